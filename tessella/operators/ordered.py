"""Running sums over a whole table in an order, without a window that holds all rows.

Rows fall into buckets between approximate quantiles of the order column; sums are made over the buckets (a few thousand rows), then inside each.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window may hold, rows of a bucket, and the most buckets.
WHOLE, ROWS, MOST = 200_000, 100_000, 4096


def before(rows: DataFrame, order: str, ties: list[str], name: str, value: str | None = None) -> DataFrame:
    """rows with name: the sum of value (without one: the number) of the rows before, in ascending order of order, then of ties; nulls first.

    order must be a number, date or timestamp for more than WHOLE rows; equal values of it fall into one bucket.
    """
    n = rows.count()
    amount = F.col(value) if value else F.lit(1)
    if n <= WHOLE:
        return rows.withColumn(name, F.coalesce(F.sum(amount).over(Window.orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.col(order).cast("double") if dict(rows.dtypes)[order] not in ("date", "timestamp", "timestamp_ntz") else F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    marked = rows.withColumn("__order_x", number)
    buckets = min(MOST, -(-n // ROWS))
    cuts = marked.agg(F.percentile_approx("__order_x", [k / buckets for k in range(1, buckets)], 100_000)).first()[0] or []
    cuts = sorted({c for c in cuts if math.isfinite(c)}) or [0.0]
    inside = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__order_x", outputCol="__order_b", handleInvalid="keep").transform(marked)
    inside = inside.withColumn("__order_b", F.when(F.col(order).isNull(), -1).otherwise(F.col("__order_b")).cast("int"))
    per = inside.groupBy("__order_b").agg(F.sum(amount).alias("__order_s"))
    first = per.select(F.col("__order_b").alias("__order_of"), F.coalesce(F.sum("__order_s").over(Window.orderBy("__order_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__order_base"))
    met = inside.join(F.broadcast(first), F.col("__order_b") == F.col("__order_of"))  # MOST + 2 rows at most
    own = F.sum(amount).over(Window.partitionBy("__order_b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1))
    return met.select(*[c for c in rows.columns if c != name], (F.col("__order_base") + F.coalesce(own, F.lit(0))).alias(name))
