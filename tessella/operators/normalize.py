"""Normalisations of the long layout. Totals come from aggregates joined back, so that no window holds a whole feature."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log1p_total(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """value -> ln(1 + value * scale / total of the cell); cells whose total is zero keep their values."""
    totals = counts.groupBy("cell_id").agg(F.sum("value").alias("total"))
    scaled = F.when(F.col("total") == 0, F.col("value")).otherwise(F.col("value") * F.lit(scale) / F.col("total"))
    return counts.join(totals, "cell_id").select("cell_id", "feature_id", F.log1p(scaled).alias("value"))


def tfidf(counts: DataFrame, scale: float = 1e4, log_again: bool = False) -> DataFrame:
    """ln(1 + scale * value / row sum) * ln(1 + cells / column sum)."""
    rows = counts.groupBy("cell_id").agg(F.sum("value").alias("row_sum"))
    columns = counts.groupBy("feature_id").agg(F.sum("value").alias("col_sum"))
    n = counts.agg(F.countDistinct("cell_id").alias("n"))
    value = F.log1p(F.lit(scale) * F.col("value") / F.col("row_sum")) * F.log1p(F.col("n") / F.col("col_sum"))
    return counts.join(columns, "feature_id").join(rows, "cell_id").join(F.broadcast(n)).select("cell_id", "feature_id", (F.log1p(value) if log_again else value).alias("value"))


def clr(composition: DataFrame, eps: float = 1e-3) -> DataFrame:
    """proportion + eps, renormalised per unit, log, minus the unit's mean log."""
    unit = Window.partitionBy("unit")
    p = (F.col("proportion") + eps) / F.sum(F.col("proportion") + eps).over(unit)
    return composition.withColumn("l", F.log(p)).select("unit", "celltype", (F.col("l") - F.avg("l").over(unit)).alias("clr"))


def clr_clipped(composition: DataFrame) -> DataFrame:
    """Proportions clipped to [least non-zero, 1 - that], log, minus the unit's mean log; not renormalised."""
    least = composition.agg(F.min(F.when(F.col("proportion") > 0, F.col("proportion"))).alias("m"))
    clipped = composition.join(F.broadcast(least)).withColumn("l", F.log(F.least(F.greatest("proportion", "m"), 1 - F.col("m"))))
    return clipped.select("unit", "celltype", (F.col("l") - F.avg("l").over(Window.partitionBy("unit"))).alias("clr"))


def align_features(counts: DataFrame, n_cells: int, method: str = "zscore") -> DataFrame:
    """cell_id, feature_id, value, zero_value: each feature brought to one scale, so that two modalities can be compared.

    zscore: minus the mean, by the sample deviation (1 where it is 0); minmax: to [0, 1], constant features to 0; rank: the mean rank by n_cells.
    Entries that are not stored count as zeros, and zero_value is what they become. Values must not be negative. Equal values of a feature are
    counted before they are ranked.
    """
    if method == "rank":
        same = counts.groupBy("feature_id", "value").agg(F.count("*").alias("n"))
        stored = counts.groupBy("feature_id").agg(F.sum((F.col("value") > 0).cast("long")).alias("above"))
        below = F.sum("n").over(Window.partitionBy("feature_id").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
        zeros = F.lit(n_cells) - F.col("above")
        ranked = same.where("value > 0").withColumn("below", F.coalesce(below, F.lit(0))).join(stored, "feature_id")
        ranked = ranked.select("feature_id", "value", ((zeros + F.col("below") + (F.col("n") + 1) / 2.0) / n_cells).alias("r"))
        out = counts.join(ranked, ["feature_id", "value"], "left").join(stored, "feature_id")
        zero = (zeros + 1) / 2.0 / n_cells
        return out.select("cell_id", "feature_id", F.coalesce("r", zero).alias("value"), zero.alias("zero_value"))
    n = F.lit(float(n_cells))
    moments = counts.groupBy("feature_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.count("*").alias("stored"))
    if method == "zscore":
        variance = F.greatest((F.col("ss") - F.col("s") * F.col("s") / n) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0))
        scale = moments.select("feature_id", (F.col("s") / n).alias("shift"), F.when(variance > 0, F.sqrt(variance)).otherwise(1.0).alias("by"))
    elif method == "minmax":
        least = F.when(F.col("stored") < n, F.least("lo", F.lit(0.0))).otherwise(F.col("lo"))
        scale = moments.select("feature_id", least.alias("shift"), F.when(F.col("hi") > least, F.col("hi") - least).otherwise(1.0).alias("by"))
    else:
        raise ValueError(f"no alignment is called {method}")
    return counts.join(scale, "feature_id").select("cell_id", "feature_id", ((F.col("value") - F.col("shift")) / F.col("by")).alias("value"), (-F.col("shift") / F.col("by")).alias("zero_value"))


#: Points of a reference distribution, and rows of a feature that are mapped at a time.
QUANTILES, ROWS = 1000, 100_000


def align_quantiles(reference: DataFrame, target: DataFrame, zero_aware: bool = True, strict_reference: bool = True) -> DataFrame:
    """cell_id, feature_id, value, zero_value of target: each feature that both have carried to its distribution in reference. Both hold normalised values, 0 or more.

    A value's share u is its place among min(QUANTILES, n) quantiles of the reference, the mean of the lowest and highest place for repeated ones;
    the result is the reference's quantile at u, or with strict_reference at the normal distribution's share below u (which keeps to the upper half:
    what the usual pair of a uniform and a normal quantile transform gives). zero_aware: only positive values count and change, and a feature needs
    two of them on both sides; else entries that are not stored count as zeros, and zero_value is what they become. Other features stay as they are.
    """
    cells = lambda df: df.agg(F.countDistinct("cell_id")).first()[0]
    n_reference = cells(reference)
    known, own = (df.where("value > 0") if zero_aware else df for df in (reference, target))
    n = known.groupBy("feature_id").agg(F.count("*").alias("stored")).withColumn("n", F.col("stored") if zero_aware else F.lit(n_reference))
    enough = own.groupBy("feature_id").agg(F.count("*").alias("rows")).where("rows > 1" if zero_aware else "rows > 0")
    sized = n.where("n > 1").join(enough, "feature_id")
    shares = F.array(*[F.lit(i / (QUANTILES - 1)) for i in range(QUANTILES)])
    weighed = known.select("feature_id", "value", F.lit(1).cast("long").alias("w")).join(sized.select("feature_id", "stored", "n"), "feature_id")
    if not zero_aware:
        weighed = weighed.unionByName(sized.where("n > stored").select("feature_id", F.lit(0.0).alias("value"), (F.col("n") - F.col("stored")).alias("w"), "stored", "n"))
    # Few values are their own quantiles; of many the quantiles are made without gathering them.
    few = weighed.where(F.col("n") <= QUANTILES).groupBy("feature_id").agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat("value", F.col("w").cast("int"))))).alias("q"))
    many = weighed.where(F.col("n") > QUANTILES).groupBy("feature_id").agg(F.percentile(F.col("value"), shares, F.col("w")).alias("q"))
    quantiles = few.unionByName(many).join(sized.select("feature_id", "rows"), "feature_id").withColumn("parts", (F.floor(F.col("rows") / ROWS) + 1).cast("int"))
    part = F.pmod(F.xxhash64("cell_id"), F.col("parts")).cast("int")
    rows = own.join(quantiles.select("feature_id", "parts"), "feature_id").select("cell_id", "feature_id", F.col("value").cast("double").alias("value"), part.alias("part"))
    each = quantiles.select(F.col("feature_id").alias("of"), "q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of_part"))

    def carry(values: np.ndarray, q: np.ndarray) -> np.ndarray:
        share = np.linspace(0, 1, len(q))
        u = 0.5 * (np.interp(values, q, share) - np.interp(-values, -q[::-1], -share[::-1]))
        u = np.where(values <= q[0], 0.0, np.where(values >= q[-1], 1.0, u))
        if strict_reference:
            u = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in u])
        return np.interp(u, share, q)

    def bring(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"cell_id": [], "feature_id": [], "value": [], "zero_value": []})
        q = np.array(right["q"].iloc[0], float)
        zero = 0.0 if zero_aware else float(carry(np.zeros(1), q)[0])
        return pd.DataFrame({"cell_id": left["cell_id"], "feature_id": left["feature_id"], "value": carry(left["value"].to_numpy(float), q), "zero_value": zero})

    kinds = dict(target.dtypes)
    done = rows.groupBy("feature_id", "part").cogroup(each.groupBy("of", "of_part")).applyInPandas(bring, f"cell_id {kinds['cell_id']}, feature_id {kinds['feature_id']}, value double, zero_value double")
    rest = target.join(sized, "feature_id", "left_anti").select("cell_id", "feature_id", F.col("value").cast("double").alias("value"), F.lit(0.0).alias("zero_value"))
    out = done.unionByName(rest)
    if zero_aware:
        out = out.unionByName(target.where("value = 0").join(sized, "feature_id", "left_semi").select("cell_id", "feature_id", F.lit(0.0).alias("value"), F.lit(0.0).alias("zero_value")))
    return out
