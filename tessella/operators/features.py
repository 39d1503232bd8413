"""Feature selection: variance of standardised counts, binned dispersion, plain variance, significance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def local_fit(x: np.ndarray, y: np.ndarray, span: float) -> np.ndarray:
    """Local quadratic regression with tricube weights; x ascends, so the nearest points are a window that moves up."""
    n = len(x)
    k = min(n, max(4, int(np.ceil(span * n))))
    out, low = np.empty(n), 0
    for i in range(n):
        while low + k < n and x[low + k] - x[i] < x[i] - x[low]:
            low += 1
        near = slice(low, low + k)
        d = np.abs(x[near] - x[i])
        h = d.max() or 1.0
        w = np.sqrt(np.clip(1 - (d / h) ** 3, 0, 1) ** 3)
        a = np.vander(x[near] - x[i], 3, increasing=True)
        beta, *_ = np.linalg.lstsq(a * w[:, None], y[near] * w, rcond=None)
        out[i] = beta[0]
    return out


def variable_by_standardised(counts: DataFrame, n_cells: int, top: int, span: float = 0.3) -> DataFrame:
    """feature_id, variance (of clipped standardised counts), rank <= top. The mean-variance curve is fitted at the driver on a row
    per feature, all features; the clipped second moment is an aggregate over all counts."""
    spark = counts.sparkSession
    m = counts.groupBy("feature_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / n_cells
    var = (F.col("q") - n_cells * mean * mean) / max(1, n_cells - 1)
    stats = m.select("feature_id", mean.alias("mean"), var.alias("var"))
    usable = stats.where("var > 0 and mean > 0").select(F.log10("mean").alias("x"), F.log10("var").alias("y"))
    points = usable.collect()
    if not points:
        return spark.createDataFrame([], "feature_id string, variance double, rank int")
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    for s in (span, 0.5, 0.8, 1.0):
        fitted = local_fit(x, y, s)
        if np.isfinite(fitted).all():
            break
    kx, first = np.unique(x, return_index=True)
    sent = spark.sparkContext.broadcast((kx, fitted[first]))

    @F.pandas_udf("double")
    def expected(v):
        import pandas as pd

        return pd.Series(10 ** (np.interp(np.log10(np.maximum(v, 1e-300)), *sent.value) / 2))

    sd = stats.where("var > 0 and mean > 0").withColumn("sd", expected("mean"))
    clip = float(np.sqrt(n_cells))
    z = F.least((F.col("value") - F.col("mean")) / F.col("sd"), F.lit(clip))
    zero = F.least(-F.col("mean") / F.col("sd"), F.lit(clip))
    sums = counts.join(sd, "feature_id").groupBy("feature_id", "mean", "sd").agg(F.sum(z).alias("zs"), F.sum(z * z).alias("zq"), F.count("*").alias("n"))
    zs, zq = F.col("zs") + (n_cells - F.col("n")) * zero, F.col("zq") + (n_cells - F.col("n")) * zero * zero
    v = sums.select("feature_id", ((zq - zs * zs / n_cells) / max(1, n_cells - 1)).alias("variance"))
    best = v.orderBy(F.desc("variance"), "feature_id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance"), "feature_id")))


def variable_by_batch(counts: DataFrame, batches: DataFrame, top: int, span: float = 0.3) -> DataFrame:
    """feature_id, batches, median_rank, rank: features by the median of their ranks in the batches whose top they are in, then by the number of
    those. batches: cell_id, batch; a batch is ranked on its own, and batches without a variable feature are left out."""
    per = None
    for batch, n in sorted(map(tuple, batches.where("batch is not null").groupBy("batch").count().collect())):  # batches, not cells
        own = variable_by_standardised(counts.join(batches.where(F.col("batch") == batch).select("cell_id"), "cell_id", "left_semi"), n, top, span).select("feature_id", "rank")
        per = own if per is None else per.unionByName(own)
    if per is None:
        return counts.sparkSession.createDataFrame([], "feature_id string, batches long, median_rank double, rank int")
    scored = per.groupBy("feature_id").agg(F.count("*").alias("batches"), F.median("rank").alias("median_rank"))
    best = scored.orderBy("median_rank", F.desc("batches"), "feature_id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("median_rank", F.desc("batches"), "feature_id")))


def variable_by_dispersion(means: DataFrame, top: int, bins: int = 20) -> DataFrame:
    """feature_id, dispersion (z-score within its bin of means), rank. means: feature_id, mean, variance.

    Ranks go by the dispersion to 9 places, then by feature_id: the two features of a bin of two have the same size of z-score in every such bin, and the
    rounding of sums, in whatever order they were added, would else decide between bins.
    """
    base = means.where("mean > 0").withColumn("d", F.log(F.greatest(F.col("variance") / F.col("mean"), F.lit(1e-12)))).withColumn("m", F.log1p("mean"))
    ends = base.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    binned = base.join(F.broadcast(ends)).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-12) * bins)))
    per = binned.groupBy("bin").agg(F.avg("d").alias("bm"), F.stddev_samp("d").alias("bs"))
    z = binned.join(F.broadcast(per), "bin").select("feature_id", F.when(F.col("bs") > 0, (F.col("d") - F.col("bm")) / F.col("bs")).otherwise(1.0).alias("dispersion"))
    order = [F.desc(F.round("dispersion", 9)), F.asc("feature_id")]
    return z.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def variable_by_variance(counts: DataFrame, n_cells: int, top: int) -> DataFrame:
    """feature_id, variance (population, zeros counted), the top of it."""
    m = counts.groupBy("feature_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / F.lit(float(n_cells))
    return m.select("feature_id", (F.col("q") / F.lit(float(n_cells)) - mean * mean).alias("variance")).orderBy(F.desc("variance"), "feature_id").limit(top)


def significance_order(results: DataFrame, level: float = 0.05) -> DataFrame:
    """celltype, n_significant, least, rank: types by how many of their comparisons are significant, then the least p, then the name."""
    per = results.groupBy("celltype").agg(F.sum((F.col("p") < level).cast("long")).alias("n_significant"), F.min("p").alias("least"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_significant"), "least", "celltype")))
