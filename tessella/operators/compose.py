"""Aggregates from cells to units: compositions, pseudobulk, metadata, contingency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def composition(cells: DataFrame, unit: str = "unit", celltype: str = "celltype") -> DataFrame:
    """unit, celltype, n, proportion; absent pairs are filled with zero (units times types: both small)."""
    n = cells.groupBy(unit, celltype).agg(F.count("*").alias("n"))
    grid = n.select(unit).distinct().join(F.broadcast(n.select(celltype).distinct()))
    filled = grid.join(n, [unit, celltype], "left").na.fill(0, ["n"])
    return filled.select(F.col(unit).alias("unit"), F.col(celltype).alias("celltype"), "n", (F.col("n") / F.sum("n").over(Window.partitionBy(unit))).alias("proportion"))


def majority(rows: DataFrame, unit: str, label: str) -> DataFrame:
    """The most frequent label of each unit; ties go to the least label."""
    n = rows.groupBy(unit, label).agg(F.count("*").alias("n"))
    return n.groupBy(unit).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label), F.max("n").alias("n"))


def first_known(rows: DataFrame, unit: str, columns: list[str], order: str) -> DataFrame:
    """The first non-null of each column per unit, first by order."""
    return rows.groupBy(unit).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def pseudobulk(counts: DataFrame, cells: DataFrame, by: list[str], how: str = "mean") -> DataFrame:
    """by..., feature_id, value: sums over a group's cells; the mean divides by all its cells, zeros included.

    counts joins the cells once; the number of cells comes from cells, not from counts, and groups without a feature have 0.
    """
    sums = counts.join(cells.select("cell_id", *by), "cell_id").groupBy(*by, "feature_id").agg(F.sum("value").alias("value"))
    sizes = cells.groupBy(*by).agg(F.count("*").alias("n"))
    grid = sizes.crossJoin(sums.select("feature_id").distinct())
    out = grid.join(sums, [*by, "feature_id"], "left").na.fill(0.0, ["value"])
    return out.select(*by, "feature_id", (F.col("value") / F.col("n") if how == "mean" else F.col("value")).alias("value"))


def pseudobulk_features(counts: DataFrame, cells: DataFrame, unit: str, celltype: str) -> DataFrame:
    """unit, feature `type - gene`, mean over all cells of unit and type; 0 for units without such cells or counts. Features that are 0 in every
    unit are left out. A row per unit and feature, made from one record per feature that holds its units."""
    sums = counts.join(cells.select("cell_id", unit, celltype), "cell_id").groupBy(unit, celltype, "feature_id").agg(F.sum("value").alias("s"))
    sizes = cells.groupBy(unit, celltype).agg(F.count("*").alias("n"))
    means = sums.join(sizes, [unit, celltype]).groupBy(celltype, "feature_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col(unit), (F.col("s") / F.col("n")).alias("m")))).alias("m"), F.max(F.col("s") != 0).alias("some"))
    units = [r[0] for r in cells.select(unit).where(F.col(unit).isNotNull()).distinct().orderBy(unit).collect()]  # units, not cells
    each = means.where("some").withColumn(unit, F.explode(F.array(*map(F.lit, units)) if units else F.array().cast(f"array<{cells.schema[unit].dataType.simpleString()}>")))
    return each.select(unit, F.concat_ws(" - ", celltype, "feature_id").alias("feature"), F.coalesce(F.element_at("m", F.col(unit)), F.lit(0.0)).alias("value"))


def pseudobulk_corrected(counts: DataFrame, cells: DataFrame, unit: str, celltype: str, batch: str | None = None, top: int | None = 2000) -> DataFrame:
    """pseudobulk_features, each cell type on its own: without the batches' effects (a unit's batch is its most frequent one; the mean over the batches
    stays), then the top features of the type by dispersion within bins of means."""
    from .features import variable_by_dispersion

    values = pseudobulk_features(counts, cells, unit, celltype)
    if batch:
        of = majority(cells, unit, batch).select(unit, F.col(batch).alias("__batch"))
        per = Window.partitionBy("feature", "__batch")
        met = values.join(of, unit).withColumn("__mean", F.avg("value").over(per)).withColumn("__first", F.row_number().over(per.orderBy(unit)) == 1)
        level = F.avg(F.when(F.col("__first"), F.col("__mean"))).over(Window.partitionBy("feature"))
        values = met.select(unit, "feature", (F.col("value") - F.col("__mean") + level).alias("value"))
    if top is None:
        return values
    kind = F.substring_index("feature", " - ", 1)
    moments = values.groupBy("feature").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance")).withColumn("kind", kind)
    kept = None
    for (k,) in sorted(map(tuple, moments.select("kind").distinct().collect())):  # types, not cells
        own = variable_by_dispersion(moments.where(F.col("kind") == k).select(F.col("feature").alias("feature_id"), "mean", "variance"), top).select(F.col("feature_id").alias("feature"))
        kept = own if kept is None else kept.unionByName(own)
    return values if kept is None else values.join(kept, "feature", "left_semi").select(unit, "feature", "value")


def mean_and_variance(counts: DataFrame, cells: DataFrame, sample: str) -> DataFrame:
    """sample, feature_id, mean, variance within the sample: E[x^2] - mean^2, times n / (n - 1); absent entries count as zeros."""
    s = counts.join(cells.select("cell_id", sample), "cell_id").groupBy(sample, "feature_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    n = cells.groupBy(sample).agg(F.count("*").alias("n"))
    mean = F.col("s") / F.col("n")
    return s.join(n, sample).where("n > 1").select(sample, "feature_id", mean.alias("mean"), ((F.col("q") / F.col("n") - mean * mean) * F.col("n") / (F.col("n") - 1)).alias("variance"))


def centroids(cells: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """label, dim (from 1), value: the mean of the first dims coordinates."""
    long = cells.select(label, F.posexplode(F.slice(vector, 1, dims)).alias("dim", "x"))
    return long.groupBy(label, (F.col("dim") + 1).alias("dim")).agg(F.avg(F.col("x").cast("double")).alias("value"))


def sample_grouping(cells: DataFrame, sample: str, numeric: str, text: str, width: float) -> DataFrame:
    """A label per sample: floor bin of the mean of numeric, and the most frequent text, joined by `_`."""
    means = cells.groupBy(sample).agg(F.avg(numeric).alias("mean"))
    least = means.agg(F.min("mean").alias("least"))
    binned = means.join(F.broadcast(least)).select(sample, F.floor((F.col("mean") - F.col("least")) / F.lit(width)).cast("long").alias("bin"))
    return binned.join(majority(cells, sample, text).select(sample, text), sample).select(sample, "bin", text, F.concat_ws("_", F.col("bin").cast("string"), F.col(text)).alias("grouping"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count("*").alias("n"))


def describe_by(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Count, mean, standard deviation by a, by b, and by both: one pass with grouping sets."""
    sets = rows.groupingSets([[F.col(a)], [F.col(b)], [F.col(a), F.col(b)]], F.col(a), F.col(b))
    return sets.agg(F.grouping_id().cast("int").alias("level"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def time_weighted(rows: DataFrame, key: str, ts: Column, value: str) -> DataFrame:
    """Per key: sum(value * dt) / sum(dt) with dt since the row before, and the peak."""
    order = Window.partitionBy(key).orderBy("t", "event_id")
    dt = rows.withColumn("t", ts).withColumn("dt", F.col("t") - F.lag("t").over(order))
    return dt.groupBy(key).agg((F.sum(F.col(value) * F.col("dt")) / F.sum(F.when(F.col(value).isNotNull(), F.col("dt")))).alias("weighted"), F.max(value).alias("peak"))


def gene_concordance(links: DataFrame, min_peaks: int = 5, least: float = 0.8) -> DataFrame:
    """gene, n, agreeing share, concordant: genes with at least min_peaks links whose sign agrees in at least that share."""
    out = links.groupBy("gene").agg(F.count("*").alias("n"), F.avg(F.col("agrees").cast("double")).alias("share"))
    return out.where(F.col("n") >= min_peaks).withColumn("concordant", F.col("share") >= least)


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: purity, adjusted Rand index and normalised mutual information of two labelings, from their contingency."""
    n = contingency(rows, a, b)
    pairs = lambda c: F.sum(c * (c - 1) / 2.0)
    ra, rb = n.groupBy(a).agg(F.sum("n").alias("na")), n.groupBy(b).agg(F.sum("n").alias("nb"))
    all_ = n.agg(F.sum("n").cast("double").alias("total"))
    entropy = lambda df, c: df.join(F.broadcast(all_)).agg((-F.sum(F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total")))).alias(f"h_{c}"), pairs(F.col(c)).alias(f"p_{c}"))
    cell = n.join(ra, a).join(rb, b).join(F.broadcast(all_))
    mutual = cell.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"), pairs(F.col("n")).alias("index"), F.first("total").alias("total"))
    pure = n.groupBy(b).agg(F.max("n").alias("m")).agg(F.sum("m").alias("pure"))
    one = mutual.join(F.broadcast(entropy(ra, "na"))).join(F.broadcast(entropy(rb, "nb"))).join(F.broadcast(pure))
    expected = F.col("p_na") * F.col("p_nb") / (F.col("total") * (F.col("total") - 1) / 2.0)
    return one.select((F.col("pure") / F.col("total")).alias("purity"), ((F.col("index") - expected) / ((F.col("p_na") + F.col("p_nb")) / 2.0 - expected)).alias("ari"), (F.col("mi") / ((F.col("h_na") + F.col("h_nb")) / 2.0)).alias("nmi"))
