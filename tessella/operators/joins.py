"""Metadata joins, label propagation, overlays, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_cell_metadata(cells: DataFrame, meta: DataFrame, key: str = "cell_id") -> DataFrame:
    return cells.join(meta, key, "left")


def join_sample_metadata(cells: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Left join; columns on both sides come from meta, whose null strings become Unknown before; unmatched rows stay null."""
    known = meta.select(*[F.coalesce(c, F.lit("Unknown")).alias(c) if t == "string" and c != key else F.col(c) for c, t in meta.dtypes])
    return cells.drop(*[c for c in meta.columns if c != key]).join(known, key, "left")


def join_loose(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join on trimmed, lower-cased ids."""
    plain = lambda c: F.lower(F.trim(F.col(c)))
    return left.withColumn("__k", plain(left_key)).join(right.withColumn("__k", plain(right_key)), "__k").drop("__k")


def propagate_labels(union: DataFrame, cells: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """cells with the label of the first union row of their key."""
    first = union.groupBy(key).agg(F.min_by(label, order).alias(label))
    return cells.join(first, key, "left")


def overlay_labels(cells: DataFrame, fine: DataFrame, finer: DataFrame, key: str, broad: str) -> DataFrame:
    """finer over fine over the broad label."""
    a, b = fine.select(key, F.col("label").alias("__a")), finer.select(key, F.col("label").alias("__b"))
    return cells.join(a, key, "left").join(b, key, "left").withColumn("label", F.coalesce("__b", "__a", broad)).drop("__a", "__b")


def align_genes(left: DataFrame, right: DataFrame, key, mapping: DataFrame | None = None) -> DataFrame:
    """gene, left_id, right_id: unified keys on both sides, the first id of a key wins, sorted intersection."""

    def keyed(df, name):
        out = df.withColumn("gene", key(F.col("feature_id")))
        if mapping is not None:
            out = out.join(mapping, out["gene"] == mapping["symbol"], "left").withColumn("gene", F.coalesce("mapped", "gene"))
        return out.groupBy("gene").agg(F.min("feature_id").alias(name))

    return keyed(left, "left_id").join(keyed(right, "right_id"), "gene").orderBy("gene")


def map_genes(features: DataFrame, mapping: DataFrame, policy: str = "first", least: float = 0.0) -> DataFrame:
    """features(feature_id) -> gene_id by mapping(symbol, gene_id); duplicates dropped, suffixed or kept.

    A symbol with several ids takes the least. Raises if under `least` of the features are mapped.
    """
    one = mapping.groupBy(F.upper("symbol").alias("k")).agg(F.min("gene_id").alias("gene_id"))
    out = features.withColumn("k", F.upper("feature_id")).join(one, "k", "left").drop("k")
    if least:
        rate = out.agg(F.avg(F.col("gene_id").isNotNull().cast("double"))).first()[0] or 0.0
        if rate < least:
            raise ValueError(f"{rate:.1%} of the features are mapped; {least:.1%} are asked for")
    out = out.where("gene_id is not null")
    if policy == "keep":
        return out
    ranked = out.withColumn("k", F.row_number().over(Window.partitionBy("gene_id").orderBy("feature_id")))
    if policy == "first":
        return ranked.where("k = 1").drop("k")
    return ranked.withColumn("gene_id", F.when(F.col("k") > 1, F.concat_ws("-", "gene_id", F.col("k") - 1)).otherwise(F.col("gene_id"))).drop("k")


def identifier_kind(features: DataFrame, is_ensembl) -> DataFrame:
    """One row: the share of Ensembl-like ids, and what the features are: over 0.8 ensembl, under 0.4 symbols, else mixed."""
    share = features.agg(F.avg(is_ensembl(F.col("feature_id")).cast("double")).alias("share"))
    return share.withColumn("kind", F.when(F.col("share") > 0.8, "ensembl").when(F.col("share") <= 0.4, "symbol").otherwise("mixed"))


def union_modalities(rna: DataFrame, atac: DataFrame, key: str = "cell_id", modalities=("RNA", "ATAC")) -> DataFrame:
    """Both sides' rows, shared columns only; ids suffixed by modality, the original kept."""
    shared = [c for c in rna.columns if c in atac.columns and c != key]
    side = lambda df, m: df.select(F.concat_ws("_", F.col(key).cast("string"), F.lit(m)).alias(key), F.col(key).cast("string").alias("original_barcode"), F.lit(m).alias("modality"), *shared)
    return side(rna, modalities[0]).unionByName(side(atac, modalities[1]))


def merge_matrices(parts: list[DataFrame], how: str = "inner") -> DataFrame:
    """Long matrices in one; inner keeps the features that every part has."""
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    both = tagged[0]
    for p in tagged[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    if how == "outer":
        return both.drop("part")
    common = both.groupBy("feature_id").agg(F.countDistinct("part").alias("n")).where(F.col("n") == len(parts))
    return both.join(common.select("feature_id"), "feature_id", "left_semi").drop("part")


def paired_units(units: DataFrame, unit: str, base, modality, a: str = "RNA", b: str = "ATAC") -> DataFrame:
    """base, a's unit, b's unit of the bases that both modalities have."""
    keyed = units.select(F.col(unit), base(F.col(unit)).alias("base"), modality(F.col(unit)).alias("m"))
    left = keyed.where(F.col("m") == a).select("base", F.col(unit).alias("unit_a"))
    return left.join(keyed.where(F.col("m") == b).select("base", F.col(unit).alias("unit_b")), "base")


def with_pseudotime(meta: DataFrame, pseudotime: DataFrame, sample: str = "sample") -> DataFrame:
    """The metadata of the samples that have a pseudotime, with it; ids are compared as trimmed strings."""
    key = lambda c: F.trim(F.col(c).cast("string"))
    own = pseudotime.select(key("sample").alias("__key"), "pseudotime")
    return meta.withColumn("__own", key(sample)).join(own, F.col("__own") == F.col("__key")).drop("__own", "__key")


def match_samples(reduced: DataFrame, samples: DataFrame, cells: DataFrame | None = None, key: str = "sample") -> DataFrame:
    """The rows of reduced whose sample is among samples: by the very name; if none is, by the name in small letters, renamed to the other side's; if
    none is either, by the names in cells. Nothing in common is an error."""
    names = samples.select(F.col(key).cast("string").alias("__name")).distinct()
    exact = reduced.join(names, F.col(key).cast("string") == F.col("__name"), "left_semi")
    if not exact.isEmpty():
        return exact
    small = names.groupBy(F.lower("__name").alias("__small")).agg(F.min("__name").alias("__name"))
    loose = reduced.join(small, F.lower(F.col(key).cast("string")) == F.col("__small")).withColumn(key, F.col("__name")).drop("__small", "__name")
    if not loose.isEmpty():
        return loose
    if cells is not None:
        return match_samples(reduced, cells, None, key)
    raise ValueError("no sample is in both tables")
