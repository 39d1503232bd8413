"""A whole run from a configuration: quality, normalisation, embeddings, compositions, distances, trajectory, tests; each stage's tables are written
and read again, and a stage that the status file has as done is not run twice.

Tables below the output folder: quality_counts, quality_cells, embedding (cells), cell_types, composition, units, distances, pseudotime, associations.
Samples are what the sample column says; cell types come from their column, or from clusters of nearest neighbours where it is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, compose, distance, embedding, features, neighbours, normalize, qc, stats, trajectory
from ..sources.tables import RunConfig, read_matrix, read_status, read_table, write_status

METRICS = ("euclidean", "cosine", "jensenshannon")


def quality(spark: SparkSession, c: RunConfig) -> dict[str, DataFrame]:
    """Cells by features and special share, features by cells, samples by cells; sample and cell type as strings."""
    matrix = read_matrix(spark, c.input)
    special = F.upper("feature_id").startswith(c.special_prefix.upper()) if c.special_prefix else F.lit(False)
    kept = qc.cell_metrics(matrix["counts"], special).where((F.col("n_features") >= c.min_features) & (F.col("pct_special") <= c.max_pct_special))
    cells = matrix["cells"].join(kept.select("cell_id"), "cell_id", "left_semi").where(F.col(c.sample_column).isNotNull())
    cells = qc.samples_with_cells(cells, c.min_cells, c.sample_column)
    counts = matrix["counts"].join(cells.select("cell_id"), "cell_id", "left_semi")
    return {"quality_counts": qc.drop_features(qc.features_in_share(counts), special), "quality_cells": cells}


def cell_embedding(spark: SparkSession, c: RunConfig) -> dict[str, DataFrame]:
    """Principal components of the variable features of log-normalised counts."""
    counts, cells = (read_table(spark, c.output, t) for t in ("quality_counts", "quality_cells"))
    best = features.variable_by_standardised(counts, cells.count(), c.variable_features)
    logged = normalize.log1p_total(counts).join(best.select("feature_id"), "feature_id", "left_semi")
    return {"embedding": embedding.count_pca(logged, 2 * c.components, seed=c.seed)}


def cell_types(spark: SparkSession, c: RunConfig) -> dict[str, DataFrame]:
    cells, vectors = read_table(spark, c.output, "quality_cells"), read_table(spark, c.output, "embedding")
    if c.celltype_column:
        return {"cell_types": cells.select("cell_id", F.col(c.celltype_column).cast("string").alias("celltype"))}
    links = neighbours.nearest(vectors, vectors, 15, id_col="cell_id", vector="pc")
    found = clusters.cell_types(links, vectors, "cell_id", "pc", target=c.cell_types or None, seed=c.seed)
    return {"cell_types": found.select("cell_id", F.col("celltype").cast("string").alias("celltype"))}


def units(spark: SparkSession, c: RunConfig) -> dict[str, DataFrame]:
    """Compositions and the samples' embedding."""
    cells = read_table(spark, c.output, "quality_cells").withColumn("unit", F.col(c.sample_column).cast("string"))
    extra = [F.col(c.batch_column).cast("string").alias("batch")] if c.batch_column else []
    both = cells.select("cell_id", "unit", *extra).join(read_table(spark, c.output, "cell_types"), "cell_id").join(read_table(spark, c.output, "embedding"), "cell_id")
    k = {"k_medium": c.k_medium or None, "k_fine": c.k_fine or None}
    made = embedding.sample_embedding(both, "unit", "celltype", "pc", "cell_id", "batch" if c.batch_column else None, **k, alpha=c.alpha, components=c.components, method=c.correction, seed=c.seed)
    return {"composition": compose.composition(both), "units": made}


def distances(spark: SparkSession, c: RunConfig) -> dict[str, DataFrame]:
    v = read_table(spark, c.output, "units").select("unit", F.col("pc").alias("v"))
    tables = [distance.pairwise(v, m) for m in METRICS[:2]] + [distance.jensen_shannon(read_table(spark, c.output, "composition"))]
    named = [t.select(F.lit(m).alias("metric"), "a", "b", F.col("distance").cast("double").alias("distance")) for m, t in zip(METRICS, tables, strict=True)]
    return {"distances": named[0].unionByName(named[1]).unionByName(named[2])}


def pseudotime(spark: SparkSession, c: RunConfig) -> dict[str, DataFrame]:
    """Along the target by canonical correlation if there is one, else along the tree of clusters; and each component's share explained by it."""
    u = read_table(spark, c.output, "units")
    if c.target_column:
        target = compose.first_known(read_table(spark, c.output, "quality_cells"), c.sample_column, [c.target_column], "cell_id")
        known = u.join(target.select(F.col(c.sample_column).cast("string").alias("unit"), F.col(c.target_column).try_cast("double").alias("y")), "unit", "left")
        time = trajectory.cca_pseudotime(known, "unit", "pc", "y").select("unit", "pseudotime")
    else:
        time = trajectory.tree_pseudotime(u, "unit", "pc", seed=c.seed).select("unit", "pseudotime")
    n = u.agg(F.max(F.size("pc"))).first()[0] or 0
    wide = u.join(time, "unit").select("unit", "pseudotime", *[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(n)])
    return {"pseudotime": time, "associations": stats.r2_continuous(wide, "pseudotime", [f"pc{i + 1}" for i in range(n)])}


#: In this order; each reads what those before it wrote.
STAGES: dict[str, Callable[[SparkSession, RunConfig], dict[str, DataFrame]]] = {"quality": quality, "cell_embedding": cell_embedding, "cell_types": cell_types, "units": units, "distances": distances, "pseudotime": pseudotime}


def run(spark: SparkSession, config: RunConfig) -> dict[str, bool]:
    """Run what isn't done yet; the stages that ran this time."""
    status, ran = f"{config.output}/status", {}
    done = read_status(spark, status)
    for name, stage in STAGES.items():
        if ran or not done.get(name):  # what follows a stage that ran is stale
            for table, df in stage(spark, config).items():
                df.write.mode("overwrite").parquet(f"{config.output}/{table}.parquet")
            write_status(spark, status, {name: True} | {later: False for later in list(STAGES)[list(STAGES).index(name) + 1 :]})
            ran[name] = True
    return ran
