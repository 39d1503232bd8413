"""Sources and sinks of the long layout, metadata files, run records and profiles."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_matrix(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three tables of an annotated matrix: counts, cells, features."""
    return {n: read_table(spark, folder, n) for n in ("counts", "cells", "features")}


def write_matrix(tables: dict[str, DataFrame], folder: str, clean: bool = False) -> None:
    """clean: null strings of cells become Unknown, as an export."""
    for name, df in tables.items():
        out = df.na.fill("Unknown", [c for c, t in df.dtypes if t == "string"]) if clean and name == "cells" else df
        out.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_table(df: DataFrame, path: str) -> None:
    """By the path's ending: csv, tsv or txt (tabs) with a header, json, parquet. Columns of arrays and structs are written as JSON text where the format has none."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    writer = lambda x: x.write.mode("overwrite")
    if kind == "parquet":
        writer(df).parquet(path)
    elif kind == "json":
        writer(df).json(path)
    elif kind in ("csv", "tsv", "txt"):
        flat = df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes])
        writer(flat).option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)
    else:
        raise ValueError(f"no table is written as {kind}")


def read_gene_models(spark: SparkSession, path: str, feature: str = "gene") -> DataFrame:
    """gene_id (without version), gene, chrom (with chr), start (0-based), end, strand, biotype from a GTF or GFF3 text, a row per line of that feature."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where((F.size("f") == 9) & (F.col("f")[2] == feature))
    more = F.col("f")[8]

    def attribute(*names):
        found = [F.nullif(F.regexp_extract(more, rf'(?:^|;\s*){n}(?:=|\s+)"?([^";]*)"?', 1), F.lit("")) for n in names]
        return F.coalesce(*found)

    chrom = F.when(F.col("f")[0].startswith("chr"), F.col("f")[0]).otherwise(F.concat(F.lit("chr"), F.col("f")[0]))
    gene_id = F.substring_index(F.regexp_replace(attribute("gene_id", "ID"), "^gene:", ""), ".", 1)
    return lines.select(gene_id.alias("gene_id"), F.coalesce(attribute("gene_name", "Name"), gene_id).alias("gene"), chrom.alias("chrom"), (F.col("f")[3].cast("long") - 1).alias("start"), F.col("f")[4].cast("long").alias("end"), F.col("f")[6].alias("strand"), attribute("gene_type", "gene_biotype", "biotype").alias("biotype"))


def sniff_separator(spark: SparkSession, path: str) -> str:
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return max((",", "\t", ";", "|"), key=line.count)


def read_metadata(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A CSV with its separator sniffed, the byte-order mark stripped and names trimmed; key is checked."""
    df = spark.read.csv(path, header=True, inferSchema=True, sep=sniff_separator(spark, path))
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if key and key not in df.columns:
        raise ValueError(f"{path} has no column {key}")
    return df


def infer_column(columns: list[str], candidates: list[str], parts: list[str] = ()) -> str | None:
    """The first candidate that is a column (case aside), else the first column that holds one of the parts."""
    low = {c.lower(): c for c in columns}
    return next((low[c.lower()] for c in candidates if c.lower() in low), None) or next((c for c in columns if any(p.lower() in c.lower() for p in parts)), None)


def read_pseudotime(spark: SparkSession, source, sample: str | None = None, value: str | None = None) -> DataFrame:
    """sample, pseudotime from a DataFrame, a file or a dict; columns inferred, numbers coerced, nulls dropped, the first of a sample kept."""
    if isinstance(source, dict):
        source = spark.createDataFrame([(str(k), float(v)) for k, v in source.items()], "sample string, pseudotime double")
    df = read_metadata(spark, source) if isinstance(source, str) else source
    sample = sample or infer_column(df.columns, ["sample", "sample_id"], ["sample"])
    value = value or infer_column(df.columns, ["pseudotime", "ptime"], ["pseudo", "time"])
    if not sample or not value:
        raise ValueError(f"no sample or pseudotime column among {df.columns}")
    plain = df.select(F.col(sample).cast("string").alias("sample"), F.col(value).try_cast("double").alias("pseudotime"), F.monotonically_increasing_id().alias("i")).na.drop()
    return plain.groupBy("sample").agg(F.min_by("pseudotime", "i").alias("pseudotime"))


@dataclass
class RunConfig:
    """Every key must be known and every field is present."""

    input: str = ""
    output: str = ""
    sample_column: str = "sample"
    celltype_column: str = "celltype"
    batch_column: str = ""
    target_column: str = ""
    min_cells: int = 500
    min_features: int = 500
    max_pct_special: float = 20.0
    special_prefix: str = "MT-"
    variable_features: int = 2000
    cell_types: int = 0
    components: int = 10
    k_medium: int = 120
    k_fine: int = 300
    alpha: float = 0.6
    correction: str = "harmony"
    seed: int = 42


def load_config(text: str) -> RunConfig:
    """From YAML; unknown and missing keys are errors."""
    import yaml

    raw = yaml.safe_load(text) or {}
    names = {f.name for f in fields(RunConfig)}
    if unknown := sorted(set(raw) - names):
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    if missing := sorted(names - set(raw)):
        raise ValueError(f"missing keys: {', '.join(missing)}")
    return RunConfig(**raw)


def config_template() -> str:
    import yaml

    return yaml.safe_dump(asdict(RunConfig()), sort_keys=False)


def write_status(spark: SparkSession, path: str, flags: dict[str, bool]) -> dict[str, bool]:
    """Merge the stages done into a one-row JSON table and return them all."""
    merged = read_status(spark, path) | flags
    spark.createDataFrame([(json.dumps(merged, sort_keys=True),)], "status string").coalesce(1).write.mode("overwrite").text(path)
    return merged


def read_status(spark: SparkSession, path: str) -> dict[str, bool]:
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return {}
    rows = spark.read.text(path).collect()
    return json.loads(rows[0][0]) if rows else {}


def same_design(spark: SparkSession, left: str, right: str) -> bool:
    """Whether two JSON designs are equal, key order aside."""
    return json.loads(left) == json.loads(right)


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column, type, n, nulls, distinct: one pass over the table."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    plain = [(c, t) for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary"))]
    one = df.agg(F.count("*").alias("__n"), *[f.alias(f"{k}{i}") for i, (c, _) in enumerate(plain) for k, f in (("c", F.count(c)), ("d", distinct(c)))])
    items = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("__n").alias("n"), (F.col("__n") - F.col(f"c{i}")).alias("nulls"), F.col(f"d{i}").alias("distinct")) for i, (c, t) in enumerate(plain)]
    return one.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def batches_of_rows(counts: DataFrame, cells: DataFrame, start: int, size: int) -> DataFrame:
    """The counts of cells start..start+size by id order."""
    from ..operators.ordered import before

    ordered = before(cells.select("cell_id").distinct(), "cell_id", [], "__i")
    return counts.join(ordered.where(F.col("__i").between(start, start + size - 1)).select("cell_id"), "cell_id", "left_semi")


def safe_name(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]+", "_", name).strip("_")
