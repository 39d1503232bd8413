"""The test tables in the roles of the data model, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table


def cells(spark: SparkSession, d: str) -> DataFrame:
    o, c = read_table(spark, d, "orders"), read_table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("cell_id"), F.col("c_mktsegment").alias("sample"), F.col("c_mktsegment").alias("unit"), F.col("o_orderpriority").alias("celltype"), F.col("o_orderstatus").alias("batch"), F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("acct"), F.col("c_nationkey").alias("nation")
    )


CELLS = """cells AS (SELECT o_orderkey AS cell_id, c_mktsegment AS sample, c_mktsegment AS unit, o_orderpriority AS celltype, o_orderstatus AS batch,
  o_totalprice AS price, c_acctbal AS acct, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey)"""


def counts(spark: SparkSession, d: str) -> DataFrame:
    feature = F.concat(F.lit("g"), (F.col("l_partkey") % 200).cast("string"))
    return read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), feature.alias("feature_id")).agg(F.sum("l_quantity").alias("value"))


COUNTS = "counts AS (SELECT l_orderkey AS cell_id, 'g' || (l_partkey % 200)::VARCHAR AS feature_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"

COMP = (
    CELLS
    + """, n AS (SELECT unit, celltype, count(*) AS n FROM cells GROUP BY 1, 2),
grid AS (SELECT u.unit, t.celltype, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT unit FROM n) u CROSS JOIN (SELECT DISTINCT celltype FROM n) t LEFT JOIN n ON n.unit = u.unit AND n.celltype = t.celltype),
comp AS (SELECT unit, celltype, n, n::DOUBLE / sum(n) OVER (PARTITION BY unit) AS proportion FROM grid)"""
)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, embedding, label, unit (of 20), modality."""
    return read_table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label"), (F.col("vec_id") % 20).alias("unit"), F.when(F.col("vec_id") % 2 == 0, "RNA").otherwise("ATAC").alias("modality"))


LONG = """vec AS (SELECT vec_id, embedding, label::VARCHAR AS label, vec_id % 20 AS unit, CASE WHEN vec_id % 2 = 0 THEN 'RNA' ELSE 'ATAC' END AS modality FROM embeddings),
long AS (SELECT vec_id, label, unit, modality, i, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM vec))"""


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """unit, v: the mean vector."""
    m = vectors(spark, d).select("unit", F.posexplode("embedding").alias("i", "x")).groupBy("unit", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


UNITS = LONG + ", units AS (SELECT unit, i, avg(x) AS x FROM long GROUP BY 1, 2), pairs AS (SELECT a.unit AS a, b.unit AS b, a.x AS x, b.x AS y FROM units a JOIN units b ON a.i = b.i AND a.unit < b.unit)"


def peaks(spark: SparkSession, d: str) -> DataFrame:
    """peak, chrom, p0, p1, centre from lineitem: a peak per distinct part."""
    p = read_table(spark, d, "part")
    start = F.col("p_partkey") * 137 % 100000
    return p.select(F.col("p_partkey").alias("peak"), F.concat(F.lit("chr"), (F.col("p_partkey") % 5).cast("string")).alias("chrom"), start.alias("p0"), (start + 200 + F.col("p_size")).alias("p1"), (start + 250).alias("centre"))


def genes(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier")
    start = F.col("s_suppkey") * 4099 % 100000
    return s.select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("gene"), F.concat(F.lit("chr"), (F.col("s_suppkey") % 5).cast("string")).alias("chrom"), start.alias("g_start"), (start + 1000 + F.col("s_suppkey") % 7 * 300).alias("g_end"), F.when(F.col("s_suppkey") % 2 == 0, "+").otherwise("-").alias("strand"))


REGIONS = """peaks AS (SELECT p_partkey AS peak, 'chr' || (p_partkey % 5)::VARCHAR AS chrom, p_partkey * 137 % 100000 AS p0, p_partkey * 137 % 100000 + 200 + p_size AS p1, p_partkey * 137 % 100000 + 250 AS centre FROM part),
genes AS (SELECT 'G' || s_suppkey::VARCHAR AS gene, 'chr' || (s_suppkey % 5)::VARCHAR AS chrom, s_suppkey * 4099 % 100000 AS g_start,
  s_suppkey * 4099 % 100000 + 1000 + s_suppkey % 7 * 300 AS g_end, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM supplier),
win AS (SELECT *, greatest(g_start - 5000, 0) AS w0, g_end + 5000 AS w1, CASE WHEN strand = '+' THEN g_start ELSE g_end END AS tss FROM genes)"""


def peak_counts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("peak")).agg(F.sum("l_quantity").alias("value"))


PEAK_COUNTS = "pc AS (SELECT l_orderkey AS cell_id, l_partkey AS peak, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
