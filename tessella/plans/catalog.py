"""Registered queries: each operator on the test tables, with the SQL that must give the same rows. Doubles are rounded to 6 places on both sides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clusters, compose, differential, distance, embedding, features, intervals, joins, neighbours, normalize, qc, stats, trajectory, tuning
from ..sources import tables
from . import domain as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


# Compositions and distances between units


@query(f"WITH {D.COMP} SELECT unit, celltype, n::BIGINT AS n, round(proportion, 6) AS proportion FROM comp")
def celltype_composition(spark, d):
    return r6(compose.composition(D.cells(spark, d)), "proportion")


@query(f"WITH {D.COMP}, l AS (SELECT unit, celltype, ln((proportion + 1e-3) / sum(proportion + 1e-3) OVER (PARTITION BY unit)) AS l FROM comp) SELECT unit, celltype, round(l - avg(l) OVER (PARTITION BY unit), 6) AS clr FROM l")
def composition_clr(spark, d):
    return r6(normalize.clr(compose.composition(D.cells(spark, d))), "clr")


@query(f"WITH {D.COMP}, m AS (SELECT min(proportion) FILTER (WHERE proportion > 0) AS m FROM comp), l AS (SELECT unit, celltype, ln(least(greatest(proportion, m), 1 - m)) AS l FROM comp, m) SELECT unit, celltype, round(l - avg(l) OVER (PARTITION BY unit), 6) AS clr FROM l")
def composition_clr_clip(spark, d):
    return r6(normalize.clr_clipped(compose.composition(D.cells(spark, d))), "clr")


PAIRED = D.COMP + ", pq AS (SELECT x.unit AS a, y.unit AS b, x.celltype, x.proportion AS p, y.proportion AS q FROM comp x JOIN comp y ON x.celltype = y.celltype AND x.unit < y.unit)"
JS = PAIRED + ", dist AS (SELECT a, b, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS d FROM pq GROUP BY 1, 2), js AS (SELECT a, b, d / max(d) OVER () AS distance FROM dist)"


@query(f"WITH {JS} SELECT a, b, round(distance, 6) AS distance FROM js")
def js_distance(spark, d):
    return r6(distance.jensen_shannon(compose.composition(D.cells(spark, d))), "distance")


@query(f"WITH {PAIRED}, z AS (SELECT a, b, CASE WHEN p = 0 THEN 1e-10 ELSE p END AS p, CASE WHEN q = 0 THEN 1e-10 ELSE q END AS q FROM pq), dist AS (SELECT a, b, 0.5 * sum((p - q) * (p - q) / (p + q)) AS d FROM z GROUP BY 1, 2) SELECT a, b, round(d / max(d) OVER (), 6) AS distance FROM dist")
def chi_square_distance(spark, d):
    return r6(distance.chi_square(compose.composition(D.cells(spark, d))), "distance")


METRIC_SQL = {
    "euclidean": "sqrt(sum((x - y) * (x - y)))",
    "sqeuclidean": "sum((x - y) * (x - y))",
    "minkowski": "sqrt(sum((x - y) * (x - y)))",
    "cityblock": "sum(abs(x - y))",
    "chebyshev": "max(abs(x - y))",
    "cosine": "1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))",
    "correlation": "1 - corr(x, y)",
    "hamming": "avg(CASE WHEN x <> y THEN 1.0::DOUBLE ELSE 0 END)",
    "matching": "avg(CASE WHEN x <> y THEN 1.0::DOUBLE ELSE 0 END)",
    "jaccard": "sum(CASE WHEN x <> y THEN 1.0::DOUBLE ELSE 0 END) / sum(CASE WHEN x <> 0 OR y <> 0 THEN 1 ELSE 0 END)",
    "canberra": "sum(CASE WHEN x = 0 AND y = 0 THEN 0 ELSE abs(x - y) / (abs(x) + abs(y)) END)",
    "braycurtis": "sum(abs(x - y)) / sum(abs(x + y))",
}
for _metric, _sql in METRIC_SQL.items():
    query(f"WITH {D.UNITS}, dist AS (SELECT a, b, {_sql} AS d FROM pairs GROUP BY 1, 2) SELECT a, b, round(d / max(d) OVER (), 6) AS distance FROM dist", f"pdist_{_metric}")(lambda spark, d, m=_metric: r6(distance.pairwise(D.unit_vectors(spark, d), m), "distance"))

EUCLID = D.UNITS + ", dist AS (SELECT a, b, sqrt(sum((x - y) * (x - y))) AS d FROM pairs GROUP BY 1, 2), e AS (SELECT a, b, d / max(d) OVER () AS distance FROM dist)"


@query(f"WITH {EUCLID} SELECT round(avg(distance), 6) AS mean, round(stddev_pop(distance), 6) AS sd, round(min(distance), 6) AS least, round(max(distance), 6) AS most, round(quantile_cont(distance, 0.5), 6) AS median FROM e")
def distance_stats(spark, d):
    return r6(distance.statistics(distance.pairwise(D.unit_vectors(spark, d), "euclidean")), "mean", "sd", "least", "most", "median")


UNIT_LABELS = "lab AS (SELECT unit, 'g' || (unit % 3)::VARCHAR AS label FROM (SELECT DISTINCT unit FROM units))"


def unit_labels(spark, d):
    return D.vectors(spark, d).select("unit").distinct().withColumn("label", F.concat(F.lit("g"), (F.col("unit") % 3).cast("string")))


GROUPED = f"WITH {EUCLID}, {UNIT_LABELS}, w AS (SELECT avg(distance) FILTER (WHERE x.label = y.label) AS within, avg(distance) FILTER (WHERE x.label <> y.label) AS between_ FROM e JOIN lab x ON e.a = x.unit JOIN lab y ON e.b = y.unit)"


@query(GROUPED + ' SELECT round(within, 6) AS within, round(between_, 6) AS "between", round(between_ / within, 6) AS score FROM w')
def distance_check_score(spark, d):
    return r6(distance.group_score(distance.pairwise(D.unit_vectors(spark, d), "euclidean"), unit_labels(spark, d)), "within", "between", "score")


@query(GROUPED + ' SELECT round(within, 6) AS within, round(between_, 6) AS "between", round(between_ / within, 6) AS ratio FROM w')
def preservation_ratio(spark, d):
    return r6(stats.preservation(distance.pairwise(D.unit_vectors(spark, d), "euclidean"), unit_labels(spark, d)), "within", "between", "ratio")


@query()
def emd_distance(spark, d):
    comp = compose.composition(D.cells(spark, d))
    ground = distance.pairwise(comp.groupBy(F.col("celltype").alias("unit")).agg(F.transform(F.array_sort(F.collect_list(F.struct("unit", "proportion"))), lambda s: s["proportion"]).alias("v")), "euclidean")
    return r6(distance.earth_mover(comp, ground), "distance")


@query()
def classical_mds(spark, d):
    names, m = distance.square(distance.pairwise(D.unit_vectors(spark, d), "euclidean"))
    return spark.createDataFrame([(int(u), *[round(float(v), 6) for v in row]) for u, row in zip(names, distance.classical_mds(m, 2), strict=True)], "unit long, x double, y double")


# Quality control


@query(f"WITH {D.COUNTS}, k AS (SELECT feature_id FROM counts WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT cell_id) >= 280) SELECT feature_id, count(*) AS n, round(sum(value), 6) AS total FROM counts WHERE feature_id IN (SELECT feature_id FROM k) GROUP BY 1")
def qc_feature_filter(spark, d):
    return r6(qc.features_in_cells(D.counts(spark, d), 280).groupBy("feature_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


@query(f"WITH {D.COUNTS}, k AS (SELECT cell_id FROM counts WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT feature_id) >= 5) SELECT cell_id, count(*) AS n, round(sum(value), 6) AS total FROM counts WHERE cell_id IN (SELECT cell_id FROM k) GROUP BY 1")
def qc_cell_filter(spark, d):
    return r6(qc.cells_with_features(D.counts(spark, d), 5).groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


@query(f"WITH {D.COUNTS}, m AS (SELECT cell_id, sum(value) AS total, count(*) FILTER (WHERE value > 0) AS n_features, coalesce(sum(CASE WHEN feature_id LIKE 'g1%' THEN value ELSE 0 END) / sum(value) * 100, 0) AS pct FROM counts GROUP BY 1) SELECT cell_id, round(total, 6) AS total, n_features, round(pct, 6) AS pct_special FROM m WHERE pct < 60")
def qc_pct_flag(spark, d):
    return r6(qc.cell_metrics(D.counts(spark, d), F.col("feature_id").startswith("g1")).where("pct_special < 60"), "total", "pct_special")


@query(f"WITH {D.COUNTS} SELECT feature_id, count(*) AS n FROM counts WHERE feature_id NOT LIKE 'g1%' AND feature_id NOT IN ('g7', 'g8') GROUP BY 1")
def qc_drop_features(spark, d):
    return qc.drop_features(D.counts(spark, d), F.col("feature_id").startswith("g1"), ["g7", "g8"]).groupBy("feature_id").agg(F.count("*").alias("n"))


@query(f"WITH {D.CELLS}, k AS (SELECT nation FROM cells GROUP BY 1 HAVING count(*) >= 600) SELECT nation, count(*) AS n FROM cells WHERE nation IN (SELECT nation FROM k) GROUP BY 1")
def qc_sample_min_cells(spark, d):
    return qc.samples_with_cells(D.cells(spark, d), 600, "nation").groupBy("nation").agg(F.count("*").alias("n"))


@query(f"WITH {D.COUNTS}, t AS (SELECT floor(count(DISTINCT cell_id) * 0.018::DOUBLE) AS t FROM counts), k AS (SELECT feature_id FROM counts WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT cell_id) >= (SELECT t FROM t)) SELECT feature_id, count(*) AS n FROM counts WHERE feature_id IN (SELECT feature_id FROM k) GROUP BY 1")
def qc_fraction_refilter(spark, d):
    return qc.features_in_share(D.counts(spark, d), 0.018).groupBy("feature_id").agg(F.count("*").alias("n"))


@query(f"WITH {D.COUNTS}, k AS (SELECT cell_id FROM counts WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT feature_id) BETWEEN 3 AND 5) SELECT cell_id, count(*) AS n FROM counts WHERE cell_id IN (SELECT cell_id FROM k) GROUP BY 1")
def qc_range_filter(spark, d):
    return qc.cells_with_features(D.counts(spark, d), 3, 5).groupBy("cell_id").agg(F.count("*").alias("n"))


@query(f"""WITH {D.COUNTS}, c AS (SELECT cell_id FROM counts GROUP BY 1 HAVING count(*) FILTER (WHERE value > 0) BETWEEN 2 AND 6 AND sum(value) >= 50 AND coalesce(sum(CASE WHEN feature_id LIKE 'g1%' THEN value ELSE 0 END) / sum(value) * 100, 0) <= 80),
f AS (SELECT feature_id FROM counts WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT cell_id) >= 250 AND sum(value) >= 100)
SELECT cell_id, feature_id, round(value, 6) AS value FROM counts WHERE cell_id IN (SELECT cell_id FROM c) AND feature_id IN (SELECT feature_id FROM f)""")
def qc_joint_filter(spark, d):
    return r6(qc.joint_filter(D.counts(spark, d), F.col("feature_id").startswith("g1"), 2, 6, 50, 80, 250, 100), "value")


@query(f"""WITH {D.LONG}, t AS (SELECT count(*)::DOUBLE AS t FROM vec), e AS (SELECT modality, count(*) / (SELECT t FROM t) AS expected FROM vec GROUP BY 1), s AS (SELECT label, count(*) AS size FROM vec GROUP BY 1), n AS (SELECT label, modality, count(*) AS n FROM vec GROUP BY 1, 2),
b AS (SELECT s.label, min(coalesce(n.n, 0) / s.size::DOUBLE / e.expected) AS balance FROM s CROSS JOIN e LEFT JOIN n ON n.label = s.label AND n.modality = e.modality GROUP BY 1) SELECT label, round(balance, 6) AS balance, balance >= 0.9 AS kept FROM b""")
def modality_imbalance_filter(spark, d):
    return r6(qc.imbalance(D.vectors(spark, d), "label", "modality", 0.9), "balance")


@query()
def doublet_scores(spark, d):
    return qc.doublet_scores(D.counts(spark, d), D.cells(spark, d).select("cell_id", F.col("nation").cast("string").alias("sample")))


@query("SELECT * FROM (SELECT 'c_nationkey' AS \"column\", max(n) <= 1 AS sample_level FROM (SELECT count(DISTINCT c_nationkey) AS n FROM customer GROUP BY c_custkey) UNION ALL SELECT 'c_acctbal', max(n) <= 1 FROM (SELECT count(DISTINCT c_acctbal) AS n FROM customer GROUP BY c_nationkey)) t")
def sample_level_columns(spark, d):
    c = tables.read_table(spark, d, "customer")
    return qc.sample_level_columns(c, "c_custkey", ["c_nationkey"]).unionByName(qc.sample_level_columns(c, "c_nationkey", ["c_acctbal"]))


@query("SELECT 'c_mktsegment' AS \"column\", count(DISTINCT c_mktsegment) AS n_distinct, 'categorical' AS kind FROM customer UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal), 'continuous' FROM customer UNION ALL SELECT 'c_name', count(DISTINCT c_name), 'dropped' FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey), 'continuous' FROM customer")
def classify_columns(spark, d):
    return qc.classify_columns(tables.read_table(spark, d, "customer"), ["c_mktsegment", "c_acctbal", "c_name", "c_nationkey"])


# Normalisation and pseudobulk


@query(f"WITH {D.COUNTS}, t AS (SELECT cell_id, sum(value) AS t FROM counts GROUP BY 1) SELECT cell_id, feature_id, round(ln(1 + CASE WHEN t = 0 THEN value ELSE value * 1e4 / t END), 6) AS value FROM counts JOIN t USING (cell_id)")
def normalize_log1p(spark, d):
    return r6(normalize.log1p_total(D.counts(spark, d)), "value")


TFIDF = "SELECT cell_id, feature_id, round(ln(1 + 1e4 * value / rs) * ln(1 + (SELECT count(DISTINCT cell_id) FROM counts) / cs), 6) AS value FROM counts JOIN (SELECT cell_id, sum(value)::DOUBLE AS rs FROM counts GROUP BY 1) r USING (cell_id) JOIN (SELECT feature_id, sum(value)::DOUBLE AS cs FROM counts GROUP BY 1) c USING (feature_id)"


@query(f"WITH {D.COUNTS} {TFIDF}")
def tfidf_counts(spark, d):
    return r6(normalize.tfidf(D.counts(spark, d)), "value")


@query("WITH counts AS (SELECT doc_id AS cell_id, w AS feature_id, count(*)::DOUBLE AS value FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1, 2) " + TFIDF)
def tfidf_documents(spark, d):
    words = tables.read_table(spark, d, "documents").select(F.col("doc_id").alias("cell_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("feature_id"))
    return r6(normalize.tfidf(words.groupBy("cell_id", "feature_id").agg(F.count("*").cast("double").alias("value"))), "value")


@query(f"WITH {D.CELLS}, {D.COUNTS}, n AS (SELECT sample, count(*) AS n FROM cells GROUP BY 1), f AS (SELECT DISTINCT feature_id FROM counts JOIN cells USING (cell_id)), s AS (SELECT sample, feature_id, sum(value) AS s FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2) SELECT n.sample, f.feature_id, round(coalesce(s.s, 0) / n.n, 6) AS value FROM n CROSS JOIN f LEFT JOIN s ON s.sample = n.sample AND s.feature_id = f.feature_id")
def pseudobulk_sample(spark, d):
    return r6(compose.pseudobulk(D.counts(spark, d), D.cells(spark, d), ["sample"]), "value")


@query(f"WITH {D.CELLS}, {D.COUNTS}, n AS (SELECT sample, celltype, count(*) AS n FROM cells GROUP BY 1, 2), s AS (SELECT sample, celltype, feature_id, sum(value) AS s FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2, 3), f AS (SELECT celltype, feature_id FROM s GROUP BY 1, 2 HAVING bool_or(s <> 0)) SELECT g.sample, f.celltype || ' - ' || f.feature_id AS feature, round(coalesce(s.s / n.n, 0), 6) AS value FROM (SELECT DISTINCT sample FROM cells) g CROSS JOIN f LEFT JOIN s ON s.sample = g.sample AND s.celltype = f.celltype AND s.feature_id = f.feature_id LEFT JOIN n ON n.sample = g.sample AND n.celltype = f.celltype")
def pseudobulk_sample_celltype(spark, d):
    return r6(compose.pseudobulk_features(D.counts(spark, d), D.cells(spark, d), "sample", "celltype"), "value")


@query(f"WITH {D.CELLS}, {D.COUNTS}, s AS (SELECT sample, feature_id, sum(value) AS s FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2), f AS (SELECT DISTINCT feature_id FROM s), g AS (SELECT DISTINCT sample FROM cells) SELECT g.sample, f.feature_id, round(coalesce(s.s, 0), 6) AS value FROM g CROSS JOIN f LEFT JOIN s ON s.sample = g.sample AND s.feature_id = f.feature_id")
def pseudobulk_group_sum(spark, d):
    return r6(compose.pseudobulk(D.counts(spark, d), D.cells(spark, d), ["sample"], "sum"), "value")


MV = "n AS (SELECT sample, count(*)::DOUBLE AS n FROM cells GROUP BY 1), s AS (SELECT sample, feature_id, sum(value) AS s, sum(value * value) AS q FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2), mv AS (SELECT sample, feature_id, s / n AS mean, (q / n - (s / n) * (s / n)) * n / (n - 1) AS variance, n FROM s JOIN n USING (sample) WHERE n > 1)"


@query(f"WITH {D.CELLS}, {D.COUNTS}, {MV} SELECT sample, feature_id, round(mean, 6) AS mean, round(variance, 6) AS variance FROM mv")
def sample_mean_variance(spark, d):
    return r6(compose.mean_and_variance(D.counts(spark, d), D.cells(spark, d), "sample"), "mean", "variance")


@query(f"WITH {D.LONG} SELECT label, i AS dim, round(avg(x), 6) AS value FROM long WHERE i <= 20 GROUP BY 1, 2")
def type_centroids(spark, d):
    return r6(compose.centroids(D.vectors(spark, d), "label", "embedding", 20), "value").withColumn("dim", F.col("dim").cast("long"))


@query(f"WITH {D.COUNTS}, n AS (SELECT count(DISTINCT cell_id)::DOUBLE AS n FROM counts) SELECT feature_id, round(sum(value * value) / n - (sum(value) / n) * (sum(value) / n), 6) AS variance FROM counts, n GROUP BY feature_id, n ORDER BY variance DESC, feature_id LIMIT 50")
def variable_by_variance(spark, d):
    counts = D.counts(spark, d)
    return r6(features.variable_by_variance(counts, counts.select("cell_id").distinct().count(), 50), "variance")


@query()
def variable_by_standardised(spark, d):
    counts = D.counts(spark, d)
    return features.variable_by_standardised(counts, counts.select("cell_id").distinct().count(), 50)


@query(f"WITH {D.CELLS}, {D.COUNTS}, {MV}, m AS (SELECT feature_id, avg(mean) AS mean, avg(variance) AS variance FROM mv GROUP BY 1), b AS (SELECT feature_id, ln(greatest(variance / mean, 1e-12)) AS d, ln(1 + mean) AS m FROM m WHERE mean > 0), e AS (SELECT min(m) AS lo, max(m) AS hi FROM b), k AS (SELECT feature_id, d, least(19, floor((m - lo) / (hi - lo + 1e-12) * 20))::INT AS bin FROM b CROSS JOIN e), p AS (SELECT bin, avg(d) AS bm, stddev_samp(d) AS bs FROM k GROUP BY 1), z AS (SELECT feature_id, round(CASE WHEN bs > 0 THEN (d - bm) / bs ELSE 1.0 END, 6) AS dispersion, CASE WHEN bs > 0 THEN (d - bm) / bs ELSE 1.0 END AS exact FROM k JOIN p ON p.bin = k.bin) SELECT feature_id, dispersion, rank FROM (SELECT *, row_number() OVER (ORDER BY exact DESC, feature_id)::INT AS rank FROM z) WHERE rank <= 50")
def variable_by_dispersion(spark, d):
    m = compose.mean_and_variance(D.counts(spark, d), D.cells(spark, d), "sample").groupBy("feature_id").agg(F.avg("mean").alias("mean"), F.avg("variance").alias("variance"))
    return r6(features.variable_by_dispersion(m, 50), "dispersion")


@query(f"WITH {D.CELLS}, {D.COUNTS}, {MV}, c AS (SELECT quantile_cont(mean, 0.7) AS c FROM mv), k AS (SELECT feature_id, var_samp(mean) AS variance FROM mv GROUP BY 1 HAVING max(mean) > (SELECT c FROM c)) SELECT feature_id, round(variance, 6) AS variance, rank FROM (SELECT *, row_number() OVER (ORDER BY variance DESC, feature_id)::INT AS rank FROM k) WHERE rank <= 30")
def informative_features(spark, d):
    return r6(qc.informative_features(compose.mean_and_variance(D.counts(spark, d), D.cells(spark, d), "sample"), 0.7, 30), "variance")


# Metadata joins, labels, sets


@query("SELECT c_custkey, c_name, n_name AS nation, coalesce(r_name, 'Unknown') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def metadata_left_join_override(spark, d):
    n, r = tables.read_table(spark, d, "nation"), tables.read_table(spark, d, "region")
    meta = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return joins.join_sample_metadata(tables.read_table(spark, d, "customer").withColumn("region", F.lit("old")), meta, "c_nationkey").select("c_custkey", "c_name", "nation", "region")


@query("SELECT user_id, first(event_type ORDER BY event_id) FILTER (WHERE event_type IS NOT NULL) AS event_type, first(value ORDER BY event_id) FILTER (WHERE value IS NOT NULL) AS value FROM events GROUP BY 1")
def first_non_null_metadata(spark, d):
    return compose.first_known(tables.read_table(spark, d, "events"), "user_id", ["event_type", "value"], "event_id")


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM n) WHERE k = 1")
def majority_label(spark, d):
    return compose.majority(tables.read_table(spark, d, "events"), "user_id", "event_type")


@query(f"WITH {D.CELLS}, m AS (SELECT nation, avg(acct) AS m FROM cells GROUP BY 1), b AS (SELECT nation, floor((m - (SELECT min(m) FROM m)) / 250.0)::BIGINT AS bin FROM m), p AS (SELECT nation, celltype FROM (SELECT nation, celltype, row_number() OVER (PARTITION BY nation ORDER BY count(*) DESC, celltype) AS k FROM cells GROUP BY 1, 2) WHERE k = 1) SELECT nation, bin, celltype, bin::VARCHAR || '_' || celltype AS grouping FROM b JOIN p USING (nation)", "sample_grouping_bins")
def sample_grouping_bins(spark, d):
    return compose.sample_grouping(D.cells(spark, d), "nation", "acct", "celltype", 250.0)


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON lower(trim(' N' || s_nationkey::VARCHAR || ' ')) = lower(trim('n' || n_nationkey::VARCHAR))")
def case_insensitive_align(spark, d):
    s = tables.read_table(spark, d, "supplier").withColumn("k1", F.concat(F.lit(" N"), F.col("s_nationkey").cast("string"), F.lit(" ")))
    n = tables.read_table(spark, d, "nation").withColumn("k2", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    return joins.join_loose(s, n, "k1", "k2").select("s_suppkey", "n_name")


@query("SELECT user_id, label FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, first(event_type ORDER BY event_id) AS label FROM events WHERE event_id % 3 = 0 GROUP BY 1) f USING (user_id)")
def propagate_labels(spark, d):
    e = tables.read_table(spark, d, "events")
    return joins.propagate_labels(e.where("event_id % 3 = 0").select("user_id", F.col("event_type").alias("label"), "event_id"), e.select("user_id").distinct(), "user_id", "label", "event_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'b' || p_size::VARCHAR WHEN p_partkey % 3 = 0 THEN 'a' || p_size::VARCHAR ELSE p_brand END AS label FROM part")
def overlay_labels(spark, d):
    p = tables.read_table(spark, d, "part")
    named = lambda m, t: p.where(F.col("p_partkey") % m == 0).select("p_partkey", F.concat(F.lit(t), F.col("p_size").cast("string")).alias("label"))
    return joins.overlay_labels(p, named(3, "a"), named(7, "b"), "p_partkey", "p_brand").select("p_partkey", "label")


@query("SELECT s_suppkey::VARCHAR || '_RNA' AS cell_id, s_suppkey::VARCHAR AS original_barcode, 'RNA' AS modality, s_nationkey AS nation FROM supplier UNION ALL SELECT c_custkey::VARCHAR || '_ATAC', c_custkey::VARCHAR, 'ATAC', c_nationkey FROM customer")
def union_modalities(spark, d):
    a = tables.read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_nationkey").alias("nation"), "s_name")
    b = tables.read_table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("nation"), "c_name")
    return joins.union_modalities(a, b)


GENE_SIDES = "l AS (SELECT CASE WHEN l_partkey % 2 = 0 THEN 'ens' || 'g' || lpad((l_partkey % 400)::VARCHAR, 6, '0') || '.1' ELSE 'Sym' || (l_partkey % 400)::VARCHAR END AS f FROM lineitem), k AS (SELECT f, CASE WHEN f LIKE 'ensg%' THEN split_part(upper(f), '.', 1) ELSE upper(f) END AS gene FROM l)"


@query(f"WITH {GENE_SIDES}, p AS (SELECT 'SYM' || p_partkey::VARCHAR AS f, 'SYM' || p_partkey::VARCHAR AS gene FROM part UNION ALL SELECT 'ENSG' || lpad(p_partkey::VARCHAR, 6, '0') || '.7', 'ENSG' || lpad(p_partkey::VARCHAR, 6, '0') FROM part) SELECT gene, min(k.f) AS left_id, min(p.f) AS right_id FROM k JOIN p USING (gene) GROUP BY 1")
def gene_id_intersection(spark, d):
    k = F.col("l_partkey")
    left = tables.read_table(spark, d, "lineitem").select(F.when(k % 2 == 0, F.concat(F.lit("ensg"), F.lpad((k % 400).cast("string"), 6, "0"), F.lit(".1"))).otherwise(F.concat(F.lit("Sym"), (k % 400).cast("string"))).alias("feature_id"))
    p = tables.read_table(spark, d, "part")
    right = p.select(F.concat(F.lit("SYM"), F.col("p_partkey").cast("string")).alias("feature_id")).unionAll(p.select(F.concat(F.lit("ENSG"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(".7"))))
    return joins.align_genes(left, right, C.gene_key)


@query("SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def set_difference(spark, d):
    return tables.read_table(spark, d, "part").select("p_partkey").subtract(tables.read_table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")))


@query(f"WITH {D.COUNTS}, a AS (SELECT *, 0 AS part FROM counts WHERE cell_id % 2 = 0 AND feature_id <> 'g3'), b AS (SELECT *, 1 AS part FROM counts WHERE cell_id % 2 = 1 AND feature_id <> 'g4') SELECT feature_id, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1 HAVING count(DISTINCT part) = 2")
def merge_matrices(spark, d):
    c = D.counts(spark, d)
    return joins.merge_matrices([c.where("cell_id % 2 = 0 and feature_id <> 'g3'"), c.where("cell_id % 2 = 1 and feature_id <> 'g4'")]).groupBy("feature_id").agg(F.count("*").alias("n"))


@query("SELECT base, base || '_RNA' AS unit_a, base || '_ATAC' AS unit_b FROM (SELECT 's' || s_suppkey::VARCHAR AS base FROM supplier WHERE s_suppkey % 6 = 0)")
def paired_units(spark, d):
    s = tables.read_table(spark, d, "supplier")
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    units = s.where("s_suppkey % 2 = 0").select(F.concat(name, F.lit("_RNA")).alias("u")).unionAll(s.where("s_suppkey % 3 = 0").select(F.concat(name, F.lit("_ATAC"))))
    return joins.paired_units(units, "u", C.base_unit, C.modality_of)


@query("SELECT n_name AS a, CASE WHEN lower(trim(n_name)) = 'france' THEN 'in' ELSE 'out' END AS side FROM nation")
def split_by_value(spark, d):
    same, other = qc.split_by_value(tables.read_table(spark, d, "nation"), "n_name", " France ")
    return same.select(F.col("n_name").alias("a"), F.lit("in").alias("side")).unionAll(other.select("n_name", F.lit("out")))


@query("SELECT p_partkey, 'chr' || (p_partkey % 3)::VARCHAR AS chrom, p_partkey AS \"start\", p_partkey + p_size AS \"end\", ((p_partkey // 500 * 500) + ((p_partkey + p_size) // 500 + 1) * 500) // 2 AS centre FROM part WHERE p_size > 0")
def peak_tiles(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.when(k % 2 == 0, "chr").otherwise(""), (k % 3).cast("string"), F.when(k % 5 == 0, ":").when(k % 5 < 3, "-").otherwise("_"), k.cast("string"), F.when(k % 5 < 3, "-").otherwise("_"), (k + s).cast("string"))
    out = tables.read_table(spark, d, "part").select("p_partkey", C.parse_region(name).alias("r")).where("r is not null").select("p_partkey", "r.*")
    return out.withColumn("centre", C.tile_centre(F.col("start"), F.col("end")))


# Embedding blocks


ANCHORS = "anc AS (SELECT label AS anchor, i, avg(x) AS c FROM long GROUP BY 1, 2), d2 AS (SELECT vec_id, unit, anchor, sum((x - c) * (x - c)) AS d2 FROM long JOIN anc USING (i) GROUP BY 1, 2, 3), sg AS (SELECT quantile_cont(sqrt(d2), 0.5) AS s FROM d2), e AS (SELECT vec_id, unit, anchor, exp(-(d2 - min(d2) OVER (PARTITION BY vec_id)) / (2 * s * s)) AS e FROM d2, sg), soft AS (SELECT unit, anchor, e / sum(e) OVER (PARTITION BY vec_id) AS w FROM e)"


def label_anchors(spark, d):
    c = compose.centroids(D.vectors(spark, d), "label", "embedding", 1 << 20)
    return c.groupBy(F.col("label").alias("anchor")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("c"))


@query(f"WITH {D.LONG}, {ANCHORS} SELECT unit, anchor, round(avg(w), 6) AS share FROM soft GROUP BY 1, 2")
def soft_composition_fixed_anchors(spark, d):
    return r6(embedding.soft_composition(D.vectors(spark, d), label_anchors(spark, d), "unit", "embedding", "vec_id"), "share")


RMD = "st AS (SELECT unit, modality, label, i, sum(x) AS s, count(*) AS n FROM long GROUP BY 1, 2, 3, 4), rmd AS (SELECT unit, label AS celltype, i AS dim, (s / n - CASE WHEN sum(n) OVER p - n > 0 THEN (sum(s) OVER p - s) / (sum(n) OVER p - n) ELSE 0 END) * sqrt(n) / greatest(max(sqrt(n)) OVER (PARTITION BY label, i), 1e-6) AS value FROM st WINDOW p AS (PARTITION BY modality, label, i))"


@query(f"WITH {D.LONG}, {RMD} SELECT unit, celltype, dim, round(value, 6) AS value FROM rmd")
def rmd_displacement(spark, d):
    return r6(embedding.displacement(D.vectors(spark, d), "unit", "modality", "label", "embedding"), "value").withColumn("dim", F.col("dim").cast("long"))


STACK = D.COMP + ", blk AS (SELECT unit, celltype AS feature, proportion - avg(proportion) OVER (PARTITION BY celltype) AS v FROM comp), nrm AS (SELECT sqrt(sum(v * v)) AS norm, sqrt(count(DISTINCT unit)) AS ru FROM blk)"


@query(f"WITH {STACK} SELECT unit, '0:' || feature AS feature, round(v / norm * ru * 2.0, 6) AS value FROM blk, nrm")
def block_frobenius_stack(spark, d):
    block = compose.composition(D.cells(spark, d)).select("unit", F.col("celltype").alias("feature"), F.col("proportion").alias("value"))
    return r6(embedding.frobenius_stack([(block, 2.0)]), "value")


@query(f"WITH {D.LONG} SELECT vec_id AS unit, i AS feature, round(x - avg(x) OVER (PARTITION BY unit % 4, i), 6) AS value FROM long")
def linear_batch_removal(spark, d):
    long = D.vectors(spark, d).select(F.col("vec_id").alias("unit"), (F.col("unit") % 4).alias("batch"), F.posexplode("embedding").alias("feature", "x"))
    out = embedding.remove_batch(long.select("unit", "batch", (F.col("feature") + 1).cast("long").alias("feature"), F.col("x").cast("double").alias("value")), "batch")
    return r6(out.drop("batch"), "value")


@query()
def sample_embedding(spark, d):
    out = embedding.sample_embedding(D.vectors(spark, d), "unit", "label", "embedding", "vec_id", batch="modality")
    return out.select("unit", F.transform("pc", lambda x: F.round(x, 6)).alias("pc"))


@query()
def cell_pca(spark, d):
    return embedding.cell_pca(D.vectors(spark, d), "embedding", 5).select("vec_id", F.transform("pc", lambda x: F.round(x, 6)).alias("pc"))


@query()
def harmony_embedding(spark, d):
    rows = D.unit_vectors(spark, d).orderBy("unit").collect()
    z = embedding.harmony(embedding.pca(np.array([r["v"] for r in rows]), 5), [str(r["unit"] % 3) for r in rows])
    return spark.createDataFrame([(r["unit"], [round(float(v), 6) for v in x]) for r, x in zip(rows, z, strict=True)], "unit long, pc array<double>")


# Intervals and gene activity

OVER = D.REGIONS + """, o AS (SELECT peak, gene, abs((p0 + p1) // 2 - tss) AS distance, p0 <= g_end AND p1 >= g_start AS body, p0 <= tss + 300 AND p1 >= greatest(tss - 300, 0) AS promoter,
CASE WHEN strand = '+' THEN (p0 + p1) // 2 - tss ELSE tss - (p0 + p1) // 2 END AS rel FROM peaks JOIN win ON peaks.chrom = win.chrom AND w0 <= p1 AND w1 >= p0),
links AS (SELECT peak, gene, distance, body, promoter, (exp(-0.5 * (distance / 50000.0::DOUBLE) * (distance / 50000.0::DOUBLE)) + 0.5 * body::INT + 5.0 * promoter::INT) * CASE WHEN rel < 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS weight FROM o)"""


@query(f"WITH {D.REGIONS} SELECT peak, gene FROM peaks JOIN win ON peaks.chrom = win.chrom AND w0 <= p1 AND w1 >= p0")
def interval_overlap_join(spark, d):
    return intervals.overlap_join(D.peaks(spark, d), intervals.gene_windows(D.genes(spark, d), 5000, 0), "chrom", ("p0", "p1"), ("w_start", "w_end"), 10000).select("peak", "gene")


@query(f"WITH {OVER} SELECT peak, gene, distance, body, promoter, round(weight, 6) AS weight, round(weight / sum(weight) OVER (PARTITION BY peak), 6) AS share, row_number() OVER (PARTITION BY peak ORDER BY weight DESC, gene)::INT AS rank FROM links")
def peak_gene_weights(spark, d):
    return intervals.each_peak(r6(intervals.best_genes_of(D.peaks(spark, d), D.genes(spark, d), 5000, 300, 10000), "weight", "share"))


@query(f"WITH {OVER} SELECT gene, count(*) AS n_peaks, sum(promoter::INT)::BIGINT AS n_promoter, sum(body::INT)::BIGINT AS n_gene_body, round(avg(distance), 6) AS mean_distance, round(sum(weight), 6) AS total_weight FROM links GROUP BY 1")
def annotation_summary(spark, d):
    return r6(intervals.summary_of(D.peaks(spark, d), D.genes(spark, d), 5000, 300, 10000), "mean_distance", "total_weight")


for _how, _value in {"weighted_sum": "sum(value * weight)", "weighted_mean": "sum(value * weight) / sum(weight)", "max_weighted": "max(value * weight)", "sum": "sum(value)"}.items():
    query(f"WITH {OVER}, {D.PEAK_COUNTS}, t AS (SELECT gene, sum(weight) AS tw FROM links GROUP BY 1), a AS (SELECT cell_id, gene, {_value} AS a FROM pc JOIN links USING (peak) GROUP BY 1, 2) SELECT cell_id, gene, round(a / tw, 6) AS activity FROM a JOIN t USING (gene)", f"gene_activity_{_how}")(
        lambda spark, d, how=_how: intervals.activity_of(D.peak_counts(spark, d), D.peaks(spark, d), D.genes(spark, d), 5000, 300, 10000, how, places=6)
    )


@query(f"""WITH {D.REGIONS}, {D.PEAK_COUNTS}, c AS (SELECT peak, gene, centre, g_start, g_end, least(abs(centre - g_start), abs(centre - g_end), abs(centre - tss)) AS near FROM peaks JOIN win ON peaks.chrom = win.chrom AND w0 <= centre AND w1 >= centre),
o AS (SELECT peak, gene, CASE WHEN centre BETWEEN g_start AND g_end THEN 0 ELSE least(abs(centre - g_start), abs(centre - g_end)) END AS gap, g_end - g_start AS size FROM (SELECT *, rank() OVER (PARTITION BY peak ORDER BY near) AS k FROM c) WHERE k = 1)
SELECT cell_id, gene, round(sum(value * (exp(-gap / 5000.0::DOUBLE) + exp(-1.0::DOUBLE)) * CASE WHEN size <= 500 THEN 5.0::DOUBLE WHEN size >= 100000 THEN 1.0::DOUBLE ELSE 5.0::DOUBLE - (size - 500.0::DOUBLE) / 99500.0::DOUBLE * 4.0::DOUBLE END), 6) AS activity FROM pc JOIN o USING (peak) GROUP BY 1, 2""")
def nearest_owner_activity(spark, d):
    owners = intervals.nearest_owners(D.peaks(spark, d), D.genes(spark, d), 5000, 10000)
    return r6(intervals.owner_activity(D.peak_counts(spark, d), owners), "activity")


# Neighbours

KNN = D.LONG + ", nd AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS distance FROM long a JOIN long b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY 1, 2), knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour)::INT AS rank FROM nd) WHERE rank <= 10)"


def knn(spark, d, k=10):
    v = D.vectors(spark, d)
    return neighbours.nearest(v, v, k)


def labels_of(spark, d, column="label"):
    return D.vectors(spark, d).select(F.col("vec_id").alias("id"), F.col(column).alias("label"))


@query(f"WITH {KNN} SELECT query, neighbour, round(distance, 6) AS distance, rank FROM knn")
def knn_exact(spark, d):
    return r6(knn(spark, d), "distance")


@query(f"WITH {KNN}, v AS (SELECT query, label, count(*) AS votes FROM knn JOIN vec ON vec.vec_id = neighbour GROUP BY 1, 2) SELECT query, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) AS k FROM v) WHERE k = 1")
def knn_label_transfer(spark, d):
    return neighbours.transfer_labels(knn(spark, d), labels_of(spark, d))


def sides(spark, d):
    v = D.vectors(spark, d)
    return v.where("modality = 'RNA'"), v.where("modality = 'ATAC'")


@query(f"""WITH {D.LONG}, nd AS (SELECT a.vec_id AS q, a.modality AS qm, b.vec_id AS n, b.modality AS nm, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS dd FROM long a JOIN long b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3, 4),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, nm ORDER BY dd, n) AS r FROM nd) WHERE r <= 5),
j AS (SELECT x, y, count(*) AS j FROM (SELECT a.q AS x, b.q AS y FROM k a JOIN k b ON a.n = b.n WHERE a.qm = 'RNA' AND a.nm = 'RNA' AND b.qm = 'ATAC' AND b.nm = 'RNA' UNION ALL SELECT a.q, b.q FROM k a JOIN k b ON a.n = b.n WHERE a.qm = 'RNA' AND a.nm = 'ATAC' AND b.qm = 'ATAC' AND b.nm = 'ATAC') GROUP BY 1, 2),
w AS (SELECT y, label, sum(j / (20 - j)::DOUBLE) AS w FROM j JOIN vec ON vec_id = x GROUP BY 1, 2), best AS (SELECT y, label, w / t AS c FROM (SELECT *, sum(w) OVER (PARTITION BY y) AS t, row_number() OVER (PARTITION BY y ORDER BY round(w, 12) DESC, label) AS k FROM w) WHERE k = 1)
SELECT vec_id AS y, coalesce(best.label, 'unassigned') AS label, round(coalesce(c, 0), 6) AS confidence FROM vec LEFT JOIN best ON y = vec_id WHERE modality = 'ATAC'""")
def snn_label_transfer(spark, d):
    x, y = sides(spark, d)
    near = neighbours.nearest
    return r6(neighbours.snn_transfer(near(x, x, 5), near(x, y, 5), near(y, x, 5), near(y, y, 5), labels_of(spark, d), 5), "confidence")


@query(f"WITH {KNN}, p AS (SELECT vec_id AS a, vec_id + 1 AS b FROM vec WHERE vec_id + 1 IN (SELECT vec_id FROM vec)), f AS (SELECT a, rank FROM p LEFT JOIN knn ON query = a AND neighbour = b) SELECT k::INT AS k, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM f, (SELECT unnest(generate_series(1, 10)) AS k) GROUP BY 1")
def pair_in_topk(spark, d):
    v = D.vectors(spark, d)
    pairs = v.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b")).join(v.select(F.col("vec_id").alias("b")), "b")
    return r6(neighbours.hit_rate(knn(spark, d), pairs, 10), "rate")


@query(f"WITH {KNN} SELECT a.modality AS label, round(avg((a.modality = b.modality)::INT), 6) AS share FROM knn JOIN vec a ON a.vec_id = query JOIN vec b ON b.vec_id = neighbour GROUP BY 1")
def knn_same_batch_share(spark, d):
    return r6(neighbours.same_share(knn(spark, d), labels_of(spark, d, "modality")), "share")


@query(f"WITH {KNN}, n AS (SELECT a.label AS own, b.label AS other, count(*) AS n FROM knn JOIN vec a ON a.vec_id = query JOIN vec b ON b.vec_id = neighbour GROUP BY 1, 2) SELECT own, other, n, round(n / sum(n) OVER (PARTITION BY own)::DOUBLE, 6) AS share FROM n")
def mixing_matrix(spark, d):
    return r6(neighbours.mixing_matrix(knn(spark, d), labels_of(spark, d)), "share")


@query(f"WITH {KNN}, n AS (SELECT query, label, count(*) AS n FROM knn JOIN vec ON vec_id = neighbour GROUP BY 1, 2) SELECT query, round(sum(n) * sum(n) / sum(n * n)::DOUBLE, 6) AS ilisi FROM n GROUP BY 1")
def ilisi(spark, d):
    return r6(neighbours.inverse_simpson(knn(spark, d), labels_of(spark, d)), "ilisi")


BOTH = EUCLID + ", both_ AS (SELECT a, b, distance FROM e UNION ALL SELECT b, a, distance FROM e)"


def both_ways(spark, d):
    p = distance.pairwise(D.unit_vectors(spark, d), "euclidean")
    return p.unionAll(p.select("b", "a", "distance"))


@query(f"WITH {BOTH}, r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY distance, b) - 1 AS k FROM both_) SELECT a, b, round(k / 18.0::DOUBLE, 6) AS rank FROM r WHERE b = a + 10 OR a = b + 10")
def partner_rank(spark, d):
    pairs = D.vectors(spark, d).select("unit").distinct().select(F.col("unit").alias("a"), F.when(F.col("unit") < 10, F.col("unit") + 10).otherwise(F.col("unit") - 10).alias("b"))
    return r6(neighbours.partner_rank(both_ways(spark, d), pairs, 20), "rank")


@query(f"WITH {BOTH}, {UNIT_LABELS}, m AS (SELECT a, x.label AS la, y.label AS lb, avg(distance) AS d FROM both_ JOIN lab x ON a = x.unit JOIN lab y ON b = y.unit GROUP BY 1, 2, 3), s AS (SELECT a, max(d) FILTER (WHERE la = lb) AS i, min(d) FILTER (WHERE la <> lb) AS o FROM m GROUP BY 1) SELECT round(greatest(0, least(1, (1 - avg(coalesce((o - i) / greatest(o, i), 0))) / 2)), 6) AS asw_batch FROM s")
def silhouette_batch(spark, d):
    return r6(stats.silhouette_batch(both_ways(spark, d), unit_labels(spark, d).withColumnRenamed("unit", "id")), "asw_batch")


@query(f"WITH {D.LONG}, nd AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS dd FROM long a JOIN long b ON a.i = b.i WHERE a.modality = 'RNA' AND b.modality = 'ATAC' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dd, neighbour) AS r FROM nd) SELECT query, round(avg(abs(query % 7 - neighbour % 7)), 6) AS gap FROM k WHERE r <= 5 GROUP BY 1")
def nn_severity_gap(spark, d):
    x, y = sides(spark, d)
    values = D.vectors(spark, d).select(F.col("vec_id").alias("id"), (F.col("vec_id") % 7).alias("value"))
    return r6(neighbours.anchor_gap(neighbours.nearest(x, y, 5), values), "gap")


# Statistics


@query(f"WITH {D.CELLS}, c AS (SELECT corr(price, acct) AS a, corr(price, nation) AS b FROM cells) SELECT 'acct' AS component, round(a * a, 6) AS r2 FROM c UNION ALL SELECT 'nation', round(b * b, 6) FROM c")
def assoc_r2_continuous(spark, d):
    return r6(stats.r2_continuous(D.cells(spark, d), "price", ["acct", "nation"]), "r2")


ANOVA = "per AS (SELECT celltype, count(*) AS c, avg(price) AS m, var_pop(price) AS v FROM cells GROUP BY 1), al AS (SELECT sum(c)::BIGINT AS n, count(*) AS g, sum(c * m) / sum(c) AS mean FROM per), s AS (SELECT n, g AS groups, sum(c * (m - mean) * (m - mean)) AS ssb, sum(c * v) AS ssw FROM per, al GROUP BY 1, 2)"


@query(f"WITH {D.CELLS}, {ANOVA} SELECT n, groups, round(ssb / 1e9, 6) AS ssb, round((ssb + ssw) / 1e9, 6) AS sst, round(ssb / (groups - 1) / (ssw / (n - groups)), 6) AS f, round(ssb / (ssb + ssw), 6) AS eta_sq, round((ssb - (groups - 1) * ssw / (n - groups)) / (ssb + ssw + ssw / (n - groups)), 6) AS omega_sq FROM s")
def anova_oneway_eta_sq(spark, d):
    out = stats.anova(D.cells(spark, d), "celltype", "price").withColumns({"ssb": F.col("ssb") / 1e9, "sst": F.col("sst") / 1e9})
    return r6(out, "ssb", "sst", "f", "eta_sq", "omega_sq")


@query(f"WITH {D.CELLS}, {ANOVA} SELECT 'celltype' AS variable, round(ssb / (ssb + ssw), 6) AS r2 FROM s")
def assoc_r2_categorical(spark, d):
    return r6(stats.anova(D.cells(spark, d), "celltype", "price").select(F.lit("celltype").alias("variable"), F.col("eta_sq").alias("r2")), "r2")


@query(f"WITH {D.CELLS}, r AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS rx, rank() OVER (ORDER BY acct) + (count(*) OVER (PARTITION BY acct) - 1) / 2.0 AS ry FROM cells) SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r")
def spearman(spark, d):
    return r6(stats.spearman(D.cells(spark, d), "price", "acct"), "rho")


@query("WITH p AS (SELECT p_partkey, (p_partkey * 7919 % 10007) / 10007.0::DOUBLE * ((p_partkey * 7919 % 10007) / 10007.0::DOUBLE) AS p FROM part), q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, p_partkey) AS q FROM p) SELECT p_partkey, round(p, 6) AS p, round(least(1, min(q) OVER (ORDER BY p DESC, p_partkey DESC ROWS UNBOUNDED PRECEDING)), 6) AS fdr FROM q")
def bh_fdr(spark, d):
    u = (F.col("p_partkey") * 7919 % 10007) / F.lit(10007.0)
    return r6(stats.benjamini_hochberg(tables.read_table(spark, d, "part").select("p_partkey", (u * u).alias("p")), "p", "p_partkey"), "p", "fdr")


@query(f"WITH {D.CELLS} SELECT celltype, batch, grouping(celltype, batch)::INT AS level, count(price) AS n, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS sd FROM cells GROUP BY GROUPING SETS ((celltype), (batch), (celltype, batch))")
def group_desc_stats(spark, d):
    return r6(compose.describe_by(D.cells(spark, d), "celltype", "batch", "price"), "mean", "sd")


@query(f"WITH {D.CELLS} SELECT sample, celltype, count(*) AS n FROM cells GROUP BY 1, 2")
def contingency_table(spark, d):
    return compose.contingency(D.cells(spark, d), "sample", "celltype")


@query(f"WITH {D.LONG}, n AS (SELECT label, modality, count(*) AS n FROM vec GROUP BY 1, 2), p AS (SELECT label, n, n / sum(n) OVER (PARTITION BY label)::DOUBLE AS p FROM n) SELECT label, sum(n)::BIGINT AS size, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1")
def mixing_entropy(spark, d):
    return r6(stats.cluster_entropy(D.vectors(spark, d), "label", "modality"), "entropy")


@query(f"WITH {D.CELLS}, n AS (SELECT sample, celltype, count(*) AS o FROM cells GROUP BY 1, 2), a AS (SELECT sample, sum(o)::DOUBLE AS na FROM n GROUP BY 1), b AS (SELECT celltype, sum(o)::DOUBLE AS nb FROM n GROUP BY 1), g AS (SELECT a.sample, b.celltype, na * nb / (SELECT sum(o) FROM n) AS e, coalesce(o, 0) AS o FROM a CROSS JOIN b LEFT JOIN n ON n.sample = a.sample AND n.celltype = b.celltype) SELECT round(sum((o - e) * (o - e) / e), 6) AS chi2, ((count(DISTINCT sample) - 1) * (count(DISTINCT celltype) - 1))::BIGINT AS df FROM g")
def chi2_independence(spark, d):
    return r6(stats.chi2_independence(D.cells(spark, d), "sample", "celltype"), "chi2")


@query("""WITH n AS (SELECT label AS a, vec_id % 7 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS na FROM n GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM n GROUP BY 1), t AS (SELECT sum(n) AS t FROM n),
i AS (SELECT sum(n * (n - 1) / 2) AS idx, sum(n / t * ln(n * t / (na * nb))) AS mi FROM n JOIN ra USING (a) JOIN rb USING (b), t), ha AS (SELECT -sum(na / t * ln(na / t)) AS h, sum(na * (na - 1) / 2) AS p FROM ra, t), hb AS (SELECT -sum(nb / t * ln(nb / t)) AS h, sum(nb * (nb - 1) / 2) AS p FROM rb, t), pu AS (SELECT sum(m) AS m FROM (SELECT max(n) AS m FROM n GROUP BY b))
SELECT round(pu.m / t, 6) AS purity, round((idx - ha.p * hb.p / (t * (t - 1) / 2)) / ((ha.p + hb.p) / 2 - ha.p * hb.p / (t * (t - 1) / 2)), 6) AS ari, round(mi / ((ha.h + hb.h) / 2), 6) AS nmi FROM i, ha, hb, pu, t""")
def ari_nmi_purity(spark, d):
    return r6(compose.agreement(tables.read_table(spark, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("bucket")), "label", "bucket"), "purity", "ari", "nmi")


SCORES = "sc AS (SELECT l_shipmode_ AS method, l_returnflag AS variant, l_linestatus AS metric, avg(l_discount) AS value FROM (SELECT *, 'm' || (l_suppkey % 6)::VARCHAR AS l_shipmode_ FROM lineitem) GROUP BY 1, 2, 3)"


@query(f"WITH {SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY metric, variant ORDER BY round(value, 9) DESC NULLS LAST) AS r FROM sc) SELECT method, round(avg(m), 6) AS mean_rank FROM (SELECT method, metric, avg(r) AS m FROM r GROUP BY 1, 2) GROUP BY 1")
def method_rank_aggregate(spark, d):
    m = F.concat(F.lit("m"), (F.col("l_suppkey") % 6).cast("string"))
    scores = tables.read_table(spark, d, "lineitem").groupBy(m.alias("method"), "l_returnflag", "l_linestatus").agg(F.round(F.avg("l_discount"), 9).alias("value"))
    return r6(stats.rank_methods(scores, "method", "l_returnflag", "l_linestatus", "value"), "mean_rank")


SPLIT = "x AS (SELECT l_suppkey AS e, l_partkey % 30 AS f, sum(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2), y AS (SELECT l_suppkey AS e, l_partkey % 30 AS f, sum(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)"


def halves(spark, d):
    li = tables.read_table(spark, d, "lineitem")
    side = lambda s: li.where(F.col("l_linestatus") == s).groupBy(F.col("l_suppkey").alias("e"), (F.col("l_partkey") % 30).alias("f")).agg(F.sum("l_quantity").alias("value"))
    return side("O"), side("F")


@query(f"WITH {SPLIT}, b AS (SELECT e, f, coalesce(x.v, 0) AS xv, coalesce(y.v, 0) AS yv FROM x FULL JOIN y USING (e, f)) SELECT e, count(*) AS n, round(corr(xv, yv), 6) AS r FROM b GROUP BY 1 HAVING count(*) >= 3")
def per_entity_pearson(spark, d):
    return r6(stats.entity_pearson(*halves(spark, d), "e", "f"), "r")


@query(f"WITH {SPLIT}, b AS (SELECT f, x.v AS xv, y.v AS yv FROM x JOIN y USING (e, f)), r AS (SELECT f, rank() OVER (PARTITION BY f ORDER BY xv) + (count(*) OVER (PARTITION BY f, xv) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY f ORDER BY yv) + (count(*) OVER (PARTITION BY f, yv) - 1) / 2.0 AS ry FROM b) SELECT f, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1 HAVING count(*) >= 5")
def per_feature_spearman(spark, d):
    return r6(stats.feature_spearman(*halves(spark, d), "f", "e", 5), "rho")


@query("WITH t AS (SELECT user_id, value, epoch(ts) AS t, event_id FROM events), g AS (SELECT user_id, value, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS dt FROM t) SELECT user_id, round(sum(value * dt) / sum(dt) FILTER (WHERE value IS NOT NULL), 4) AS weighted, max(value) AS peak FROM g GROUP BY 1")
def time_weighted_avg(spark, d):
    out = compose.time_weighted(tables.read_table(spark, d, "events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "value")
    return out.withColumn("weighted", F.round("weighted", 4))


@query("SELECT 'g' || (l_partkey % 100)::VARCHAR AS gene, count(*) AS n, round(avg((l_quantity > 25)::INT), 6) AS share, avg((l_quantity > 25)::INT) >= 0.5 AS concordant FROM lineitem GROUP BY 1 HAVING count(*) >= 5")
def gene_concordance(spark, d):
    links = tables.read_table(spark, d, "lineitem").select(F.concat(F.lit("g"), (F.col("l_partkey") % 100).cast("string")).alias("gene"), (F.col("l_quantity") > 25).alias("agrees"))
    return r6(compose.gene_concordance(links, 5, 0.5), "share")


@query()
def association_permutation(spark, d):
    v = D.unit_vectors(spark, d)
    names = [f"pc{i}" for i in range(v.agg(F.max(F.size("v"))).first()[0] or 0)]
    rows = v.select("unit", *[F.col("v")[i].alias(c) for i, c in enumerate(names)], (F.col("unit") % 5).alias("x"))
    return r6(stats.r2_permutations(rows, "unit", "x", names), "r2", "p")


@query()
def moderated_t(spark, d):
    values = normalize.clr(compose.composition(D.cells(spark, d), "nation", "celltype")).select("unit", F.when(F.col("unit") % 2 == 0, "a").otherwise("b").alias("group"), F.col("celltype").alias("feature"), F.col("clr").alias("value"))
    return r6(stats.moderated_t(values, "group", "a", "b"), "difference", "t", "p", "fdr")


@query()
def sample_test(spark, d):
    cells = D.cells(spark, d).withColumn("sample", F.col("nation").cast("string"))
    n = cells.groupBy("sample").agg(F.count("*").alias("n"))
    s = compose.mean_and_variance(D.counts(spark, d), cells, "sample").join(n, "sample")
    groups = n.select("sample", F.when(F.col("sample").cast("int") % 2 == 0, "a").otherwise("b").alias("group"))
    return r6(differential.sample_test(s, groups, "a", "b"), "fold_change", "statistic", "p", "fdr")


def sample_stats(spark, d):
    cells = D.cells(spark, d).withColumn("sample", F.col("nation").cast("string"))
    n = cells.groupBy("sample").agg(F.count("*").alias("n"))
    of = F.col("sample").cast("int")
    samples = n.select("sample", F.element_at(F.array(*map(F.lit, "abc")), of % 3 + 1).alias("group"), (of / 2).cast("int").alias("individual"), of.cast("double").alias("value"))
    return compose.mean_and_variance(D.counts(spark, d), cells, "sample").join(n, "sample"), samples


@query()
def sample_test_paired(spark, d):
    s, samples = sample_stats(spark, d)
    sides = samples.withColumn("group", F.when(F.col("value") % 2 == 0, "a").otherwise("b")).where("individual < 12")
    return r6(differential.sample_test(s, sides, "a", "b", "paired"), "fold_change", "statistic", "p", "fdr")


@query()
def sample_test_continuous(spark, d):
    s, samples = sample_stats(spark, d)
    return r6(differential.sample_test(s, samples, kind="continuous"), "fold_change", "statistic", "p", "fdr")


@query()
def sample_test_pairwise(spark, d):
    s, samples = sample_stats(spark, d)
    return r6(differential.pairwise_tests(s, samples, permutations=20)[0], "fold_change", "statistic", "p", "fdr")


@query()
def pseudobulk_corrected(spark, d):
    return r6(compose.pseudobulk_corrected(D.counts(spark, d), D.cells(spark, d).withColumn("unit", F.col("nation")), "unit", "celltype", "batch", 50), "value")


@query("WITH z AS (SELECT p_brand, p_size, coalesce((p_retailprice - avg(p_retailprice) OVER w) / nullif(stddev_pop(p_retailprice) OVER w, 0), 0) AS z FROM part WINDOW w AS (PARTITION BY p_brand)), m AS (SELECT p_brand, p_size, round(avg(z), 9) AS m FROM z GROUP BY 1, 2), k AS (SELECT p_brand, p_size AS peak, row_number() OVER (PARTITION BY p_brand ORDER BY m DESC, p_size) AS i FROM m) SELECT p_brand, peak, row_number() OVER (ORDER BY peak, p_brand)::INT AS rank FROM k WHERE i = 1")
def temporal_order(spark, d):
    return trajectory.temporal_order(trajectory.z_scores(tables.read_table(spark, d, "part"), "p_brand", "p_retailprice"), "p_brand", "p_size")


@query()
def two_way_anova(spark, d):
    rows = D.cells(spark, d).groupBy("sample", "batch", "celltype").agg(F.avg("price").alias("y")).orderBy("sample", "batch", "celltype").collect()
    found = stats.two_way(np.array([r["y"] for r in rows]), [r["sample"] for r in rows], [r["batch"] for r in rows])
    return spark.createDataFrame([(k, *[round(float(v[c]), 6) for c in ("df", "f", "p", "eta_sq", "partial_eta_sq")]) for k, v in found.items()], "term string, df double, f double, p double, eta_sq double, partial_eta_sq double")


# Trajectories

TIMED = "u AS (SELECT user_id, min(event_id) AS first, avg(value) AS x, count(*)::DOUBLE AS y FROM events GROUP BY 1)"


def timed(spark, d):
    return tables.read_table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first"), F.avg("value").alias("x"), F.count("*").cast("double").alias("y"))


@query(f"WITH {TIMED} SELECT user_id, round((row_number() OVER (ORDER BY first, user_id) - 1) / (count(*) OVER () - 1)::DOUBLE, 6) AS pseudotime FROM u")
def rank_pseudotime(spark, d):
    return r6(trajectory.rank_pseudotime(timed(spark, d), "user_id", "first"), "pseudotime")


@query(f"WITH {TIMED}, s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS dd FROM u WINDOW w AS (ORDER BY first, user_id)), c AS (SELECT user_id, sum(dd) OVER (ORDER BY first, user_id ROWS UNBOUNDED PRECEDING) AS cs FROM s) SELECT user_id, round(cs / max(cs) OVER (), 6) AS pseudotime FROM c")
def distance_pseudotime(spark, d):
    return r6(trajectory.path_pseudotime(timed(spark, d), "user_id", "first", ["x", "y"]), "pseudotime")


@query(f"WITH {TIMED}, r AS (SELECT y, row_number() OVER (ORDER BY first) - 1 AS i, row_number() OVER (ORDER BY y, first) - 1 AS k, count(*) OVER () AS n FROM u) SELECT round(sum(y * (2 * i - n + 1)) / sum(y * (2 * k - n + 1)), 6) AS score FROM r")
def order_score(spark, d):
    return r6(trajectory.order_score(timed(spark, d), "first", "y"), "score")


@query(f"WITH {TIMED}, e AS (SELECT min(y) AS lo, max(y) AS hi FROM u) SELECT user_id, round((y - lo) / (hi - lo), 6) AS y FROM u, e")
def min_max_scale(spark, d):
    return r6(trajectory.min_max(timed(spark, d).select("user_id", "y"), ["y"]), "y")


@query("SELECT p_partkey, round(coalesce((p_retailprice - avg(p_retailprice) OVER w) / nullif(stddev_pop(p_retailprice) OVER w, 0), 0), 6) AS z FROM part WINDOW w AS (PARTITION BY p_brand)")
def feature_z_scores(spark, d):
    return r6(trajectory.z_scores(tables.read_table(spark, d, "part"), "p_brand", "p_retailprice").select("p_partkey", "z"), "z")


@query("WITH c AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer) SELECT c_custkey, ((a < c_acctbal)::INT + (b < c_acctbal)::INT + (c < c_acctbal)::INT) AS bin FROM customer, c")
def quantile_bins(spark, d):
    return trajectory.quantile_bins(tables.read_table(spark, d, "customer"), "c_acctbal").select("c_custkey", "bin")


@query("(SELECT c_custkey, c_acctbal, 'low' AS side FROM customer ORDER BY c_acctbal, c_custkey LIMIT 15) UNION ALL (SELECT c_custkey, c_acctbal, 'high' FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15)")
def extremes(spark, d):
    return trajectory.extremes(tables.read_table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", 15)


@query(f"WITH {D.COMP}, t AS (SELECT unit, (row_number() OVER (ORDER BY unit) - 1)::DOUBLE AS pt FROM (SELECT DISTINCT unit FROM comp)), r AS (SELECT celltype, round(corr(proportion, pt), 6) AS r FROM comp JOIN t USING (unit) GROUP BY 1) SELECT celltype, r, row_number() OVER (ORDER BY abs(r) DESC, celltype)::INT AS rank FROM r")
def proportion_trends(spark, d):
    comp = compose.composition(D.cells(spark, d))
    order = comp.select("unit").distinct().select("unit", (F.row_number().over(Window.orderBy("unit")) - 1).cast("double").alias("pseudotime"))
    return r6(trajectory.proportion_trends(comp, order), "r")


def unit_table(spark, d):
    """The units' first four principal components over all coordinates, and a target."""
    units, _, x = embedding.matrix(D.unit_vectors(spark, d).select("unit", F.posexplode("v").alias("feature", "value")))
    return spark.createDataFrame([(u, [float(v) for v in row], float(u % 5)) for u, row in zip(units, embedding.pca(x, 4), strict=True)], "unit long, pc array<double>, y double")


@query()
def cca_pseudotime(spark, d):
    return r6(trajectory.cca_pseudotime(unit_table(spark, d), "unit", "pc", "y"), "score", "pseudotime")


@query()
def cca_permutation(spark, d):
    score, p = trajectory.cca_permutation(unit_table(spark, d), "unit", "pc", "y")
    return spark.createDataFrame([(round(score, 6), p)], "score double, p double")


@query()
def mst_path(spark, d):
    return trajectory.tree_pseudotime(unit_table(spark, d), "unit", "pc", "y")


@query()
def gam_trend(spark, d):
    bulk = compose.pseudobulk(D.counts(spark, d), D.cells(spark, d).withColumn("unit", F.col("nation")), ["unit"]).withColumnRenamed("feature_id", "feature")
    return r6(trajectory.gam_trends(bulk, bulk.select("unit").distinct().select("unit", F.col("unit").cast("double").alias("pseudotime"))), "p", "deviance", "effect", "fdr")


# Clusters and tuning


@query()
def kmeans_clusters(spark, d):
    return clusters.kmeans(D.vectors(spark, d), "vec_id", "embedding", 5)


@query()
def gmm_bic(spark, d):
    rows = unit_table(spark, d).orderBy("unit").collect()
    found = trajectory.cluster_by_bic(np.array([r["pc"] for r in rows]))
    return spark.createDataFrame([(r["unit"], int(c)) for r, c in zip(rows, found, strict=True)], "unit long, cluster int")


@query()
def leiden_clusters(spark, d):
    return clusters.cell_types(knn(spark, d), D.vectors(spark, d), "vec_id", "embedding", target=5)


@query()
def cluster_reconciliation(spark, d):
    return clusters.reconcile(tables.read_table(spark, d, "embeddings").select((F.col("vec_id") % 7).alias("c"), "label"), "c", "label")


def blocks(spark, d):
    """Units, and the four blocks of their embedding with weights."""
    made = [(embedding.matrix(b), w) for b, w in embedding.sample_blocks(D.vectors(spark, d), "unit", "label", "embedding", "vec_id")]
    return made[0][0][0], [x for (_, _, x), _ in made], [w for _, w in made]


@query()
def autotune_alpha(spark, d):
    units, made, weights = blocks(spark, d)
    score, alpha = tuning.autotune(made, weights[:-1], [float(u % 5) for u in units], "cca")
    return spark.createDataFrame([(round(score, 6), round(alpha, 6))], "score double, alpha double")


@query()
def stratified_subsample(spark, d):
    return tuning.stratified_sample(tables.read_table(spark, d, "customer"), "c_custkey", "c_mktsegment", "c_nationkey", 200, 2)


@query("SELECT 'c_custkey' AS \"column\", 'bigint' AS type, count(*) AS n, count(*) - count(c_custkey) AS nulls, count(DISTINCT c_custkey) AS \"distinct\" FROM customer UNION ALL SELECT 'c_name', 'string', count(*), count(*) - count(c_name), count(DISTINCT c_name) FROM customer UNION ALL SELECT 'c_nationkey', 'int', count(*), count(*) - count(c_nationkey), count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', 'double', count(*), count(*) - count(c_acctbal), count(DISTINCT c_acctbal) FROM customer UNION ALL SELECT 'c_mktsegment', 'string', count(*), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer")
def table_profile(spark, d):
    return tables.profile(tables.read_table(spark, d, "customer"))


# Feature identifiers, feature filters and alignment of modalities


def mixed_ids(spark, d):
    return tables.read_table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("ENSG"), F.lpad(F.col("p_partkey").cast("string"), 11, "0"))).otherwise(F.col("p_name")).alias("feature_id"))


@query("SELECT round(avg((p_partkey % 2 = 0)::INT), 6) AS share, 'mixed' AS kind FROM part")
def identifier_kind(spark, d):
    return r6(joins.identifier_kind(mixed_ids(spark, d), C.is_ensembl), "share")


MAPPED = "f AS (SELECT DISTINCT 'g' || (l_partkey % 200)::VARCHAR AS feature_id FROM lineitem), m AS (SELECT 'G' || p_partkey::VARCHAR AS symbol, min('E' || (p_partkey % 70)::VARCHAR) AS gene_id FROM part WHERE p_partkey % 3 > 0 GROUP BY 1), r AS (SELECT feature_id, gene_id, row_number() OVER (PARTITION BY gene_id ORDER BY feature_id) AS k FROM f JOIN m ON upper(feature_id) = symbol)"


def gene_map(spark, d):
    features = tables.read_table(spark, d, "lineitem").select(F.concat(F.lit("g"), (F.col("l_partkey") % 200).cast("string")).alias("feature_id")).distinct()
    mapping = tables.read_table(spark, d, "part").where("p_partkey % 3 > 0").select(F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("symbol"), F.concat(F.lit("E"), (F.col("p_partkey") % 70).cast("string")).alias("gene_id"))
    return features, mapping


@query(f"WITH {MAPPED} SELECT feature_id, gene_id FROM r WHERE k = 1")
def map_genes_first(spark, d):
    return joins.map_genes(*gene_map(spark, d), policy="first")


@query(f"WITH {MAPPED} SELECT feature_id, CASE WHEN k > 1 THEN gene_id || '-' || (k - 1)::VARCHAR ELSE gene_id END AS gene_id FROM r")
def map_genes_suffix(spark, d):
    return joins.map_genes(*gene_map(spark, d), policy="suffix")


@query("SELECT name, CASE WHEN name LIKE '1-URGENT - %' THEN 'urgent' || substr(name, 9) WHEN name LIKE '5-LOW - %' THEN 'low' || substr(name, 6) ELSE name END AS renamed FROM (SELECT DISTINCT CASE WHEN o_orderkey % 50 = 0 THEN 'bare' ELSE o_orderpriority || ' - ' || o_orderstatus END AS name FROM orders)")
def relabel_features(spark, d):
    o = tables.read_table(spark, d, "orders")
    names = o.select(F.when(F.col("o_orderkey") % 50 == 0, "bare").otherwise(F.concat_ws(" - ", "o_orderpriority", "o_orderstatus")).alias("name")).distinct()
    return names.withColumn("renamed", C.relabel_feature(F.col("name"), {"1-URGENT": "urgent", "5-LOW": "low"}))


@query(f"WITH {D.UNITS}, k AS (SELECT i FROM units GROUP BY 1 HAVING var_samp(x) >= 0.001) SELECT unit, i::INT AS feature_id, round(x, 6) AS value FROM units WHERE i IN (SELECT i FROM k)")
def varying_features(spark, d):
    values = D.unit_vectors(spark, d).select("unit", F.posexplode("v").alias("p", "value")).select("unit", (F.col("p") + 1).alias("feature_id"), "value")
    return r6(qc.varying_features(values, 0.001), "value")


@query(f"WITH {D.COUNTS}, {D.CELLS} SELECT DISTINCT celltype, feature_id FROM counts JOIN cells USING (cell_id) WHERE value >= 50")
def nonzero_features(spark, d):
    counts = D.counts(spark, d).withColumn("value", F.when(F.col("value") >= 50, F.col("value")).otherwise(0.0))
    return qc.nonzero_features(counts.join(D.cells(spark, d).select("cell_id", "celltype"), "cell_id"))


@query(f"WITH {D.CELLS} SELECT nation AS sample, count(*) AS n FROM cells WHERE nation IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1")
def batch_subset(spark, d):
    listed = tables.read_table(spark, d, "nation").select(F.col("n_nationkey").alias("sample"), F.col("n_regionkey").cast("string").alias("batch"))
    cells = D.cells(spark, d).select("cell_id", F.col("nation").alias("sample"))
    return qc.batch_subset(cells, listed, "1").groupBy("sample").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT o_orderpriority AS celltype, (o_orderkey * 37 % 1000 + 1) / 1001.0::DOUBLE AS p FROM orders), g AS (SELECT celltype, sum((p < 0.05)::INT)::BIGINT AS n_significant, min(p) AS least FROM r GROUP BY 1) SELECT celltype, n_significant, round(least, 6) AS least, row_number() OVER (ORDER BY n_significant DESC, least, celltype)::INT AS rank FROM g")
def significance_order(spark, d):
    results = tables.read_table(spark, d, "orders").select(F.col("o_orderpriority").alias("celltype"), ((F.col("o_orderkey") * 37 % 1000 + 1) / F.lit(1001.0)).alias("p"))
    return r6(features.significance_order(results), "least")


@query(f"WITH {KNN}, s AS (SELECT query, i, avg(x) AS y FROM knn JOIN long ON long.vec_id = neighbour GROUP BY 1, 2) SELECT s.i::INT AS feature_id, count(*) AS n, round(corr(x, y), 6) AS r FROM s JOIN long ON long.vec_id = query AND long.i = s.i GROUP BY 1")
def knn_smoothed_correlation(spark, d):
    v = D.vectors(spark, d)
    values = v.select(F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("p", "x")).select("cell_id", (F.col("p") + 1).alias("feature_id"), F.col("x").cast("double").alias("value"))
    own = values.select(F.col("cell_id").alias("query"), "feature_id", F.col("value").alias("x"))
    both = neighbours.smooth(knn(spark, d), values).join(own, ["query", "feature_id"])
    return r6(both.groupBy("feature_id").agg(F.count("*").alias("n"), F.corr("x", "value").alias("r")), "r")


LOGGED = D.COUNTS + ", tot AS (SELECT cell_id, sum(value) AS t FROM counts GROUP BY 1), v AS (SELECT cell_id, feature_id, ln(1 + value * 1e4 / t) AS value FROM counts JOIN tot USING (cell_id)), nc AS (SELECT count(*) AS n FROM tot)"


def aligned(spark, d, method):
    counts = D.counts(spark, d)
    n = counts.agg(F.countDistinct("cell_id")).first()[0]
    return r6(normalize.align_features(normalize.log1p_total(counts), n, method), "value", "zero_value")


@query(f"WITH {LOGGED}, m AS (SELECT feature_id, sum(value) AS s, sum(value * value) AS ss FROM v GROUP BY 1), k AS (SELECT feature_id, s / n AS mean, sqrt((ss - s * s / n) / (n - 1)) AS sd FROM m CROSS JOIN nc) SELECT v.cell_id, v.feature_id, round((value - mean) / sd, 6) AS value, round(-mean / sd, 6) AS zero_value FROM v JOIN k ON k.feature_id = v.feature_id")
def align_zscore(spark, d):
    return aligned(spark, d, "zscore")


@query(f"WITH {LOGGED}, m AS (SELECT feature_id, max(value) AS hi FROM v GROUP BY 1) SELECT cell_id, feature_id, round(value / hi, 6) AS value, 0.0::DOUBLE AS zero_value FROM v JOIN m USING (feature_id)")
def align_minmax(spark, d):
    return aligned(spark, d, "minmax")


@query(f"WITH {D.COUNTS}, nc AS (SELECT count(DISTINCT cell_id) AS n FROM counts), r AS (SELECT cell_id, feature_id, rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature_id) AS c FROM counts) SELECT cell_id, feature_id, round((n - c + r) / n, 6)::DOUBLE AS value, round((n - c + 1) / 2.0 / n, 6)::DOUBLE AS zero_value FROM r, nc")
def align_rank(spark, d):
    counts = D.counts(spark, d)
    n = counts.agg(F.countDistinct("cell_id")).first()[0]
    return r6(normalize.align_features(counts, n, "rank"), "value", "zero_value")


def carried(spark, d, zero_aware):
    """Every second cell as one modality, the others carried to its distributions."""
    logged = normalize.log1p_total(D.counts(spark, d))
    return r6(normalize.align_quantiles(logged.where("cell_id % 2 = 0"), logged.where("cell_id % 2 = 1"), zero_aware), "value", "zero_value")


@query()
def align_quantile(spark, d):
    return carried(spark, d, False)


@query()
def align_zero_aware_quantile(spark, d):
    return carried(spark, d, True)


@query()
def count_pca(spark, d):
    found = embedding.count_pca(normalize.log1p_total(D.counts(spark, d)), 5)
    return found.select("cell_id", F.transform("pc", lambda x: F.round(x, 4)).alias("pc"))


@query()
def lsi_embedding(spark, d):
    return embedding.lsi(D.counts(spark, d), 10)[0].select("cell_id", F.transform("lsi", lambda x: F.round(x, 4)).alias("lsi"))


@query()
def variable_by_batch(spark, d):
    return r6(features.variable_by_batch(D.counts(spark, d), D.cells(spark, d).select("cell_id", F.col("sample").alias("batch")), 30), "median_rank")


@query()
def tukey_hsd(spark, d):
    rows = D.cells(spark, d).groupBy("sample", "batch", "celltype").agg(F.avg("price").alias("y")).orderBy("sample", "batch", "celltype").collect()
    found = stats.tukey(np.array([r["y"] for r in rows]), [r["batch"] for r in rows])
    return spark.createDataFrame([(a, b, round(gap, 6), round(p, 6), bool(no)) for a, b, gap, p, no in found], "one string, other string, difference double, p double, rejected boolean")


@query()
def cca_imputed(spark, d):
    units = unit_table(spark, d).withColumn("y", F.when(F.col("unit") != 3, F.col("y")))
    return r6(trajectory.cca_with_all(units, "unit", "pc", "y"), "y", "score", "pseudotime")


@query(f"WITH {TIMED} SELECT c_custkey, c_mktsegment, x AS pseudotime FROM customer JOIN (SELECT user_id, round(x, 6) AS x FROM u) ON user_id = c_custkey")
def pseudotime_inner_join(spark, d):
    meta = tables.read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    time = timed(spark, d).select(F.col("user_id").cast("string").alias("sample"), F.round("x", 6).alias("pseudotime"))
    return joins.with_pseudotime(meta, time, "c_custkey")


@query("SELECT n_name AS sample, n_nationkey::DOUBLE AS pc FROM nation WHERE n_nationkey % 3 <> 0")
def sample_matching(spark, d):
    n = tables.read_table(spark, d, "nation")
    reduced = n.select(F.lower("n_name").alias("sample"), F.col("n_nationkey").cast("double").alias("pc"))
    return joins.match_samples(reduced, n.where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("sample")))


NUMERIC = "(SELECT count({c}) AS n, count(DISTINCT {c}) AS d, bool_and({c}::DOUBLE % 1 = 0) AS w, '{c}' AS c FROM {t})"


@query(" UNION ALL ".join(f"SELECT c AS \"column\", CASE WHEN d <= 10 AND d < 0.1 * n AND w THEN 'ordinal' ELSE 'numerical' END AS kind, d AS n_distinct FROM {NUMERIC.format(c=c, t='part')}" for c in ("p_size", "p_retailprice", "p_partkey")) + " UNION ALL SELECT 'p_brand', 'categorical', count(DISTINCT p_brand) FROM part")
def data_types(spark, d):
    return qc.data_types(tables.read_table(spark, d, "part"), ["p_size", "p_retailprice", "p_partkey", "p_brand"])


@query()
def combat_units(spark, d):
    rows = D.unit_vectors(spark, d).orderBy("unit").collect()
    y = stats.combat(np.array([r["v"] for r in rows]), [r["unit"] % 3 for r in rows])
    return spark.createDataFrame([(r["unit"], [round(float(v), 6) for v in x]) for r, x in zip(rows, y, strict=True)], "unit long, v array<double>")


@query()
def random_pair_baseline(spark, d):
    return r6(stats.pair_baseline(*halves(spark, d), "e", "f"), "mean_r")


ASSOCIATION = "WITH r AS (SELECT o_orderpriority AS variable, o_orderstatus AS component, regr_r2(o_totalprice, (o_orderkey % 97)::DOUBLE) AS r2 FROM orders GROUP BY 1, 2)"


@query(f"{ASSOCIATION} SELECT variable, component, round(r2, 6) AS r2, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY r2 DESC, component) AS rank FROM r) WHERE rank <= 2")
def best_components(spark, d):
    o = tables.read_table(spark, d, "orders")
    r2 = o.groupBy(F.col("o_orderpriority").alias("variable"), F.col("o_orderstatus").alias("component")).agg(F.pow(F.corr("o_totalprice", (F.col("o_orderkey") % 97).cast("double")), 2).alias("r2"))
    return r6(tuning.best_components(r2), "r2")


@query()
def ablation_variants(spark, d):
    """Mean squared coordinate of the units under each variant of the embedding."""
    units, made, weights = blocks(spark, d)
    variants = tuning.ablations(made, weights, [u % 3 for u in units], 5)
    return spark.createDataFrame([(name, len(z), round(float((z**2).mean()), 6)) for name, z in variants.items()], "variant string, n long, mean_square double")
