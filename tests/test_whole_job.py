"""Queries do their whole job: held against SQL over whole tables, brute force and planted inputs."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessella.operators import embedding, features, qc
from tessella.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def by_sql(name, folder=SF):
    sql = ORACLES[name]
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con.execute(sql).df()


def same(got, want, keys):
    got, want = (x.sort_values(keys).reset_index(drop=True) for x in (got[list(want.columns)], want))
    assert len(got) == len(want)
    for c in want.columns:
        if want[c].dtype.kind == "f":
            assert np.allclose(got[c].astype(float), want[c], atol=2e-6, equal_nan=True), c
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c


@pytest.mark.parametrize("name", ["gene_activity_weighted_sum", "gene_activity_weighted_mean", "gene_activity_max_weighted", "gene_activity_sum", "nearest_owner_activity"])
def test_activity_takes_every_cell(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    same(got, by_sql(name), ["cell_id", "gene"])
    assert (got["cell_id"] % 50 != 0).any()


def test_doublets_score_every_cell(spark):
    cells = duckdb.connect().execute(f"select distinct o_orderkey from '{SF}/orders.parquet' join '{SF}/customer.parquet' on o_custkey = c_custkey join '{SF}/lineitem.parquet' on l_orderkey = o_orderkey").df()
    got = QUERIES["doublet_scores"](spark, SF).toPandas()
    assert sorted(got["cell_id"].astype(int)) == sorted(cells["o_orderkey"]) and got["score"].between(0, 1).all()


def test_doublets_are_found_whatever_the_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(c, f"f{f}", float(v)) for c in range(60) for f, v in zip(rng.permutation(12)[:5] + 12 * (c % 2), rng.integers(1, 9, 5), strict=True)]
    rows += [(100 + c, f"f{f}", float(rng.integers(1, 9))) for c in range(3) for f in (1, 2, 3, 4, 13, 14, 15, 16)]
    counts = spark.createDataFrame(rows, "cell_id long, feature_id string, value double")
    sample = counts.select("cell_id").distinct().selectExpr("cell_id", "'s' as sample")
    one, many = ({r["cell_id"]: r["score"] for r in qc.doublet_scores(counts, sample, block=b).collect()} for b in (1024, 7))
    assert one == many and len(one) == 63
    assert np.mean([one[str(100 + c)] for c in range(3)]) > np.mean([one[str(c)] for c in range(60)])


def test_doublets_meet_by_shared_features(spark):
    """Many copies, few shared features: scores as by all distances, whatever the blocks and chunks; copies are compared once."""
    rng = np.random.default_rng(3)
    kinds = [{int(f): float(v) for f, v in zip(rng.permutation(40)[: rng.integers(1, 5)], rng.integers(1, 9, 4), strict=False)} for _ in range(30)]
    of = [kinds[c % 30] if c < 150 else {int(f): float(rng.integers(1, 9)) for f in rng.permutation(40)[:3]} for c in range(170)]
    cells = {(s, 1000 * s + c): x for s in (1, 2) for c, x in enumerate(of[: 170 if s == 1 else 1])}
    counts = spark.createDataFrame([(c, f"f{f}", v) for (_, c), x in cells.items() for f, v in x.items()], "cell_id long, feature_id string, value double")
    sample = spark.createDataFrame([(c, f"s{s}") for s, c in cells], "cell_id long, sample string")
    want = {}
    for s in (1, 2):
        own = sorted((str(c), x) for (t, c), x in cells.items() if t == s)
        n = len(own)
        made = spark.range(n * 2).selectExpr("id", f"pmod(xxhash64(42, 'a', 's{s}', id), {n}L) as a", f"pmod(xxhash64(42, 'b', 's{s}', id), {n}L) as b").orderBy("id").collect()
        prefix = spark.range(1).selectExpr(f"xxhash64(42, 'a', 's{s}') as p").first()["p"]
        assert (qc.hashed(prefix, np.arange(n * 2)) % n).tolist() == [r["a"] for r in made]
        x = np.zeros((3 * n, 40))
        for i, (_, y) in enumerate(own):
            x[i, list(y)] = list(y.values())
        for r in made:
            x[n + r["id"]] = x[r["a"]] + x[r["b"]]
        x = np.log1p(1e4 * x / x.sum(axis=1, keepdims=True))
        for i, (c, _) in enumerate(own):
            d = np.round(((x - x[i]) ** 2).sum(axis=1), 9)
            want[c] = np.mean([j >= n for j in np.lexsort((np.arange(3 * n), d)) if j != i][:10])
    for options in ({}, {"block": 64, "chunk": 50}, {"block": 33}):
        got = {r["cell_id"]: r["score"] for r in qc.doublet_scores(counts, sample, **options).collect()}
        assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want)
    sink = pa.BufferOutputStream()
    table = pa.table({"at": range(150), "cell_id": [str(i) for i in range(150)], "x": pa.array([[{"f": f, "v": v} for f, v in x.items()] for x in of[:150]])})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    ones, number = qc.Cells([sink.getvalue().to_pybytes()], 0).copies(np.arange(150))
    assert len(ones) == len({tuple(sorted(x.items())) for x in kinds}) and all(of[ones[m]] == of[i] for i, m in enumerate(number))


def test_anchors_follow_the_cells(spark, monkeypatch):
    asked, fit = [], embedding.kmeans_anchors
    monkeypatch.setattr(embedding, "kmeans_anchors", lambda cells, vector, k, seed: asked.append(k) or fit(cells, vector, min(k, 3), seed, 1))
    cells = spark.range(2400).selectExpr("id as vec_id", "id % 4 as unit", "id % 3 as label", "array(double(id % 7), double(id % 11)) as v")
    embedding.sample_embedding(cells, "unit", "label", "v", "vec_id")
    embedding.sample_embedding(cells, "unit", "label", "v", "vec_id", k_fine=5)
    embedding.sample_embedding(cells.where("vec_id < 100"), "unit", "label", "v", "vec_id")
    assert asked == [12, 24, 12, 5, 2, 2]


def test_gene_ids_meet_all_parts(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["gene_id_intersection"](spark, folder).toPandas()
    same(got, by_sql("gene_id_intersection", folder), ["gene"])
    assert len(got) > 200


def plain_fit(x, y, span):
    k, out = max(4, int(np.ceil(span * len(x)))), []
    for at in x:
        d = np.abs(x - at)
        near = np.argsort(d, kind="stable")[:k]
        w = np.sqrt((1 - np.minimum(d[near] / d[near].max(), 1) ** 3) ** 3)
        a = np.vander(x[near] - at, 3, increasing=True)
        out.append(np.linalg.lstsq(a * w[:, None], y[near] * w, rcond=None)[0][0])
    return np.array(out)


def test_the_variance_curve_takes_every_feature(spark):
    rng = np.random.default_rng(3)
    n, m = 12, 4300
    x = np.round(rng.gamma(2, np.exp(rng.normal(0, 1, m)), (n, m)) + 0.01, 3)
    counts = spark.createDataFrame([(int(c), f"f{f}", float(x[c, f])) for c in range(n) for f in range(m)], "cell_id long, feature_id string, value double")
    mean, var = x.mean(0), x.var(0, ddof=1)
    order = np.lexsort((np.log10(var), np.log10(mean)))
    sd = np.empty(m)
    sd[order] = 10 ** (plain_fit(np.log10(mean)[order], np.log10(var)[order], 0.3) / 2)
    z = np.minimum((x - mean) / sd, np.sqrt(n)).var(0, ddof=1)
    got = features.variable_by_standardised(counts, n, m).collect()
    assert len(got) == m
    # Features with the very same mean share one point of the curve.
    once = {f"f{f}" for f in range(m) if (np.abs(mean - mean[f]) < 1e-9).sum() == 1}
    assert len(once) > m / 2 and all(abs(r["variance"] - z[int(r["feature_id"][1:])]) < 1e-7 for r in got if r["feature_id"] in once)


@pytest.mark.parametrize(("name", "keys"), [("linear_batch_removal", ["unit", "feature"]), ("knn_smoothed_correlation", ["feature_id"])])
def test_every_coordinate_is_a_feature(spark, name, keys):
    got = QUERIES[name](spark, SF).toPandas()
    same(got, by_sql(name), keys)
    assert got[keys[-1]].nunique() == 64
