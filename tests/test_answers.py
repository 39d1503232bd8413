"""Answers held against definitions: ties, orders, degrees of freedom, alignments, decompositions, post-hoc tests, readers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.special import studentized_range_tail
from tessella.operators import compose, embedding, features, joins, neighbours, normalize, qc, stats, trajectory
from tessella.sources import tables


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_equal_distances_go_by_id(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "PAIRS", 50)
    same = [(i, [1.0, 2.0]) for i in range(1, 101)]
    other = [(200 + i, [float(i % 3), float(i % 2) + 0.5]) for i in range(30)]
    df = spark.createDataFrame(same + other, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in neighbours.nearest(df, df, 3, metric).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"]))
    vectors = dict(same + other)
    for q, x in vectors.items():
        x = np.array(x)
        far = lambda y: np.linalg.norm(x - y) if metric == "euclidean" else 1 - (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y))
        want = sorted((round(float(far(np.array(y))), 9), i) for i, y in vectors.items() if i != q)[:3]
        if metric == "euclidean" or want[0][0] != want[2][0]:
            assert [i for _, i in sorted(got[q])] == [i for _, i in want]
    assert [i for _, i in sorted(got[50])] == [1, 2, 3]


def test_order_along_the_path_is_by_cluster_first(spark, monkeypatch):
    """Two clusters share an edge and overlap in their projections on it: all of the first come before all of the second."""
    x = {0: (0.0, 0.0), 1: (1.6, 1.5), 2: (0.4, -1.5), 3: (1.0, 0.1), 4: (0.7, 0.0), 5: (3.0, 0.0)}
    cluster = np.array([0, 0, 0, 1, 1, 2])
    monkeypatch.setattr(trajectory, "cluster_by_bic", lambda *a: cluster)
    units = spark.createDataFrame([(k, list(v), float(k)) for k, v in x.items()], "unit long, v array<double>, y double")
    rows = sorted(trajectory.tree_pseudotime(units, "unit", "v", "y").collect(), key=lambda r: r["pseudotime"])
    assert [r["cluster"] for r in rows] == sorted(r["cluster"] for r in rows)
    assert [r["unit"] for r in rows if r["cluster"] == 0] == [2, 0, 1]


def test_pseudobulk_has_every_unit(spark):
    counts = spark.createDataFrame([(1, "a", 2.0), (2, "a", 4.0), (3, "b", 1.0), (3, "c", 0.0)], "cell_id long, feature_id string, value double")
    cells = spark.createDataFrame([(1, "s", "t"), (2, "s", "t"), (3, "u", "w"), (4, "z", "t")], "cell_id long, unit string, celltype string")
    got = {(r["unit"], r["feature"]): r["value"] for r in compose.pseudobulk_features(counts, cells, "unit", "celltype").collect()}
    assert got == {("s", "t - a"): 3.0, ("u", "t - a"): 0.0, ("z", "t - a"): 0.0, ("s", "w - b"): 0.0, ("u", "w - b"): 1.0, ("z", "w - b"): 0.0}


def test_each_feature_has_its_own_units(spark):
    rng = np.random.default_rng(4)
    rows = [(u, "ab"[u % 2], f"f{k}", float(rng.normal(k % 3, 1 + k % 4))) for k in range(12) for u in range(20 if k % 2 else 8)]
    got = {r["feature"]: r for r in stats.moderated_t(spark.createDataFrame(rows, "unit long, group string, feature string, value double"), "group", "a", "b").collect()}
    var, df, gap, error = [], [], [], []
    for k in range(12):
        a, b = (np.array([v for _, g, f, v in rows if f == f"f{k}" and g == side]) for side in "ab")
        df.append(len(a) + len(b) - 2)
        var.append((((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) / df[-1])
        gap.append(a.mean() - b.mean())
        error.append(1 / len(a) + 1 / len(b))
    shrunk, prior, _ = stats.squeeze_variances(np.array(var), np.array(df))
    from tessella.functions.special import t_tail

    for k in range(12):
        t = gap[k] / math.sqrt(shrunk[k] * error[k])
        assert abs(got[f"f{k}"]["t"] - t) < 1e-9 and abs(got[f"f{k}"]["p"] - t_tail(t, min(df[k] + prior, sum(df)))) < 1e-9


def test_spline_sizes():
    assert [trajectory.spline_size(n) for n in (2, 3, 4, 5, 6, 7, 9, 10, 12, 13, 40)] == [(2, 1), (2, 1), (3, 2), (3, 2), (4, 3), (4, 3), (4, 3), (4, 3), (5, 3), (5, 3), (5, 3)]


def carried(r, t, strict):
    """A target carried to a reference's quantiles, value by value."""
    q = np.round(np.quantile(r, np.linspace(0, 1, min(1000, len(r)))), 10)
    p = np.linspace(0, 1, len(q))
    out = []
    for x in t:
        u = 0.0 if x <= q[0] else 1.0 if x >= q[-1] else (np.interp(x, q, p) - np.interp(-x, -q[::-1], -p[::-1])) / 2
        u = 0.5 * math.erfc(-u / math.sqrt(2)) if strict else u
        out.append(np.interp(u, p, q))
    return np.array(out)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("zero_aware", [True, False])
@pytest.mark.parametrize("n", [30, 1500])
def test_quantile_alignment(spark, monkeypatch, zero_aware, strict, n):
    monkeypatch.setattr(normalize, "ROWS", 100)
    rng = np.random.default_rng(5)
    x = {s: np.round(np.where(rng.random((n, 3)) < 0.6, rng.gamma(2, 1 + k, (n, 3)), 0), 2) for k, s in enumerate("rt")}
    x["t"][:, 2] = 0
    x["t"][0, 2] = 1.5  # one positive value
    frame = lambda m: spark.createDataFrame([(int(c), f"f{f}", float(m[c, f])) for c in range(n) for f in range(3) if m[c, f] or f == 0], "cell_id long, feature_id string, value double")
    got = {(r["cell_id"], r["feature_id"]): r for r in normalize.align_quantiles(frame(x["r"]), frame(x["t"]), zero_aware, strict).collect()}
    for f in range(3):
        r, t = x["r"][:, f], x["t"][:, f]
        some = t > 0
        if zero_aware:
            want = np.where(some, t, 0.0)
            if some.sum() > 1:
                want[some] = carried(r[r > 0], t[some], strict)
        else:
            want = carried(r, t, strict)
        for c in range(n):
            if (c, f"f{f}") in got:
                assert abs(got[c, f"f{f}"]["value"] - want[c]) < 1e-8
                assert zero_aware or abs(got[c, f"f{f}"]["zero_value"] - carried(r, [0.0], strict)[0]) < 1e-9
            else:
                assert t[c] == 0
    assert len(got) == n + sum(int((x["t"][:, f] > 0).sum()) for f in (1, 2))


def test_lsi(spark):
    rng = np.random.default_rng(6)
    kinds = rng.gamma(0.5, 1, (4, 30))
    x = rng.poisson(kinds[np.arange(80) % 4] * rng.integers(2, 9, (80, 1))).astype(float)
    x[:, 0] += 1
    counts = spark.createDataFrame([(int(c), f"f{f:02d}", float(x[c, f])) for c, f in zip(*np.nonzero(x), strict=True)], "cell_id long, feature_id string, value double")
    used = x[:, x.sum(0) > 0]
    weight = np.log1p(1e4 * used / used.sum(1, keepdims=True)) * np.log1p(len(x) / used.sum(0))
    u, s, _ = np.linalg.svd(weight, full_matrices=False)
    got, deviation = embedding.lsi(counts, 4, rounds=30)
    assert np.allclose(deviation, s[1:4] / math.sqrt(len(x) - 1), rtol=1e-6)
    rows = np.array([r["lsi"] for r in got.orderBy("cell_id").collect()])
    want = (u[:, 1:4] - u[:, 1:4].mean(0)) / u[:, 1:4].std(0)
    assert np.allclose(np.abs((rows * want).mean(0)), 1, atol=1e-5) and np.allclose(rows.mean(0), 0, atol=1e-7) and np.allclose(rows.std(0), 1)


def test_tukey():
    assert [round(studentized_range_tail(*c), 3) for c in ((3.877, 3, 10), (3.958, 4, 20), (3.314, 3, math.inf), (2.772, 2, math.inf))] == [0.05] * 4
    y = np.array([1.0, 2, 3, 2, 5, 6, 7, 6, 2, 3, 1])
    got = stats.tukey(y, list("aaaabbbbccc"))
    assert [(g[0], g[1], g[4]) for g in got] == [("a", "b", True), ("a", "c", False), ("b", "c", True)] and abs(got[0][2] - 4) < 1e-12
    one = stats.two_way(y, list("aaaabbbbccc"), ["x"] * 11)
    assert set(one) == {"a"} and one["a"]["df"] == 2 and one["a"]["p"] < 0.01
    # Two groups: the range's tail is the two-sided t's, so the one-way p is Tukey's.
    assert abs(stats.tukey(y[:8], list("aaaabbbb"))[0][3] - stats.one_way(y[:8], list("aaaabbbb"))["a"]["p"]) < 1e-6


def test_effect_shares_of_two_factors_sum_to_one():
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 3, 40), rng.integers(0, 2, 40)
    y = a + rng.normal(size=40)
    out = stats.two_way(y, list(a), list(b))
    residual = out["a"]["ss"] / out["a"]["partial_eta_sq"] - out["a"]["ss"]
    assert abs(sum(t["ss"] for t in out.values()) + residual - out["a"]["ss"] / out["a"]["eta_sq"]) < 1e-9


def test_features_variable_in_most_batches(spark):
    rng = np.random.default_rng(8)
    x = rng.poisson(3, (90, 40)).astype(float) + 1
    x[::3, 5] *= 30
    x[:, 6] *= rng.integers(1, 40, 90)
    counts = spark.createDataFrame([(int(c), f"f{f}", float(x[c, f])) for c in range(90) for f in range(40)], "cell_id long, feature_id string, value double")
    batches = spark.createDataFrame([(c, "uvw"[c // 30]) for c in range(90)], "cell_id long, batch string")
    got = features.variable_by_batch(counts, batches, 6).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and len(got) == 6
    assert [(r["median_rank"], -r["batches"], r["feature_id"]) for r in got] == sorted((r["median_rank"], -r["batches"], r["feature_id"]) for r in got)
    ranks = {}
    for b in "uvw":
        own = counts.join(batches.where(F.col("batch") == b).select("cell_id"), "cell_id")
        for r in features.variable_by_standardised(own, 30, 6).collect():
            ranks.setdefault(r["feature_id"], []).append(r["rank"])
    assert all(r["median_rank"] == np.median(ranks[r["feature_id"]]) and r["batches"] == len(ranks[r["feature_id"]]) for r in got)


def test_small_joins_and_rules(spark, tmp_path):
    meta = spark.createDataFrame([("a ", 1), ("B", 2), ("c", 3)], "sample string, x int")
    time = spark.createDataFrame([("a", 0.5), ("B", 0.1), ("zz", 1.0)], "sample string, pseudotime double")
    assert sorted(tuple(r) for r in joins.with_pseudotime(meta, time).collect()) == [("B", 2, 0.1), ("a ", 1, 0.5)]
    reduced = spark.createDataFrame([("s1", 1.0), ("S2", 2.0)], "sample string, pc double")
    names = lambda *v: spark.createDataFrame([(x,) for x in v], "sample string")
    assert [tuple(r) for r in joins.match_samples(reduced, names("S2", "S1")).collect()] == [("S2", 2.0)]
    assert sorted(tuple(r) for r in joins.match_samples(reduced, names("s2", "S1")).collect()) == [("S1", 1.0), ("s2", 2.0)]
    assert [tuple(r) for r in joins.match_samples(reduced, names("q"), names("s1")).collect()] == [("s1", 1.0)]
    with pytest.raises(ValueError, match="no sample"):
        joins.match_samples(reduced, names("q"))
    assert qc.variable_columns(["age", "pseudotime", "pseudotime_x", "cluster_a_kmeans", "X_DR_1", "_k", "time"]) == ["age", "time"]
    rows = spark.createDataFrame([(str(i % 2), i % 4, float(i), "x" if i % 3 else "1", None if i % 9 else "2.5") for i in range(100)], "flag string, stage int, size double, word string, rare string")
    assert {r["column"]: r["kind"] for r in qc.data_types(rows, rows.columns).collect()} == {"flag": "categorical", "stage": "ordinal", "size": "numerical", "word": "categorical", "rare": "numerical"}
    units = spark.createDataFrame([(i, [float(i), float(i % 3), 9.0], None if i == 4 else float(i)) for i in range(9)], "unit long, v array<double>, age double")
    full = trajectory.cca_with_all(units, "unit", "v", "age").collect()
    assert len(full) == 9 and {r["unit"]: r["age"] for r in full}[4] == 4.0 and min(r["pseudotime"] for r in full) == 0


def test_gene_models_and_sinks(spark, tmp_path):
    lines = ["#!x", '1\thavana\tgene\t11\t20\t.\t+\t.\tgene_id "ENSG01.3"; gene_name "Abc"; gene_biotype "coding";', "1\th\texon\t11\t12\t.\t+\t.\tgene_id \"ENSG01.3\";", "chr2\th\tgene\t5\t9\t.\t-\t.\tID=gene:ENSG02;Name=Def;biotype=rna", "chrX\th\tgene\t1\t2\t.\t-\t.\tID=ENSG03"]
    (tmp_path / "g.gtf").write_text("\n".join(lines))
    got = sorted(tuple(r) for r in tables.read_gene_models(spark, str(tmp_path / "g.gtf")).collect())
    assert got == [("ENSG01", "Abc", "chr1", 10, 20, "+", "coding"), ("ENSG02", "Def", "chr2", 4, 9, "-", "rna"), ("ENSG03", "ENSG03", "chrX", 0, 2, "-", None)]
    df = spark.createDataFrame([(1, "a b", [1.0, 2.0]), (2, None, None)], "k int, s string, v array<double>")
    for kind, read in (("csv", lambda p: spark.read.csv(p, header=True)), ("tsv", lambda p: spark.read.csv(p, header=True, sep="\t")), ("json", spark.read.json), ("parquet", spark.read.parquet)):
        tables.write_table(df, str(tmp_path / f"t.{kind}"))
        back = sorted((int(r["k"]), r["s"]) for r in read(str(tmp_path / f"t.{kind}")).collect())
        assert back == [(1, "a b"), (2, None)]
    with pytest.raises(ValueError, match="written"):
        tables.write_table(df, str(tmp_path / "t.xyz"))


def test_sums_before_each_row(spark, monkeypatch):
    from tessella.operators import ordered

    rng = np.random.default_rng(9)
    rows = [(None if i % 50 == 0 else int(rng.integers(0, 300)), i, float(rng.integers(1, 9))) for i in range(2000)]
    df = spark.createDataFrame(rows, "x long, k long, v double").repartition(7)
    want, n, total = {}, 0, 0.0
    for _, k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want[k], n, total = (n, total), n + 1, total + v
    for whole in (10_000, 100):
        monkeypatch.setattr(ordered, "WHOLE", whole)
        monkeypatch.setattr(ordered, "ROWS", 70)
        got = ordered.before(ordered.before(df, "x", ["k"], "n"), "x", ["k"], "s", "v").collect()
        assert {r["k"]: (r["n"], r["s"]) for r in got} == want


def test_count_pca(spark):
    rng = np.random.default_rng(12)
    x = np.where(rng.random((70, 25)) < 0.5, rng.gamma(2, 1, (70, 25)) * np.linspace(1, 3, 25), 0)
    x[:, 3] += np.arange(70) / 5
    x[:, 0] += 0.1
    values = spark.createDataFrame([(int(c), f"f{f:02d}", float(x[c, f])) for c, f in zip(*np.nonzero(x), strict=True)], "cell_id long, feature_id string, value double")
    got = np.array([r["pc"] for r in embedding.count_pca(values, 3, rounds=40).orderBy("cell_id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for j in range(3):
        assert min(np.abs(got[:, j] - sign * u[:, j] * s[j]).max() for sign in (1, -1)) < 1e-5


def test_trend_by_its_definition(spark):
    from tessella.functions.special import f_tail

    rng = np.random.default_rng(13)
    t = np.sort(rng.random(30))
    y = np.sin(3 * t) + 0.1 * rng.normal(size=30) + 2
    values = spark.createDataFrame([(i, "f", float(v)) for i, v in enumerate(y)], "unit long, feature string, value double")
    got = trajectory.gam_trends(values, spark.createDataFrame([(i, float(v)) for i, v in enumerate(t)], "unit long, pseudotime double")).first()
    b = trajectory.spline_basis(t, 5, 3)
    d = np.array([[1, -2, 1, 0, 0], [0, 1, -2, 1, 0], [0, 0, 1, -2, 1]], float)
    hat = b @ np.linalg.solve(b.T @ b + 0.6 * d.T @ d, b.T)
    fitted, edof = hat @ y, np.trace(hat)
    rss, tss = ((y - fitted) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    f = ((tss - rss) / (edof - 1)) / (rss / (30 - edof))
    assert np.allclose([got["deviance"], got["p"], got["effect"]], [1 - rss / tss, f_tail(f, edof - 1, 30 - edof), np.ptp(fitted) / math.sqrt(rss / (30 - edof))], rtol=1e-6) and got["direction"] == ("UP" if fitted[-1] > fitted[0] else "DOWN")


def test_mixture_finds_its_parts():
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.normal(m, 0.3, (25, 2)) for m in ((0, 0), (4, 0), (0, 5))])
    found = trajectory.cluster_by_bic(x, 6)
    assert len(set(found)) == 3 and all(len(set(found[i : i + 25])) == 1 for i in (0, 25, 50))
    bic, label = trajectory.gaussian_mixture(x, 3)
    total = 0.0
    parts = [(x[label == j].mean(0), np.cov(x[label == j].T, ddof=0) + 1e-3 * np.eye(2), (label == j).mean()) for j in range(3)]
    for row in x:
        total += math.log(sum(w * math.exp(-0.5 * (row - m) @ np.linalg.solve(c, row - m)) / (2 * math.pi * math.sqrt(np.linalg.det(c))) for m, c, w in parts))
    assert abs(bic - (17 * math.log(75) - 2 * total)) < 0.5


def test_kmeans_is_settled(spark):
    from tessella.operators import clusters

    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(m, 0.2, (40, 3)) for m in ((0, 0, 0), (3, 0, 1), (0, 4, 2))])
    rows = clusters.kmeans(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding", 3).collect()
    name = next(c for c in rows[0].asDict() if c != "vec_id")
    label = np.array([r[name] for r in sorted(rows, key=lambda r: r["vec_id"])])
    centre = {c: x[label == c].mean(0) for c in set(label.tolist())}
    assert len(centre) == 3 and all(min(centre, key=lambda c: ((x[i] - centre[c]) ** 2).sum()) == label[i] for i in range(len(x)))


def test_designs(spark):
    from tessella.operators import differential

    rng = np.random.default_rng(16)
    samples = [(f"s{i:02d}", "ab"[i % 2], f"p{i // 2}", float(i // 3)) for i in range(16)]
    person = rng.normal(0, 5, 8)
    y = {(s, f): 3 + person[i // 2] + (1.5 * (f == 0) if i % 2 else 0) + 0.4 * v * (f == 1) + rng.normal(0, 0.1) for i, (s, _, _, v) in enumerate(samples) for f in range(30)}
    stats_ = spark.createDataFrame([(s, f"f{f}", float(m), 0.5, 40) for (s, f), m in y.items()], "sample string, feature_id string, mean double, variance double, n long")
    table = spark.createDataFrame(samples, "sample string, group string, individual string, value double")
    paired = {r["feature"]: r for r in differential.sample_test(stats_, table, "b", "a", "paired").collect()}
    one = {r["feature"]: r for r in differential.sample_test(stats_, table, "b", "a").collect()}
    for f in range(30):
        gaps = [y[samples[i + 1][0], f] - y[samples[i][0], f] for i in range(0, 16, 2)]
        assert abs(paired[f"f{f}"]["fold_change"] - np.mean(gaps)) < 1e-9 and abs(one[f"f{f}"]["fold_change"] - np.mean(gaps)) < 1e-9
    assert paired["f0"]["fdr"] < 0.05 < one["f0"]["p"] and min(paired[f"f{f}"]["p"] for f in range(2, 30)) > paired["f0"]["p"]
    slope = {r["feature"]: r["fold_change"] for r in differential.sample_test(stats_, table, kind="continuous").collect()}
    own = {r["feature"]: r["fold_change"] for r in differential.sample_test(stats_, table, kind="custom", custom={s: [1.0, v, float(i % 2)] for i, (s, _, _, v) in enumerate(samples)}, contrast=[0, 1, 0]).collect()}
    v = np.array([x[3] for x in samples])
    for f in range(30):
        m = np.array([y[x[0], f] for x in samples])
        assert abs(slope[f"f{f}"] - np.polyfit(v, m, 1)[0]) < 1e-9
        assert abs(own[f"f{f}"] - np.linalg.lstsq(np.stack([np.ones(16), v, np.arange(16) % 2], axis=1), m, rcond=None)[0][1]) < 1e-9
    with pytest.raises(ValueError, match="contrast"):
        differential.sample_test(stats_, table, kind="custom", custom={x[0]: [1.0, 1.0] for x in samples}, contrast=[1, -1])
    with pytest.raises(ValueError, match="design"):
        differential.sample_test(stats_, table, kind="other")
    found, failed = differential.pairwise_tests(stats_, table, permutations=10)
    assert found.count() == 30 and not failed


def test_pseudobulk_without_batches(spark):
    rng = np.random.default_rng(17)
    counts, cells = [], []
    for i in range(60):
        u = i % 6
        cells.append((i, f"u{u}", "tw"[i // 6 % 2], "xy"[u % 2]))
        counts += [(i, f"g{g}", float(rng.poisson(3 + 4 * (u % 2)) + 1)) for g in range(5)]
    counts, cells = spark.createDataFrame(counts, "cell_id long, feature_id string, value double"), spark.createDataFrame(cells, "cell_id long, unit string, celltype string, batch string")
    plain = {(r["unit"], r["feature"]): r["value"] for r in compose.pseudobulk_features(counts, cells, "unit", "celltype").collect()}
    got = {(r["unit"], r["feature"]): r["value"] for r in compose.pseudobulk_corrected(counts, cells, "unit", "celltype", "batch", None).collect()}
    side = {f"u{u}": u % 2 for u in range(6)}
    for f in {f for _, f in plain}:
        means = [np.mean([plain[u, f] for u in side if side[u] == b]) for b in (0, 1)]
        assert all(abs(got[u, f] - (plain[u, f] - means[side[u]] + np.mean(means))) < 1e-9 for u in side)
    few = compose.pseudobulk_corrected(counts, cells, "unit", "celltype", "batch", 2)
    assert few.count() == 2 * 2 * 6


def test_small_columns(spark):
    from tessella.functions import columns as C

    df = spark.createDataFrame([("s1:ACGTACGTACGTACGT-1", "x", 2), ("s2:ENCSR123ABC", None, 3), ("plain", "y", 4)], "id string, b string, n int")
    rows = df.select(C.sample_of(F.col("id")).alias("s"), C.barcode(F.col("id")).alias("c"), C.batch_key(F.col("b"), F.col("n")).alias("k")).collect()
    assert [tuple(r) for r in rows] == [("s1", "ACGTACGTACGTACGT", "x__2"), ("s2", "ENCSR123ABC", "3"), ("plain", None, "y__4")]
    assert tables.same_design(spark, '{"a": 1, "b": [2]}', '{"b": [2], "a": 1}') and not tables.same_design(spark, '{"a": 1}', '{"a": 2}')
    cells = spark.createDataFrame([(1, "u"), (2, "v")], "cell_id long, unit string")
    meta = spark.createDataFrame([(1, "m")], "cell_id long, age string")
    assert sorted((r["cell_id"], r["age"]) for r in joins.join_cell_metadata(cells, meta).collect()) == [(1, "m"), (2, None)]
    counts = spark.createDataFrame([(c, "f", 1.0) for c in range(10)], "cell_id long, feature_id string, value double")
    assert sorted(r["cell_id"] for r in tables.batches_of_rows(counts, counts.select("cell_id"), 3, 4).collect()) == [3, 4, 5, 6]
    trends = spark.createDataFrame([("a", 0.01, 2.0), ("b", 0.2, 9.0), ("c", 0.02, 5.0), ("d", 0.03, 0.5)], "feature string, fdr double, effect double")
    assert [r["feature"] for r in trajectory.select_trends(trends).collect()] == ["c", "a"] and [r["feature"] for r in trajectory.select_trends(trends, top=1).collect()] == ["c"]


def test_cell_types_of_any_number_of_cells(spark):
    """Beyond the bound of nodes the graph is one of groups; separated types come out the same."""
    from tessella.operators import clusters

    rng = np.random.default_rng(18)
    x = np.concatenate([rng.normal(m, 0.3, (60, 2)) for m in ((0, 0), (6, 0), (0, 7))])
    cells = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    links = neighbours.nearest(cells, cells, 6)
    for options in ({}, {"max_nodes": 50, "groups": 24}):
        found = {r["vec_id"]: r["celltype"] for r in clusters.cell_types(links, cells, "vec_id", "embedding", target=3, **options).collect()}
        assert len(found) == 180 and len(set(found.values())) == 3
        assert all(len({found[i] for i in range(k, k + 60)}) == 1 for k in (0, 60, 120))
