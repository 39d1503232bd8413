"""What only tables beyond a bound, or larger samples of them, bring about."""

import numpy as np

from tessella.operators import embedding, features, ordered, stats, trajectory


def test_spearman_beyond_one_window(spark, monkeypatch):
    """More distinct values than one window may hold."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 400, 900), rng.integers(0, 300, 900)
    rows = spark.createDataFrame([(float(a), float(a // 2 + b)) for a, b in zip(x, y, strict=True)], "x double, y double").repartition(5)
    want = stats.spearman(rows, "x", "y").first()
    monkeypatch.setattr(ordered, "WHOLE", 100)
    monkeypatch.setattr(ordered, "ROWS", 70)
    got = stats.spearman(rows, "x", "y").first()
    assert got["n"] == want["n"] == 900 and abs(got["rho"] - want["rho"]) < 1e-12


def test_tree_of_one_cluster(spark, monkeypatch):
    monkeypatch.setattr(trajectory, "cluster_by_bic", lambda x, *a: np.full(len(x), 3))
    units = spark.createDataFrame([(k, [float(k), 0.0], float(k)) for k in range(6)], "unit long, pc array<double>, y double")
    rows = trajectory.tree_pseudotime(units, "unit", "pc", "y").collect()
    assert [tuple(r) for r in rows] == [(k, 0, None, None) for k in range(6)]


def test_dispersions_of_bins_of_two_tie(spark):
    """In exact arithmetic both features of a bin of two lie 1 / sqrt(2) from its mean, so names decide between bins."""
    rng = np.random.default_rng(3)
    rows = [(f"g{7 * (2 * k + j) % 40:02d}", float(np.expm1(1 + (k + 0.3 + 0.4 * j) / 20)), float(rng.uniform(1, 9))) for k in range(20) for j in (0, 1)]
    means = spark.createDataFrame(rows, "feature_id string, mean double, variance double").repartition(3)
    got = [(r["rank"], r["feature_id"]) for r in features.variable_by_dispersion(means, 20).orderBy("rank").collect()]
    larger = [max(rows[2 * k : 2 * k + 2], key=lambda r: r[2] / r[1])[0] for k in range(20)]
    assert got == list(enumerate(sorted(larger), 1))


def test_soft_composition_by_its_definition(spark):
    """The exact median of an even number of distances, gaps, a vector that is an anchor, far from the origin; no plan holds a list of all distances."""
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(61, 6)) + 1e4, rng.normal(size=(4, 6)) + 1e4
    x[7] = c[2]
    rows = [(i, None if i % 9 == 0 else f"u{i % 4}", [float(v) for v in row]) for i, row in enumerate(x)] + [(100, "u1", None), (101, "u1", [1.0] * 5 + [None]), (102, "u9", None)]
    cells = spark.createDataFrame(rows, "id long, unit string, v array<double>").repartition(5)
    anchors = spark.createDataFrame([(f"a{i}", [float(v) for v in row]) for i, row in enumerate(c)], "anchor string, c array<double>")
    d2 = ((x[:, None] - c[None]) ** 2).sum(2)
    for sigma in (None, 0.7):
        e = np.exp(-(d2 - d2.min(1, keepdims=True)) / (2 * (sigma or np.median(np.sqrt(d2))) ** 2))
        share = e / e.sum(1, keepdims=True)
        made = embedding.soft_composition(cells, anchors, "unit", "v", "id", sigma)
        got = {(r["unit"], r["anchor"]): r["share"] for r in made.collect()}
        assert len(got) == 6 * 4 and all(got["u9", f"a{j}"] is None for j in range(4))
        for u in (None, "u0", "u1", "u2", "u3"):
            of = [i for i in range(61) if rows[i][1] == u]
            assert all(abs(got[u, f"a{j}"] - share[of, j].mean()) < 1e-9 for j in range(4))
        assert "percentile" not in made._jdf.queryExecution().toString()


def test_anchors_are_centres_of_their_cells(spark):
    """Lloyd's rounds by plain arithmetic from the same seeds; copies don't take the seeds."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(i * 3, 1, (40, 3)) for i in range(5)] + [np.zeros((300, 3))])
    cells = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None)], "id long, v array<double>").repartition(5)
    got = np.array([r["c"] for r in embedding.kmeans_anchors(cells, "v", 6, iterations=200).orderBy("anchor").collect()])
    nearest = ((x[:, None] - got[None]) ** 2).sum(2).argmin(1)
    assert len(got) == 6 and all(np.abs(x[nearest == j].mean(0) - got[j]).max() < 1e-3 for j in range(6))
    assert embedding.kmeans_anchors(cells.where("id >= 200"), "v", 6).count() == 1
