"""Functions on the driver against plain definitions."""

import itertools
import math

import numpy as np
import pytest

from tessella.functions import special
from tessella.functions.columns import block_weights
from tessella.operators import clusters, distance, embedding, features, normalize, stats, trajectory, tuning

RNG = np.random.default_rng(3)


def test_special_functions():
    assert special.t_tail(2.0, 10) == pytest.approx(0.0733880348, abs=1e-9)
    assert special.t_tail(1.96, math.inf) == pytest.approx(0.0499957902, abs=1e-9)
    assert special.f_tail(3.0, 2, 20) == pytest.approx((1 + 0.3) ** -10, rel=1e-9)
    assert special.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert special.digamma(1) == pytest.approx(-0.5772156649, abs=1e-9)
    assert special.trigamma(1) == pytest.approx(math.pi**2 / 6, abs=1e-9)
    assert special.inverse_trigamma(special.trigamma(3.7)) == pytest.approx(3.7, rel=1e-9)


def test_block_weights():
    assert [round(w, 2) for w in block_weights(15, 120, 300, 0.6)] == [4.47, 1.58, 1.0, 0.6]


def test_transport_is_least():
    for _ in range(20):
        n = 4
        p, q = RNG.dirichlet(np.ones(n)), np.full(n, 1 / n)
        cost = RNG.random((n, n))
        best = distance.transport(p, q, cost)
        # On units of 1/m of mass the problem is an assignment.
        m = 12
        counts = np.floor(p * m).astype(int)
        counts[0] += m - counts.sum()
        rows = np.repeat(np.arange(n), counts)
        cols = np.repeat(np.arange(n), m // n)
        exact = sum(cost[rows[i], cols[j]] for i, j in clusters.assignment(cost[np.ix_(rows, cols)])) / m
        assert distance.transport(counts / m, q, cost) == pytest.approx(exact, abs=1e-9)
        assert 0 <= best <= cost.max()


def test_assignment_against_all_permutations():
    for shape in ((4, 4), (3, 5), (5, 3)):
        cost = RNG.random(shape)
        n = min(shape)
        best = min(sum(cost[i, j] for i, j in zip(rows, cols, strict=True)) for rows in itertools.permutations(range(shape[0]), n) for cols in itertools.combinations(range(shape[1]), n))
        assert sum(cost[i, j] for i, j in clusters.assignment(cost)) == pytest.approx(best)


def test_mds_gives_the_distances_back():
    x = RNG.random((8, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    y = distance.classical_mds(d, 2)
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)), d)


def test_harmony_brings_batches_together():
    x = RNG.normal(size=(60, 4))
    batch = [i % 2 for i in range(60)]
    x[np.array(batch) == 1] += 3
    z = embedding.harmony(x, batch)
    gap = lambda m: np.linalg.norm(m[np.array(batch) == 1].mean(0) - m[np.array(batch) == 0].mean(0))
    assert gap(z) < 0.5 * gap(x)
    assert (embedding.harmony(x, [0] * 60) == x).all()
    assert embedding.composite_batches(["a", "a"], [1, 2]) == ["a", "a"] and embedding.composite_batches(["a", "a", "a"], [1, 2, 2]) == ["a__1", "a__2", "a__2"]


def test_leiden_finds_cliques():
    groups = [range(i, i + 6) for i in (0, 6, 12)]
    edges = [(a, b, 1.0) for g in groups for a in g for b in g if a < b] + [(0, 6, 1.0), (6, 12, 1.0)]
    found = clusters.leiden(18, edges)
    assert len(set(found)) == 3 and all(len({found[i] for i in g}) == 1 for g in groups)
    assert clusters.average_linkage(np.array([[0.0], [0.1], [5.0], [5.1]]), 2).tolist() == [1, 1, 2, 2]


def test_canonical_correlation_and_order():
    x = RNG.normal(size=(50, 3))
    y = x @ np.array([1.0, -2.0, 0.0])
    assert trajectory.canonical_correlation(x, y)[0] == pytest.approx(1)
    assert trajectory.best_pair(x, y)[1] == (0, 1)


def test_tree_and_path():
    d = np.abs(np.subtract.outer(np.arange(5.0), np.arange(5.0)))
    edges = trajectory.minimum_tree(d)
    assert sorted(tuple(sorted(e)) for e in edges) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert trajectory.principal_path([*edges, (2, 5)], {}) == [0, 1, 2, 3, 4]


def test_spline_basis_sums_to_one():
    assert np.allclose(trajectory.spline_basis(np.linspace(0, 1, 40), 8, 3).sum(1), 1)


def test_variances_shrink_to_the_prior():
    s2 = RNG.chisquare(4, 500) / 4
    out, prior, scale = stats.squeeze_variances(s2, 4)
    assert out.var() < s2.var() and prior > 4 and 0.5 < scale < 1.5


def test_two_way_and_removal():
    a, b = ["x", "y"] * 20, ["p", "p", "q", "q"] * 10
    y = np.array([3.0 * (v == "y") for v in a]) + RNG.normal(size=40) * 0.1
    found = stats.two_way(y, a, b)
    assert found["a"]["p"] < 1e-6 < found["b"]["p"] and found["a"]["eta_sq"] > 0.9
    m = np.stack([y, y + 1], axis=1)
    batch = np.array([[v == "q"] for v in b], float)
    clean = stats.remove_effects(m + 5 * batch, np.ones((40, 1)), batch)
    assert abs(clean[batch[:, 0] == 1].mean() - clean[batch[:, 0] == 0].mean()) < 0.5
    combat = stats.combat(RNG.normal(size=(40, 30)) + 4 * batch, b)
    assert abs(combat[batch[:, 0] == 1].mean() - combat[batch[:, 0] == 0].mean()) < 0.3
    assert stats.permutation_p(np.arange(20.0), np.arange(20.0), lambda u, v: float(np.corrcoef(u, v)[0, 1]), 99, 1) == pytest.approx(0.01)


def test_searches_find_the_peak():
    f = lambda a: -((a - 1.3) ** 2)
    for name, search in tuning.SEARCHES.items():
        assert search(f, 0.0, 3.0)[1] == pytest.approx(1.3, abs=0.15), name
    blocks = [RNG.normal(size=(30, 4)), RNG.normal(size=(30, 6))]
    assert set(tuning.ablations(blocks, [1.0, 1.0], [i % 2 for i in range(30)])) == {"composition", "displacement", "none", "linear", "harmony"}
    for name in tuning.SCORERS:
        y = list(range(30)) if name in ("cca", "knn_error", "spearman") else ["a", "b"] * 15
        assert math.isfinite(tuning.SCORERS[name](blocks[0], y))


def test_local_fit_follows_a_parabola():
    x = np.linspace(0, 1, 50)
    assert np.allclose(features.local_fit(x, x * x, 0.4), x * x, atol=1e-8)


def test_aligned_features_against_dense(spark):
    dense = RNG.integers(0, 4, (12, 5)).astype(float)
    dense[:, 3], dense[:, 4] = 2.0, 0.0  # constant; never stored
    stored = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(12) for j in range(5) if dense[i, j]], "cell_id long, feature_id long, value double")

    def ranks(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x]) / len(x)

    whole = {
        "zscore": lambda x: (x - x.mean()) / (x.std(ddof=1) or 1.0),
        "minmax": lambda x: (x - x.min()) / ((x.max() - x.min()) or 1.0),
        "rank": ranks,
    }
    for method, f in whole.items():
        rows = normalize.align_features(stored, 12, method).collect()
        assert len(rows) == int((dense > 0).sum())
        for r in rows:
            want = f(dense[:, r["feature_id"]])
            assert r["value"] == pytest.approx(want[r["cell_id"]], abs=1e-9)
            for i in np.flatnonzero(dense[:, r["feature_id"]] == 0):
                assert r["zero_value"] == pytest.approx(want[i], abs=1e-9)
    with pytest.raises(ValueError):
        normalize.align_features(stored, 12, "other")


def test_random_partners(spark):
    entities = spark.range(300).withColumnRenamed("id", "e").union(spark.range(300))
    rows = stats.random_partners(entities, "e", 3, per_bucket=40).collect()
    for k in range(3):
        mine = [(r["e"], r["partner"]) for r in rows if r["round"] == k]
        assert all(a != b for a, b in mine) and len({a for a, _ in mine}) == len({b for _, b in mine}) == len(mine) > 290
    assert sorted(map(tuple, stats.random_partners(entities, "e", 3, per_bucket=40).collect())) == sorted(map(tuple, rows))


def test_pair_baseline_tells_pairs_from_chance(spark):
    x = RNG.random((40, 30))
    side = lambda noise: spark.createDataFrame([(i, j, float(x[i, j] + noise * RNG.random())) for i in range(40) for j in range(30)], "e long, f long, value double")
    got = {r["round"]: r["mean_r"] for r in stats.pair_baseline(side(0.2), side(0.2), "e", "f").collect()}
    assert sorted(got) == [-1, 0, 1, 2, 3, 4] and got[-1] > 0.8 and all(abs(got[k]) < 0.3 for k in range(5))
