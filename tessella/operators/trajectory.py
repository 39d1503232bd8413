"""Pseudotime: canonical axes, cluster trees, orderings, trends. Inputs are unit-sized; per-feature fits run as grouped Arrow functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import f_tail
from .ordered import before


def rank_pseudotime(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, pseudotime = i / (n - 1) in order, ties by key."""
    n = rows.count()
    ranked = before(rows.select(key, order), order, [key], "__i")
    return ranked.select(key, (F.col("__i") / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)).alias("pseudotime"))


def path_pseudotime(rows: DataFrame, key: str, order: str, coordinates: list[str]) -> DataFrame:
    """key, pseudotime: the length of the path through the ordered points so far, over the whole length."""
    placed = before(rows.select(key, order, *coordinates), order, [key], "__i")
    last = placed.select((F.col("__i") + 1).alias("__j"), *[F.col(c).alias(f"__{c}") for c in coordinates])
    step = F.sqrt(sum((F.pow(F.col(c) - F.col(f"__{c}"), 2) for c in coordinates), F.lit(0.0)))
    steps = placed.join(last, F.col("__i") == F.col("__j"), "left").select(key, "__i", F.coalesce(step, F.lit(0.0)).alias("__d"))
    total = steps.agg(F.sum("__d")).first()[0] or 0.0
    run = before(steps, "__i", [], "__s", "__d")
    return run.select(key, ((F.col("__s") + F.col("__d")) / F.lit(total) if total > 0 else F.lit(0.0)).alias("pseudotime"))


def min_max(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column brought to 0..1; constants become 0.5."""
    ends = rows.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    lo, hi = (lambda c: F.col(f"__lo_{c}")), (lambda c: F.col(f"__hi_{c}"))
    return rows.join(F.broadcast(ends)).select(*[c for c in rows.columns if c not in columns], *[F.when(hi(c) > lo(c), (F.col(c) - lo(c)) / (hi(c) - lo(c))).otherwise(0.5).alias(c) for c in columns])


def z_scores(rows: DataFrame, feature: str, value: str) -> DataFrame:
    w = Window.partitionBy(feature)
    sd = F.stddev_pop(value).over(w)
    return rows.withColumn("z", F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0))


def temporal_order(rows: DataFrame, group: str, time: str, value: str = "z") -> DataFrame:
    """group, peak, rank: groups (such as clusters of features) by the time at which their mean value is highest (to 9 decimals), the first of equal ones."""
    means = rows.groupBy(group, time).agg(F.avg(value).alias("__m"))
    peak = means.groupBy(group).agg(F.min_by(time, F.struct(-F.round("__m", 9), F.col(time))).alias("peak"))
    return peak.withColumn("rank", F.row_number().over(Window.orderBy("peak", group)))


def quantile_bins(rows: DataFrame, value: str, q: int = 4) -> DataFrame:
    """bin (from 0): right-closed between the distinct quantiles; the least value is in the first."""
    cuts = rows.agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / q) for i in range(q + 1)]))).alias("__cuts"))
    inner = F.slice("__cuts", 2, F.greatest(F.size("__cuts") - 2, F.lit(0)))
    return rows.join(F.broadcast(cuts)).withColumn("bin", F.size(F.filter(inner, lambda c: c < F.col(value)))).drop("__cuts")


def order_score(rows: DataFrame, position: str, value: str) -> DataFrame:
    """One row: sum over i < j of (s_j - s_i), over the same for the sorted values; closed form sum s_i (2 i - n + 1)."""
    n = F.lit(rows.count())
    ranked = before(before(rows.select(position, value), position, [], "__i"), value, [position], "__k")
    s = ranked.agg(F.sum(F.col(value) * (2 * F.col("__i") - n + 1)).alias("seen"), F.sum(F.col(value) * (2 * F.col("__k") - n + 1)).alias("best"))
    return s.select(F.when(F.col("best") > 0, F.col("seen") / F.col("best")).alias("score"))


def extremes(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n lowest and n highest rows, with side."""
    low, high = rows.orderBy(value, key).limit(n), rows.orderBy(F.desc(value), key).limit(n)
    return low.withColumn("side", F.lit("low")).unionByName(high.withColumn("side", F.lit("high")))


def canonical_correlation(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """With one target: the root of R^2, and unit-length weights on standardised x."""
    sd = x.std(0, ddof=1)
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    t = (y - y.mean()) / (y.std(ddof=1) or 1)
    beta, *_ = np.linalg.lstsq(z, t, rcond=None)
    fitted = z @ beta
    r = float(np.corrcoef(fitted, t)[0, 1]) if fitted.std() > 0 else 0.0
    return abs(r), beta / (np.linalg.norm(beta) or 1)


def best_pair(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[int, int]]:
    """The two columns with the largest canonical correlation; ties to the first."""
    scored = [(canonical_correlation(x[:, [i, j]], y)[0], (i, j)) for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])]
    return max(scored, key=lambda s: (round(s[0], 12), (-s[1][0], -s[1][1])))


def cca_pseudotime(units: DataFrame, key: str, vector: str, target: str) -> DataFrame:
    """key, score, pseudotime: raw coordinates of the best pair of axes times their weights, brought to 0..1. Units without a target are left out."""
    rows = units.where(F.col(target).isNotNull()).orderBy(key).select(key, vector, F.col(target).cast("double")).collect()
    x, y = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    score, _ = canonical_correlation(x, y)
    _, pair = best_pair(x, y) if x.shape[1] > 1 else (score, (0, 0))
    own = x[:, list(dict.fromkeys(pair))]
    along = own @ canonical_correlation(own, y)[1]
    along = (along - along.min()) / (np.ptp(along) or 1)
    return units.sparkSession.createDataFrame([(r[0], score, float(a)) for r, a in zip(rows, along, strict=True)], [key, "score", "pseudotime"])


def cca_with_all(units: DataFrame, key: str, vector: str, target: str) -> DataFrame:
    """key, target (the mean of the known ones where it is null), score, pseudotime along the first two coordinates: no unit is left out."""
    value = F.col(target).cast("double")
    mean = units.agg(F.avg(value).alias("__mean"))
    filled = units.join(F.broadcast(mean)).select(key, F.slice(vector, 1, 2).alias(vector), F.coalesce(value, "__mean").alias(target))
    return filled.select(key, target).join(cca_pseudotime(filled, key, vector, target), key)


def cca_permutation(units: DataFrame, key: str, vector: str, target: str, rounds: int = 200, seed: int = 42) -> tuple[float, float]:
    """The score, and the share of shuffles of the target that reach it (no + 1)."""
    from .stats import permutation_p

    rows = units.where(F.col(target).isNotNull()).orderBy(key).select(vector, F.col(target).cast("double")).collect()
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    score = lambda a, b: canonical_correlation(a, b)[0]
    return score(x, y), permutation_p(x, y, score, rounds, seed, plus_one=False)


def minimum_tree(d: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the minimum spanning tree, by growing from node 0."""
    inside, edges = {0}, []
    while len(inside) < len(d):
        _, i, j = min((d[i, j], i, j) for i in inside for j in range(len(d)) if j not in inside)
        edges.append((i, j))
        inside.add(j)
    return edges


def principal_path(edges: list[tuple[int, int]], sizes: dict[int, int]) -> list[int]:
    """The leaf-to-leaf path with most nodes, then most members, then least labels."""
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    if not near:
        return [0]

    def to(a, b, seen=()):
        if a == b:
            return [a]
        for n in near[a]:
            if n not in seen and (rest := to(n, b, (*seen, a))):
                return [a, *rest]
        return []

    leaves = sorted(n for n in near if len(near[n]) == 1)
    paths = [to(a, b) for i, a in enumerate(leaves) for b in leaves[i + 1 :]]
    return min(paths, key=lambda p: (-len(p), -sum(sizes.get(n, 0) for n in p), p))


def project_on_path(x: np.ndarray, cluster: np.ndarray, path: list[int], edges: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """(row, edge of the path, raw projection): end clusters go to their edge, inner ones to the edge of the nearest tree neighbour; rows whose
    nearest neighbour is off the path are left out."""
    centre = {c: x[cluster == c].mean(0) for c in set(cluster.tolist())}
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out = []
    for i, c in enumerate(cluster.tolist()):
        if c not in path or len(path) < 2:
            continue
        at = path.index(c)
        if at in (0, len(path) - 1):
            edge = min(at, len(path) - 2)
        else:
            to = min(sorted(near[c]), key=lambda n: float(((x[i] - centre[n]) ** 2).sum()))
            if to not in (path[at - 1], path[at + 1]):
                continue
            edge = at - 1 if to == path[at - 1] else at
        direction = centre[path[edge + 1]] - centre[path[edge]]
        out.append((i, edge, float(x[i] @ direction / (np.linalg.norm(direction) or 1))))
    return out


def gaussian_mixture(x: np.ndarray, k: int, restarts: int = 10, ridge: float = 1e-3, seed: int = 42, rounds: int = 200) -> tuple[float, np.ndarray]:
    """BIC and labels of a full-covariance mixture; the best of several starts."""
    n, d = x.shape
    best = (math.inf, np.zeros(n, int))
    for turn in range(restarts):
        rng = np.random.default_rng(seed + turn)
        mean = x[rng.choice(n, k, replace=False)]
        cov = np.array([np.cov(x.T, ddof=0).reshape(d, d) + ridge * np.eye(d)] * k)
        share, last = np.full(k, 1 / k), -math.inf
        for _ in range(rounds):
            logs = []
            for j in range(k):
                c = np.linalg.cholesky(cov[j])
                y = np.linalg.solve(c, (x - mean[j]).T)
                logs.append(math.log(max(share[j], 1e-300)) - 0.5 * (y**2).sum(0) - np.log(np.diag(c)).sum() - 0.5 * d * math.log(2 * math.pi))
            logs = np.array(logs).T
            top = logs.max(1)
            total = top + np.log(np.exp(logs - top[:, None]).sum(1))
            r = np.exp(logs - total[:, None])
            if total.sum() - last < 1e-6 * n:
                break
            last, w = total.sum(), r.sum(0) + 1e-10
            share, mean = w / n, (r.T @ x) / w[:, None]
            cov = np.array([((x - mean[j]).T * r[:, j]) @ (x - mean[j]) / w[j] + ridge * np.eye(d) for j in range(k)])
        bic = (k - 1 + k * d + k * d * (d + 1) / 2) * math.log(n) - 2 * total.sum()
        if bic < best[0]:
            best = (bic, r.argmax(1))
    return best


def cluster_by_bic(x: np.ndarray, most: int = 20, seed: int = 42, restarts: int = 5) -> np.ndarray:
    """Labels of the mixture with the least BIC over k = 2..min(most, n // 2)."""
    tried = [gaussian_mixture(x, k, restarts, seed=seed + 1) for k in range(2, max(3, min(most, len(x) // 2) + 1))]
    return min(tried, key=lambda t: t[0])[1]


def tree_pseudotime(units: DataFrame, key: str, vector: str, target: str | None = None, most: int = 20, seed: int = 42) -> DataFrame:
    """key, cluster, edge, pseudotime: mixture clusters, their spanning tree, its principal path from the end with the lower mean target.

    If all units fall into one cluster, its tree has no edge: each unit has a row, without an edge and a pseudotime.
    """
    columns = [key, vector] + ([target] if target else [])
    rows = units.orderBy(key).select(*columns).collect()
    x = np.array([r[1] for r in rows], float)
    raw = cluster_by_bic(x, most, seed)
    cluster = np.searchsorted(np.unique(raw), raw)
    n = int(cluster.max()) + 1
    schema = f"{key} {dict(units.dtypes)[key]}, cluster long, edge long, pseudotime double"
    if n < 2:
        return units.sparkSession.createDataFrame([(r[0], 0, None, None) for r in rows], schema)
    centre = np.array([x[cluster == c].mean(0) for c in range(n)])
    edges = minimum_tree(np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2)))
    path = principal_path(edges, {c: int((cluster == c).sum()) for c in range(n)})
    if target and len(path) > 1:
        means = [np.mean([float(r[2]) for r, c in zip(rows, cluster, strict=True) if c == e and r[2] is not None] or [math.inf]) for e in (path[0], path[-1])]
        if means[1] < means[0]:
            path = path[::-1]
    # By the clusters along the path, inside a cluster by its two edges, inside an edge by the projection.
    placed = sorted(project_on_path(x, cluster, path, edges), key=lambda p: (path.index(cluster[p[0]]), p[1], p[2], p[0]))
    return units.sparkSession.createDataFrame([(rows[i][0], int(cluster[i]), int(e), k / max(1, len(placed) - 1)) for k, (i, e, _) in enumerate(placed)], schema)


def spline_basis(x: np.ndarray, splines: int, order: int) -> np.ndarray:
    """B-splines on an even grid over the range of x."""
    lo, hi = x.min(), x.max()
    step = (hi - lo or 1) / (splines - order)
    knots = lo + step * np.arange(-order, splines + 1)
    b = ((x[:, None] >= knots[None, :-1]) & (x[:, None] < knots[None, 1:])).astype(float)
    b[x >= hi, splines - 1] = 1
    b[x >= hi, splines:] = 0
    for k in range(1, order + 1):
        left = (x[:, None] - knots[None, : -k - 1]) / (k * step)
        right = (knots[None, k + 1 :] - x[:, None]) / (k * step)
        b = left * b[:, :-1] + right * b[:, 1:]
    return b[:, :splines]


def spline_size(n: int, splines: int = 5, order: int = 3) -> tuple[int, int]:
    """Number and order of the splines for n points: lower orders up to 5 points, about two points a spline, always more splines than their order."""
    if n <= order:
        most, order = min(2, max(1, n - 2)), 1
    elif n < 6:
        most, order = max(2, n - 3), 2
    elif n < 10:
        order = min(3, order)
        most = max(2, (n - order - 1) // 2)
    else:
        most = min(max(2, n - order - 4), max(2, n // 2))
    return max(2, min(splines, most), order + 1), order


def gam_trends(values: DataFrame, pseudotime: DataFrame, splines: int = 5, order: int = 3, penalty: float = 0.6) -> DataFrame:
    """feature, n, p, deviance, effect, direction, fdr: a penalised spline of value over pseudotime per feature, where the value isn't 0.

    values: unit, feature, value. Features with too few points are left out. effect: range of the fit over the residual scale.
    """

    from .stats import benjamini_hochberg

    def fit(key, frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["value"] != 0]
        k, o = spline_size(len(own), splines, order)
        empty = pd.DataFrame({"feature": [], "n": [], "p": [], "deviance": [], "effect": [], "direction": []})
        if len(own) < o + k + 2 or own["pseudotime"].nunique() < 3:
            return empty
        x, y = own["pseudotime"].to_numpy(float), own["value"].to_numpy(float)
        b = spline_basis(x, k, o)
        d = np.diff(np.eye(k), n=2, axis=0)
        inverse = np.linalg.pinv(b.T @ b + penalty * d.T @ d)
        hat = b @ inverse @ b.T
        fitted, edof = hat @ y, float(np.trace(hat))
        rss, tss, left = float(((y - fitted) ** 2).sum()), float(((y - y.mean()) ** 2).sum()), max(1e-9, len(y) - edof)
        if tss <= 0:
            return empty
        f = max(0.0, (tss - rss) / max(1e-9, edof - 1)) / max(rss / left, 1e-300)
        line = np.argsort(x, kind="stable")
        return pd.DataFrame({"feature": [key[0]], "n": [len(y)], "p": [f_tail(f, max(1e-9, edof - 1), left)], "deviance": [1 - rss / tss], "effect": [float(np.ptp(fitted)) / max(math.sqrt(rss / left), 1e-12)], "direction": ["UP" if fitted[line[-1]] > fitted[line[0]] else "DOWN"]})

    met = values.join(pseudotime, "unit").select("feature", F.col("value").cast("double"), F.col("pseudotime").cast("double"))
    out = met.groupBy("feature").applyInPandas(fit, "feature string, n long, p double, deviance double, effect double, direction string")
    return benjamini_hochberg(out, "p", "feature")


def select_trends(trends: DataFrame, fdr: float = 0.05, effect: float = 1.0, top: int | None = None) -> DataFrame:
    kept = trends.where((F.col("fdr") < fdr) & (F.col("effect") > effect)).orderBy(F.desc("effect"), "feature")
    return kept.limit(top) if top else kept


def proportion_trends(composition: DataFrame, pseudotime: DataFrame) -> DataFrame:
    """celltype, r with pseudotime, rank by its size."""
    r = composition.join(pseudotime, "unit").groupBy("celltype").agg(F.corr("proportion", "pseudotime").alias("r"))
    return r.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "celltype")))
