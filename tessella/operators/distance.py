"""Distances between units, in long form (a < b), scaled to a largest of 1. Units are few; features may be many."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _zip(f) -> Column:
    return F.aggregate(F.zip_with("va", "vb", f), F.lit(0.0), lambda s, x: s + x)


def _metric(name: str, p: float = 2.0) -> Column:
    n = F.size("va")
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    square = lambda a, b: _zip(lambda x, y: (x - y) * (x - y))
    dot = _zip(lambda x, y: x * y)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    gap = _zip(lambda x, y: F.abs(x - y))
    either = _zip(lambda x, y: ((x != 0) | (y != 0)).cast("double"))
    differ = _zip(lambda x, y: (x != y).cast("double"))
    ma, mb = mean(F.col("va")), mean(F.col("vb"))
    covariance = dot / n - ma * mb
    spread = lambda v, m: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / n - m * m
    return {
        "euclidean": F.sqrt(square(None, None)),
        "sqeuclidean": square(None, None),
        "minkowski": F.pow(_zip(lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(1 / p)),
        "cityblock": gap,
        "chebyshev": F.array_max(F.zip_with("va", "vb", lambda x, y: F.abs(x - y))),
        "cosine": 1 - dot / (norm(F.col("va")) * norm(F.col("vb"))),
        "correlation": 1 - covariance / F.sqrt(spread(F.col("va"), ma) * spread(F.col("vb"), mb)),
        "hamming": differ / n,
        "matching": differ / n,
        "jaccard": differ / either,
        "canberra": _zip(lambda x, y: F.when((x == 0) & (y == 0), 0.0).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y)))),
        "braycurtis": gap / _zip(lambda x, y: F.abs(x + y)),
    }[name]


METRICS = ("euclidean", "sqeuclidean", "minkowski", "cityblock", "chebyshev", "cosine", "correlation", "hamming", "matching", "jaccard", "canberra", "braycurtis")


def scale_to_one(pairs: DataFrame) -> DataFrame:
    """NaN and null become 0, then the largest becomes 1; the largest is a one-row aggregate, not a global window."""
    clean = pairs.withColumn("distance", F.nanvl(F.coalesce("distance", F.lit(0.0)), F.lit(0.0)))
    most = clean.agg(F.max("distance").alias("__most"))
    return clean.join(F.broadcast(most)).select("a", "b", F.when(F.col("__most") > 0, F.col("distance") / F.col("__most")).otherwise(F.col("distance")).alias("distance"))


def pairwise(units: DataFrame, metric: str, scaled: bool = True, p: float = 2.0) -> DataFrame:
    """units: unit, v (array<double>)."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; known: {', '.join(METRICS)}")
    right = units.select(F.col("unit").alias("b"), F.col("v").alias("vb"))
    pairs = units.select(F.col("unit").alias("a"), F.col("v").alias("va")).join(right, F.col("a") < F.col("b")).select("a", "b", _metric(metric, p).alias("distance"))
    return scale_to_one(pairs) if scaled else pairs


def _by_type(composition: DataFrame) -> DataFrame:
    right = composition.select(F.col("unit").alias("b"), "celltype", F.col("proportion").alias("q"))
    return composition.select(F.col("unit").alias("a"), "celltype", F.col("proportion").alias("p")).join(right, "celltype").where("a < b")


def chi_square(composition: DataFrame) -> DataFrame:
    """Half the sum of (p - q)^2 / (p + q), exact zeros replaced by 1e-10."""
    some = lambda c: F.when(F.col(c) == 0, 1e-10).otherwise(F.col(c))
    term = F.pow(some("p") - some("q"), 2) / (some("p") + some("q"))
    return scale_to_one(_by_type(composition).groupBy("a", "b").agg((F.lit(0.5) * F.sum(term)).alias("distance")))


def jensen_shannon(composition: DataFrame) -> DataFrame:
    """Root of the divergence to base 2."""
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return scale_to_one(_by_type(composition).groupBy("a", "b").agg(F.sqrt(F.greatest(F.lit(0.0), (F.sum(part("p")) + F.sum(part("q"))) / 2)).alias("distance")))


def transport(p: np.ndarray, q: np.ndarray, cost: np.ndarray) -> float:
    """The least cost of moving p to q: successive shortest paths on the bipartite residual graph, with potentials."""
    p, q = p / p.sum(), q / q.sum()
    n, m = len(p), len(q)
    supply, demand, flow = p.copy(), q.copy(), np.zeros((n, m))
    u, v = np.zeros(n), np.zeros(m)
    while supply.max() > 1e-12:
        du, dv = np.where(supply > 1e-12, 0.0, np.inf), np.full(m, np.inf)
        from_v, from_u, done_u, done_v = np.full(n, -1), np.full(m, -1), np.zeros(n, bool), np.zeros(m, bool)
        while True:
            a, b = np.where(done_u, np.inf, du), np.where(done_v, np.inf, dv)
            i, j = int(a.argmin()), int(b.argmin())
            if min(a[i], b[j]) == np.inf:
                break
            if a[i] <= b[j]:
                done_u[i] = True
                to = du[i] + np.maximum(0.0, cost[i] + u[i] - v)
                better = (to < dv - 1e-15) & ~done_v
                dv[better], from_u[better] = to[better], i
            else:
                done_v[j] = True
                if demand[j] > 1e-12:
                    break
                back = (flow[:, j] > 1e-15) & ~done_u
                to = dv[j] + np.maximum(0.0, -(cost[:, j] + u - v[j]))
                better = back & (to < du - 1e-15)
                du[better], from_v[better] = to[better], j
        end = j
        if demand[end] <= 1e-12 or dv[end] == np.inf:
            break
        reach = dv[end]
        path, at = [], end
        while True:
            i = from_u[at]
            path.append((i, at))
            if from_v[i] < 0:
                break
            at = from_v[i]
        amount = min(supply[path[-1][0]], demand[end], *(flow[path[k][0], path[k + 1][1]] for k in range(len(path) - 1)), 1.0)
        for k, (i, at) in enumerate(path):
            flow[i, at] += amount
            if k + 1 < len(path):
                flow[i, path[k + 1][1]] -= amount
        supply[path[-1][0]] -= amount
        demand[end] -= amount
        u += np.minimum(du, reach)
        v += np.minimum(dv, reach)
    return float((flow * cost).sum())


def earth_mover(composition: DataFrame, ground: DataFrame) -> DataFrame:
    """Between units, over cell types whose ground distances (a, b, distance) are scaled; each pair is solved in its own Arrow row."""
    types = sorted(r[0] for r in composition.select("celltype").distinct().collect())  # a unit's types: few
    at = {t: i for i, t in enumerate(types)}
    cost = np.zeros((len(types), len(types)))
    for r in ground.collect():
        cost[at[r["a"]], at[r["b"]]] = cost[at[r["b"]], at[r["a"]]] = r["distance"]
    rows = composition.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("celltype", "proportion"))), lambda x: x["proportion"]).alias("v"))
    pairs = rows.select(F.col("unit").alias("a"), F.col("v").alias("va")).join(rows.select(F.col("unit").alias("b"), F.col("v").alias("vb")), F.col("a") < F.col("b"))

    @F.pandas_udf("double")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([transport(np.array(x), np.array(y), cost) for x, y in zip(a, b, strict=True)])

    return scale_to_one(pairs.select("a", "b", solve("va", "vb").alias("distance")))


def statistics(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("sd"), F.min("distance").alias("least"), F.max("distance").alias("most"), F.percentile("distance", 0.5).alias("median"))


def group_score(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """within, between, score = between / within (null if within is 0 or none); units without a label are Unknown."""
    side = lambda c: labels.select(F.col("unit").alias(c), F.col("label").alias(f"l{c}"))
    met = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").na.fill("Unknown", ["la", "lb"])
    same = F.col("la") == F.col("lb")
    out = met.agg(F.avg(F.when(same, F.col("distance"))).alias("within"), F.avg(F.when(~same, F.col("distance"))).alias("between"))
    return out.withColumn("score", F.when(F.col("within") > 0, F.col("between") / F.col("within")))


def square(pairs: DataFrame) -> tuple[list, np.ndarray]:
    """The symmetric matrix of unit-sized pairs, on the driver."""
    rows = pairs.collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {x: i for i, x in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for r in rows:
        d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = r["distance"]
    return names, d


def classical_mds(d: np.ndarray, k: int) -> np.ndarray:
    """Coordinates whose distances come closest: double centring, eigenvectors of positive eigenvalues; signs make each largest entry positive."""
    d = (d + d.T) / 2
    n = len(d)
    j = np.eye(n) - 1.0 / n
    values, vectors = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
    order = [i for i in np.argsort(-values) if values[i] > 1e-12][:k]
    out = vectors[:, order] * np.sqrt(values[order])
    return out * np.sign(out[np.abs(out).argmax(0), np.arange(out.shape[1])])[None, :] if len(order) else out
