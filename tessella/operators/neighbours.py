"""Exact nearest neighbours, label transfer over them, and scores of neighbourhoods.

Reference vectors go out in packed blocks of bounded size, and each query block takes the k best of each reference block by matrix products of
CHUNK queries; blocks meet in a join on the block pair, partial bests are merged by query, so neither side has to fit anywhere as a whole. A query block
is SIDE times a reference block, as it is what travels to every reference block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SIDE, CHUNK = 4096, 8, 1024
#: Pairs whose exact distances are made at a time.
PAIRS = 1 << 17


def _blocks(df: DataFrame, id_col: str, vector: str, n: int, name: str) -> DataFrame:
    packed = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return packed.groupBy("k").agg(F.collect_list(F.struct("id", "v")).alias(name)).withColumnRenamed("k", f"k_{name}")


def nearest(queries: DataFrame, pool: DataFrame, k: int, metric: str = "euclidean", id_col: str = "vec_id", vector: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """query, neighbour, distance, rank (from 1); equal distances go by the neighbour's id."""
    if metric not in ("euclidean", "cosine"):
        raise ValueError("euclidean or cosine")
    nq, np_ = (max(1, -(-df.count() // size)) for df, size in ((queries, SIDE * BLOCK), (pool, BLOCK)))
    a, b = _blocks(queries, id_col, vector, nq, "q"), _blocks(pool, id_col, vector, np_, "p")
    # Each query block is sent to each block of the pool: an equi-join on the pool block's number.
    met = a.withColumn("k_p", F.explode(F.sequence(F.lit(0), F.lit(np_ - 1)))).join(b, "k_p")

    def best(batches):
        for frame in batches:
            for q, p in zip(frame["q"], frame["p"], strict=True):
                pi, y = np.array([r["id"] for r in p]), np.array([r["v"] for r in p], float)
                for lo in range(0, len(q), CHUNK):
                    part = q[lo : lo + CHUNK]
                    yield from nearest_of(np.array([r["id"] for r in part]), np.array([r["v"] for r in part], float), pi, y)

    def nearest_of(qi, x, pi, y):
        if metric == "cosine":
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
        squares = (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :]
        rough = squares - 2 * x @ y.T if metric == "euclidean" else 1 - x @ y.T
        if exclude_self:
            rough[qi[:, None] == pi[None, :]] = np.inf
        # All that may be as near as the k-th, as the products round: ties are told apart by their exact distances and ids.
        limit = np.partition(rough, min(k, len(pi)) - 1, axis=1)[:, min(k, len(pi)) - 1] + 1e-10 * (1 + squares.max(1))
        near = np.isfinite(rough) & (rough <= limit[:, None])
        ends = np.cumsum(near.sum(1))
        i = 0
        while i < len(qi):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            a, c = np.nonzero(near[i:j])
            a += i
            d = np.sqrt(((x[a] - y[c]) ** 2).sum(1)) if metric == "euclidean" else 1 - np.einsum("ij,ij->i", x[a], y[c])
            order = np.lexsort((pi[c], d, a))
            a, c, d = a[order], c[order], d[order]
            keep = np.arange(len(a)) - np.searchsorted(a, a) < k
            yield pd.DataFrame({"query": qi[a[keep]], "neighbour": pi[c[keep]], "distance": d[keep]})
            i = j

    part = met.select("q", "p").mapInPandas(best, "query long, neighbour long, distance double")
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def transfer_labels(links: DataFrame, labels: DataFrame) -> DataFrame:
    """query, label, votes: the most frequent label of the neighbours, ties to the least."""
    votes = links.join(labels.select(F.col("id").alias("neighbour"), "label"), "neighbour").groupBy("query", "label").agg(F.count("*").alias("votes"))
    return votes.groupBy("query").agg(F.min_by("label", F.struct(-F.col("votes"), "label")).alias("label"), F.max("votes").alias("votes"))


def snn_transfer(xx: DataFrame, xy: DataFrame, yx: DataFrame, yy: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Labels of x carried to y by shared neighbours: J = (x,y pairs reached by xx.yx or xy.yy), weight J / (4k - J), columns normalised, best class.

    All inputs hold query, neighbour; labels: id of x, label. y without any weight is unassigned with confidence 0.
    """
    a = xx.select(F.col("query").alias("x"), F.col("neighbour").alias("m")).join(yx.select(F.col("query").alias("y"), F.col("neighbour").alias("m")), "m").select("x", "y")
    b = xy.select(F.col("query").alias("x"), F.col("neighbour").alias("m")).join(yy.select(F.col("query").alias("y"), F.col("neighbour").alias("m")), "m").select("x", "y")
    j = a.unionAll(b).groupBy("x", "y").agg(F.count("*").alias("j"))
    weighed = j.join(labels.select(F.col("id").alias("x"), "label"), "x").groupBy("y", "label").agg(F.sum(F.col("j") / (4 * k - F.col("j"))).alias("w"))
    # Rounded, so that sums in another order are a tie still.
    best = weighed.groupBy("y").agg(F.min_by("label", F.struct(-F.round("w", 12), "label")).alias("label"), (F.max("w") / F.sum("w")).alias("confidence"))
    return yx.select(F.col("query").alias("y")).distinct().join(best, "y", "left").select("y", F.coalesce("label", F.lit("unassigned")).alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def hit_rate(links: DataFrame, pairs: DataFrame, up_to: int) -> DataFrame:
    """k, rate: the share of pairs (a, b) whose b is among a's k nearest, for k = 1..up_to."""
    found = pairs.join(links.select(F.col("query").alias("a"), F.col("neighbour").alias("b"), "rank"), ["a", "b"], "left")
    ks = found.select("rank", F.explode(F.sequence(F.lit(1), F.lit(up_to))).alias("k"))
    return ks.groupBy("k").agg(F.avg(F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)).cast("double")).alias("rate"))


def same_share(links: DataFrame, labels: DataFrame) -> DataFrame:
    """label, share: the mean share of a row's neighbours that have its own label."""
    own = labels.select(F.col("id").alias("query"), F.col("label").alias("own"))
    other = labels.select(F.col("id").alias("neighbour"), F.col("label").alias("other"))
    return links.join(own, "query").join(other, "neighbour").groupBy(F.col("own").alias("label")).agg(F.avg((F.col("own") == F.col("other")).cast("double")).alias("share"))


def mixing_matrix(links: DataFrame, labels: DataFrame) -> DataFrame:
    own = labels.select(F.col("id").alias("query"), F.col("label").alias("own"))
    other = labels.select(F.col("id").alias("neighbour"), F.col("label").alias("other"))
    n = links.join(own, "query").join(other, "neighbour").groupBy("own", "other").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("own")))


def inverse_simpson(links: DataFrame, labels: DataFrame) -> DataFrame:
    """query, ilisi: 1 / sum of squared label shares among a row's neighbours."""
    other = labels.select(F.col("id").alias("neighbour"), "label")
    n = links.join(other, "neighbour").groupBy("query", "label").agg(F.count("*").alias("n"))
    return n.groupBy("query").agg((F.pow(F.sum("n"), 2) / F.sum(F.col("n") * F.col("n"))).alias("ilisi"))


def partner_rank(distances: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """a, b, rank: how many of the other units are nearer to a than its partner b, over n - 2. distances: both directions."""
    order = Window.partitionBy("a").orderBy("distance", "b")
    return distances.withColumn("k", F.row_number().over(order) - 1).join(pairs, ["a", "b"]).select("a", "b", (F.col("k") / F.lit(float(max(1, n - 2)))).alias("rank"))


def anchor_gap(links: DataFrame, values: DataFrame) -> DataFrame:
    """query, gap: the mean absolute difference of value between a row and its neighbours."""
    own, other = values.select(F.col("id").alias("query"), F.col("value").alias("own")), values.select(F.col("id").alias("neighbour"), F.col("value").alias("other"))
    return links.join(own, "query").join(other, "neighbour").groupBy("query").agg(F.avg(F.abs(F.col("own") - F.col("other"))).alias("gap"))


def smooth(links: DataFrame, values: DataFrame) -> DataFrame:
    """query, feature_id, value: the mean over a row's neighbours, absent entries as zeros."""
    n = links.groupBy("query").agg(F.count("*").alias("k"))
    s = links.join(values.withColumnRenamed("cell_id", "neighbour"), "neighbour").groupBy("query", "feature_id").agg(F.sum("value").alias("s"))
    return s.join(n, "query").select("query", "feature_id", (F.col("s") / F.col("k")).alias("value"))
