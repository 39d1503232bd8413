"""Clusterings of graphs and units, and their reconciliation with labels."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kmeans(units: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = units.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("__f"))
    return KMeans(k=k, seed=seed, featuresCol="__f", predictionCol="cluster").fit(x).transform(x).select(key, (F.col("cluster") + 1).alias("cluster"))


def leiden(n: int, edges: list[tuple[int, int, float]], resolution: float = 1.0, seed: int = 42) -> np.ndarray:
    """Communities of an undirected weighted graph: local moving by modularity, refinement inside communities, aggregation, until stable."""
    rng = np.random.default_rng(seed)
    graph: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        graph[a][b] = graph[a].get(b, 0.0) + w
        if a != b:
            graph[b][a] = graph[b].get(a, 0.0) + w
    member = [[i] for i in range(n)]
    total = sum(sum(g.values()) for g in graph) or 1.0

    def move(of: list[int], allowed: list[int] | None) -> bool:
        degree = [sum(g.values()) for g in graph]
        load: dict[int, float] = {}
        for i, c in enumerate(of):
            load[c] = load.get(c, 0.0) + degree[i]
        changed, queue = False, deque(rng.permutation(len(graph)).tolist())
        waiting = set(queue)
        while queue:
            i = queue.popleft()
            waiting.discard(i)
            links: dict[int, float] = {}
            for j, w in graph[i].items():
                if j != i and (allowed is None or allowed[j] == allowed[i]):
                    links[of[j]] = links.get(of[j], 0.0) + w
            load[of[i]] -= degree[i]
            gain = lambda c: links.get(c, 0.0) - resolution * degree[i] * load.get(c, 0.0) / total  # noqa: B023, E731
            best = max(sorted(links), key=lambda c: round(gain(c), 12), default=of[i])
            if gain(best) <= gain(of[i]) + 1e-12:
                best = of[i]
            load[best] = load.get(best, 0.0) + degree[i]
            if best != of[i]:
                of[i], changed = best, True
                for j in graph[i]:
                    if of[j] != best and j not in waiting:
                        queue.append(j)
                        waiting.add(j)
        return changed

    of = list(range(n))
    while True:
        changed = move(of, None)
        fine = list(range(len(graph)))
        move(fine, of)
        kinds = sorted(set(fine))
        if not changed or len(kinds) == len(graph):
            break
        at = {c: i for i, c in enumerate(kinds)}
        merged: list[dict[int, float]] = [{} for _ in kinds]
        parts: list[list[int]] = [[] for _ in kinds]
        up = [0] * len(kinds)
        for i, g in enumerate(graph):
            a = at[fine[i]]
            parts[a] += member[i]
            up[a] = of[i]
            for j, w in g.items():
                b = at[fine[j]]
                merged[a][b] = merged[a].get(b, 0.0) + w
        graph, member = merged, parts
        names = {c: i for i, c in enumerate(dict.fromkeys(up))}
        of = [names[c] for c in up]
    out = np.zeros(n, int)
    for i, m in enumerate(member):
        out[m] = of[i]
    sizes = sorted(set(out.tolist()), key=lambda c: (-(out == c).sum(), c))
    return np.array([sizes.index(c) + 1 for c in out])


def average_linkage(x: np.ndarray, k: int) -> np.ndarray:
    """Labels 1..k of rows by average linkage on Euclidean distances."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        _, a, b = min((d[np.ix_(p, q)].mean(), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
        groups[a] += groups.pop(b)
    out = np.zeros(len(x), int)
    for i, g in enumerate(groups):
        out[g] = i + 1
    return out


def cell_types(links: DataFrame, cells: DataFrame, id_col: str, vector: str, target: int | None = None, resolution: float = 0.8, most: float = 5.0, seed: int = 42, max_nodes: int = 200_000, groups: int = 20_000) -> DataFrame:
    """id, celltype: Leiden on the kNN links; the resolution rises by 0.5 until there are target types, and what is over is merged by centroids.

    The graph step is one machine's work on max_nodes nodes at most. Beyond, the nodes are groups of near cells (K-means centres, all cells take part),
    joined by the number of links between their cells, so what reaches the driver is bounded whatever the number of cells; a group has one type.
    """
    n = cells.count()
    if n <= max_nodes:
        ids = [r[0] for r in cells.select(id_col).orderBy(id_col).collect()]
        at = {x: i for i, x in enumerate(ids)}
        edges = [(at[r[0]], at[r[1]], 1.0) for r in links.select("query", "neighbour").collect()]
        nodes = cells.sparkSession.createDataFrame(list(enumerate(ids)), f"__node long, {id_col} {dict(cells.dtypes)[id_col]}")
        size = len(ids)
    else:
        nodes = kmeans(cells, id_col, vector, groups, seed).select(id_col, (F.col("cluster") - 1).cast("long").alias("__node")).persist()
        side = lambda own, name: nodes.select(F.col(id_col).alias(own), F.col("__node").alias(name))
        between = links.join(side("query", "a"), "query").join(side("neighbour", "b"), "neighbour").groupBy("a", "b").agg(F.count("*").alias("w"))
        # A group's own links count from both of their ends, as they would cell by cell.
        edges = [(r["a"], r["b"], float(r["w"] * (2 if r["a"] == r["b"] else 1))) for r in between.collect()]
        size = groups
    found = leiden(size, edges, resolution, seed)
    while target and found.max() < target and resolution < most:
        resolution += 0.5
        found = leiden(size, edges, resolution, seed)
    label = cells.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(found)], "__node long, c int")
    long = nodes.join(label, "__node").select(id_col, "c")
    if target and found.max() > target:
        means = cells.join(long, id_col).select("c", F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy("c", "i").agg(F.avg("x").alias("x")).groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
        centre = {r["c"]: r["v"] for r in means.collect()}
        present = sorted(centre)
        merged = average_linkage(np.array([centre[c] for c in present]), target)
        long = long.join(cells.sparkSession.createDataFrame([(c, int(m)) for c, m in zip(present, merged, strict=True)], "c int, m int"), "c").select(id_col, F.col("m").alias("c"))
    return long.select(F.col(id_col), F.col("c").cast("int").alias("celltype"))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (row, column) of least total cost: shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = c[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def reconcile(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """cluster, label, n, matched: one-to-one by largest agreement; clusters left over take their majority label."""
    n = rows.groupBy(cluster, label).agg(F.count("*").alias("n")).collect()  # clusters by labels
    cs, ls = sorted({r[cluster] for r in n}, key=str), sorted({r[label] for r in n}, key=str)
    table = np.zeros((len(cs), len(ls)))
    for r in n:
        table[cs.index(r[cluster]), ls.index(r[label])] = r["n"]
    to = dict(assignment(-table))
    out = [(str(c), str(ls[to.get(i, int(table[i].argmax()))]), int(table[i, to.get(i, int(table[i].argmax()))]), i in to) for i, c in enumerate(cs)]
    return rows.sparkSession.createDataFrame(out, "cluster string, label string, n long, matched boolean")
