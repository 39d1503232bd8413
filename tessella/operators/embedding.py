"""From cell embeddings to a unit embedding: soft composition, displacement, stacking, PCA, batch correction.

Cell-sized steps are aggregates; what reaches the driver is a unit-sized matrix or a Gramian of the number of coordinates.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _square_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of each row of x to each of c, by one product about the mean of c; those that are small beside the norms are made from differences."""
    x, c = x - c.mean(0), c - c.mean(0)
    norms = (x**2).sum(1)[:, None] + (c**2).sum(1)[None, :]
    d2 = np.maximum(norms - 2 * (x @ c.T), 0)
    i, j = np.nonzero(d2 < 1e-6 * norms)
    for lo in range(0, len(i), 1 << 15):
        at = slice(lo, lo + (1 << 15))
        d2[i[at], j[at]] = ((x[i[at]] - c[j[at]]) ** 2).sum(1)
    return d2


def _whole(vectors, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of a column of lists have dims entries, none of them null; and these as a matrix."""
    import pyarrow as pa
    import pyarrow.compute as pc

    at = np.zeros(len(vectors) + 1, np.int64)
    at[1:] = np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False))
    flat = vectors.flatten()
    gaps = np.concatenate([[0], np.cumsum(pc.is_null(flat).to_numpy(zero_copy_only=False))])
    good = (np.diff(at) == dims) & (gaps[at[1:]] == gaps[at[:-1]]) & pc.is_valid(vectors).to_numpy(zero_copy_only=False)
    kept = vectors.filter(pa.array(good)).flatten()
    return good, kept.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, dims)


def _median_distance(vectors: DataFrame, centres: np.ndarray) -> float | None:
    """The exact median of the distances of all rows (v) to all centres: the middle ones are found from their leading bits on, in four passes of counts.

    Doubles from 0 on sort as their bits do. After the first, a pass counts 2^16 values at most per middle one.
    """
    import pyarrow as pa

    def counted(shift: int, known: list[int], width: int) -> dict[int, int]:
        def count(batches):
            for batch in batches:
                found: dict[int, int] = {}
                _, x = _whole(batch.column(0), centres.shape[1])
                for lo in range(0, len(x), 2048):
                    bits = np.sqrt(_square_distances(x[lo : lo + 2048], centres)).ravel().view(np.int64)
                    if known:
                        bits = bits[np.isin(bits >> (shift + width), known)]
                    for value, n in zip(*(a.tolist() for a in np.unique(bits >> shift, return_counts=True)), strict=True):
                        found[value] = found.get(value, 0) + n
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["bits", "n"])

        return dict(vectors.mapInArrow(count, "bits long, n long").groupBy("bits").agg(F.sum("n")).toLocalIterator())

    ranks: list[int] = []
    known: list[int] = []
    for shift, width in ((46, 18), (30, 16), (14, 16), (0, 14)):
        seen = sorted(counted(shift, sorted(set(known)), width).items())
        if not ranks:
            n = sum(c for _, c in seen)
            if not n:
                return None
            ranks = [(n - 1) // 2, n // 2]
        chosen, left = [], []
        for which, rank in enumerate(ranks):
            for value, c in seen:
                if known and value >> width != known[which]:
                    continue
                if rank < c:
                    chosen.append(value)
                    left.append(rank)
                    break
                rank -= c
        known, ranks = chosen, left
    return float(np.array(known, np.int64).view(float).mean())


def soft_composition(cells: DataFrame, anchors: DataFrame, unit: str, vector: str, id_col: str, sigma: float | None = None) -> DataFrame:
    """unit, anchor, share: softmax over anchors of -d^2 / 2 sigma^2, averaged over a unit's cells; sigma: the median of all distances.

    anchors(anchor, c array<double>): a few hundred rows, which go to the tasks as one matrix. Cells without a whole vector count for nothing.
    """
    import pyarrow as pa

    rows = anchors.orderBy("anchor").select("anchor", F.col("c").cast("array<double>")).collect()
    kinds = dict(anchors.dtypes)["anchor"], dict(cells.dtypes)[unit]
    if not rows:
        return cells.sparkSession.createDataFrame([], f"unit {kinds[1]}, anchor {kinds[0]}, share double")
    centres = np.array([r[1] for r in rows], float)
    packed = cells.select(F.col(vector).cast("array<double>").alias("v"), F.col(unit).alias("unit"))
    width = float(sigma) if sigma is not None else _median_distance(packed.select("v"), centres)

    def shares(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(1).dictionary_encode(null_encoding="encode")
            good, x = _whole(batch.column(0), centres.shape[1])
            owner, total, n = of.indices.to_numpy()[good], np.zeros((len(of.dictionary), len(centres))), np.bincount(of.indices.to_numpy()[good], minlength=len(of.dictionary))
            for lo in range(0, len(x), 2048):
                d2 = _square_distances(x[lo : lo + 2048], centres)
                more = d2 - d2.min(1, keepdims=True)
                e = np.exp(-more / (2 * width * width)) if width else (more == 0).astype(float)
                np.add.at(total, owner[lo : lo + 2048], e / e.sum(1, keepdims=True))
            units, places = len(of.dictionary), len(centres)
            own = of.dictionary.take(pa.array(np.repeat(np.arange(units), places)))
            yield pa.RecordBatch.from_arrays([own, pa.array(np.tile(np.arange(places, dtype=np.int32), units)), pa.array(total.ravel()), pa.array(np.repeat(n, places).astype(np.int64))], ["unit", "at", "s", "n"])

    sums = packed.mapInArrow(shares, f"unit {kinds[1]}, at int, s double, n long").groupBy("unit", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    names = cells.sparkSession.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"at int, anchor {kinds[0]}")
    return sums.join(F.broadcast(names), "at").select("unit", "anchor", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("share"))  # as many names as anchors


def _seeds(pool: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each next centre by its squared distance to those before; fewer than k if no other row is left."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(pool)))]
    far = ((pool - pool[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and far.sum() > 0:
        chosen.append(int(rng.choice(len(pool), p=far / far.sum())))
        far = np.minimum(far, ((pool - pool[chosen[-1]]) ** 2).sum(1))
    return pool[chosen]


def kmeans_anchors(cells: DataFrame, vector: str, k: int, seed: int = 42, iterations: int = 20) -> DataFrame:
    """anchor, c: centres by Lloyd's rounds over all cells, from seeds among 20 k different vectors (those with the least hashes)."""
    import pyarrow as pa

    k = max(2, k)
    rows = cells.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    hashed = rows.withColumn("h", F.xxhash64(F.lit(seed), "v"))
    last = hashed.select("h").distinct().orderBy("h").limit(20 * k).agg(F.max("h")).first()[0]
    pool = hashed.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).orderBy("h").select("v").collect() if last is not None else []
    if not pool:
        raise ValueError("no vectors to cluster")
    centres = _seeds(np.array([r[0] for r in pool], float), k, seed)
    n, dims = centres.shape

    def pack(batches):
        for batch in batches:
            _, x = _whole(batch.column(0), dims)
            packed = [x[lo : lo + 512].tobytes() for lo in range(0, len(x), 512)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["x"])

    # Read once; every round goes over the packed rows, on all cores though the table may be one file.
    sent = max(rows.rdd.getNumPartitions(), cells.sparkSession.sparkContext.defaultParallelism)
    blocks = rows.mapInArrow(pack, "x binary").repartition(sent).rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(iterations):

        def sums(packed, centres=centres):
            total = np.zeros((n, dims + 1))
            for block in packed:
                x = np.frombuffer(block).reshape(-1, dims)
                member = np.zeros((len(x), n))
                member[np.arange(len(x)), _square_distances(x, centres).argmin(1)] = 1
                total += member.T @ np.column_stack([x, np.ones(len(x))])
            yield total

        total = blocks.mapPartitions(sums).treeReduce(lambda a, b: a + b)
        moved = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), centres)
        settled = ((moved - centres) ** 2).sum(1).max() <= 1e-8
        centres = moved
        if settled:
            break
    blocks.unpersist()
    return cells.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "anchor int, c array<double>")


def unit_type_sums(cells: DataFrame, unit: str, group: str, celltype: str, vector: str) -> DataFrame:
    """unit, group, celltype, dim, s, n: sufficient statistics; they merge, so they stream too."""
    long = cells.select(unit, group, celltype, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    return long.groupBy(unit, group, celltype, "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))


def displacement(cells: DataFrame, unit: str, group: str, celltype: str, vector: str) -> DataFrame:
    """unit, celltype, dim, value: a unit's mean in a type minus the mean of the group's other cells of that type, times reliability.

    Reliability is sqrt(n) over the largest sqrt(n) of the type. A reference without cells is 0; a unit without cells of a type has no row (0).
    """
    s = unit_type_sums(cells, unit, group, celltype, vector)
    peers = Window.partitionBy(group, celltype, "dim")
    others = F.sum("n").over(peers) - F.col("n")
    reference = F.when(others > 0, (F.sum("s").over(peers) - F.col("s")) / others).otherwise(0.0)
    reliability = F.sqrt("n") / F.greatest(F.max(F.sqrt("n")).over(Window.partitionBy(celltype, "dim")), F.lit(1e-6))
    return s.withColumn("value", (F.col("s") / F.col("n") - reference) * reliability).select(F.col(unit).alias("unit"), F.col(celltype).alias("celltype"), (F.col("dim") + 1).alias("dim"), "value")


def frobenius_stack(blocks: list[tuple[DataFrame, float]]) -> DataFrame:
    """unit, feature, value: each block (unit, feature, value, zeros filled) centred by feature and scaled to norm sqrt(units) * weight."""
    out = None
    for i, (block, weight) in enumerate(blocks):
        centred = block.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("feature")))
        norm = centred.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.countDistinct("unit").alias("units"))
        scaled = centred.join(F.broadcast(norm)).select("unit", F.concat(F.lit(f"{i}:"), F.col("feature").cast("string")).alias("feature"), F.when(F.col("norm") > 0, F.col("value") / F.col("norm") * F.sqrt("units") * F.lit(float(weight))).otherwise(0.0).alias("value"))
        out = scaled if out is None else out.unionByName(scaled)
    return out


def remove_batch(values: DataFrame, batch: str) -> DataFrame:
    """Minus the batch's mean per feature, the whole mean with it."""
    return values.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(batch, "feature")))


def matrix(values: DataFrame) -> tuple[list, list, np.ndarray]:
    """units, features, dense matrix of a unit-sized long table."""
    rows = values.select("unit", "feature", "value").collect()
    units, features = sorted({r[0] for r in rows}, key=str), sorted({r[1] for r in rows}, key=str)
    at_u, at_f = {u: i for i, u in enumerate(units)}, {f: i for i, f in enumerate(features)}
    x = np.zeros((len(units), len(features)))
    for u, f, v in rows:
        x[at_u[u], at_f[f]] = v or 0.0
    return units, features, x


def pca(x: np.ndarray, k: int) -> np.ndarray:
    """Centred scores; each component's largest entry is positive."""
    x = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    k = min(k, max(1, min(x.shape) - (x.shape[0] <= x.shape[1])))
    out = u[:, :k] * s[:k]
    return out * np.where(out[np.abs(out).argmax(0), np.arange(k)] < 0, -1, 1)


def gramian(cells: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and centred second moments of a cell-sized table: one pass, a matrix of the number of coordinates per partition."""
    import pandas as pd

    def sums(batches):
        n, s, g = 0, None, None
        for frame in batches:
            if len(frame):
                x = np.array(frame["v"].tolist(), float)
                n += len(x)
                s = x.sum(0) if s is None else s + x.sum(0)
                g = x.T @ x if g is None else g + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    rows = cells.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null").mapInPandas(sums, "n long, s array<double>, g array<double>")
    add = lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2])
    n, s, g = rows.rdd.map(lambda r: (r[0], np.array(r[1]), np.array(r[2]))).treeReduce(add)
    mean = s / n
    return n, mean, g.reshape(len(s), -1) - n * np.outer(mean, mean)


def cell_pca(cells: DataFrame, vector: str, k: int, out: str = "pc") -> DataFrame:
    """cells with the scores of the first k components; the projection is an expression over literal loadings."""
    _, mean, g = gramian(cells, vector)
    values, vectors = np.linalg.eigh(g)
    load = vectors[:, np.argsort(-values)[:k]]
    load = load * np.where(load[np.abs(load).argmax(0), np.arange(load.shape[1])] < 0, -1, 1)
    v = F.col(vector).cast("array<double>")
    score = [F.aggregate(F.zip_with(v, F.lit([float(x) for x in load[:, j]]), lambda x, w: x * w), F.lit(-float(mean @ load[:, j])), lambda s, x: s + x) for j in range(load.shape[1])]
    return cells.withColumn(out, F.array(*score))


def _sparse_product(i, x, v: np.ndarray):
    """x v of cells given by their features' places i and values x; and the entries: places, values, rows."""
    sizes = [len(a) for a in i]
    at, value = np.concatenate([np.asarray(a, int) for a in i]), np.concatenate([np.asarray(a, float) for a in x])
    return np.add.reduceat(v[at] * value[:, None], np.cumsum([0, *sizes[:-1]]), axis=0), at, value, np.repeat(np.arange(len(sizes)), sizes)


def decompose(values: DataFrame, components: int, centred: bool, rounds: int = 8, more: int = 10, seed: int = 42):
    """Singular vectors of the cells' features (cell_id, feature_id, value; absent ones are 0), minus each feature's mean over the cells if centred.

    Subspace iteration: a cell's features stand in one row, each round adds up x' (x v) over the cells, and only features times components reach the
    driver. Returns the rows (cell_id, i, x), the loadings by feature (each component's largest is positive), the features' means (0 if not centred),
    the singular values and the components' means over the cells.
    """
    spark = values.sparkSession
    names = [r[0] for r in values.select("feature_id").distinct().orderBy("feature_id").collect()]  # features, not cells
    k = min(components + more, len(names))
    if len(names) * k > 1 << 26:
        raise ValueError(f"{len(names)} features times {k} components exceed what one matrix may hold; choose variable features first")
    place = spark.createDataFrame(list(enumerate(names)), f"i int, feature_id {dict(values.dtypes)['feature_id']}")
    rows = values.join(place, "feature_id").groupBy("cell_id").agg(F.collect_list(F.struct("i", "value")).alias("x")).select("cell_id", F.col("x.i").alias("i"), F.col("x.value").alias("x")).persist()
    n = rows.count()
    mean = np.zeros(len(names))
    if centred:
        for i, m in values.join(place, "feature_id").groupBy("i").agg(F.sum("value") / n).collect():
            mean[i] = m

    def once(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x' x v, the second moments and the sums of x v."""
        sent = spark.sparkContext.broadcast(v)

        def part(batch):
            back, second, total = np.zeros_like(sent.value), np.zeros((sent.value.shape[1],) * 2), np.zeros(sent.value.shape[1])
            chunk = []

            def add():
                u, at, value, owner = _sparse_product([r[0] for r in chunk], [r[1] for r in chunk], sent.value)
                np.add.at(back, at, u[owner] * value[:, None])
                second.__iadd__(u.T @ u)
                total.__iadd__(u.sum(0))
                chunk.clear()

            for r in batch:
                chunk.append(r)
                if len(chunk) >= 256:
                    add()
            if chunk:
                add()
            yield back, second, total

        back, second, total = rows.select("i", "x").rdd.mapPartitions(part).treeReduce(lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)))
        shift = mean @ v
        return back - n * np.outer(mean, shift), second - n * np.outer(shift, shift), total - n * shift

    v, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(names), k)))
    for _ in range(rounds):
        v, _ = np.linalg.qr(once(v)[0])
    _, second, total = once(v)
    found, turn = np.linalg.eigh(second)
    order = np.argsort(-found)[: min(components, k)]
    load = v @ turn[:, order]
    sign = np.where(load[np.abs(load).argmax(0), np.arange(load.shape[1])] < 0, -1.0, 1.0)
    return rows, load * sign, mean, np.sqrt(np.maximum(found[order], 0)), total @ turn[:, order] * sign / n


def _scores(rows: DataFrame, name: str, load: np.ndarray, shift: np.ndarray, by: np.ndarray) -> DataFrame:
    """cell_id and name: (x load - shift) / by of every cell."""
    sent = rows.sparkSession.sparkContext.broadcast((load, shift, by))

    def project(frames):
        import pandas as pd

        for frame in frames:
            for lo in range(0, len(frame), 256):
                part = frame.iloc[lo : lo + 256]
                u = _sparse_product(list(part["i"]), list(part["x"]), sent.value[0])[0]
                yield pd.DataFrame({"cell_id": part["cell_id"].to_numpy(), name: list((u - sent.value[1]) / sent.value[2])})

    return rows.mapInPandas(project, f"cell_id {dict(rows.dtypes)['cell_id']}, {name} array<double>")


def lsi(counts: DataFrame, components: int = 50, drop_first: bool = True, rounds: int = 8, more: int = 10, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """cell_id, lsi (a coordinate per component), and the components' deviations: the first left singular vectors of the TF-IDF of counts, each
    brought to mean 0 and deviation 1 over the cells with counts; the first component, which follows the depth, is left out."""
    from .normalize import tfidf

    rows, load, _, singular, mean = decompose(tfidf(counts), components, False, rounds, more, seed)
    n, own = rows.count(), slice(1 if drop_first else 0, None)
    sd = np.sqrt(np.maximum(singular[own] ** 2 / n - mean[own] ** 2, 1e-300))
    return _scores(rows, "lsi", load[:, own], mean[own], sd), singular[own] / np.sqrt(max(1, n - 1))


def count_pca(values: DataFrame, components: int = 20, rounds: int = 8, more: int = 10, seed: int = 42) -> DataFrame:
    """cell_id, pc: scores of the first principal components of the features of normalised counts, over the cells with counts."""
    rows, load, mean, singular, _ = decompose(values, components, True, rounds, more, seed)
    return _scores(rows, "pc", load, mean @ load, np.ones(len(singular)))


def harmony(z: np.ndarray, batch: list, clusters: int | None = None, rounds: int = 30, sigma: float = 0.1, theta: float = 2.0, ridge: float = 1.0, seed: int = 42) -> np.ndarray:
    """Soft k-means on the sphere with a diversity penalty, then ridge removal of the batch per cluster, until it settles."""
    names = sorted(set(batch), key=str)
    if len(names) < 2 or len(z) < 8:
        return z.copy()
    phi = np.array([[b == n for n in names] for b in batch], float)
    share = phi.mean(0)
    k = clusters or max(2, min(len(names), len(z) // 2))
    rng = np.random.default_rng(seed)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    cur, x = z.copy(), unit(z)
    y = x[rng.choice(len(x), k, replace=False)]
    design = np.concatenate([np.ones((len(z), 1)), phi], axis=1)
    penalty = ridge * np.diag([0.0] + [1.0] * len(names))
    r = np.full((len(z), k), 1 / k)
    for _ in range(rounds):
        before = cur
        for _ in range(10):
            d = 2 * (1 - x @ y.T)
            observed, expected = r.T @ phi, np.outer(r.sum(0), share)
            weight = ((expected + 1) / (observed + 1)) ** theta
            r = np.exp(-(d - d.min(1, keepdims=True)) / sigma) * (phi @ weight.T)
            r /= r.sum(1, keepdims=True)
            y = unit(r.T @ x)
        cur = z.copy()
        for j in range(k):
            w = design * r[:, j : j + 1]
            beta = np.linalg.solve(w.T @ design + penalty + 1e-9 * np.eye(len(penalty)), w.T @ z)
            beta[0] = 0
            cur -= w @ beta
        x = unit(cur)
        if np.abs(cur - before).max() < 1e-6:
            break
    return cur


def composite_batches(groups: list, batches: list) -> list[str]:
    """`group__batch`; groups alone if every unit would be a batch of its own."""
    both = [f"{g}__{b}" for g, b in zip(groups, batches, strict=True)]
    return [str(g) for g in groups] if len(set(both)) == len(both) else both


def reduce_units(values: DataFrame, batches: dict | None, components: int = 10, method: str = "harmony") -> DataFrame:
    """unit, pc: PCA of the stacked blocks, batch-corrected; Harmony falls back to linear, linear to none."""
    spark = values.sparkSession
    units, _, x = matrix(values)
    z = pca(x, min(components, max(1, len(units) - 1)))
    labels = [str((batches or {}).get(u, "")) for u in units]
    if len(set(labels)) > 1 and len(units) >= 8 and method != "none":
        try:
            if method != "harmony":
                raise np.linalg.LinAlgError
            z = harmony(z, labels)
        except np.linalg.LinAlgError:
            for b in set(labels):
                of = [i for i, x in enumerate(labels) if x == b]
                z[of] -= z[of].mean(0)
    return spark.createDataFrame([(u, [float(v) for v in row]) for u, row in zip(units, z, strict=True)], ["unit", "pc"])


def sample_blocks(cells: DataFrame, unit: str, celltype: str, vector: str, id_col: str, k_medium: int | None = None, k_fine: int | None = None, alpha: float = 0.6, seed: int = 42) -> list[tuple[DataFrame, float]]:
    """The four blocks (unit, feature, value) and their weights: hard composition, two soft compositions, displacement.

    Anchors follow the number of cells n unless given: min(120, max(2, n // 200)) and min(300, max(2, n // 100)).
    """
    from ..functions.columns import block_weights
    from .compose import composition

    if k_medium is None or k_fine is None:
        n = cells.count()
        k_medium = min(120, max(2, n // 200)) if k_medium is None else k_medium
        k_fine = min(300, max(2, n // 100)) if k_fine is None else k_fine

    hard = composition(cells, unit, celltype).select("unit", F.col("celltype").cast("string").alias("feature"), F.col("proportion").alias("value"))
    soft = [soft_composition(cells, kmeans_anchors(cells, vector, k, seed + i), unit, vector, id_col).select("unit", F.col("anchor").cast("string").alias("feature"), F.col("share").alias("value")) for i, k in enumerate((k_medium, k_fine))]
    moved = displacement(cells.withColumn("__all", F.lit(1)), unit, "__all", celltype, vector).select("unit", F.concat_ws(":", "celltype", "dim").alias("feature"), "value")
    grid = moved.select("unit").distinct().crossJoin(moved.select("feature").distinct())
    moved = grid.join(moved, ["unit", "feature"], "left").na.fill(0.0, ["value"])
    weights = block_weights(hard.select("feature").distinct().count(), k_medium, k_fine, alpha)
    return list(zip([hard, *soft, moved], weights, strict=True))


def sample_embedding(cells: DataFrame, unit: str, celltype: str, vector: str, id_col: str, batch: str | None = None, k_medium: int | None = None, k_fine: int | None = None, alpha: float = 0.6, components: int = 10, method: str = "harmony", seed: int = 42) -> DataFrame:
    """The flagship: the four blocks, stacked, reduced, corrected."""
    from .compose import majority

    blocks = [(block.persist(), weight) for block, weight in sample_blocks(cells, unit, celltype, vector, id_col, k_medium, k_fine, alpha, seed)]  # unit-sized, each read several times
    batches = {r[0]: r[1] for r in majority(cells, unit, batch).select(unit, batch).collect()} if batch else None
    made = reduce_units(frobenius_stack(blocks), batches, components, method)
    for block, _ in blocks:
        block.unpersist()
    return made
