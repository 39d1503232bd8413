"""Quality control over the long layout: counts(cell_id, feature_id, value), zeros absent; cells(cell_id, sample, ...).

Every filter is an aggregate and a semi join; the aggregates combine on the map side, and only ids and numbers are shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def features_in_cells(counts: DataFrame, min_cells: int) -> DataFrame:
    """Counts of the features that at least min_cells cells have."""
    kept = counts.where("value > 0").groupBy("feature_id").agg(F.countDistinct("cell_id").alias("n")).where(F.col("n") >= min_cells)
    return counts.join(kept.select("feature_id"), "feature_id", "left_semi")


def cells_with_features(counts: DataFrame, min_features: int, max_features: int | None = None) -> DataFrame:
    """Counts of the cells with at least min_features features, and at most max_features."""
    n = counts.where("value > 0").groupBy("cell_id").agg(F.countDistinct("feature_id").alias("n"))
    kept = n.where(F.col("n") >= min_features)
    if max_features is not None:
        kept = kept.where(F.col("n") <= max_features)
    return counts.join(kept.select("cell_id"), "cell_id", "left_semi")


def cell_metrics(counts: DataFrame, special: Column) -> DataFrame:
    """cell_id, total, n_features, pct_special: the share of counts on features that special marks, in percent."""
    share = F.sum(F.when(special, F.col("value")).otherwise(0.0)) / F.sum("value") * 100
    return counts.groupBy("cell_id").agg(F.sum("value").alias("total"), F.count(F.when(F.col("value") > 0, 1)).alias("n_features"), F.coalesce(share, F.lit(0.0)).alias("pct_special"))


def drop_features(counts: DataFrame, special: Column, excluded: list[str] = ()) -> DataFrame:
    return counts.where(~special & ~F.col("feature_id").isin(list(excluded)) if excluded else ~special)


def samples_with_cells(cells: DataFrame, min_cells: int, sample: str = "sample") -> DataFrame:
    kept = cells.groupBy(sample).agg(F.count("*").alias("n")).where(F.col("n") >= min_cells)
    return cells.join(kept.select(sample), sample, "left_semi")


def features_in_share(counts: DataFrame, share: float = 0.001, least: int = 0) -> DataFrame:
    """Counts of the features in at least int(share * cells) cells; the threshold is a one-row subquery, not a driver round trip."""
    threshold = counts.agg(F.greatest(F.lit(least), F.floor(F.countDistinct("cell_id") * F.lit(share))).alias("least"))
    n = counts.where("value > 0").groupBy("feature_id").agg(F.countDistinct("cell_id").alias("n"))
    kept = n.join(F.broadcast(threshold), F.col("n") >= F.col("least")).select("feature_id")
    return counts.join(kept, "feature_id", "left_semi")


def joint_filter(counts: DataFrame, special: Column, min_features: int, max_features: int, min_counts: float, max_special: float, min_cells: int, min_feature_counts: float) -> DataFrame:
    """Cells and features judged on the unfiltered counts, then both filters at once."""
    cells = cell_metrics(counts, special).where(F.col("n_features").between(min_features, max_features) & (F.col("total") >= min_counts) & (F.col("pct_special") <= max_special))
    features = counts.where("value > 0").groupBy("feature_id").agg(F.countDistinct("cell_id").alias("n"), F.sum("value").alias("total")).where((F.col("n") >= min_cells) & (F.col("total") >= min_feature_counts))
    return counts.join(cells.select("cell_id"), "cell_id", "left_semi").join(features.select("feature_id"), "feature_id", "left_semi")


def imbalance(cells: DataFrame, cluster: str, modality: str, least: float = 0.05) -> DataFrame:
    """cluster, balance, kept: balance is the least over modalities of the cluster's share of a modality over the modality's share of all."""
    total = cells.count()
    share = cells.groupBy(modality).agg((F.count("*") / F.lit(float(max(1, total)))).alias("expected"))
    sizes = cells.groupBy(cluster).agg(F.count("*").alias("size"))
    seen = cells.groupBy(cluster, modality).agg(F.count("*").alias("n"))
    grid = sizes.join(F.broadcast(share)).join(seen, [cluster, modality], "left")
    return grid.groupBy(cluster).agg(F.min(F.coalesce(F.col("n"), F.lit(0)) / F.col("size") / F.col("expected")).alias("balance")).withColumn("kept", F.col("balance") >= least)


def hashed(prefix: int, numbers: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of some columns and a long, from its value for those columns."""
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.array([prefix], np.int64).view(np.uint64) + p5 + np.uint64(8)
    h = turn(h ^ (turn(numbers.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs laid end to end."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Cells:
    """Cells of a sample from place `first` on: ids, and entries by cell, then by feature."""

    def __init__(self, pieces: list[bytes], first: int):
        table = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in pieces]).sort_by("at").combine_chunks()
        x = table.column("x").combine_chunks()
        self.first, self.n, self.ids = first, len(table), table.column("cell_id").combine_chunks()
        self.sizes = pc.list_value_length(x).to_numpy().astype(np.int64)
        inner, row = x.flatten(), np.repeat(np.arange(self.n), self.sizes)
        f, v = (inner.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        order = np.lexsort((f, row))
        self.f, self.v, self.starts = f[order], v[order], np.cumsum(self.sizes) - self.sizes

    def entries(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature and value of the entries of the cells at these places in the sample."""
        own = places - self.first
        at = runs(self.starts[own], self.sizes[own])
        return np.repeat(np.arange(len(own)), self.sizes[own]), self.f[at], self.v[at]

    def copies(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of cells with the same entries one each, and for every place the number of its own among these."""
        own = places - self.first
        kind = np.add.reduceat(self.marks(), self.starts)[own]
        order = np.argsort(kind, kind="stable")
        new = np.append(True, kind[order][1:] != kind[order][:-1])
        like = np.empty(len(own), np.int64)
        like[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        # The marks only say which to compare.
        same = self.sizes[own] == self.sizes[own[like]]
        sizes = np.where(same, self.sizes[own], 0)
        a, b = runs(self.starts[own], sizes), runs(self.starts[own[like]], sizes)
        wrong = np.repeat(np.arange(len(own)), sizes)[(self.f[a] != self.f[b]) | (self.v[a] != self.v[b])]
        same[wrong] = False
        like = np.where(same, like, np.arange(len(own)))
        one, number = np.unique(like, return_inverse=True)
        return places[one], number

    def marks(self) -> np.ndarray:
        x = (self.f.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(32)) ^ self.v.view(np.uint64)) * np.uint64(0x9E3779B185EBCA87)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)


def log_normalised(row: np.ndarray, column: np.ndarray, v: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value, by row, equal columns of a row summed."""
    entry, which = np.unique(row * width + column, return_inverse=True)
    value, row = np.bincount(which, v, len(entry)), entry // width
    return row, entry % width, np.log1p(1e4 * value / np.maximum(np.bincount(row, value, n), 1e-12)[row])


class Pool:
    """Some of the cells and doublets that others are compared with: postings by feature, and squared lengths."""

    def __init__(self, ids: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray], width: int):
        row, column, value = log_normalised(*entries, len(ids), width)
        self.ids, self.size = ids, -(-max(1, len(ids)) // 64) * 64
        self.length = np.full(self.size, np.inf)
        length = np.bincount(row, value**2, len(ids))
        self.length[: len(ids)] = np.where(np.isfinite(length), length, np.inf)  # the others are near to nothing
        kept = np.isfinite(self.length[row])
        row, column, value = row[kept], column[kept], value[kept]
        order = np.argsort(column, kind="stable")
        self.row, self.value = row[order], value[order]
        self.ends = np.cumsum(np.bincount(column, minlength=width)).tolist()

    def near(self, columns: list[int], values: list[float], length: float, k: int, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of the k nearest to a row, of all that are as near as the last, and at times of some more; none above most."""
        spans = [(self.ends[c - 1] if c else 0, self.ends[c], v) for c, v in zip(columns, values, strict=True)]
        d = np.bincount(np.concatenate([self.row[i:j] for i, j, _ in spans]), np.concatenate([self.value[i:j] * v for i, j, v in spans]), self.size).astype(float, copy=False)  # whole numbers if there is nothing to add
        d *= -2
        d += self.length
        # Columns of 64: the k-th of their least values is no less than the k-th of all.
        d = d.reshape(64, -1)
        least = d.min(axis=0)
        cut = most - length
        if len(least) >= k:
            cut = min(cut, np.partition(least, k - 1)[k - 1])
        cut += 2e-9
        column = np.flatnonzero(least <= cut)
        if not len(column):
            return self.ids[:0], self.length[:0]
        d = d[:, column]
        i, j = np.nonzero((d <= cut) & (d < np.inf))
        return self.ids[i * len(least) + column[j]], np.round(d[i, j] + length, 9)


def doublet_scores(counts: DataFrame, sample: DataFrame, n_simulated: float = 2.0, k: int = 10, seed: int = 42, block: int = 1 << 19, chunk: int = 1 << 16) -> DataFrame:
    """cell_id, score: per sample, the share of simulated sums of two cells among a cell's k nearest, on log-normalised features.

    Every cell of a sample meets all its cells and simulated doublets. A sample's cells stand packed in a row; a task takes a slice of the cells of one block,
    makes the doublets of two blocks, and adds up products over postings by feature, so only features that both have cost anything. Cells with the same
    entries are in one slice and are compared once. A task holds three blocks of cells and a chunk of doublets. Equal distances (to 9 places) go to the real cell first,
    then by place, so the scores don't depend on blocks, slices or chunks.
    """
    # Groups hold the cell's id as the join has dealt it, so only the join shuffles entries; ids become text after.
    long = counts.join(sample.select("cell_id", "sample").where("sample is not null"), "cell_id").groupBy("sample", "cell_id", F.xxhash64("feature_id").alias("f")).agg(F.sum(F.col("value").cast("double")).alias("v"))
    cells = long.groupBy("sample", "cell_id").agg(F.collect_list(F.struct("f", "v")).alias("x")).withColumn("cell_id", F.col("cell_id").cast("string"))
    at = F.row_number().over(Window.partitionBy("sample").orderBy("cell_id")).cast("long") - 1
    each = min(block, 8192)
    prefix = [F.xxhash64(F.lit(seed), F.lit(side), "sample").alias(side) for side in "ab"]
    placed = cells.withColumn("at", at).select(F.col("sample").cast("string").alias("sample"), *prefix, "at", "cell_id", "x")
    keys = ["sample", "a", "b"]

    def pack(group: pa.Table) -> pa.Table:
        own, sink = group.select(["at", "cell_id", "x"]), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(own)
        head = {c: group.column(c)[:1] for c in keys}
        return pa.table(head | {"block": [pc.min(group.column("at")).as_py() // block], "n": [len(group)], "piece": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    pieces = placed.groupBy(*keys, F.floor(F.col("at") / block).alias("k"), F.floor(F.col("at") % block / each).alias("p")).applyInArrow(pack, "sample string, a long, b long, block long, n long, piece binary")
    sized = pieces.groupBy(*keys, "block").agg(F.sum("n").alias("n"), F.collect_list("piece").alias("pieces")).groupBy(*keys).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("block", "pieces"))).alias("of"))
    # As many slices as keep the cores busy; each makes its doublets anew.
    slices = F.greatest(F.least(F.ceil(F.least(F.col("n"), F.lit(block)) / 8192), F.lit(8)), F.ceil(F.least(F.col("n"), F.lit(block)) / 65536)).cast("int")
    last = F.floor((F.col("n") - 1) / block)
    tasks = sized.withColumn("slices", slices)
    for name in ("k_a", "k_b", "k_q"):
        tasks = tasks.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    tasks = tasks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    held = [F.col("of")[F.col("k_a")].alias("p_a"), F.when(F.col("k_b") != F.col("k_a"), F.col("of")[F.col("k_b")]).alias("p_b"), F.when((F.col("k_q") != F.col("k_a")) & (F.col("k_q") != F.col("k_b")), F.col("of")[F.col("k_q")]).alias("p_q")]
    # A batch of 10,000 such rows would not fit beside the heap.
    spark = counts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    tasks = tasks.select("sample", "a", "b", "n", "slices", "slice", "k_a", "k_b", "k_q", *held).repartition(max(96, int(spark.conf.get("spark.sql.shuffle.partitions"))), "sample", "k_a", "k_b", "k_q", "slice")

    def meet(row: dict) -> pa.RecordBatch:
        n, k_a, k_b, k_q = row["n"], row["k_a"], row["k_b"], row["k_q"]
        blocks = {k_a: Cells(row["p_a"], k_a * block)}
        blocks |= {number: Cells(row[name], number * block) for number, name in ((k_b, "p_b"), (k_q, "p_q")) if row[name] is not None}
        names = np.unique(np.concatenate([c.f for c in blocks.values()]))
        for c in blocks.values():
            c.f = np.searchsorted(names, c.f)
        a, b, q, width = blocks[k_a], blocks[k_b], blocks[k_q], len(names)
        # The names of features, not their numbers, say in which slice a cell is: all blocks agree.
        q.f, own = names[q.f], q.f
        slice_of = np.add.reduceat(q.marks(), q.starts) % np.uint64(row["slices"])
        q.f = own
        mine = q.first + np.flatnonzero(slice_of == np.uint64(row["slice"]))
        if not len(mine):
            return pa.RecordBatch.from_pylist([], pa.schema([("sample", pa.string()), ("cell_id", pa.string()), ("id", pa.int64()), ("d", pa.float64()), ("share", pa.float64())]))
        ones, number = q.copies(mine)
        r, c, v = log_normalised(*q.entries(ones), len(ones), width)
        length, cut = np.bincount(r, v**2, len(ones)), np.searchsorted(r, np.arange(len(ones) + 1)).tolist()
        c, v = c.tolist(), v.tolist()
        # One more than k, as a cell is among its own.
        d, ids = np.full((len(ones), k + 1), np.inf), np.full((len(ones), k + 1), -1)
        ends = n + max(1, int(np.floor(n * float(n_simulated))))
        for begin in range(0, ends, chunk):
            some = np.arange(begin, min(ends, begin + chunk))
            real, made = some[some < n], some[some >= n]
            real = real[(real >= a.first) & (real < a.first + a.n)] if k_a == k_b else real[:0]
            one, other = (hashed(row[side], made - n) % n for side in "ab")
            here = (one >= a.first) & (one < a.first + a.n) & (other >= b.first) & (other < b.first + b.n)
            made, one, other = made[here], one[here], other[here]
            if not len(real) + len(made):
                continue
            x, y, z = a.entries(real), a.entries(one), b.entries(other)
            pool = Pool(np.append(real, made), (np.concatenate([x[0], y[0] + len(real), z[0] + len(real)]), *(np.concatenate(e) for e in zip(x[1:], y[1:], z[1:], strict=True))), width)
            for i in np.flatnonzero(np.isfinite(length)).tolist():
                found, far = pool.near(c[cut[i] : cut[i + 1]], v[cut[i] : cut[i + 1]], length[i], k + 1, d[i, k])
                if len(found):
                    far, found = np.append(d[i], far), np.append(ids[i], found)
                    best = np.lexsort((found, far))[: k + 1]
                    d[i], ids[i] = far[best], found[best]
        d, ids = d[number], ids[number]
        kept = np.isfinite(d) & (ids != mine[:, None])
        kept &= np.cumsum(kept, axis=1) <= k
        names = q.ids.take(pa.array(mine - q.first))
        if n <= block:  # the task has met the whole sample
            some = np.flatnonzero(kept.any(axis=1))
            share = ((ids >= n) & kept).sum(axis=1)[some] / kept.sum(axis=1)[some]
            far, found = np.zeros(len(some)), np.zeros(len(some), np.int64)
        else:
            some, at = np.nonzero(kept)
            far, found = d[some, at], ids[some, at]
            share = (found >= n).astype(float)
        return pa.RecordBatch.from_arrays([pa.array([row["sample"]] * len(some), pa.string()), names.take(pa.array(some)), pa.array(found), pa.array(far), pa.array(share)], ["sample", "cell_id", "id", "d", "share"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield meet(batch.slice(i, 1).to_pylist()[0])

    part = tasks.mapInArrow(run, "sample string, cell_id string, id long, d double, share double")
    order = Window.partitionBy("sample", "cell_id").orderBy("d", "id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("sample", "cell_id").agg(F.avg("share").alias("score")).select("cell_id", "score")


def sample_level_columns(cells: DataFrame, sample: str, columns: list[str]) -> DataFrame:
    """column, sample_level: whether every sample has at most one distinct value. One pass for all columns."""
    per = cells.groupBy(sample).agg(*[F.countDistinct(c).alias(c) for c in columns])
    most = per.agg(*[F.max(c).alias(c) for c in columns])
    return most.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) <= 1).alias("sample_level")) for c in columns])).alias("x")).select("x.*")


def classify_columns(units: DataFrame, columns: list[str], categorical_max: int = 10) -> DataFrame:
    """column, n_distinct, kind: categorical, continuous or dropped, by type and number of values."""
    n = units.count()
    counted = units.agg(*[F.countDistinct(c).alias(c) for c in columns])
    kinds = dict(units.dtypes)

    def kind(c):
        d = F.col(c)
        if kinds[c] == "boolean":
            return F.when(d >= 2, "categorical").otherwise("dropped")
        if kinds[c] in ("float", "double"):
            return F.when(d < 2, "dropped").when((d > categorical_max) | (d > max(5, 0.3 * n)), "continuous").otherwise("categorical")
        if kinds[c] == "string":
            return F.when((d >= 2) & (d <= max(10, int(0.5 * n) + 1)), "categorical").otherwise("dropped")
        return F.when(d < 2, "dropped").when(d > categorical_max, "continuous").otherwise("categorical")

    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_distinct"), kind(c).alias("kind")) for c in columns])).alias("x")).select("x.*")


def varying_features(values: DataFrame, least: float = 1e-6) -> DataFrame:
    """Rows of the features whose sample variance reaches least; values: unit, feature_id, value, zeros present."""
    kept = values.groupBy("feature_id").agg(F.var_samp("value").alias("v")).where(F.col("v") >= least)
    return values.join(kept.select("feature_id"), "feature_id", "left_semi")


def batch_subset(cells: DataFrame, listed: DataFrame, batch: str, sample: str = "sample") -> DataFrame:
    return cells.join(listed.where(F.col("batch") == batch).select(sample).distinct(), sample, "left_semi")


def split_by_value(cells: DataFrame, column: str, value: str) -> tuple[DataFrame, DataFrame]:
    same = F.coalesce(F.lower(F.trim(F.col(column))) == value.strip().lower(), F.lit(False))
    return cells.where(same), cells.where(~same)


def nonzero_features(counts: DataFrame, celltype: str = "celltype") -> DataFrame:
    """celltype, feature_id of the features that any cell of the type has."""
    return counts.groupBy(celltype, "feature_id").agg(F.max((F.col("value") != 0).cast("int")).alias("any")).where("any = 1").drop("any")


def informative_features(means: DataFrame, quantile: float, top: int) -> DataFrame:
    """feature_id, variance, rank: with any sample mean above the global quantile; the top by variance of the means."""
    from pyspark.sql import Window

    cut = means.agg(F.percentile("mean", quantile).alias("cut"))
    kept = means.join(F.broadcast(cut)).groupBy("feature_id").agg(F.max(F.col("mean") > F.col("cut")).alias("any"), F.var_samp("mean").alias("variance")).where("any")
    order = Window.orderBy(F.desc("variance"), "feature_id")
    # The top is taken by a sort with a limit first, so the numbering sees `top` rows only.
    return kept.orderBy(F.desc("variance"), "feature_id").limit(top).select("feature_id", "variance", F.row_number().over(order).alias("rank"))


def align_layers(processed: DataFrame, raw: DataFrame) -> DataFrame:
    """processed with the raw value beside it; fails if any processed entry has no raw one."""
    missing = processed.join(raw, ["cell_id", "feature_id"], "left_anti").limit(1).count()
    if missing:
        raise ValueError("processed entries are missing from the raw layer")
    return processed.join(raw.withColumnRenamed("value", "raw"), ["cell_id", "feature_id"])


#: Columns that earlier steps left and that are no variables of the samples.
INTERNAL = (r"^pseudotime(_.*)?$", r"^cluster_.*_kmeans$", r"^X_DR_.*$", r"^_")


def variable_columns(columns: list[str], internal: tuple[str, ...] = INTERNAL) -> list[str]:
    return [c for c in columns if not any(re.match(p, c) for p in internal)]


def data_types(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, kind, n_distinct: categorical if at most 80 % of the known values are numbers, or they are 0 and 1 alone; ordinal if they are whole, at most
    10 different ones and fewer than a tenth of the rows; else numerical. 0 and 1 count as categorical under the same two limits. One pass."""
    aggregates = []
    for i, c in enumerate(columns):
        text = F.col(f"`{c}`").cast("string")
        number = F.when(~F.isnan(text.try_cast("double")), text.try_cast("double"))
        known = text.isNotNull() & ~F.coalesce(F.isnan(text.try_cast("double")), F.lit(False))
        aggregates += [F.count(F.when(known, 1)).alias(f"n{i}"), F.count(number).alias(f"m{i}"), F.countDistinct(F.when(known, text)).alias(f"d{i}"), F.countDistinct(number).alias(f"e{i}"), F.coalesce(F.bool_and(number.isin(0.0, 1.0)), F.lit(False)).alias(f"b{i}"), F.coalesce(F.bool_and(F.pmod(number, F.lit(1.0)) == 0), F.lit(False)).alias(f"w{i}")]

    def kind(i):
        n, m, d = (F.col(f"{x}{i}") for x in "nmd")
        small = (d <= 10) & (d < 0.1 * n)
        return F.when((n == 0) | (m <= 0.8 * n), "categorical").when(small & F.col(f"b{i}") & (F.col(f"e{i}") == 2), "categorical").when(small & F.col(f"w{i}"), "ordinal").otherwise("numerical")

    items = [F.struct(F.lit(c).alias("column"), kind(i).alias("kind"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(columns)]
    return rows.agg(*aggregates).select(F.explode(F.array(*items)).alias("x")).select("x.*")
