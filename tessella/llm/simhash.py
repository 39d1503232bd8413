"""SimHash near copies, found by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits (r even) share a variant that is at most r/2 bits from each, and two that share
such a variant differ in at most r: so every fingerprint emits all variants within r/2 bits, variants are shuffled, and equal ones
name the colliding pairs, which are deduplicated and verified.

The 2,081 variants of r = 4 would be some hundred times the input. A variant's bucket is a linear hash over bits, so the bucket of
`fingerprint xor mask` is `bucket(fingerprint) xor bucket(mask)`: a fingerprint travels once to each bucket that one of its variants
falls in, and the bucket's task makes exactly the variants that belong to it, in rounds of bounded size. The collisions are those of
sending each variant. Within a variant all are linked to the least one (a star, not all pairs); each bucket reduces its links to a
spanning forest, and star contraction over tables joins the forests.

Defined cases: no words, null included: fingerprint zero, linked like any other; fewer words than a shingle: one shingle of all; rows
that share an id are one node of the graph; a null id takes its group's least id; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, per_text, rows, small_batches

#: Variants that one task makes, and that it holds at a time.
PER_TASK, PER_ROUND = 128 << 20, 1 << 21


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned; a bit is set if it is in over half of the shingles' hashes."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = list(accumulate(len(x) + 1 for x in w))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[words - 1 :], strict=False)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id, fp: the fingerprint as the signed long of the same bits."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def one(text):
        x = fingerprint(text, words)
        return (x - (1 << 64) if x >> 63 else x,)

    return source.mapInArrow(per_text(one, [("fp", pa.int64())]), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def linear_hash(x: np.ndarray) -> np.ndarray:
    """30 bits, linear over xor: the xor of a constant for each set bit."""
    return np.bitwise_xor.reduce([t[(x >> np.uint64(8 * k)) & np.uint64(255)] for k, t in enumerate(_byte_tables())], axis=0)


@cache
def _byte_tables() -> list[np.ndarray]:
    of_bit = [xxhash.xxh32_intdigest(bytes([i])) & ((1 << 30) - 1) for i in range(64)]
    made = []
    for k in range(8):
        t = np.zeros(256, np.int64)
        for i in range(8):
            t[np.arange(256) >> i & 1 == 1] ^= of_bit[8 * k + i]
        made.append(t)
    return made


@cache
def ball(radius: int) -> np.ndarray:
    """All 64-bit masks with at most so many bits."""
    layers = [np.zeros(1, np.uint64)]
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    last = {0: -1}
    for _ in range(radius):
        last = {m | int(bits[j]): j for m, i in last.items() for j in range(i + 1, 64)}
        layers.append(np.fromiter(last, np.uint64, len(last)))
    return np.concatenate(layers)


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of n nodes' components."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            return label


def collisions(fps: np.ndarray, bucket: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links among fps that show in this bucket: pairs (member, its component's least)."""
    masks = ball(radius // 2)
    more = 0
    while len(fps) * len(masks) >> (bits + more) > PER_ROUND and bits + more < 30:
        more += 1
    full = (1 << (bits + more)) - 1
    fps = np.sort(fps)
    of_fp, of_mask = linear_hash(fps) & full, linear_hash(masks) & full
    by_fp, by_mask = np.argsort(of_fp, kind="stable"), np.argsort(of_mask, kind="stable")
    of_fp = of_fp[by_fp]
    kinds, first = np.unique(of_mask[by_mask], return_index=True)
    groups = np.split(masks[by_mask], first[1:])
    links = [np.zeros((0, 2), np.int64)]
    for turn in range(1 << more):
        want = (turn << bits | bucket) ^ kinds
        lo, hi = np.searchsorted(of_fp, want), np.searchsorted(of_fp, want, "right")
        made = [(by_fp[i:j], g) for i, j, g in zip(lo, hi, groups, strict=True) if i < j]
        if not made:
            continue
        variant = np.concatenate([(fps[at][:, None] ^ g[None, :]).ravel() for at, g in made])
        ordered = np.sort(variant)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            continue
        twice = twice[np.append(True, twice[1:] != twice[:-1])]
        short = lambda v: (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        maybe = np.zeros(1 << 20, bool)
        maybe[short(twice)] = True
        at = np.flatnonzero(maybe[short(variant)])
        k = np.searchsorted(twice, variant[at])
        hit = (k < len(twice)) & (twice[np.minimum(k, len(twice) - 1)] == variant[at])
        at, k = at[hit], k[hit]
        member = np.concatenate([np.repeat(x, len(g)) for x, g in made])[at]
        order = np.lexsort((member, k))
        member, k = member[order], k[order]
        starts = np.append(True, k[1:] != k[:-1])
        least = member[starts][np.cumsum(starts) - 1]
        pairs = np.unique(np.stack([least, member], axis=1)[least != member], axis=0)
        links.append(pairs[np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= radius])
        if sum(map(len, links)) > 4 * len(fps) + 1000:
            links = [forest(np.concatenate(links), len(fps))]
    tree = forest(np.concatenate(links), len(fps))
    return fps[tree[:, 1]], fps[tree[:, 0]]


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """(least, member) of each component of more than one."""
    label = local_components(pairs[:, 0], pairs[:, 1], n)
    member = np.flatnonzero(label != np.arange(n))
    return np.stack([label[member], member], axis=1)


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp): edges that connect all that are within radius bits, through others if need be."""
    if radius % 2:
        raise ValueError("the radius must be even: half of it goes to each side")
    n = nodes.count()
    bits = 4
    while n * len(ball(radius // 2)) >> bits > PER_TASK and bits < 30:
        bits += 1

    def send(batches):
        to = np.unique(linear_hash(ball(radius // 2)) & ((1 << bits) - 1))
        for batch in rows(batches, 1 << 20):
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            own = linear_hash(fps) & ((1 << bits) - 1)
            order = np.argsort(own, kind="stable")
            classes, first = np.unique(own[order], return_index=True)
            packs: dict[int, list[bytes]] = {}
            for c, part in zip(classes, np.split(fps[order], first[1:]), strict=True):
                raw = part.astype("<u8").tobytes()
                for bucket in (to ^ c).tolist():
                    packs.setdefault(bucket, []).append(raw)
            if packs:
                yield pa.RecordBatch.from_arrays([pa.array(list(packs), pa.int32()), pa.array([b"".join(x) for x in packs.values()], pa.binary())], ["bucket", "fps"])

    def meet(key, groups):
        fps = np.frombuffer(b"".join(x for g in groups for x in g.column("fps").to_pylist()), "<u8")
        a, b = collisions(fps, key[0].as_py(), bits, radius)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def meet_table(key, group):
        return pa.Table.from_batches(list(meet(key, [group])))

    return nodes.select("fp").mapInArrow(send, "bucket int, fps binary").groupBy("bucket").applyInArrow(meet_table, "a long, b long").distinct()


def components(edges: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """(node, root): of the nodes that have an edge, all but each component's least. Alternating star contraction.

    Each half round sends every neighbour of a node to the least one, by an aggregate and a join; a written table cuts the lineage. like: a
    written table that the edges are not much larger than.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", like)
    seen = None
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        after = materialize(small, "edges", edges)
        now = tuple(after.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())
        drop(edges)
        edges = after
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def near_copies(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the least id that links reach, its own included)."""
    marked = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints", docs)
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes", marked)
    # Rows that share an id join their fingerprints' components too.
    shared = marked.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    same = marked.join(shared.select("doc_id", "x"), "doc_id").select(F.col("fp").alias("a"), F.col("x").alias("b"))
    tree = components(links(nodes, radius).unionAll(same), nodes)
    rooted = nodes.join(tree, nodes.fp == tree.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written, so that both sides of the joins below stand on plain exchanges, whose large partitions (a large component, a frequent fingerprint)
    # Spark can split.
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least", nodes)
    part = materialize(rooted.join(least, "root").select("fp", "component_id"), "parts", nodes)
    drop(nodes, tree, least)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(part, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """The rows of documents, all columns, whose id is their component's least. Rows that share an id are one document: they stay
    or go together. Rows without an id stay: nothing ranks them."""
    found = near_copies(docs, radius, words)
    out = found.where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(out, docs["doc_id"] == out["__gone"], "left_anti")
