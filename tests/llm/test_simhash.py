import re
from collections import Counter

import numpy as np
import xxhash

from tessella.llm import simhash


def plain(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=4):
    """id -> least reachable id."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    first = {}
    for i, f in rows:
        if f != f or i is not None:
            for g in {f, *[x for j, x in rows if j == i and i is not None]}:
                root[find(g)] = find(f)
    for i, f in rows:
        if i is not None:
            first[find(f)] = min(first.get(find(f), i), i)
    return Counter((i, f"{f:016x}", first.get(find(f))) for i, f in rows)


def test_fingerprints_of_odd_texts():
    for t in ("", None, " \n", "One", "a b c", "A b C d", "é É a b c d e\x0bf", "x " * 5000, "\x85 b c d e"):
        assert simhash.fingerprint(t) == plain(t)


def test_components_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(5000, None), (5001, ""), (5002, "a b"), (5002, "c d e f g"), (None, "a b"), (None, "quite another text of words")], "doc_id long, text string")
    rows = [(r[0], plain(r[1])) for r in docs.unionByName(extra).collect()]
    got = simhash.near_copies(docs.unionByName(extra)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)
    assert simhash.near_copies(extra.limit(0)).count() == 0


def test_collisions_connect_what_is_near(monkeypatch):
    """Clusters of every distance up to the radius, in every bucket and in many rounds."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(map(int, base))
    for b in base[:40]:
        x = int(b)
        for d in (1, 2, 3, 4, 4, 5):
            x ^= sum(1 << int(i) for i in rng.choice(64, d, replace=False))
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    monkeypatch.setattr(simhash, "PER_ROUND", 5000)
    for bits in (0, 2, 5):
        edges = [simhash.collisions(fps, bucket, bits, 4) for bucket in range(1 << bits)]
        a, b = (np.searchsorted(fps, np.concatenate(x)) for x in zip(*edges, strict=True))
        assert (np.bitwise_count(fps[a] ^ fps[b]) >= 1).all()
        near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
        want = simhash.local_components(*np.nonzero(near), len(fps))
        assert (simhash.local_components(a, b, len(fps)) == want).all()


def test_star_contraction(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = simhash.local_components(*np.array(pairs).T, 1100)
    assert got == {i: int(r) for i, r in enumerate(label) if r != i}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_first_keeps_one_of_each(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    least = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == sorted(set(least.values()))
