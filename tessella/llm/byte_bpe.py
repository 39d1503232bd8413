"""Byte-level BPE over a corpus by a global distinct-word shuffle.

Scan tasks explode texts into words (units that the pattern surely parts) and keep, per block of documents, each word's positions; a block's
distinct words, and nothing else, are shuffled by the word's hash. There each distinct word is encoded once, every match of the pattern separately,
and its ids return to the blocks that asked. The block's positions then put each document together. Decoding joins the ids
with the table of token bytes.

Words, ids and positions are shuffled as packed, compressed columns of a block rather than as a row per word: a common word costs one
record per block, so neither hot words nor long documents gather in a task. A block is bounded by its bytes (one document at least). A bucket is one
task, which encodes a word for the first block that has it and looks it up for the others; beyond KNOWN words, which takes some 50 TB of text whose
words hardly recur, those that no block shared so far are encoded again.

The positions and the words of a block come from two passes over the same scan, so the scan must give the same rows in the same order; a
file scan does, and any other plan is written to the shared folder first. A checksum of the words, sent with both, is compared in the end.

Defined cases: a null or empty text has no ids; rows that share an id are encoded one by one; a null id stays null; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import gather, materialize, partitions, rows, small_batches
from .pieces import Memo, split, text_of

#: Text bytes of a block, about, and of a bucket of words; the most buckets, and the distinct words of a bucket that are known at a time.
BLOCK, PER_BUCKET, MOST, KNOWN = 4 << 20, 16 << 20, 16_384, 2_000_000


_KINDS = ("<u1", "<u2", "<u4", "<u8", "<i8")


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, compressed, each with its type and length."""
    parts = []
    for a in arrays:
        kind = next(k for k, t in enumerate(_KINDS) if not len(a) or np.iinfo(t).min <= a.min() and a.max() <= np.iinfo(t).max)
        parts += [np.array([len(a), kind], "<i8").tobytes(), a.astype(_KINDS[kind]).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unsqueeze(raw: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(data):
        n, kind = np.frombuffer(data, "<i8", 2, at)
        a = np.frombuffer(data, _KINDS[kind], n, at + 16)
        out.append(a)
        at += 16 + a.nbytes
    return out


def blocks(batches, size: int = BLOCK):
    """Lists of (ids, texts) of about so many text bytes."""
    ids, texts, held = [], [], 0
    for batch in rows(batches, 1 << 20):
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            held += len(texts[-1])
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def index(texts: list[str], buckets: int):
    """The distinct words in order of bucket, their buckets, each text's number of words, all positions as word numbers, a checksum."""
    distinct, seq, lengths = split(pa.array(texts, pa.string()))
    raw = distinct.cast(pa.binary()).to_pylist()
    bucket = np.fromiter((zlib.crc32(r) % buckets for r in raw), np.int64, len(raw))
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(raw), np.int64)
    rank[order] = np.arange(len(raw))
    raw = [raw[i] for i in order]
    return raw, bucket[order], lengths, rank[seq], zlib.crc32(b"\0".join(raw))


_encoders: dict = {}


def tokenizer(ranks_raw: bytes, pattern: str):
    """A worker's own encoding by the rank file."""
    key = (zlib.crc32(ranks_raw), pattern)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_raw.splitlines())}
        one = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        _encoders[key] = lambda new, _: [np.array(one(text_of(w.decode())), "<u4").tobytes() for w in new]
    return _encoders[key]


class Table:
    """Strings of bytes by id, laid end to end."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The strings of ids[:ends[0]], ids[ends[0]:ends[1]], ... each joined; about half a million ids at a time."""
        out, i, begins = [], 0, np.concatenate([[0], ends[:-1]])
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, begins[i] + (1 << 19), "right")))
            at, stops = gather(self.starts, self.lengths, ids[begins[i] : ends[j - 1]])
            raw = self.data[at].tobytes()
            cuts = np.concatenate([[0], stops])[np.concatenate([begins[i : i + 1], ends[i:j]]) - begins[i]]
            out += [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            i = j
        return out


_tables: dict = {}


def token_bytes(ranks_raw: bytes) -> Table:
    key = zlib.crc32(ranks_raw)
    if key not in _tables:
        by_id = {int(b): base64.b64decode(a) for a, b in map(bytes.split, ranks_raw.splitlines())}
        _tables[key] = Table([by_id.get(i, b"") for i in range(max(by_id) + 1)])
    return _tables[key]


@cache
def decimals(n: int) -> Table:
    return Table([b"%d," % i for i in range(n)])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, finish=None, schema: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every row; or what finish(doc ids as an Arrow array, ids, ends) makes of a block, under schema."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # one rank file
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    if not repeatable(docs):
        source = materialize(source, "texts")
    # So many that a bucket's words come from some PER_BUCKET bytes of text; no more than MOST, as each block sends a record to each.
    parts = buckets or max(16, min(MOST, partitions(source, PER_BUCKET)))

    def block_id(k):
        return TaskContext.get().partitionId() << 32 | k

    def positions(batches):
        for k, (ids, texts) in enumerate(blocks(batches)):
            _, bucket, lengths, seq, check = index(texts, parts)
            payload = squeeze(lengths, seq, np.array([check]))
            yield pa.RecordBatch.from_arrays([pa.array([block_id(k)]), pa.array([ids], pa.list_(kind_of)), pa.array([payload], pa.binary())], ["block", "doc_ids", "payload"])

    def words(batches):
        for k, (_, texts) in enumerate(blocks(batches)):
            raw, bucket, _, _, check = index(texts, parts)
            kinds, first = np.unique(bucket, return_index=True)
            made = []
            for b, i, j in zip(kinds.tolist(), first.tolist(), [*first[1:].tolist(), len(raw)], strict=True):
                made.append((b, block_id(k), check, zstandard.ZstdCompressor(level=3).compress(np.array([len(r) for r in raw[i:j]], "<u4").tobytes() + b"".join(raw[i:j])), j - i))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)], ["bucket", "block", "check", "words", "n"])

    def encode_words(batches):
        memo = Memo(tokenizer(sent.value, pattern), KNOWN)  # a bucket's own: no other task sees its words
        for batch in batches:
            out = []
            for b, block, check, packed, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = zstandard.ZstdDecompressor().decompress(packed)
                ends = 4 * n + np.cumsum(np.frombuffer(data, "<u4", n)).astype(np.int64)
                cuts = [4 * n, *ends.tolist()]
                own = [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
                ids = memo.of(own)
                out.append((b, block, check, squeeze(np.array([len(x) // 4 for x in ids], np.int64), np.frombuffer(b"".join(ids), "<u4"))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "block", "check", "ids"])

    def plain(doc_ids, ids, ends):
        return [doc_ids, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))]

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        lengths, seq, check = unsqueeze(left.column("payload")[0].as_py())
        right = right.sort_by("bucket")
        if any(c != check[0] for c in right.column("check").to_pylist()):
            raise RuntimeError("the scan gave other rows the second time; write the input to a table first")
        parts = [unsqueeze(x) for x in right.column("ids").to_pylist()]
        sizes = np.concatenate([p[0] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        flat = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint32)
        at, stops = gather(np.cumsum(sizes) - sizes, sizes, seq)
        ends = np.concatenate([[0], stops])[np.cumsum(lengths.astype(np.int64))] if len(lengths) else np.zeros(0, np.int64)
        doc_ids = left.column("doc_ids").combine_chunks().flatten()
        arrays = (finish or plain)(doc_ids, flat[at], ends)
        return pa.Table.from_arrays(arrays, names)

    out_schema = f"doc_id {kind}, " + (schema or "ids array<int>")
    names = [x.split()[0] for x in out_schema.split(", ")]
    kind_of = to_arrow_type(source.schema["doc_id"].dataType)
    where = source.mapInArrow(positions, f"block long, doc_ids array<{kind}>, payload binary")
    asked = source.mapInArrow(words, "bucket int, block long, check long, words binary, n int").repartitionById(parts, F.col("bucket"))
    answered = asked.mapInArrow(encode_words, "bucket int, block long, check long, ids binary")
    return where.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(assemble, out_schema)


def repeatable(docs: DataFrame) -> bool:
    """Whether the plan is a file scan with at most projections and filters above it."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() in ("LogicalRelation",) or plan.nodeName().startswith("Relation")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, decoded (binary) of rows of doc_id, ids."""
    spark = encoded.sparkSession
    with open(ranks_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches):
        table = token_bytes(sent.value)
        for batch in rows(batches):
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(table.join(lists.flatten().to_numpy(zero_copy_only=False), ends), pa.binary())], ["doc_id", "decoded"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, decoded binary")


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes that the ids decode to)."""
    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def finish(doc_ids, ids, ends):
        table = token_bytes(sent.value)
        texts = [sha(x[:-1]) for x in decimals(len(table.lengths)).join(ids, ends)]
        return [doc_ids, pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(texts, pa.string()), pa.array([sha(x) for x in table.join(ids, ends)], pa.string())]

    return encode(docs, ranks_path, pattern, finish=finish, schema="n_tokens long, ids_sha256 string, decoded_sha256 string")
