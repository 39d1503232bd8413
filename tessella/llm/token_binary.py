"""Token ids as binary shards with Elias-Fano document boundaries.

Documents are range-sorted by id; each task encodes its part and writes shards: the ids of all its documents laid end to end, two bytes each if
the vocabulary allows it, and the documents' ends and their ids as Elias-Fano sequences with select samples instead of tables of 64-bit numbers. A
shard is written beside its place and moved there, under a name that its partition gives, so a task that runs again writes the same file. The
manifest, a written table with a row per shard, gives each shard the number of ids before it: running sums over the parts, then over a part's shards.

Shard: magic, then 8-byte little-endian numbers (documents, documents without an id, ids, bytes per id, least document id, then of both sequences,
ends and document ids, universe and low bits; length of each part), then the parts: ids; of both sequences low bits, high bits, and as 4-byte numbers
the position of every 64th one in the high bits.

Texts are encoded as the library does by default: a control string of the tokenizer that stands in a text becomes its id.

Defined cases: a null text is empty and gives the end id alone; ids are whole numbers; rows without an id come first, rows that share one are ordered by
a hash of the text; an empty table gives an empty table and no shard; other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, gather, materialize, move_file, partitions, rows, scratch, small_batches
from .pieces import Memo, split, text_of

MAGIC = b"TESSEF02"
EVERY = 64
#: Ids that one task reads back, about.
IDS_PER_TASK = 4 << 20
#: Documents whose bounds are selected together.
TOGETHER = 8192
#: Ids of one shard, about; it is closed after the batch that reaches them.
SHARD_IDS = 4 << 20
#: Text bytes that are encoded together.
BATCH = 12 << 20


class EliasFano:
    """An ascending sequence of whole numbers below universe: low bits packed, high bits in unary, select by sampled ones."""

    def __init__(self, n: int, universe: int, width: int, low: bytes, high: bytes, sample: np.ndarray):
        self.n, self.universe, self.width, self.sample = n, universe, width, sample
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        v = values.astype(np.uint64)
        bits = (v[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, universe, width, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes(), ones[::EVERY].astype("<u4"))

    def select(self, i: int, j: int | None = None) -> np.ndarray:
        """The i-th to the j-th value, j left out (the i-th alone without j): from the nearest sampled one on to the next, no other part is read."""
        j = i + 1 if j is None else j
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.uint64)
        first, next_ = i // EVERY, (j - 1) // EVERY + 1
        begin = int(self.sample[first])
        end = int(self.sample[next_]) if next_ < len(self.sample) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin >> 3 : (end + 7) >> 3], bitorder="little")
        bits[: begin & 7] = 0
        ones = np.flatnonzero(bits)[i - first * EVERY : j - first * EVERY] + (begin & ~7)
        value = (ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            at = i * self.width
            low = np.unpackbits(self.low[at >> 3 : (j * self.width + 7) >> 3], bitorder="little")[at & 7 :][: (j - i) * self.width]
            value |= np.bitwise_or.reduce(low.reshape(j - i, self.width).astype(np.uint64) << np.arange(self.width, dtype=np.uint64), axis=1)
        return value

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.sample.tobytes()]


def pack(ids: list[bytes], ends: np.ndarray, doc_ids: list, width: int) -> bytes:
    """One shard's bytes; ids are the documents' encoded ids, ends their running number of ids."""
    n = int(ends[-1]) if len(ends) else 0
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    own = known.view(np.uint64) - np.uint64(least & (1 << 64) - 1)
    sequences = EliasFano.of(ends, n + 1), EliasFano.of(own, int(own[-1]) + 1 if len(own) else 1)
    parts = [b"".join(ids), *(p for s in sequences for p in s.parts())]
    head = struct.pack("<4qq4Q7q", len(ends), len(doc_ids) - len(known), n, width, least, *(x for s in sequences for x in (s.universe - 1, s.width)), *map(len, parts))
    return MAGIC + head + b"".join(parts)


class Shard:
    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a shard")
        self.n, self.unknown, self.n_ids, self.width, self.least, *rest = struct.unpack_from("<4qq4Q7q", raw, 8)
        at, parts = 8 + 16 * 8, []
        for size in rest[4:]:
            parts.append(memoryview(raw)[at : at + size])
            at += size
        self.ids = np.frombuffer(parts[0], "<u2" if self.width == 2 else "<u4")
        made = [EliasFano(n, rest[2 * k] + 1, rest[2 * k + 1], parts[3 * k + 1], parts[3 * k + 2], np.frombuffer(parts[3 * k + 3], "<u4")) for k, n in enumerate((self.n, self.n - self.unknown))]
        self.ends, self.known = made

    def bounds(self, i: int, j: int) -> np.ndarray:
        """Where document i begins and where documents i to j, j left out, end."""
        ends = self.ends.select(max(0, i - 1), j).astype(np.int64)
        return ends if i else np.concatenate([[0], ends])

    def doc_ids(self, i: int, j: int) -> list:
        a, b = max(0, i - self.unknown), max(0, j - self.unknown)
        return [None] * (j - i - (b - a)) + (self.known.select(a, b) + np.uint64(self.least & (1 << 64) - 1)).view(np.int64).tolist()

    def document(self, i: int) -> np.ndarray:
        begin, end = self.bounds(i, i + 1).tolist()
        return self.ids[begin:end]


def write_file(folder: str, name: str, data: bytes) -> str:
    """Beside its place first, then moved: a reader never sees a part of it. One that another run of the task left is the same, byte for byte."""
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)
    beside = f"{at}/_{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(beside) as out:
        out.write(data)
    move_file(fs, beside, f"{at}/{name}")
    return f"{folder}/{name}"


def read_file(path: str) -> bytes:
    fs, at = file_system(path)
    with fs.open_input_file(at) as file:
        return file.read()


_memos: dict = {}
MARKS = ".,;:!?"


class UnitEncoder:
    """The tokenizer's ids of units, as bytes. A word of letters, with marks behind it or without, is a match of its own (and its marks
    another), so many such words are encoded in one call and told apart by the word numbers that the library gives."""

    def __init__(self, tokenizer, width: int, joined: bool = True):
        """joined: whether words may be encoded together, which no control token with white space may stand against."""
        self.tokenizer, self.width, self.joined, self.tails = tokenizer, width, joined, {"": b""}

    def alone(self, texts: list[str]) -> list[bytes]:
        return [self.raw(e.ids) for i in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch(texts[i : i + 4096], add_special_tokens=False)]

    def raw(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def words(self, words: list[str], lead: str) -> list[bytes]:
        """Of lead + word each; the lead is a blank, which joins its word's match, or a line feed, which is one."""
        out, per = [], 1 if lead == " " else 2
        chunks = [words[i : i + 256] for i in range(0, len(words), 256)]
        texts = [lead + lead.join(c) for c in chunks]
        for chunk, e in zip(chunks, (e for i in range(0, len(texts), 32) for e in self.tokenizer.encode_batch(texts[i : i + 32], add_special_tokens=False)), strict=True):
            of = np.array(e.word_ids)
            if of[-1] + 1 != per * len(chunk):  # what Python takes for a letter is none to the pattern
                out += self.alone([lead + w for w in chunk])
                continue
            cuts = (np.searchsorted(of, np.arange(0, of[-1] + 2, per)) * self.width).tolist()
            raw = self.raw(e.ids)
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def __call__(self, new: list[str], known: dict[str, bytes]) -> list[bytes]:
        if not self.joined:
            return self.alone([text_of(u) for u in new])
        made = dict.fromkeys(u for u in new if u.isalpha())
        marked, rest = {" ": [], "\n": []}, []
        for u in new:
            if u not in made:
                lead = u[0] if u[0] in "\0\n" else " "
                word = u.rstrip(MARKS)
                if lead != "\0" and (word if lead == " " else word[1:]).isalpha():
                    marked[lead].append((u, word, u[len(word) :]))
                else:
                    rest.append(u)
        for lead, found in marked.items():
            words = [w for w in (made if lead == " " else {}) if w] + list({w for _, w, _ in found if w not in known and w not in made})
            made.update(zip(words, self.words(words if lead == " " else [w[1:] for w in words], lead), strict=True))
        tails = list({t for found in marked.values() for _, _, t in found if t not in self.tails})
        ends = self.tails | dict(zip(tails, self.alone(tails), strict=True))
        if len(ends) < 10_000:
            self.tails = ends
        for u, w, t in marked[" "] + marked["\n"]:
            made[u] = (made.get(w) or known[w]) + ends[t]
        made.update(zip(rest, self.alone([text_of(u) for u in rest]), strict=True))
        return [made[u] for u in new]


class Library:
    """A worker's tokenizer as the library sets it up, the strings that it takes for control tokens, and a memo of units (unit -> its ids as bytes)."""

    def __init__(self, tokenizer_json: str, width: int):
        from tokenizers import Tokenizer

        self.whole, plain = Tokenizer.from_str(tokenizer_json), Tokenizer.from_str(tokenizer_json)
        plain.encode_special_tokens = True  # units hold none; words that are joined for one call must not make one
        self.controls = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]
        self.memo = Memo(UnitEncoder(plain, width, not any(c.isspace() for t in self.controls for c in t)))


def encoder(tokenizer_json: str, width: int) -> Library:
    key = (zlib.crc32(tokenizer_json.encode()), len(tokenizer_json), width)
    if key not in _memos:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _memos[key] = Library(tokenizer_json, width)
    return _memos[key]


def encode(texts: pa.Array, library: Library, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts laid end to end, each text's followed by the end id, and where each text's end."""
    texts = pc.fill_null(texts, "")
    odd = np.zeros(len(texts), bool)
    for control in library.controls:
        odd |= pc.match_substring(texts, control).to_numpy(zero_copy_only=False)
    if odd.any():  # by the library as a whole, put in before their end ids
        made = [library.whole.encode(texts[i].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(odd).tolist()]
        flat, ends = encode(pc.if_else(pa.array(odd), "", texts), library, end)
        sizes = np.zeros(len(texts), np.int64)
        sizes[odd] = [len(m) for m in made]
        return np.insert(flat, np.repeat(ends - 1, sizes), np.concatenate([np.array(m, end.dtype) for m in made])), ends + np.cumsum(sizes)
    distinct, number, lengths = split(texts)
    encoded = library.memo.of(distinct.to_pylist(), np.bincount(number, minlength=len(distinct)))
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // end.itemsize
    flat = np.concatenate([np.frombuffer(b"".join(encoded), end.dtype), end])
    # The end id is one more unit, after the last of each text.
    order = np.insert(number.astype(np.int64), np.cumsum(lengths), len(encoded))
    at, stops = gather(np.append(np.cumsum(sizes) - sizes, sizes.sum()), np.append(sizes, 1), order)
    return flat[at], stops[np.cumsum(lengths + 1) - 1] if len(lengths) else stops


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write; the manifest: part, shard, path, n_docs, n_ids, base (ids before it), a written table."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    width = 2 if max(end_id + 1, Tokenizer.from_str(tokenizer_json).get_vocab_size()) <= 1 << 16 else 4
    sent = spark.sparkContext.broadcast(tokenizer_json)  # one vocabulary file
    end = np.array([end_id], f"<u{width}")

    def write(batches):
        library = encoder(sent.value, width)
        part, shard = TaskContext.get().partitionId(), 0
        ids, ends, doc_ids, made, total = [], [], [], [], 0

        def close():
            nonlocal shard, ids, ends, doc_ids, total
            path = write_file(folder, f"part-{part:06d}-{shard:04d}.tef", pack(ids, np.concatenate(ends), doc_ids, width))
            made.append((part, shard, path, len(doc_ids), total))
            shard, ids, ends, doc_ids, total = shard + 1, [], [], [], 0

        for batch in rows(batches, BATCH):
            new, new_ends = encode(batch.column(1), library, end)
            ids.append(new.tobytes())
            ends.append(new_ends + total)
            doc_ids += batch.column(0).to_pylist()
            total += len(new)
            if total >= SHARD_IDS:
                close()
        if doc_ids:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "shard", "path", "n_docs", "n_ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = source.repartitionByRange(partitions(source), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    made = materialize(ordered.mapInArrow(write, "part int, shard int, path string, n_docs long, n_ids long"), "shards")
    # The parts are as many as `partitions` allows at most, which bounds the first running sum; the second is inside a part.
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = made.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("of"), before(Window.orderBy("part"), "n").alias("of_part"))
    base = F.col("of_part") + before(Window.partitionBy("part").orderBy("shard"), "n_ids")
    return materialize(made.join(parts, F.col("part") == F.col("of")).select("part", "shard", "path", "n_docs", "n_ids", base.alias("base")), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit), read from the shards."""
    small_batches(manifest.sparkSession)

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(read_file(path))
                for i in range(0, shard.n, TOGETHER):
                    j = min(shard.n, i + TOGETHER)
                    bounds = shard.bounds(i, j)
                    wide = memoryview(shard.ids[bounds[0] : bounds[-1]].astype("<u4").tobytes())
                    cuts = (4 * (bounds - bounds[0])).tolist()
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(i, j), pa.int64()), pa.array(bounds[:-1] + base, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    total = manifest.agg(F.sum("n_ids")).first()[0] or 0
    each = manifest.select("path", "base").repartition(max(1, min(200_000, total // IDS_PER_TASK)))
    return each.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer_path, f"{scratch(docs.sparkSession)}/tokens-{uuid.uuid4().hex}", end_id))
