"""Passages of 50 words or more that stand earlier in the corpus, removed: whole lines or paragraphs first, then runs of words in any place.

Units (lines or paragraphs) are normalised (lower case, runs of white space to one blank, ends trimmed), digested, and the digests grouped over the
whole corpus. A unit's occurrences are ranked by id, then by place in the text; the first stays, the others are repeats. Repeats that follow one another,
with nothing but units without words between, go where they have `passage` words or more together: a repeated short line alone stays.

A passage inside lines that differ elsewhere is found by its runs of `passage` words (lower case, parted by white space). Winnowing keeps one in some of
the shorter runs, by content, so that every run of `passage` words has one that its other occurrences keep as well; only round those that recur, all
runs of `passage` words are digested and grouped. A word goes if a run covers it that a lesser id has too, or that the same row has before without
overlap. Runs that lie in removed units as a whole take no part: neither are they searched nor do they make another a repeat.

Only digests, ids and places are shuffled by digest; texts meet their marks by id. The offsets of what goes, in the original text, are kept.

Defined cases: a null or empty text has no units and is returned as it is; rows that share an id rank equally, and only what comes after the first within
each row goes there; rows without an id rank last, equally; an empty table gives an empty table. Ids are whole numbers. Internal columns start with __,
others pass through untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, gather, materialize, materialize_arrow, rows, small_batches
from .wording import BASES, Words, lowered, runs, sliding, stretches

#: What parts units, as a literal pattern.
SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
LAST = (1 << 63) - 1
#: Words of the runs that winnowing chooses from.
RUN = 12
#: Text bytes that are looked at together.
BATCH = 1 << 20


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id, __h (a hash of the text), __text."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("__id"), F.xxhash64(text).alias("__h"), text.alias("__text"))


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and bounds, a null list as an empty one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def winnow(h: np.ndarray, valid: np.ndarray, wide: int) -> np.ndarray:
    """Places of the hashes that are the least of any `wide` that follow one another from a valid place on."""
    if len(h) < wide:
        return np.zeros(0, np.int64)
    least = np.where(valid[: len(h) - wide + 1], sliding(h, wide, np.minimum), 0)
    around = sliding(np.concatenate([np.zeros(wide - 1, np.uint64), least, np.zeros(wide - 1, np.uint64)]), wide, np.maximum)
    return np.flatnonzero((around == h) & (h > 0))


def distinct(text: np.ndarray, place: np.ndarray, *digests: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of occurrences in order of text and place: the first of each digest in its text, and for each of those a list of the later places."""
    order = np.lexsort((np.arange(len(text)), *digests, text))
    new = np.append(True, np.any([x[order][1:] != x[order][:-1] for x in (text, *digests)], axis=0))[: len(order)]
    first = np.flatnonzero(new)
    by_first = np.argsort(order[first], kind="stable")  # back to the order of places
    sizes = (np.diff(np.append(first, len(order))) - 1)[by_first]
    at, ends = gather(first[by_first] + 1, sizes, np.arange(len(sizes)))
    return order[first[by_first]], lists(place[order[at]].astype(np.int32), np.concatenate([[0], ends]), pa.int32())


SCANNED = "__id long, __h long, words int, d1 array<bigint>, d2 array<bigint>, n array<int>, place array<int>, others array<array<int>>, at array<int>, unit array<int>, last array<int>, run array<bigint>"


def scan(texts: DataFrame, sep: str, passage: int) -> DataFrame:
    """A row per text: number of its units; digests, numbers of words and places of its distinct ones; its chosen runs: place, first and last unit
    of what is round them, hash."""

    def read(batches):
        for batch in rows(batches, BATCH):
            w = Words(lowered(batch.column(2)))
            codes = w.codes()
            begins, ends, of_text = w.units(sep)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(of_text))
            d1, d2 = (stretches(codes, begins, ends, b) for b in BASES)
            ordinal = np.arange(len(begins)) - of_text[owner]
            own, others = distinct(owner, ordinal, d1, d2)
            per_text = np.searchsorted(owner[own], np.arange(batch.num_rows + 1))
            columns = [pa.array(np.diff(of_text).astype(np.int32)), *(lists(x[own], per_text, t) for x, t in ((d1.view(np.int64), pa.int64()), (d2.view(np.int64), pa.int64()), ((ends - begins).astype(np.int32), pa.int32()), (ordinal.astype(np.int32), pa.int32())))]
            columns.append(pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), others))
            h = runs(codes, RUN, BASES[0])
            stop = np.repeat(w.bounds[1:], np.diff(w.bounds))  # the end of each word's text
            at = winnow(h, np.arange(len(codes)) + passage <= stop, passage - RUN + 1)
            bounds = np.searchsorted(at, w.bounds)
            text = np.searchsorted(w.bounds, at, "right") - 1
            # The units of all runs of `passage` words round it.
            unit = np.searchsorted(begins, np.maximum(at - (passage - RUN), w.bounds[text]), "right") - 1
            last = np.searchsorted(begins, np.minimum(at + passage, w.bounds[text + 1]) - 1, "right") - 1
            columns += [lists((x - y).astype(np.int32), bounds, pa.int32()) for x, y in ((at, w.bounds[text]), (unit, of_text[text]), (last, of_text[text]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, lists(h[at].view(np.int64), bounds, pa.int64())], ["__id", "__h", "words", "d1", "d2", "n", "place", "others", "at", "unit", "last", "run"])

    return materialize_arrow(texts, read, SCANNED, "scanned", texts)


def earliest(found: DataFrame, name: str, apart: int) -> tuple[DataFrame, DataFrame]:
    """__id, __h, at, more: the occurrences that are not the earliest of their digest, from found, a written table with a row per text and digest:
    __id, __h, d1, d2, place (the first in the text), others (the later ones), more; and the table of digests, written for them."""
    # Written, so that the join below stands on plain exchanges, whose large partitions Spark can split.
    grouped = found.groupBy("d1", "d2").agg(F.min("__id").alias("first"), F.count("*").alias("texts"), F.max(F.size("others")).alias("most"))
    common = materialize(grouped.where("texts > 1 or most > 0").select("d1", "d2", "first"), f"{name}-common", found, 4)
    later = F.filter("others", lambda p: p >= F.col("place") + apart)
    own = F.when(F.col("__id") == F.col("first"), later).otherwise(F.concat(F.array("place"), "others"))
    return found.join(common, ["d1", "d2"]).select("__id", "__h", own.alias("at"), "more").where(F.size("at") > 0), common


def repeats(scanned: DataFrame, passage: int) -> DataFrame:
    """__id, __h, begin, end: of each row that loses units, its stretches of them, counted in units with words."""
    each = scanned.select("__id", "__h", F.explode(F.arrays_zip("d1", "d2", "n", "place", "others")).alias("u"))
    found, common = earliest(each.select("__id", "__h", "u.d1", "u.d2", "u.place", "u.others", F.col("u.n").alias("more")), "units", 1)
    marked = found.groupBy("__id", "__h").agg(F.sort_array(F.flatten(F.collect_list(F.transform("at", lambda p: F.struct(p.alias("p"), F.col("more").alias("n")))))).alias("u"))

    def join(batches):
        for batch in batches:
            units, bounds = batch.column(2), np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))])
            p, n = (units.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            new = np.append(True, np.diff(p) != 1)
            new[bounds[:-1]] = True
            begins = np.flatnonzero(new)
            ends = np.append(begins[1:], len(p))
            total = np.concatenate([[0], np.cumsum(n)])
            keep = total[ends] - total[begins] >= passage
            begins, ends = begins[keep], ends[keep]
            some = np.searchsorted(begins, bounds)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(p[begins].astype(np.int32), some, pa.int32()), lists((p[ends - 1] + 1).astype(np.int32), some, pa.int32())], ["__id", "__h", "begin", "end"])
            yield out.filter(pa.array(np.diff(some) > 0))

    gone = materialize_arrow(marked, join, "__id long, __h long, begin array<int>, end array<int>", "gone", scanned)
    drop(common)
    return gone


def covered(batch: pa.RecordBatch, begin: int, end: int, bounds: np.ndarray) -> np.ndarray:
    """Of units that bounds parts by row, past each how many lie in the stretches that columns begin and end give (running sum, one more)."""
    marks = np.zeros(bounds[-1] + 1, np.int64)
    for column, add in ((begin, 1), (end, -1)):
        values, own = flat(batch.column(column))
        np.add.at(marks, values.astype(np.int64) + np.repeat(bounds[:-1], np.diff(own)), add)
    return np.concatenate([[0], np.cumsum(np.cumsum(marks)[:-1] > 0)])


def anchors(scanned: DataFrame, gone: DataFrame) -> DataFrame:
    """__id, __h, place, run: the chosen runs but for those with nothing but removed units round them."""

    def left(batches):
        for batch in batches:
            at, bounds = flat(batch.column(2))
            unit, last, run = (flat(batch.column(i))[0] for i in (3, 4, 5))
            n = batch.column(6).to_numpy(zero_copy_only=False)
            of = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            inside = covered(batch, 7, 8, of)
            keep = inside[last + 1 + of[row]] - inside[unit + of[row]] < last + 1 - unit
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row[keep])) for i in (0, 1)), pa.array(at[keep], pa.int32()), pa.array(run[keep], pa.int64())], ["__id", "__h", "place", "run"])

    both = scanned.join(gone, ["__id", "__h"], "left").select("__id", "__h", "at", "unit", "last", "run", "words", "begin", "end")
    return materialize_arrow(both, left, "__id long, __h long, place int, run long", "runs", scanned)


def passages(texts: DataFrame, scanned: DataFrame, gone: DataFrame, sep: str, passage: int) -> tuple[DataFrame, list[DataFrame]]:
    """__id, __h, from: the words at which runs of `passage` words begin that go; and the tables that this is made of."""

    def around(batches):
        for batch in rows(batches, BATCH):
            w = Words(lowered(batch.column(2)))
            codes = w.codes()
            begins, _, of_text = w.units(sep)
            inside = covered(batch, 4, 5, of_text)
            at, own = flat(batch.column(3))
            row = np.repeat(np.arange(batch.num_rows), np.diff(own))
            near = np.zeros(len(codes) + 1, np.int64)
            places = at.astype(np.int64) + w.bounds[row]
            np.add.at(near, np.maximum(places - (passage - RUN), w.bounds[row]), 1)
            np.add.at(near, places + 1, -1)
            stop = np.repeat(w.bounds[1:], np.diff(w.bounds))
            start = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (np.arange(len(codes)) + passage <= stop))
            unit, last = (np.searchsorted(begins, x, "right") - 1 for x in (start, start + passage - 1))
            start = start[inside[last + 1] - inside[unit] < last + 1 - unit]
            text = np.searchsorted(w.bounds, start, "right") - 1
            digests = [runs(codes, passage, b)[start] for b in BASES]
            place = start - w.bounds[text]
            own, others = distinct(text, place, *digests)
            index = pa.array(text[own])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *(pa.array(d[own].view(np.int64)) for d in digests), pa.array(place[own].astype(np.int32)), others, pa.array(np.zeros(len(own), np.int32))], ["__id", "__h", "d1", "d2", "place", "others", "more"])

    found = anchors(scanned, gone)
    again = materialize(found.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run"), "again", found, 4)
    places = found.join(again, "run").groupBy("__id", "__h").agg(F.collect_set("place").alias("__at"))
    asked = materialize(places.join(gone, ["__id", "__h"], "left"), "places", found, 4)
    drop(found, again)
    near = texts.join(asked, ["__id", "__h"]).select("__id", "__h", "__text", "__at", "begin", "end")
    windows = materialize_arrow(near, around, "__id long, __h long, d1 long, d2 long, place int, others array<int>, more int", "windows", texts)
    repeated, common = earliest(windows, "passages", passage)
    return repeated.groupBy("__id", "__h").agg(F.flatten(F.collect_list("at")).alias("from")), [asked, windows, common]


def cut(text: str, begin: list[int], end: list[int], starts: np.ndarray, sep: str, passage: int) -> tuple[str, list[dict]]:
    """The text without the units and passages that go, and their offsets in order; a passage is cut where a unit ends."""
    column = pa.array([text])
    w = Words(column)
    first_words, last_words, _ = w.units(sep)
    seps = w.separators(sep)
    opens, closes = np.concatenate([[0], seps + len(sep)]), np.append(seps, len(w.data))
    goes = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(goes, starts, 1)
    np.add.at(goes, starts + passage, -1)
    goes = np.cumsum(goes)[:-1] > 0
    out = np.zeros(len(opens), bool)
    unit_of = np.searchsorted(seps, w.starts)  # the unit of each word, wordless ones counted
    for a, b in zip(begin, end, strict=True):
        goes[first_words[a] : last_words[b - 1]] = False
        out[unit_of[first_words[a:b]]] = True
    chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    at = np.flatnonzero(goes)
    new = np.append(True, (np.diff(at) > 1) | (np.diff(unit_of[at]) > 0))[: len(at)]
    runs_at, runs_to = w.starts[at[new]], w.ends[at[np.append(new[1:], True)]] if len(at) else w.ends[:0]
    # What is cut, in bytes: the passages, and each unit that goes with what parts it from its neighbour.
    lost = np.flatnonzero(out)
    some = np.flatnonzero(~out)
    final = some[-1] if len(some) else -1
    take_from = np.where(lost > final, opens[lost] - len(sep), opens[lost])
    take_to = np.where(lost > final, closes[lost], closes[lost] + len(sep))
    if final < 0:
        take_from, take_to = np.zeros(1, np.int64), np.array([len(w.data)])
    a, b = np.concatenate([runs_at, take_from]), np.concatenate([runs_to, take_to])
    order = np.argsort(a, kind="stable")
    raw, edges = text.encode(), [0, *np.stack([a[order], b[order]], axis=1).ravel().tolist(), len(w.data)]
    kept = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)).decode()
    a, b = np.concatenate([runs_at, opens[lost]]), np.concatenate([runs_to, closes[lost]])
    order = np.argsort(a, kind="stable")
    return kept, [{"start": i, "end": j} for i, j in zip(chars[a[order]].tolist(), chars[b[order]].tolist(), strict=True)]


def deduplicate(docs: DataFrame, unit: str = "line", id_col: str = "doc_id", text_col: str = "text", passage: int = 50, removed: str = "removed") -> DataFrame:
    """The rows with text_col rewritten, plus (in the place of a column of that name, if there is one) `removed`: array<struct<start, end>>, the
    offsets of what went, in the original text."""
    if passage < RUN:
        raise ValueError(f"a passage has {RUN} words at least")
    small_batches(docs.sparkSession)
    sep = SEPARATORS[unit]
    texts = keyed(docs, id_col, text_col)
    scanned = scan(texts, sep, passage)
    gone = repeats(scanned, passage)
    found, made = passages(texts, scanned, gone, sep, passage)
    marks = gone.join(found, ["__id", "__h"], "full").select(F.col("__id").alias("__id2"), F.col("__h").alias("__h2"), F.col("begin").alias("__begin"), F.col("end").alias("__end"), F.col("from").alias("__from"))
    marks = materialize(marks, "marks", scanned, 4)
    drop(scanned, gone, *made)
    own = [F.col(f"`{c}`") for c in docs.columns if c != removed]
    names = [c for c in docs.columns if c != removed]
    text = F.col(f"`{text_col}`").cast("string")
    row = docs.select(*own, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("__id"), F.xxhash64(text).alias("__h")).withColumn(text_col, text)
    joined = row.join(marks, (F.col("__id") == F.col("__id2")) & (F.col("__h") == F.col("__h2")), "left").select(*[F.col(f"`{c}`") for c in names], "__begin", "__end", "__from")
    at, kind = names.index(text_col), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def rewrite_texts(batches):
        for batch in rows(batches, BATCH):
            marked = np.flatnonzero(batch.column(batch.num_columns - 3).is_valid().to_numpy(zero_copy_only=False) | batch.column(batch.num_columns - 1).is_valid().to_numpy(zero_copy_only=False))
            columns, spans = batch.columns[:-3], [[]] * batch.num_rows
            if len(marked):
                texts = columns[at].to_pylist()
                for i in marked.tolist():
                    begin, end, start = (batch.column(batch.num_columns - k)[i].as_py() or [] for k in (3, 2, 1))
                    texts[i], spans[i] = cut(texts[i], begin, end, np.array(start, np.int64), sep, passage)
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], [*names, removed])

    schema = T.StructType(joined.schema.fields[:-3]).add(removed, T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())))
    return joined.mapInArrow(rewrite_texts, schema)


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text, n_removed, spans: the deduplicated texts, and the removed offsets as `start-end` joined by commas."""
    done = deduplicate(docs.select("doc_id", "text"), **options)
    spans = F.array_join(F.transform("removed", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return done.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), spans.alias("spans"))


def rewrite(docs: DataFrame, **options) -> DataFrame:
    """The columns of documents with the texts deduplicated; n_chars, if there is one, counts what is left."""
    done = deduplicate(docs, removed="__removed", **options)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size("__removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.drop("__removed")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, text FROM documents),
l AS (SELECT r, id, i, ls[i] AS line FROM (SELECT r, id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT r, id, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL))),
m AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
             regexp_extract_all(line, '[ 	-
]+|[^ 	-
]+') AS toks, regexp_extract_all(lower(line), '[^ 	-
]+') AS ws FROM l),
w AS (SELECT r, id, i, len(ws) AS n, md5(array_to_string(ws, ' ')) AS h, row_number() OVER (PARTITION BY r ORDER BY i) AS k FROM m WHERE len(ws) > 0),
f AS (SELECT *, id > min(id) OVER (PARTITION BY h) OR k > min(k) OVER (PARTITION BY h, r) AS again FROM w),
g AS (SELECT *, sum(n) OVER (PARTITION BY r, again, k - q) AS total FROM (SELECT *, row_number() OVER (PARTITION BY r, again ORDER BY k) AS q FROM f)),
u AS (SELECT m.*, coalesce(g.again AND g.total >= 50, false) AS gone FROM m LEFT JOIN g USING (r, i)),
t AS (SELECT r, id, i, gone, start + coalesce(sum(length(tok)) OVER (PARTITION BY r, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a, j, tok,
             regexp_matches(tok, '^[^ 	-
]') AS is_word FROM (SELECT r, id, i, gone, start, toks, toks[j] AS tok, j FROM (SELECT *, unnest(generate_series(1, len(toks))) AS j FROM u))),
v AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i, j) - 1 AS p FROM t WHERE is_word),
x AS (SELECT r, id, list(lower(tok) ORDER BY p) AS ws, list(CASE WHEN gone THEN 0 ELSE 1 END ORDER BY p) AS stays FROM v GROUP BY r, id),
y AS (SELECT r, id, p, md5(array_to_string(ws[p + 1 : p + 50], ' ')) AS h FROM (SELECT *, unnest(generate_series(0, len(ws) - 50)) AS p FROM x WHERE len(ws) >= 50) WHERE list_contains(stays[p + 1 : p + 50], 1)),
z AS (SELECT r, p FROM (SELECT r, id, p, min(id) OVER (PARTITION BY h) AS first, min(p) OVER (PARTITION BY h, r) AS own FROM y) WHERE id > first OR p >= own + 50),
c AS (SELECT r, p, 1 AS e FROM z UNION ALL SELECT r, p + 50, -1 FROM z),
e AS (SELECT r, p, sum(e) AS e FROM c GROUP BY r, p),
o AS (SELECT v.*, NOT gone AND coalesce(sum(e.e) OVER (PARTITION BY v.r ORDER BY v.p), 0) > 0 AS out FROM v LEFT JOIN e ON e.r = v.r AND e.p = v.p),
s AS (SELECT t.r, t.i, t.j, t.a, t.tok, t.gone, t.is_word, coalesce(o.out, false) AS out, lag(coalesce(o.out, false)) OVER q AS before, lead(coalesce(o.out, false)) OVER q AS after
      FROM t LEFT JOIN o USING (r, i, j) WINDOW q AS (PARTITION BY t.r, t.i ORDER BY t.j)),
k AS (SELECT *, CASE WHEN is_word THEN out ELSE coalesce(before AND after, false) END AS cut FROM s),
n AS (SELECT r, i, string_agg(tok, '' ORDER BY j) FILTER (WHERE NOT cut) AS line FROM k GROUP BY r, i),
b AS (SELECT r, i, min(a) AS a, max(a + length(tok)) AS b FROM (SELECT *, j - row_number() OVER (PARTITION BY r, i ORDER BY j) AS run FROM k WHERE cut) GROUP BY r, i, run
      UNION ALL SELECT r, i, start, start + length(line) FROM u WHERE gone),
done AS (SELECT u.r, string_agg(coalesce(n.line, ''), chr(10) ORDER BY u.i) FILTER (WHERE NOT u.gone) AS text FROM u LEFT JOIN n USING (r, i) GROUP BY u.r),
spans AS (SELECT r, count(*) AS n, string_agg(a::VARCHAR || '-' || b::VARCHAR, ',' ORDER BY a) AS spans FROM b GROUP BY r)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(done.text, '') END AS text, coalesce(spans.n, 0)::BIGINT AS n_removed, coalesce(spans.spans, '') AS spans
FROM d LEFT JOIN done USING (r) LEFT JOIN spans USING (r)
"""
