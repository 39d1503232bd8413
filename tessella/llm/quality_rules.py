"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are measured on a sample, as the cascade meets it: on documents that the base rules pass, with the base measures
made. Rules then run in the order of rejections per second of cost and stop at the first that rejects. The verdict is "no rule rejects", so the order
changes the time only, never the result.

Defined cases: a null text has no words, fails the base rules and is not kept; an empty table gives an empty table; rows that
share an id (or have none) are judged one by one; other columns of the input are not read.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, per_text, rows, small_batches

SYMBOLS = "#*$%&|<>"


class Document:
    """A text whose measures are made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_upper(self) -> int:
        raw = self.text.encode("utf-8", "surrogatepass")
        return len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_distinct_words(self) -> int:
        return len(set(self.words))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by a 3-word window that occurs twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        covered = bytearray(len(w))
        for i, window in enumerate(windows):
            if seen[window] > 1:
                covered[i : i + 3] = b"\1\1\1"
        return covered.count(1)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


#: In whole numbers, so that SQL gives the same verdicts.
RULES = (
    Rule("symbols over 5 % of the word characters", lambda d: 20 * d.n_symbols > d.word_chars),
    Rule("capitals over 25 % of the word characters", lambda d: 4 * d.n_upper > d.word_chars),
    Rule("over half the lines are repeated", lambda d: 2 * d.n_dup_lines > len(d.lines)),
    Rule("under 5 % of the words are distinct", lambda d: 20 * d.n_distinct_words < len(d.words)),
    Rule("mean word over 15 characters", lambda d: d.word_chars > 15 * len(d.words)),
    Rule("mean word under 2 characters", lambda d: d.word_chars < 2 * len(d.words)),
)


def base_measures(d: Document) -> tuple[int, int, int, int, int]:
    return len(d.words), d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words


def base_failed(measures: tuple[int, int, int, int, int], min_words: int) -> bool:
    return measures[0] < min_words or 100 * measures[4] > 50 * measures[0]


def measure_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int, id_col: str, text_col: str, min_words: int = 50) -> list[tuple[int, int, int]]:
    """(rows, rejections, nanoseconds) of each rule on those of about sample_rows rows, chosen by a hash, that the base rules pass."""
    n = docs.count()
    if not n:
        return [(0, 0, 0)] * len(rules)
    # By id and text, so that rows without an id, or with the same, aren't drawn together.
    text = F.col(text_col).cast("string")
    kept = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1 << 30)) < int(min(1.0, sample_rows / n) * (1 << 30))

    def time_them(batches):
        made = [[0, 0, 0] for _ in rules]
        for batch in rows(batches):
            for text in batch.column(0).to_pylist():
                if base_failed(base_measures(Document(text)), min_words):
                    continue
                for m, rule in zip(made, rules, strict=True):
                    d = Document(text)  # what other rules have made is not there yet, what the base rules make is
                    base_measures(d)
                    began = time.perf_counter_ns()
                    m[1] += bool(rule.rejects(d))
                    m[2] += time.perf_counter_ns() - began
                    m[0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), *(pa.array([m[i] for m in made], pa.int64()) for i in range(3))], ["rule", "n", "rejected", "ns"])

    timed = docs.where(kept).select(text).mapInArrow(time_them, "rule int, n long, rejected long, ns long")
    found = {r[0]: (r[1], r[2], r[3]) for r in timed.groupBy("rule").agg(F.sum("n"), F.sum("rejected"), F.sum("ns")).collect()}
    return [found.get(i, (0, 0, 0)) for i in range(len(rules))]


def cascade(rules: Sequence[Rule], measures: list[tuple[int, int, int]]) -> list[Rule]:
    """By rejections per cost, smoothed so that a rule that rejected nothing still has a place."""
    worth = [((r + 0.5) / (n + 1)) / ((ns + 1) / (n + 1)) for n, r, ns in measures]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-worth[i], i))]


def passes(doc: Document, ordered: Sequence[Rule]) -> bool:
    return not any(rule.rejects(doc) for rule in ordered)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, sample_rows: int = 2000) -> DataFrame:
    """One row per document: its base measures, base_failed, and kept."""
    small_batches(docs.sparkSession)
    ordered = cascade(rules, measure_rules(docs, rules, sample_rows, id_col, text_col, min_words))

    def verdict(text):
        d = Document(text)
        base = base_measures(d)
        failed = base_failed(base, min_words)
        return *base, failed, not failed and passes(d, ordered)

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    columns = [(x, pa.int64()) for x in names[:5]] + [(x, pa.bool_()) for x in names[5:]]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(per_text(verdict, columns), f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names[:5]) + ", base_failed boolean, kept boolean")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM c, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
l AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(l.n, 0) AS n_lines,
             coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, len(list_distinct(ws)) AS n_distinct
      FROM d JOIN w USING (r) LEFT JOIN l USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (20 * n_symbols > word_chars OR 4 * n_upper > word_chars OR 2 * n_dup_lines > n_lines
                                OR 20 * n_distinct < n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words) AS kept
FROM b
"""
