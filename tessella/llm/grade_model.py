"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds part them: P(grade <= k) = s(threshold_k - x.w).
The expected grade and the tail probability P(grade >= keep_from) come from that, and the tail selects.

Grades of the labels table: 0 for low quality, 1 for toxic, 2 for good. Fit on at most max_labels rated rows (whole texts): the first max_labels
ratings by a hash of the id, and of the different rows that they meet in documents the first max_labels by a hash of id and text, so that neither a label
nor a document that stands there any number of times sends more than that to the driver. Full-batch Adam on the driver. Every document is scored.

Defined cases: a null or empty text has the bias alone; a label without a document, or a document without a label, takes no part in the fit; rows that
agree in id, text and grade count once, those that share only some of it one by one; ids that are rated are whole numbers; with fewer than
two grades among the labels every document gets that grade (or 2) with certainty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, small_batches

BITS = 18
SIZE = 1 << BITS
#: Text bytes whose features are made together.
BATCH = 2 << 20
_CLASS = re.compile(r"([a-zà-öø-ÿ]+)|([A-ZÀ-ÖØ-Þ]+)|([0-9]+)|(\s+)")
_MARK = re.compile(r"(.)\1+")


@cache
def _shape(word: str) -> str:
    """A word's outline: runs of small letters, capitals and digits as a, A, 0; runs of a mark as two."""
    plain = _CLASS.sub(lambda m: "aA0 "[m.lastindex - 1], word)
    return _MARK.sub(r"\1\1", plain)[:12]


#: Letters of a word's beginning that is a feature of its own where the word goes on: what words of one stem have in common.
STEM = 5
_known: dict[str, tuple[int, int, int]] = {}


def _places(word: str) -> tuple[int, int, int]:
    """The places of a word's bare small form, of its outline and of its beginning (-1 for none)."""
    found = _known.get(word)
    if found is None:
        bare = word.strip(".,;:!?\"'()[]{}<>|#*$%&").lower()
        at = lambda kind, x: zlib.crc32(kind + x.encode()) & (SIZE - 1)
        found = (at(b"w", bare), at(b"s", _shape(word[:200])), at(b"p", bare[:STEM]) if len(bare) > STEM else -1)
        if len(_known) < 300_000:
            _known[word] = found
    return found


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner (a text's number, ascending), place and value of the features of texts (null: empty): each word and beginning the root of its share of the
    words (of 20 more than there are, times 20); each outline its share times 8; share of repeated words and lines, a bias."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    words, owner = coded.dictionary.to_pylist(), np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if "" in words:
        some = code != words.index("")
        code, owner = code[some], owner[some]
    n = np.maximum(1, np.bincount(owner, minlength=len(texts)))
    places = np.array([_places(w) for w in words], np.int64).reshape(-1, 3)
    pairs, times = np.unique(owner * max(1, len(words)) + code, return_counts=True)
    of, word = np.divmod(pairs, max(1, len(words)))

    def counted(kinds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([places[word, k] for k in kinds])
        key = np.concatenate([of] * len(kinds)) * SIZE + at
        known = at >= 0
        kept, inverse = np.unique(key[known], return_inverse=True)
        return *np.divmod(kept, SIZE), np.bincount(inverse, np.concatenate([times] * len(kinds))[known], len(kept))

    own, at, share = counted((0, 2))
    out, shape, seen = counted((1,))
    again = np.bincount(owner[1:][(code[1:] == code[:-1]) & (owner[1:] == owner[:-1])], minlength=len(texts))
    lines = [x.split("\n") for x in texts.to_pylist()]
    extra = np.stack([np.ones(len(texts)), 8 * (1 - np.array([len(set(x)) / len(x) for x in lines])), 8 * again / n, 8 * np.maximum(0.0, 0.3 - np.bincount(of, minlength=len(texts)) / n)], axis=1)
    owner = np.concatenate([own, out, np.repeat(np.arange(len(texts)), 4)])
    order = np.argsort(owner, kind="stable")
    value = np.concatenate([np.sqrt(share * 20 / (n[own] + 20)), 8 * seen / n[out], extra.ravel()])
    return owner[order], np.concatenate([at, shape, np.tile(np.arange(4), len(texts))])[order].astype(np.int32), value[order].astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, z: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k below the last grade, a column each."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - z[:, None], -50, 50)))

    def scores(self, texts: pa.Array, keep_from: int) -> tuple[np.ndarray, np.ndarray]:
        owner, at, value = features(texts)
        p = self.below(np.bincount(owner, self.weights[at].astype(float) * value, len(texts)))
        return (1 - p).sum(axis=1), 1 - p[:, keep_from - 1]


def telling(at: np.ndarray, grade_of: np.ndarray, grade: np.ndarray, grades: int, least: int = 5, z: float = 4.5) -> np.ndarray:
    """Which places to fit: those that at least so many texts have and whose share in some grade is z standard errors from that in the
    others. Places that few texts have would learn the sample by heart. The four general measures always take part."""
    seen = np.bincount(at.astype(np.int64) * grades + grade_of, minlength=SIZE * grades).reshape(SIZE, grades)
    n, total = np.bincount(grade, minlength=grades), len(grade)
    df = seen.sum(axis=1)
    keep = np.zeros(SIZE, bool)
    for g in range(grades):
        if 0 < n[g] < total:
            share = df / total
            error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n[g] + 1 / (total - n[g])))
            keep |= np.abs(seen[:, g] / n[g] - (df - seen[:, g]) / (total - n[g])) > z * error
    keep &= df >= least
    keep[:4] = True
    return keep


def fit_matrix(at: np.ndarray, value: np.ndarray, ends: np.ndarray, grade: np.ndarray, grades: int, steps: int = 300, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """Maximum likelihood with a weight decay; thresholds as a first one and positive steps, so they stay in order."""
    begins, n = np.concatenate([[0], ends[:-1]]), len(ends)
    owner = np.repeat(np.arange(n), ends - begins)
    told = telling(at, grade[owner], grade, grades)[at]
    at, value, owner = at[told], value[told], owner[told]
    kinds, place = np.unique(at, return_inverse=True)
    balance = 1.0 / np.maximum(1, np.bincount(grade, minlength=grades))[grade]
    balance = balance / balance.sum() * n
    x = np.zeros(len(kinds) + grades - 1)
    x[-(grades - 1)] = -1.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    lower = np.concatenate([[-np.inf], np.zeros(0)])
    for step in range(1, steps + 1):
        w, free = x[: len(kinds)], x[len(kinds) :]
        cuts = np.cumsum(np.concatenate([free[:1], np.logaddexp(0, free[1:])]))
        z = np.bincount(owner, w[place] * value, minlength=n)
        up = np.concatenate([cuts, [np.inf]])[grade] - z
        lo = np.concatenate([lower, cuts])[grade] - z
        s_up, s_lo = 1 / (1 + np.exp(-np.clip(up, -50, 50))), 1 / (1 + np.exp(-np.clip(lo, -50, 50)))
        s_up, s_lo = np.where(np.isinf(up), 1.0, s_up), np.where(np.isinf(lo), 0.0, s_lo)
        p = np.maximum(s_up - s_lo, 1e-9)
        d_up, d_lo = balance * s_up * (1 - s_up) / p, balance * s_lo * (1 - s_lo) / p
        g_z = (d_up - d_lo) / n
        g_cut = np.array([-(d_up[grade == k].sum() - d_lo[grade == k + 1].sum()) / n for k in range(grades - 1)])
        tail = np.cumsum(g_cut[::-1])[::-1]
        g_free = np.concatenate([tail[:1], tail[1:] / (1 + np.exp(-free[1:]))])
        g = np.concatenate([np.bincount(place, g_z[owner] * value, minlength=len(kinds)) + decay * w, g_free])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(SIZE, np.float32)
    weights[kinds] = x[: len(kinds)]
    free = x[len(kinds) :]
    return Model(weights, np.cumsum(np.concatenate([free[:1], np.logaddexp(0, free[1:])])))


def fit(docs: DataFrame, rated: DataFrame, max_labels: int = 10_000, grades: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """rated: doc_id and grade, from 0 on."""
    spark = docs.sparkSession
    small_batches(spark)
    few = rated.where("doc_id is not null and grade is not null").orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("grade")), "doc_id", "grade").limit(max_labels).collect()
    if len({r["grade"] for r in few}) < 2:
        sure = few[0]["grade"] if few else grades - 1
        return Model(np.zeros(SIZE, np.float32), np.array([-50.0 if k < sure else 50.0 for k in range(grades - 1)]))
    chosen = F.broadcast(spark.createDataFrame([(r["doc_id"], int(r["grade"])) for r in few], "doc_id long, grade int"))  # max_labels rows
    sample = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "doc_id").select("doc_id", "grade", "text", F.xxhash64("doc_id", "text").alias("draw"))

    def make(batches):
        for batch in rows(batches, BATCH):
            owner, at, value = features(batch.column(2))
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
            packed = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()) for x in (at, value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed, batch.column(3)], ["doc_id", "grade", "at", "value", "draw"])

    made = sample.mapInArrow(make, "doc_id long, grade int, at binary, value binary, draw long")
    got = sorted(tuple(r)[:4] for r in made.dropDuplicates(["doc_id", "grade", "draw"]).orderBy("draw", "doc_id", "grade").limit(max_labels).collect())
    if len({r[1] for r in got}) < 2:
        sure = got[0][1] if got else grades - 1
        return Model(np.zeros(SIZE, np.float32), np.array([-50.0 if k < sure else 50.0 for k in range(grades - 1)]))
    at = np.frombuffer(b"".join(r[2] for r in got), np.int32)
    value = np.frombuffer(b"".join(r[3] for r in got), np.float32).astype(float)
    ends = np.cumsum([len(r[2]) // 4 for r in got])
    return fit_matrix(at, value, ends, np.array([r[1] for r in got]), grades)


def score(docs: DataFrame, model: Model, keep_from: int = 2, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability (of keep_from or better), kept."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 weights

    def run(batches):
        for batch in rows(batches, BATCH):
            grade, tail = sent.value.scores(batch.column(1), keep_from)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grade, pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= least, pa.bool_())], ["doc_id", "expected_grade", "tail_probability", "kept"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail_probability double, kept boolean")


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id, grade from the labels table: 0 low quality, 1 toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & F.coalesce(F.col("toxic") == 0, F.lit(True)), 2).alias("grade"))
