"""Language ID by the nearest centroid.

Texts become normalised TF-IDF vectors of hashed letter 1- to 3-grams (of whole texts). Each language has several centroids,
found by spherical k-means over a bounded sample of labelled documents; the nearest by cosine gives the language, and a text
that is farther from all of them than usual texts held back from the fit are is rejected.

Parameters that bound the fit: max_docs labelled texts in all, at most per_language of one language; nothing else is sampled.
Defined cases: a null text or one without a letter gives `und`, score 0, rejected; without labelled documents every text does;
equal scores go to the language first by code point; a null id belongs to the learning part and is not held out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows, small_batches

BITS = 12
SIZE = 1 << BITS


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the hashed n-grams, a row per text; whether each has a letter. Words are framed by one blank."""
    framed = [f" {t.lower()} ".encode("utf-32-le", "surrogatepass") for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) // 4 for x in framed])
    code = np.frombuffer(b"".join(framed), "<u4")
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = True
    code, owner, letter = np.where(letter, code, 32)[keep].astype(np.uint32), owner[keep], letter[keep]
    a, b, c = code * np.uint32(0x9E3779B1), code * np.uint32(0x85EBCA77), code * np.uint32(0xC2B2AE3D)
    grams = ((a, letter), (a[:-1] + b[1:] + np.uint32(1), letter[:-1] | letter[1:]), (a[:-2] + b[1:-1] + c[2:] + np.uint32(2), letter[1:-1]))
    found = np.zeros(len(texts) * SIZE, np.int64)
    for n, (h, use) in enumerate(grams):
        h = (h ^ (h >> np.uint32(15)))[use] * np.uint32(0x2C1B3C6D)
        found += np.bincount(owner[n:][use] * SIZE + (h >> np.uint32(32 - BITS)), minlength=len(found))
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    return found.reshape(len(texts), SIZE).astype(np.float32), has


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        counts, has = ngram_counts([t or "" for t in texts])
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        near = vectors(counts, self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        score = np.where(has, np.clip(near[np.arange(len(texts)), best], 0, 1), 0.0).astype(float)
        which = self.owner[best]
        return [self.languages[k] if h else "und" for k, h in zip(which, has, strict=True)], score, ~has | (score < self.floor[which])


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts at the vector nearest the mean, then the farthest from those chosen."""
    mean = x.mean(axis=0)
    chosen = [int((x @ mean).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centers = x[chosen]
    for _ in range(rounds):
        to = (x @ centers.T).argmax(axis=1)
        sums = np.stack([x[to == j].sum(axis=0) if (to == j).any() else centers[j] for j in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", clusters: int = 4, per_language: int = 300, max_docs: int = 3000, quantile: float = 0.01, margin: float = 0.6) -> Model:
    """Learn from a bounded sample, chosen by a hash of the id: at most per_language texts each and max_docs in all.

    Every fourth text of a language is held back from the centroids. floor: margin times that quantile of the held-back texts' cosines (of
    the training texts' where none is held back); nearer texts are never rejected.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    known = labelled.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    per = {r[0]: r[1] for r in known.groupBy("l").count().orderBy(F.desc("count"), "l").limit(max_docs).collect()}
    if not per:
        return Model([], np.zeros(SIZE), np.zeros((0, SIZE)), np.zeros(0, int), np.zeros(0))
    cap = max(1, min(per_language, max_docs // len(per)))
    draw = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("language")), F.lit(1 << 30))
    rate = spark.createDataFrame([(k, int(min(1.0, (1.5 * cap + 20) / n) * (1 << 30))) for k, n in per.items()], "l string, rate long")
    order = Window.partitionBy("l").orderBy("draw", "i", "t")
    sample = known.withColumn("draw", draw).join(F.broadcast(rate), "l").where("draw < rate").withColumn("k", F.row_number().over(order)).where(F.col("k") <= cap).select("l", "t")

    def count(batches):
        for batch in rows(batches, 1 << 19):
            counts, has = ngram_counts(batch.column(1).to_pylist())
            where = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([w.astype("<u2").tobytes() for w in where], pa.binary()), pa.array([c[w].astype("<u4").tobytes() for c, w in zip(counts, where, strict=True)], pa.binary()), pa.array(has)],
                ["l", "at", "n", "has"],
            )

    found = sorted(tuple(r) for r in sample.mapInArrow(count, "l string, at binary, n binary, has boolean").where("has").drop("has").collect())
    languages = sorted({r[0] for r in found})
    counts = np.zeros((len(found), SIZE), np.float32)
    for row, (_, at, n) in zip(counts, found, strict=True):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(n, "<u4")
    of = np.array([languages.index(r[0]) for r in found], int)
    # found is sorted by language, so this counts within each.
    back = (np.arange(len(of)) - np.searchsorted(of, of)) % 4 == 3
    held, held_of, counts, of = counts[back], of[back], counts[~back], of[~back]
    idf = (np.log((1 + len(of)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x, y = vectors(counts, idf), vectors(held, idf)
    groups = [cluster(x[of == k], clusters) for k in range(len(languages))]
    judged = [y[held_of == k] if (held_of == k).any() else x[of == k] for k in range(len(groups))]
    floor = np.array([margin * float(np.quantile((v @ g.T).max(axis=1), quantile)) for v, g in zip(judged, groups, strict=True)])
    return Model(languages, idf, np.concatenate(groups).astype(np.float32) if groups else np.zeros((0, SIZE)), np.repeat(np.arange(len(groups)), [len(g) for g in groups]), floor)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some 16 vectors: its size doesn't follow the data

    def run(batches):
        for batch in rows(batches, 1 << 19):
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                lang, score, rejected = sent.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, that the model doesn't reject."""
    names, spark = docs.columns, docs.sparkSession
    small_batches(spark)
    sent, at = spark.sparkContext.broadcast(model), names.index("text")

    def run(batches):
        for batch in rows(batches, 1 << 19):
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                yield part.filter(pa.array(~sent.value.predict(part.column(at).to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)
