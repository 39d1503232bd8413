"""Planted passages, other languages and noise."""

import base64
import random
import string

import numpy as np

from tessella.llm import language_id, substring_dedup


def test_passages_in_differing_lines_go(spark):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    passage, near = text(56), text(49)
    wrapped = passage.upper().replace(" ", "\n", 9)
    rows = [(1, f"{text(30)} {passage} {text(9)}"), (2, f"{text(3)} {passage} {text(40)}"), (3, f"{text(8)}\n{wrapped} {text(5)}"), (4, f"{text(9)} {near} {text(9)}"), (5, f"{text(7)} {near} {text(2)}"), (6, "same " * 90), (7, None)]
    out = {r["doc_id"]: r for r in substring_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = {i: (r["text"] or "").lower().split() for i, r in out.items()}
    assert all(out[i]["text"] == dict(rows)[i] and out[i]["n_removed"] == 0 for i in (1, 4, 5, 6, 7))
    assert [len(left[i]) for i in (2, 3)] == [43, 13] and not set(passage.split()) & set(left[2] + left[3])


def test_other_languages_and_noise_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))
    rng = random.Random(1)
    letters = [" ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 9))) for _ in range(80)) for _ in range(10)]
    others = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    ]
    assert model.predict(letters + others + [base64.b64encode(rng.randbytes(400)).decode() for _ in range(10)])[2].all()
    kept = language_id.predict(docs, model).join(docs, "doc_id").where(language_id.held_out()).where("length(text) >= 100 and lang is not null").collect()
    assert np.mean([not r["rejected"] for r in kept]) > 0.995
