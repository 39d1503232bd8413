"""Very long texts, and input columns that are called like the operators' own."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P

from tessella.llm import byte_bpe, chat_format, grade_model, language_id, mixing, quality_rules, simhash, substring_dedup, token_binary, topk_search

from .test_simhash import plain
from .test_text_operators import base, frame
from .test_tokens import JSON, RANKS, E, T

rng = np.random.default_rng(10)
WORDS = [f"{''.join(chr(97 + c) for c in rng.integers(0, 26, 1 + k % 9))}{'.,é!'[k % 4] if k % 3 == 0 else ''}" for k in range(4000)]
LONG = " ".join(WORDS[k] + ("\n" if k % 17 == 0 else "") for k in rng.integers(0, 4000, 450_000))
ROWS = [(1, LONG), (2, "a" * 60_000), (3, LONG[:400]), (4, None), (5, "\n" * 50_000), (6, " " * 50_000 + "end")]


def test_long_texts(spark):
    assert len(LONG) > 2_000_000
    docs = frame(spark, ROWS)
    assert {r["doc_id"]: tuple(r)[1:6] for r in quality_rules.judge(docs).collect()} == {i: base(t) for i, t in ROWS}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in simhash.near_copies(docs).collect()} == {i: plain(t) for i, t in ROWS}
    ids = lambda t: [*T.encode(t or "", add_special_tokens=False).ids, 2]
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_binary.round_trip(docs, JSON).collect()} == {i: (len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in ROWS}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = {i: (len(e := E.encode_ordinary(t or "")), sha(",".join(map(str, e)).encode()), sha((t or "").encode())) for i, t in ROWS}
    assert {r["doc_id"]: tuple(r)[1:] for r in byte_bpe.digest(docs, RANKS, P.PATTERN).collect()} == want
    cut = {r["doc_id"]: r for r in substring_dedup.report(docs.union(frame(spark, [(7, f"x {LONG[:2_000_000]} y"), (8, LONG[1000:90_000])]))).collect()}
    assert all(cut[i]["text"] == t for i, t in ROWS if i != 3) and len(cut[7]["text"].split()) < 60 and len(cut[8]["text"].split()) < 60 and len(cut[3]["text"].split()) < 3
    model = language_id.fit(spark.createDataFrame([(i, w, "x") for i, w in enumerate(WORDS[:200])], "doc_id long, text string, lang string"))
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()} == {1: "x", 2: "x", 3: "x", 4: "und", 5: "und", 6: "x"}
    scored = grade_model.score(docs, grade_model.Model(np.ones(grade_model.SIZE, np.float32), np.array([0.0, 1.0]))).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["tail_probability"] <= 1 for r in scored)
    assert {r["doc_id"]: r["size"] for r in mixing.plan(docs.withColumnRenamed("kept", "source")).collect()} == {i: base(t)[0] for i, t in ROWS}
    assert {(r["query_id"], r["doc_id"]) for r in topk_search.search(docs, docs.where("doc_id < 3"), k=1).collect()} == {(1, 1), (2, 2)}
    chats = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", f"turn {t} <|end|>") for t in range(20_000)] + [(2, 0, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.digest(chats).collect()}
    assert got[1]["n_turns"] == 20_000 and got[1]["loss_chars"] == sum(len(f"turn {t} <|end|>") for t in range(0, 20_000, 2)) and got[2]["loss_sha256"] == sha(LONG.encode())


def test_columns_called_like_our_own(spark):
    names = ["fp", "least", "root", "node", "component_id", "rejected", "score", "lang_pred", "begin", "end", "from", "__x", "rid", "nth", "copies", "removed", "words", "at"]
    rows = [(i, f"some words of text number {i % 7} and more of them {'again ' * (i % 5)}", "s", "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    docs = docs.selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in names])
    model = language_id.fit(docs)
    for done in (simhash.keep_first(docs), language_id.keep_accepted(docs, model), substring_dedup.rewrite(docs), mixing.mix(docs)):
        assert done.columns == docs.columns
        assert all(r[n] == f"{n}{r['doc_id']}" for r in done.collect() for n in names)
    for done in (simhash.near_copies(docs), language_id.predict(docs, model), quality_rules.judge(docs), mixing.plan(docs), topk_search.search(docs, docs), token_binary.round_trip(docs, JSON), byte_bpe.digest(docs, RANKS, P.PATTERN)):
        assert done.count() >= 40
