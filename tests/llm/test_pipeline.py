import base64
import hashlib
from collections import Counter

import duckdb
import pandas as pd
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tessella.llm import language_id, mixing
from tessella.llm.common import table

from .test_simhash import brute, plain
from .test_text_operators import plain_dedup

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialize(stage(spark, now, SF), name)
        assert now.columns == columns and now.count() > 0


def test_pipeline_against_plain_python(spark):
    """Every stage's decisions, one after the other: the model's own predictions, then all pairs of fingerprints, all runs of words, the mix's SQL and
    the library, on plain lists."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = sorted((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
    model = language_id.fit(docs.where(~language_id.held_out()))
    rejected = model.predict([t for _, t, _ in rows])[2]
    rows = [r for r, no in zip(rows, rejected, strict=True) if not no]
    least = {i: least for i, _, least in brute([(i, plain(t)) for i, t, _ in rows])}
    rows = [r for r in rows if least[r[0]] == r[0]]
    texts = {i: t for i, t, *_ in plain_dedup([r[:2] for r in rows])}
    documents = pd.DataFrame([(i, texts[i], s) for i, _, s in rows], columns=["doc_id", "text", "source"])
    con = duckdb.connect()
    con.register("documents", documents)
    taken = {r[0]: (r[1], r[4]) for r in con.sql(mixing.SQL).fetchall()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = Counter()
    for i, t in texts.items():
        ids = enc.encode_ordinary(t)
        size, words = taken[i]
        if size:
            want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())] = words // size
    got = Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect() if taken[r["doc_id"]][0])
    assert got == +want and sum(got.values()) > 500


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
