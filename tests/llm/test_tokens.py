import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import byte_bpe, token_binary
from tessella.llm.pieces import text_of, units

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " ", "\n", "  two  blanks ", "a\nb", "a\n\nb", "\na", "a\n", "a \nb", "tab\there", "it's we'll nbsp", "x\0y \0z", "\0", "été Straße 123 !!\nÉ.", "<|endoftext|> a", "see <|endoftext|> here<|endoftext|>", "end.\nNext, word", "𐐀 ͸ ʰ", "a  b", "日本語 テキスト。", "word " * 3000]


def ranked():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


T, E = Tokenizer.from_file(JSON), ranked()  # as the library sets it up


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*" \n\t.,'!as1é\0 \x1c\x85", "<|endoftext|>", "<|endof"]), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
def test_units_encode_as_the_text(text):
    assert "".join(map(text_of, units(text))) == text
    library = token_binary.encoder(open(JSON, encoding="utf-8").read(), 2)
    want = T.encode(text, add_special_tokens=False).ids
    got, ends = token_binary.encode(pa.array([text, None, text]), library, np.array([2], "<u2"))
    assert (got.tolist(), ends.tolist()) == ([*want, 2, 2, *want, 2], [len(want) + 1, len(want) + 2, 2 * len(want) + 3])
    assert [i for u in units(text) for i in E.encode_ordinary(text_of(u))] == E.encode_ordinary(text)


@given(st.lists(st.integers(0, 5000), max_size=200), st.integers(0, 70000))
def test_elias_fano(values, more):
    values = sorted(values)
    ef = token_binary.EliasFano.of(np.array(values, np.int64), (values[-1] if values else 0) + 1 + more)
    n = len(values)
    assert ef.select(0, n).tolist() == values == [int(ef.select(i)[0]) for i in range(n)]
    assert all(ef.select(i, j).tolist() == values[i:j] for i in range(0, n, 7) for j in range(i, n, 13))
    with pytest.raises(IndexError):
        ef.select(len(values))


def docs(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(None, "no id", 1), (3, "again", 2), (3, "again", 2), (None, None, 3)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, block long").repartition(3)


def test_token_binary(spark, monkeypatch):
    monkeypatch.setattr(token_binary, "SHARD_IDS", 50)
    rows, df = docs(spark)
    got = [tuple(r) for r in token_binary.round_trip(df, JSON).collect()]
    ids = lambda t: T.encode(t or "", add_special_tokens=False).ids + [2]
    crc = lambda t: zlib.crc32(np.array(ids(t), "<u4").tobytes())
    key = lambda x: (x[0] is not None, x)
    assert sorted(((g[0], g[2], g[3]) for g in got), key=key) == sorted(((r[0], len(ids(r[1])), crc(r[1])) for r in rows), key=key)
    ordered = sorted(got, key=lambda g: g[1])
    assert [g[1] for g in ordered] == np.concatenate([[0], np.cumsum([g[2] for g in ordered])[:-1]]).tolist()
    assert [g[0] for g in ordered] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_binary.round_trip(empty, JSON).count() == 0


def test_byte_bpe(spark, monkeypatch):
    rows, df = docs(spark)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = sorted((str(i), len(e := E.encode_ordinary(t or "")), sha(",".join(map(str, e)).encode()), sha((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, byte_bpe.digest(df, RANKS, P.PATTERN).collect())) == want
    monkeypatch.setattr(byte_bpe, "BLOCK", 1)
    encoded = byte_bpe.encode(df, RANKS, P.PATTERN)
    assert sorted((str(r[0]), r[1]) for r in encoded.collect()) == sorted((str(i), E.encode_ordinary(t or "")) for i, t, _ in rows)
    assert sorted((str(r[0]), bytes(r[1])) for r in byte_bpe.decode(encoded, RANKS).collect()) == sorted((str(i), (t or "").encode()) for i, t, _ in rows)
    assert byte_bpe.digest(spark.createDataFrame([], "doc_id long, text string"), RANKS, P.PATTERN).count() == 0


def test_documents_against_the_libraries(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in byte_bpe.digest(df, RANKS, P.PATTERN).collect():
        e = E.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    for r in token_binary.round_trip(df, JSON).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array(T.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2], "<u4").tobytes())
