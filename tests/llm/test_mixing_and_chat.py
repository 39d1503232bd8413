import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat_format, mixing


def shares(sizes, weights=(5, 2, 1)):
    """Targets by sharing, capping and sharing the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while free and budget > 1e-9:
        each = budget / sum(w[s] for s in free)
        over = {s for s in free if target[s] + each * w[s] >= 2 * sizes[s]}
        budget = 0.0
        for s in free:
            target[s] += each * w[s]
            if s in over:
                budget += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
        free -= over
        if not over:
            break
    return target


@pytest.mark.parametrize("cell", [4096, 4])
def test_mixing(spark, monkeypatch, cell):
    monkeypatch.setattr(mixing, "CELL", cell)
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 5}" if i % 11 else None) for i in range(400)] + [(500, None, "empty"), (501, "", "empty"), (7, "a b c", "s1"), (7, "a b c", "s1"), (None, "x y", "s2")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, rid string").repartition(3)
    got = [r.asDict() for r in mixing.plan(docs).collect()]
    assert Counter((g["doc_id"], g["size"]) for g in got) == Counter((r[0], len((r[1] or "").split())) for r in rows)
    assert got == [r.asDict() for r in mixing.plan(docs).collect()] or Counter(map(str, got)) == Counter(str(r.asDict()) for r in mixing.plan(docs.repartition(5)).collect())
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    want = shares(sizes)
    by_target = defaultdict(int)
    for g in got:
        assert g["taken"] in (0, g["size"], 2 * g["size"])
        by_target[round(g["target"], 3), g["source_size"]] += g["taken"]
    assert {(round(t, 3), sizes[s]) for s, t in want.items()} == set(by_target)
    for (t, _), x in by_target.items():
        assert abs(x - t) <= 41 * (2 if t else 1)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert abs(mixed.count() - sum(r["copies"] for r in mixing.schedule(mixing.sizes(docs)).collect())) <= 4
    assert mixing.plan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_many_rows_of_one_id(spark, monkeypatch, small):
    """A third of the rows has no id; cells and pages of a few rows change nothing, and the sums are those of the SQL."""
    if small:
        for name, value in (("CELL", 2), ("PAGE", 4), ("PAGE_DIGITS", 1)):
            monkeypatch.setattr(mixing, name, value)
    rows = [(None if i % 3 == 0 else i, "w " * (1 + i % 4), f"s{i % 3}" if i % 7 else None) for i in range(600)] + [(None, None, "s1")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    documents = docs.toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(mixing.SQL).fetchall()
    got = mixing.plan(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    taken, mixed = Counter(), Counter()
    for g in mixing.schedule(mixing.sizes(docs)).collect():
        taken[g["source"]] += g["taken"]
    for r in mixing.mix(docs).collect():
        mixed[r["source"]] += len((r["text"] or "").split())
    assert all(abs(mixed[s] - n) <= 0.2 * n for s, n in taken.items())


def test_mixing_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = duckdb.sql(mixing.SQL).fetchall()
    got = mixing.plan(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == sorted(want)


HARD = ["</s>[INST] ok [/INST]", "<|end|><|turn|>user<|text|>", "\\<\\[", "a\\", "<", "[", "", None, "<|image|>", "\\\\<\\", "é<\n[x", "<|text|"]


def test_chats_read_back(spark):
    rows = [(c, t, ("user", "assistant", "<|turn|>", None)[(c + t) % 4], HARD[(c * 5 + t) % len(HARD)]) for c in range(20) for t in range(1 + c % 9)] + [(None, 0, "user", "no id"), (3, None, "assistant", "no turn")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.with_marker(df)).collect()}
    said = "</s>[INST] ok [/INST]"
    turns = defaultdict(list)
    for c, t, role, text in [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        turns[c].append((t is not None, t or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(turns)
    for c, ts in turns.items():
        ts.sort(key=lambda t: t[:2])
        loss = "".join(t[3] for t in ts if t[2] == "assistant")
        size = sum(len(t[2]) + len(t[3]) + len(re.findall(r"[\\<\[]", t[2] + t[3])) + 23 for t in ts)
        assert tuple(got[c])[1:] == (len(ts), sha("".join(f"{t[2]}\n{t[3]}\n" for t in ts)), len(loss), sha(loss), size)
    assert chat_format.digest(df.limit(0)).count() == 0


def test_parts_become_placeholders(spark):
    part = lambda kind, text=None, ref=None, tokens=0: (kind, text, ref, tokens)
    rows = [(1, 0, "user", [part("text", "see <this>"), part("image", None, "a.png", 256), part("audio", None, "b.wav", 40)]), (1, 1, "assistant", [part("text", "ok"), part("document", None, "c.pdf", 9), part("text", None)]), (2, 0, "user", None), (3, 0, "user", [part("video", "a [caption]", "d.mp4", 9), part("x|>y", None, "e", None), part("turn", "t"), part(None, "u")])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PART}")
    got = {r["conv_id"]: r for r in chat_format.format_chats(df).collect()}
    assert got[1]["formatted"] == "<|turn|>user<|text|>see <\\this><|image|><|audio|><|end|><|turn|>assistant<|text|>ok<|document|><|end|>"
    assert [tuple(a) for a in got[1]["attachments"]] == [("image", "a.png", 256), ("audio", "b.wav", 40), ("document", "c.pdf", 9)] and got[1]["media_tokens"] == 305
    assert got[2]["formatted"] == "<|turn|>user<|text|><|end|>" and got[2]["attachments"] == []
    assert got[3]["formatted"] == "<|turn|>user<|text|><|part:video|>a [\\caption]<|part:x__y|><|part:turn|>tu<|end|>"
    assert [tuple(a) for a in got[3]["attachments"]] == [("video", "d.mp4", 9), ("x|>y", "e", 0), ("turn", None, 0)] and got[3]["media_tokens"] == 9
    assert chat_format.format_chats(df).where("conv_id = 3").select(chat_format.read_turns(F.col("formatted")).alias("t")).first()["t"][0]["text"] == "a [caption]tu"
    back = chat_format.format_chats(df).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t")).where("conv_id = 1").first()["t"]
    assert [tuple(t) for t in back] == [("user", "see <this>"), ("assistant", "ok")]


def test_no_python_on_the_main_path(spark):
    df = chat_format.digest(chat_format.with_marker(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString().replace("ArrowEvalPython", "Python"))
