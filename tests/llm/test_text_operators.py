"""Quality rules, language ID, ordinal grades, repeated lines: edge cases against plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import grade_model, language_id, quality_rules, substring_dedup

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three one two three one two"), (None, "x y z"), (6, "é #|\x0b$"), (6, "é #|\x0b$"), (7, "a b\na b\n\na b"), (8, "Word word " * 40), (9, "w" * 5000)]


def frame(spark, rows, extra=""):
    return spark.createDataFrame([(*r, "x") for r in rows], f"doc_id long, text string, kept string{extra}").repartition(3)


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if win[tuple(w[i : i + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    got = quality_rules.judge(frame(spark, ODD)).collect()
    assert Counter((r["doc_id"], *tuple(r)[1:6]) for r in got) == Counter((i, *base(t)) for i, t in ODD)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in got)
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_the_order_of_the_cascade_changes_no_verdict():
    texts = [t for _, t in ODD] + ["good plain words in a row " * 12, "#a $b " * 60, "ABC DEF GHI jkl " * 20]
    verdicts = {tuple(quality_rules.passes(quality_rules.Document(t), order) for t in texts) for order in (quality_rules.RULES, quality_rules.RULES[::-1])}
    assert len(verdicts) == 1
    cheap = quality_rules.cascade(quality_rules.RULES[:3], [(100, 10, 1000), (100, 10, 10), (100, 0, 10)])
    assert cheap == [quality_rules.RULES[1], quality_rules.RULES[2], quality_rules.RULES[0]] or cheap[0] == quality_rules.RULES[1]


def test_costs_and_rejections_are_measured_behind_the_base_rules(spark):
    plain = [(i, f"{' '.join(f'word{k}of{i}' for k in range(60))}") for i in range(40)]
    loud = [(None, f"{' '.join(f'WORD{k}OF{i}' for k in range(60))}") for i in range(10)]
    short = [(None, f"#$ ## {i}") for i in range(300)]
    measures = quality_rules.measure_rules(frame(spark, plain + loud + short), quality_rules.RULES, 10_000, "doc_id", "text")
    assert [m[0] for m in measures] == [50] * 6 and [m[1] for m in measures] == [0, 10, 0, 0, 0, 0] and all(m[2] > 0 for m in measures)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))
    rows = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out()).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["lang"]]) > 0.97
    odd = {r["doc_id"]: r for r in language_id.predict(frame(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "the")]), model).collect()}
    assert [odd[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(odd[i]["rejected"] and odd[i]["score"] == 0 for i in (1, 2, 3))
    assert odd[4]["lang_pred"] in model.languages and 0 <= odd[4]["score"] <= 1
    none = language_id.fit(frame(spark, []).selectExpr("doc_id", "text", "kept as lang"))
    assert {r["lang_pred"] for r in language_id.predict(frame(spark, ODD), none).collect()} == {"und"}


def test_ngram_counts_of_one_text_do_not_depend_on_its_neighbours():
    texts = ["ab cd", "", "  x", "cd", "ÄÖ 1 é"]
    together, has = language_id.ngram_counts(texts)
    for i, t in enumerate(texts):
        alone, one = language_id.ngram_counts([t])
        assert (alone[0] == together[i]).all() and one[0] == has[i]


def test_grades_in_order(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = grade_model.fit(docs, grade_model.ratings(labels.where("doc_id % 3 <> 0")))
    assert (np.diff(model.thresholds) > 0).all()
    rows = grade_model.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["toxic"]]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(junk) < 0.1 and np.mean([r["kept"] for r in rows if r["toxic"]]) < 0.05
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows)
    one = grade_model.fit(docs, labels.where("quality = 1").selectExpr("doc_id", "2 as grade"))
    assert {r["kept"] for r in grade_model.score(frame(spark, ODD), one).collect()} == {True}
    assert grade_model.score(frame(spark, []), model).count() == 0


def test_features_by_their_definition():
    texts = ["", None, "  one  One, one two two thousand THOUSANDS\nline\nline", " \n", "a#b $$$ 12 12 Été."]
    owner, at, value = grade_model.features(pa.array(texts))
    assert (np.diff(owner) >= 0).all()
    for i, t in enumerate(texts):
        words = (t or "").split()
        n, want = max(1, len(words)), Counter()
        for w in set(words):
            bare, shape, stem = grade_model._places(w)
            want["w", bare] += words.count(w)
            want["s", shape] += words.count(w)
            if stem >= 0:
                want["w", stem] += words.count(w)
        lines = (t or "").split("\n")
        extra = [1, 8 * (1 - len(set(lines)) / len(lines)), 8 * sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 8 * max(0, 0.3 - len(set(words)) / n)]
        pairs = sorted([(k, np.sqrt(c * 20 / (n + 20)) if kind == "w" else 8 * c / n) for (kind, k), c in want.items()] + list(enumerate(extra)))
        got = sorted(zip(at[owner == i].tolist(), value[owner == i].tolist(), strict=True))
        assert [g[0] for g in got] == [p[0] for p in pairs] and np.allclose([g[1] for g in got], [p[1] for p in pairs], atol=1e-6)


def test_cumulative_link_by_brute_force():
    """Grades' probabilities from the definition; no weight or threshold near the fit has a higher likelihood less decay."""
    rng = np.random.default_rng(3)
    n, kinds, decay = 150, 4, 0.01
    x = rng.normal(size=(n, kinds))
    grade = np.searchsorted([-0.7, 0.8], x @ [1.5, -1, 0.5, 0] + rng.logistic(size=n))
    at, value, ends = np.tile(np.arange(kinds, dtype=np.int32), n), x.ravel(), np.arange(1, n + 1) * kinds
    model = grade_model.fit_matrix(at, value, ends, grade, 3, steps=3000, rate=0.01, decay=decay)

    def lost(w, cuts):
        share = 1 / np.bincount(grade)[grade]
        total = 0.0
        for row, g, s in zip(x, grade, share / share.sum(), strict=True):
            below = [0.0, *[1 / (1 + np.exp(-(c - row @ w))) for c in cuts], 1.0]
            total -= s * np.log(below[g + 1] - below[g])
        return total + decay / 2 * (w @ w)

    w, cuts = model.weights[:kinds].astype(float), model.thresholds
    best = lost(w, cuts)
    for k in range(kinds):
        assert all(lost(w + d * np.eye(kinds)[k], cuts) > best for d in (-0.05, 0.05))
    for k in range(2):
        assert all(lost(w, cuts + d * np.eye(2)[k]) > best for d in (-0.05, 0.05))
    p = model.below(np.array([0.3]))[0]
    assert np.allclose(p, [1 / (1 + np.exp(0.3 - c)) for c in cuts]) and cuts[0] < cuts[1]


def test_repeated_documents_and_labels_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(i % 3, f"good words of text {i % 90}" if i % 3 else f"bad $$ ## {i % 90}") for i in range(900)] + [(None, "x"), (9, None)], "doc_id long, text string")
    rated = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (1, 2), (None, 1), (77, 1)], "doc_id long, grade int")
    model = grade_model.fit(docs, rated, max_labels=70)
    found = {r["doc_id"]: r["kept"] for r in grade_model.score(docs, model).collect()}
    assert not found[0] and found[1] and found[2]
    assert (grade_model.fit(docs.limit(0), rated).thresholds == -50).all()


def plain_dedup(rows, passage=50, sep="\n"):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    last = 1 << 63
    rank = [last if i is None else i for i, _ in rows]
    lines: list = [None] * len(rows)
    for n, (_, t) in enumerate(rows):
        at, lines[n] = 0, []
        for x in (t or "").split(sep):
            lines[n].append((x, [y.lower() for y in word.findall(x)], at))
            at += len(x) + len(sep)
    first = {}
    for r, ls in zip(rank, lines, strict=True):
        for _, w, _ in ls:
            if w:
                first[tuple(w)] = min(first.get(tuple(w), last), r)
    out = []
    for r, ls in zip(rank, lines, strict=True):
        seen, group, gone = set(), [], set()
        for k, (_, w, _) in enumerate([*ls, ("", ["end of all"], 0)]):
            if not w:
                continue
            if k < len(ls) and (r > first[tuple(w)] or tuple(w) in seen):
                group.append(k)
            else:
                if sum(len(ls[g][1]) for g in group) >= passage:
                    gone |= set(group)
                group = []
            seen.add(tuple(w))
        out.append(gone)
    windows, own = {}, []
    for r, ls, gone in zip(rank, lines, out, strict=True):
        ws = [(x, k) for k, (_, w, _) in enumerate(ls) for x in w]
        mine = {}
        for p in range(len(ws) - passage + 1):
            if any(k not in gone for _, k in ws[p : p + passage]):
                mine.setdefault(tuple(x for x, _ in ws[p : p + passage]), []).append(p)
        for h in mine:
            windows[h] = min(windows.get(h, last), r)
        own.append(mine)
    done = []
    for (i, t), r, ls, gone, mine in zip(rows, rank, lines, out, own, strict=True):
        goes = {q for h, ps in mine.items() for p in ps if r > windows[h] or p >= ps[0] + passage for q in range(p, p + passage)}
        kept, spans, q = [], [], 0
        for k, (x, w, at) in enumerate(ls):
            if k in gone:
                spans.append((at, at + len(x)))
                q += len(w)
                continue
            left, cuts = 0, []
            for m in word.finditer(x):
                if q in goes:
                    if cuts and cuts[-1][2] == q - 1:
                        cuts[-1][1:] = [m.end(), q]
                    else:
                        cuts.append([m.start(), m.end(), q])
                q += 1
            piece = ""
            for a, b, _ in cuts:
                piece, left = piece + x[left:a], b
            kept.append(piece + x[left:])
            spans += [(at + a, at + b) for a, b, _ in cuts]
        done.append((i, t if t is None else sep.join(kept), len(spans), ",".join(f"{a}-{b}" for a, b in spans)))
    return Counter(done)


def passage_rows():
    """Passages in lines, across lines, inside differing lines, within one text, in copies, overlapping, short ones, odd ones."""
    say = lambda n, seed: [f"{'Äb' if (k * seed) % 5 == 0 else 'w'}{(k * 7 + seed * 131) % 997}" for k in range(n)]
    long = " ".join(say(70, 1))
    three = "\n".join(" ".join(say(20, s)) for s in (2, 3, 4))
    short = "this  line has Six words\there"
    wide = " ".join(say(140, 5))
    return [
        *ODD, (20, f"{short}\nother\n{short.upper()}"), (10, f"é é\n{short} "), (None, short), (12, "a b c d\na b c d"),
        (30, f"own start {long} own end"), (31, f"Another beginning {long.upper()}\n and more"), (32, f"{long}"), (None, f"x {long} y"), (None, f"x {long} y"),
        (40, f"{three}\n"), (41, f"head\n{three}\ntail"), (42, f"{three}"), (43, " ".join(say(20, 2)) + "\n\n \n" + " ".join(say(20, 3)) + "\nx\n" + " ".join(say(20, 4))), (44, f"a {three.replace(chr(10), ' ')} b"), (44, f"c {three} d"),
        (50, f"{wide} middle {wide}"), (51, f"one\ttwo\r\n{wide} three {long}"), (52, " ".join(say(49, 5))), (53, "q " + " ".join(say(50, 5)) + " q"), (54, "same " * 130), (55, "same " * 60), (56, ("r s t u v w x y z \n" * 30)),
        (60, f"{wide}\n{three}\n{long}"), (61, "0 " + " ".join([*say(30, 2), *say(30, 3)])), (3, f"again {long}"), (3, f"again {long}"),
    ]


def test_substring_dedup(spark):
    rows = passage_rows()
    got = substring_dedup.report(frame(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == plain_dedup(rows)
    assert substring_dedup.report(frame(spark, [])).count() == 0


def test_substring_dedup_by_paragraph(spark):
    rows = [(i, t and t.replace("\n", "\n\n" if i and i % 2 else "\n\n\n")) for i, t in passage_rows()]
    got = substring_dedup.report(frame(spark, rows), unit="paragraph").collect()
    assert Counter(tuple(r) for r in got) == plain_dedup(rows, sep="\n\n")


def test_substring_dedup_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert Counter(tuple(r) for r in substring_dedup.report(docs).collect()) == want


def test_a_text_of_many_lines(spark):
    lines = [f"line {i} of a text with very many lines says {i * i}" for i in range(50_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[:40_000] + ["its own end"])), (3, " ".join(lines[100:200]))]
    got = {r["doc_id"]: r for r in substring_dedup.report(frame(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "its own end" and got[2]["n_removed"] == 40_000
    assert got[3]["text"] == "" and got[3]["n_removed"] == 1


def test_substring_dedup_keeps_columns_whatever_their_names(spark):
    rows = passage_rows()
    docs = frame(spark, rows).withColumnRenamed("kept", "removed").selectExpr("*", "length(text) as n_chars", "doc_id as begin", "1 as `from`")
    done = substring_dedup.rewrite(docs)
    assert done.columns == docs.columns and done.count() == len(rows) and {r["removed"] for r in done.collect()} == {"x"}
    assert all(r["n_chars"] == len(r["text"]) for r in done.where("text is not null").collect())


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_spans_are_those_of_the_original(spark, unit):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in substring_dedup.deduplicate(docs, unit=unit).collect():
        assert len(r["text"]) <= len(text[r["doc_id"]]) and all(0 <= s["start"] <= s["end"] <= len(text[r["doc_id"]]) for s in r["removed"])
