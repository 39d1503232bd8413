"""Links of peaks and genes by blocks: held against all pairs, on odd rows, with no row per link before the result asks for it."""

import numpy as np
import pytest

from tessella.operators import intervals

REACH, PROMOTER, WIDTH = 50, 20, 100


@pytest.fixture
def tables(spark, monkeypatch):
    """Peaks longer than bins, reversed, with equal ends, recurring ids, without a place; genes of any length, alike or without a strand."""
    monkeypatch.setattr(intervals, "BLOCK", 7)
    monkeypatch.setattr(intervals, "PAIRS", 64)
    rng = np.random.default_rng(4)
    starts, sizes = rng.integers(0, 3000, 150).tolist(), rng.choice([0, 5, 99, 100, 101, 450, -30], 150).tolist()
    peaks = [(i, f"chr{i % 2}", s, s + n, s + n // 2) for i, (s, n) in enumerate(zip(starts, sizes, strict=True))]
    peaks += [(200 + i, *peaks[i % 4][1:]) for i in range(12)] + [(5, "chr0", 700, 760, 730), (5, "chr1", 40, 90, 65), (None, "chr0", 10, 60, 30), (None, "chr1", 10, 60, 35)]
    peaks += [(300, None, 1, 2, 1), (301, "chr0", None, 9, None), (302, "chr9", 1, 2, 1), (303, "chr1", -40, -20, -30)]
    begin = rng.integers(0, 3000, 60).tolist()
    genes = [(f"G{i}", f"chr{i % 2}", s, s + int(rng.choice([0, 30, 100, 900])), "+-"[i % 3 > 0]) for i, s in enumerate(begin)]
    genes += [("G7", "chr0", 720, 800, None), ("H", *genes[3][1:]), ("I", "chr0", 0, 40, "+"), ("J", "chr1", 2000, 1900, "-")]
    make = spark.createDataFrame
    return make(peaks, "peak long, chrom string, p0 long, p1 long, centre long").repartition(3), make(genes, "gene string, chrom string, g_start long, g_end long, strand string").repartition(3)


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def links_by_pairs(peaks, genes):
    """(peak, gene, distance, body, promoter, weight) of every pair that overlaps."""
    for peak, chrom, p0, p1, _ in peaks.collect():
        for gene, on, g0, g1, strand in genes.collect():
            if None in (chrom, p0, p1) or chrom != on or not (p0 <= g1 + REACH and p1 >= max(g0 - REACH, 0)):
                continue
            tss = g0 if strand == "+" else g1
            off = (p0 + p1) // 2 - tss
            body, near = p0 <= g1 and p1 >= g0, p0 <= tss + PROMOTER and p1 >= max(tss - PROMOTER, 0)
            yield peak, gene, abs(off), body, near, (np.exp(-0.5 * (off / 50000) ** 2) + 0.5 * body + 5.0 * near) * (1.0 if (off if strand == "+" else -off) < 0 else 0.8)


def test_summary_of_every_pair(tables):
    want = {}
    for _, gene, *x in links_by_pairs(*tables):
        want.setdefault(gene, []).append((1, x[2], x[1], x[0], x[3]))
    want = [(g, n := len(x), sum(r[1] for r in x), sum(r[2] for r in x), round(sum(r[3] for r in x) / n, 9), round(float(sum(r[4] for r in x)), 9)) for g, x in want.items()]
    assert rows(intervals.summary_of(*tables, REACH, PROMOTER, WIDTH)) == sorted(want, key=str)
    links = intervals.peak_gene_links(*tables, REACH, PROMOTER, WIDTH, 5.3)
    assert rows(intervals.summary_of(*tables, REACH, PROMOTER, WIDTH, 5.3)) == rows(intervals.annotation_summary(links))


def test_closest_genes_of_every_centre(tables):
    peaks, genes = (t.collect() for t in tables)
    least, found = {}, []
    for peak, chrom, _, _, c in peaks:
        for gene, on, g0, g1, _ in genes:
            if chrom == on and c is not None and max(g0 - REACH, 0) <= c <= g1 + REACH:
                near = min(abs(c - g0), abs(c - g1))
                least[peak] = min(near, least.get(peak, near))
                found.append((near, peak, gene, 0 if g0 <= c <= g1 else near, g1 - g0))
    assert rows(intervals.nearest_owners(*tables, REACH, WIDTH)) == sorted((x[1:] for x in found if x[0] == least[x[1]]), key=str)


@pytest.mark.parametrize("name", ["annotation_summary", "nearest_owner_activity"])
def test_no_row_of_each_pair(spark, monkeypatch, name):
    from tessella.plans.catalog import QUERIES

    monkeypatch.setattr(intervals, "overlap_join", lambda *a: pytest.fail("pairs of peaks and windows as rows"))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_weights_of_every_link(tables):
    of = {}
    for peak, gene, *x in links_by_pairs(*tables):
        of.setdefault(peak, []).append((-x[3], gene, *x))
    want = []
    for peak, x in of.items():
        total = sum(r[5] for r in x)
        want += [(peak, r[1], *r[2:5], round(float(r[5]), 9), round(float(r[5] / total), 9), k) for k, r in enumerate(sorted(x, key=lambda r: (round(r[0], 12), r[1])), 1)]
    # Ranks of rows that agree in all else are open.
    plain = lambda made: sorted((r[:7] for r in made), key=str)
    got = rows(intervals.each_peak(intervals.best_genes_of(*tables, REACH, PROMOTER, WIDTH)))
    assert plain(got) == plain(want) and sorted((str(r[0]), r[7], r[5]) for r in got) == sorted((str(r[0]), r[7], r[5]) for r in want)


def test_links_are_not_shuffled(spark, monkeypatch):
    from tessella.plans.catalog import QUERIES

    shuffled, rank = [], intervals.best_genes
    monkeypatch.setattr(intervals, "best_genes", lambda links: shuffled.append(links.count()) or rank(links))
    assert QUERIES["peak_gene_weights"](spark, "/root/testdata/sf0.001").count() == 112 and sum(shuffled) == 0


@pytest.mark.parametrize("how, normalise, log", [("weighted_sum", "total_weight", False), ("weighted_mean", "n_peaks", True), ("max_weighted", "archR", False), ("sum", "total_weight", True), ("sum", "none", False)])
def test_activity_of_every_cell(spark, tables, how, normalise, log):
    """Cells of one count and of very many, without an id, counts without a value or without a peak, and in two rows."""
    rng = np.random.default_rng(5)
    cells = rng.choice([1, 2, 3, 4, 5, 6, 7, 7, 7, 7, 7, 7, None], 400).tolist()
    found = [(c, int(p), None if v > 8 else float(v)) for c, p, v in zip(cells, rng.integers(0, 220, 400), rng.integers(1, 10, 400), strict=True)]
    found += [(8, 3, None), (9, None, 2.0), (None, None, 2.0), (10, 302, 1.0), (11, 5, 2.0), (11, 5, 3.0)]
    links, met = list(links_by_pairs(*tables)), {}
    for c, p, v in found:
        for peak, gene, _, _, _, w in links:
            if p is not None and p == peak:
                met.setdefault((c, gene), []).append((v, w))
    want = []
    for (c, gene), x in met.items():
        some = [(v, w) for v, w in x if v is not None]
        value = {"sum": lambda s: sum(v for v, _ in s), "max_weighted": lambda s: max(v * w for v, w in s)}.get(how, lambda s: sum(v * w for v, w in s))(some) if some else None
        if value is not None:
            value /= sum(w for _, w in x) if how == "weighted_mean" else 1
            value /= {"total_weight": sum(y[5] for y in links if y[1] == gene), "n_peaks": sum(y[1] == gene for y in links)}.get(normalise, 1)
            value = np.log2(value + 1) if normalise == "archR" else value
            value = round(float(np.log1p(value) if log else value), 9)
        want.append((c, gene, value))
    counts = spark.createDataFrame(found, "cell_id long, peak long, value double")
    got = intervals.activity_of(counts, *tables, REACH, PROMOTER, WIDTH, how, normalise, log)
    near = lambda made: [(*r[:2], None if r[2] is None else round(r[2], 7)) for r in sorted(made, key=str)]
    assert near(rows(got)) == near(want)
    few = {r[:2] for r in rows(intervals.activity_of(counts, *tables, REACH, PROMOTER, WIDTH, how, "none", least=5.3))}
    assert few == {(c, gene) for c, p, _ in found for peak, gene, *_, w in links if p is not None and p == peak and w >= 5.3}
    none = tables[1].where("gene is null")
    assert not intervals.activity_of(counts, tables[0], none, REACH, PROMOTER, WIDTH, how, normalise, log).count()


@pytest.mark.parametrize("name", ["gene_activity_sum", "gene_activity_weighted_sum", "gene_activity_weighted_mean", "gene_activity_max_weighted"])
def test_neither_links_nor_sums_are_shuffled(spark, monkeypatch, name):
    from tessella.plans.catalog import QUERIES

    monkeypatch.setattr(intervals, "overlap_join", lambda *a: pytest.fail("pairs of peaks and windows as rows"))
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString().splitlines()
    met = next(i for i, x in enumerate(plan) if "MapInArrow" in x)
    assert not any("Exchange" in x or "Aggregate" in x or "Join" in x for x in plan[:met])
