"""Interval joins and gene activity.

A range predicate alone plans a nested loop over all pairs. Here windows are spread over fixed-width bins, points or intervals over
the bins that they touch, and an equi-join on (chromosome, bin) meets them, followed by the exact predicate. A pair that meets in several bins
is kept in the bin where its overlap begins, so no distinct is needed.

Where links outnumber peaks and genes by far, they are no rows until the result asks for them: peaks in blocks meet the genes of their bin, and arrays hold the
links of some peaks at a time. There a peak has one bin, that of its start; bins are as wide as the longest peaks of their level, and genes reach one bin back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import peak_gene_weight

#: Peaks of a block, pairs that are looked at together.
BLOCK, PAIRS = 256, 1 << 19
PLACES = ("p0", "p1")
GENE = ("w_start", "w_end", "tss", "g_start", "g_end", "p_start", "p_end")


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_ends: tuple[str, str], right_ends: tuple[str, str], width: int) -> DataFrame:
    """All pairs with equal key whose closed intervals overlap."""
    spread = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    a = left.withColumn("__bin", spread(*left_ends))
    b = right.withColumnRenamed(key, "__key").withColumn("__bin2", spread(*right_ends))
    start = F.floor(F.greatest(F.col(left_ends[0]), F.col(right_ends[0])) / width)
    met = a.join(b, (F.col(key) == F.col("__key")) & (F.col("__bin") == F.col("__bin2")) & (F.col("__bin") == start))
    return met.where((F.col(left_ends[0]) <= F.col(right_ends[1])) & (F.col(left_ends[1]) >= F.col(right_ends[0]))).drop("__bin", "__bin2", "__key")


def gene_windows(genes: DataFrame, reach: int, promoter: int) -> DataFrame:
    """w_start, w_end; tss; p_start, p_end: the window and promoter follow the strand."""
    forward = F.col("strand") == "+"
    tss = F.when(forward, F.col("g_start")).otherwise(F.col("g_end"))
    return genes.withColumns({"w_start": F.greatest(F.col("g_start") - reach, F.lit(0)), "w_end": F.col("g_end") + reach, "tss": tss, "p_start": F.greatest(tss - promoter, F.lit(0)), "p_end": tss + promoter})


def peak_gene_links(peaks: DataFrame, genes: DataFrame, reach: int, promoter: int, width: int, least: float = 0.0) -> DataFrame:
    """peak, gene, distance of the peak's centre to the start of transcription, body, promoter, weight."""
    pairs = overlap_join(peaks, gene_windows(genes, reach, promoter), "chrom", ("p0", "p1"), ("w_start", "w_end"), width)
    centre = F.floor((F.col("p0") + F.col("p1")) / 2)
    distance = F.abs(centre - F.col("tss"))
    relative = F.when(F.col("strand") == "+", centre - F.col("tss")).otherwise(F.col("tss") - centre)
    body = (F.col("p0") <= F.col("g_end")) & (F.col("p1") >= F.col("g_start"))
    near = (F.col("p0") <= F.col("p_end")) & (F.col("p1") >= F.col("p_start"))
    out = pairs.select("peak", "gene", distance.alias("distance"), body.alias("body"), near.alias("promoter"), relative.alias("relative"))
    return out.withColumn("weight", peak_gene_weight(F.col("distance"), F.col("body"), F.col("promoter"), F.col("relative"))).where(F.col("weight") >= least).drop("relative")


def best_genes(links: DataFrame) -> DataFrame:
    """Weights of a peak brought to sum 1, and their rank, best first."""
    peak = Window.partitionBy("peak")
    return links.withColumn("share", F.col("weight") / F.sum("weight").over(peak)).withColumn("rank", F.row_number().over(peak.orderBy(F.desc("weight"), "gene")))


def packed(df: DataFrame, keys: list[str], name: str, columns: tuple[str, ...], each: int) -> DataFrame:
    """Rows of equal keys in lists of about so many: a list of structs per row."""
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / each).alias("__parts"))
    dealt = df.join(sizes, keys).withColumn("__part", F.pmod(F.xxhash64(*columns), F.col("__parts")))
    return dealt.groupBy(*keys, "__part").agg(F.collect_list(F.struct(*columns)).alias(name)).drop("__part")


def spread_out(df: DataFrame) -> DataFrame:
    """As many partitions as the session has for shuffles: blocks are small, the work on them isn't. An Arrow batch of 10,000 of them would not fit beside the heap."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def link_blocks(peaks: DataFrame, genes: DataFrame, reach: int, promoter: int, width: int, held: str, columns: tuple[str, ...], genes_each: int | None) -> DataFrame:
    """Blocks of p, structs of p0, p1 and held, beside g, structs of columns and GENE: each pair that overlaps is in one block. Genes without both ends are in none."""
    q = F.floor(F.abs(F.col("p1") - F.col("p0")) / width)
    at = lambda c: F.floor(c / (F.lit(float(width)) * F.pow(F.lit(2.0), "__level")))
    placed = peaks.where("p0 is not null and p1 is not null").withColumn("__level", F.when(q == 0, 0).otherwise(F.length(F.bin(q))))
    placed = placed.withColumn("__bin", at(F.col("p0")))
    windows = gene_windows(genes.where("g_start is not null and g_end is not null"), reach, promoter)
    first, last = at(F.least("w_start", "w_end")) - 1, at(F.greatest("w_start", "w_end"))
    spread = windows.crossJoin(F.broadcast(placed.select("__level").distinct())).withColumn("__bin", F.explode(F.sequence(first, last)))
    spread = spread.withColumn("forward", F.coalesce(F.col("strand") == "+", F.lit(False)))
    keys = ["chrom", "__level", "__bin"]
    g = (*columns, "forward", *GENE)
    left = packed(placed, keys, "p", (*PLACES, held), BLOCK)
    right = packed(spread, keys, "g", g, genes_each) if genes_each else spread.groupBy(*keys).agg(F.collect_list(F.struct(*g)).alias("g"))
    return spread_out(left.join(right, keys).select("p", "g"))


def numbers(structs: pa.StructArray, name: str) -> np.ndarray:
    return structs.field(structs.type.get_field_index(name)).to_numpy(zero_copy_only=False)


def links_of(p: pa.StructArray, g: pa.StructArray, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Of some peaks at a time: places of peak and gene, distance, body, promoter, weight of each link."""
    p0, p1 = (numbers(p, c).astype(np.int64) for c in PLACES)
    w0, w1, tss, g0, g1, n0, n1 = (numbers(g, c).astype(np.int64) for c in GENE)
    forward = numbers(g, "forward").astype(bool)
    step = max(1, PAIRS // max(1, len(g)))
    for at in range(0, len(p), step):
        a, b = p0[at : at + step], p1[at : at + step]
        i, j = np.nonzero((a[:, None] <= w1) & (b[:, None] >= w0))
        a, b = a[i], b[i]
        off = (a + b) // 2 - tss[j]
        body, near = (a <= g1[j]) & (b >= g0[j]), (a <= n1[j]) & (b >= n0[j])
        weight = np.exp(-0.5 * (off / 50000.0) ** 2) + 0.5 * body + 5.0 * near
        weight *= np.where(np.where(forward[j], off, -off) < 0, 1.0, 0.8)
        links = i + at, j, np.abs(off), body, near, weight
        yield links if least <= 0 else tuple(x[weight >= least] for x in links)


def best_genes_of(peaks: DataFrame, genes: DataFrame, reach: int, promoter: int, width: int, least: float = 0.0) -> DataFrame:
    """The rows of best_genes(peak_gene_links(...)), as peaks (a list of peaks with the same ends), gene, distance, body, promoter, weight, share, rank.

    Nothing is shuffled by link. each_peak makes a row of each peak; what is computed from a row's other columns is cheaper before. The genes that
    reach into a bin stand in one row.
    """
    own = peaks.select("peak", "chrom", F.col("p0").cast("long").alias("p0"), F.col("p1").cast("long").alias("p1"))
    counted = own.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("peak")))
    alike = counted.where("__n = 1").groupBy("chrom", "p0", "p1").agg(F.collect_list("peak").alias("peaks"))
    met = link_blocks(alike, genes, reach, promoter, width, "peaks", ("gene",), None)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                p, g = one.column("p").flatten(), one.column("g").flatten()
                ids, names = p.field(p.type.get_field_index("peaks")), g.field(g.type.get_field_index("gene"))
                order = np.empty(len(g), np.int64)
                order[pc.sort_indices(names, null_placement="at_start").to_numpy()] = np.arange(len(g))
                for i, j, distance, body, near, weight in links_of(p, g, least):
                    by = np.lexsort((order[j], -weight, i))
                    i, j, distance, body, near, weight = (x[by] for x in (i, j, distance, body, near, weight))
                    share = weight / np.bincount(i, weight, len(p))[i]
                    rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
                    # A list of very many peaks isn't repeated at once for each of its genes.
                    much = max(1, (1 << 16) // max(1, pc.max(pc.list_value_length(ids)).as_py()))
                    for at in range(0, len(i), much):
                        to = slice(at, at + much)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[to])), names.take(pa.array(j[to])), *(pa.array(x[to]) for x in (distance, body, near, weight, share)), pa.array(rank[to], pa.int32())], ["peaks", "gene", "distance", "body", "promoter", "weight", "share", "rank"])

    kinds = {f.name: f.dataType.simpleString() for f in (*peaks.schema, *genes.schema)}
    made = met.mapInArrow(run, f"peaks array<{kinds['peak']}>, gene {kinds['gene']}, distance long, body boolean, promoter boolean, weight double, share double, rank int")
    # Peaks whose id recurs (or is null) share their weights over all its rows.
    again = best_genes(peak_gene_links(counted.where("__n > 1").drop("__n"), genes, reach, promoter, width, least))
    return made.unionByName(again.withColumn("peak", F.array("peak")).withColumnRenamed("peak", "peaks"))


def each_peak(links: DataFrame) -> DataFrame:
    rest = [c for c in links.columns if c != "peaks"]
    return links.select(F.explode("peaks").alias("peak"), *rest)


def summary_of(peaks: DataFrame, genes: DataFrame, reach: int, promoter: int, width: int, least: float = 0.0) -> DataFrame:
    """The rows of annotation_summary(peak_gene_links(...)), of sums per block and gene instead of links; peaks with the same ends count together."""
    alike = peaks.groupBy("chrom", F.col("p0").cast("long").alias("p0"), F.col("p1").cast("long").alias("p1")).agg(F.count("*").alias("n"))
    met = link_blocks(alike, genes, reach, promoter, width, "n", ("gene",), 4096)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                p, g = one.column("p").flatten(), one.column("g").flatten()
                n, sums = numbers(p, "n").astype(float), np.zeros((5, len(g)))
                for i, j, distance, body, near, weight in links_of(p, g, least):
                    n_i = n[i]
                    for k, x in enumerate((n_i, n_i * near, n_i * body, n_i * distance, n_i * weight)):
                        sums[k] += np.bincount(j, x, len(g))
                some = np.flatnonzero(sums[0])
                names = g.field(g.type.get_field_index("gene"))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), *(pa.array(np.rint(x[some]).astype(np.int64)) for x in sums[:4]), pa.array(sums[4][some])], ["gene", "n", "promoter", "body", "distance", "weight"])

    parts = met.mapInArrow(run, f"gene {genes.schema['gene'].dataType.simpleString()}, n long, promoter long, body long, distance long, weight double")
    return parts.groupBy("gene").agg(F.sum("n").alias("n_peaks"), F.sum("promoter").alias("n_promoter"), F.sum("body").alias("n_gene_body"), (F.sum("distance") / F.sum("n")).alias("mean_distance"), F.sum("weight").alias("total_weight"))


def annotation_summary(links: DataFrame) -> DataFrame:
    return links.groupBy("gene").agg(F.count("*").alias("n_peaks"), F.sum(F.col("promoter").cast("long")).alias("n_promoter"), F.sum(F.col("body").cast("long")).alias("n_gene_body"), F.avg("distance").alias("mean_distance"), F.sum("weight").alias("total_weight"))


def gene_activity(counts: DataFrame, links: DataFrame, how: str = "weighted_sum", normalise: str = "total_weight", log: bool = False) -> DataFrame:
    """cell_id, gene, activity over linked peaks. weighted_mean with total_weight divides by the weights twice, as users of the method know it."""
    met = counts.join(links, "peak")
    weighted = F.sum(F.col("value") * F.col("weight"))
    value = {"weighted_sum": weighted, "weighted_mean": weighted / F.sum("weight"), "max_weighted": F.max(F.col("value") * F.col("weight")), "sum": F.sum("value")}[how]
    per_gene = links.groupBy("gene").agg(F.count("*").alias("n_peaks"), F.sum("weight").alias("total_weight"))
    out = met.groupBy("cell_id", "gene").agg(value.alias("activity")).join(per_gene, "gene")
    scaled = {"n_peaks": F.col("activity") / F.col("n_peaks"), "total_weight": F.col("activity") / F.col("total_weight"), "archR": F.log2(F.col("activity") + 1), "none": F.col("activity")}[normalise]
    return out.select("cell_id", "gene", (F.log1p(scaled) if log else scaled).alias("activity"))


def near_genes(genes: dict[str, np.ndarray]) -> dict[int, list[np.ndarray]]:
    """For each chromosome's number, places of genes in the order of w_start, in lists of windows of like length: those that meet a peak stand together."""
    size = np.maximum(genes["w_end"] - genes["w_start"], 0)
    level = np.frexp(size.astype(float))[1]
    order = np.lexsort((genes["w_start"], level, genes["chrom"]))
    chrom, level = genes["chrom"][order], level[order]
    lists: dict[int, list[np.ndarray]] = {}
    for own in np.split(order, np.flatnonzero(np.diff(chrom) | np.diff(level)) + 1) if len(order) else []:
        lists.setdefault(int(genes["chrom"][own[0]]), []).append(own)
    return lists


def meetings(chrom: np.ndarray, p0: np.ndarray, p1: np.ndarray, genes: dict[str, np.ndarray], lists: dict[int, list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of peaks in the order that they came, and where the genes that each may meet begin and end in the lists, laid end to end."""
    rows, lo, hi, laid, at = [], [], [], [], 0
    for c, own in lists.items():
        some = np.flatnonzero(chrom == c)
        for genes_ in own:
            if len(some):
                start = genes["w_start"][genes_]
                longest = max(0, int((genes["w_end"][genes_] - start).max()))
                a, b = np.searchsorted(start, p0[some] - longest), np.searchsorted(start, p1[some], "right")
                met = b > a
                rows.append(some[met])
                lo.append(a[met] + at)
                hi.append(b[met] + at)
            laid.append(genes_)
            at += len(genes_)
    rows, lo, hi, laid = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, lo, hi, laid))
    by = np.argsort(rows, kind="stable")
    return rows[by], lo[by], hi[by], laid


def activity_of(counts: DataFrame, peaks: DataFrame, genes: DataFrame, reach: int, promoter: int, width: int, how: str = "weighted_sum", normalise: str = "total_weight", log: bool = False, least: float = 0.0, places: int | None = None) -> DataFrame:
    """The rows of gene_activity(counts, peak_gene_links(...)), rounded to so many places; values are doubles, a division by zero gives null.

    Counts meet their peaks, not links, and are grouped by cell; a cell meets the genes in its task, so neither links nor sums are shuffled. The genes
    with their totals, feature-sized, go through the driver to the tasks.
    """
    spark = counts.sparkSession
    windows = gene_windows(genes.where("g_start is not null and g_end is not null and gene is not null and chrom is not null"), reach, promoter)
    rows = windows.select("gene", "chrom", F.coalesce(F.col("strand") == "+", F.lit(False)).alias("forward"), *(F.col(c).cast("long") for c in GENE)).toArrow().combine_chunks()
    chroms, names = (pc.dictionary_encode(rows.column(c).combine_chunks()) for c in ("chrom", "gene"))
    gene = {c: rows.column(c).to_numpy() for c in ("forward", *GENE)} | {"chrom": chroms.indices.to_numpy(), "id": names.indices.to_numpy().astype(np.int64)}
    totals = np.ones(len(names.dictionary))
    if normalise in ("total_weight", "n_peaks"):
        summed = summary_of(peaks, genes, reach, promoter, width, least).where("gene is not null").select("gene", F.col(normalise).cast("double").alias("total")).toArrow()
        at = pc.index_in(summed.column("gene"), names.dictionary).to_numpy()
        totals[at] = summed.column("total").to_numpy()
    kinds = {f.name: f.dataType.simpleString() for f in (*counts.schema, *genes.schema)}
    numbered = spark.createDataFrame(list(enumerate(chroms.dictionary.to_pylist())), f"c int, chrom {kinds['chrom']}")
    placed = peaks.where("p0 is not null and p1 is not null").join(numbered, "chrom").select("peak", "c", F.col("p0").cast("long").alias("p0"), F.col("p1").cast("long").alias("p1"))
    dealt = counts.join(placed, "peak").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell_id")
    met = dealt.groupBy("cell_id").agg(F.collect_list(F.struct("c", *PLACES, F.col("value").cast("double").alias("v"))).alias("p"))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    shared, pairs = spark.sparkContext.broadcast((gene, names.dictionary, totals)), PAIRS

    def run(batches):
        gene, names, totals = shared.value
        lists, n_genes = near_genes(gene), len(names)
        most = max(1, 2 * pairs // max(1, n_genes))
        seen, number = np.zeros(most * n_genes, bool), np.zeros(most * n_genes, np.int32)

        def together(key, columns):
            """Sums of equal keys, the first column's maximum where that is asked."""
            seen[key] = True
            keys = np.flatnonzero(seen)
            seen[keys] = False
            number[keys] = np.arange(len(keys))
            at, out = number[key], []
            for k, x in enumerate(columns):
                if k == 0 and how == "max_weighted":
                    out.append(np.full(len(keys), -np.inf))
                    np.maximum.at(out[0], at, x)
                else:
                    out.append(np.bincount(at, x, len(keys)))
            return keys, out

        def links(of, row, lo, hi, laid, own):
            """Key of each link, and what is summed: value, weight, links with a value."""
            p0, p1, v, valid = of
            n = hi - lo
            i, j = np.repeat(row, n), laid[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)]
            a, b = p0[i], p1[i]
            near = gene["w_end"][j] >= a
            if not near.all():
                i, j, a, b = i[near], j[near], a[near], b[near]
            weight = None
            if how != "sum" or least > 0:
                off = (a + b) // 2 - gene["tss"][j]
                weight = np.exp(-0.5 * (off / 50000.0) ** 2) + 0.5 * ((a <= gene["g_end"][j]) & (b >= gene["g_start"][j]))
                weight += 5.0 * ((a <= gene["p_end"][j]) & (b >= gene["p_start"][j]))
                weight *= np.where(np.where(gene["forward"][j], off, -off) < 0, 1.0, 0.8)
                if least > 0:
                    held = weight >= least
                    i, j, weight = i[held], j[held], weight[held]
            value = v[i] if how == "sum" else v[i] * weight
            if valid is not None and how == "max_weighted":
                value[~valid[i]] = -np.inf
            columns = [value] + ([weight] if how == "weighted_mean" else []) + ([] if valid is None else [valid[i].astype(float)])
            return own[i] * n_genes + gene["id"][j], columns

        for batch in batches:
            ends = batch.column("p").offsets.to_numpy().astype(np.int64)
            p = batch.column("p").flatten()
            c, p0, p1 = (numbers(p, x).astype(np.int64) for x in ("c", *PLACES))
            v = p.field(p.type.get_field_index("v"))
            of = p0, p1, v.fill_null(0.0).to_numpy(zero_copy_only=False), v.is_valid().to_numpy(zero_copy_only=False) if v.null_count else None
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            row, lo, hi, laid = meetings(c, p0, p1, gene, lists)
            for first in range(0, batch.num_rows, most):
                begin, end = np.searchsorted(owner[row], [first, first + most])
                # As many rows at once as have about so many links, one at least.
                part = np.cumsum((hi - lo)[begin:end]) // pairs
                found = None
                for some in np.split(np.arange(begin, end), np.flatnonzero(np.diff(part)) + 1):
                    key, columns = links(of, row[some], lo[some], hi[some], laid, owner - first)
                    if found is not None:
                        key, columns = np.append(found[0], key), [np.append(x, y) for x, y in zip(found[1], columns, strict=True)]
                    found = together(key, columns)
                key, columns = found
                id_, null = key % n_genes, np.zeros(len(key), bool)
                value = columns[0]
                with np.errstate(divide="ignore", invalid="ignore"):
                    if how == "weighted_mean":
                        null |= columns[1] == 0
                        value = value / columns[1]
                    if of[3] is not None:
                        null |= columns[-1] == 0
                    if normalise in ("total_weight", "n_peaks"):
                        null |= totals[id_] == 0
                        value = value / totals[id_]
                    value = np.log2(value + 1) if normalise == "archR" else value
                    value = np.log1p(value) if log else value
                if places is not None:
                    value = np.copysign(np.floor(np.abs(value) * 10.0**places + 0.5) / 10.0**places, value)
                yield pa.RecordBatch.from_arrays([batch.column("cell_id").take(pa.array(first + key // n_genes)), names.take(pa.array(id_)), pa.array(value, mask=null)], ["cell_id", "gene", "activity"])

    return met.mapInArrow(run, f"cell_id {kinds['cell_id']}, gene {kinds['gene']}, activity double")


def closest(c: np.ndarray, g0: np.ndarray, g1: np.ndarray, w0: np.ndarray, w1: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (centre, gene) with no gene nearer whose window holds the centre. A gene's end within reach means that its window does, so ends in order answer most centres."""
    ends = np.concatenate([g0, g1])
    order = np.argsort(ends, kind="stable")
    ends = ends[order]
    after = np.searchsorted(ends, c)
    far = np.iinfo(np.int64).max
    left = np.where(after > 0, c - ends[np.maximum(after - 1, 0)], far)
    right = np.where(after < len(ends), ends[np.minimum(after, len(ends) - 1)] - c, far)
    d = np.minimum(left, right)
    sure = (d <= reach) & (c >= 0) & bool((g0 <= g1).all())
    pairs = []
    for end in (c - d, c + d):
        some = np.flatnonzero(sure)
        lo, hi = np.searchsorted(ends, end[some], "left"), np.searchsorted(ends, end[some], "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        pairs.append(np.repeat(some, n) * len(g0) + order[at] % len(g0))
    others = np.flatnonzero(~sure)
    step = max(1, PAIRS // len(g0))
    for at in range(0, len(others), step):
        some = others[at : at + step]
        x = c[some][:, None]
        near = np.where((w0 <= x) & (w1 >= x), np.minimum(np.abs(x - g0), np.abs(x - g1)), far)
        i, j = np.nonzero((near == near.min(axis=1, keepdims=True)) & (near < far))
        pairs.append(some[i] * len(g0) + j)
    found = np.unique(np.concatenate(pairs))
    return found // len(g0), found % len(g0)


def nearest_owners(peaks: DataFrame, genes: DataFrame, reach: int, width: int) -> DataFrame:
    """peak, gene of the closest genes within reach of the peak's centre; ties keep all. gap is zero inside a gene, the ranking distance isn't.

    Each centre of a chromosome is looked up once, among the sorted ends of the genes that reach into its bin; pairs of peaks and windows are no rows.
    """
    spread = gene_windows(genes.where("g_start is not null and g_end is not null"), reach, 0)
    bins = F.sequence(F.floor(F.least("w_start", "w_end") / width), F.floor(F.greatest("w_start", "w_end") / width))
    at = peaks.select("chrom", F.col("centre").cast("long").alias("centre")).where("chrom is not null and centre is not null").distinct().withColumn("__bin", F.floor(F.col("centre") / width))
    keys, columns = ["chrom", "__bin"], ("gene", "w_start", "w_end", "g_start", "g_end")
    right = spread.withColumn("__bin", F.explode(bins)).groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("g"))
    met = spread_out(packed(at, keys, "p", ("centre",), 1024).join(right, keys).select("chrom", "p", "g"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                p, g = one.column("p").flatten(), one.column("g").flatten()
                c = numbers(p, "centre").astype(np.int64)
                w0, w1, g0, g1 = (numbers(g, x).astype(np.int64) for x in columns[1:])
                i, j = closest(c, g0, g1, w0, w1, reach)
                near = np.minimum(np.abs(c[i] - g0[j]), np.abs(c[i] - g1[j]))
                gap = np.where((c[i] >= g0[j]) & (c[i] <= g1[j]), 0, near)
                names = g.field(g.type.get_field_index("gene"))
                yield pa.RecordBatch.from_arrays([pa.repeat(one.column("chrom")[0], len(i)), pa.array(c[i]), names.take(pa.array(j)), pa.array(near), pa.array(gap), pa.array((g1 - g0)[j])], ["chrom", "centre", "gene", "near", "gap", "size"])

    kinds = {f.name: f.dataType.simpleString() for f in (*peaks.schema, *genes.schema)}
    found = met.mapInArrow(run, f"chrom {kinds['chrom']}, centre long, gene {kinds['gene']}, near long, gap long, size long")
    # An id in several rows has the closest genes of them all.
    best = Window.partitionBy("peak").orderBy("near")
    pairs = peaks.select("peak", "chrom", F.col("centre").cast("long").alias("centre")).join(found, ["chrom", "centre"])
    return pairs.withColumn("rank", F.rank().over(best)).where("rank = 1").select("peak", "gene", "gap", "size")


def owner_weight(gap: Column, size: Column, lo: float = 500.0, hi: float = 100000.0) -> Column:
    """(exp(-gap / 5000) + exp(-1)) times 5 for short genes down to 1 for long ones."""
    by_size = F.when(size <= lo, 5.0).when(size >= hi, 1.0).otherwise(5.0 - (size - lo) / (hi - lo) * 4.0)
    return (F.exp(-gap / F.lit(5000.0)) + F.exp(F.lit(-1.0))) * by_size


def owner_activity(counts: DataFrame, owners: DataFrame) -> DataFrame:
    weighted = counts.join(owners, "peak").withColumn("w", owner_weight(F.col("gap"), F.col("size")))
    return weighted.groupBy("cell_id", "gene").agg(F.sum(F.col("value") * F.col("w")).alias("activity"))
