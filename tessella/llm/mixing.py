"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in a shuffled order, epoch after epoch; each gets the virtual finish time `words of its source up to and
with it / target of its source`. All are ranged by finish time into slots, and the mix is what fits in the total budget from the start: the slots
before the one that the budget ends in, and of that one, sorted, what still fits.

Targets: the sources, by code point with null last, weigh as `weights` repeating, and share budget_share times all words; none gets more
than max_epochs times its words, and what exceeds that is reshared by weight until none is above. In closed form: sorted by limit / weight,
a source is capped while its limit is at most its weight's part of what is left.

Running sums are made in three levels: over pages of cells (of the shuffle key, or of slots of the finish time), over a page's cells, inside a cell.
Cells and pages follow the number of rows, so no source, however large, and no sort is in one task, and what a single task sums grows with the rows
divided by CELL * PAGE. The order comes from md5 of the id, so reruns agree; rows that agree in id, source and size (such as rows without an id) are
numbered, and the number goes into the key, so that a frequent id is not one cell.

Defined cases: a null text has size 0; a null source is a source; a source without words has target 0 and gives nothing; rows that share id, source
and size are interchangeable; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop, materialize

WEIGHTS = (5, 2, 1)
#: Rows of a cell, and cells of a page, about; hexadecimal digits of the key that tell a page's cells apart.
CELL, PAGE, PAGE_DIGITS = 1024, 4096, 3


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, budget_share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """source, source_size, target; one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    choose = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = per.withColumn("w", choose).withColumn("limit", (F.col("source_size") * max_epochs).cast("double")).withColumn("budget", F.sum("source_size").over(everything) * F.lit(budget_share))
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    left = weighed.withColumn("spent", F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn("level", (F.col("budget") - F.col("spent")) / F.sum("w").over(rest))
    capped = left.withColumn("capped", F.col("limit") <= F.col("w") * F.col("level"))
    free = F.col("budget") - F.sum(F.when(F.col("capped"), F.col("limit")).otherwise(0.0)).over(everything)
    level = free / F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(everything)
    return capped.select("source", "source_size", F.round(F.when(F.col("capped"), F.col("limit")).otherwise(F.col("w") * level), 6).alias("target"))


def numbered(base: DataFrame) -> DataFrame:
    """base (rid, doc_id, source, size) with nth: 0, 1, ... for rows that agree in all but rid. Counted per partition of the scan first, as one id may
    have any number of rows."""
    same = ["doc_id", "source", "size"]
    each = base.withColumn("part", F.shiftright("rid", 33))
    per = each.groupBy(*same, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Only what has fellows in other partitions of the scan needs their number.
    offsets = per.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("before > 0").select(*[F.col(c).alias(f"__{c}") for c in (*same, "part")], "before")
    own = each.withColumn("own", F.row_number().over(Window.partitionBy(*same, "part").orderBy("rid")) - 1)
    met = own.join(offsets, F.col("part").eqNullSafe(F.col("__part")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")), "left")
    return met.select("rid", *same, (F.col("own") + F.coalesce("before", F.lit(0))).alias("nth"))


def running(rows: DataFrame, within: list[str], page: str, cell: str, value: str) -> DataFrame:
    """rows (one per cell) with base: the sum of value over the cells before, by page, then by cell; per value of within, nulls as one."""
    pages = rows.groupBy(*within, page).agg(F.sum(value).alias("__v"))
    w = Window.partitionBy(*within) if within else Window.partitionBy()
    first = w.orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.select(*[F.col(c).alias(f"__{c}") for c in (*within, page)], F.coalesce(F.sum("__v").over(first), F.lit(0)).alias("__before"))
    met = rows.join(pages, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*within, page)]))
    inner = Window.partitionBy(*within, page).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn("base", F.col("__before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).select(*rows.columns, "base")


def schedule(sized: DataFrame, weights=WEIGHTS, budget_share: float = 1.5, max_epochs: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words), copies of each row of sized."""
    first = materialize(sized.withColumn("rid", F.monotonically_increasing_id()), "rows", sized)
    base = materialize(numbered(first), "sized", sized)
    drop(first)
    goal = materialize(targets(base, weights, budget_share, max_epochs), "targets", base)
    n, budget = base.count(), goal.agg(F.round(F.sum("target"), 3)).first()[0] or 0.0
    digits = 1
    while 16**digits * CELL < n:
        digits += 1
    plain = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("epoch").cast("string"), F.lit(str(seed)))
    key = F.md5(F.when(F.col("nth") == 0, plain).otherwise(F.concat_ws(":", plain, F.col("size").cast("string"), F.col("nth").cast("string"))))
    epochs = F.explode(F.array(*[F.lit(e) for e in range(1, max_epochs + 1)]))
    queue = base.select("rid", "doc_id", "source", "size", "nth", epochs.alias("epoch")).withColumn("key", key).withColumn("cell", F.substring("key", 1, digits))
    # Words of the source before each cell; a page's cells share the digits before the last PAGE_DIGITS, and the epoch.
    cells = queue.groupBy("source", "epoch", "cell").agg(F.sum("size").alias("words")).withColumn("page", F.concat(F.lpad(F.col("epoch").cast("string"), 6, "0"), F.substring("cell", 1, max(0, digits - PAGE_DIGITS))))
    cells = running(cells, ["source"], "page", "cell", "words").select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("cell").alias("c"), "base")
    aims = goal.where("target > 0").select(F.col("source").alias("s2"), "target")
    cells = cells.join(aims, F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    inside = Window.partitionBy("source", "epoch", "cell").orderBy("key", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    run = queue.withColumn("run", F.sum("size").over(inside))
    both = run.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("cell") == F.col("c")))
    finished = both.select("rid", "doc_id", "source", "size", "epoch", "key", ((F.col("base") + F.col("run")) / F.col("target")).alias("finish"))
    # Beyond 4 times its target a source's queue can't be reached: all sources finish near 1.
    per_unit = max(1, 2 * n // CELL)
    queued = materialize(finished.withColumn("slot", F.least(F.floor(F.col("finish") * per_unit), F.lit(4 * per_unit)).cast("long")), "queue", base)
    slots = queued.groupBy("slot").agg(F.sum("size").alias("words")).withColumn("page", F.floor(F.col("slot") / PAGE))
    summed = running(slots, [], "page", "slot", "words")
    cut = summed.where((F.col("base") <= F.lit(budget)) & (F.col("base") + F.col("words") > F.lit(budget))).agg(F.min_by(F.struct("slot", "base"), "slot").alias("cut")).first()["cut"]
    if cut is None:
        taken = queued
    else:
        order = Window.orderBy("finish", F.col("source").asc_nulls_last(), "epoch", "key", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
        last = queued.where(F.col("slot") == cut["slot"]).withColumn("total", F.sum("size").over(order) + F.lit(cut["base"])).where(F.col("total") <= F.lit(budget)).drop("total")
        taken = queued.where(F.col("slot") < cut["slot"]).unionByName(last)
    words = taken.groupBy("rid").agg(F.sum("size").alias("taken"), F.count("*").alias("copies"))
    out = base.join(words, "rid", "left").join(goal.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))


def plan(docs: DataFrame, **options) -> DataFrame:
    return schedule(sizes(docs), **options).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of documents, all columns, as often as the mix takes them. Rows that agree in id, source and size get what the mix takes of them all
    in even shares; where that is no whole number, a hash of the text says which get one more."""
    decided = schedule(sizes(docs), **options).groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__s"), F.col("size").alias("__n")).agg(F.avg("copies").alias("__copies")).where("__copies > 0")
    decided = materialize(decided, "decided", docs)
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    keyed = docs.withColumn("__size", size)
    both = keyed.join(decided, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__n")))
    draw = F.pmod(F.xxhash64("text", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor("__copies") + (draw < F.col("__copies") - F.floor("__copies")).cast("int")).cast("int")
    return both.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             (2 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM p),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT *, cap <= w * level AS capped FROM l),
t AS (SELECT source, source_size, round(CASE WHEN capped THEN cap ELSE w * ((budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()) END, 6) AS target FROM c),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size ORDER BY rid) - 1 AS nth FROM d),
q AS (SELECT rid, doc_id, source, size, e AS epoch, md5(coalesce(doc_id::VARCHAR, '') || ':' || e || ':42' || CASE WHEN nth = 0 THEN '' ELSE ':' || size || ':' || nth END) AS key FROM x, (VALUES (1), (2)) AS v(e)),
f AS (SELECT q.*, (sum(size) OVER (PARTITION BY q.source ORDER BY epoch, key, doc_id, size, rid))::DOUBLE / target AS finish FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source WHERE target > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, epoch, key, doc_id, size, rid) AS total FROM f),
k AS (SELECT rid, sum(size)::BIGINT AS taken FROM g WHERE total <= (SELECT round(sum(target), 3) FROM t) GROUP BY rid)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k USING (rid)
"""
