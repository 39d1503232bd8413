"""Tests and scores. Sums come from aggregates; tails are computed on result-sized tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import digamma, f_tail, inverse_trigamma, studentized_range_tail, t_tail, trigamma
from .ordered import before


def benjamini_hochberg(rows: DataFrame, p: str, key: str, within: list[str] = ()) -> DataFrame:
    """fdr: the least p * m / rank from here on down, 1 at most. Equal p by key."""
    part = Window.partitionBy(*within)
    rank = F.row_number().over(part.orderBy(F.col(p), F.col(key)))
    m = F.count(p).over(part)
    raised = rows.where(F.col(p).isNotNull()).withColumn("__q", F.col(p) * m / rank)
    down = part.orderBy(F.col(p).desc(), F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return raised.withColumn("fdr", F.least(F.lit(1.0), F.min("__q").over(down))).drop("__q")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rho, n. Ranks come from counts of distinct values, so one value's rows never meet in a sort."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranked(df, c):
        n = df.groupBy(c).agg(F.count("*").alias("__n"))
        return before(n, c, [], "__before", "__n").select(F.col(c).alias(f"__{c}"), (F.col("__before") + (F.col("__n") + 1) / 2.0).alias(f"r_{c}"))

    met = both.join(ranked(both, x), F.col(x) == F.col(f"__{x}")).join(ranked(both, y), F.col(y) == F.col(f"__{y}"))
    return met.agg(F.corr(f"r_{x}", f"r_{y}").alias("rho"), F.count("*").alias("n"))


def r2_continuous(rows: DataFrame, x: str, ys: list[str]) -> DataFrame:
    """component, r2: squared correlation of x with each y, where n reaches 4."""
    one = rows.where(F.col(x).isNotNull()).agg(F.count("*").alias("n"), *[F.pow(F.corr(x, y), 2).alias(y) for y in ys])
    return one.select("n", F.explode(F.array(*[F.struct(F.lit(y).alias("component"), F.col(y).alias("r2")) for y in ys])).alias("x")).where("n >= 4").select("x.component", "x.r2")


def anova(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: n, groups, ssb, sst, f, eta_sq, omega_sq, p-free; one pass over groups' sums."""
    per = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("c"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    all_ = per.agg(F.sum("c").alias("n"), F.count("*").alias("groups"), (F.sum(F.col("c") * F.col("m")) / F.sum("c")).alias("mean"))
    s = per.join(F.broadcast(all_)).agg(F.first("n").alias("n"), F.first("groups").alias("groups"), F.sum(F.col("c") * F.pow(F.col("m") - F.col("mean"), 2)).alias("ssb"), F.sum(F.col("c") * F.col("v")).alias("ssw"))
    msw = F.col("ssw") / (F.col("n") - F.col("groups"))
    total = F.col("ssb") + F.col("ssw")
    return s.select("n", "groups", "ssb", total.alias("sst"), (F.col("ssb") / (F.col("groups") - 1) / msw).alias("f"), (F.col("ssb") / total).alias("eta_sq"), ((F.col("ssb") - (F.col("groups") - 1) * msw) / (total + msw)).alias("omega_sq"))


def permutation_p(x: np.ndarray, y: np.ndarray, statistic, rounds: int, seed: int, plus_one: bool = True) -> float:
    """Share of shuffles of y whose statistic reaches the observed one; (c + 1) / (n + 1), or c / n."""
    rng = np.random.default_rng(seed)
    seen = statistic(x, y)
    c = sum(statistic(x, rng.permutation(y)) >= seen - 1e-12 for _ in range(rounds))
    return (c + 1) / (rounds + 1) if plus_one else c / rounds


def r2_permutations(rows: DataFrame, key: str, x: str, ys: list[str], rounds: int = 199, seed: int = 42) -> DataFrame:
    """component, r2, p: rounds of shuffled x, each an order by a seeded hash; all rounds are one plan over unit-sized rows."""
    base = rows.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), *[F.col(y).cast("double").alias(y) for y in ys]).where("x is not null")
    place = base.withColumn("i", F.row_number().over(Window.orderBy("k")))
    turns = place.select(F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("round"), "k", "i", "x")
    drawn = F.when(F.col("round") == 0, F.col("i").cast("long")).otherwise(F.xxhash64("round", "k", F.lit(seed)))
    shuffled = turns.withColumn("j", F.row_number().over(Window.partitionBy("round").orderBy(drawn))).select("round", "x", F.col("j").alias("i"))
    met = shuffled.join(place.drop("x", "k"), "i").groupBy("round").agg(*[F.pow(F.corr("x", y), 2).alias(y) for y in ys])
    long = met.select("round", F.explode(F.array(*[F.struct(F.lit(y).alias("component"), F.col(y).alias("r2")) for y in ys])).alias("v")).select("round", "v.component", "v.r2")
    seen = long.where("round = 0").select("component", F.col("r2").alias("seen"))
    return long.where("round > 0").join(F.broadcast(seen), "component").groupBy("component").agg(F.first("seen").alias("r2"), ((F.sum((F.col("r2") >= F.col("seen") - 1e-12).cast("int")) + 1) / F.lit(float(rounds + 1))).alias("p"))


def squeeze_variances(s2: np.ndarray, df: float | np.ndarray) -> tuple[np.ndarray, float, float]:
    """Moderated variances, prior degrees of freedom (may be infinite), prior variance: moments of log variances. df: of each variance, or of all."""
    df = np.broadcast_to(np.asarray(df, float), s2.shape)
    kinds, which = np.unique(df, return_inverse=True)
    e = np.log(np.maximum(s2, 1e-300)) - np.array([digamma(d / 2) - math.log(d / 2) for d in kinds])[which]
    spread = e.var(ddof=1) - np.array([trigamma(d / 2) for d in kinds])[which].mean() if len(e) > 1 else 0.0
    if spread <= 0:
        return np.full_like(s2, math.exp(e.mean())), math.inf, math.exp(e.mean())
    prior = 2 * inverse_trigamma(spread)
    scale = math.exp(e.mean() + digamma(prior / 2) - math.log(prior / 2))
    return (prior * scale + df * s2) / (prior + df), prior, scale


def moderated_t(values: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """feature, difference, t, p, fdr between two groups of units; variances are shrunk together. values: unit, group, feature, value."""
    per = values.where(F.col(group).isin(a, b)).groupBy("feature", group).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    side = lambda g, s: per.where(F.col(group) == g).select("feature", *[F.col(c).alias(c + s) for c in "nmv"])
    rows = side(a, "a").join(side(b, "b"), "feature").where("na > 1 and nb > 1").orderBy("feature").collect()  # a row per feature of a result
    if not rows:
        return values.sparkSession.createDataFrame([], "feature string, difference double, t double, p double, fdr double")
    na, nb = (np.array([r[c] for r in rows], float) for c in ("na", "nb"))
    df = na + nb - 2
    pooled = np.array([(r["na"] - 1) * r["va"] + (r["nb"] - 1) * r["vb"] for r in rows]) / df
    s2, prior, _ = squeeze_variances(pooled, df)
    diff = np.array([r["ma"] - r["mb"] for r in rows])
    t = diff / np.sqrt(np.maximum(s2, 1e-300) * (1 / na + 1 / nb))
    out = values.sparkSession.createDataFrame([(str(r["feature"]), float(d), float(x), float(t_tail(x, min(own + prior, df.sum())))) for r, d, x, own in zip(rows, diff, t, df, strict=True)], "feature string, difference double, t double, p double")
    return benjamini_hochberg(out, "p", "feature")


def remove_effects(y: np.ndarray, keep: np.ndarray, remove: np.ndarray) -> np.ndarray:
    """Fit both designs jointly, subtract the removed part. y: units by features."""
    beta, *_ = np.linalg.lstsq(np.concatenate([keep, remove], axis=1), y, rcond=None)
    return y - remove @ beta[keep.shape[1] :]


def combat(y: np.ndarray, batch: list) -> np.ndarray:
    """Location and scale of each batch shrunk over features (empirical Bayes), then taken out. y: units by features."""
    names = sorted(set(batch), key=str)
    of = [np.array([b == n for b in batch]) for n in names]
    mean = sum(y[i].mean(0) * i.mean() for i in of)
    sd = np.sqrt(np.mean([(y[j] - y[i].mean(0)) ** 2 for i in of for j in np.flatnonzero(i)], axis=0))
    z = (y - mean) / np.maximum(sd, 1e-12)
    out = z.copy()
    for i in of:
        n, g = i.sum(), z[i].mean(0)
        d = z[i].var(0, ddof=1) if n > 1 else np.ones(z.shape[1])
        t2, gm = g.var(ddof=1) if len(g) > 1 else 0.0, g.mean()
        dm, dv = d.mean(), max(d.var(ddof=1) if len(d) > 1 else 0.0, 1e-12)
        shape, rate = dm**2 / dv + 2, dm * (dm**2 / dv + 1)
        gs, ds = g, np.maximum(d, 1e-12)
        for _ in range(50):
            new_g = (n * t2 * g + ds * gm) / (n * t2 + ds + 1e-12)
            new_d = (rate + 0.5 * ((z[i] - new_g) ** 2).sum(0)) / (n / 2 + shape - 1)
            done = max(np.abs(new_g - gs).max(), np.abs(new_d - ds).max()) < 1e-6
            gs, ds = new_g, new_d
            if done:
                break
        out[i] = (z[i] - gs) / np.sqrt(ds)
    return out * sd + mean


def two_way(y: np.ndarray, a: list, b: list) -> dict[str, dict[str, float]]:
    """Type II sums of squares with interaction: ss, df, f, p, eta_sq (of all terms' and the residual's squares), partial_eta_sq per term. One
    level of b: one-way over a alone."""
    if len(set(b)) < 2:
        return one_way(y, a)
    dummies = lambda v: np.array([[x == n for n in sorted(set(v), key=str)[1:]] for x in v], float).reshape(len(v), -1)
    da, db = dummies(a), dummies(b)
    cross = (da[:, :, None] * db[:, None, :]).reshape(len(y), -1)
    one = np.ones((len(y), 1))

    def rss(*parts):
        x = np.concatenate([one, *parts], axis=1)
        beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        return float(((y - x @ beta) ** 2).sum()), int(rank)

    full, rank = rss(da, db, cross)
    both, rank_both = rss(da, db)
    terms = {"a": (rss(db), (both, rank_both)), "b": (rss(da), (both, rank_both)), "a:b": ((both, rank_both), (full, rank))}
    left, out = len(y) - rank, {}
    total = full + sum(max(0.0, less - more) for (less, _), (more, _) in terms.values())
    for name, ((less, r0), (more, r1)) in terms.items():
        ss, df = max(0.0, less - more), r1 - r0
        f = ss / df / (full / left) if df and left and full > 0 else math.nan
        out[name] = {"ss": ss, "df": df, "f": f, "p": f_tail(f, df, left) if f == f else math.nan, "eta_sq": ss / total if total else math.nan, "partial_eta_sq": ss / (ss + full) if ss + full else math.nan}
    return out


def one_way(y: np.ndarray, a: list) -> dict[str, dict[str, float]]:
    groups = [y[[x == g for x in a]] for g in sorted(set(a), key=str)]
    within, between = sum(float(((g - g.mean()) ** 2).sum()) for g in groups), sum(len(g) * float(g.mean() - y.mean()) ** 2 for g in groups)
    df, left = len(groups) - 1, len(y) - len(groups)
    f = between / df / (within / left) if df and left and within > 0 else math.nan
    share = between / (between + within) if between + within else math.nan
    return {"a": {"ss": between, "df": df, "f": f, "p": f_tail(f, df, left) if f == f else math.nan, "eta_sq": share, "partial_eta_sq": share}}


def tukey(y: np.ndarray, a: list, level: float = 0.05) -> list[tuple[str, str, float, float, bool]]:
    """(one, other, difference of means, p, whether p is below level) of all pairs of groups, by the studentized range with unequal sizes."""
    names = sorted(set(a), key=str)
    of = {g: y[[x == g for x in a]] for g in names}
    left = len(y) - len(names)
    if left < 1:
        return []
    mean_square = sum(float(((v - v.mean()) ** 2).sum()) for v in of.values()) / left
    out = []
    for i, g in enumerate(names):
        for h in names[i + 1 :]:
            gap = float(of[h].mean() - of[g].mean())
            error = math.sqrt(mean_square / 2 * (1 / len(of[g]) + 1 / len(of[h])))
            p = float(studentized_range_tail(abs(gap) / error, len(names), left)) if error > 0 else float(gap == 0)
            out.append((str(g), str(h), gap, p, p < level))
    return out


def silhouette_batch(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: (1 - mean silhouette) / 2, clipped to 0..1. pairs: both directions a, b, distance; labels: id, label."""
    own, other = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    means = pairs.join(own, "a").join(other, "b").groupBy("a", "la", "lb").agg(F.avg("distance").alias("d"))
    s = means.groupBy("a").agg(F.max(F.when(F.col("la") == F.col("lb"), F.col("d"))).alias("i"), F.min(F.when(F.col("la") != F.col("lb"), F.col("d"))).alias("o"))
    width = F.when(F.col("i").isNull() | F.col("o").isNull(), 0.0).otherwise((F.col("o") - F.col("i")) / F.greatest("o", "i"))
    return s.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.avg(width)) / 2)).alias("asw_batch"))


def preservation(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """within, between, ratio of mean distances."""
    from .distance import group_score

    return group_score(pairs, labels).select("within", "between", F.col("score").alias("ratio"))


def cluster_entropy(rows: DataFrame, cluster: str, modality: str) -> DataFrame:
    """cluster, size, entropy (base 2) of its modalities."""
    n = rows.groupBy(cluster, modality).agg(F.count("*").alias("n"))
    p = n.withColumn("t", F.sum("n").over(Window.partitionBy(cluster))).withColumn("p", F.col("n") / F.col("t"))
    return p.groupBy(cluster).agg(F.max("t").alias("size"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def chi2_independence(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2, df."""
    n = rows.groupBy(a, b).agg(F.count("*").alias("o"))
    ra, rb = n.groupBy(a).agg(F.sum("o").alias("na")), n.groupBy(b).agg(F.sum("o").alias("nb"))
    total = n.agg(F.sum("o").alias("t"))
    grid = ra.join(F.broadcast(rb)).join(F.broadcast(total)).join(n, [a, b], "left")
    e = F.col("na") * F.col("nb") / F.col("t")
    return grid.agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - e, 2) / e).alias("chi2"), ((F.countDistinct(a) - 1) * (F.countDistinct(b) - 1)).alias("df"))


def rank_methods(scores: DataFrame, method: str, variant: str, metric: str, value: str) -> DataFrame:
    """method, mean_rank: rank (least of ties, nulls last) within variant and metric, averaged over variants, then metrics."""
    r = scores.withColumn("r", F.rank().over(Window.partitionBy(metric, variant).orderBy(F.col(value).desc_nulls_last())))
    return r.groupBy(method, metric).agg(F.avg("r").alias("m")).groupBy(method).agg(F.avg("m").alias("mean_rank"))


def entity_pearson(left: DataFrame, right: DataFrame, entity: str, other: str, least: int = 3) -> DataFrame:
    """entity, n, r over the union of what either side has, absent as 0."""
    both = left.select(entity, other, F.col("value").alias("x")).join(right.select(entity, other, F.col("value").alias("y")), [entity, other], "full").na.fill(0.0, ["x", "y"])
    return both.groupBy(entity).agg(F.count("*").alias("n"), F.corr("x", "y").alias("r")).where(F.col("n") >= least)


def feature_spearman(left: DataFrame, right: DataFrame, feature: str, other: str, least: int) -> DataFrame:
    """feature, n, rho over what both sides have."""
    both = left.select(feature, other, F.col("value").alias("x")).join(right.select(feature, other, F.col("value").alias("y")), [feature, other])
    part = Window.partitionBy(feature)
    rank = lambda c: F.rank().over(part.orderBy(c)) + (F.count("*").over(Window.partitionBy(feature, c)) - 1) / 2.0
    r = both.withColumn("rx", rank("x")).withColumn("ry", rank("y"))
    return r.groupBy(feature).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho")).where(F.col("n") >= least)


def random_partners(entities: DataFrame, entity: str, rounds: int, seed: int = 42, per_bucket: int = 1000) -> DataFrame:
    """round, entity, partner: in each round every entity gets another one, and none is given twice.

    Entities fall into buckets of about per_bucket by a seeded hash and are passed on in a ring inside them, so no window holds them all.
    An entity alone in its bucket has no partner in that round.
    """
    one = entities.select(entity).where(F.col(entity).isNotNull()).distinct()
    buckets = max(1, one.count() // per_bucket)
    drawn = one.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("__h", F.xxhash64(entity, "round", F.lit(seed)))
    ring = Window.partitionBy("round", F.pmod("__h", F.lit(buckets))).orderBy(F.xxhash64("__h", F.lit(seed)), entity)
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    paired = drawn.withColumn("partner", F.coalesce(F.lead(entity).over(ring), F.first(entity).over(whole)))
    return paired.where(F.col("partner") != F.col(entity)).select("round", entity, "partner")


def pair_baseline(left: DataFrame, right: DataFrame, entity: str, other: str, rounds: int = 5, least: int = 3, seed: int = 42) -> DataFrame:
    """round, n, mean_r: mean correlation of an entity's two sides (round -1) and of sides of entities paired at random."""
    partners = random_partners(left.select(entity).join(right.select(entity), entity, "left_semi"), entity, rounds, seed)
    pair = F.struct("round", entity).alias("pair")
    a = partners.join(left, entity).select(pair, other, "value")
    b = partners.join(right.withColumnRenamed(entity, "partner"), "partner").select(pair, other, "value")
    mean = [F.count("r").alias("n"), F.avg("r").alias("mean_r")]
    drawn = entity_pearson(a, b, "pair", other, least).groupBy(F.col("pair.round").alias("round")).agg(*mean)
    return entity_pearson(left, right, entity, other, least).agg(*mean).select(F.lit(-1).alias("round"), "n", "mean_r").unionByName(drawn)


def bootstrap_mean(values: np.ndarray, rounds: int = 2000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float, float]:
    rng = np.random.default_rng(seed)
    means = np.array([rng.choice(values, len(values)).mean() for _ in range(rounds)])
    return float(values.mean()), float(np.quantile(means, alpha / 2)), float(np.quantile(means, 1 - alpha / 2))
