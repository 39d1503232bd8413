"""Sample-aware differential expression: means per sample, variances shrunk within and between samples, contrasts with a permutation null."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import t_tail
from .stats import benjamini_hochberg, squeeze_variances


def contrast_design(groups: list, paired: list | None = None) -> tuple[np.ndarray, list[str]]:
    """One column per group in order of first appearance; with pairs, a column per individual but the first beside them."""
    names = list(dict.fromkeys(groups))
    x = np.array([[g == n for n in names] for g in groups], float)
    if paired is not None:
        others = list(dict.fromkeys(paired))[1:]
        x = np.concatenate([x, np.array([[p == n for n in others] for p in paired], float).reshape(len(groups), -1)], axis=1)
        names += [f"individual {n}" for n in others]
    return x, names


def design_of(rows: list[dict], kind: str, a=None, b=None, custom: dict | None = None, contrast: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The design of the samples (a row each) and the contrast that is tested.

    unpaired: a column per group, a minus b; paired: besides, a column per individual but the first; continuous: a column of ones and the value, its
    slope; custom: each sample's own row, and the contrast as given.
    """
    if kind == "continuous":
        return np.array([[1.0, float(r["value"])] for r in rows]), np.array([0.0, 1.0])
    if kind == "custom":
        x, c = np.array([custom[r["sample"]] for r in rows], float), np.asarray(contrast, float)
        if x.ndim != 2 or x.shape[1] != len(c):
            raise ValueError("a custom design needs as many columns as its contrast has entries")
        return x, c
    if kind not in ("unpaired", "paired"):
        raise ValueError(f"no design is called {kind}")
    x, names = contrast_design([r["group"] for r in rows], [r["individual"] for r in rows] if kind == "paired" else None)
    return x, np.array([1.0 if n == a else -1.0 if n == b else 0.0 for n in names])


def sample_test(stats: DataFrame, samples: DataFrame, a: str | None = None, b: str | None = None, kind: str = "unpaired", custom: dict | None = None, contrast: list[float] | None = None, permutations: int = 100, seed: int = 42) -> DataFrame:
    """feature, fold_change, statistic, p, fdr of the contrast of a design (see design_of): group a against b, the slope of a value, or any other.

    stats: sample, feature_id, mean, variance, n (cells); samples: sample, and group, individual or value as the design needs; samples without what it
    needs, and for groups those of others, are left out. A feature's measurement variance is the pooled within-sample variance, shrunk over features; its
    sample variance is what the residuals show beyond that. The null of the statistic comes from permuted samples (of the same individual, if paired),
    taken as normal or as the t distribution that fits it best.
    """

    spark = stats.sparkSession
    needed = {"unpaired": ["group"], "paired": ["group", "individual"], "continuous": ["value"], "custom": []}.get(kind, [])
    used = samples.where(F.col("group").isin(a, b)) if "group" in needed else samples
    order = [r.asDict() for r in used.orderBy("sample").select("sample", *needed).collect() if all(r[x] is not None for x in needed)]
    if kind == "custom":
        order = [r for r in order if r["sample"] in (custom or {})]
    names = [r["sample"] for r in order]
    design, c = design_of(order, kind, a, b, custom, contrast)
    if np.linalg.matrix_rank(np.vstack([design, c])) > np.linalg.matrix_rank(design):
        raise ValueError("the design can't tell the contrast")
    inverse = np.linalg.pinv(design)
    k = c @ inverse
    residual = np.eye(len(names)) - design @ inverse
    df = max(1, len(names) - int(np.linalg.matrix_rank(design)))
    rng = np.random.default_rng(seed)
    alike = [[i for i, r in enumerate(order) if r["individual"] == x] for x in dict.fromkeys(r["individual"] for r in order)] if kind == "paired" else [list(range(len(names)))]

    def shuffled() -> np.ndarray:
        at = np.arange(len(names))
        for group in alike:
            at[group] = rng.permutation(group)
        return design[at]

    null = [c @ np.linalg.pinv(shuffled()) for _ in range(permutations)]
    at = {s: i for i, s in enumerate(names)}

    def fit(key, frame: pd.DataFrame) -> pd.DataFrame:
        y, w = np.zeros(len(names)), np.zeros(len(names))
        for s, m, v, n in zip(frame["sample"], frame["mean"], frame["variance"], frame["n"], strict=True):
            y[at[s]], w[at[s]] = m, max(v, 0.0) / max(1, n)
        return pd.DataFrame({"feature": [str(key[0])], "b": [float(k @ y)], "within": [w.tolist()], "rss": [float(y @ residual @ y) / df], "null": [[float(q @ y) for q in null]]})

    rows = stats.join(F.broadcast(spark.createDataFrame([(n,) for n in names], f"sample {dict(samples.dtypes)['sample']}")), "sample").select("feature_id", "sample", "mean", "variance", "n")
    found = rows.groupBy("feature_id").applyInPandas(fit, "feature string, b double, within array<double>, rss double, null array<double>").orderBy("feature").collect()
    if not found:
        return spark.createDataFrame([], "feature string, fold_change double, statistic double, p double, fdr double")
    within = np.array([r["within"] for r in found])
    shrunk, _, _ = squeeze_variances(np.maximum(within.mean(1), 1e-12), len(names))
    sample_var = np.maximum(np.array([r["rss"] for r in found]) - within.mean(1), 0.0)
    pooled, _, _ = squeeze_variances(sample_var + 1e-12, df)
    scale = np.sqrt(np.maximum((k**2).sum() * (shrunk + pooled), 1e-300))
    t = np.array([r["b"] for r in found]) / scale
    null_t = (np.array([r["null"] for r in found]) / scale[:, None]).ravel()
    null_t = null_t[null_t != 0] if (null_t != 0).any() else np.array([1.0])
    spread = float(np.sqrt((null_t**2).mean()))

    def likelihood(d: float) -> float:
        z = null_t / spread
        if math.isinf(d):
            return float(-0.5 * (z**2).sum() - len(z) * 0.5 * math.log(2 * math.pi))
        return float(len(z) * (math.lgamma((d + 1) / 2) - math.lgamma(d / 2) - 0.5 * math.log(d * math.pi)) - (d + 1) / 2 * np.log1p(z**2 / d).sum())

    best = max([*np.arange(1, 100.5, 0.5).tolist(), math.inf], key=likelihood)
    out = [(r["feature"], float(r["b"]), float(x), float(t_tail(x / spread, best))) for r, x in zip(found, t, strict=True)]
    return benjamini_hochberg(spark.createDataFrame(out, "feature string, fold_change double, statistic double, p double"), "p", "feature")


def pairwise_tests(stats: DataFrame, samples: DataFrame, control: str | None = None, **options) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """All pairs of groups, or each against control, in one table; pairs that fail are listed with their reason."""
    groups = sorted(r[0] for r in samples.select("group").distinct().collect())
    pairs = [(g, control) for g in groups if g != control] if control else [(x, y) for i, x in enumerate(groups) for y in groups[i + 1 :]]
    out, failed = None, []
    for x, y in pairs:
        try:
            one = sample_test(stats, samples, x, y, **options).withColumns({"group_a": F.lit(x), "group_b": F.lit(y)})
            out = one if out is None else out.unionByName(one)
        except (ValueError, np.linalg.LinAlgError) as error:
            failed.append((x, y, str(error)))
    return out, failed
