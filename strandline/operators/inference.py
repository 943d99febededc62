"""Group inference: multiplicity corrections, ranks, permutation and bootstrap statistics."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.numbers import clip_r, safe_corr

SEED = 20260314


def holm(rows: DataFrame, p: str, family: list[str], out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p within each family (all rows if it is empty)."""
    w = Window.partitionBy(*family).orderBy(p)
    n = F.count("*").over(Window.partitionBy(*family))
    raised = rows.withColumn("sl_step", (n - F.row_number().over(w) + 1) * F.col(p))
    # equal p values share the largest of their steps: a range frame includes ties
    return raised.withColumn(out, F.least(F.max("sl_step").over(w.rangeBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("sl_step")


def benjamini_hochberg(rows: DataFrame, p: str, family: list[str], out: str = "q_fdr") -> DataFrame:
    up = Window.partitionBy(*family).orderBy(p)
    down = Window.partitionBy(*family).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(Window.partitionBy(*family))
    ratio = rows.withColumn("sl_step", F.col(p) * n / F.row_number().over(up))
    return ratio.withColumn(out, F.least(F.min("sl_step").over(down), F.lit(1.0))).drop("sl_step")


def average_ranks(rows: DataFrame, column: str, family: list[str], out: str) -> DataFrame:
    """Ranks from 1; equal values share the mean of theirs."""
    rank = F.rank().over(Window.partitionBy(*family).orderBy(column))
    ties = F.count("*").over(Window.partitionBy(*family, column))
    return rows.withColumn(out, rank + (ties - 1) / 2)


def spearman(rows: DataFrame, x: str, y: str, family: list[str]) -> DataFrame:
    ranked = average_ranks(average_ranks(rows, x, family, "sl_x"), y, family, "sl_y")
    return ranked.groupBy(*family).agg(safe_corr("sl_x", "sl_y").alias("rho"), F.count("*").alias("n"))


def fisher_mean(rows: DataFrame, keys: list[str], r: str) -> DataFrame:
    """tanh of the mean atanh of clipped correlations, and that mean."""
    return rows.groupBy(*keys).agg(F.avg(F.atanh(clip_r(F.col(r)))).alias("mean_z")).withColumn("mean_r", F.tanh("mean_z"))


def iqr_outliers(rows: DataFrame, value: str, family: list[str], reach: float = 1.5) -> DataFrame:
    """Flag of values outside the quartiles by more than ``reach`` interquartile ranges."""
    q = rows.groupBy(*family).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    joined = rows.join(F.broadcast(q), family) if family else rows.join(F.broadcast(q))
    width = F.col("q")[1] - F.col("q")[0]
    return joined.withColumn("is_outlier", (F.col(value) < F.col("q")[0] - reach * width) | (F.col(value) > F.col("q")[1] + reach * width)).drop("q")


def pooled_r2(rows: DataFrame, y: str, fitted: str, keys: list[str]) -> DataFrame:
    """1 - SSE / (sum y^2 - (sum y)^2 / n), 0 for a constant y."""
    sse = F.sum((F.col(y) - F.col(fitted)) * (F.col(y) - F.col(fitted)))
    spread = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / F.count("*")
    return rows.groupBy(*keys).agg(F.when(spread <= 0, 0.0).otherwise(1 - F.try_divide(sse, spread)).alias("r2"), F.count("*").alias("n"))


def _rng(key: tuple) -> np.random.Generator:
    """A generator set by the group's key alone, so that a group's draws do not depend on the others."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr((SEED, *map(str, key))).encode()).digest()[:8], "big"))


def sign_flip_p(values: np.ndarray, draws: int, rng: np.random.Generator, exact_up_to: int = 0) -> float:
    """One-sided p of the mean: (1 + flips with a mean at least as large) / (flips + 1); every flip for few values."""
    seen = values.mean()
    if len(values) <= exact_up_to:
        flips = np.array(list(itertools.product((1.0, -1.0), repeat=len(values))))
        return float((1 + (flips @ values / len(values) >= seen - 1e-15).sum()) / (len(flips) + 1))
    hits, left = 0, draws
    while left:
        n = min(left, 2_000_000 // max(len(values), 1) + 1)
        hits += int((rng.choice((-1.0, 1.0), (n, len(values))) @ values / len(values) >= seen).sum())
        left -= n
    return (1 + hits) / (draws + 1)


def bootstrap_interval(values: np.ndarray, draws: int, rng: np.random.Generator) -> tuple[float, float]:
    """2.5 and 97.5 percentiles of resampled means."""
    means, left = [], draws
    while left:
        n = min(left, 2_000_000 // max(len(values), 1) + 1)
        means.append(values[rng.integers(0, len(values), (n, len(values)))].mean(1))
        left -= n
    low, high = np.percentile(np.concatenate(means), [2.5, 97.5])
    return float(low), float(high)


def resampled(values: DataFrame, keys: list[str], value: str, permutations: int = 10_000, bootstraps: int = 10_000, exact_up_to: int = 0) -> DataFrame:
    """keys, n, mean, p_perm, ci_low, ci_high: groups are subjects' values, so of bounded size."""
    kinds = dict(values.dtypes)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(frame[value].to_numpy(float))  # the order rows arrive in does not matter
        rng = _rng(key)
        low, high = bootstrap_interval(v, bootstraps, rng)
        return pd.DataFrame([[*key, len(v), v.mean(), sign_flip_p(v, permutations, rng, exact_up_to), low, high]], columns=[*keys, "n", "mean", "p_perm", "ci_low", "ci_high"])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n bigint, mean double, p_perm double, ci_low double, ci_high double"])
    return values.where(F.col(value).isNotNull()).groupBy(*keys).applyInPandas(run, schema)


def rank_average(x: np.ndarray) -> np.ndarray:
    order = np.sort(x)
    return (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2


def spearman_of(x: np.ndarray, y: np.ndarray) -> float:
    a, b = rank_average(x), rank_average(y)
    a, b = a - a.mean(), b - b.mean()
    under = math.sqrt((a @ a) * (b @ b))
    return float(a @ b / under) if under > 0 else float("nan")


def layer_order_p(x: np.ndarray, y: np.ndarray, draws: int, rng: np.random.Generator) -> tuple[float, float]:
    """(rho, two-sided permutation p over orders of y); every order up to 8 values."""
    rho = spearman_of(x, y)
    if math.isnan(rho):
        return rho, rho
    orders = itertools.permutations(range(len(y))) if len(y) <= 8 else (rng.permutation(len(y)) for _ in range(draws))
    hits = total = 0
    for order in orders:
        total += 1
        hits += abs(spearman_of(x, y[list(order)])) >= abs(rho) - 1e-12
    return rho, (1 + hits) / (total + 1)


def layer_coupling(rows: DataFrame, keys: list[str], order: str, x: str, y: str, draws: int = 10_000) -> DataFrame:
    """keys, n, rho, p_perm of two layer curves; a group has as many rows as a model has layers."""
    kinds = dict(rows.dtypes)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        rho, p = layer_order_p(frame[x].to_numpy(float), frame[y].to_numpy(float), draws, _rng(key))
        return pd.DataFrame([[*key, len(frame), None if math.isnan(rho) else rho, None if math.isnan(p) else p]], columns=[*keys, "n", "rho", "p_perm"])

    return rows.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n bigint, rho double, p_perm double"]))
