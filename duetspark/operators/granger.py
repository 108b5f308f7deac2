"""Does the past of one series help to foretell the other: nested regressions from sums of products.

A pair is dealt in chunks with the samples that lags reach; a chunk gives the products of all lagged
columns, and their sums are all that a pair's regressions need, whatever its length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PAIR

#: Samples of a pair in a chunk.
CHUNK = 16_384


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    guard = lambda v: v if abs(v) > 1e-300 else 1e-300
    c, d, out = math.inf, 1.0, 1.0
    for k in range(1, 1_000_000):
        m = k // 2
        if k % 2:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        c, d = guard(1 + step / c), 1 / guard(1 + step * d)
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, front * out)


def f_tail(f: float, d1: int, d2: int) -> float:
    """The chance of an F no smaller than ``f``."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def _unexplained(g: np.ndarray, target: int, by: list[int]) -> float:
    """What a regression on columns leaves of the target's sum of squares."""
    coefficients = np.linalg.lstsq(g[np.ix_(by, by)], g[by, target], rcond=1e-12)[0]
    return max(0.0, float(g[target, target] - g[by, target] @ coefficients))


def granger(paired: DataFrame, max_lag: int = 5, alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """(keys, direction, lag, n, f, p_value, p_bonferroni, eta2, causes) of each pair in both directions.

    ``x_to_y``: y's own last ``lag`` samples and a constant, against these and as many of x; ``f``
    is that of the nested models, ``eta2`` the share of what the smaller one leaves that the larger
    explains. The lag up to ``max_lag`` is that of the larger model's least BIC, the smaller of equals.
    All lags are judged on the same samples: those for which none of the ``max_lag`` + 1 samples of
    both is missing. p is multiplied by the tests of a dyad (of the first key), at most 1. Pairs
    with too few samples for any lag have no row; where one model leaves nothing, f and what follows
    from it are NULL.
    """
    keys = keys or PAIR
    kinds, width = dict(paired.dtypes), 2 * max_lag + 3
    means = paired.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    centred = paired.join(means, keys).select(*keys, "idx", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    own = F.floor(F.col("idx") / CHUNK)
    near = F.when(F.col("idx") % CHUNK >= CHUNK - max_lag, F.array(own, own + 1)).otherwise(F.array(own))
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def products(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["idx"].to_numpy() - int(key[-1]) * CHUNK + max_lag
        size = int(at.max()) + 1 if len(at) else 0
        sides = np.full((2, max(size, max_lag)), np.nan)
        sides[:, at] = pdf[["x", "y"]].to_numpy(float).T
        columns = [np.ones(sides.shape[1] - max_lag)] + [s[max_lag - lag : len(s) - lag] for s in sides for lag in range(max_lag + 1)]
        v = np.stack(columns)
        v = v[:, ~np.isnan(v).any(axis=0)]
        out = pd.DataFrame({"place": np.arange(width * width), "s": (v @ v.T).ravel()})
        for name, value in zip(reversed(keys), reversed(key[:-1]), strict=True):
            out.insert(0, name, value)
        return out

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros(width * width)
        g[pdf["place"]] = pdf["s"]
        g = g.reshape(width, width)
        n, out = round(g[0, 0]), []
        x, y = ([1 + side * (max_lag + 1) + lag for lag in range(max_lag + 1)] for side in (0, 1))
        for direction, cause, effect in (("x_to_y", x, y), ("y_to_x", y, x)):
            tried = []
            for lag in range(1, max_lag + 1):
                if n > 2 * lag + 1:
                    small = [0, *effect[1 : lag + 1]]
                    left = _unexplained(g, effect[0], small + cause[1 : lag + 1])
                    # sums of products carry a few last bits of the whole
                    left = left if left > 1e-12 * g[effect[0], effect[0]] else 0.0
                    tried.append((n * math.log(left / n) + (2 * lag + 1) * math.log(n) if left else -math.inf, lag, _unexplained(g, effect[0], small), left))
            if not tried:
                continue
            _, lag, before, left = min(tried)
            f = max(0.0, before - left) / lag / (left / (n - 2 * lag - 1)) if left else None
            tail = None if f is None else f_tail(f, lag, n - 2 * lag - 1)
            out.append((*key, direction, lag, n, f, tail, max(0.0, before - left) / before if left else None))
        return pd.DataFrame(out, columns=[*keys, "direction", "lag", "n", "f", "p_value", "eta2"])

    chunks = centred.withColumn("chunk", F.explode(near)).groupBy(*keys, "chunk").applyInPandas(products, f"{head}, place int, s double")
    sums = chunks.groupBy(*keys, "place").agg(F.sum("s").alias("s"))
    found = sums.groupBy(*keys).applyInPandas(solve, f"{head}, direction string, lag int, n bigint, f double, p_value double, eta2 double")
    tests = F.count("*").over(Window.partitionBy(keys[0]))
    whole = found.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p_value") * tests)).withColumn("p_bonferroni", F.when(F.col("p_value").isNotNull(), F.col("p_bonferroni")))
    return whole.select(*keys, "direction", "lag", "n", "f", "p_value", "p_bonferroni", "eta2", (F.col("p_bonferroni") < alpha).alias("causes"))


def shown(found: DataFrame) -> DataFrame:
    """Directions that cause, the largest F first."""
    return found.where("causes").orderBy(F.desc("f"))
