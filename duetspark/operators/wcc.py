"""Pairs of series, and their sliding correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PAIR, ratio
from .context import within

#: Windows in a chunk: a long pair is dealt to several tasks, each with the next chunk's head.
CHUNK = 16_384
#: Decimal places of a correlation.
PLACES = 12
_SIDE = ["mod_a", "feat_a", "mod_b", "feat_b"]


def pairs(aligned: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(dyad_id, pair_key, mod_a, feat_a, mod_b, feat_b, idx, t, x, y): every feature of a modality
    with every feature of each later one, joined on the dyad's sample.

    Modalities stand in ``order``, others after them by name; never a modality with itself.
    """
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("modality")) if order else F.lit(0)
    ordered = aligned.withColumn("__ord", F.struct(F.when(rank == 0, len(order or []) + 1).otherwise(rank).alias("r"), F.col("modality").alias("m")))
    a = ordered.select("dyad_id", "idx", "t", F.col("__ord").alias("oa"), F.col("modality").alias("mod_a"), F.col("feature").alias("feat_a"), F.col("value").alias("x"))
    b = ordered.select("dyad_id", "idx", F.col("__ord").alias("ob"), F.col("modality").alias("mod_b"), F.col("feature").alias("feat_b"), F.col("value").alias("y"))
    key = F.concat("mod_a", F.lit("_"), "feat_a", F.lit("__"), "mod_b", F.lit("_"), "feat_b")
    return a.join(b, ["dyad_id", "idx"]).where("oa < ob").select("dyad_id", key.alias("pair_key"), *_SIDE, "idx", "t", "x", "y")


def lagged(paired: DataFrame, lag: int) -> DataFrame:
    """y moved right by ``lag`` samples (left if negative); vacated places are NULL."""
    if not lag:
        return paired
    y = paired.select(*PAIR, (F.col("idx") + lag).alias("idx"), "y")
    return paired.drop("y").join(y, [*PAIR, "idx"], "left").select(paired.columns)


def wcc(paired: DataFrame, window: int = 10, lag: int = 0, keys: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(keys, idx, r): the correlation of samples idx to idx + window - 1, within [-1, 1].

    r is rounded to 12 places, so that equal correlations are equal whatever the order of their
    sums: thresholds, plateaus and ties then don't hang on last bits.

    A window with a missing value has no r. One without spread has none either, unless the pair
    (after the lag) has a missing value anywhere: then it is 0. Every row goes to its own chunk
    of positions and, if it is among the next chunk's first window - 1, to the one before.
    """
    keys = keys or PAIR
    rows = lagged(paired, lag).select(*keys, "idx", "x", "y")
    flags = rows.groupBy(*keys).agg(F.bool_or(F.col("x").isNull() | F.col("y").isNull()).alias("__holes"))
    own = F.floor(F.col("idx") / chunk)
    dealt = rows.withColumn("__c", F.explode(F.when(F.col("idx") % chunk < window - 1, F.array(own, own - 1)).otherwise(F.array(own))))
    frame = Window.partitionBy(*keys, "__c").orderBy("idx").rowsBetween(0, window - 1)
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    spread = F.stddev_pop("x").over(frame) * F.stddev_pop("y").over(frame)
    framed = dealt.withColumns({
        "__n": F.count("*").over(frame), "__valid": F.count_if(both).over(frame), "__cov": F.covar_pop("x", "y").over(frame), "__s": spread,
    }).where((own == F.col("__c")) & (F.col("__n") == window))
    clean = F.when(F.col("__s") > 1e-10, F.col("__cov") / F.nullif("__s", F.lit(0.0)))
    holed = F.coalesce(ratio(F.col("__cov"), F.col("__s")), F.lit(0.0))
    r = F.when(F.col("__valid") == window, F.when(F.col("__holes"), holed).otherwise(clean))
    bounded = F.when(r.isNotNull(), F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)), PLACES))
    return framed.join(flags, keys).select(*keys, "idx", bounded.alias("r"))


#: Decimal places of a correlation that is compared with those of other lags.
LAG_PLACES = 9


def _runs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of x and y and the sum of products of their deviations, of each column's first 1, 2, ... values."""
    mx, my, c = x.copy(), y.copy(), np.zeros_like(x)
    for k in range(1, len(x)):
        d = x[k] - mx[k - 1]
        mx[k] = mx[k - 1] + d / (k + 1)
        my[k] = my[k - 1] + (y[k] - my[k - 1]) / (k + 1)
        c[k] = c[k - 1] + d * (y[k] - my[k])
    return mx, my, c


def _comoment(x: np.ndarray, y: np.ndarray, window: int) -> np.ndarray:
    """The sum of products of deviations from the window's means, of each ``window`` values: what is left of a
    block and what begins the next one. No other value counts, however large, and nothing large is subtracted."""
    starts = np.arange(len(x) - window + 1)
    blocks = [np.concatenate([v, np.zeros(-len(v) % window)]).reshape(-1, window).T for v in (x, y)]
    flat = lambda runs: [v.T.ravel() for v in runs]
    hx, hy, hc = (v[starts + window - 1] for v in flat(_runs(*map(np.ascontiguousarray, blocks))))
    tx, ty, tc = (v[starts] for v in flat(v[::-1] for v in _runs(*(np.ascontiguousarray(v[::-1]) for v in blocks))))
    head = starts % window
    return np.where(head == 0, hc, tc + hc + (hx - tx) * (hy - ty) * (head * (window - head) / window))


def _moments(a: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Deviation and completeness of each window of values with NaN."""
    filled, missing = np.nan_to_num(a), np.concatenate([[0], np.cumsum(np.isnan(a))])
    return np.sqrt(_comoment(filled, filled, window) / window), missing[window:] == missing[:-window]


def _lag_correlations(x: np.ndarray, y: np.ndarray, window: int, lags: np.ndarray) -> np.ndarray:
    """(lags, windows): r of x[i : i + window] and y[i - lag : i - lag + window]; NaN where a value is missing
    or a window is flat. ``y`` holds the largest lag's number of samples more at both ends."""
    most, n = int(np.abs(lags).max(initial=0)), len(x)
    sx, kx = _moments(x, window)
    sy, ky = _moments(y, window)
    x, y = np.nan_to_num(x), np.nan_to_num(y)
    out = np.full((len(lags), n - window + 1), np.nan)
    for k, lag in enumerate(lags):
        at = slice(most - lag, most - lag + n - window + 1)
        spread = sx * sy[at]
        fit = kx & ky[at] & (spread > 1e-10)
        if fit.any():
            cov = _comoment(x, y[most - lag : most - lag + n], window) / window
            out[k, fit] = np.clip(cov[fit] / spread[fit], -1, 1)
    return np.round(out, LAG_PLACES)


def wcc_directional(paired: DataFrame, window: int = 10, max_lag: int = 12, step: int = 1, lag_step: int = 1, keys: list[str] | None = None,
                    chunk: int = CHUNK) -> DataFrame:
    """(keys, idx, lag, r, lags): of every ``step``-th window the lag at which the two series agree or
    disagree most, and r there.

    Lags go from -max_lag to max_lag by ``lag_step`` from 0; at lag k, x at i stands beside y at i - k, so a
    negative lag means that x leads. Of equal |r| the smaller lag counts, then the negative one. ``lags``
    is how many lags had a correlation: none without a full window of values in both series, or where
    one of them is flat. A window without any has neither lag nor r. This is our own definition.

    A sample goes to its chunk of positions and, where a window or a lag there reaches for it, to the
    neighbouring ones: what is shuffled doesn't grow with the number of lags.
    """
    keys = keys or PAIR
    kinds = dict(paired.dtypes)
    lags = np.array(sorted([*range(0, max_lag + 1, lag_step), *range(-lag_step, -max_lag - 1, -lag_step)], key=lambda k: (abs(k), k)))
    most = int(np.abs(lags).max(initial=0))
    rows = paired.select(*keys, "idx", "x", "y")
    first, last = F.floor((F.col("idx") - (window - 1) - most) / chunk), F.floor((F.col("idx") + most) / chunk)
    dealt = rows.withColumn("__c", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo = int(key[-1]) * chunk
        pos = pdf["idx"].to_numpy(np.int64) - lo
        if pos.max() < 0:  # reached by lags of other windows only
            return pd.DataFrame(columns=[*keys, "idx", "lag", "r", "lags"])
        size = min(chunk, int(pos.max()) + 1) + window - 1
        x, y = np.full(size, np.nan), np.full(size + 2 * most, np.nan)
        near = (pos >= 0) & (pos < size)
        x[pos[near]] = pdf["x"].to_numpy(float, na_value=np.nan)[near]
        near = (pos >= -most) & (pos < size + most)
        y[pos[near] + most] = pdf["y"].to_numpy(float, na_value=np.nan)[near]
        r = _lag_correlations(x, y, window, lags)
        at = np.arange(r.shape[1])[(-lo) % step :: step]
        at = at[np.isin(at, pos) & np.isin(at + window - 1, pos)]  # windows that lie in the series
        r = r[:, at]
        best = np.where(np.isnan(r), -1, np.abs(r)).argmax(0) if len(at) else np.zeros(0, int)
        counts = (~np.isnan(r)).sum(0)
        out = pd.DataFrame({"idx": at + lo, "lag": np.where(counts > 0, lags[best], np.nan), "r": r[best, np.arange(len(at))], "lags": counts})
        for name, value in zip(reversed(keys), reversed(key[:-1]), strict=True):
            out.insert(0, name, value)
        return out

    fields = ", ".join(f"{k} {kinds[k]}" for k in keys)
    got = dealt.groupBy(*keys, "__c").applyInPandas(run, f"{fields}, idx bigint, lag double, r double, lags int")
    return got.select(*keys, "idx", F.when(~F.isnan("lag"), F.col("lag").cast("int")).alias("lag"), F.when(~F.isnan("r"), F.col("r")).alias("r"), "lags")


def in_context(df: DataFrame, contexts: DataFrame, time: Column | None = None) -> DataFrame:
    """Rows of ``df`` with each context of their dyad that they are in, start included, end not."""
    time = F.col("t") if time is None else time
    c = contexts.select("dyad_id", "ctx_id", "start_sec", "end_sec", "label", "score")
    return within(df, c, time, F.col("start_sec"), F.col("end_sec"), ["dyad_id"])


def whole_recording(aligned: DataFrame) -> DataFrame:
    """One context ``full`` a dyad, from its first to its last sample (which it doesn't hold)."""
    return aligned.groupBy("dyad_id").agg(
        F.lit(0).cast("bigint").alias("ctx_id"), F.min("t").alias("start_sec"), F.max("t").alias("end_sec"), F.lit("full").alias("label"), F.lit(0.0).alias("score")
    )


def segments(paired: DataFrame, contexts: DataFrame, window: int, max_missing: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The pairs' samples within each context, numbered from its first, and diagnostics.

    Contexts of fewer than three windows are left out, and pairs of which more than
    ``max_missing`` are missing there; the second frame lists the former.
    """
    keys = ["dyad_id", "label", "pair_key"]
    inside = in_context(paired, contexts)
    by = inside.groupBy(*keys, "ctx_id").agg(
        F.min("idx").alias("__a"), F.count("*").alias("__n"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("__v")
    )
    # of contexts with one label the last counts
    last = by.groupBy(*keys).agg(F.max_by(F.struct("ctx_id", "__a", "__n", "__v"), "ctx_id").alias("s")).select(*keys, "s.*")
    fit = last.where((F.col("__n") >= 3 * window) & (F.col("__v") >= (1 - max_missing) * F.col("__n")))
    short = last.where(F.col("__n") < 3 * window).groupBy("dyad_id", "label").agg(F.max("__n").alias("samples"))
    rows = inside.join(fit.select(*keys, "ctx_id", "__a"), [*keys, "ctx_id"]).withColumn("idx", F.col("idx") - F.col("__a"))
    return rows.drop("__a", "start_sec", "end_sec", "score"), short.select("dyad_id", F.lit("segment_too_short").alias("type"), F.concat("label", F.lit(": "), "samples").alias("message"))
