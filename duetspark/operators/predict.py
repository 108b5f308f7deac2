"""Prediction of later synchrony from earlier dynamics, with splits that don't leak."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from ..schema import FEATURES, PAIR
from .features import features

#: Windows of prediction within a pair are raised with the length of a series up to this.
GROW = 60
#: Features whose missing value means the event didn't happen within the window.
DURATIONS = ("onset_latency", "peak_duration", "recovery_time")
FOLDS = "fold_id int, train_size int, test_size int, dynamic_auc double, baseline_auc double, ar_baseline_auc double, delta_auc double"


def windowed(series: DataFrame, window: int, keys: list[str], grow: int | None = None) -> DataFrame:
    """``series`` of at least one window, with the series' length n, its window w and step.

    With ``grow``, a series' window is raised to a quarter of its length, at most ``grow``.
    """
    w = F.greatest(F.lit(window), F.least(F.lit(grow), F.floor(F.col("n") / 4))) if grow else F.lit(window)
    n = series.groupBy(*keys).agg((F.max("idx") + 1).alias("n")).withColumn("w", w.cast("bigint"))
    sized = n.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("w") / 2)).cast("bigint"))
    return series.join(sized, keys).where("n >= w")


def hops(series: DataFrame, window: int, keys: list[str] | None = None, grow: int | None = None) -> DataFrame:
    """(keys, win, w, start, idx, r): samples in the windows that start every half window."""
    keys, step = keys or PAIR, F.col("step")
    lo = F.greatest(F.lit(0), F.ceil((F.col("idx") - F.col("w") + 1) / step))
    hi = F.least(F.floor(F.col("idx") / step), F.floor((F.col("n") - F.col("w")) / step))
    dealt = windowed(series, window, keys, grow).withColumn("win", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    return dealt.select(*keys, "win", "w", (F.col("win") * step).alias("start"), (F.col("idx") - F.col("win") * step).alias("idx"), "r")


def feature_matrix(series: DataFrame, window: int, hz: float = 1.0, onset: float = 0.2, keys: list[str] | None = None, grow: int | None = None) -> DataFrame:
    """(keys, win, the ten features) of each hopping window; with ``grow`` also w, the series' window."""
    keys = keys or PAIR
    return features(hops(series, window, keys, grow), [*keys, "win", *(["w"] if grow else [])], hz=hz, onset=onset)


def future_labels(series: DataFrame, window: int, horizon: int = 1, threshold: float = 0.0, keys: list[str] | None = None, grow: int | None = None) -> DataFrame:
    """(keys, win, label): whether the mean of the ``horizon`` windows after a window, cut at the end, is
    above the threshold. No row where none is left or more than half of it is missing."""
    keys, step, w = keys or PAIR, F.col("step"), F.col("w")
    # a sample is in the future of windows that end at or before it and began within reach
    lo = F.greatest(F.lit(0), F.ceil((F.col("idx") - w * (horizon + 1) + 1) / step))
    hi = F.least(F.floor((F.col("idx") - w) / step), F.floor((F.col("n") - w) / step))
    dealt = windowed(series, window, keys, grow).withColumn("win", F.explode(F.when((lo <= hi) & (hi >= 0), F.sequence(lo, hi))))
    by = dealt.groupBy(*keys, "win").agg(F.avg("r").alias("m"), F.count("r").alias("valid"), F.count("*").alias("all"))
    return by.where("valid >= 0.5 * all and valid > 0").select(*keys, "win", (F.col("m") > threshold).cast("int").alias("label"))


def examples(series: DataFrame, window: int, hz: float = 1.0, horizon: int = 1, threshold: float = 0.0, onset: float = 0.2,
             keys: list[str] | None = None, grow: int | None = None) -> DataFrame:
    """(keys, win, label, the ten features) of windows with a label and any feature, imputed: a window's
    duration for DURATIONS, 0 for the rest."""
    keys = keys or PAIR
    known = feature_matrix(series, window, hz, onset, keys, grow).where(F.coalesce(*FEATURES).isNotNull())
    duration = (F.col("w") if grow else F.lit(window)) / F.lit(float(hz))
    filled = known.withColumns({f: F.coalesce(f, duration if f in DURATIONS else F.lit(0.0)) for f in FEATURES})
    return filled.join(future_labels(series, window, horizon, threshold, keys, grow), [*keys, "win"]).select(*keys, "win", "label", *FEATURES)


def splits(n: int, folds: int, gap: int = 0) -> list[tuple[int, int, int]]:
    """(train end, test start, test end) of rolling-origin folds; empty if a fold had no training rows."""
    test = n // (folds + 1)
    if test < 1 or n - gap - folds * test <= 0:
        return []
    return [(n - (folds - k) * test - gap, n - (folds - k) * test, n - (folds - k - 1) * test) for k in range(folds)]


def fold_rows(rows: DataFrame, folds: int = 5, gap: int = 0, keys: list[str] | None = None, order: str = "win") -> DataFrame:
    """``rows`` once for each fold they take part in, with fold_id and is_test."""
    keys = keys or PAIR
    at = rows.withColumn("__k", F.row_number().over(SparkWindow.partitionBy(*keys).orderBy(order)) - 1)
    n = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    test = F.floor(F.col("__n") / (folds + 1))
    dealt = at.join(n, keys).where((test >= 1) & (F.col("__n") - gap - folds * test > 0)).withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = F.col("__n") - (folds - F.col("fold_id")) * test
    is_test = (F.col("__k") >= start) & (F.col("__k") < start + test)
    return dealt.withColumn("is_test", is_test).where(is_test | (F.col("__k") < start - gap)).drop("__k", "__n")


def auc(scored: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(keys, auc): the chance that a positive outranks a negative, ties half; NULL with one class only.

    Rows are first counted by score, so equal scores are one row of the ranking.
    """
    by = scored.groupBy(*keys, score).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    below = F.sum("n").over(SparkWindow.partitionBy(*keys).orderBy(score).rowsBetween(SparkWindow.unboundedPreceding, 0)) - F.col("n")
    ranked = by.withColumn("ranks", F.col("p") * (below + (F.col("n") + 1) / 2))
    total = ranked.groupBy(*keys).agg(F.sum("ranks").alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    pairs = F.col("p") * (F.col("n") - F.col("p"))
    return total.select(*keys, F.when(pairs > 0, (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(pairs, F.lit(0))).alias("auc"))


# ---- one small model a fold, fitted where the pair's rows are ----


def l1_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Weights, the bias last, of least |w| + sum of balanced logistic losses, by accelerated proximal steps."""
    a = np.column_stack([x, np.ones(len(x))])
    s = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    scale = np.maximum(np.abs(a).max(axis=0), 1e-9)  # steps in comparable units; the penalty stays on w
    b, pen = a / scale, 1 / scale
    step = 1 / max(0.25 * np.linalg.norm(b * np.sqrt(s)[:, None], 2) ** 2, 1e-12)
    w = v = np.zeros(a.shape[1])
    t, sign = 1.0, 2 * y - 1
    for _ in range(rounds):
        g = -(b * (s * sign / (1 + np.exp(np.clip(sign * (b @ v), -500, 500))))[:, None]).sum(axis=0)
        z = v - step * g
        new = np.sign(z) * np.maximum(np.abs(z) - step * pen, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (v - new) @ (new - w) > 0:  # restart where momentum points uphill
            t2, v = 1.0, new
        else:
            v = new + (t - 1) / t2 * (new - w)
        done = np.abs(new - w).max() < 1e-10
        w, t = new, t2
        if done:
            break
    return w / scale


def rank_auc(y: np.ndarray, p: np.ndarray) -> float:
    pos, neg = p[y == 1], p[y == 0]
    return float(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))


def _fold(x: np.ndarray, y: np.ndarray, train: int, start: int, end: int) -> tuple[float, np.ndarray]:
    w = l1_logistic(x[:train], y[:train])
    return rank_auc(y[start:end], x[start:end] @ w[:-1] + w[-1]), w[:-1]


def _verdict(y: np.ndarray, folds: int, gap: int, least: int) -> str | None:
    if len(y) < least:
        return "insufficient_samples"
    if min(y.sum(), len(y) - y.sum()) < 3:
        return "class_imbalance"
    return None if splits(len(y), folds, gap) else "data_too_short_for_cv"


def rolling_origin_cv(
    series: DataFrame, window: int = 30, hz: float = 1.0, horizon: int = 1, folds: int = 5, gap: int = 0, threshold: float = 0.0,
    onset: float = 0.2, keys: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Folds, and one row a series: means, mean coefficients and a warning.

    A window below a quarter of a series is raised to it, at most to GROW.
    Folds of fewer than three test rows or a single class are skipped. Windows, features and
    labels are made by joins and aggregates; only a series' few rows of ten features meet in a task.
    """
    keys = keys or PAIR
    rows = examples(series, window, hz, horizon, threshold, onset, keys, GROW)
    kinds = dict(rows.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("win")
        x, y = pdf[FEATURES].to_numpy(float), pdf["label"].to_numpy(int)
        out, coefs, warning = [], [], _verdict(y, folds, gap, max(3, folds))
        for k, (train, start, end) in enumerate([] if warning else splits(len(y), folds, gap)):
            if end - start < 3 or len(set(y[:train])) < 2 or len(set(y[start:end])) < 2:
                continue
            got, w = _fold(x, y, train, start, end)
            coefs.append(w)
            out.append({"fold_id": k, "train_size": train, "test_size": end - start, "dynamic_auc": got, "baseline_auc": 0.5, "ar_baseline_auc": 0.5, "delta_auc": got - 0.5})
        delta = float(np.mean([f["delta_auc"] for f in out])) if out else 0.0
        warning = warning or ("no_valid_folds" if not out else "leakage_suspected" if delta > 0.4 else None)
        return pd.DataFrame([[*key, out, dict(zip(FEATURES, np.mean(coefs, axis=0).tolist(), strict=True)) if coefs else {}, warning]], columns=[*keys, "folds", "importance", "warning"])

    struct = FOLDS.replace(" ", ":").replace(",:", ", ")
    got = rows.groupBy(*keys).applyInPandas(run, f"{head}, folds array<struct<{struct}>>, importance map<string,double>, warning string")
    return got.select(*keys, F.explode("folds").alias("f")).select(*keys, "f.*"), _summary(got, keys)


def _summary(got: DataFrame, keys: list[str]) -> DataFrame:
    mean = lambda f, d: F.when(F.size("folds") > 0, F.aggregate("folds", F.lit(0.0), lambda a, x: a + x[f]) / F.greatest(F.size("folds"), F.lit(1))).otherwise(d)
    return got.select(
        *keys, mean("dynamic_auc", 0.5).alias("mean_dynamic_auc"), mean("baseline_auc", 0.5).alias("mean_baseline_auc"),
        mean("ar_baseline_auc", 0.5).alias("mean_ar_baseline_auc"), mean("delta_auc", 0.0).alias("mean_delta_auc"),
        F.size("folds").alias("n_folds"), "importance", "warning",
    )


def cross_modal(
    series: DataFrame, window: int = 30, hz: float = 1.0, horizon: int = 1, folds: int = 5, gap: int = 0, threshold: float = 0.0, onset: float = 0.2,
) -> tuple[DataFrame, DataFrame]:
    """Every ordered pair of a dyad's series (dyad_id, pair_key): does the source's dynamics predict the
    target's later synchrony better than the target's own? Folds and one summary row a pair of pairs.

    Series need 20 rows. A gap that leaves no training rows gives the warning data_too_short_for_cv.
    """
    keys = ["dyad_id", "source", "target"]
    known = feature_matrix(series, window, hz, onset).withColumn("empty", F.coalesce(*FEATURES).isNull())
    filled = known.withColumns({f: F.coalesce(f, F.lit(window / hz if f in DURATIONS else 0.0)) for f in FEATURES})
    src = filled.where("not empty").select("dyad_id", F.col("pair_key").alias("source"), "win", F.array(*FEATURES).alias("x"))
    own = filled.join(future_labels(series, window, horizon, threshold), [*PAIR, "win"]).select(
        "dyad_id", F.col("pair_key").alias("target"), "win", "label", F.array(*FEATURES).alias("own"))
    rows = src.join(own, ["dyad_id", "win"]).where("source <> target")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("win")
        x, own, y = np.stack(pdf["x"]), np.stack(pdf["own"]), pdf["label"].to_numpy(int)
        out, coefs, warning = [], [], _verdict(y, folds, gap, 20)
        for k, (train, start, end) in enumerate([] if warning else splits(len(y), folds, gap)):
            if end - start < 3 or len(set(y[:train])) < 2 or len(set(y[start:end])) < 2:
                continue
            got, w = _fold(x, y, train, start, end)
            ar, _ = _fold(own, y, train, start, end)
            coefs.append(w)
            out.append({"fold_id": k, "train_size": train, "test_size": end - start, "dynamic_auc": got, "baseline_auc": 0.5, "ar_baseline_auc": ar, "delta_auc": got - max(0.5, ar)})
        delta = float(np.mean([f["delta_auc"] for f in out])) if out else 0.0
        warning = warning or ("no_valid_folds" if not out else "leakage_suspected" if delta > 0.4 else "ar_baseline_dominates" if delta < -0.2 else None)
        return pd.DataFrame([[*key, out, dict(zip(FEATURES, np.mean(coefs, axis=0).tolist(), strict=True)) if coefs else {}, warning]], columns=[*keys, "folds", "importance", "warning"])

    struct = FOLDS.replace(" ", ":").replace(",:", ", ")
    got = rows.groupBy(*keys).applyInPandas(run, f"dyad_id string, source string, target string, folds array<struct<{struct}>>, importance map<string,double>, warning string")
    return got.select(*keys, F.explode("folds").alias("f")).select(*keys, "f.*"), _summary(got, keys)


def multicollinearity(rows: DataFrame, keys: list[str] | None = None, above: float = 0.9) -> DataFrame:
    """(keys, feature_a, feature_b, r) of the features' pairs with |r| above; flat features have none."""
    keys = keys or PAIR
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
    spread = lambda a, b: F.stddev_pop(a) * F.stddev_pop(b)
    r = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.when(spread(a, b) > 0, F.covar_pop(a, b) / F.nullif(spread(a, b), F.lit(0.0))).alias("r")) for a, b in pairs]
    return rows.groupBy(*keys).agg(F.array(*r).alias("rs")).select(*keys, F.explode("rs").alias("p")).select(*keys, "p.*").where(F.abs("r") > above)


def bootstrap_ci(rows: DataFrame, keys: list[str], value: str, order: str, draws: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(keys, n, lower, upper): percentile interval of the means of resampled values; NULL for fewer than three.

    What the j-th place of a resample holds follows from a hash of seed, keys, draw and place, so a run
    repeats wherever it is computed. Resamples are rows, their means and percentiles aggregates; places are
    looked up by number, so a key's values are spread as well.
    """
    known = rows.where(F.col(value).isNotNull())
    numbered = known.select(*keys, F.col(value).alias("__v"), (F.row_number().over(SparkWindow.partitionBy(*keys).orderBy(order)) - 1).alias("__k"))
    n = known.groupBy(*keys).agg(F.count("*").alias("n"))
    places = n.where("n >= 3").withColumn("__d", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), *keys, F.col("__d").cast("string"), F.col("__j").cast("string")).cast("binary"))
    picked = places.withColumn("__k", F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint") % F.col("n"))
    means = picked.join(numbered, [*keys, "__k"]).groupBy(*keys, "__d").agg(F.avg("__v").alias("m"))
    ends = means.groupBy(*keys).agg(F.percentile("m", alpha / 2).alias("lower"), F.percentile("m", 1 - alpha / 2).alias("upper"))
    return n.join(ends, keys, "left").select(*keys, "n", "lower", "upper")


def fold_intervals(folds: DataFrame, keys: list[str] | None = None, column: str = "delta_auc", **options) -> DataFrame:
    """(keys, n, lower, upper): bootstrap interval of a series' folds."""
    return bootstrap_ci(folds, keys or PAIR, column, "fold_id", **options)


def feasibility(n: int, window: int = 30, step: int = 15, folds: int = 5, gap: int = 0) -> dict:
    """Whether ``n`` samples give enough windows for the folds, and what would fit."""
    windows = (n - window) // step + 1 if n >= window else 0
    needed = (folds + 1) * (1 + gap) + folds
    ok = windows >= needed
    hint = "the parameters fit" if ok else f"{windows} windows of {needed} needed: try {max(2, windows // (2 + gap) - 1)} folds, or a gap of {max(0, windows // (folds + 1) - 2)}"
    return {
        "feasible": ok, "n_samples": n, "n_windows": windows, "n_splits_requested": folds, "gap_requested": gap, "min_samples_needed": needed,
        "max_splits_safe": max(2, windows - 2) if windows >= 3 else 0, "max_gap_safe": max(0, windows - 3) if windows >= 3 else 0, "suggestion": hint,
    }


def leave_one_dyad_out(results: DataFrame, value: str = "mean_delta_auc") -> tuple[DataFrame, DataFrame]:
    """(dyad_id, actual, predicted, error): the mean of all other dyads; and (n, mae, r, error).

    The totals are one row, broadcast. Fewer than three dyads give no predictions and an error.
    """
    known = results.select("dyad_id", F.col(value).alias("actual"))
    total = known.agg(F.sum("actual").alias("s"), F.count("*").alias("n"))
    rows = known.crossJoin(F.broadcast(total)).where("n >= 3").withColumn("predicted", (F.col("s") - F.col("actual")) / (F.col("n") - 1))
    rows = rows.select("dyad_id", "actual", "predicted", F.abs(F.col("actual") - F.col("predicted")).alias("error"))
    spread = F.stddev_pop("actual") * F.stddev_pop("predicted")
    summary = rows.agg(F.count("*").alias("n"), F.avg("error").alias("mae"), F.when(spread > 0, F.covar_pop("actual", "predicted") / F.nullif(spread, F.lit(0.0))).alias("r"))
    return rows, summary.withColumn("message", F.when(F.col("n") < 3, "at least three dyads are needed"))
