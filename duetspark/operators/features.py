"""Features of correlation series: peaks, the ten features, and their SQL-only parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PAIR
from .peaks import features, peaks
from .wcc import segments, wcc

__all__ = ["all_pairs", "entropy", "features", "onset", "peaks", "per_context", "recovery", "score_view"]

def all_pairs(paired: DataFrame, window: int = 10, **options) -> DataFrame:
    return features(wcc(paired, window), **options)


def per_context(paired: DataFrame, contexts: DataFrame, window: int = 10, max_missing: float = 0.2, **options) -> DataFrame:
    """(dyad_id, label, pair_key, the ten features): series are cut to the context before correlating."""
    keys = ["dyad_id", "label", "pair_key"]
    rows, _ = segments(paired, contexts, window, max_missing)
    return features(wcc(rows, window, keys=keys), keys, max_missing=max_missing, **options)


# ---- parts that plain aggregates express ----


def onset(series: DataFrame, threshold: float = 0.2, keys: list[str] | None = None) -> DataFrame:
    """(keys, onset_idx, onset_amplitude): the first r at the threshold or above."""
    hit = F.when(F.col("r") >= threshold, F.col("idx"))
    return series.groupBy(*(keys or PAIR)).agg(F.min(hit).alias("onset_idx"), F.min_by("r", hit).alias("onset_amplitude"))


def entropy(series: DataFrame, keys: list[str] | None = None, bins: int = 10) -> DataFrame:
    """(keys, mean_synchrony, synchrony_entropy) over equal bins between least and greatest r; a value on an edge is in the upper bin."""
    keys = keys or PAIR
    by = series.where("r is not null").groupBy(*keys).agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.avg("r").alias("mean_synchrony"), F.count("*").alias("n"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    place = F.coalesce(F.least(F.floor((F.col("r") - F.col("lo")) / width * bins), F.lit(bins - 1)), F.lit(0))
    counts = series.where("r is not null").join(by, keys).groupBy(*keys, "mean_synchrony", "n", place.alias("bin")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("n")
    return counts.groupBy(*keys, "mean_synchrony").agg(F.sum(-p * F.log(p)).alias("synchrony_entropy"))


def recovery(series: DataFrame, found: DataFrame, hz: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """(keys, recovery_time): valid samples from the last peak (keys, peak_index) to the end, in seconds."""
    keys = keys or PAIR
    last = found.groupBy(*keys).agg(F.max("peak_index").alias("last"))
    n = F.count_if((F.col("idx") >= F.col("last")) & F.col("r").isNotNull())
    return series.join(last, keys).groupBy(*keys).agg((n / hz).alias("recovery_time"))


def score_view(series: DataFrame, aligned: DataFrame, contexts: DataFrame) -> DataFrame:
    """(dyad_id, ctx_id, label, start_sec, end_sec, score, mean_sync): over pairs, the mean of the
    mean r whose number is that of one of the context's samples; 0 without any. Contexts without
    samples are left out."""
    from .wcc import in_context

    times = aligned.select("dyad_id", "idx", "t").distinct()
    own = ["dyad_id", "ctx_id", "label", "start_sec", "end_sec", "score"]
    inside = in_context(times, contexts).select(*own, "idx")
    by = inside.join(series, ["dyad_id", "idx"], "left").groupBy(*own, "pair_key").agg(F.avg("r").alias("m"))
    return by.groupBy(*own).agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("mean_sync"))
