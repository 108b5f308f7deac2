"""Missing values, outliers and sliding medians on aligned series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SERIES
from .neighbours import with_neighbours

#: Samples in a chunk of the neighbour windows.
CHUNK = 65_536


def _near(aligned: DataFrame) -> DataFrame:
    valid = F.col("value").isNotNull()
    return with_neighbours(aligned, SERIES, F.col("idx"), valid, F.struct("idx", "value"), F.floor(F.col("idx") / CHUNK))


def _gap(near: DataFrame) -> DataFrame:
    """``gap``: length of the run of missing samples that a missing sample is in."""
    ends = near.groupBy(*SERIES).agg(F.min("idx").alias("__first"), F.max("idx").alias("__last"))
    lo = F.coalesce(F.col("prev.idx"), F.col("__first") - 1)
    hi = F.coalesce(F.col("next.idx"), F.col("__last") + 1)
    return near.join(ends, SERIES).withColumn("gap", F.when(F.col("value").isNull(), hi - lo - 1)).drop("__first", "__last")


def max_gap_samples(max_gap_sec: float | None, hz: float) -> int | None:
    n = int(max_gap_sec * hz) if max_gap_sec else 0
    return n or None


def ffill(aligned: DataFrame, max_gap: int | None = None) -> DataFrame:
    """Missing values from the last valid one, then at the head from the next.

    With ``max_gap`` only gaps of so many samples at most are filled, whole, and not at the head.
    """
    near = _near(aligned)
    if max_gap:
        value = F.coalesce("value", F.when(F.col("gap") <= max_gap, F.col("prev.value")))
        return _gap(near).withColumn("value", value).select(aligned.columns)
    return near.withColumn("value", F.coalesce("value", "prev.value", "next.value")).select(aligned.columns)


def _between() -> Column:
    p, n = F.col("prev"), F.col("next")
    return p["value"] + (n["value"] - p["value"]) * (F.col("idx") - p["idx"]) / (n["idx"] - p["idx"])


def interpolate(aligned: DataFrame, max_gap: int | None = None) -> DataFrame:
    """Missing values on the line between their neighbours; a trailing gap holds the last value.

    Without ``max_gap`` a leading gap takes the first value; with it, longer gaps stay.
    """
    value = F.when(F.col("prev").isNotNull() & F.col("next").isNotNull(), _between()).otherwise(F.col("prev.value"))
    near = _near(aligned)
    if max_gap:
        return _gap(near).withColumn("value", F.coalesce("value", F.when(F.col("gap") <= max_gap, value))).select(aligned.columns)
    return near.withColumn("value", F.coalesce("value", value, "next.value")).select(aligned.columns)


def short_gaps(aligned: DataFrame, max_gap: int = 3) -> DataFrame:
    """Gaps of up to ``max_gap`` samples by line; at an edge, from the only neighbour; longer ones stay."""
    value = F.when(F.col("prev").isNotNull() & F.col("next").isNotNull(), _between()).otherwise(F.coalesce("prev.value", "next.value"))
    return _gap(_near(aligned)).withColumn("value", F.coalesce("value", F.when(F.col("gap") <= max_gap, value))).select(aligned.columns)


def drop_window(aligned: DataFrame) -> DataFrame:
    """Only the positions at which every series of the dyad has a value, numbered anew from 0.

    The new number of a position is how many kept ones stand before it: counted within chunks of
    positions, with the chunks' sums carried on, so that no task holds a whole recording.
    """
    whole = aligned.groupBy("dyad_id", "idx").agg(F.count_if(F.col("value").isNull()).alias("missing")).where("missing = 0")
    whole = whole.select("dyad_id", "idx", F.floor(F.col("idx") / CHUNK).alias("c"))
    inside = Window.partitionBy("dyad_id", "c").orderBy("idx")
    sums = whole.groupBy("dyad_id", "c").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("dyad_id").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = whole.withColumn("k", F.row_number().over(inside)).join(before, ["dyad_id", "c"])
    at = at.select("dyad_id", "idx", (F.col("before") + F.col("k") - 1).alias("__idx"))
    return aligned.join(at, ["dyad_id", "idx"]).withColumn("idx", F.col("__idx")).select(aligned.columns)


def handle_missing(aligned: DataFrame, strategy: str = "ffill", max_gap_sec: float | None = None, hz: float = 1.0) -> DataFrame:
    gap = max_gap_samples(max_gap_sec, hz)
    if strategy == "ffill":
        return ffill(aligned, gap)
    if strategy == "interpolate":
        return interpolate(aligned, gap)
    if strategy == "drop_window":
        return drop_window(aligned)
    raise ValueError(f"unknown strategy {strategy!r}")


def clip_bounds(aligned: DataFrame, factor: float = 3.0, method: str = "iqr") -> DataFrame:
    """(series, n, lower, upper); bounds are NULL for series with fewer than ten valid samples."""
    q = lambda p: F.percentile("value", F.lit(p))
    if method == "iqr":
        by = aligned.groupBy(*SERIES).agg(F.count("value").alias("n"), q(0.25).alias("a"), q(0.75).alias("b"))
        lower, upper = F.col("a") - factor * (F.col("b") - F.col("a")), F.col("b") + factor * (F.col("b") - F.col("a"))
    elif method == "mad":
        mid = aligned.groupBy(*SERIES).agg(F.count("value").alias("n"), q(0.5).alias("m"))
        off = aligned.join(mid, SERIES).groupBy(*SERIES).agg(F.percentile(F.abs(F.col("value") - F.col("m")), F.lit(0.5)).alias("d"))
        by = mid.join(off, SERIES)
        lower, upper = F.col("m") - factor * 1.4826 * F.col("d"), F.col("m") + factor * 1.4826 * F.col("d")
    else:
        raise ValueError(f"unknown method {method!r}")
    enough = F.col("n") >= 10
    return by.select(*SERIES, "n", F.when(enough, lower).alias("lower"), F.when(enough, upper).alias("upper"))


def clip_outliers(aligned: DataFrame, factor: float = 3.0, method: str = "iqr") -> tuple[DataFrame, DataFrame]:
    """Values drawn to the bounds, and (series, n, lower, upper, clipped)."""
    limits = clip_bounds(aligned, factor, method)
    both = aligned.join(limits, SERIES)
    value = F.when(F.col("value").isNull() | F.col("lower").isNull(), F.col("value")).otherwise(F.greatest("lower", F.least("upper", "value")))
    report = both.groupBy(*SERIES, "n", "lower", "upper").agg(F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).alias("clipped"))
    return both.withColumn("value", value).select(aligned.columns), report


def median_filter(aligned: DataFrame, kernel: int = 5) -> DataFrame:
    """Median over ``kernel`` samples (an even one is raised by one) of each run of valid samples.

    Runs shorter than the kernel, and series with fewer valid samples, stay; at a run's ends the
    run is reflected, the end sample included. A sample looks up its neighbours by position, so
    rows are dealt by series and position alone.
    """
    kernel += 1 - kernel % 2
    h = kernel // 2
    # the run's ends are the missing samples beside it
    gaps = with_neighbours(
        aligned, SERIES, F.col("idx"), F.col("value").isNull(), F.col("idx"), F.floor(F.col("idx") / CHUNK)
    )
    ends = aligned.groupBy(*SERIES).agg(F.min("idx").alias("__a"), F.max("idx").alias("__b"))
    runs = gaps.join(ends, SERIES).withColumns({"__lo": F.coalesce(F.col("prev") + 1, "__a"), "__hi": F.coalesce(F.col("next") - 1, "__b")})
    runs = runs.where("value is not null and __hi - __lo + 1 >= " + str(kernel))
    # each valid sample stands in the windows around it, and again where a run's end mirrors it
    at, lo, hi = F.col("idx"), F.col("__lo"), F.col("__hi")
    shown = F.flatten(F.array(
        F.array(at),
        F.when(at - lo < h, F.array(2 * lo - 1 - at)).otherwise(F.array().cast("array<bigint>")),
        F.when(hi - at < h, F.array(2 * hi + 1 - at)).otherwise(F.array().cast("array<bigint>")),
    ))
    spread = runs.select(*SERIES, "__lo", "__hi", "value", F.explode(shown).alias("s"))
    spread = spread.select(*SERIES, "__lo", "__hi", "value", F.explode(F.sequence(F.greatest(F.col("s") - h, lo), F.least(F.col("s") + h, hi))).alias("idx"))
    middle = spread.groupBy(*SERIES, "idx").agg(F.array_sort(F.collect_list("value"))[h].alias("__m"))  # kernel values
    return aligned.join(middle, [*SERIES, "idx"], "left").withColumn("value", F.coalesce("__m", "value")).select(aligned.columns)
