"""Z-scores, their statistics, baselines and detrending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SERIES, ratio


def stats(aligned: DataFrame, method: str = "standard") -> DataFrame:
    """(series, centre, scale[, q25, q75]): mean and population deviation, or median and quartile range."""
    if method == "standard":
        return aligned.groupBy(*SERIES).agg(F.avg("value").alias("centre"), F.stddev_pop("value").alias("scale"))
    if method == "robust":
        q = aligned.groupBy(*SERIES).agg(F.percentile("value", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])).alias("q"))
        return q.select(*SERIES, F.col("q")[1].alias("centre"), (F.col("q")[2] - F.col("q")[0]).alias("scale"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"))
    raise ValueError(f"unknown method {method!r}")


def zscore(aligned: DataFrame, method: str = "standard", clip: float | None = None) -> DataFrame:
    """Values less their centre over their scale, drawn to +-``clip`` afterwards.

    A series without spread becomes 0 throughout, where values are missing too. Statistics are
    one small row a series and joined back, so no task holds a series.
    """
    z = ratio(F.col("value") - F.col("centre"), F.col("scale"))
    if clip is not None:
        z = F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))
    value = F.when(F.col("scale") == 0, 0.0).otherwise(z)
    return aligned.join(stats(aligned, method).select(*SERIES, "centre", "scale"), SERIES).withColumn("value", value).select(aligned.columns)


def within_dyad_zscore(
    df: DataFrame, dyad_col: str = "dyad_id", time_col: str | None = None, skip: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """A wide frame's numeric columns as z-scores within each dyad, and their statistics.

    A deviation under 1e-12 gives 0 throughout and counts as skipped; without any valid value the
    mean is 0, the deviation 1 and values 0; else missing values stay.
    """
    numeric = [c for c, k in df.dtypes if k in ("int", "bigint", "double", "float") and c not in (dyad_col, time_col, *skip)]
    valid = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numeric}
    aggs = [f(valid[c]).alias(f"{c}__{n}") for c in numeric for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("n", F.count))]
    by = df.groupBy(dyad_col).agg(*aggs)
    flat = lambda c: (F.col(f"{c}__n") == 0) | (F.col(f"{c}__std") < 1e-12)
    scored = df.join(by, dyad_col).select(*[
        F.when(flat(c), 0.0).otherwise((valid[c] - F.col(f"{c}__mean")) / F.nullif(F.col(f"{c}__std"), F.lit(0.0))).alias(c) if c in numeric else F.col(c)
        for c in df.columns
    ])
    row = lambda c: F.struct(
        F.lit(c).alias("column"), F.coalesce(f"{c}__mean", F.lit(0.0)).alias("mean"), F.coalesce(f"{c}__std", F.lit(1.0)).alias("std"),
        F.col(f"{c}__n").alias("n"), ((F.col(f"{c}__n") > 0) & flat(c)).alias("skipped"),
    )
    return scored, by.select(dyad_col, F.explode(F.array(*map(row, numeric))).alias("s")).select(dyad_col, "s.*")


def baseline_zscore(aligned: DataFrame, baseline: int) -> DataFrame:
    """Z-scores by the mean and deviation of the first ``baseline`` samples; 0 without spread there."""
    first = F.when(F.col("idx") < baseline, F.col("value"))
    by = aligned.groupBy(*SERIES).agg(F.avg(first).alias("centre"), F.stddev_pop(first).alias("scale"))
    value = F.when(F.col("value").isNotNull(), F.coalesce(ratio(F.col("value") - F.col("centre"), F.col("scale")), F.lit(0.0)))
    return aligned.join(by, SERIES).withColumn("value", value).select(aligned.columns)


def minmax(aligned: DataFrame) -> DataFrame:
    """Values between 0 at the least and 1 at the greatest; 0 without spread."""
    by = aligned.groupBy(*SERIES).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    value = F.when(F.col("value").isNotNull(), F.coalesce(ratio(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)))
    return aligned.join(by, SERIES).withColumn("value", value).select(aligned.columns)


def detrend(df: DataFrame, keys: list[str], x: str = "idx", cols: tuple[str, ...] = ("value",)) -> DataFrame:
    """``cols`` less their least-squares line over ``x`` within ``keys``; the rest has mean 0.

    A single sample, or no spread of ``x``, leaves the value less the mean.
    """
    aggs: list[Column] = []
    for c in cols:
        aggs += [F.regr_slope(c, x).alias(f"__s_{c}"), F.avg(F.when(F.col(c).isNotNull(), F.col(x))).alias(f"__x_{c}"), F.avg(c).alias(f"__m_{c}")]
    both = df.join(df.groupBy(*keys).agg(*aggs), keys)
    line = lambda c: F.col(f"__m_{c}") + F.coalesce(f"__s_{c}", F.lit(0.0)) * (F.col(x) - F.col(f"__x_{c}"))
    return both.withColumns({c: F.col(c) - line(c) for c in cols}).select(df.columns)


def hann(i: Column, n: Column) -> Column:
    """The periodic Hann window."""
    return 0.5 * (1 - F.cos(2 * F.pi() * i / n))
