"""Reports on what was ingested: per modality, and per two-person stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(aligned: DataFrame) -> DataFrame:
    """(dyad_id, modality, samples, features, missing, t_min, t_max)."""
    by = aligned.groupBy("dyad_id", "modality", "feature").agg(
        F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    return by.groupBy("dyad_id", "modality").agg(
        F.max("n").alias("samples"), F.count("*").alias("features"), F.sum("missing").alias("missing"), F.min("lo").alias("t_min"), F.max("hi").alias("t_max"))


def validate(stream: DataFrame, expected_rate: float | None = None) -> DataFrame:
    """One report row a stream of (stream_id, row, t_ms, p1, p2), rows in file order.

    ``errors``, ``warnings`` and ``notes`` list codes; ``valid``: no error. Checked are size,
    missing and non-finite values, order and duplicates of times, rate and gaps (over three median
    intervals), spread, equality of the sides over the first 100 rows, and duration.
    """
    order = Window.partitionBy("stream_id").orderBy("row")
    odd = lambda c: F.col(c).isNull() | F.isnan(c)
    endless = lambda c: odd(c) | (F.abs(c) == float("inf"))
    rows = stream.withColumn("dt", F.col("t_ms") - F.lag("t_ms").over(order)).withColumn("k", F.row_number().over(order))
    by = _by(rows, odd, endless)
    gaps = rows.join(by.select("stream_id", "median"), "stream_id").groupBy("stream_id").agg(F.count_if(F.col("dt") > 3 * F.col("median")).alias("gaps"))
    all_ = by.join(gaps, "stream_id").withColumn("rate", F.when(F.col("median") > 0, 1000 / F.nullif("median", F.lit(0.0))))
    ratio = F.col("rate") / expected_rate if expected_rate else F.lit(1.0)
    listed = lambda *xs: F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in xs]), lambda x: x.isNotNull())
    return all_.select(
        "stream_id", "n", "missing", "non_finite", "backwards", "duplicates", "median", "rate", "gaps", "duration",
        listed(("too_few", F.col("n") < 10), ("missing", F.col("missing") > 0.2 * F.col("n")), ("non_finite", F.col("non_finite") > 0), ("backwards", F.col("backwards") > 0),
               ("no_spread", (F.col("v1") == 0) | (F.col("v2") == 0))).alias("errors"),
        listed(("missing", (F.col("missing") > 0) & (F.col("missing") <= 0.2 * F.col("n"))), ("duplicates", F.col("duplicates") > 0), ("gaps", F.col("gaps") > 0),
               ("rate", ~ratio.between(0.5, 2.0)), ("identical", F.coalesce("same", F.lit(False)))).alias("warnings"),
        listed(("short", F.col("duration") < 30000)).alias("notes"),
    ).withColumn("valid", F.size("errors") == 0)


def _by(rows: DataFrame, odd, endless) -> DataFrame:
    by = rows.groupBy("stream_id").agg(
        F.count("*").alias("n"), F.count_if(odd("p1") | odd("p2")).alias("missing"), F.count_if(endless("p1") | endless("p2") | endless("t_ms")).alias("non_finite"),
        F.count_if(F.col("dt") < 0).alias("backwards"), F.count_if(F.col("dt") == 0).alias("duplicates"), F.var_pop("p1").alias("v1"), F.var_pop("p2").alias("v2"),
        F.bool_and(F.when(F.col("k") <= 100, F.abs(F.col("p1") - F.col("p2")) < 1e-10)).alias("same"), (F.max_by("t_ms", "row") - F.min_by("t_ms", "row")).alias("duration"),
    )
    # the upper median of positive steps: steps are counted by value first
    counted = rows.where("dt > 0").groupBy("stream_id", "dt").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("stream_id").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    total = counted.groupBy("stream_id").agg(F.sum("c").alias("m"))
    median = counted.withColumn("upto", F.sum("c").over(upto)).join(total, "stream_id").where("upto > floor(m / 2)").groupBy("stream_id").agg(F.min("dt").alias("median"))
    return by.join(median, "stream_id", "left")
