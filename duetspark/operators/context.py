"""Contexts: labelled intervals of a recording, start included, end not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CONTEXTS


def contexts(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A contexts table of (dyad_id, start, end, label[, score]); an empty interval is an error."""
    for r in rows:
        if r[1] >= r[2]:
            raise ValueError(f"context {r[3]!r} starts at {r[1]} and ends at {r[2]}")
    full = [(r[0], i, float(r[1]), float(r[2]), r[3], float(r[4]) if len(r) > 4 else 0.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, CONTEXTS)


def invalid(table: DataFrame) -> DataFrame:
    return table.where("start_sec >= end_sec or start_sec is null or end_sec is null")


def within(points: DataFrame, intervals: DataFrame, time: Column, start: Column, end: Column, keys: list[str]) -> DataFrame:
    """``points`` joined with the ``intervals`` of the same ``keys`` that hold their time, start included, end not.

    Intervals are dealt by length: those of a level are no longer than its bins, and each level's bins are
    four times as wide as those of the one below. So an interval is in one or two bins of one level, a
    point in one bin of each level that occurs, and it only meets intervals near it, of however many the
    recording has. Levels are as many as lengths differ in powers of four; a few dozen at the very most.
    """
    known = intervals.where(end > start)
    level = F.ceil(F.log(4.0, (end - start).cast("double"))).cast("int")
    levels = sorted(r[0] for r in known.select(level.alias("k")).distinct().collect())
    if not levels:
        return points.join(known, keys).limit(0)
    bin_of = lambda c, k: F.floor(c / F.pow(F.lit(4.0), k))
    dealt = known.withColumn("__level", level).withColumns({"__start": start, "__end": end})
    dealt = dealt.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("__start"), F.col("__level")), bin_of(F.col("__end"), F.col("__level")))))
    at = points.withColumn("__t", time).withColumn("__level", F.explode(F.array(*map(F.lit, levels))))
    at = at.withColumn("__bin", bin_of(F.col("__t"), F.col("__level")))
    both = at.join(dealt, [*keys, "__level", "__bin"]).where((F.col("__t") >= F.col("__start")) & (F.col("__t") < F.col("__end")))
    return both.drop("__level", "__bin", "__t", "__start", "__end")


def context_at(points: DataFrame, table: DataFrame) -> DataFrame:
    """``points`` (dyad_id, t, ...) with ctx_id and label of the first context, by start, that holds t; else NULL."""
    keys = ["dyad_id", "t"]
    own = table.select("dyad_id", "ctx_id", "start_sec", "end_sec", "label")
    at = within(points.select(*keys).distinct(), own, F.col("t"), F.col("start_sec"), F.col("end_sec"), ["dyad_id"])
    first = at.groupBy(*keys).agg(F.min_by(F.struct("ctx_id", "label"), F.struct("start_sec", "ctx_id")).alias("c"))
    return points.join(first, keys, "left").select(*points.columns, F.col("c.ctx_id").alias("ctx_id"), F.col("c.label").alias("label"))


def parse(text: str, dyad_id: str) -> tuple | None:
    """``start,end,label[,score]`` of a command line; None if malformed."""
    parts = text.split(",")
    if len(parts) < 3:
        return None
    return (dyad_id, float(parts[0]), float(parts[1]), parts[2], float(parts[3]) if len(parts) > 3 else 0.0)
