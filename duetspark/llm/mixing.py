"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fresh, small, table

#: A larger mean is split into that many equal draws, so that exp(-mean) keeps its precision.
PIECE = 100.0


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash of the parts (52 bits of MD5)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / 2.0**52


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, power: float = 0.5,
          source_col: str = "source") -> DataFrame:
    """(source, pieces, cdf): how often a document of each source is to appear, on average.

    With ``weights`` a source gets that share of ``total`` rows (of all rows, if None); sources
    without a weight get none. Without, shares are the sources' row counts to ``power``.
    cdf holds the Poisson distribution of the rate divided by ``pieces``.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow("n", F.lit(power)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
        weight = F.coalesce(F.try_element_at(given, "source"), F.lit(0.0)) if weights else F.lit(0.0)
        weighed = counts.withColumn("weight", weight.cast("double"))
    whole = weighed.agg(F.sum("weight").alias("weights"), F.sum("n").alias("rows"))
    rate = F.when(
        F.col("weights") > 0, (F.lit(float(total)) if total is not None else F.col("rows")) * F.col("weight") / F.col("weights") / F.col("n")
    ).otherwise(0.0)
    rated = weighed.crossJoin(F.broadcast(whole)).withColumn("rate", rate)  # whole is one row
    rated = rated.withColumn("pieces", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("pieces")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 25).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["cdf"], F.array(acc["c"] + p)).alias("cdf"))

    return rated.withColumn("mean", mean).select(
        "source", "rate", "pieces", F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"].alias("cdf")
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, power: float = 0.5,
        seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` replicated to target source weights and shuffled globally, with a column ``copy``.

    A document appears as often as the inverse Poisson distribution with its source's rate says
    at a number hashed from the seed and its id: the same in every run and partitioning. Copies
    count from 1. Rows are dealt to partitions and ordered within them by a hash of id and copy,
    so no source or id gathers in one place.

    Null sources are a source of their own (weight 0 if weights are given); null ids hash as an
    empty id; rows that repeat an id are replicated alike; texts are never read. An empty table
    gives an empty one. A column of ``docs`` named ``copy`` stays, and the new one gets an
    underscore.
    """
    rated = small(rates(docs, weights, total, power, source_col).select(
        F.struct(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("__source"),
        F.col("pieces").alias("__pieces"), F.col("cdf").alias("__cdf"),
    ), 5_000)
    name = fresh(docs, "copy")
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    draws = F.transform(F.sequence(F.lit(1), F.col("__pieces")), lambda j: uniform(F.lit(str(seed)), ident, j.cast("string")))  # each drawn once
    counted = docs.withColumn("__source", F.struct(F.coalesce(source_col, F.lit("")), F.col(source_col).isNull())).join(
        rated, "__source"
    )
    times = F.aggregate("__draws", F.lit(0), lambda acc, u: acc + F.size(F.filter("__cdf", lambda c: c <= u)))
    copies = counted.withColumn("__draws", draws).withColumn("__times", times).where("__times > 0").select(
        *docs.columns, F.explode(F.sequence(F.lit(1), F.col("__times"))).alias(name)
    )
    key = F.xxhash64(F.lit(seed), ident, F.col(name))
    return copies.withColumn("__key", key).repartition("__key").sortWithinPartitions("__key").drop("__key")


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH RECURSIVE n AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM n) * w / (SELECT sum(w) FROM n) / n AS mean FROM n),
c(source, mean, k, p, c) AS (
  SELECT source, mean, 0, exp(-mean), exp(-mean) FROM r
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM c WHERE k < mean + 12 * sqrt(mean) + 24),
d AS (SELECT *, ('0x' || substr(md5('17:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
t AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) FILTER (c.c <= d.u) AS times
      FROM d JOIN c ON c.source = d.source GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, times + 1)) AS INTEGER) AS copy FROM t
"""
