"""Helpers that the corpus operators share: tables, checkpoints, components, pair checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of small rows that an operator broadcasts; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Largest sum of the widths of rows that may be long.
BROADCAST_BYTES = 64 << 20

#: Rows and bytes of an Arrow batch that Spark has unless told, and those for texts, which may be
#: long and are held by the JVM and by Python.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b"),
}


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands Python workers smaller batches, unless it has its own bounds."""
    spark = df.sparkSession
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only on one machine, as in
    tests, a temporary one does where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named and sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return named or sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this run has written, wherever it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and read it back without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """A column name starting with ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int = BROADCAST_ROWS, width: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, and their ``width`` (where rows
    may be long) adds up to BROADCAST_BYTES at most; otherwise ``df`` as it is, for a shuffled join."""
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.lit(0) if width is None else width).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["bytes"] or 0) <= BROADCAST_BYTES else df


def packed(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, already cut, in no more partitions than its rows fill: small tables make few tasks and files."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(src, dst)``: rows (v, component), the smallest id reachable.

    Each round every vertex takes the smallest label among its neighbours and then its
    label's label, so a chain shortens by more than half. Edges are read by their source in a
    plain equi-join, which adaptive execution splits where one vertex has most of them;
    minima are combined before the shuffle. Null ends are ignored; an edge to itself makes a
    vertex. Labels are cut every round.
    """
    pairs = edges.where("src is not null and dst is not null")
    both = packed(cut(pairs.select("src", "dst").union(pairs.select(F.col("dst"), F.col("src"))).distinct()))
    labels = packed(cut(both.groupBy(F.col("src").alias("v")).agg(F.least(F.col("v"), F.min("dst")).alias("label"))))
    parts = labels.rdd.getNumPartitions()
    while True:
        low = (
            both.join(labels, both["src"] == labels["v"])
            .groupBy(F.col("dst").alias("v"))
            .agg(F.min("label").alias("low"))
        )
        hooked = labels.join(low, "v").select("v", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("up"))
        step = cut(hooked.join(up, "label").select("v", "was", F.least("label", "up").alias("label"))).coalesce(parts)
        changed = step.where("was <> label").limit(1).count()
        labels = step.select("v", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
