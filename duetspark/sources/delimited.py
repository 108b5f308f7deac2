"""Delimited text of recording devices: the first lines tell the format, Spark reads the rest."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines that the driver looks at.
HEAD = 40


def number(s: str) -> float | None:
    """The number that a text begins with, as device exports write them; None if it begins with none."""
    m = re.match(r"\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)", s)
    return float(m.group()) if m else None


@dataclass
class Format:
    """What the head of a file says: its format, lines before the data, clock, delimiter and columns."""

    name: str | None = None
    skip: int = 0
    rate: float | None = None
    start: float | None = None
    delimiter: str = ","
    headers: list[str] = field(default_factory=list)
    header_line: bool = False


def empatica(lines: list[str]) -> Format | None:
    """A start time, a rate, then values: at most two columns each."""
    if len(lines) < 3:
        return None
    first, second = (x.strip().split(",") for x in lines[:2])
    start, rate = number(first[0]), number(second[0])
    if len(first) <= 2 and len(second) <= 2 and start is not None and rate is not None and 1e9 < start < 2e10 and 0 < rate <= 1000:
        return Format("empatica", 2, rate, start)
    return None


def opensignals(lines: list[str]) -> Format | None:
    if len(lines) < 2 or not re.match("# ?OpenSignals", lines[0]):
        return None
    return Format("opensignals", next((i for i, x in enumerate(lines) if not x.startswith("#")), len(lines)))


def biopac(lines: list[str]) -> Format | None:
    """Text lines, ten at most, of which the last is the header."""
    if len(lines) < 3 or not any(x in lines[0].lower() for x in ("acqknowledge", "biopac", "mp150", "mp160")):
        return None
    n = next((i for i, x in enumerate(lines[:10]) if number(re.split("[,\t]", x)[0]) is not None), min(10, len(lines)))
    return Format("biopac", max(n - 1, 0))


def physionet(lines: list[str]) -> Format | None:
    return Format("physionet") if len(lines) >= 2 and (lines[0].startswith("'Elapsed time'") or "PhysioNet" in lines[0]) else None


def rmea(lines: list[str], name: str) -> bool:
    """Two columns of numbers without a header, more than twenty lines."""
    if not re.search(r"\.(txt|csv)$", name, re.I) or len(lines) <= 20:
        return False
    rows = [re.split(r"[,\t\s]+", x.strip()) for x in lines[:10]]
    return len(rows[0]) == 2 and all(1 <= len(r) <= 3 and all(number(v) is not None for v in r) for r in rows)


def ibi(lines: list[str], headers: list[str]) -> bool:
    """Two columns, the second an interval under five seconds in the five rows after the first."""
    if len(headers) != 2 or not (re.search(r"ibi|inter.?beat|rr.?interval", " ".join(headers), re.I) or len(lines) > 5):
        return False
    rows = [[number(v) for v in re.split("[,\t]", x)] for x in lines[1:6]]
    return all(len(r) == 2 and None not in r and 0 < r[1] < 5 for r in rows)


def _cells(line: str, delimiter: str) -> list[str]:
    return [re.sub('^"|"$', "", v.strip()) for v in line.split(delimiter)]


def sniff(lines: list[str], name: str = "") -> Format:
    """The format of a file's first lines; lines beginning with # or % are skipped before the data."""
    found = next((f for f in (empatica(lines), opensignals(lines), biopac(lines), physionet(lines)) if f), Format())
    while found.skip < len(lines) and re.match("[#%]", lines[found.skip].strip()):
        found.skip += 1
    rest = lines[found.skip :]
    if not rest:
        return found
    found.delimiter = next((d for d in ("\t", ";") if d in rest[0]), ",")
    first = _cells(rest[0], found.delimiter)
    if all(number(v) is not None for v in first):
        if not found.name and rmea(rest, name):
            found.name, found.rate = "rmea", 25.0
        made = {1: ["value"], 2: ["person1_mea", "person2_mea"], 3: ["time", "person1", "person2"]}
        found.headers = made.get(len(first)) or [f"col_{i + 1}" for i in range(len(first))]
    else:
        found.headers, found.header_line = first, True
    if found.name == "empatica":
        found.headers = ["timestamp_s", *[h for h in found.headers if h.lower() != "timestamp"]]
    elif not found.name and ibi(rest, found.headers):
        found.name = "ibi"
    return found


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with their number in the file, from 0: counts per partition are one small row each."""
    at = lines.withColumn("__id", F.monotonically_increasing_id())
    at = at.select("*", F.shiftright("__id", 33).alias("__p"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__k"))
    counts = at.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return at.join(F.broadcast(before.select("__p", "__before")), "__p").select("value", (F.col("__before") + F.col("__k")).alias("line"))  # a row a partition


def read(spark: SparkSession, path: str) -> tuple[DataFrame, Format]:
    """(row, cells array<string>) of a file, and its format. Blank lines and metadata are left out.

    Only the head reaches the driver. An Empatica file gets its time, row / rate, as first cell.
    """
    lines = spark.read.text(path)
    head = [r["value"] for r in lines.limit(HEAD).collect()]
    f = sniff(head, path)
    begin = f.skip + int(f.header_line)
    data = numbered(lines).where((F.col("line") >= begin) & (F.trim("value") != ""))
    cells = F.transform(F.split("value", re.escape(f.delimiter)), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    row = F.col("line") - begin
    if f.name == "empatica":
        cells = F.concat(F.array((row / f.rate).cast("string")), cells)
    return data.select(row.alias("row"), cells.alias("cells")), f


#: What ``formats`` tells of a file.
FORMATS = "file string, name string, skip int, rate double, start double, delimiter string, headers array<string>, header_line boolean"


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of every line of every file of a path, lines numbered from 0 in their file.

    A file may be read by many tasks: each of its ranges counts its lines, and what lies before a
    range is a running sum over the ranges of the file.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    ranges = raw.groupBy("file", "at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("file", "at", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return raw.join(ranges, ["file", "at"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def formats(lines: DataFrame) -> DataFrame:
    """(FORMATS) of each file of (file, line, value), told by its first HEAD lines on the executors."""
    heads = lines.where(F.col("line") < HEAD).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("head"))

    def run(batches):
        for pdf in batches:
            out = []
            for file, head in zip(pdf["file"], pdf["head"], strict=True):
                f = sniff([h["value"] for h in head], file)
                out.append((file, f.name, f.skip, f.rate, f.start, f.delimiter, f.headers, f.header_line))
            yield pd.DataFrame(out, columns=["file", "name", "skip", "rate", "start", "delimiter", "headers", "header_line"])

    return heads.mapInPandas(run, FORMATS)


def read_many(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, row, cells, malformed) of all files of a path, and their formats (FORMATS), in one job.

    The path may name files of any mixture of formats. Rows and cells are those of ``read`` on each
    file: blank lines are left out but counted, an Empatica row has its time first. A row with
    another number of cells than its file has columns keeps its cells, and its line stands in
    ``malformed``; it is NULL for others. Empty files have no row and no format.
    """
    lines = _scan(spark, path)
    told = formats(lines)
    at = lines.join(told.select("file", "name", "skip", "rate", "delimiter", F.size("headers").alias("width"), "header_line"), "file")
    row = F.col("line") - F.col("skip") - F.col("header_line").cast("int")
    at = at.withColumn("row", row).where((F.col("row") >= 0) & (F.trim("value") != ""))
    cells = F.transform(F.split("value", F.col("delimiter")), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    timed = F.when(F.col("name") == "empatica", F.concat(F.array((F.col("row") / F.col("rate")).cast("string")), cells)).otherwise(cells)
    rows = at.withColumn("cells", timed)
    return rows.select("file", "row", "cells", F.when(F.size("cells") != F.col("width"), F.col("value")).alias("malformed")), told


def values(rows: DataFrame, told: DataFrame) -> DataFrame:
    """(file, row, pos, header, value) of the cells that have a column; value is NULL where a cell is no number."""
    cell = F.posexplode("headers").alias("pos", "header")
    each = rows.join(told.select("file", "headers"), "file").select("file", "row", "cells", cell)
    return each.select("file", "row", "pos", "header", F.expr("try_cast(try_element_at(cells, pos + 1) as double)").alias("value"))


def columns_of(rows: DataFrame, told: DataFrame, most: int = 20) -> DataFrame:
    """(file, pos, header, values): each column with the numbers of its first ``most`` lines, as column roles read them."""
    by = values(rows.where(F.col("row") < most), told).groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("v"))
    every = told.select("file", F.posexplode("headers").alias("pos", "header"))
    listed = F.coalesce(F.transform("v", lambda s: s["value"]), F.expr("cast(array() as array<double>)"))
    return every.join(by, ["file", "pos"], "left").select("file", "pos", "header", listed.alias("values"))


def table(rows: DataFrame, fmt: Format) -> DataFrame:
    """The cells as named columns, numbers where a whole cell is one, else NULL."""
    return rows.select("row", *[F.expr(f"try_cast(try_element_at(cells, {i + 1}) as double)").alias(h) for i, h in enumerate(fmt.headers)])


def load_csv(spark: SparkSession, path: str, time_col: str = "time", value_col: str | None = None) -> DataFrame:
    """A CSV file with a header; with ``value_col`` only the time and that column are read."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    for c in (time_col, *([value_col] if value_col else [])):
        if c not in df.columns:
            raise ValueError(f"{path} has no column {c!r}")
    return df.select(time_col, value_col) if value_col else df


def load_multimodal(spark: SparkSession, paths: dict[str, str], dyad_id: str | None = None, time_col: str = "time", value_col: str | None = None) -> DataFrame:
    """The long form of one file a modality."""
    from functools import reduce

    from ..schema import as_signals

    return reduce(DataFrame.unionByName, [as_signals(load_csv(spark, p, time_col, value_col), name, dyad_id, time_col) for name, p in paths.items()])
