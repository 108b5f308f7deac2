"""European Data Format: a text header, then records of 16-bit samples."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Widths of the header's fields, of the file and of each signal.
MAIN = [("version", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8), ("bytes", 8), ("reserved", 44), ("records", 8), ("duration", 8), ("signals", 4)]
SIGNAL = [("label", 16), ("transducer", 80), ("dimension", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("samples", 8), ("reserved", 32)]
SAMPLES = "path string, signal int, label string, rate double, idx bigint, t double, value double"
#: Bytes of the file's own header and of each signal's.
WIDTH = 256
#: Samples in a batch that leaves a task.
BATCH = 200_000
#: Paths of stores that tasks can read ranges of; files of others come whole, through Spark.
REACHED = "^(file|hdfs|s3|gs|abfss?):"
#: Bytes of records that a task reads at a time.
RANGE = 8 << 20


@dataclass
class Header:
    main: dict[str, str]
    signals: list[dict[str, str]]

    def number(self, text: str, default: float = 0.0) -> float:
        m = re.match(r"\s*[+-]?\d+\.?\d*", text)
        return float(m.group()) if m else default

    @property
    def samples(self) -> list[int]:
        return [int(self.number(s["samples"])) for s in self.signals]

    @property
    def duration(self) -> float:
        return self.number(self.main["duration"]) or 1.0

    @property
    def start(self) -> int:
        """The place of the first record."""
        return int(self.number(self.main["bytes"]))

    def values(self, there: int) -> int:
        """How many of the 16-bit values after the header belong to records."""
        return len(range(max(0, there))[: int(self.number(self.main["records"])) * sum(self.samples)])

    def physical(self, k: int, digital: np.ndarray) -> np.ndarray:
        pmin, pmax, dmin, dmax = (self.number(self.signals[k][x]) for x in ("pmin", "pmax", "dmin", "dmax"))
        scale = (pmax - pmin) / (dmax - dmin) if dmax != dmin else np.nan
        return digital.astype(float) * scale + (pmin - dmin * scale)


def parse_header(data: bytes, signals: bool = True) -> Header:
    """The header that ``data`` begins with; without ``signals`` the file's own fields alone."""

    def fields(widths: list[tuple[str, int]], at: int, each: int = 1) -> tuple[dict[str, list[str]], int]:
        out = {}
        for name, width in widths:
            out[name] = [data[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(each)]
            at += width * each
        return out, at

    main, at = fields(MAIN, 0)
    main = {k: v[0] for k, v in main.items()}
    n = int(main["signals"] or 0) if signals else 0
    by, _ = fields(SIGNAL, at, n)
    return Header(main, [{k: v[i] for k, v in by.items()} for i in range(n)])


def decode(data: bytes) -> Iterator[tuple[int, str, float, np.ndarray]]:
    """(number, label, rate, physical values) of each signal; a truncated tail gives what is there."""
    h = parse_header(data)
    size, begin = sum(h.samples), min(len(data), h.start)
    body = np.frombuffer(data, "<i2", count=h.values((len(data) - begin) // 2), offset=begin)
    place = np.arange(len(body)) % max(size, 1)
    at = 0
    for k, s in enumerate(h.signals):
        own = body[(place >= at) & (place < at + h.samples[k])]
        at += h.samples[k]
        yield k, s["label"], h.samples[k] / h.duration, h.physical(k, own)


def _open(path: str):
    """A file by its path as Spark writes it, in a store that is REACHED."""
    if re.match("file:|/", path):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", path))
    system, inner = fs.FileSystem.from_uri(quote(path, safe=":/@?&=%+,;~"))
    return system.open_input_file(inner)


def ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, head, first, count) of (path, length): runs of whole records of about ``size`` bytes.

    Only headers are read. A truncated file ends with what is there.
    """

    def run(batches):
        for pdf in batches:
            for name, length in zip(pdf["path"], pdf["length"], strict=True):
                if length < WIDTH:
                    continue
                with _open(name) as f:
                    head = f.read(WIDTH)
                    head += f.read(max(0, int(parse_header(head[:WIDTH], False).main["signals"] or 0)) * WIDTH)
                h = parse_header(head)
                values = h.values((length - h.start) // 2)
                if values:
                    each = max(1, size // (2 * sum(h.samples)))
                    first = np.arange(0, -(-values // sum(h.samples)), each)
                    yield pd.DataFrame({"path": name, "head": head, "first": first, "count": each})

    return files.mapInPandas(run, "path string, head binary, first bigint, count bigint")


def read(spark: SparkSession, path: str, labels: list[str] | None = None, size: int = RANGE, tasks: int | None = None) -> DataFrame:
    """(path, signal, label, rate, idx, t, value) of all signals, or those of ``labels``, of all files of a path.

    Files are read in ranges of records dealt in turn over ``tasks`` tasks (the session's shuffle
    partitions), so a long file is many tasks' work and none holds more than a range. Samples of
    other signals are not decoded. A value is NULL where a signal's digital range is empty. A file
    shorter than a header, or without signals, has no rows. A file of a store that only Spark
    reads comes whole, as one cell of 2 GB at most.
    """

    def run(batches):
        for pdf in batches:
            for name, head, first, count in zip(pdf["path"], pdf["head"], pdf["first"], pdf["count"], strict=True):
                h = parse_header(head)
                width = sum(h.samples)
                with _open(name) as f:
                    there = h.values((f.size() - h.start) // 2) - first * width
                    f.seek(h.start + 2 * first * width)
                    body = np.frombuffer(f.read(2 * min(count * width, there)), "<i2")
                whole = len(body) // width * width
                at = 0
                for k, (signal, m) in enumerate(zip(h.signals, h.samples, strict=True)):
                    if labels is None or signal["label"] in labels:
                        own = np.concatenate([body[:whole].reshape(-1, width)[:, at : at + m].ravel(), body[whole:][at : at + m]])
                        idx, rate, own = np.arange(first * m, first * m + len(own)), m / h.duration, h.physical(k, own)
                        for part in range(0, len(own), BATCH):
                            s = slice(part, part + BATCH)
                            yield pd.DataFrame({"path": name, "signal": k, "label": signal["label"], "rate": rate, "idx": idx[s], "t": idx[s] / rate, "value": own[s]})
                    at += m

    # an exact number: rows are few and small here, and would else be put together again
    files = spark.read.format("binaryFile").load(path)
    near = F.col("path").rlike(REACHED)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a file's ranges go to one task after the other, from one that its path tells; hashes would leave tasks without any
    turn = F.pmod(F.pmod(F.xxhash64("path"), F.lit(tasks)) + F.floor(F.col("first") / F.col("count")), F.lit(tasks)).cast("int")
    dealt = ranges(files.where(near).select("path", "length"), size).repartitionById(tasks, turn)
    out = dealt.mapInPandas(run, SAMPLES)
    if files.where(~near).select("path").limit(1).isEmpty():
        return out

    def run_whole(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                for k, label, rate, own in decode(content) if len(content) >= WIDTH else ():
                    if labels is None or label in labels:
                        for part in range(0, len(own), BATCH):
                            value = own[part : part + BATCH]
                            idx = np.arange(part, part + len(value))
                            yield pd.DataFrame({"path": name, "signal": k, "label": label, "rate": rate, "idx": idx, "t": idx / rate, "value": value})

    return out.unionByName(files.where(~near).select("path", "content").mapInPandas(run_whole, SAMPLES))


def common_clock(samples: DataFrame) -> DataFrame:
    """(path, idx, t, label, value) at the highest rate: slower signals repeat, annotations are dropped."""
    data = samples.where(~F.col("label").rlike("(?i)^(EDF Annotations|Status|Annotation)"))
    by = data.groupBy("path", "signal", "label", "rate").agg(F.count("*").alias("n"))
    top = by.groupBy("path").agg(F.max("rate").alias("top"), F.max("n").alias("total"))
    at = by.join(top, "path").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1)).alias("i"))
    at = at.withColumn("idx", F.least(F.floor(F.col("i") * F.col("rate") / F.col("top")), F.col("n") - 1))
    return at.join(data.select("path", "signal", "idx", "value"), ["path", "signal", "idx"]).select("path", F.col("i").alias("idx"), (F.col("i") / F.col("top")).alias("t"), "label", "value")
