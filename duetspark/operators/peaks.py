"""Peaks of series of any length: a series is packed in chunks, and no task holds more than a few of them.

Heights, distances, prominences and widths are those of the whole series. What a chunk can't tell
alone goes on as rows: runs of equal values that cross a border are put together from each chunk's
first and last run; whether a summit stays beside a higher one is settled in rounds, as far as each
chunk and its surroundings tell; and a search for higher or lower ground that leaves its chunk finds by
the chunks' extremes the one it ends in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES, PAIR
from ._peaks import Search, ends_of_runs, level_runs, settle, summits
from .neighbours import with_neighbours
from .reuse import cut

#: Samples of a chunk, and how far beyond it summits are looked at together.
CHUNK, AROUND = 16_384, 2_048

_ASKED = "sid string, p bigint, v double, n bigint, side int, above boolean, level double"
_ANSWER = f"{_ASKED}, c bigint, at bigint, low double, v_at double, v_in double, open boolean"


class Packed:
    """Series (keys, idx, r) as one row a chunk: sid, c, n, m, rs. ``idx`` counts from 0 without holes;
    ``n`` is the series' length, ``m`` the mean of its known values (0 without any), for missing ones."""

    def __init__(self, series: DataFrame, keys: list[str], onset: float, chunk: int):
        self.chunk, self.keys, self.onset = chunk, keys, onset
        kinds = dict(series.dtypes)
        self.schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
        rows = series.select(F.to_json(F.struct(*keys)).alias("sid"), F.col("idx").cast("bigint").alias("idx"), "r")
        arrays = rows.groupBy("sid", F.floor(F.col("idx") / chunk).alias("c")).agg(F.array_sort(F.collect_list(F.struct("idx", "r"))).alias("s"))
        self.raw = cut(arrays.select("sid", "c", F.col("s.r").alias("rs")))
        r = F.col("r")
        self.stats = cut(self.samples().groupBy("sid").agg(
            F.count("*").alias("n"), F.count(r).alias("known"), F.avg(r).alias("mean"), F.min(r).alias("lo"), F.max(r).alias("hi"),
            F.min(F.when(r >= onset, F.col("i"))).alias("start")))
        self.rows = self.raw.join(self.stats.select("sid", "n", F.coalesce("mean", F.lit(0.0)).alias("m")), "sid")

    def samples(self) -> DataFrame:
        """(sid, i, r), a row a sample."""
        return self.raw.select("sid", "c", F.posexplode("rs").alias("pos", "r")).select("sid", (F.col("c") * self.chunk + F.col("pos")).alias("i"), "r")

    def named(self, df: DataFrame) -> DataFrame:
        """``df`` with the keys instead of sid."""
        return df.withColumn("sid", F.from_json("sid", self.schema)).select("sid.*", *[c for c in df.columns if c != "sid"])


def _values(rs, m: float) -> np.ndarray:
    v = np.asarray(rs, float)
    return np.where(np.isnan(v), m, v)


def _each(pdf: pd.DataFrame, *more: str) -> Iterator[tuple]:
    return zip(*(pdf[c].tolist() for c in ("sid", "c", "n", "m", "rs", *more)), strict=True)


def _in_chunks(chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sid, c, n, m, rs in _each(pdf):
                v = _values(rs, m)
                out += [(sid, c * chunk + p, v[p], n) for p in summits(v).tolist()]
            yield pd.DataFrame(out, columns=["sid", "p", "v", "n"])

    return run


def _borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for sid, c, n, m, rs in _each(pdf):
            v = _values(rs, m)
            starts, ends = level_runs(v)
            many = len(starts) > 1
            out.append((sid, c, n, len(v), v[0], ends[0], v[starts[1]] if many else v[0], v[-1], len(v) - starts[-1], v[starts[-2]] if many else v[0], v.max(), v.min()))
        yield pd.DataFrame(out, columns=["sid", "c", "n", "len", "first", "first_len", "after", "last", "last_len", "before", "high", "low"])


_BORDER = "sid string, c bigint, n bigint, len bigint, first double, first_len bigint, after double, last double, last_len bigint, before double, high double, low double"


def _settled(found: DataFrame, distance: int, chunk: int) -> DataFrame:
    """The summits (sid, p, v, n) that stay, by rounds; each settles all but chains longer than AROUND."""
    own = F.floor(F.col("p") / chunk)
    near = F.sequence(F.floor((F.col("p") - AROUND) / chunk), F.floor((F.col("p") + AROUND) / chunk))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p", ignore_index=True)
        lo, hi, p = int(key[1]) * chunk - AROUND, (int(key[1]) + 1) * chunk + AROUND, pdf["p"].to_numpy(np.int64)
        pdf["fate"] = settle(p, pdf["v"].to_numpy(), pdf["fate"].to_numpy(np.int64), distance, -np.inf if lo <= 0 else lo, np.inf if hi >= pdf["n"].iloc[0] else hi)
        return pdf[p // chunk == key[1]][["sid", "p", "v", "n", "fate"]]

    state = found.withColumn("fate", F.lit(0))
    while True:
        now = cut(state.withColumn("c", F.explode(near)).groupBy("sid", "c").applyInPandas(run, "sid string, p bigint, v double, n bigint, fate int"))
        if not now.where("fate = 0").limit(1).count():
            return now.where("fate = 1").drop("fate")
        state = now


def _searched(chunk: int, begin: bool):
    """Answers in a row's chunk: from p on, or with ``begin`` from the border by which the search comes in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sid, c, n, m, rs, asked in _each(pdf, "asked"):
                v = _values(rs, m)
                searches, base, end = {1: Search(v), -1: Search(v[::-1])}, c * chunk, len(v)
                for q in asked:
                    side, s = q["side"], searches[q["side"]]
                    start = 0 if begin else q["p"] - base + 1 if side > 0 else end - (q["p"] - base)
                    k = s.first(start, q["level"], q["above"]) if start < end else -1
                    passed = s.v[start : k if k >= 0 else end]
                    low = min(q["low"], passed.min()) if len(passed) else q["low"]
                    inner = s.v[k - 1] if k > 0 else q["v_in"]
                    edge = c * chunk + end >= n if side > 0 else c == 0
                    at = None if k < 0 else base + (k if side > 0 else end - 1 - k)
                    out.append((sid, q["p"], q["v"], n, side, q["above"], q["level"], c, at, low, s.v[k] if k >= 0 else None, inner if k >= 0 else None, k < 0 and not edge))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _ANSWER.split(", ")])

    return run


def _onward(chunk: int):
    """For searches that left their chunk: the one in which they end, what lies between, and the value before its border."""

    def run(asked: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked):
            chunks = chunks.sort_values("c")
            high, low = chunks["high"].to_numpy(), chunks["low"].to_numpy()
            ways = {1: (Search(high), Search(low)), -1: (Search(high[::-1]), Search(low[::-1]))}
            inner = {1: chunks["last"].to_numpy(), -1: chunks["first"].to_numpy()[::-1]}
            for q in asked.to_dict("records"):
                side, n = q["side"], len(chunks)
                start = int(q["c"]) + 1 if side > 0 else n - int(q["c"])
                lows, way = ways[side][1].v, ways[side][0 if q["above"] else 1]
                k = way.first(start, q["level"], q["above"])
                between = lows[start : k if k >= 0 else n]
                q["low"] = min(q["low"], between.min()) if len(between) else q["low"]
                q["c"], q["v_in"], q["open"] = (k if side > 0 else n - 1 - k, inner[side][k - 1], True) if k >= 0 else (q["c"], None, False)
                out.append(q)
        return pd.DataFrame(out, columns=[f.split()[0] for f in _ANSWER.split(", ")])

    return run


def _answers(packed: Packed, borders: DataFrame, asked: DataFrame) -> DataFrame:
    """For each of ``asked`` (p, side, above, level) the nearest place on that side whose value is above the
    level, or else at it or below (``at``, null: none), the least value between, and the values there and
    next to it."""
    start = asked.withColumns({"low": F.lit(float("inf")), "v_in": F.col("v"), "c": F.floor(F.col("p") / packed.chunk)})

    def met(df: DataFrame, begin: bool) -> DataFrame:
        fields = F.struct("p", "v", "side", "above", "level", "low", "v_in")
        by = df.groupBy("sid", "c").agg(F.collect_list(fields).alias("asked"))
        return packed.rows.join(by, ["sid", "c"]).mapInPandas(_searched(packed.chunk, begin), _ANSWER)

    first = cut(met(start, False))
    on = first.where("open").groupBy("sid").cogroup(borders.groupBy("sid")).applyInPandas(_onward(packed.chunk), _ANSWER)
    on = cut(on)
    return first.where("not open").unionByName(on.where("not open")).unionByName(met(on.where("open"), True))


def _alone(height: float, distance: int, prominence: float):
    """The same of series that are one chunk each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sid, _, n, m, rs in _each(pdf):
                v = _values(rs, m)
                p = summits(v)
                p = p[v[p] >= height]
                p = p[settle(p, v[p], np.zeros(len(p), np.int64), distance, -np.inf, np.inf) == 1]
                ways = (Search(v), Search(v[::-1]))
                for at in p.tolist():
                    starts = (at + 1, n - at)
                    ends = [s.first(a, v[at], True) for s, a in zip(ways, starts, strict=True)]
                    tall = v[at] - max(s.v[a : k if k >= 0 else n].min() for s, a, k in zip(ways, starts, ends, strict=True))
                    level, wide = v[at] - tall / 2, 0.0
                    for s, a in zip(ways, starts, strict=True) if tall >= prominence else ():
                        k = s.first(a, level, False)
                        wide += k - a + 1 - ((level - s.v[k]) / (s.v[k - 1] - s.v[k]) if s.v[k] < level else 0.0)
                    if wide >= 1:
                        out.append((sid, at, v[at], n, tall, wide))
            yield pd.DataFrame(out, columns=["sid", "p", "v", "n", "tall", "wide"])

    return run


def _found(packed: Packed, height: float, distance: int, prominence: float) -> DataFrame:
    """(sid, p, v, tall, wide) of the peaks that pass, in turn, height, distance, prominence and a width of
    one sample at half prominence."""
    chunk, rows = packed.chunk, packed.rows
    if (packed.stats.agg(F.max("n")).first()[0] or 0) <= chunk:
        return rows.mapInPandas(_alone(height, distance, prominence), "sid string, p bigint, v double, n bigint, tall double, wide double")
    borders = cut(rows.mapInPandas(_borders, _BORDER))

    def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("c")
        out = ends_of_runs(own.to_dict("records"), chunk)
        return pd.DataFrame([(key[0], p, v, own["n"].iloc[0]) for p, v in out], columns=["sid", "p", "v", "n"])

    tops = rows.mapInPandas(_in_chunks(chunk), "sid string, p bigint, v double, n bigint")
    tops = tops.unionByName(borders.groupBy("sid").applyInPandas(across, "sid string, p bigint, v double, n bigint"))
    kept = _settled(tops.where(F.col("v") >= height), distance, chunk)

    def both(df: DataFrame, above: bool, level: Column) -> DataFrame:
        sides = df.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1)))).select("sid", "p", "v", "n", "side", F.lit(above).alias("above"), level.alias("level"))
        return _answers(packed, borders, sides)

    by = both(kept, True, F.col("v")).groupBy("sid", "p", "v", "n").agg((F.col("v") - F.max("low")).alias("tall"))
    proud = cut(by.where(F.col("tall") >= prominence))
    slope = F.when(F.col("v_at") < F.col("level"), (F.col("level") - F.col("v_at")) / F.nullif(F.col("v_in") - F.col("v_at"), F.lit(0.0))).otherwise(0.0)
    reach = both(proud, False, F.col("v") - F.col("tall") / 2).select("sid", "p", F.col("side"), (F.col("at") - F.col("side") * slope).alias("x"))
    wide = reach.groupBy("sid", "p").agg(F.sum(F.col("x") * F.col("side")).alias("wide")).where("wide >= 1")
    return proud.join(wide, ["sid", "p"])


def _rates(packed: Packed, found: DataFrame, hz: float) -> DataFrame:
    """``found`` with the peaks before and after, and the rates of rise and fall.

    Every sample between two peaks is dealt to that pair of peaks; of the least values the first counts.
    """
    v = F.coalesce("r", "mean", F.lit(0.0))
    samples = packed.samples().join(packed.stats.select("sid", "mean"), "sid").select("sid", "i", v.alias("v"))
    marked = samples.join(found.select("sid", F.col("p").alias("i"), F.lit(True).alias("peak")), ["sid", "i"], "left")
    near = with_neighbours(marked, ["sid"], F.col("i"), F.col("peak").isNotNull(), F.col("i"), F.floor(F.col("i") / packed.chunk))
    between = cut(near.where("peak is null").groupBy("sid", F.col("prev").alias("before"), F.col("next").alias("after")).agg(
        F.min(F.struct("v", "i")).alias("low"), F.sum("v").alias("sum"), F.count("*").alias("count")))
    left = between.where("after is not null").select("sid", F.col("after").alias("p"), "before", F.col("low").alias("l"), (F.col("sum") / F.col("count")).alias("head"))
    right = between.where("before is not null").select("sid", F.col("before").alias("p"), "after", F.col("low").alias("h"), "sum", "count")
    both = found.join(left, ["sid", "p"]).join(right, ["sid", "p"])  # no peak is a first or a last sample
    rise = F.when(F.col("before").isNull(), (F.col("v") - F.col("head")) / (F.col("p") / hz)).otherwise((F.col("v") - F.col("l.v")) / ((F.col("p") - F.col("l.i")) / hz))
    tail = (F.col("sum") + F.col("v")) / (F.col("count") + 1)
    fall = F.when(F.col("after").isNull(), (F.col("v") - tail) / (F.col("count") / hz)).otherwise((F.col("v") - F.col("h.v")) / ((F.col("h.i") - F.col("p")) / hz))
    return both.select(
        "sid", F.col("p").alias("peak_index"), (F.col("p") / hz).alias("peak_time_sec"), F.col("v").alias("peak_value"), F.col("tall").alias("prominence"),
        F.col("wide").alias("width_samples"), ((F.col("after") - F.col("p")) / hz).alias("inter_peak_interval_sec"), rise.alias("build_up_rate"), fall.alias("breakdown_rate"))


def _profiles(packed: Packed, hz: float, height: float, distance: int | None, prominence: float | None) -> DataFrame:
    found = _found(packed, height, max(10, int(hz)) if distance is None else distance, height / 2 if prominence is None else prominence)
    return _rates(packed, cut(found), hz)


def peaks(series: DataFrame, keys: list[str] | None = None, hz: float = 1.0, height: float = 0.2, distance: int | None = None,
          prominence: float | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row a peak of each series (keys, idx, r): place, time, value, prominence, width, time to the
    next, rates of rise and fall. Missing values count as the mean of the series."""
    packed = Packed(series, keys or PAIR, height, chunk)
    return packed.named(_profiles(packed, hz, height, distance, prominence))


def features(series: DataFrame, keys: list[str] | None = None, hz: float = 1.0, onset: float = 0.2, max_missing: float = 0.2, height: float | None = None,
             distance: int | None = None, prominence: float | None = None, aggregation: str = "mean", chunk: int = CHUNK) -> DataFrame:
    """(keys, the ten features) of each series (keys, idx, r); NULL throughout where too much is missing or
    there is no peak. ``aggregation`` over peaks: mean, median, or max for the values of the highest one."""
    packed = Packed(series, keys or PAIR, onset, chunk)
    found = cut(_profiles(packed, hz, onset if height is None else height, distance, prominence))
    tallest = F.struct("peak_value", -F.col("peak_index"))
    over = {"max": lambda c: F.max_by(c, tallest), "median": lambda c: F.percentile(c, 0.5)}.get(aggregation, F.avg)
    by = found.groupBy("sid").agg(
        F.min("peak_index").alias("first"), F.max("peak_index").alias("last"), F.max("peak_value").alias("peak_amplitude"), over("build_up_rate").alias("build_up_rate"),
        (over("width_samples") / hz).alias("peak_duration"), over("breakdown_rate").alias("breakdown_rate"))
    fit = packed.stats.where((F.col("known") >= 5) & (1 - F.col("known") / F.col("n") <= max_missing)).join(by, "sid")
    r, i, start = F.col("r"), F.col("i"), F.coalesce("start", F.lit(0))
    rising = F.when((i >= start) & (i <= F.col("first")), r)
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((r - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 10), F.lit(9))).otherwise(0)
    counts = [F.count_if(r.isNotNull() & (bin_ == k)).alias(f"b{k}") for k in range(10)]
    share = [F.when(F.col(f"b{k}") > 0, -F.col(f"b{k}") / F.col("known") * F.ln(F.col(f"b{k}") / F.col("known"))).otherwise(0.0) for k in range(10)]
    rest = packed.samples().join(fit, "sid").groupBy("sid").agg(
        F.regr_slope(rising, i / hz).alias("slope"), F.count(rising).alias("rising"), F.count_if(r.isNotNull() & (i >= F.col("last"))).alias("after"),
        F.min_by(r, F.when(r.isNotNull() & (i < F.greatest("first", F.lit(1))), i)).alias("head"), F.max(F.when(i == F.col("start"), r)).alias("hit"), *counts)
    slope = F.when((F.col("first") - start > 1) & (F.col("rising") > 1), F.col("slope")).otherwise(0.0)
    ten = fit.join(rest, "sid").select(
        "sid", (F.coalesce("start", "first") / hz).alias("onset_latency"), F.coalesce("hit", "head").alias("onset_amplitude"), slope.alias("build_up_slope"), "build_up_rate", "peak_amplitude",
        "peak_duration", "breakdown_rate", (F.nullif("after", F.lit(0)) / hz).alias("recovery_time"), F.col("mean").alias("mean_synchrony"), sum(share[1:], share[0]).alias("synchrony_entropy"))
    return packed.named(packed.stats.select("sid").join(ten, "sid", "left").select("sid", *FEATURES))
