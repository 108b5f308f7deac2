"""Live pairs: modalities of a stream that meet by event time, and their sliding correlation with timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: State of ``correlations`` needs a store that keeps several variables a key.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "dyad_id string, pair_key string, epoch_start timestamp, r double, ended boolean"


def pairs(signals: DataFrame, length: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(dyad_id, pair_key, w, x, y): epoch means of every two modalities of a dyad, of signals
    (dyad_id, modality, ts, value), a stream or a table.

    Both sides are means of the same event-time window ``w`` (start, end), the modality that is first by name on
    the left; pair_key is ``a__b``. A stream waits ``late`` for late samples: then an epoch is final,
    meets those of the dyad's other modalities once, and all leave the state. Samples that come later
    are dropped. An epoch that one of the two modalities lacks, or has only nulls in, gives no row. Null dyads,
    modalities and times are in no pair. Samples are added up before they are shuffled, and epochs
    spread by their window, so a dyad with most of the samples is no single key.
    """
    rows = signals.where("dyad_id is not null and modality is not null and ts is not null and value is not null")
    rows = rows.select("dyad_id", "modality", "ts", F.col("value").cast("double").alias("value"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    means = rows.groupBy("dyad_id", "modality", F.window("ts", length).alias("w")).agg(F.avg("value").alias("v"))
    # An epoch's modalities meet in a second aggregation: a stream joined with itself gave no rows here where
    # the dyad was a computed column. The list is as long as the dyad has modalities.
    met = means.groupBy("dyad_id", "w").agg(F.array_sort(F.collect_list(F.struct("modality", "v"))).alias("all"))
    two = F.flatten(F.transform("all", lambda a, i: F.transform(F.slice("all", i + 2, F.size("all")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    sides = met.select("dyad_id", "w", F.explode(two).alias("p"))
    return sides.select(
        "dyad_id", F.concat_ws("__", "p.a.modality", "p.b.modality").alias("pair_key"), "w", F.col("p.a.v").alias("x"), F.col("p.b.v").alias("y")
    )


class _Sliding(StatefulProcessor):
    """The last ``window`` - 1 epochs of a pair, and a timer for its end."""

    def __init__(self, window: int, patience: float) -> None:
        self.window, self.patience = window, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "first bigint, last bigint, x double, y double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[["first", "last", "x", "y"]].sort_values("first")
        held = pd.DataFrame([tuple(r) for r in self.held.get()], columns=new.columns)
        if len(held):
            new = new[new["first"] > held["first"].iloc[-1]]
        if not len(new):
            return
        known = pd.concat([held, new]) if len(held) else new
        first, last = known["first"].to_numpy("int64"), known["last"].to_numpy("int64")
        # an epoch opens a run where the one before did not end at its start: no window crosses that
        opens = np.r_[True, first[1:] != last[:-1]]
        began = np.maximum.accumulate(np.where(opens, np.arange(len(first)), 0))
        ends = np.arange(self.window - 1, len(first))
        ends = ends[began[ends] <= ends - self.window + 1]
        out = pd.DataFrame({"epoch_start": first[ends - self.window + 1], "r": self._r(known, ends)})
        kept = known.iloc[max(int(began[-1]), len(known) - max(self.window - 1, 1)) :]
        self.held.put([(int(f), int(t), float(x), float(y)) for f, t, x, y in kept.itertuples(index=False)])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(int(last[-1] / 1000 + self.patience * 1000))
        yield self._rows(key, out, False)

    def _r(self, known: pd.DataFrame, ends: np.ndarray) -> np.ndarray:
        if not len(ends):
            return np.empty(0)
        cut = ends[:, None] + np.arange(-self.window + 1, 1)
        x, y = (known[c].to_numpy(float)[cut] for c in ("x", "y"))
        x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
        spread = np.sqrt((x * x).mean(1) * (y * y).mean(1))
        flat = spread <= 1e-10
        return np.where(flat, np.nan, np.clip((x * y).mean(1) / np.where(flat, 1.0, spread), -1, 1))

    def _rows(self, key: tuple, out: pd.DataFrame, ended: bool) -> pd.DataFrame:
        at = pd.to_datetime(out["epoch_start"], unit="us", utc=True)
        return pd.DataFrame({"dyad_id": key[0], "pair_key": key[1], "epoch_start": at, "r": out["r"].to_numpy(), "ended": ended}).astype({"dyad_id": object, "pair_key": object, "ended": bool})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.held.get()]
        self.held.clear()
        if held:
            yield self._rows(key, pd.DataFrame({"epoch_start": [held[-1][0]], "r": [np.nan]}), True)


def correlations(paired: DataFrame, window: int = 10, patience: float = 3600.0) -> DataFrame:
    """(dyad_id, pair_key, epoch_start, r, ended) of the stream that ``pairs`` gives.

    A row for each ``window`` epochs of a pair that follow one another without a missing one, under the
    start of the first, when the last is final; r is null where one side doesn't vary. Of a pair the
    state holds its last ``window`` - 1 epochs, or fewer after a gap. ``patience`` seconds of
    event time after a pair's last epoch its state goes, with one row ``ended`` that bears that epoch's
    start and no r; a pair that is heard again begins anew. Samples of a pair that come in one trigger are
    sorted in one task, which the trigger's size bounds; epochs not after the last held one are dropped.

    The session has to set ``STORE`` before the stream starts.
    """
    flat = paired.select("dyad_id", "pair_key", "w", F.unix_micros("w.start").alias("first"), F.unix_micros("w.end").alias("last"), "x", "y")
    out = flat.groupBy("dyad_id", "pair_key").transformWithStateInPandas(_Sliding(window, patience), OUT, "Append", "EventTime")
    return out.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def all_of(stream: DataFrame, folder: str) -> DataFrame:
    """All rows that a stream gives for what is there now, written to ``folder``, a new one in a shared store.

    The stream's place and state are kept there too, so a run that was cut short goes on where it was.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        run = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
        run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
