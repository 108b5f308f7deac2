"""Epochs and sliding correlation of live signals: an extension of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def epochs(signals: DataFrame, length: str = "1 minute", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(modality[, dyad_id], epoch_start, n, value) means of event-time windows, of a stream or a table.

    ``slide`` makes windows hop; ``late`` is how long a stream waits for late samples, after which
    an epoch is final and its state goes.
    """
    rows = signals.withWatermark("ts", late) if late and signals.isStreaming else signals
    keys = [c for c in ("dyad_id", "modality") if c in signals.columns]
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    by = rows.groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    return by.select(*keys, F.col("w.start").alias("epoch_start"), "n", "value")


def live_wcc(pairs: DataFrame, window: int = 10) -> DataFrame:
    """(dyad_id, pair_key, idx, r) of a stream of paired samples (dyad_id, pair_key, idx, x, y).

    The state of a pair is its last ``window`` - 1 samples, whatever the stream's length; a window is
    emitted, under its first sample's number, when its last sample has come. Samples of a pair
    come in order of idx within the trigger's rows; older ones than the state holds are dropped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists and state.get[0] else []
        new = pd.concat(list(parts)).sort_values("idx")
        rows = held + [(int(i), float(x), float(y)) for i, x, y in zip(new["idx"], new["x"], new["y"], strict=True) if not held or i > held[-1][0]]
        out = []
        for k in range(len(rows) - window + 1):
            _, x, y = (np.array(c) for c in zip(*rows[k : k + window], strict=True))
            spread = x.std() * y.std()
            r = float(np.clip(((x - x.mean()) * (y - y.mean())).mean() / spread, -1, 1)) if spread > 1e-10 else None
            out.append((*key, rows[k][0], r))
        last = rows[-(window - 1) :]
        state.update(tuple([list(c) for c in zip(*last, strict=True)]))
        yield pd.DataFrame(out, columns=["dyad_id", "pair_key", "idx", "r"])

    return pairs.groupBy("dyad_id", "pair_key").applyInPandasWithState(
        step, "dyad_id string, pair_key string, idx bigint, r double", "idx array<bigint>, x array<double>, y array<double>", "append", GroupStateTimeout.NoTimeout
    )
