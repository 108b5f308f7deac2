"""Tables of the library. Missing values are SQL NULL; NaN and infinities become NULL at ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Long form of any recording, before and after alignment.
SIGNALS = "dyad_id string, modality string, feature string, t double, value double"
ALIGNED = "dyad_id string, modality string, feature string, idx bigint, t double, value double"
CONTEXTS = "dyad_id string, ctx_id bigint, start_sec double, end_sec double, label string, score double"
SERIES = ["dyad_id", "modality", "feature"]
PAIR = ["dyad_id", "pair_key"]

#: The ten features of a correlation series, in their fixed order.
FEATURES = [
    "onset_latency", "onset_amplitude", "build_up_slope", "build_up_rate", "peak_amplitude",
    "peak_duration", "breakdown_rate", "recovery_time", "mean_synchrony", "synchrony_entropy",
]


def present(c: Column) -> Column:
    """``c`` with NaN and infinities as NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 (plain division raises in ANSI mode)."""
    return F.when(b != 0, a / b)


def as_signals(wide: DataFrame, modality: str, dyad_id: str | None = None, time_col: str = "time") -> DataFrame:
    """A wide frame (time and numeric features) in long form; every other numeric column is a feature.

    Rows need a numeric time; of rows with equal times the first in file order stays (see
    ``ingest.first_per_time``). ``dyad_id`` names the dyad unless the frame has the column.
    """
    kinds = dict(wide.dtypes)
    if time_col not in kinds:
        raise ValueError(f"no time column {time_col!r} in modality {modality!r}")
    numeric = ("int", "bigint", "smallint", "tinyint", "double", "float")
    if kinds[time_col] not in numeric and not kinds[time_col].startswith("decimal"):
        raise ValueError(f"time column {time_col!r} of modality {modality!r} is not numeric")
    names = [c for c, k in kinds.items() if c not in (time_col, "dyad_id") and (k in numeric or k.startswith("decimal"))]
    dyad = F.col("dyad_id").cast("string") if "dyad_id" in kinds else F.lit(dyad_id or "dyad_01")
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    rows = wide.select(dyad.alias("dyad_id"), F.lit(modality).alias("modality"), F.col(time_col).cast("double").alias("t"), F.explode(cells).alias("c"))
    return rows.select("dyad_id", "modality", F.col("c.feature").alias("feature"), "t", present(F.col("c.value")).alias("value"))
