"""Episodes: runs of epochs above a threshold, how they hold, break and return, and where modalities meet in them.

These are our own definitions. A modality is high where its value is at least its mean and ``sigma``
deviations. A run is a maximal row of epochs in one state, a missing value counts as low. Each epoch
learns the nearest epoch of the other state on both sides, chunk by chunk, and these two name its run:
no task holds a whole series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import entropy
from .neighbours import with_neighbours

KEYS = ["dyad_id", "modality"]
CHUNK = 16_384


def states(epochs: DataFrame, sigma: float = 0.5) -> DataFrame:
    """(dyad_id, modality, epoch, value, high)."""
    level = epochs.groupBy(*KEYS).agg((F.avg("value") + sigma * F.stddev_pop("value")).alias("__level"))
    return epochs.select(*KEYS, "epoch", "value").join(level, KEYS).select(*KEYS, "epoch", "value", F.coalesce(F.col("value") >= F.col("__level"), F.lit(False)).alias("high"))


def runs(marked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(dyad_id, modality, high, first, last, epochs, before, after) of ``states``: each run, and the
    nearest epochs of the other state, NULL at the series' ends."""
    where = F.floor(F.col("epoch") / chunk)
    at_low = with_neighbours(marked, KEYS, F.col("epoch"), ~F.col("high"), F.col("epoch"), where).withColumnsRenamed({"prev": "pl", "next": "nl"})
    both = with_neighbours(at_low, KEYS, F.col("epoch"), F.col("high"), F.col("epoch"), where)
    before, after = F.when(F.col("high"), F.col("pl")).otherwise(F.col("prev")), F.when(F.col("high"), F.col("nl")).otherwise(F.col("next"))
    return both.groupBy(*KEYS, "high", before.alias("before"), after.alias("after")).agg(F.min("epoch").alias("first"), F.max("epoch").alias("last"), F.count("*").alias("epochs"))


def dynamics(epochs: DataFrame, sigma: float = 0.5, chunk: int = CHUNK) -> DataFrame:
    """A row a modality: onset (its first high epoch), build_up (rise from its first epoch to its peak, an
    epoch), peak, maintenance (epochs of its longest high run), breakdowns (high runs that end before
    the recording does), recovery (mean epochs of the low runs between two high ones) and entropy."""
    marked = states(epochs, sigma)
    value, at = F.col("value"), F.when(F.col("value").isNotNull(), F.col("epoch"))
    top = F.max_by("epoch", F.when(value.isNotNull(), F.struct(value, -F.col("epoch"))))
    rise = marked.groupBy(*KEYS).agg(
        F.min(F.when(F.col("high"), F.col("epoch"))).alias("onset"), F.max(value).alias("peak"), F.min_by(value, at).alias("v"), F.min(at).alias("a"), top.alias("b"))
    held = runs(marked, chunk).groupBy(*KEYS).agg(
        F.coalesce(F.max(F.when(F.col("high"), F.col("epochs"))), F.lit(0)).alias("maintenance"), F.count_if(F.col("high") & F.col("after").isNotNull()).alias("breakdowns"),
        F.avg(F.when(~F.col("high") & F.col("before").isNotNull() & F.col("after").isNotNull(), F.col("epochs"))).alias("recovery"))
    spread = entropy(marked.select(*KEYS, F.col("epoch").alias("idx"), value.alias("r")), KEYS).select(*KEYS, F.col("synchrony_entropy").alias("entropy"))
    up = (F.col("peak") - F.col("v")) / F.nullif(F.col("b") - F.col("a"), F.lit(0))
    return rise.join(held, KEYS).join(spread, KEYS, "left").select(*KEYS, "onset", up.alias("build_up"), "peak", "maintenance", "breakdowns", "recovery", "entropy")


def chords(epochs: DataFrame, sigma: float = 0.5) -> DataFrame:
    """A row a dyad: leader (the modality that is high first, of several the first by name), delay (epochs
    from its onset to the last modality's), coherence (epochs with two or more modalities high) and
    full_chord (share of epochs in which all of the dyad's modalities are high)."""
    marked = states(epochs, sigma)
    onsets = marked.where("high").groupBy(*KEYS).agg(F.min("epoch").alias("onset")).groupBy("dyad_id").agg(
        F.min(F.struct("onset", "modality"))["modality"].alias("leader"), (F.max("onset") - F.min("onset")).alias("delay"))
    many = marked.groupBy("dyad_id").agg(F.countDistinct("modality").alias("m"))
    by = marked.groupBy("dyad_id", "epoch").agg(F.count_if("high").alias("h")).join(many, "dyad_id")
    met = by.groupBy("dyad_id").agg(F.count_if(F.col("h") >= 2).alias("coherence"), F.avg((F.col("h") == F.col("m")).cast("int")).alias("full_chord"))
    return met.join(onsets, "dyad_id", "left").select("dyad_id", "leader", "delay", "coherence", "full_chord")
