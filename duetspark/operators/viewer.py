"""Aggregates that a viewer of results shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SERIES, ratio
from .context import within


def epoch_mean(aligned: DataFrame, samples: int) -> DataFrame:
    """(series, epoch, value): means of ``samples`` samples in a row."""
    return aligned.groupBy(*SERIES, F.floor(F.col("idx") / samples).alias("epoch")).agg(F.avg("value").alias("value"))


def epoch_direction(windows: DataFrame, per_epoch: int) -> DataFrame:
    """(dyad_id, pair_key, epoch, mean_signed, mean_lag, fraction_negative, direction) of windows (pair, win, ccf, lag)."""
    by = windows.groupBy("dyad_id", "pair_key", F.floor(F.col("win") / per_epoch).alias("epoch")).agg(
        F.avg("ccf").alias("mean_signed"), F.avg("lag").alias("mean_lag"), F.avg((F.col("ccf") < 0).cast("int")).alias("fraction_negative"))
    return by.withColumn("direction", F.when(F.col("mean_lag") < 0, "a_leads").when(F.col("mean_lag") > 0, "b_leads").otherwise("synchronous"))


def pivot_timeline(epochs: DataFrame, modalities: list[str], places: int | None = None) -> DataFrame:
    """One row (dyad_id, epoch) with a column for each modality, NULL where it has none.

    The modalities are given, so the pivot needs no pass over the data to find them.
    """
    value = F.avg("value")
    wide = epochs.groupBy("dyad_id", "epoch").pivot("modality", modalities).agg(F.round(value, places) if places is not None else value)
    return wide


def modality_summary(epochs: DataFrame) -> DataFrame:
    return epochs.groupBy("dyad_id", "modality").agg(F.max("value").alias("max"), F.avg("value").alias("mean"))


def segment_stats(epochs: DataFrame, segments: DataFrame, places: int = 3) -> DataFrame:
    """(dyad_id, segment, modality, mean, max, min) of epochs from start_epoch to before end_epoch."""
    inside = within(epochs.where("value is not null"), segments, F.col("epoch"), F.col("start_epoch"), F.col("end_epoch"), ["dyad_id"])
    return inside.groupBy("dyad_id", "segment", "modality").agg(*[F.round(f("value"), places).alias(n) for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))])


def largest_gap(segments: DataFrame, total: int) -> DataFrame:
    """(dyad_id, gap_start, gap_end): the widest room between a dyad's segments, the first of equals.

    Room before the first counts if that starts after epoch 1; room after the last goes to ``total``.
    """
    order = Window.partitionBy("dyad_id").orderBy("start_epoch", "end_epoch")
    after = segments.select("dyad_id", F.col("end_epoch").alias("a"), F.coalesce(F.lead("start_epoch").over(order), F.lit(total)).alias("b"))
    head = segments.groupBy("dyad_id").agg(F.min("start_epoch").alias("b")).where("b > 1").select("dyad_id", F.lit(0).alias("a"), "b")
    return after.unionByName(head).where("b > a").groupBy("dyad_id").agg(
        F.min_by("a", F.struct(F.col("a") - F.col("b"), "a")).alias("gap_start"), F.min_by("b", F.struct(F.col("a") - F.col("b"), "a")).alias("gap_end"))


def merge_streams(streams: DataFrame) -> DataFrame:
    """(dyad_id, modality, epoch, value) of (dyad_id, modality, stream_ord, epoch, value): streams of a
    modality averaged one after the other, over the epochs that all have.

    Later streams weigh more: after n of them the last has a half, the one before a quarter.
    """
    n = streams.groupBy("dyad_id", "modality").agg(F.countDistinct("stream_ord").alias("n"))
    by = streams.groupBy("dyad_id", "modality", "epoch").agg(F.array_sort(F.collect_list(F.struct("stream_ord", "value"))).alias("s"))
    whole = by.join(n, ["dyad_id", "modality"]).where("size(s) = n")  # as many values as streams
    rest = F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0)))
    return whole.select("dyad_id", "modality", "epoch", F.aggregate(rest, F.col("s")[0]["value"], lambda a, x: (a + x["value"]) / 2).alias("value"))


def anchor_offsets(rows: DataFrame) -> DataFrame:
    """(dyad_id, stream_id, offset): what moves each stream's first time (of 100 rows) to the dyad's first."""
    first = rows.where("row < 100").groupBy("dyad_id", "stream_id").agg(F.min("t_ms").alias("lo"))
    all_ = first.groupBy("dyad_id").agg(F.min("lo").alias("least"))
    return first.join(all_, "dyad_id").select("dyad_id", "stream_id", (F.col("least") - F.col("lo")).alias("offset"))


def stream_groups(datasets: DataFrame, streams: DataFrame) -> DataFrame:
    """(modality, datasets, streams) of complete datasets."""
    done = datasets.where("status = 'complete'").select(F.col("id").alias("dataset_id"))
    return streams.join(done, "dataset_id").groupBy("modality").agg(F.countDistinct("dataset_id").alias("datasets"), F.count("*").alias("streams"))


def onsets(epochs: DataFrame, sigma: float = 1.0) -> DataFrame:
    """(dyad_id, modality, onset_epoch): the first epoch ``sigma`` deviations above the modality's mean."""
    by = epochs.groupBy("dyad_id", "modality").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    hit = F.when(F.col("value") >= F.col("m") + sigma * F.col("s"), F.col("epoch"))
    return epochs.join(by, ["dyad_id", "modality"]).groupBy("dyad_id", "modality").agg(F.min(hit).alias("onset_epoch"))


def cascade_chain(found: DataFrame) -> DataFrame:
    """(dyad_id, modality, onset_epoch, position, delay): onsets in order and the time to the next."""
    order = Window.partitionBy("dyad_id").orderBy("onset_epoch", "modality")
    known = found.where("onset_epoch is not null")
    return known.select("dyad_id", "modality", "onset_epoch", F.row_number().over(order).alias("position"), (F.lead("onset_epoch").over(order) - F.col("onset_epoch")).alias("delay"))


def onset_stability(epochs: DataFrame, sigmas: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0, 1.25, 1.5)) -> DataFrame:
    """(dyad_id, modality, onsets, spread): onsets at several thresholds and how far they lie apart."""
    by = epochs.groupBy("dyad_id", "modality").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    both = epochs.join(by, ["dyad_id", "modality"])
    hits = [F.min(F.when(F.col("value") >= F.col("m") + k * F.col("s"), F.col("epoch"))).alias(f"o{i}") for i, k in enumerate(sigmas)]
    cols = [F.col(f"o{i}") for i in range(len(sigmas))]
    return both.groupBy("dyad_id", "modality").agg(*hits).select("dyad_id", "modality", F.array(*cols).alias("onsets"), (F.greatest(*cols) - F.least(*cols)).alias("spread"))


def top_leads(peaks: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` pairs with the largest correlation at their peak: a top-k report."""
    return peaks.orderBy(F.desc("ccf"), "dyad_id", "pair_key").limit(k)


def causes(rows: DataFrame) -> DataFrame:
    """Granger rows that say one causes the other, by falling F."""
    return rows.where("direction = 'causes'").orderBy(F.desc("f_stat"))


def weighted_composite(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(dyad_id, epoch, composite): weighted mean of the modalities' scores that an epoch has."""
    w = F.when(F.col("value").isNotNull(), F.col("weight"))
    return scores.join(weights, "modality").groupBy("dyad_id", "epoch").agg(ratio(F.sum(F.col("weight") * F.col("value")), F.sum(w)).alias("composite"))


def convergence(pairs: DataFrame, scale: float) -> DataFrame:
    """``pairs`` (.., x, y) with convergence: 1 less their distance over the scale."""
    return pairs.withColumn("convergence", 1 - F.abs(F.col("x") - F.col("y")) / scale)


def step_hold(sparse: DataFrame, epochs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, epoch, value): each value held until the next one."""
    from .neighbours import with_neighbours

    both = epochs.select(*keys, "epoch").join(sparse.select(*keys, "epoch", "value"), [*keys, "epoch"], "left")
    near = with_neighbours(both, keys, F.col("epoch"), F.col("value").isNotNull(), F.col("value"), F.floor(F.col("epoch") / 65_536))
    return near.select(*keys, "epoch", F.col("prev").alias("value"))


def category_counts(references: DataFrame) -> DataFrame:
    return references.groupBy("category").agg(F.count("*").alias("n"))


def import_rows(cells: DataFrame, factor: float = 1.0, offset: float = 0.0) -> DataFrame:
    """(row, t_ms, p1, p2) of text cells (row, t, a, b): scaled time, 0 for what is no number."""
    n = lambda c: F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(0.0))
    return cells.select("row", (n("t") * factor + offset).alias("t_ms"), n("a").alias("p1"), n("b").alias("p2"))
