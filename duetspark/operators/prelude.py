"""Does what a dyad's modalities do now tell how synchronous it is later? Left-out predictions and their report.

These are our own definitions. The later state is high if the mean over modalities, ``ahead`` epochs
on, is at least the dyad's mean of such means and ``sigma`` deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .predict import auc, l1_logistic

#: Left-out rows whose models a task fits.
BLOCK = 16


def examples(epochs: DataFrame, ahead: int, sigma: float = 0.5, change: bool = True) -> DataFrame:
    """(dyad_id, epoch, label, composite, x): of each epoch of which all is known, whether the state
    ``ahead`` epochs later is high, the mean over modalities now, and the features: the modalities' values
    in order of name and, with ``change``, what they changed by since the epoch before.

    An epoch is known if every modality of the dyad has a value in it.
    """
    known = epochs.where("value is not null").select("dyad_id", "modality", "epoch", "value")
    many = known.groupBy("dyad_id").agg(F.countDistinct("modality").alias("m"))
    # one value a modality and epoch; the mean is taken in order of name, so equal rows give equal means
    by = known.groupBy("dyad_id", "epoch").agg(F.array_sort(F.collect_list(F.struct("modality", "value"))).alias("s")).join(many, "dyad_id").where("size(s) = m")
    now = by.select("dyad_id", "epoch", F.col("s.value").alias("x"), (F.aggregate("s", F.lit(0.0), lambda a, s: a + s["value"]) / F.col("m")).alias("composite"))
    level = now.groupBy("dyad_id").agg((F.avg("composite") + sigma * F.stddev_pop("composite")).alias("level"))
    later = now.select("dyad_id", (F.col("epoch") - ahead).alias("epoch"), F.col("composite").alias("later")).join(level, "dyad_id")
    rows = now.join(later, ["dyad_id", "epoch"]).withColumn("label", (F.col("later") >= F.col("level")).cast("int"))
    if change:
        was = now.select("dyad_id", (F.col("epoch") + 1).alias("epoch"), F.col("x").alias("was"))
        rows = rows.join(was, ["dyad_id", "epoch"]).withColumn("x", F.concat("x", F.zip_with("x", "was", lambda a, b: a - b)))
    return rows.select("dyad_id", "epoch", "label", "composite", "x")


def left_out(rows: DataFrame) -> DataFrame:
    """(dyad_id, epoch, label, p, weights): for each of ``examples`` the chance that a model gives it which
    was fitted to all others of its dyad, and that model's weights.

    A dyad has as many models as examples. They are dealt by blocks of left-out rows; what each task holds
    is one dyad's examples, epochs and not samples. Where the others are of one class, so is the answer.
    """
    packed = rows.groupBy("dyad_id").agg(F.array_sort(F.collect_list(F.struct("epoch", "label", "x"))).alias("s"))
    blocks = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / BLOCK).cast("int")))).repartition("dyad_id", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for dyad, s, block in zip(pdf["dyad_id"], pdf["s"], pdf["block"], strict=True):
                x, y = np.array([r["x"] for r in s], float), np.array([r["label"] for r in s], int)
                for i in range(block * BLOCK, min((block + 1) * BLOCK, len(s))):
                    rest = np.arange(len(s)) != i
                    if len(set(y[rest])) < 2:
                        p, w = float(y[rest][0]) if rest.any() else 0.5, np.zeros(x.shape[1])
                    else:
                        fit = l1_logistic(x[rest], y[rest])
                        p, w = 1 / (1 + np.exp(-np.clip(x[i] @ fit[:-1] + fit[-1], -500, 500))), fit[:-1]
                    out.append((dyad, s[i]["epoch"], y[i], float(p), w.tolist()))
            yield pd.DataFrame(out, columns=["dyad_id", "epoch", "label", "p", "weights"])

    return blocks.mapInPandas(run, "dyad_id string, epoch bigint, label int, p double, weights array<double>")


def report(predictions: DataFrame, keys: list[str] | None = None, at: float = 0.5) -> DataFrame:
    """(keys, n, tp, fp, tn, fn, accuracy, f1, sensitivity, specificity, auc) of predictions (keys, label,
    p): p of ``at`` or more says 1. A share of nothing is NULL."""
    keys = keys or ["dyad_id"]
    says, is_ = F.col("p") >= at, F.col("label") == 1
    by = predictions.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(says & is_).alias("tp"), F.count_if(says & ~is_).alias("fp"), F.count_if(~says & ~is_).alias("tn"), F.count_if(~says & is_).alias("fn"))
    share = lambda a, b: a / F.nullif(b, F.lit(0))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return by.join(auc(predictions.select(*keys, "label", F.col("p").alias("score")), keys), keys).select(
        *keys, "n", "tp", "fp", "tn", "fn", ((tp + tn) / F.col("n")).alias("accuracy"), share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        share(tp, tp + fn).alias("sensitivity"), share(tn, tn + fp).alias("specificity"), "auc")


def importance(predictions: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(dyad_id, feature, weight): the mean weight of each feature over the dyad's models."""
    each = predictions.select("dyad_id", F.posexplode("weights").alias("k", "w")).groupBy("dyad_id", "k").agg(F.avg("w").alias("weight"))
    name = F.array(*map(F.lit, names))[F.col("k")] if names else F.concat(F.lit("x"), "k")
    return each.select("dyad_id", name.alias("feature"), "weight")
