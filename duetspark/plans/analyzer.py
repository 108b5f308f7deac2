"""The whole analysis: signals and contexts of any number of dyads to tables, and one dyad's report."""

from __future__ import annotations

import json
import math
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, cascade, clean, features, normalize, predict, wcc
from ..operators.reuse import reuse
from ..schema import FEATURES, PAIR

SCHEMA_VERSION = "0.2.0"


@dataclass
class Parameters:
    window_size: int = 10
    surrogate_n: int = 500
    max_lag_sec: float = 30.0
    alpha: float = 0.05
    seed: int = 42
    onset_threshold: float = 0.2
    prediction_window: int = 10
    prediction_horizon: int = 5
    prediction_gap: int = 5
    hz: float = 1.0
    missing: str | None = None
    max_gap_sec: float | None = None
    pair_scope: str = "all"
    order: list[str] | None = None


@dataclass
class Results:
    """Tables keyed by dyad_id; ``report`` collects one dyad's, which are small."""

    parameters: Parameters
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def report(self, dyad_id: str) -> dict:
        rows = lambda name: [r.asDict(True) for r in self.tables[name].where(F.col("dyad_id") == dyad_id).collect()] if name in self.tables else []
        ten = lambda r: {f: r[f] for f in FEATURES}
        by_context: dict = {}
        for r in rows("segments"):
            by_context.setdefault(r["label"], {})[r["pair_key"]] = ten(r)
        folds: dict = {}
        for r in rows("prediction_folds"):
            folds.setdefault(r["pair_key"], []).append({k: r[k] for k in ("fold_id", "dynamic_auc", "baseline_auc", "delta_auc")})
        side = {r["pair_key"]: (r["mod_a"], r["mod_b"]) for r in rows("sides")}
        keep = ("mean_dynamic_auc", "mean_baseline_auc", "mean_delta_auc", "warning")
        return clean_json({
            "schema_version": SCHEMA_VERSION,
            "dyad_id": dyad_id,
            "dynamic_features": {r["pair_key"]: ten(r) for r in rows("features")},
            "dynamic_features_segmented": by_context,
            "cascade_graph": {
                "nodes": sorted(r["node"] for r in rows("nodes")),
                "edges": [{"from": r["source"], "to": r["target"], **{k: r[k] for k in ("lag_sec", "ccf_value", "p_value", "is_significant", "polarity")}} for r in rows("edges")],
            },
            "cascade_metrics": {r["modality"]: {k: r[k] for k in ("in_degree", "out_degree", "driver_score", "is_hub", "is_follower")} for r in rows("metrics")},
            "prediction": {
                r["pair_key"]: {"modality_a": side[r["pair_key"]][0], "modality_b": side[r["pair_key"]][1], "mode": "intra", **{k: r[k] for k in keep}, "feature_importance": r["importance"], "folds": folds[r["pair_key"]]}
                for r in rows("prediction") if r["n_folds"]
            },
            "cross_modal_prediction": {f"{r['source']} -> {r['target']}": {**{k: r[k] for k in keep}, "mean_ar_baseline_auc": r["mean_ar_baseline_auc"], "feature_importance": r["importance"]} for r in rows("cross_modal") if r["n_folds"]},
            "score_view": [{k: r[k] for k in ("start_sec", "end_sec", "label", "score", "mean_sync")} for r in sorted(rows("score_view"), key=lambda r: r["start_sec"])],
            "diagnostics": [{k: v for k, v in r.items() if k != "dyad_id"} for r in rows("diagnostics")],
            "parameters": {k: v for k, v in asdict(self.parameters).items() if k not in ("missing", "max_gap_sec", "pair_scope", "order")},
        })

    def export(self, dyad_id: str, path: str) -> None:
        """One dyad's report as an indented JSON file for a viewer."""
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.report(dyad_id), f, indent=2, ensure_ascii=False)

    def write(self, folder: str) -> None:
        """Every table as Parquet below a folder: the form for many dyads."""
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def clean_json(x):
    """NaN and infinities as null, all the way down."""
    if isinstance(x, dict):
        return {k: clean_json(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [clean_json(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def load_report(path: str) -> dict:
    """A report with every part present; older ones lack some."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    parts = {"dynamic_features": {}, "dynamic_features_segmented": {}, "cascade_graph": {"nodes": [], "edges": []}, "cascade_metrics": {}, "prediction": {}, "cross_modal_prediction": {}, "score_view": [], "diagnostics": [], "parameters": {}}
    return {"schema_version": SCHEMA_VERSION, "dyad_id": "", **parts, **found}


def prepare(signals: DataFrame, p: Parameters, method: str = "linear") -> DataFrame:
    """Signals aligned at the rate and normalised; clocks that don't go together raise."""
    wrong = align.clock_report(signals).where("level = 'error'").limit(1).collect()
    if wrong:
        raise ValueError(f"dyad {wrong[0]['dyad_id']}: {wrong[0]['message']}")
    aligned = align.align(signals, p.hz, method)
    if p.missing:
        aligned = clean.handle_missing(aligned, p.missing, p.max_gap_sec, p.hz)
    return normalize.zscore(aligned)


def analyse(aligned: DataFrame, contexts: DataFrame | None = None, parameters: Parameters | None = None, prediction: bool = True) -> Results:
    """All stages over aligned, normalised series: features overall and by context, lead and lag with
    surrogates, prediction within and across pairs, and mean synchrony by context."""
    p = parameters or Parameters()
    if "idx" not in aligned.columns:
        raise ValueError("series must be aligned first")
    paired = reuse(wcc.pairs(aligned, p.order))
    series = reuse(wcc.wcc(paired, p.window_size))
    options = {"hz": p.hz, "onset": p.onset_threshold}
    out = Results(p)
    t = out.tables
    t["sides"] = paired.select(*PAIR, "mod_a", "mod_b").distinct()
    t["wcc"] = series
    t["features"] = features.features(series, **options)
    lead = cascade.analyse(paired, p.max_lag_sec, p.hz, p.surrogate_n, p.alpha, p.seed, pair_scope=p.pair_scope, order=p.order)
    t |= {k: lead[k] for k in ("results", "ccf", "edges", "metrics", "nodes")}
    notes = lead["diagnostics"].withColumn("label", F.lit(None).cast("string"))
    if contexts is not None:
        t["segments"] = features.per_context(paired, contexts, p.window_size, **options)
        _, short = wcc.segments(paired, contexts, p.window_size)
        notes = notes.unionByName(short, allowMissingColumns=True)
        t["score_view"] = features.score_view(series, aligned, contexts)
    if prediction:
        window = max(p.prediction_window, 30)
        t["prediction_folds"], t["prediction"] = predict.rolling_origin_cv(series, window, p.hz, folds=5, gap=max(p.prediction_gap, window // 2))
        t["cross_modal_folds"], t["cross_modal"] = predict.cross_modal(series, window, p.hz, folds=3, gap=max(p.prediction_gap, window // 2))
        failed = t["prediction"].where("warning is not null").select(*PAIR, F.col("warning").alias("type"), F.lit("prediction").alias("message"))
        notes = notes.unionByName(failed, allowMissingColumns=True)
    t["diagnostics"] = notes
    return out


def run(spark: SparkSession, signals: DataFrame, contexts: DataFrame | None = None, parameters: Parameters | None = None) -> Results:
    p = parameters or Parameters()
    return analyse(prepare(signals, p), contexts, p)
