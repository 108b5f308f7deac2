"""Published results, from the recipes of their inputs."""

import json
import math

import numpy as np
import pandas as pd
import pytest

from duetspark.cli import main
from duetspark.operators import align, cascade, features, normalize, wcc
from duetspark.operators.context import contexts
from duetspark.plans import analyzer
from duetspark.schema import FEATURES
from duetspark.sources import synthetic

# Features of the two committed runs, in the order of FEATURES.
NOISE = [1.0, 0.4074113316849146, 0.0, 0.13377790830311834, 0.5582449035796724, 8.633299361622353, 0.05766203553349709, 31.0, -0.12279874779374518, 2.1599463957679954]
DEMO = [5.0, 0.2941631659360004, 0.0, 0.15945832106618707, 0.7872876625180154, 8.373948926714304, 0.11745659493782491, 18.0, -0.04693796436310251, 2.2755280024721896]
TASK = [6.0, 0.2998431589204838, 0.05973637860274823, 0.1299423045528073, 0.7831015777899495, 8.427002808331878, 0.11738850186868278, 18.0, -0.09933341854265824, 2.25106606488838]
PRE = [5.0, 0.29416316593599895, 0.0, 0.17642671518524017, 0.7697083171638015, 7.528074748401252, 0.10638249860323146, 26.0, -0.02730524201670675, 2.2712129129572687]


def close(row, wanted, tol=1e-9):
    assert [math.isclose(row[f], w, abs_tol=tol) for f, w in zip(FEATURES, wanted, strict=True)] == [True] * 10, [row[f] for f in FEATURES]


@pytest.fixture(scope="module")
def demo(spark):
    s = synthetic.signals(spark, synthetic.ground_truth("behavior", "neural"), "d")
    z = normalize.zscore(align.align(s, 1.0)).persist()
    return z, wcc.pairs(z).persist()


def test_noise_pair(spark):
    np.random.seed(42)
    frames = [pd.DataFrame({"modality": m, "t": np.arange(100.0), "value": np.random.randn(100)}) for m in ("neural", "behavior")]
    s = synthetic.signals(spark, pd.concat(frames), "d")
    p = wcc.pairs(normalize.zscore(align.align(s, 1.0)), ["neural", "behavior"])
    rows = features.all_pairs(p).collect()
    assert [r["pair_key"] for r in rows] == ["neural_value__behavior_value"]
    close(rows[0], NOISE)


def test_demo_features_and_contexts(spark, demo):
    z, p = demo
    close(features.all_pairs(p).first(), DEMO)
    c = contexts(spark, [("d", 0, 150, "PreTask"), ("d", 150, 300, "Task")])
    got = {r["label"]: r for r in features.per_context(p, c).collect()}
    close(got["PreTask"], PRE)
    close(got["Task"], TASK)
    view = {r["label"]: r["mean_sync"] for r in features.score_view(wcc.wcc(p), z, c).collect()}
    assert view["PreTask"] == pytest.approx(0.0033188998499470187, abs=1e-10)
    assert view["Task"] == pytest.approx(-0.09933341854266477, abs=1e-10)


def test_demo_lead(spark, demo):
    got = cascade.analyse(demo[1], surrogates=20)
    r = got["results"].first()
    assert (r["lag"], r["lag_sec"], r["direction"]) == (-12, 12.0, "a_leads")
    assert r["ccf"] == pytest.approx(0.4850960773017936, abs=1e-9)
    assert r["p_value"] >= 1 / 21
    e = got["edges"].collect()
    if r["p_value"] < 0.05:
        assert [(x["source"], x["target"], x["polarity"]) for x in e] == [("behavior", "neural", "positive")]


def test_ground_truth_is_found(spark):
    f = synthetic.ground_truth("behavior", "neural", noise=0.2)
    p = wcc.pairs(normalize.zscore(align.align(synthetic.signals(spark, f, "d"), 1.0)))
    r = cascade.analyse(p, 25.0, surrogates=200)["results"].first()
    assert 7 <= r["lag_sec"] <= 17 and r["direction"] == "a_leads" and r["p_value"] < 0.05


def test_report_of_demo_command(spark, tmp_path):
    out = tmp_path / "deep" / "demo.json"
    assert main(["demo", "-o", str(out), "--surrogates", "20"]) == 0
    r = json.loads(out.read_text())
    assert r["schema_version"] == "0.2.0" and set(r["dynamic_features_segmented"]) == {"PreTask", "Task"}
    assert "NaN" not in out.read_text()
    assert analyzer.load_report(str(out))["parameters"]["surrogate_n"] == 20
    assert main(["analyze", "-i", "a.csv,b.csv", "-n", "a"]) == 1
