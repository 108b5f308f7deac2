"""Operators that deal a series in chunks against plain loops over the whole of it."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from duetspark.operators import context, episodes, features, peaks, predict, prelude, wcc


def peaks_by_loops(r, height, distance, prominence):
    """[(place, prominence, width, rise, fall)] by scanning the whole series for each peak."""
    v = np.where(np.isnan(r), np.nanmean(r), r)
    n, tops = len(v), []
    i = 1
    while i < n:
        j = i
        while j + 1 < n and v[j + 1] == v[i]:
            j += 1
        if v[i] > v[i - 1] and j + 1 < n and v[j + 1] < v[i] and v[i] >= height:
            tops.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(tops, key=lambda p: (v[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        lo, hi = p, p
        while lo >= 0 and v[lo] <= v[p]:
            lo -= 1
        while hi < n and v[hi] <= v[p]:
            hi += 1
        tall = v[p] - max(v[lo + 1 : p + 1].min(), v[p:hi].min())
        if tall < prominence:
            continue
        level, a, b = v[p] - tall / 2, p, p
        while v[a] > level:
            a -= 1
        while v[b] > level:
            b += 1
        x = a + ((level - v[a]) / (v[a + 1] - v[a]) if v[a] < level else 0)
        y = b - ((level - v[b]) / (v[b - 1] - v[b]) if v[b] < level else 0)
        if y - x >= 1:
            out.append((p, tall, y - x))
    full = []
    for k, (p, tall, wide) in enumerate(out):
        if k:
            q = out[k - 1][0]
            m = q + int(v[q : p + 1].argmin())
            rise = (v[p] - v[m]) / (p - m)
        else:
            rise = (v[p] - v[:p].mean()) / p
        if k + 1 < len(out):
            m = p + int(v[p : out[k + 1][0] + 1].argmin())
            fall = (v[p] - v[m]) / (m - p)
        else:
            fall = (v[p] - v[p:].mean()) / (n - 1 - p)
        full.append((p, tall, wide, rise, fall))
    return full


def walks():
    rng = np.random.default_rng(6)
    noise = rng.standard_normal(700)
    steps = np.repeat(rng.integers(-3, 4, 120), rng.integers(1, 40, 120)).astype(float)  # plateaus over several chunks
    holes = np.cumsum(rng.standard_normal(500))
    holes[rng.random(500) < 0.2] = np.nan
    stairs = np.ravel(np.column_stack([np.arange(300.0), np.arange(300.0) - 1.5]))  # each top is beside a higher one, to the end
    return {"noise": noise, "steps": steps, "holes": holes, "stairs": stairs, "down": stairs[::-1].copy(), "walk": np.cumsum(rng.standard_normal(900)), "flat": np.ones(200),
            "short": np.array([0, 1, 0, 2, 0.0]), "one": np.array([1.0]), "edge": np.concatenate([np.zeros(63), np.ones(2), np.zeros(64)]), "none": np.full(90, np.nan)}


def frame(spark, series):
    rows = [("d", k, i, None if np.isnan(x) else float(x)) for k, v in series.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "dyad_id string, pair_key string, idx bigint, r double").repartition(5)


@pytest.mark.parametrize(("chunk", "around", "distance", "height", "prominence"), [(64, 16, 5, 0.0, 0.5), (32, 40, 12, -9.0, 0.0), (4096, 64, 10, 0.2, 0.1)])
def test_peaks_of_chunks_are_those_of_the_whole(spark, monkeypatch, chunk, around, distance, height, prominence):
    monkeypatch.setattr(peaks, "AROUND", around)
    series = walks()
    got = {k: [] for k in series}
    for r in peaks.peaks(frame(spark, series), height=height, distance=distance, prominence=prominence, chunk=chunk).orderBy("peak_index").collect():
        got[r["pair_key"]].append((r["peak_index"], r["prominence"], r["width_samples"], r["build_up_rate"], r["breakdown_rate"]))
    for k, v in series.items():
        want = peaks_by_loops(v, height, distance, prominence) if (~np.isnan(v)).any() else []
        assert [p[0] for p in got[k]] == [p[0] for p in want], k
        assert np.allclose(np.array(got[k]), np.array(want), rtol=1e-9, atol=1e-12), k
    assert sum(map(len, got.values())) > 30


def test_features_and_their_aggregations(spark):
    series = {k: v for k, v in walks().items() if k in ("noise", "walk", "short", "flat", "holes")}
    for name, over in (("mean", np.mean), ("median", np.median), ("max", None)):
        got = {r["pair_key"]: r for r in features.features(frame(spark, series), onset=0.2, aggregation=name, chunk=128, max_missing=0.3).collect()}
        assert set(got) == set(series) and got["flat"]["mean_synchrony"] is None and got["short"]["peak_amplitude"] is not None
        for k in ("noise", "walk", "holes"):
            found = peaks_by_loops(series[k], 0.2, 10, 0.1)
            v = np.where(np.isnan(series[k]), np.nanmean(series[k]), series[k])
            top = int(np.argmax([v[p[0]] for p in found]))
            for c, field in ((2, "peak_duration"), (3, "build_up_rate"), (4, "breakdown_rate")):
                values = [p[c] for p in found]
                assert np.isclose(got[k][field], values[top] if over is None else over(values)), (name, k, field)
            assert np.isclose(got[k]["peak_amplitude"], max(v[p[0]] for p in found))


def test_a_million_samples(spark):
    n = 1_000_000
    wave = F.sin(F.col("id") / 37) + 0.3 * F.sin(F.col("id") / 5.3) + F.sin(F.col("id") / 100_003)
    s = spark.range(n).select(F.lit("d").alias("dyad_id"), F.lit("p").alias("pair_key"), F.col("id").alias("idx"), F.round(wave, 6).alias("r"))
    began = time.time()
    got = peaks.peaks(s, height=0.2).select("peak_index").orderBy("peak_index").toPandas()["peak_index"].to_numpy()
    took = time.time() - began
    assert 10_000 < len(got) < n / 10 and np.diff(got).min() >= 10
    assert took < 120  # a scan of the series for each peak would take hours


# ---- correlation over a lag table ----


def directed_by_loops(x, y, window, most, step, lag_step):
    lags = sorted({s * k for k in range(0, most + 1, lag_step) for s in (1, -1)}, key=lambda k: (abs(k), k))
    out = {}
    for i in range(0, len(x) - window + 1, step):
        best, count = (None, None), 0
        for lag in lags:
            if i - lag < 0 or i - lag + window > len(y):
                continue
            a, b = x[i : i + window], y[i - lag : i - lag + window]
            if np.isnan(a).any() or np.isnan(b).any() or a.std() * b.std() <= 1e-10:
                continue
            r = round(float(((a - a.mean()) * (b - b.mean())).mean() / (a.std() * b.std())), 9)
            count += 1
            if best[0] is None or abs(r) > abs(best[1]):
                best = (lag, r)
        out[i] = (*best, count)
    return out


@pytest.mark.parametrize(("window", "most", "step", "lag_step", "chunk"), [(10, 12, 1, 1, 50), (7, 9, 3, 4, 16), (30, 5, 2, 2, 1000), (4, 0, 1, 1, 8)])
def test_lag_table_as_by_loops(spark, window, most, step, lag_step, chunk):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.standard_normal(260)) + 50
    y = np.concatenate([x[6:], np.zeros(6)]) + 0.3 * rng.standard_normal(260)
    x[100:130], y[40:44], x[200] = x[100], np.nan, np.nan  # flat, holes
    rows = [("d", "p", i, None if np.isnan(a) else float(a), None if np.isnan(b) else float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "dyad_id string, pair_key string, idx bigint, x double, y double").repartition(3)
    got = {r["idx"]: (r["lag"], r["r"], r["lags"]) for r in wcc.wcc_directional(df, window, most, step, lag_step, chunk=chunk).collect()}
    want = directed_by_loops(x, y, window, most, step, lag_step)
    assert got.keys() == want.keys()
    assert [(i, got[i], want[i]) for i in want if got[i] != want[i] and not (got[i][0] == want[i][0] and got[i][2] == want[i][2] and abs(got[i][1] - want[i][1]) < 2e-9)] == []


def test_lag_correlations_of_windows_that_hardly_move():
    """Small deviations around values far from the series' mean count as precisely as any."""
    rng = np.random.default_rng(9)
    x, y = rng.standard_normal(300) + 40, rng.standard_normal(300) * 100
    for at in (30, 90, 151, 240):
        x[at : at + 25], y[at : at + 25] = 7 + 1e-4 * rng.standard_normal(25), -3 + 1e-3 * rng.standard_normal(25)
    lags = np.array([0, -1, 1, -2, 2])
    for window in (5, 7, 10):
        pad = np.full(2, np.nan)
        got = wcc._lag_correlations(x, np.concatenate([pad, y, pad]), window, lags)
        for k, lag in enumerate(lags):
            for i in range(len(x) - window + 1):
                if 0 <= i - lag <= len(x) - window:
                    a, b = x[i : i + window] - x[i : i + window].mean(), y[i - lag : i - lag + window] - y[i - lag : i - lag + window].mean()
                    assert abs(got[k, i] - a @ b / np.sqrt((a @ a) * (b @ b))) < 2e-9, (window, lag, i)


def test_lag_table_shuffles_no_more_for_more_lags(spark):
    df = spark.range(4000).select(F.lit("d").alias("dyad_id"), F.lit("p").alias("pair_key"), F.col("id").alias("idx"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    plan = lambda m: wcc.wcc_directional(df, 10, m, chunk=1000)._jdf.queryExecution().executedPlan().toString()
    assert plan(1).count("Exchange") == plan(40).count("Exchange") == 1


# ---- intervals ----


def test_points_in_ten_thousand_intervals(spark):
    rng = np.random.default_rng(8)
    start = np.round(rng.random(10_000) * 5_000 - 100, 3)
    length = np.where(rng.random(10_000) < 0.01, 4.0 ** rng.integers(0, 7, 10_000), np.round(rng.random(10_000) * 2, 3))  # powers of four among them; some empty
    rows = [("d", i, float(a), float(a + b), f"c{i}") for i, (a, b) in enumerate(zip(start, length, strict=True))]
    table = spark.createDataFrame(rows, "dyad_id string, ctx_id bigint, start_sec double, end_sec double, label string")
    times = sorted({*np.round(rng.random(1_500) * 5_200 - 150, 3).tolist(), *start[:200].tolist(), *(start + length)[:200].tolist()})
    points = spark.createDataFrame([("d", t, i) for i, t in enumerate(times)] + [("e", 1.0, -1)], "dyad_id string, t double, k int")
    got = {r["k"]: r["ctx_id"] for r in context.context_at(points, table).collect()}
    order = np.lexsort((np.arange(10_000), start))
    for k, t in enumerate(times):
        inside = order[(start[order] <= t) & (t < (start + length)[order])]
        assert got[k] == (int(inside[0]) if len(inside) else None), t
    assert got[-1] is None and len(got) == len(times) + 1
    assert context.within(points, table.limit(0), F.col("t"), F.col("start_sec"), F.col("end_sec"), ["dyad_id"]).count() == 0


# ---- episodes, left-out predictions, resamples ----


def epochs(spark, values):
    rows = [("d", m, i, None if v is None else float(v)) for m, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "dyad_id string, modality string, epoch bigint, value double")


def test_runs_over_chunks(spark):
    rng = np.random.default_rng(4)
    bits = np.repeat(rng.integers(0, 2, 60), rng.integers(1, 30, 60))
    marked = spark.createDataFrame([("d", "a", i, float(b), bool(b)) for i, b in enumerate(bits)], "dyad_id string, modality string, epoch bigint, value double, high boolean").repartition(4)
    edges = [0, *(np.flatnonzero(np.diff(bits)) + 1).tolist(), len(bits)]
    want = sorted((bool(bits[a]), a, b - 1, b - a, a - 1 if a else None, b if b < len(bits) else None) for a, b in zip(edges, edges[1:], strict=False))
    got = sorted((r["high"], r["first"], r["last"], r["epochs"], r["before"], r["after"]) for r in episodes.runs(marked, 16).collect())
    assert got == want


def test_dynamics_and_chords_by_hand(spark):
    e = epochs(spark, {"a": [0, 0, 9, 9, 0, 9, 9, 9, 0, 0], "b": [0, 0, 0, 9, 0, 0, 9, 9, 0, 9], "c": [5] * 4 + [None] + [5] * 5})
    d = {r["modality"]: r for r in episodes.dynamics(e, 0.5, 4).collect()}
    a, b, c = d["a"], d["b"], d["c"]
    assert (a["onset"], a["peak"], a["maintenance"], a["breakdowns"], a["recovery"], a["build_up"]) == (2, 9, 3, 2, 1.0, 4.5)
    assert (b["onset"], b["maintenance"], b["breakdowns"], b["recovery"]) == (3, 2, 2, 1.5)
    assert (c["onset"], c["maintenance"], c["breakdowns"], c["recovery"], c["build_up"], c["entropy"]) == (0, 5, 1, 1.0, None, 0.0)  # flat: at its own threshold but where it is missing
    got = episodes.chords(e).first()
    assert (got["leader"], got["delay"], got["coherence"], got["full_chord"]) == ("c", 3, 6, pytest.approx(0.3))


def test_left_out_models_are_those_without_the_row(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((40, 2))
    rows = prelude.examples(epochs(spark, {"a": x[:, 0], "b": x[:, 1]}), 1, 0.0)
    known = sorted(rows.collect(), key=lambda r: r["epoch"])
    assert [r["epoch"] for r in known] == list(range(1, 39))  # the first has no change, the last no later state
    m, mean = x.mean(1), x.mean(1).mean()
    assert [r["label"] for r in known] == [int(m[r["epoch"] + 1] >= mean) for r in known]
    assert np.allclose([r["x"] for r in known], [[*x[r["epoch"]], *(x[r["epoch"]] - x[r["epoch"] - 1])] for r in known])
    a, y = np.array([r["x"] for r in known]), np.array([r["label"] for r in known])
    said = prelude.left_out(rows)
    got = {r["epoch"]: r["p"] for r in said.collect()}
    for i, r in enumerate(known):
        w = predict.l1_logistic(np.delete(a, i, 0), np.delete(y, i))
        assert got[r["epoch"]] == pytest.approx(1 / (1 + np.exp(-(a[i] @ w[:-1] + w[-1]))), abs=1e-9)
    t = prelude.report(said).first()
    p = np.array([got[r["epoch"]] for r in known]) >= 0.5
    tp, fp, tn, fn = ((p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 0)).sum(), (~p & (y == 1)).sum())
    assert (t["n"], t["tp"], t["fp"], t["tn"], t["fn"]) == (38, tp, fp, tn, fn) and t["accuracy"] == (tp + tn) / 38
    assert t["auc"] == pytest.approx(predict.rank_auc(y, np.array([got[r["epoch"]] for r in known])))
    assert {r["feature"] for r in prelude.importance(said, ["a", "b", "da", "db"]).collect()} == {"a", "b", "da", "db"}
    one = prelude.left_out(rows.withColumn("label", F.lit(1))).collect()
    assert {r["p"] for r in one} == {1.0}


def test_resampled_intervals(spark):
    rng = np.random.default_rng(1)
    rows = [("a", "p", i, float(v)) for i, v in enumerate(rng.standard_normal(60))] + [("b", "p", 0, 1.0), ("b", "p", 1, 2.0)] + [("c", "p", i, v) for i, v in enumerate([3.0, 3.0, 3.0, None])]
    df = spark.createDataFrame(rows, "dyad_id string, pair_key string, fold_id int, delta_auc double")
    got = {r["dyad_id"]: (r["n"], r["lower"], r["upper"]) for r in predict.fold_intervals(df, draws=400).collect()}
    again = {r["dyad_id"]: (r["n"], r["lower"], r["upper"]) for r in predict.fold_intervals(df.repartition(7), draws=400).collect()}
    v = np.array([r[3] for r in rows[:60]])
    assert got["b"] == (2, None, None) and got["c"] == (3, 3.0, 3.0)
    assert got["a"][1:] == pytest.approx(again["a"][1:])
    half = 1.96 * v.std() / np.sqrt(60)
    assert abs(got["a"][1] - (v.mean() - half)) < 0.06 and abs(got["a"][2] - (v.mean() + half)) < 0.06
