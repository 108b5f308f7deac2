"""Operators against plain numpy and hand-made cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duetspark.functions import text as wording
from duetspark.operators import align, cascade, clean, context, normalize, predict, quality, viewer, wcc
from duetspark.operators.spectral import angles
from duetspark.schema import ALIGNED, SIGNALS, as_signals, present

N = None


def aligned(spark, **series):
    rows = [("d", m, "v", i, float(i), N if v is None else float(v)) for m, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, ALIGNED)


def values(df, modality="a"):
    return [r["value"] for r in df.where(F.col("modality") == modality).orderBy("idx").collect()]


def signals(spark, **series):
    return spark.createDataFrame([("d", m, "v", float(t), N if v is None else float(v)) for m, tv in series.items() for t, v in tv], SIGNALS)


def test_linear_as_numpy(spark):
    rng = np.random.default_rng(0)
    t = np.sort(rng.uniform(0, 20000, 300))  # several chunks
    v = rng.standard_normal(300)
    got = align.align(signals(spark, a=list(zip(t, v, strict=True)), b=[(0, 1), (20000, 2)]), 0.05)
    rows = got.where("modality = 'a'").orderBy("idx").collect()
    x = np.array([r["t"] for r in rows])
    n = int((t[-1] - t[0]) * 0.05) + 1
    assert len(rows) == n and np.allclose(x, np.linspace(t[0], t[-1], n))
    assert np.allclose([r["value"] for r in rows], np.interp(x, t, v))


def test_nearest_takes_the_earlier_of_equals(spark):
    got = align.align(signals(spark, a=[(0, 1), (2, 5), (4, 9)], b=[(0, 0), (4, 0)]), 1.0, "nearest")
    assert values(got) == [1, 1, 5, 5, 9]


def test_cubic_is_exact_on_cubics():
    x = np.array([0.0, 1, 2.5, 4, 5, 7])
    f = lambda z: z**3 - 2 * z**2 + z - 3
    at = np.linspace(0, 7, 50)
    assert np.allclose(align.not_a_knot(x, f(x), at), f(at))
    assert np.isnan(align.not_a_knot(x, f(x), np.array([-1.0, 8.0]))).all()
    assert np.allclose(align.not_a_knot(x[:3], f(x[:3]), np.array([0.5])), np.interp(0.5, x[:3], f(x[:3])))


def test_cubic_in_chunks_as_whole(spark, monkeypatch):
    rng = np.random.default_rng(5)
    # evenly spread, crowded into one bin with lone samples at both ends, five samples
    times = {"a": rng.uniform(0, 100, 300), "b": np.concatenate([[0, 99.9], rng.uniform(40, 42, 250)]), "c": [0, 20, 55, 70, 100], "d": [0, 30, 100], "e": [50]}
    made = {k: [(x, rng.standard_normal()) for x in sorted(t)] for k, t in times.items()}
    df = signals(spark, **made).withColumn("dyad_id", F.when(F.col("modality") == "e", "e").otherwise("d"))
    df = df.union(df.where("modality = 'e'").withColumns({"modality": F.lit("f")})).union(spark.createDataFrame([("e", "f", "v", 60.0, 1.0), ("e", "e", "v", 60.0, N)], SIGNALS))
    for rows in (5, 40):
        monkeypatch.setattr(align, "SPLINE_ROWS", rows)
        got = align.align(df, 3.0, "cubic").collect()
        for k, tv in made.items():
            here = sorted((r for r in got if r["modality"] == k), key=lambda r: r["idx"])
            want = align.not_a_knot(*map(np.array, zip(*tv, strict=True)), np.array([r["t"] for r in here]))
            assert [r["idx"] for r in here] == list(range(len(here))) and len(here) > 20
            assert np.allclose([np.nan if r["value"] is None else r["value"] for r in here], want, rtol=1e-7, atol=1e-9, equal_nan=True), (rows, k)


def test_cubic_tasks_hold_chunks_only(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = signals(spark, a=[(x, rng.standard_normal()) for x in np.sort(rng.uniform(0, 100, 400))], b=[(0, 1), (100, 2)])
    monkeypatch.setattr(align, "SPLINE_ROWS", 50)
    reduce, evaluate = align._reduce, align._evaluate

    def few(key, pdf):
        assert len(pdf) <= 100
        return reduce(key, pdf)

    def short(key, points, known):
        assert len(points) <= 50 and len(known) <= 100
        return evaluate(key, points, known)

    monkeypatch.setattr(align, "_reduce", few)
    monkeypatch.setattr(align, "_evaluate", short)
    assert len(values(align.align(df, 10.0, "cubic"))) == len(values(align.align(df, 10.0, "linear")))


def test_few_samples_and_ranges(spark):
    got = align.align(signals(spark, a=[(0, N), (1, 3), (5, N)], b=[(0, 0), (2, 2), (3, N), (5, N)]), 1.0)
    assert values(got) == [N] * 6 and values(got, "b") == [0, 1, 2, N, N, N]
    with pytest.raises(Exception, match="no common time"):
        align.align(signals(spark, a=[(0, 1), (1, 1)], b=[(5, 1), (6, 1)]), 1.0).collect()
    with pytest.raises(ValueError, match="method"):
        align.align(signals(spark, a=[(0, 1)]), 1.0, "other")


def test_clocks(spark):
    s = signals(spark, a=[(1.7e9, 1), (1.7e9 + 5, 1)], b=[(0, 1), (9, 1)])
    assert [r["level"] for r in align.clock_report(s).collect()] == ["error"]
    absolute = signals(spark, a=[(1.7e9, 1)], b=[(1.7e9, 1)])
    assert align.clock_report(absolute).count() == 0
    assert [r["level"] for r in align.clock_report(absolute, compat=True).collect()] == ["error"]
    relative = signals(spark, a=[(0, 1)], b=[(3, 1)])
    assert [align.clock_report(relative, x).first()["level"] for x in (False, True)] == ["warning", "error"]


def test_gaps(spark):
    a = aligned(spark, a=[N, 1, N, N, 4, N, N, N, 8, N])
    assert values(clean.ffill(a)) == [1, 1, 1, 1, 4, 4, 4, 4, 8, 8]
    assert values(clean.ffill(a, 2)) == [N, 1, 1, 1, 4, N, N, N, 8, 8]
    assert values(clean.interpolate(a)) == [1, 1, 2, 3, 4, 5, 6, 7, 8, 8]
    assert values(clean.short_gaps(a, 2)) == [1, 1, 2, 3, 4, N, N, N, 8, 8]
    both = aligned(spark, a=[1, N, 3, 4], b=[1, 2, N, 4])
    kept = clean.drop_window(both)
    assert values(kept) == [1, 4] and [r["idx"] for r in kept.where("modality = 'a'").orderBy("idx").collect()] == [0, 1]
    assert values(clean.ffill(aligned(spark, a=[N, N]))) == [N, N]
    with pytest.raises(ValueError, match="strategy"):
        clean.handle_missing(a, "other")


def test_median_filter_reflects_ends(spark):
    v = [5.0, 1, 9, 2, 8, 3, N, 1, 2, N, 4, 4, 9, 4, 4, 4]
    got = values(clean.median_filter(aligned(spark, a=v), 4))  # raised to 5

    def run(x):
        y = np.pad(np.array(x, float), 2, mode="symmetric")
        return [float(np.median(y[i : i + 5])) for i in range(len(x))]

    assert got == [*run(v[:6]), N, 1, 2, N, *run(v[10:])]


def test_clipping(spark):
    v = [*range(20), 500, N]
    out, report = clean.clip_outliers(aligned(spark, a=v, b=[1, 2, 300]), 3.0)
    q1, q3 = np.percentile(v[:-1], [25, 75])
    assert max(x for x in values(out) if x is not None) == q3 + 3 * (q3 - q1) and values(out, "b") == [1, 2, 300]
    assert {r["modality"]: r["clipped"] for r in report.collect()} == {"a": 1, "b": 0}


def test_zscores(spark):
    a = aligned(spark, a=[1, 2, 3, N], b=[5, 5, N])
    z = values(normalize.zscore(a))
    assert z[3] is None and np.allclose(z[:3], (np.arange(3) - 1) / np.std([1, 2, 3]))
    assert values(normalize.zscore(a), "b") == [0, 0, 0]
    assert max(values(normalize.zscore(aligned(spark, a=[0] * 20 + [9]), clip=2.0))) == 2.0


def wcc_numpy(x, y, w):
    holes = np.isnan(x).any() or np.isnan(y).any()
    out = []
    for i in range(len(x) - w + 1):
        a, b = x[i : i + w], y[i : i + w]
        if np.isnan(a).any() or np.isnan(b).any():
            out.append(None)
            continue
        s = a.std() * b.std()
        out.append(float(np.clip(((a - a.mean()) * (b - b.mean())).mean() / s, -1, 1)) if s > 1e-10 else 0.0 if holes else None)
    return out


@pytest.mark.parametrize(("holes", "lag"), [(False, 0), (True, 0), (False, 3), (False, -2)])
def test_sliding_correlation_in_chunks(spark, holes, lag):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal(60), rng.standard_normal(60)
    y[20:35] = 2.0
    if holes:
        x[7] = np.nan
    p = wcc.pairs(aligned(spark, a=[N if np.isnan(v) else v for v in x], b=list(y)))
    got = [r["r"] for r in wcc.wcc(p, 8, lag, chunk=16).orderBy("idx").collect()]
    shifted = np.full(60, np.nan)
    if lag > 0:
        shifted[lag:] = y[:-lag]
    elif lag < 0:
        shifted[:lag] = y[-lag:]
    else:
        shifted = y
    want = wcc_numpy(x, shifted, 8)
    assert len(got) == len(want) == 53
    assert all((g is None) == (w is None) and (g is None or abs(g - w) < 1e-9) for g, w in zip(got, want, strict=True))
    assert wcc.wcc(p, 100).count() == 0


def test_pair_order(spark):
    p = wcc.pairs(aligned(spark, a=[1], b=[1], c=[1]), ["c", "a"])
    assert {r["pair_key"] for r in p.collect()} == {"c_v__a_v", "c_v__b_v", "a_v__b_v"}


def test_ccf_as_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(90)
    y = np.concatenate([np.zeros(4), x[:-4]]) + 0.1 * rng.standard_normal(90)
    rows, notes = cascade.trimmed(wcc.pairs(aligned(spark, a=list(x), b=list(y))), 10)
    got = {r["lag"]: r["ccf"] for r in cascade.ccf(rows).collect()}
    line = lambda z: z - np.polyval(np.polyfit(np.arange(90), z, 1), np.arange(90))
    a, b = line(x), line(y)
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(90) / 90))
    norm = np.linalg.norm(a) * np.linalg.norm(b)
    for lag in range(-10, 11):
        i = np.arange(max(0, lag), min(90, 90 + lag))
        assert got[lag] == pytest.approx(((a * w)[i] * (b * w)[i - lag]).sum() / norm, abs=1e-9)
    assert max(abs(v) for v in got.values()) == pytest.approx(cascade.max_abs_ccf(x[None], y[None], 10)[0], abs=1e-9)
    assert cascade.peak(cascade.ccf(rows)).first()["lag"] == -4
    short, why = cascade.trimmed(wcc.pairs(aligned(spark, a=[1] * 10, b=[2] * 10)), 3)
    assert short.count() == 0 and why.first()["type"] == "too_few_samples"


def test_surrogates_keep_the_spectrum():
    x = np.cumsum(np.random.default_rng(3).standard_normal(500))
    turns = angles(1, np.arange(5), np.arange(251))
    s = cascade.phase_randomised(x, turns)
    assert s.shape == (5, 500)
    amp = lambda z: np.abs(np.fft.rfft(z - z.mean()))[1:]
    assert all(np.corrcoef(amp(x), amp(z))[0, 1] > 0.85 for z in s)
    assert (cascade.phase_randomised(x[:3], turns[:2]) == x[:3]).all()


def test_false_discovery_rate(spark):
    p = [0.01, 0.04, 0.03, 0.2]
    df = spark.createDataFrame([("d", f"k{i}", v) for i, v in enumerate(p)], "dyad_id string, pair_key string, p_value double")
    got = [r["p_corrected"] for r in cascade.benjamini_hochberg(df).orderBy("pair_key").collect()]
    assert np.allclose(got, [0.04, 0.16 / 3, 0.16 / 3, 0.2])


def test_scope_of_pairs(spark):
    rng = np.random.default_rng(5)
    p = wcc.pairs(aligned(spark, **{m: list(rng.standard_normal(70)) for m in "abc"}))
    assert cascade.analyse(p, 5, surrogates=5)["results"].count() == 3
    assert cascade.analyse(p, 5, surrogates=5, pair_scope="first_modality")["results"].count() == 2
    with pytest.raises(ValueError, match="third"):
        cascade.rolling(p, 30, 10, 10)


def test_splits_and_feasibility():
    assert predict.splits(12, 3) == [(3, 3, 6), (6, 6, 9), (9, 9, 12)]
    assert predict.splits(12, 3, 3) == [] and predict.splits(13, 3, 3)[0] == (1, 4, 7)
    assert [n for n in range(60, 95) if not predict.splits(n, 5, 15)] == [*range(60, 71), *[n for n in range(72, 91) if n - 15 - 5 * (n // 6) <= 0]]
    f = predict.feasibility(300)
    assert f["n_windows"] == 19 and f["min_samples_needed"] == 11 and f["feasible"]
    assert not predict.feasibility(100, gap=9)["feasible"]


def test_sparse_logistic_is_optimal():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((80, 4)) * [1, 50, 0.1, 3]
    y = (x[:, 0] + 0.3 * rng.standard_normal(80) > 0.4).astype(int)
    w = predict.l1_logistic(x, y, 20000)
    a, s = np.column_stack([x, np.ones(80)]), np.where(y == 1, 80 / (2 * y.sum()), 80 / (2 * (1 - y).sum()))
    loss = lambda v: np.abs(v).sum() + (s * np.logaddexp(0, -(2 * y - 1) * (a @ v))).sum()
    assert all(loss(w) <= loss(w + e) + 1e-7 for e in 1e-3 * rng.standard_normal((300, 5)))
    assert predict.rank_auc(np.array([0, 1, 1, 0]), np.array([0.1, 0.1, 0.9, 0.2])) == 0.625


def test_contexts(spark):
    with pytest.raises(ValueError, match="context"):
        context.contexts(spark, [("d", 5, 5, "x")])
    c = context.contexts(spark, [("d", 0, 10, "a"), ("d", 5, 20, "b")])
    p = spark.createDataFrame([("d", float(t)) for t in (0, 7, 10, 20)], "dyad_id string, t double")
    assert [r["label"] for r in context.context_at(p, c).orderBy("t").collect()] == ["a", "a", "b", None]
    assert context.parse("1,2", "d") is None and context.parse("1,2,x,.5", "d") == ("d", 1.0, 2.0, "x", 0.5)


def test_validation(spark):
    def report(rows, **k):
        return quality.validate(spark.createDataFrame([("s", i, float(t), a, b) for i, (t, a, b) in enumerate(rows)], "stream_id string, row long, t_ms double, p1 double, p2 double"), **k).first()

    good = [(i * 1000, float(np.sin(i)), float(np.cos(i))) for i in range(60)]
    r = report(good)
    assert r["valid"] and r["rate"] == 1.0 and r["errors"] == r["warnings"] == r["notes"] == []
    assert report(good[:5])["errors"] == ["too_few"] and report(good[:20])["notes"] == ["short"]
    assert "rate" in report(good, expected_rate=4.0)["warnings"]
    bad = [(0, 1.0, 1.0), (0, 1.0, 1.0), (9e4, 1.0, 1.0), (8e4, float("nan"), 1.0), *[(1e5 + i, 1.0, 1.0) for i in range(20)]]
    r = report(bad)
    assert {"non_finite", "backwards", "no_spread"} <= set(r["errors"]) and {"duplicates", "gaps", "missing"} <= set(r["warnings"])


def test_viewer(spark):
    s = spark.createDataFrame([("d", "m", k, 0, v) for k, v in ((1, 4.0), (2, 8.0), (3, 10.0))] + [("d", "m", 1, 1, 1.0)], "dyad_id string, modality string, stream_ord int, epoch int, value double")
    assert [(r["epoch"], r["value"]) for r in viewer.merge_streams(s).collect()] == [(0, 8.0)]
    seg = spark.createDataFrame([("d", 0, 4), ("d", 9, 10)], "dyad_id string, start_epoch int, end_epoch int")
    r = viewer.largest_gap(seg, 12).first()
    assert (r["gap_start"], r["gap_end"]) == (4, 9)


def test_wording(spark):
    df = spark.createDataFrame([("a", "b", 0.2, "positive", "strong", 0.0001), ("a", "b", 2.0, "negative", "weak", 0.04), ("a", "b", 5.0, "negative", "odd", 0.04)], "s string, t string, l double, p string, k string, v double")
    got = [r[0] for r in df.select(wording.describe_edge(*[F.col(c) for c in "stlpkv"])).collect()]
    assert got[0].startswith("a and b are nearly synchronous (highly significant). Their positive")
    assert got[1].startswith("a weakly precedes temporally b by 2.0s.") and got[2].startswith("a moderately precedes temporally b by 5.0s.")
    t = spark.createDataFrame([("A DRIVER of change",), ("precedes",), (None,)], "x string")
    assert [r[0] for r in t.select(wording.allowed(F.col("x"))).collect()] == [False, True, True]
    driver = spark.range(1).select(wording.describe_driver(F.lit("m"), F.lit(2), F.lit(2), F.lit(0))).first()[0]
    assert "acts as a driver" in driver and wording.forbidden_words is not None


def test_ingest(spark):
    wide = spark.createDataFrame(pd.DataFrame({"time": [0.0, 1.0], "v": [1.0, float("nan")], "name": ["x", "y"]}))
    rows = as_signals(wide, "m").orderBy("t").collect()
    assert [(r["feature"], r["value"]) for r in rows] == [("v", 1.0), ("v", None)]
    with pytest.raises(ValueError, match="time"):
        as_signals(wide.drop("time"), "m")
    with pytest.raises(ValueError, match="numeric"):
        as_signals(wide.withColumn("time", F.lit("x")), "m")
    assert spark.range(1).select(present(F.lit(float("inf")))).first()[0] is None
    s = spark.createDataFrame([("d", "m", "f", 1.0, 9.0, 0), ("d", "m", "f", 1.0, 7.0, 1)], SIGNALS + ", k int")
    assert [r["value"] for r in align.first_per_time(s, F.col("k")).collect()] == [9.0]


def test_windows_grow_with_the_series(spark):
    long = [("d", "p", i, float(np.sin(i / 20))) for i in range(250)]
    short = [("d", "q", i, float(np.cos(i / 9))) for i in range(130)]
    s = spark.createDataFrame(long + short, "dyad_id string, pair_key string, idx bigint, r double")
    got = predict.hops(s, 30, grow=60).groupBy("pair_key").agg(F.max("w").alias("w"), F.max("win").alias("last"), F.count("*").alias("n")).collect()
    assert {(r["pair_key"], r["w"], r["last"], r["n"]) for r in got} == {("p", 60, 6, 7 * 60), ("q", 32, 6, 7 * 32)}
    label = {(r["pair_key"], r["win"]): r["label"] for r in predict.future_labels(s, 30, grow=60).collect()}
    want = {}
    for key, rows, w in (("p", long, 60), ("q", short, 32)):
        for win, at in enumerate(range(0, len(rows) - w + 1, w // 2)):
            if ahead := [x[3] for x in rows[at + w : at + 2 * w]]:
                want[key, win] = int(np.mean(ahead) > 0)
    assert label == want
    assert {r["pair_key"] for r in predict.hops(s, 30).where("w = 30").select("pair_key").distinct().collect()} == {"p", "q"}


def test_public_names_load():
    import duetspark

    assert all(callable(getattr(duetspark, n)) for n in duetspark.__all__)
    with pytest.raises(AttributeError):
        duetspark.unknown  # noqa: B018
