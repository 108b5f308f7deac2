"""Transforms and surrogates dealt over tasks beside numpy's of the whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duetspark.operators import cascade, spectral


def complex_rows(spark, **series):
    rows = [(k, i, len(v), float(z.real), float(z.imag)) for k, v in series.items() for i, z in enumerate(v)]
    return spark.createDataFrame(rows, "k string, idx bigint, n bigint, re double, im double")


@pytest.mark.parametrize("inverse", [False, True])
def test_transforms_of_any_length(spark, monkeypatch, inverse):
    """Squares, odd lengths, primes within a task's limit and beyond it, which go by chirps."""
    monkeypatch.setattr(spectral, "LIMIT", 50)
    monkeypatch.setattr(spectral, "HELD", 64)
    rng = np.random.default_rng(4)
    made = {f"s{n}": rng.standard_normal(n) + 1j * rng.standard_normal(n) for n in (1, 2, 36, 47, 101, 210, 622)}
    got = {k: np.zeros(len(v), complex) for k, v in made.items()}
    rows = spectral.dft(complex_rows(spark, **made), ["k"], inverse).collect()
    assert len(rows) == sum(map(len, made.values()))
    for r in rows:
        got[r["k"]][r["idx"]] = r["re"] + 1j * r["im"]
    for k, v in made.items():
        assert np.allclose(got[k], np.fft.ifft(v) if inverse else np.fft.fft(v), atol=1e-9, rtol=0), k


def pair_rows(spark, lags=6, **lengths):
    rng, rows = np.random.default_rng(7), []
    for k, n in lengths.items():
        x, y = np.cumsum(rng.standard_normal((2, n)), axis=1)
        rows += [("d", k, i, float(a), float(b), n, lags) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "dyad_id string, pair_key string, idx bigint, x double, y double, n bigint, lags int")


def test_surrogates_of_long_pairs_equal_those_of_one_task(spark, monkeypatch):
    rows = pair_rows(spark, even=120, odd=105, prime=113, short=60).persist()
    one = {(r["pair_key"], r["surrogate"]): r["peak"] for r in cascade.null_peaks(rows, 7).collect()}
    monkeypatch.setattr(cascade, "ONE_TASK", 100)
    monkeypatch.setattr(spectral, "LIMIT", 50)
    monkeypatch.setattr(spectral, "HELD", 64)
    dealt = {(r["pair_key"], r["surrogate"]): r["peak"] for r in cascade.null_peaks(rows, 7).collect()}
    assert len(one) == 28 and one.keys() == dealt.keys() and all(abs(one[k] - dealt[k]) < 1e-9 for k in one)
    copies = spectral.surrogates(rows.where("pair_key = 'odd'"), 3).orderBy("draw", "idx").toPandas()
    x = rows.where("pair_key = 'odd'").orderBy("idx").toPandas()["x"].to_numpy()
    own = spark.range(1).select(F.xxhash64(F.lit(42), F.lit("d"), F.lit("odd"))).first()[0]
    want = cascade.phase_randomised(x, spectral.angles(own, np.arange(3), np.arange(53)))
    assert np.allclose(copies["x"].to_numpy().reshape(3, -1), want, atol=1e-9)
    rows.unpersist()


def test_surrogates_of_a_long_recording(spark):
    """More samples than a task takes: dealt by the limits that the library has."""
    n = 100_000
    assert n > cascade.ONE_TASK
    rows = spark.range(n).select(
        F.lit("d").alias("dyad_id"), F.lit("p").alias("pair_key"), F.col("id").alias("idx"), F.sin(F.col("id") / 50).alias("x"), (F.hash("id") / 2.0**31).alias("y"),
        F.lit(n).cast("bigint").alias("n"), F.lit(20).alias("lags"))
    own = spark.range(1).select(F.xxhash64(F.lit(42), F.lit("d"), F.lit("p"))).first()[0]
    whole = rows.orderBy("idx").toPandas()
    turns = [spectral.angles(own + k, np.arange(2), np.arange(n // 2 + 1)) for k in (0, 1)]
    want = cascade.max_abs_ccf(*(cascade.phase_randomised(whole[c].to_numpy(), t) for c, t in zip("xy", turns, strict=True)), 20)
    got = [r["peak"] for r in cascade.null_peaks(rows, 2).orderBy("surrogate").collect()]
    assert np.allclose(got, want, atol=1e-9)


def test_summary_of_null_values(spark):
    null = spark.createDataFrame([("d", "a", v) for v in (0.1, -0.3, 0.5, 0.3)] + [("d", "b", 0.2)] * 3 + [("d", "c", None)], "dyad_id string, pair_key string, peak double")
    seen = spark.createDataFrame([("d", "a", -0.3), ("d", "b", 0.9), ("d", "c", 0.1)], "dyad_id string, pair_key string, ccf double")
    got = {r["pair_key"]: r for r in cascade.null_summary(seen, null).collect()}
    assert got.keys() == {"a", "b"}
    assert (got["a"]["n"], got["a"]["percentile"], got["a"]["p_value"]) == (4, 25.0, 0.8) and got["a"]["null_mean"] == pytest.approx(0.3)
    assert (got["b"]["percentile"], got["b"]["p_value"], got["b"]["z"]) == (100.0, 0.25, None)
