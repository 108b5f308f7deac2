"""Nested regressions from sums of products beside least squares on whole series."""

import math

import numpy as np
import pytest

from duetspark.operators import granger as g

PAIRED = "dyad_id string, pair_key string, idx bigint, x double, y double"


def by_hand(cause, effect, max_lag):
    """(lag, n, f, eta2) by least squares."""
    t = [i for i in range(max_lag, len(effect)) if not any(np.isnan(s[i - k]) for s in (cause, effect) for k in range(max_lag + 1))]
    past = lambda s, lag: [[s[i - k] for k in range(1, lag + 1)] for i in t]
    y, best = np.array([effect[i] for i in t]), None
    for lag in range(1, max_lag + 1):
        left = []
        for a in (np.column_stack([np.ones(len(t)), past(effect, lag)]), np.column_stack([np.ones(len(t)), past(effect, lag), past(cause, lag)])):
            left.append(((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum())
        bic = len(t) * math.log(left[1] / len(t)) + (2 * lag + 1) * math.log(len(t))
        if best is None or bic < best[0]:
            best = bic, lag, len(t), (left[0] - left[1]) / lag / (left[1] / (len(t) - 2 * lag - 1)), 1 - left[1] / left[0]
    return best[1:]


def test_tail_of_f():
    assert g.f_tail(3.0, 2, 7) == pytest.approx((1 + 2 * 3.0 / 7) ** -3.5, rel=1e-12)
    assert g.f_tail(2.5, 1, 1) == pytest.approx(1 - 2 / math.pi * math.atan(math.sqrt(2.5)), rel=1e-12)
    assert g.f_tail(4.0, 4, 2) == pytest.approx(1 - (8 / 9) ** 2, rel=1e-12)  # I_z(2, 1) = z²
    assert g.f_tail(90.0, 2, 100_000) == pytest.approx((1 + 180 / 100_000) ** -50_000, rel=1e-9)
    assert g.f_tail(0.0, 3, 9) == 1


@pytest.mark.parametrize("chunk", [7, 64, 16_384])
def test_directions_as_by_least_squares(spark, monkeypatch, chunk):
    monkeypatch.setattr(g, "CHUNK", chunk)
    rng, series = np.random.default_rng(2), {}
    for k, (n, holes) in {"led": (300, 0), "holes": (260, 9), "noise": (200, 0)}.items():
        x, y = rng.standard_normal((2, n)) + 5
        for i in range(3, n):
            x[i] += 0.4 * x[i - 1]
            y[i] += 0.3 * y[i - 1] + (0.8 * x[i - 3] if k != "noise" else 0)
        x[rng.integers(0, n, holes)] = np.nan
        series[k] = x, y
    rows = [("d", k, i, None if np.isnan(a) else float(a), float(b)) for k, (x, y) in series.items() for i, (a, b) in enumerate(zip(x, y, strict=True))]
    got = {(r["pair_key"], r["direction"]): r for r in g.granger(spark.createDataFrame(rows, PAIRED), 5).collect()}
    assert len(got) == 6
    for k, (x, y) in series.items():
        for direction, sides in (("x_to_y", (x, y)), ("y_to_x", (y, x))):
            r, (lag, n, f, eta2) = got[k, direction], by_hand(*sides, 5)
            assert (r["lag"], r["n"]) == (lag, n) and r["f"] == pytest.approx(f, rel=1e-7) and r["eta2"] == pytest.approx(eta2, rel=1e-7)
            assert r["p_value"] == pytest.approx(g.f_tail(f, lag, n - 2 * lag - 1), rel=1e-6) and r["p_bonferroni"] == pytest.approx(min(1, 6 * r["p_value"]))
    assert got["led", "x_to_y"]["causes"] and got["led", "x_to_y"]["lag"] == 3 and not got["noise", "y_to_x"]["causes"]


def test_flat_short_and_empty_pairs(spark):
    """A series that its own past tells has no F; too few samples have no row."""
    rows = [("d", "flat", i, 1.0, float(i * i % 7)) for i in range(40)] + [("d", "short", i, float(i % 3), float(i)) for i in range(4)] + [("d", "none", i, None, 1.0) for i in range(40)]
    got = {(r["pair_key"], r["direction"]): r for r in g.granger(spark.createDataFrame(rows, PAIRED), 3).collect()}
    assert got.keys() == {("flat", "x_to_y"), ("flat", "y_to_x")}
    assert got["flat", "y_to_x"]["f"] is None and got["flat", "y_to_x"]["causes"] is None and got["flat", "x_to_y"]["f"] == pytest.approx(0, abs=1e-6)
    assert g.granger(spark.createDataFrame([], PAIRED), 3).count() == 0
