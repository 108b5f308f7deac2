"""Resampling every modality of a dyad to one clock, and the checks before it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from ..schema import SERIES
from .neighbours import with_neighbours

METHODS = ("linear", "nearest", "cubic")
#: Clock seconds in a chunk of the as-of windows.
CHUNK_SEC = 4096.0
#: Samples in a chunk of a spline, on average.
SPLINE_ROWS = 20_000


def first_per_time(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """One sample per series and time: the first in file order (or by ``order``)."""
    order = F.monotonically_increasing_id() if order is None else order
    w = SparkWindow.partitionBy(*SERIES, "t").orderBy("__order")
    return rows.withColumn("__order", order).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__order", "__n")


def time_type(signals: DataFrame) -> DataFrame:
    """(dyad_id, modality, time_type): absolute, relative or unknown, from the least and greatest time."""
    lo, hi = F.min("t"), F.max("t")
    kind = F.when(lo > 1e6, "absolute").when((lo >= 0) & (hi < 10000), "relative").otherwise("unknown")
    return signals.groupBy("dyad_id", "modality").agg(kind.alias("time_type"))


def clock_report(signals: DataFrame, require_co_start: bool = False, compat: bool = False) -> DataFrame:
    """(dyad_id, level, message) of dyads whose clocks don't go together.

    Modalities with absolute and others with relative times are an error; so are relative times
    where ``require_co_start`` asks for a common origin, else they are a warning. All-absolute
    clocks are fine, unless ``compat`` asks for an error there too.
    """
    by = time_type(signals).groupBy("dyad_id").agg(
        F.count_if(F.col("time_type") == "absolute").alias("a"), F.count_if(F.col("time_type") == "relative").alias("r"), F.count("*").alias("n")
    )
    mixed = (F.col("a") > 0) & (F.col("r") < F.col("n")) if compat else (F.col("a") > 0) & (F.col("a") < F.col("n"))
    relative = F.col("r") == F.col("n")
    level = F.when(mixed, "error").when(relative, F.lit("error" if require_co_start else "warning"))
    message = F.when(mixed, "absolute and other clocks are mixed").when(relative, "relative clocks may not start together")
    return by.select("dyad_id", level.alias("level"), message.alias("message")).where("level is not null")


def bounds(signals: DataFrame, hz: float, strict: bool = True) -> DataFrame:
    """(dyad_id, t0, t1, n): the time that all modalities of a dyad cover, and its samples.

    A dyad without common time raises, or is left out if not ``strict``.
    """
    ends = signals.groupBy("dyad_id", "modality").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    both = ends.groupBy("dyad_id").agg(F.max("lo").alias("t0"), F.min("hi").alias("t1"))
    if strict:
        both = both.withColumn("t0", F.when(F.col("t0") < F.col("t1"), F.col("t0")).otherwise(
            F.raise_error(F.concat(F.lit("no common time in dyad "), "dyad_id")).cast("double")))
    both = both.where("t0 < t1")
    return both.withColumn("n", (F.floor((F.col("t1") - F.col("t0")) * hz) + 1).cast("bigint"))


def grid(signals: DataFrame, hz: float, strict: bool = True) -> DataFrame:
    """(series, idx, t) on the common clock: n points from t0 to t1, evenly spaced."""
    series = signals.select(*SERIES).distinct()
    rows = series.join(bounds(signals, hz, strict), "dyad_id").select(*SERIES, "t0", "t1", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
    t = F.when(F.col("n") > 1, F.col("t0") + F.col("idx") * ((F.col("t1") - F.col("t0")) / F.greatest(F.col("n") - 1, F.lit(1)))).otherwise(F.col("t0"))
    # the last point is the end itself, not what rounding makes of it
    return rows.select(*SERIES, "idx", F.when((F.col("idx") == F.col("n") - 1) & (F.col("n") > 1), F.col("t1")).otherwise(t).alias("t"))


def align(signals: DataFrame, hz: float = 1.0, method: str = "linear", strict: bool = True) -> DataFrame:
    """(series, idx, t, value) at ``hz`` on the clock common to a dyad's modalities.

    Only valid samples count; outside a series' own valid range, and where it has fewer than two,
    values are NULL. Linear joins the neighbours, nearest takes the nearer (the earlier of two
    equally near), cubic is a not-a-knot spline (linear below four samples).
    """
    if method not in METHODS:
        raise ValueError(f"method {method!r} is none of {METHODS}")
    points = grid(signals, hz, strict)
    valid = signals.where("value is not null and t is not null").select(*SERIES, "t", "value")
    if method == "cubic":
        return _cubic(points, valid)
    valid = valid.join(valid.groupBy(*SERIES).agg(F.count("*").alias("m")).where("m >= 2").select(*SERIES), SERIES)
    both = valid.select(*SERIES, F.lit(None).cast("bigint").alias("idx"), "t", "value").unionByName(
        points.withColumn("value", F.lit(None).cast("double"))
    )
    near = with_neighbours(
        both, SERIES, F.col("t"), F.col("idx").isNull(), F.struct("t", "value"), F.floor(F.col("t") / CHUNK_SEC), F.col("idx").isNotNull().cast("int")
    ).where("idx is not null")
    p, n, t = F.col("prev"), F.col("next"), F.col("t")
    if method == "linear":
        value = F.when(p["t"] == t, p["value"]).when(
            n.isNotNull(), p["value"] + (n["value"] - p["value"]) * (t - p["t"]) / F.nullif(n["t"] - p["t"], F.lit(0.0))
        )
    else:
        value = F.when(p["t"] == t, p["value"]).when(n.isNotNull(), F.when(t - p["t"] <= n["t"] - t, p["value"]).otherwise(n["value"]))
    return near.select(*SERIES, "idx", "t", F.when(p.isNotNull(), value).alias("value"))


def _cubic(points: DataFrame, valid: DataFrame) -> DataFrame:
    """The spline of each series, solved exactly in chunks of about SPLINE_ROWS samples.

    Each chunk's equations are reduced to those of its outer unknowns, a series' reduced equations
    (one row a chunk) are solved together, and each chunk is solved again between the known
    neighbours. Chunks are whole bins of a series' time, eight for every SPLINE_ROWS samples on average:
    only samples crowded into one bin make a chunk larger. Points meet their chunk's samples
    SPLINE_ROWS at a time.
    """
    size, by = SPLINE_ROWS, [*SERIES, "chunk"]
    whole = valid.groupBy(*SERIES).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"))
    whole = whole.withColumn("bins", F.when(F.col("n") <= size, F.lit(1)).otherwise(8 * F.ceil(F.col("n") / size)).cast("bigint"))
    at = F.floor((F.col("t") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * F.col("bins"))
    bin_ = F.coalesce(F.least(at, F.col("bins") - 1), F.lit(0)).cast("bigint").alias("bin")
    held = valid.join(whole, SERIES).select(*SERIES, bin_, "t", "value")
    run = SparkWindow.partitionBy(*SERIES).orderBy("bin").rowsBetween(SparkWindow.unboundedPreceding, -1)
    every = whole.select(*SERIES, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)).alias("bin"))
    counts = every.join(held.groupBy(*SERIES, "bin").agg(F.count("*").alias("k")), [*SERIES, "bin"], "left")
    chunks = counts.select(*SERIES, "bin", F.floor(F.coalesce(F.sum("k").over(run), F.lit(0)) / size).cast("bigint").alias("chunk"))
    held = held.join(chunks, [*SERIES, "bin"]).select(*by, "t", "value")

    # a chunk's place in its series, and the samples next to it
    ends = held.groupBy(*by).agg(F.count("*").alias("k"), F.min(F.struct("t", "value")).alias("a"), F.max(F.struct("t", "value")).alias("b"))
    order = SparkWindow.partitionBy(*SERIES).orderBy("chunk")
    first = F.coalesce(F.sum("k").over(order.rowsBetween(SparkWindow.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    prev, follow = F.lag("b").over(order), F.lead("a").over(order)
    ends = ends.select(*by, first.alias("first"), prev["t"].alias("t_a"), prev["value"].alias("v_a"), follow["t"].alias("t_b"), follow["value"].alias("v_b"))
    ends = ends.join(whole.select(*SERIES, "n"), SERIES)
    held = held.join(ends, by)

    head = "dyad_id string, modality string, feature string"
    reduced = held.groupBy(*by).applyInPandas(_reduce, f"{head}, chunk bigint, " + ", ".join(f"{c} double" for c in _REDUCED))
    solved = reduced.groupBy(*SERIES).applyInPandas(_solve, f"{head}, chunk bigint, " + ", ".join(f"{c} double" for c in _SOLVED))
    inside = points.join(whole, SERIES).where("t between lo and hi").select(*SERIES, "idx", "t", bin_)
    inside = inside.join(chunks, [*SERIES, "bin"]).select(*by, "idx", "t", F.floor(F.col("idx") / size).cast("bigint").alias("part"))
    needed = held.join(solved, by).join(inside.select(*by, "part").distinct(), by)
    needed = needed.select(*[F.col(k).alias(f"{k}_") for k in (*by, "part")], *[c for c in needed.columns if c not in (*by, "part")])
    got = inside.groupBy(*by, "part").cogroup(needed.groupBy(*[f"{k}_" for k in (*by, "part")])).applyInPandas(_evaluate, f"{head}, idx bigint, t double, value double")
    beyond = points.join(whole, SERIES, "left").where("n is null or t < lo or t > hi")
    return got.unionByName(beyond.select(*SERIES, "idx", "t", F.lit(None).cast("double").alias("value")))


#: Of a chunk's outer unknowns m: p - l * (the one before the chunk) - r * (the one after it), for its first,
#: second, last but one and last; steps are the ratios of the first and the last two steps of time, if it has them.
_REDUCED = [f"{c}{i}" for i in range(4) for c in "plr"] + ["unknowns", "step_a", "step_b"]
#: Second derivatives before and after a chunk, and at the ends of the series.
_SOLVED = ["m_before", "m_after", "m_first", "m_last"]


def _sweep(low: np.ndarray, diag: np.ndarray, up: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """The solution of tridiagonal equations for each column of ``rhs``."""
    diag, r, n = diag.copy(), rhs.copy(), len(diag)
    for i in range(1, n):
        f = low[i] / diag[i - 1]
        diag[i] -= f * up[i - 1]
        r[i] -= f * r[i - 1]
    for i in range(n - 1, -1, -1):
        r[i] = (r[i] - (up[i] * r[i + 1] if i < n - 1 else 0)) / diag[i]
    return r


def _knots(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int, int, int, int]:
    """Times and values of a chunk with its neighbours, the place of the first of them in the series, the
    series' length, and the chunk's first unknown and the one after its last, as places here."""
    pdf = pdf.sort_values("t")
    r, first, n = pdf.iloc[0], int(pdf["first"].iloc[0]), int(pdf["n"].iloc[0])
    before, after = first > 0, first + len(pdf) < n
    x = np.concatenate([[r["t_a"]] * before, pdf["t"], [r["t_b"]] * after])
    y = np.concatenate([[r["v_a"]] * before, pdf["value"], [r["v_b"]] * after])
    # the ends of a series are no unknowns
    s, e = int(before) + (first == 0), int(before) + len(pdf) - (first + len(pdf) == n)
    at = first - before
    return x.astype(float), y.astype(float), at, n, max(s, 1 - at), min(e, n - 1 - at)


def _equations(x: np.ndarray, y: np.ndarray, at: int, n: int, s: int, e: int) -> tuple[np.ndarray, ...]:
    """Bands and right side of the equations s to e of the second derivatives; third derivatives
    are continuous at the second and last but one sample of the series."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    low, diag, up, rhs = h[s - 1 : e - 1].copy(), 2 * (h[s - 1 : e - 1] + h[s:e]), h[s:e].copy(), 6 * (d[s:e] - d[s - 1 : e - 1])
    # m0 = m1 - (m2 - m1) h0/h1 and likewise at the end turn the end equations into inner ones
    if at + s == 1:
        diag[0] += h[s - 1] + h[s - 1] ** 2 / h[s]
        up[0] -= h[s - 1] ** 2 / h[s]
        low[0] = 0
    if at + e == n - 1:
        diag[-1] += h[e - 1] + h[e - 1] ** 2 / h[e - 2]
        low[-1] -= h[e - 1] ** 2 / h[e - 2]
        up[-1] = 0
    return low, diag, up, rhs


def _reduce(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    x, y, at, n, s, e = _knots(pdf)
    row = [np.nan] * 12 + [max(0, e - s), np.nan, np.nan]
    if n >= 4 and e > s:
        low, diag, up, rhs = _equations(x, y, at, n, s, e)
        sides = np.column_stack([rhs, np.zeros((e - s, 2))])
        sides[0, 1], sides[-1, 2] = low[0], up[-1]
        m, h = _sweep(low, diag, up, sides), np.diff(x)
        k = [0, min(1, e - s - 1), max(e - s - 2, 0), e - s - 1]
        row = [*m[k].ravel(), e - s, h[s - 1] / h[s] if at + s == 1 else np.nan, h[e - 1] / h[e - 2] if at + e == n - 1 else np.nan]
    return pd.DataFrame([[*key, *map(float, row)]], columns=[*SERIES, "chunk", *_REDUCED])


def _solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk").reset_index(drop=True)
    has = np.flatnonzero((pdf["unknowns"] > 0) & pdf["p0"].notna())
    out = pd.DataFrame(0.0, index=pdf.index, columns=_SOLVED)
    if len(has):
        c = pdf.loc[has, _REDUCED[:12]].to_numpy(float)
        j = len(c)
        first, last = np.zeros((j, 2)), np.zeros((j, 2))  # p - r * (the next chunk's first)
        p, r = 0.0, 0.0
        for i in range(j):
            p0, l0, r0, p3, l3, r3 = *c[i, :3], *c[i, 9:]
            q = 1 - l0 * r
            first[i] = (p0 - l0 * p) / q, r0 / q
            p, r = p3 - l3 * p + l3 * r * first[i, 0], l3 * r * first[i, 1] + r3
            last[i] = p, r
        a, b = np.zeros(j + 1), np.zeros(j + 1)  # first and last unknowns; none after the last chunk
        for i in range(j - 1, -1, -1):
            a[i], b[i] = first[i, 0] - first[i, 1] * a[i + 1], last[i, 0] - last[i, 1] * a[i + 1]
        count = pdf.loc[has, "unknowns"].to_numpy()
        second = c[0, 3] - c[0, 5] * a[1] if count[0] > 1 else a[1]
        before_last = c[-1, 6] - c[-1, 7] * (b[j - 2] if j > 1 else 0.0) if count[-1] > 1 else b[j - 2]
        out["m_first"] = a[0] - (second - a[0]) * pdf["step_a"][has[0]]
        out["m_last"] = b[j - 1] + (b[j - 1] - before_last) * pdf["step_b"][has[-1]]
        for i in pdf.index:
            k, up = np.searchsorted(has, i), np.searchsorted(has, i, side="right")
            out.loc[i, ["m_before", "m_after"]] = b[k - 1] if k > 0 else 0.0, a[up]
    return pd.concat([pdf[[*SERIES, "chunk"]], out], axis=1)


def _evaluate(key: tuple, points: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    x, y, at, n, s, e = _knots(known)
    points = points.sort_values("idx")
    q = points["t"].to_numpy()
    if n < 4:
        value = np.interp(q, x, y) if n > 1 else np.full(len(q), np.nan)
    else:
        before, after, first, last = known[_SOLVED].iloc[0]
        m = np.zeros(len(x))
        m[0], m[-1] = before, after
        if e > s:
            low, diag, up, rhs = _equations(x, y, at, n, s, e)
            rhs[0] -= low[0] * before
            rhs[-1] -= up[-1] * after
            m[s:e] = _sweep(low, diag, up, rhs)
        if at == 0:
            m[0] = first
        if at + len(x) == n:
            m[-1] = last
        h = np.diff(x)
        k = np.clip(np.searchsorted(x, q, side="right") - 1, 0, len(x) - 2)
        u, v = x[k + 1] - q, q - x[k]
        value = (m[k] * u**3 + m[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v
    return points.assign(value=[None if np.isnan(z) else z for z in value])[[*SERIES, "idx", "t", "value"]]


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A cubic spline whose third derivative is continuous at the second and last but one knot."""
    n = len(x)
    out = np.full(len(at), np.nan)
    if n < 2:
        return out
    inside = (at >= x[0]) & (at <= x[-1])
    if n < 4:
        out[inside] = np.interp(at[inside], x, y)
        return out
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    a = np.zeros((3, n))  # bands of the equations for second derivatives at inner knots
    rhs = np.zeros(n)
    a[0, 1:-1], a[1, 1:-1], a[2, 1:-1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    rhs[1:-1] = 6 * np.diff(d)
    # m0 = m1 - (m2 - m1) h0/h1 and likewise at the end turn the end equations into inner ones
    a[1, 1] += h[0] + h[0] ** 2 / h[1]
    a[2, 1] -= h[0] ** 2 / h[1]
    a[1, -2] += h[-1] + h[-1] ** 2 / h[-2]
    a[0, -2] -= h[-1] ** 2 / h[-2]
    m = np.zeros(n)
    diag, up, r = a[1].copy(), a[2], rhs.copy()
    for i in range(2, n - 1):
        f = a[0, i] / diag[i - 1]
        diag[i] -= f * up[i - 1]
        r[i] -= f * r[i - 1]
    for i in range(n - 2, 0, -1):
        m[i] = (r[i] - (up[i] * m[i + 1] if i < n - 2 else 0)) / diag[i]
    m[0] = m[1] - (m[2] - m[1]) * h[0] / h[1]
    m[-1] = m[-2] + (m[-2] - m[-3]) * h[-1] / h[-2]
    q = at[inside]
    k = np.clip(np.searchsorted(x, q, side="right") - 1, 0, n - 2)
    u, v = x[k + 1] - q, q - x[k]
    out[inside] = (m[k] * u**3 + m[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v
    return out
