"""Lead and lag: cross-correlation, surrogates, false discovery rate, leadership graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PAIR, ratio
from .normalize import hann
from .reuse import cut, reuse
from .spectral import TAPER, angles
from .spectral import surrogates as drawn

#: Surrogates that one task draws for one pair at a time.
BLOCK = 50
#: Samples of a pair whose surrogates one task draws; longer pairs are dealt over tasks.
ONE_TASK = 1 << 16
#: Samples of a series in a chunk of its cross-correlation.
CCF_CHUNK = 4096
_SIDES = ["mod_a", "feat_a", "mod_b", "feat_b"]


def trimmed(paired: DataFrame, max_lag: int, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs from their first to their last sample with both values, numbered from 0, with missing
    values replaced by the series' mean there; and diagnostics of pairs that are left out or odd.

    ``n`` is the length and ``lags`` the greatest lag: at most half the length. Left out are pairs
    of fewer than 20 samples or of fewer than 3 lags + 1.
    """
    keys = keys or PAIR
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    ends = paired.groupBy(*keys).agg(F.min(F.when(both, F.col("idx"))).alias("lo"), F.max(F.when(both, F.col("idx"))).alias("hi"))
    cut = reuse(paired.join(ends, keys).where("idx between lo and hi"))
    by = cut.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count_if(F.col("x").isNull()).alias("holes"),
    ).withColumn("lags", F.least(F.lit(max_lag), F.floor((F.col("n") - 1) / 2)).cast("int"))
    fit = by.where("n >= 20 and n >= 3 * lags + 1")
    rows = cut.join(fit, keys).select(
        *keys, *[c for c in _SIDES if c in paired.columns], (F.col("idx") - F.col("lo")).alias("idx"),
        F.coalesce("x", "mx").alias("x"), F.coalesce("y", "my").alias("y"), "n", "lags",
    )
    kind = F.when(F.col("n") < 20, "too_few_samples").when(F.col("n") < 3 * F.col("lags") + 1, "too_short_for_lag").when(F.col("holes") > 0.1 * F.col("n"), "imputed")
    notes = by.withColumn("type", kind).where("type is not null").select(*keys, "type", F.concat(F.lit("samples: "), "n").alias("message"))
    return rows, notes


def drift(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, drift_x, drift_y): 30 samples or more of which a line explains less than a twentieth."""
    flat = lambda c: (F.count("*") >= 30) & (F.coalesce(F.regr_r2(c, "idx"), F.lit(0.0)) < 0.05)
    return rows.groupBy(*(keys or PAIR)).agg(flat("x").alias("drift_x"), flat("y").alias("drift_y"))


def _correlate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of x[i] * y[i + k] for each k that keeps x inside y; by Fourier transforms where that is less work."""
    if len(x) * (len(y) - len(x) + 1) < 1 << 20:
        return np.correlate(y, x, "valid")
    size = 1 << (len(y) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(y, size) * np.conj(np.fft.rfft(x, size)), size)[: len(y) - len(x) + 1]


def ccf(rows: DataFrame, keys: list[str] | None = None, taper: bool = True) -> DataFrame:
    """(keys, lag, ccf) for lags -lags to lags of ``trimmed`` rows; negative: x leads.

    Pairs are dealt in chunks of CCF_CHUNK samples of x (more if there are more lags), each with the
    samples of y within its lags, so no row is sent once for each lag; a chunk gives a sum for each lag.
    """
    keys = keys or PAIR
    aggs = []
    for c in ("x", "y"):
        slope = F.regr_slope(c, "idx")
        # what a line leaves: the spread less what it explains
        left = F.regr_syy(c, "idx") - F.coalesce(slope * F.regr_sxy(c, "idx"), F.lit(0.0))
        aggs += [F.coalesce(slope, F.lit(0.0)).alias(f"s{c}"), F.avg(c).alias(f"m{c}"), F.sqrt(F.greatest(left, F.lit(0.0))).alias(f"n{c}")]
    lines = rows.groupBy(*keys).agg(F.avg("idx").alias("mi"), *aggs)
    w = hann(F.col("idx"), F.col("n")) if taper else F.lit(1.0)
    flat = lambda c: (F.col(c) - F.col(f"m{c}") - F.col(f"s{c}") * (F.col("idx") - F.col("mi"))) * w
    norm = F.when(F.col("nx") * F.col("ny") > 0, F.col("nx") * F.col("ny")).otherwise(1.0)
    scaled = rows.join(lines, keys).select(*keys, "idx", "n", "lags", flat("x").alias("x"), flat("y").alias("y"), norm.alias("norm"))
    size = F.greatest(F.lit(CCF_CHUNK), F.col("lags"))
    place = lambda at: F.floor(at / size).cast("bigint")
    near = F.sequence(place(F.greatest(F.col("idx") - F.col("lags"), F.lit(0))), place(F.least(F.col("idx") + F.col("lags"), F.col("n") - 1)))
    dealt = scaled.withColumn("chunk", F.explode(near)).withColumn("from", F.col("chunk") * size)
    own = F.when(place(F.col("idx")) == F.col("chunk"), F.col("x"))
    chunks = dealt.groupBy(*keys, "chunk", "from", "lags", "norm").agg(F.collect_list(F.struct((F.col("idx") - F.col("from")).alias("at"), own.alias("x"), "y")).alias("s"))
    width = len(keys)

    def run(batches):
        for batch in batches:
            lags, lists = np.asarray(batch.column("lags")), batch.column("s")
            took, lag, part = [], [], []
            for r in range(batch.num_rows):
                s, m = lists[r].values, int(lags[r])
                at, x, y = (s.field(c).to_numpy(zero_copy_only=False) for c in ("at", "x", "y"))
                held = ~np.isnan(x)
                if not held.any():
                    continue
                end = int(at[held].max()) + 1
                dense, other = np.zeros(end), np.zeros(end + 2 * m)
                dense[at[held]] = x[held]
                inside = (at >= -m) & (at < end + m)
                other[at[inside] + m] = y[inside]
                part.append(_correlate(dense, other)[::-1])
                lag.append(np.arange(-m, m + 1, dtype=np.int32))
                took.append(np.full(2 * m + 1, r))
            rows_ = np.concatenate(took) if took else np.empty(0, np.int64)
            cols = [batch.column(k).take(pa.array(rows_)) for k in range(width)] + [batch.column("norm").take(pa.array(rows_))]
            cols += [pa.array(np.concatenate(lag) if lag else [], pa.int32()), pa.array(np.concatenate(part) if part else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "norm", "lag", "part"])

    fields = [scaled.schema[k] for k in [*keys, "norm"]] + [T.StructField("lag", T.IntegerType()), T.StructField("part", T.DoubleType())]
    parts = chunks.select(*keys, "norm", "lags", "s").mapInArrow(run, T.StructType(fields))
    return parts.groupBy(*keys, "lag").agg((F.sum("part") / F.first("norm")).alias("ccf"))


def peak(curve: DataFrame, hz: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """(keys, lag, lag_sec, ccf, direction): the largest |ccf|, the smallest lag of equals."""
    best = F.max_by(F.struct("lag", "ccf"), F.struct(F.abs("ccf"), -F.col("lag"))).alias("p")
    by = curve.groupBy(*(keys or PAIR)).agg(best)
    direction = F.when(F.col("p.lag") < 0, "a_leads").when(F.col("p.lag") > 0, "b_leads").otherwise("synchronous")
    return by.select(*(keys or PAIR), F.col("p.lag").alias("lag"), (F.abs("p.lag") / F.lit(float(hz))).alias("lag_sec"), F.col("p.ccf").alias("ccf"), direction.alias("direction"))


# ---- surrogates: of short pairs within a task, BLOCK draws at a time; of long ones dealt over tasks ----


def phase_randomised(x: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Series with the tapered series' amplitudes and a row of angles each; short ones as they are."""
    n = len(x)
    if n < 4:
        return np.repeat(x[None], len(turns), axis=0)
    m = max(1, int(TAPER * n))
    ramp = 0.5 * (1 - np.cos(np.pi * np.arange(m) / m))
    edge = np.ones(n)
    edge[:m], edge[-m:] = ramp, ramp[::-1]
    half = np.fft.rfft(x * edge)
    turned = np.abs(half) * np.exp(1j * turns)
    alone = [0] if n % 2 else [0, -1]
    turned[:, alone] = half[alone]
    return np.fft.irfft(turned, n)


def max_abs_ccf(x: np.ndarray, y: np.ndarray, lags: int, taper: bool = True) -> np.ndarray:
    """The largest |ccf| of each row of ``x`` with that of ``y``."""
    n = x.shape[1]
    t = np.arange(n) - (n - 1) / 2

    def flat(z: np.ndarray) -> np.ndarray:
        z = z - z.mean(axis=1, keepdims=True)
        return z - (z @ t / (t @ t))[:, None] * t

    x, y = flat(x), flat(y)
    norm = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / n)) if taper else 1.0
    size = 1 << int(np.ceil(np.log2(2 * n)))
    cross = np.fft.irfft(np.fft.rfft(x * w, size) * np.conj(np.fft.rfft(y * w, size)), size)
    cross = np.concatenate([cross[:, : lags + 1], cross[:, size - lags :] if lags else cross[:, :0]], axis=1)
    return np.abs(cross).max(axis=1) / np.where(norm > 0, norm, 1)


def null_peaks(rows: DataFrame, surrogates: int = 500, seed: int = 42, taper: bool = True, keys: list[str] | None = None) -> DataFrame:
    """(keys, surrogate, peak): the largest |ccf| of a pair's phase-randomised copies.

    Angles are a hash of the seed, the pair, the draw and the frequency: the same in any
    partitioning. A pair of up to ONE_TASK samples goes to one task, once for all its draws; longer
    ones are transformed and correlated in pieces, of which none grows with the recording.
    """
    keys = keys or PAIR
    kinds = dict(rows.dtypes)
    short = rows.where(F.col("n") <= ONE_TASK).select(*keys, "idx", "x", "y", "lags", F.xxhash64(F.lit(seed), *keys).alias("pair_seed"))

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        own, lags, peaks = int(pdf["pair_seed"].iloc[0]), int(pdf["lags"].iloc[0]), []
        sides = [pdf[c].to_numpy(float) for c in ("x", "y")]
        for first in range(0, surrogates, BLOCK):
            turns = [angles(own + k, np.arange(first, min(first + BLOCK, surrogates)), np.arange(len(pdf) // 2 + 1)) for k in (0, 1)]
            peaks.append(max_abs_ccf(*map(phase_randomised, sides, turns), lags, taper))
        out = pd.DataFrame({"surrogate": np.arange(surrogates), "peak": np.concatenate([*peaks, np.empty(0)])})
        for name, value in zip(reversed(keys), reversed(key), strict=True):
            out.insert(0, name, value)
        return out

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", surrogate bigint, peak double"
    null = short.groupBy(*keys).applyInPandas(draw, schema)
    long = rows.where(F.col("n") > ONE_TASK)
    if surrogates < 1 or long.select("n").limit(1).isEmpty():
        return null
    lags = long.groupBy(*keys).agg(F.first("lags").alias("lags"))
    copies = cut(drawn(long, surrogates, seed, keys)).join(lags, keys).withColumnRenamed("draw", "surrogate")
    curves = ccf(copies, [*keys, "surrogate"], taper)
    return null.unionByName(curves.groupBy(*keys, "surrogate").agg(F.max(F.abs("ccf")).alias("peak")))


def null_summary(observed: DataFrame, null: DataFrame, keys: list[str] | None = None, value: str = "ccf", peak: str = "peak") -> DataFrame:
    """(keys, observed, n, null_mean, null_sd, percentile, z, p_value) of |observed| beside its null values.

    ``percentile`` is the share in percent of null values below the observed one, ``p_value`` counts
    those no smaller and the observed one itself; z is NULL where the null values do not spread.
    """
    keys = keys or PAIR
    o, v = F.first("__o"), F.abs(F.col(peak))
    by = null.where(F.col(peak).isNotNull()).join(observed.select(*keys, F.abs(value).alias("__o")).where("__o is not null"), keys).groupBy(*keys).agg(
        o.alias("observed"), F.count("*").alias("n"), F.avg(v).alias("null_mean"), F.stddev_samp(v).alias("null_sd"),
        (100 * F.avg((v < F.col("__o")).cast("double"))).alias("percentile"), ((1 + F.count_if(v >= F.col("__o"))) / (F.count("*") + 1)).alias("p_value"),
    )
    return by.select(*keys, "observed", "n", "null_mean", "null_sd", "percentile", ratio(F.col("observed") - F.col("null_mean"), F.col("null_sd")).alias("z"), "p_value")


def shift_null(paired: DataFrame, shifts: list[int], keys: list[str] | None = None) -> DataFrame:
    """(keys, shift, r): the correlation, to 12 places, of x with y turned around the recording by each shift; 0 is the observed one.

    A shift of y needs the rows of y again, so rows joined grow with the number of shifts.
    """
    keys = keys or PAIR
    n = paired.groupBy(*keys).agg((F.max("idx") + 1).alias("__n"))
    moved = F.explode(F.transform(F.array(*[F.lit(s) for s in shifts]), lambda s: F.struct(s.alias("shift"), F.pmod(F.col("idx") + s, F.col("__n")).alias("at"))))
    y = paired.where("y is not null").join(n, keys).select(*keys, "y", moved.alias("m")).select(*keys, "m.shift", F.col("m.at").alias("idx"), "y")
    both = paired.where("x is not null").select(*keys, "idx", "x").join(y, [*keys, "idx"])
    return both.groupBy(*keys, "shift").agg(F.round(F.corr("x", "y"), 12).alias("r"))


def p_values(observed: DataFrame, null: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``observed`` with p_value: (1 + surrogates whose peak is no smaller) / (surrogates + 1)."""
    keys = keys or PAIR
    at = null.join(observed.select(*keys, F.abs("ccf").alias("__o")), keys).groupBy(*keys).agg(
        ((1 + F.count_if(F.col("peak") >= F.col("__o"))) / (F.count("*") + 1)).alias("p_value")
    )
    return observed.join(at, keys)


def benjamini_hochberg(df: DataFrame, p: str = "p_value", by: list[str] | None = None, tie: str = "pair_key") -> DataFrame:
    """``df`` with p_corrected: p times the tests over its rank, at most 1, and never above a later one's.

    Tests of one dyad are ranked together; a dyad has as many as it has pairs.
    """
    by = by or ["dyad_id"]
    group = Window.partitionBy(*by)
    ranked = df.withColumn("__rank", F.row_number().over(group.orderBy(p, tie))).withColumn("__m", F.count("*").over(group))
    raw = F.least(F.lit(1.0), F.col(p) * F.col("__m") / F.col("__rank"))
    above = group.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("__raw", raw).withColumn("p_corrected", F.min("__raw").over(above)).drop("__rank", "__m", "__raw")


def edges(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(dyad_id, source, target, lag_sec, ccf_value, p_value, is_significant, polarity) of significant pairs
    with a direction; p_value is the corrected one."""
    a, b = F.col("mod_a"), F.col("mod_b")
    leads = F.col("direction") == "a_leads"
    return tested.where((F.col("p_corrected") < alpha) & (F.col("direction") != "synchronous")).select(
        "dyad_id", F.when(leads, a).otherwise(b).alias("source"), F.when(leads, b).otherwise(a).alias("target"), "lag_sec",
        F.col("ccf").alias("ccf_value"), F.col("p_corrected").alias("p_value"), F.lit(True).alias("is_significant"),
        F.when(F.col("ccf") >= 0, "positive").otherwise("negative").alias("polarity"),
    )


def metrics(edges_: DataFrame) -> DataFrame:
    """(dyad_id, modality, in_degree, out_degree, driver_score, is_hub, is_follower) of nodes with edges."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("modality"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                             F.struct(F.col("target").alias("modality"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    by = edges_.select("dyad_id", ends.alias("e")).groupBy("dyad_id", F.col("e.modality").alias("modality")).agg(
        F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree")
    )
    return by.select("*", (F.col("out_degree") - F.col("in_degree")).alias("driver_score"), (F.col("out_degree") >= 2).alias("is_hub"), (F.col("in_degree") >= 2).alias("is_follower"))


def nodes(edges_: DataFrame) -> DataFrame:
    return edges_.select("dyad_id", F.explode(F.array("source", "target")).alias("node")).distinct()


def analyse(
    paired: DataFrame, max_lag_sec: float = 30.0, hz: float = 1.0, surrogates: int = 500, alpha: float = 0.05, seed: int = 42,
    taper: bool = True, pair_scope: str = "all", order: list[str] | None = None,
) -> dict[str, DataFrame]:
    """results, edges, metrics, nodes and diagnostics of all pairs of all dyads.

    ``pair_scope="first_modality"`` tests only pairs with a dyad's first modality, by ``order`` or name.
    """
    if pair_scope not in ("all", "first_modality"):
        raise ValueError(f"unknown pair scope {pair_scope!r}")
    if pair_scope == "first_modality":
        place = F.array_position(F.array(*map(F.lit, order)), F.col("mod_a")) if order else F.lit(0)
        first = paired.groupBy("dyad_id").agg(F.min_by("mod_a", F.struct(place, "mod_a")).alias("__first"))
        paired = paired.join(first, "dyad_id").where("mod_a = __first").drop("__first")
    rows, notes = trimmed(paired, int(max_lag_sec * hz))
    curve = ccf(rows, taper=taper)
    sides = rows.select(*PAIR, *_SIDES).distinct()
    tested = benjamini_hochberg(p_values(peak(curve, hz), null_peaks(rows, surrogates, seed, taper)))
    tested = tested.join(sides, PAIR).withColumn("is_significant", F.col("p_corrected") < alpha)
    found = edges(tested, alpha)
    both = [("drift_x", "x is without trend"), ("drift_y", "y is without trend")]
    drifts = drift(rows).select(*PAIR, F.explode(F.filter(F.array(*[F.when(F.col(c), F.struct(F.lit("drift").alias("type"), F.lit(m).alias("message"))) for c, m in both]), lambda s: s.isNotNull())).alias("d")).select(*PAIR, "d.*")
    return {"results": tested, "ccf": curve, "edges": found, "metrics": metrics(found), "nodes": nodes(found), "diagnostics": notes.unionByName(drifts)}


def rolling(paired: DataFrame, window_sec: float = 60.0, step_sec: float = 30.0, max_lag_sec: float = 10.0, hz: float = 1.0, taper: bool = True) -> DataFrame:
    """(pair, win, window_start, window_end, window_center, lag, lag_sec, ccf, direction, leader) of hopping windows.

    Samples join their windows by number; a partial last window is dropped, as are windows with
    more than a fifth of a side missing; the rest is filled by the window's mean.
    """
    if max_lag_sec >= window_sec / 3:
        raise ValueError("the lag must be under a third of the window")
    size, step, lags = int(window_sec * hz), max(1, int(step_sec * hz)), int(max_lag_sec * hz)
    keys = [*PAIR, "win"]
    length = paired.groupBy(*PAIR).agg((F.max("idx") + 1).alias("len"))
    last = F.floor((F.col("len") - size) / step)
    lo, hi = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / step)), F.least(F.floor(F.col("idx") / step), last)
    inside = paired.join(length, PAIR).where(F.col("len") >= size).withColumn("win", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    inside = inside.withColumn("idx", F.col("idx") - F.col("win") * step)
    by = inside.groupBy(*keys).agg(F.count("x").alias("vx"), F.count("y").alias("vy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    fit = by.where((F.col("vx") >= 0.8 * size) & (F.col("vy") >= 0.8 * size)).drop("vx", "vy")
    rows = inside.join(fit, keys).select(*keys, "idx", F.coalesce("x", "mx").alias("x"), F.coalesce("y", "my").alias("y"), F.lit(size).alias("n"), F.lit(lags).alias("lags"))
    sides = paired.select(*PAIR, "mod_a", "mod_b").distinct()
    best = peak(ccf(rows, keys, taper), hz, keys).join(sides, PAIR)
    start = F.col("win") * step / F.lit(float(hz))
    leader = F.when(F.col("direction") == "a_leads", F.col("mod_a")).when(F.col("direction") == "b_leads", F.col("mod_b"))
    return best.select(
        *keys, start.alias("window_start"), (start + size / hz).alias("window_end"), (start + size / hz / 2).alias("window_center"),
        "mod_a", "mod_b", "lag", "lag_sec", "ccf", "direction", leader.alias("leader"),
    )


def rolling_driver_score(rolled: DataFrame) -> DataFrame:
    """(dyad_id, win, driver_score): how often each modality leads in a window."""
    by = rolled.where("leader is not null").groupBy("dyad_id", "win", "leader").agg(F.count("*").alias("n"))
    return by.groupBy("dyad_id", "win").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("leader", "n")))).alias("driver_score"))


def circular_shift(paired: DataFrame, shift: int, keys: list[str] | None = None) -> DataFrame:
    """y turned by ``shift`` samples around the recording: a surrogate that joins express."""
    keys = keys or PAIR
    n = paired.groupBy(*keys).agg((F.max("idx") + 1).alias("__n"))
    moved: Column = F.pmod(F.col("idx") + shift, F.col("__n"))
    y = paired.join(n, keys).select(*keys, moved.alias("idx"), "y")
    return paired.drop("y").join(y, [*keys, "idx"]).select(paired.columns)
