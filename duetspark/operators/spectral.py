"""Fourier transforms dealt over tasks, and surrogates of recordings that no task could hold.

A transform of n = n1 * n2 values is n2 transforms of n1 values (places with one remainder by n2),
turned, and n1 transforms of n2 values: two shuffles, and a task holds about the square root of n.
Lengths without such factors go by chirps: a convolution of a length that is a power of two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PAIR
from .reuse import cut

#: Values of one transform within a task; lengths with a larger cofactor go by chirps.
LIMIT = 1 << 15
#: Values that one group of the second step holds, and that one group of the first sends at a time.
HELD = 1 << 17
#: Share of a series that is tapered at either end before its spectrum is taken.
TAPER = 0.1


# ---- angles: a counter's hash, so that any task can draw the angle of any place ----


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def angles(seed: int, draws: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(draws, places) angles in [0, 2 pi), the same wherever they are drawn."""
    with np.errstate(over="ignore"):
        own = _mix(np.uint64(seed & (2**64 - 1)) + np.asarray(draws, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        z = _mix(own[:, None] + (np.asarray(places, np.uint64) + np.uint64(1))[None] * np.uint64(0xD1B54A32D192ED03))
    return (z >> np.uint64(11)) * (2 * np.pi / 2**53)


# ---- transforms ----


def _given(cols: dict[str, np.ndarray], n: int, draws: np.ndarray) -> np.ndarray:
    return (cols["re"] + 1j * cols["im"])[None]


def _drawn(cols: dict[str, np.ndarray], n: int, draws: np.ndarray) -> np.ndarray:
    """The spectra of x + iy with drawn angles at some places: mirrored places have opposite angles, and
    those that are their own mirror keep what they have."""
    k = cols["idx"]
    own = np.minimum(k, (n - k) % n)
    turn = np.where((own == 0) | (2 * own == n), 0, np.where(k == own, 1, -1))
    seed = int(cols["pair_seed"][0])
    side = lambda c, at: cols[c] * np.exp(1j * turn * angles(seed + at, draws, own))
    return side("ax", 0) + 1j * side("ay", 1)


def _chirp(at: np.ndarray, n: int, sign: int) -> np.ndarray:
    return np.exp(sign * 1j * np.pi * (at * at % (2 * n)) / n)


def _two_steps(values: DataFrame, keys: list[str], draws: int, fill: Callable, inverse: bool) -> DataFrame:
    """(keys, n, n1, n2, draw, idx, re, im) of (keys, n, n1, n2, idx and what ``fill`` reads); absent places are 0."""
    held, kinds = [*keys, "n", "n1", "n2"], dict(values.dtypes)
    head, sign = ", ".join(f"{k} {kinds[k]}" for k in held), 1 if inverse else -1
    lists = pa.list_(pa.field("element", pa.float64()))
    plain = [c for c in values.columns if c not in held and kinds[c] in ("bigint", "double")]
    transform = lambda a, axis: np.fft.ifft(a, axis=axis, norm="forward") if inverse else np.fft.fft(a, axis=axis)

    def across(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        n, n1, n2, rest = (v.as_py() for v in key[-4:])
        cols = {c: table[c].to_numpy() for c in plain}
        turn = np.exp(sign * 2j * np.pi * (rest * np.arange(n1) % (n1 * n2)) / (n1 * n2))
        width = max(1, HELD // n2)
        bounds = np.append(np.arange(0, n1, width), n1)
        parts = len(bounds) - 1
        step = max(1, HELD // n1)
        for first in range(0, draws, step):
            d = np.arange(first, min(draws, first + step))
            lines = np.zeros((len(d), n1), complex)
            lines[:, cols["idx"] // n2] = fill(cols, n, d)
            lines = transform(lines, 1) * turn
            offsets = pa.array(np.append((np.arange(len(d))[:, None] * n1 + bounds[:-1]).ravel(), len(d) * n1), pa.int32())
            made = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(v).ravel()), type=lists) for v in (lines.real, lines.imag)]
            at = [np.repeat(d, parts), np.tile(bounds[:-1], len(d)), np.full(len(d) * parts, rest)]
            yield pa.RecordBatch.from_arrays([*(pa.repeat(v, len(at[0])) for v in key[:-1]), *map(pa.array, at), *made], [*held, "draw", "start", "rest", "re", "im"])

    def along(key: tuple, table: pa.Table) -> pa.Table:
        n1, n2, draw, start = (v.as_py() for v in key[-4:])
        re, im = (table[c].combine_chunks().flatten().to_numpy() for c in ("re", "im"))
        block = np.zeros((n2, len(re) // len(table)), complex)
        block[table["rest"].to_numpy()] = (re + 1j * im).reshape(len(table), -1)
        block = transform(block, 0)
        idx = (start + np.arange(block.shape[1])[None] + n1 * np.arange(n2)[:, None]).ravel()
        flat = [pa.array(np.ascontiguousarray(v).ravel()) for v in (block.real, block.imag)]
        return pa.Table.from_arrays([*(pa.repeat(v, len(idx)) for v in key[:-1]), pa.array(idx), *flat], [*held, "draw", "idx", "re", "im"])

    dealt = values.groupBy(*held, (F.col("idx") % F.col("n2")).alias("rest"))
    turned = dealt.applyInArrow(across, f"{head}, draw bigint, start bigint, rest bigint, re array<double>, im array<double>")
    return turned.groupBy(*held, "draw", "start").applyInArrow(along, f"{head}, draw bigint, idx bigint, re double, im double")


def _by_chirps(values: DataFrame, keys: list[str], draws: int, fill: Callable, inverse: bool) -> DataFrame:
    """The same for any length: with j * k = (j² + k² - (k - j)²) / 2 the sums are a convolution."""
    sign = 1 if inverse else -1
    power = F.ceil(F.log2(2 * F.col("n") - 1)).cast("int")
    two = lambda p: F.pow(F.lit(2.0), p).cast("bigint")
    sized = values.drop("n1", "n2").withColumns({"n1": two(F.floor(power / 2)), "n2": two(F.ceil(power / 2))})
    turned = _two_steps(sized, keys, draws, lambda cols, n, d: fill(cols, n, d) * _chirp(cols["idx"], n, sign), False)
    lengths = sized.select("n", "n1", "n2").distinct()
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / 4096))
    inside = F.sequence(F.col("b") * 4096, F.least(F.col("b") * 4096 + 4095, F.col("n") - 1))
    j = lengths.withColumn("b", F.explode(blocks)).withColumn("j", F.explode(inside))
    places = F.explode(F.array_distinct(F.array("j", (F.col("n1") * F.col("n2") - F.col("j")) % (F.col("n1") * F.col("n2")))))
    wheel = _two_steps(
        j.select("n", "n1", "n2", "j", places.alias("idx")), [], 1, lambda cols, n, d: _chirp(cols["j"], n, -sign)[None], False
    ).select("n", "idx", F.col("re").alias("wr"), F.col("im").alias("wi"))
    re, im, wr, wi = (F.col(c) for c in ("re", "im", "wr", "wi"))
    both = turned.join(wheel, ["n", "idx"]).withColumns({"re": re * wr - im * wi, "im": re * wi + im * wr})
    back = _two_steps(both.drop("wr", "wi").withColumnRenamed("draw", "of"), [*keys, "of"], 1, _given, True)
    k, size = F.col("idx"), F.col("n1") * F.col("n2")
    angle = F.lit(sign * np.pi) * ((k * k) % (2 * F.col("n"))) / F.col("n")
    c, s = F.cos(angle) / size, F.sin(angle) / size
    return back.where("idx < n").drop("draw").withColumnRenamed("of", "draw").withColumns({"re": re * c - im * s, "im": re * s + im * c})


def dft(values: DataFrame, keys: list[str], inverse: bool = False, draws: int = 1, fill: Callable = _given) -> DataFrame:
    """(keys, draw, idx, re, im): sums of value[j] exp(-2 pi i j k / n) (inverse: + and divided by n).

    ``values`` are (keys, idx, n, re, im), or what ``fill`` makes the values of each draw from; an
    absent place is 0. No task holds more than some 100,000 values of a series.
    """
    length = values.select("n").distinct().withColumn("n1", F.expr("array_max(filter(sequence(1L, cast(floor(sqrt(n)) as bigint)), d -> n % d = 0))"))
    sized = values.join(length.withColumn("n2", F.expr("n div n1")), "n")
    short = _two_steps(sized.where(F.col("n2") <= LIMIT), keys, draws, fill, inverse)
    odd = sized.where(F.col("n2") > LIMIT)
    names = [*keys, "n", "draw", "idx", "re", "im"]
    out = short.select(names)
    if not odd.select("n").limit(1).isEmpty():
        out = out.unionByName(_by_chirps(odd, keys, draws, fill, inverse).select(names))
    return out.withColumns({"re": F.col("re") / F.col("n"), "im": F.col("im") / F.col("n")}) if inverse else out


# ---- surrogates ----


def _edge(idx: Column, n: Column) -> Column:
    """Half a cosine over the first and the last tenth."""
    m = F.greatest(F.lit(1), F.floor(F.lit(TAPER) * n))
    near = F.least(idx, n - 1 - idx)
    return F.when(near < m, 0.5 * (1 - F.cos(F.lit(np.pi) * near / m))).otherwise(1.0)


def spectra(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, idx, ax, ay): amplitudes of the tapered x and y at every place; signed where a place is its own mirror."""
    keys = keys or PAIR
    n, edge = F.col("n").cast("bigint"), _edge(F.col("idx"), F.col("n"))
    z = dft(rows.select(*keys, n.alias("n"), "idx", (F.col("x") * edge).alias("re"), (F.col("y") * edge).alias("im")), keys)
    mirror = (F.col("n") - F.col("idx")) % F.col("n")
    own = F.least("idx", mirror)
    by = z.withColumn("own", own).groupBy(*keys, "n", "own").agg(
        *[F.max(F.when(F.col("idx") == F.col("own"), F.col(c))).alias(f"{c}1") for c in ("re", "im")],
        *[F.max(F.when(F.col("idx") != F.col("own"), F.col(c))).alias(f"{c}2") for c in ("re", "im")],
    )
    r1, i1 = F.col("re1"), F.col("im1")
    r2, i2 = F.coalesce("re2", "re1"), F.coalesce("im2", "im1")
    alone = F.col("re2").isNull()
    ax = F.when(alone, r1).otherwise(F.hypot(r1 + r2, i1 - i2) / 2)
    ay = F.when(alone, i1).otherwise(F.hypot(i1 + i2, r2 - r1) / 2)
    places = F.explode(F.array_distinct(F.array("own", (F.col("n") - F.col("own")) % F.col("n"))))
    return by.select(*keys, "n", places.alias("idx"), ax.alias("ax"), ay.alias("ay"))


def surrogates(rows: DataFrame, draws: int, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, draw, idx, x, y): phase-randomised copies of the pairs' rows (keys, idx, x, y, n).

    The spectrum of a pair is shuffled once for all draws: the tasks of the first step draw the
    angles of their own places.
    """
    keys = keys or PAIR
    own = cut(spectra(rows, keys).withColumn("pair_seed", F.xxhash64(F.lit(seed), *keys)))
    return dft(own, keys, True, draws, _drawn).withColumnsRenamed({"re": "x", "im": "y"})
