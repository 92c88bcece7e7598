"""Filters and windows over framed audio whose frames lie in any task.

A recursive filter needs the samples before a frame; those are summed up by a state of a
few numbers. Over a frame a state changes by an affine map, and maps of neighbouring frames
combine into one, so the states at all frames' starts come from a scan in blocks of
``BLOCK`` frames, blocks of blocks and so on: no file has to lie in one task. Windows that overlap several
frames are cut by a join of windows with the frames that they overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.rhythm import MONO_BANDS, none
from tessera.sources.shared import written

BLOCK = 1024  # frames or blocks that are combined in one group
ORDER = 3  # Fixed value: of the prototype of the band-pass filter


@lru_cache(maxsize=64)
def band_pass(rate: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A Butterworth band-pass as a state-space system ``A, B, C, D``: second-order sections in a row, by the
    bilinear transform."""
    w1, w2 = (2 * rate * np.tan(np.pi * f / rate) for f in (low, high))
    prototype = np.exp(1j * np.pi * (2 * np.arange(ORDER) + ORDER + 1) / (2 * ORDER))
    half = prototype * (w2 - w1) / 2
    root = np.sqrt(half**2 - w1 * w2 + 0j)
    s = np.concatenate([half + root, half - root])
    gain = ((w2 - w1) ** ORDER * (2 * rate) ** ORDER / np.prod(2 * rate - s)).real
    z = (2 * rate + s) / (2 * rate - s)
    real = np.sort(z[np.abs(z.imag) < 1e-12].real)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in z[z.imag >= 1e-12]] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2])]
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for a1, a2 in pairs:  # zeros of each section at the rate's ends: 1 - z^-2
        own_a, own_b, own_c, own_d = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([-a1, -1.0 - a2]), np.array([1.0, 0.0]), 1.0
        a = np.block([[a, np.zeros((len(a), 2))], [np.outer(own_b, c), own_a]])
        b, c, d = np.concatenate([b, own_b * d]), np.concatenate([own_d * c, own_c]), own_d * d
    return a, b, gain * c, gain * d


@lru_cache(maxsize=64)
def responses(rate: int, low: float, high: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ``n`` samples: what a state adds to each (n by states), the response to an impulse, and what each adds to the state at the end."""
    a, b, c, d = band_pass(rate, low, high)
    of_state, to_state = np.empty((n, len(b))), np.empty((n, len(b)))
    row, column = c.copy(), b.copy()
    for i in range(n):
        of_state[i], to_state[n - 1 - i] = row, column
        row, column = row @ a, a @ column
    return of_state, np.concatenate([[d], of_state[:-1] @ b]), to_state


@lru_cache(maxsize=4096)
def over(rate: int, low: float, high: float, n: int) -> np.ndarray:
    """How ``n`` samples of silence change a state."""
    return np.linalg.matrix_power(band_pass(rate, low, high)[0], n)


def upper(rate: int, high: float) -> float:
    """The upper corner at a rate."""
    return min(high, 0.45 * rate)


def scan(items: DataFrame, low: float, high: float, block: int = BLOCK) -> DataFrame:
    """``path, k, state``: the state before each item of ``path, rate, k, n, f``, where an item of ``n`` samples takes state
    ``s`` to ``A^n s + f``."""

    def walk(rows: pd.DataFrame, state: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        states = []
        for rate, n, f in zip(rows["rate"], rows["n"], rows["f"]):
            states.append(state)
            state = over(int(rate), low, upper(rate, high), int(n)) @ state + np.asarray(f)
        return states, state

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        _, end = walk(rows, np.zeros(len(rows["f"].iloc[0])))
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "rate": [rows["rate"].iloc[0]], "k": [rows["block"].iloc[0]], "n": [rows["n"].sum()], "f": [end]})

    def states(rows: pd.DataFrame, start: np.ndarray) -> pd.DataFrame:
        rows = rows.sort_values("k")
        return pd.DataFrame({"path": rows["path"], "k": rows["k"], "state": walk(rows, start)[0]})

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        return states(rows, np.zeros(len(rows["f"].iloc[0])))

    def following(rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        return states(rows, np.asarray(starts["state"].iloc[0])) if len(rows) else none(path=object, k=int, state=object)

    shape = "path string, k long, state array<double>"
    blocked = items.withColumn("block", F.floor(F.col("k") / block))
    if items.filter(F.col("k") >= block).isEmpty():
        return items.groupBy("path").applyInPandas(first, shape)
    totals = written(blocked.groupBy("path", "block").applyInPandas(total, "path string, rate int, k long, n long, f array<double>"), "totals")
    starts = scan(totals, low, high, block).withColumnRenamed("k", "block")
    return blocked.groupBy("path", "block").cogroup(starts.groupBy("path", "block")).applyInPandas(following, shape)


def filtered(framed: DataFrame, low: float = 35.0, high: float = 12000.0, block: int = BLOCK) -> DataFrame:
    """Frames of the mean of both sides after a band-pass from ``low`` to ``high`` Hz, at most 0.45 of the rate; equal to
    filtering the whole file at once, whatever the size of the frames."""

    def mid(left, right) -> np.ndarray:
        return (np.asarray(left, np.float64) + np.asarray(right, np.float64)) / 2

    def ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, r, k, len(a), mid(a, b) @ responses(r, low, upper(r, high), len(a))[2]) for p, r, k, a, b in zip(part["path"], part["rate"], part["frame"], part["left"], part["right"])]
            yield pd.DataFrame(rows, columns=["path", "rate", "k", "n", "f"])

    def apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r, a, b, state in zip(part["rate"], part["left"], part["right"], part["state"]):
                of_state, impulse, _ = responses(r, low, upper(r, high), len(a))
                size = 1 << (2 * len(a) - 1).bit_length()
                out.append(np.fft.irfft(np.fft.rfft(mid(a, b), size) * np.fft.rfft(impulse, size), size)[: len(a)] + of_state @ np.asarray(state))
            yield part[["path", "rate", "channels", "frame"]].assign(left=out, right=out)

    fit = framed.filter((F.size("left") > 0) & (0.45 * F.col("rate") > low))
    items = written(fit.mapInPandas(ends, "path string, rate int, k long, n long, f array<double>"), "ends")
    states = scan(items, low, high, block).withColumnRenamed("k", "frame")
    return fit.join(states, ["path", "frame"]).mapInPandas(apply, "path string, rate int, channels int, frame long, left array<double>, right array<double>")


def joined_pieces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each ``keys``: its pieces ``at, left, right`` in order."""
    own = F.sort_array(F.collect_list(F.struct("at", "left", "right")))
    side = lambda s: F.flatten(F.transform("_own", lambda p: p[s])).alias(s)
    return pieces.groupBy(*keys).agg(own.alias("_own")).select(*keys, side("left"), side("right"))


def part_of(column: str, start, end):
    """Elements ``start`` to ``end`` of an array, by zero-based columns."""
    return F.slice(column, (start + 1).cast("int"), (end - start).cast("int")).alias(column)


def windows_of(framed: DataFrame, size: int, windows: DataFrame) -> DataFrame:
    """``path, rate, w, left, right``: the samples from ``start`` on, ``length`` of them or as many as there are, for each row
    ``path, w, start, length``; frames have ``size`` samples."""
    overlapped = F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("length") - 1) / size))
    wanted = windows.filter("length > 0 and start >= 0").select("path", "w", "start", "length", F.explode(overlapped).alias("frame"))
    rows = framed.select("path", "rate", "frame", "left", "right").join(wanted, ["path", "frame"])
    base = F.col("frame") * size
    a, b = F.greatest(F.col("start") - base, F.lit(0)), F.least(F.col("start") + F.col("length") - base, F.size("left"))
    return joined_pieces(rows.filter(b > a).select("path", "rate", "w", F.col("frame").alias("at"), part_of("left", a, b), part_of("right", a, b)), ["path", "rate", "w"])


def shifted(framed: DataFrame, size: int, spans: DataFrame) -> DataFrame:
    """Frames of ``size`` samples of the part of each file that ``path, start, count`` names. Each frame meets the end of one
    frame and the beginning of the next."""
    rows = framed.join(spans, "path")
    position = F.col("frame") * size - F.col("start")
    a, b = F.greatest(position, F.lit(0)), F.least(position + F.size("left"), F.col("count"))
    rows = rows.withColumns({"_p": position, "_a": a, "_b": b}).filter("_b > _a")
    rows = rows.withColumn("at", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor((F.col("_b") - 1) / size))))
    low, high = F.greatest(F.col("_a"), F.col("at") * size) - F.col("_p"), F.least(F.col("_b"), (F.col("at") + 1) * size) - F.col("_p")
    pieces = rows.select("path", "rate", "channels", F.col("at").alias("frame"), F.col("frame").alias("at"), part_of("left", low, high), part_of("right", low, high))
    return joined_pieces(pieces, ["path", "rate", "channels", "frame"])


def samples(framed: DataFrame) -> DataFrame:
    """``path, samples``."""
    return framed.groupBy("path").agg(F.sum(F.size("left")).cast("long").alias("samples"))


def welch_retention(framed: DataFrame, size: int) -> DataFrame:
    """``path, band, retention_db`` of the mono sum of files of two channels: mean spectra of half-overlapping windows of some 0.68 s, from
    neighbouring frames."""
    # The shortest and longest window in samples, and its seconds.
    length = F.least(F.lit(32768), F.greatest(F.lit(4096), F.floor(F.col("rate") * 0.68)), F.col("samples"))
    rates = framed.filter("channels >= 2").groupBy("path").agg(F.first("rate").alias("rate"))
    wide = rates.join(samples(framed), "path").withColumn("length", length.cast("long")).filter("length > 0")
    step = F.greatest(F.col("length") - F.floor(F.col("length") / 2), F.lit(1))
    windows = wide.select("path", "length", step.alias("step"), F.explode(F.sequence(F.lit(0), F.floor((F.col("samples") - F.col("length")) / step))).alias("w"))
    windows = windows.select("path", "w", (F.col("w") * F.col("step")).alias("start"), "length")

    def powers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, rate, left, right in zip(part["path"], part["rate"], part["left"], part["right"]):
                left, right = np.asarray(left, np.float64), np.asarray(right, np.float64)
                n = len(left)
                hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
                hz = np.fft.rfftfreq(n, 1 / rate)
                power = [np.abs(np.fft.rfft(x * hann)) ** 2 for x in (left, right, (left + right) / 2)]
                for p in power:
                    p[1 : len(p) - (n % 2 == 0)] *= 2
                for band, low, high in MONO_BANDS:
                    inside = (hz >= low) & (hz < min(high, rate / 2))
                    if inside.any():
                        rows.append((path, band, *(float(np.trapezoid(p[inside], hz[inside])) for p in power)))
            yield pd.DataFrame(rows, columns=["path", "band", "l", "r", "m"])

    found = windows_of(framed, size, windows).mapInPandas(powers, "path string, band string, l double, r double, m double")
    stereo = (F.sum("l") + F.sum("r")) / 2
    return found.groupBy("path", "band").agg(F.when(stereo > 0, 10 * F.log10(F.greatest(F.sum("m"), F.lit(1e-30)) / stereo)).alias("retention_db"))
