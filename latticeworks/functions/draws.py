"""Counter-based draws keyed by place, and gradient noise over them.

Draws depend on a stream and on integer keys alone, never on row order or partitioning. Arithmetic is that of unsigned
64-bit integers that wrap, on whole Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constants of SplitMix64 (Steele, Lea and Flood, 2014), and the root of all streams (fixed values).
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
ROOT = 0x5851F42D4C957F2D
#: Perlin's sixteen gradients in the plane z = 0 (fixed values).
GRADIENTS = [(1, 1), (-1, 1), (1, -1), (-1, -1), (1, 0), (-1, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)]
_GX, _GY = np.array(GRADIENTS, float).T
_U = np.uint64


def splitmix64(x: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = np.asarray(x, _U) + _U(STEP)
        z = (z ^ (z >> _U(30))) * _U(FIRST)
        z = (z ^ (z >> _U(27))) * _U(SECOND)
        return z ^ (z >> _U(31))


def stream(seed: int, parts: list[str | bytes]) -> int:
    """The stream of a user: every part is absorbed with its length."""
    h = splitmix64(seed ^ ROOT)
    for part in parts:
        data = part.encode() if isinstance(part, str) else part
        h = splitmix64(h ^ _U(len(data)))
        for byte in data:
            h = splitmix64(h ^ _U(byte))
    return int(h)


def draw_words(s: int | np.ndarray, *keys: np.ndarray) -> np.ndarray:
    h = splitmix64(np.asarray(s, _U) ^ _U(len(keys)))
    for k in keys:
        h = splitmix64(h ^ np.asarray(k, np.int64).view(_U))
    return h


def to_unit(words: np.ndarray) -> np.ndarray:
    """The 53-bit mapping to [0, 1), exact."""
    return (words >> _U(11)).astype(float) * 2.0**-53


def draw(s: int, *keys: Column) -> Column:
    """The word of a draw, as a signed 64-bit integer of the same bits."""

    @F.pandas_udf("long")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(draw_words(s, *(c.to_numpy(np.int64) for c in columns)).view(np.int64))

    return run(*(k.cast("long") for k in keys))


def unit(s: int, *keys: Column) -> Column:
    """A number in [0, 1) for each place."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(to_unit(draw_words(s, *(c.to_numpy(np.int64) for c in columns))))

    return run(*(k.cast("long") for k in keys))


def gradient_noise(s: int, octave: int, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    ix, iy = np.floor(px), np.floor(py)
    fx, fy = px - ix, py - iy
    ix, iy = ix.astype(np.int64), iy.astype(np.int64)

    def corner(a: int, b: int) -> np.ndarray:
        g = (draw_words(s, ix + a, iy + b, np.full(len(ix), octave)) >> _U(60)).astype(np.int64)
        return _GX[g] * (fx - a) + _GY[g] * (fy - b)

    fade = lambda t: t * t * t * (t * (t * 6.0 - 15.0) + 10.0)
    blend = lambda a, b, w: (1.0 - w) * a + w * b
    u, v = fade(fx), fade(fy)
    n = blend(blend(corner(0, 0), corner(1, 0), u), blend(corner(0, 1), corner(1, 1), u), v)
    return np.clip(n, -1.0, 1.0)


def _octaves(x: Column, y: Column, s: int, wavelength: float, octaves: int, gain: float, lacunarity: float, folded: bool) -> Column:
    if wavelength <= 0 or not 1 <= octaves <= 12 or not 0 < gain <= 1 or lacunarity <= 1:
        raise ValueError("formula.range: noise")

    @F.pandas_udf("double")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        total, weights = np.zeros(len(xs)), 0.0
        for i in range(octaves):
            width, g = wavelength / lacunarity**i, gain**i
            n = gradient_noise(s, i, xs.to_numpy(float) / width, ys.to_numpy(float) / width)
            total += g * ((1.0 - np.abs(n)) * (1.0 - np.abs(n)) if folded else n)
            weights += g
        return pd.Series(total / weights)

    return run(x.cast("double"), y.cast("double"))


def fbm(x: Column, y: Column, s: int, wavelength: float, octaves: int = 4, gain: float = 0.5, lacunarity: float = 2.0) -> Column:
    """Octaves of gradient noise, -1 to 1."""
    return _octaves(x, y, s, wavelength, octaves, gain, lacunarity, False)


def ridged(x: Column, y: Column, s: int, wavelength: float, octaves: int = 4, gain: float = 0.5, lacunarity: float = 2.0) -> Column:
    """Octaves of folded gradient noise, 0 to 1."""
    return _octaves(x, y, s, wavelength, octaves, gain, lacunarity, True)
