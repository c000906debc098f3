"""Pixel arrays: how sharp a frame is, how much it holds, and a light tidy-up.

Images are arrays of numbers row by row, grey or red, green and blue in turn; decoding files is
a provider's work.  Batches travel by Arrow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# Fixed values of the tidy-up.
SATURATION, BRIGHTNESS, GAIN, OFFSET, BLUR = 1.04, 1.02, 1.03, -3.0, 0.8
GREY = np.array([0.2126, 0.7152, 0.0722])


def _square(p, channels: int = 1):
    """The pixels as a square image, or None for null or another shape."""
    if p is None:
        return None
    side = round((len(p) / channels) ** 0.5)
    if side < 3 or side * side * channels != len(p):
        return None
    return np.asarray(p, dtype="f8").reshape(side, side, channels)


def _sharpness(p) -> float | None:
    """The variance of the Laplacian."""
    x = _square(p)
    if x is None:
        return None
    x = x[..., 0]
    edge = 4 * x[1:-1, 1:-1] - x[:-2, 1:-1] - x[2:, 1:-1] - x[1:-1, :-2] - x[1:-1, 2:]
    return float(edge.var())


def _entropy(p) -> float | None:
    """Bits a pixel, of the histogram of whole grey levels."""
    if p is None or not len(p):
        return None
    n = np.bincount(np.clip(np.rint(np.asarray(p, dtype="f8")), 0, 255).astype(int), minlength=256)
    q = n[n > 0] / n.sum()
    return float(-(q * np.log2(q)).sum())


def _blurred(x: np.ndarray) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-2, 3) / BLUR) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(2, 2) if a == axis else (0, 0) for a in range(3)]
        y = np.pad(x, pad, mode="edge")
        x = sum(w * np.take(y, np.arange(x.shape[axis]) + i, axis=axis) for i, w in enumerate(k))
    return x


def _tidy(p) -> np.ndarray | None:
    """A little more colour, light, contrast and edge, within 0 and 255."""
    x = _square(p, 3)
    if x is None:
        return None
    grey = (x @ GREY)[..., None]
    x = (grey + (x - grey) * SATURATION) * BRIGHTNESS * GAIN + OFFSET
    return np.clip(x + (x - _blurred(x)), 0, 255).ravel()


@F.pandas_udf(DoubleType())
def sharpness(pixels: pd.Series) -> pd.Series:
    return pixels.map(_sharpness)


@F.pandas_udf(DoubleType())
def entropy(pixels: pd.Series) -> pd.Series:
    return pixels.map(_entropy)


@F.pandas_udf(ArrayType(DoubleType()))
def tidy(pixels: pd.Series) -> pd.Series:
    return pixels.map(_tidy)
