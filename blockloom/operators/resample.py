"""Resampling by separable weight matrices, pyramids and their residuals."""

from __future__ import annotations

from functools import lru_cache
from math import ceil, floor, pi, sin

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.layout import map_frames

SUPPORT = {"bilinear": 1.0, "bicubic": 2.0, "lanczos": 3.0}


def _kernel(kind: str, x: float) -> float:
    x = abs(x)
    if kind == "bilinear":
        return max(0.0, 1.0 - x)
    if kind == "bicubic":
        a = -0.5
        return ((a + 2) * x - (a + 3)) * x * x + 1 if x < 1 else (((x - 5) * x + 8) * x - 4) * a if x < 2 else 0.0
    if x == 0:
        return 1.0
    return 3 * sin(pi * x) * sin(pi * x / 3) / (pi * pi * x * x) if x < 3 else 0.0


@lru_cache(maxsize=64)
def weights(n_in: int, n_out: int, kind: str = "lanczos") -> np.ndarray:
    """n_out x n_in weights of one axis: the kernel widens when shrinking, and rows sum to one."""
    ratio = n_in / n_out
    out = np.zeros((n_out, n_in))
    if kind == "nearest":
        out[np.arange(n_out), np.minimum(((np.arange(n_out) + 0.5) * ratio).astype(int), n_in - 1)] = 1
        return out
    scale = max(1.0, ratio)
    reach = SUPPORT[kind] * scale
    for i in range(n_out):
        centre = (i + 0.5) * ratio
        for j in range(max(0, floor(centre - reach + 0.5)), min(n_in, ceil(centre + reach - 0.5) + 1)):
            out[i, j] = _kernel(kind, (j + 0.5 - centre) / scale)
        out[i] /= out[i].sum()
    return out


def resize_array(x: np.ndarray, h: int, w: int, kind: str = "lanczos") -> np.ndarray:
    """An h x w version of an image, each channel for itself, rounded half to even."""
    y = np.einsum("ai,ijc,bj->abc", weights(x.shape[0], h, kind), x.astype(np.float64), weights(x.shape[1], w, kind), optimize=True)
    return np.round(y)


def resample(frames: DataFrame, factor: float, kind: str = "lanczos") -> DataFrame:
    """Frames scaled by factor in both axes."""
    return map_frames(frames, lambda x: resize_array(x, max(1, int(x.shape[0] * factor)), max(1, int(x.shape[1] * factor)), kind))


def resize_to(frames: DataFrame, size: int, kind: str = "lanczos") -> DataFrame:
    """Halved or doubled until size x size; sizes must be powers of two apart."""

    def steps(x: np.ndarray) -> np.ndarray:
        while x.shape[0] != size:
            n = x.shape[0] // 2 if x.shape[0] > size else x.shape[0] * 2
            if x.shape[0] > size and n < size or x.shape[0] < size and n > size:
                raise ValueError(f"{size} cannot be reached from {x.shape[0]} by halving or doubling")
            x = resize_array(x, n, n * x.shape[1] // x.shape[0], kind)
        return x

    return map_frames(frames, steps)


def nearest_half(px: DataFrame) -> DataFrame:
    """Half size by picking the pixel at (2i + 1, 2j + 1), as columns only."""
    return px.where("i % 2 = 1 and j % 2 = 1").select("frame_id", F.expr("i div 2").cast("int").alias("i"), F.expr("j div 2").cast("int").alias("j"), "ch", "x")


def pyramid_split(frames: DataFrame, kind: str = "lanczos") -> tuple[DataFrame, DataFrame]:
    """(half-size frames, frames less those scaled up again)."""

    def rest(x: np.ndarray) -> np.ndarray:
        return x - resize_array(resize_array(x, x.shape[0] // 2, x.shape[1] // 2, kind), x.shape[0], x.shape[1], kind)

    return resample(frames, 0.5, kind), map_frames(frames, rest)


def pyramid_join(low: DataFrame, rest: DataFrame, kind: str = "lanczos") -> DataFrame:
    up = resample(low, 2, kind).select("frame_id", F.col("data").alias("u"))
    return rest.join(up, "frame_id").withColumn("data", F.zip_with("data", "u", lambda a, b: (a + b).cast("float"))).drop("u")


def pyramid(frames: DataFrame, sizes: list[int], kind: str = "lanczos") -> DataFrame:
    """All sizes of each frame in one table, by descent from the largest; partition it by res on disk."""
    current, out = None, None
    for size in sorted(sizes, reverse=True):
        current = resize_to(frames if current is None else current, size, kind)
        out = current if out is None else out.unionByName(current)
    return out
