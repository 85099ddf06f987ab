"""Quality of reconstructions and of rate-distortion curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weights of the scales.
SCALES = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def frame_errors(a: DataFrame, b: DataFrame) -> DataFrame:
    """(frame_id, mse, mad, psnr) of frames with equal ids; psnr is null where they are equal."""
    pairs = a.select("frame_id", "data").join(b.select("frame_id", F.col("data").alias("other")), "frame_id")
    diff = F.zip_with("data", "other", lambda x, y: x.cast("double") - y.cast("double"))
    n = F.size("data")
    out = pairs.withColumn("_d", diff).select("frame_id", (F.aggregate("_d", F.lit(0.0), lambda s, x: s + x * x) / n).alias("mse"), (F.aggregate("_d", F.lit(0.0), lambda s, x: s + F.abs(x)) / n).alias("mad"))
    return out.withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(F.lit(255.0**2) / F.col("mse"))))


def quality(a: DataFrame, b: DataFrame) -> DataFrame:
    """Means over frames of mse, mad, psnr, and the root of the mean mse."""
    return frame_errors(a, b).agg(F.avg("mse").alias("mse"), F.avg("mad").alias("mad"), F.avg("psnr").alias("psnr"), F.sqrt(F.avg("mse")).alias("rmse"))


def _gauss(n: int, sigma: float) -> np.ndarray:
    x = np.arange(n) - (n - 1) / 2
    g = np.exp(-(x**2) / (2 * sigma**2))
    return g / g.sum()


def _blur(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Separable filter over rows and columns where it fits whole."""
    for axis in (0, 1):
        x = np.apply_along_axis(np.convolve, axis, x, g, "valid")
    return x


def ssim_pair(a: np.ndarray, b: np.ndarray, size: int = 23, sigma: float = 1.5, top: float = 255.0, k1: float = 0.01, k2: float = 0.03) -> tuple[float, float]:
    """Mean structural similarity and contrast term of two h x w x c images."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    n = min(size, a.shape[0], a.shape[1])
    g = _gauss(n, n * sigma / size if size else 0)
    ma, mb = _blur(a, g), _blur(b, g)
    va, vb, cov = _blur(a * a, g) - ma * ma, _blur(b * b, g) - mb * mb, _blur(a * b, g) - ma * mb
    c1, c2 = (k1 * top) ** 2, (k2 * top) ** 2
    contrast = (2 * cov + c2) / (va + vb + c2)
    return float((contrast * (2 * ma * mb + c1) / (ma * ma + mb * mb + c1)).mean()), float(contrast.mean())


def uniform_ssim_pair(a: np.ndarray, b: np.ndarray, size: int = 7, top: float = 255.0, k1: float = 0.01, k2: float = 0.03) -> float:
    """Mean structural similarity under flat windows with sample covariances, channels averaged."""
    a, b, g = a.astype(np.float64), b.astype(np.float64), np.full(size, 1 / size)
    ma, mb = _blur(a, g), _blur(b, g)
    sample = size * size / (size * size - 1)
    va, vb, cov = (sample * (_blur(x, g) - m) for x, m in ((a * a, ma * ma), (b * b, mb * mb), (a * b, ma * mb)))
    c1, c2 = (k1 * top) ** 2, (k2 * top) ** 2
    return float(((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def ms_ssim_pair(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity over five scales, each half of the one before."""
    a, b, terms = a.astype(np.float64), b.astype(np.float64), []
    for _ in SCALES:
        terms.append(ssim_pair(a, b))
        halve = lambda x: (lambda p: (p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) / 4)(np.pad(x, ((0, x.shape[0] % 2), (0, x.shape[1] % 2), (0, 0)), "edge"))
        a, b = halve(a), halve(b)
    sign = lambda v, w: np.sign(v) * abs(v) ** w
    return float(np.prod([sign(t[1], w) for t, w in zip(terms[:-1], SCALES)]) * sign(terms[-1][0], SCALES[-1]))


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(frame_id, ssim, ms_ssim) of frames with equal ids."""
    pairs = a.select("frame_id", "h", "w", "c", "data").join(b.select("frame_id", F.col("data").alias("other")), "frame_id")

    def run(batches):
        for p in batches:
            images = [(np.array(x).reshape(h, w, c), np.array(y).reshape(h, w, c)) for x, y, h, w, c in zip(p["data"], p["other"], p["h"], p["w"], p["c"])]
            yield pd.DataFrame({"frame_id": p["frame_id"], "ssim": [uniform_ssim_pair(x, y) for x, y in images], "ms_ssim": [ms_ssim_pair(x, y) for x, y in images]})

    return pairs.mapInPandas(run, "frame_id long, ssim double, ms_ssim double")


def _slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Derivatives of the shape-preserving cubic interpolant."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return np.array([d[0], d[0]])
    out = np.zeros(len(x))
    for i in range(1, len(x) - 1):
        if d[i - 1] * d[i] > 0:
            w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            out[i] = (w1 + w2) / (w1 / d[i - 1] + w2 / d[i])
    for end, near, far, a, b in ((0, 0, 1, h[0], h[1]), (-1, -1, -2, h[-1], h[-2])):
        s = ((2 * a + b) * d[near] - a * d[far]) / (a + b)
        out[end] = 0 if s * d[near] <= 0 else 3 * d[near] if d[near] * d[far] <= 0 and abs(s) > 3 * abs(d[near]) else s
    return out


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    s = _slopes(x, y)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    t = (at - x[i]) / h
    return (1 + 2 * t) * (1 - t) ** 2 * y[i] + t * (1 - t) ** 2 * h * s[i] + t * t * (3 - 2 * t) * y[i + 1] + t * t * (t - 1) * h * s[i + 1]


def _mean_gap(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, piecewise: bool) -> float:
    low, high = max(x1.min(), x2.min()), min(x1.max(), x2.max())
    areas = []
    for x, y in ((x1, y1), (x2, y2)):
        if piecewise:
            at = np.linspace(low, high, 100)
            areas.append(np.trapezoid(pchip(np.sort(x), np.sort(y), at), at))
        else:
            p = np.polyint(np.polyfit(x, y, 3))
            areas.append(np.polyval(p, high) - np.polyval(p, low))
    return float((areas[1] - areas[0]) / (high - low))


def bd_psnr(rate1, psnr1, rate2, psnr2, piecewise: bool = False) -> float:
    """Mean gain of curve 2 over curve 1 in dB."""
    r1, p1, r2, p2 = (np.asarray(v, float) for v in (rate1, psnr1, rate2, psnr2))
    return _mean_gap(np.log(r1), p1, np.log(r2), p2, piecewise)


def bd_rate(rate1, psnr1, rate2, psnr2, piecewise: bool = False) -> float:
    """Mean change of rate of curve 2 against curve 1, in percent."""
    r1, p1, r2, p2 = (np.asarray(v, float) for v in (rate1, psnr1, rate2, psnr2))
    return float(np.expm1(_mean_gap(p1, np.log(r1), p2, np.log(r2), piecewise)) * 100)


ANCHOR_POINTS = 10_000
"""Points of an anchor's curve, at most: they come to the driver."""


def bd_table(points: DataFrame, anchor: str, piecewise: bool = False) -> DataFrame:
    """(model, bd_psnr, bd_rate) of each model's (bpp, mse) points against the anchor's."""
    psnr = points.withColumn("psnr", 10 * F.log10(F.lit(255.0**2) / F.col("mse")))
    base = [(r.bpp, r.psnr) for r in psnr.where(F.col("model") == anchor).orderBy("bpp").limit(ANCHOR_POINTS + 1).collect()]
    if len(base) > ANCHOR_POINTS:
        raise ValueError(f"the anchor's curve has more than {ANCHOR_POINTS} points")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("bpp")
        x, y = zip(*base)
        return pd.DataFrame({"model": [g["model"].iloc[0]], "bd_psnr": [bd_psnr(x, y, g["bpp"], g["psnr"], piecewise)], "bd_rate": [bd_rate(x, y, g["bpp"], g["psnr"], piecewise)]})

    return psnr.groupBy("model").applyInPandas(compare, "model string, bd_psnr double, bd_rate double")


def displayed(points: DataFrame, limit: float = 0.3) -> DataFrame:
    """The points of a rate-distortion table that are drawn: those under a limit of bits a pixel."""
    return points.where(F.col("bpp") < limit)


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull by rising first value, the first corner left out."""
    pts = sorted(set(points))

    def half(ps):
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    return sorted(set(half(pts) + half(pts[::-1])))[1:]
