"""Colour conversions as column expressions over b, g, r / y, u, v columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Luma and chroma weights.
TO_YUV = ((0.299, 0.587, 0.114), (-0.14713, -0.28886, 0.436), (0.615, -0.51499, -0.10001))
FROM_YUV = ((1.0, 0.0, 1.13983), (1.0, -0.39465, -0.58060), (1.0, 2.03211, 0.0))


def _apply(matrix, values: list[Column]) -> list[Column]:
    return [sum((F.lit(k) * v for k, v in zip(row[1:], values[1:])), F.lit(row[0]) * values[0]) for row in matrix]


def clip(x: Column) -> Column:
    """Cut to a 16-bit whole number, then to 0..255."""
    return F.least(F.greatest(x.cast("int").cast("short"), F.lit(0).cast("short")), F.lit(255).cast("short"))


def swap_channels(data: Column) -> Column:
    """Blue-green-red to red-green-blue and back, over flat pixels of three channels."""
    return F.transform(data, lambda x, p: F.get(data, p - p % 3 + 2 - p % 3))


def rgb_to_yuv(df: DataFrame, rounded: bool = False) -> DataFrame:
    """Adds y, u, v from r, g, b less 127."""
    out = _apply(TO_YUV, [F.col(c).cast("double") - 127 for c in "rgb"])
    return df.withColumns({n: F.rint(v) if rounded else v for n, v in zip("yuv", out)})


def yuv_to_rgb(df: DataFrame, clipped: bool = False) -> DataFrame:
    """Adds r, g, b from y, u, v: plus 127, or clipped to 0..255 without it."""
    out = _apply(FROM_YUV, [F.col(c).cast("double") for c in "yuv"])
    return df.withColumns({n: clip(v) if clipped else v + 127 for n, v in zip("rgb", out)})


def to_420(yuv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frame_id, i, j, y) at full size and (frame_id, i, j, u, v) as 2 x 2 means."""
    half = yuv.groupBy("frame_id", F.expr("i div 2").cast("int").alias("i"), F.expr("j div 2").cast("int").alias("j")).agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    return yuv.select("frame_id", "i", "j", "y"), half


def to_444(y: DataFrame, uv: DataFrame) -> DataFrame:
    """Full-size u and v by bilinear weights of the four nearest half-size pixels, edges repeated."""
    size = uv.groupBy("frame_id").agg(F.max("i").alias("mi"), F.max("j").alias("mj"))
    base = y.join(size, "frame_id")
    near, far = "greatest(0, least(m{a}, cast(floor(({a} - 0.5) / 2) as int)))", "greatest(0, least(m{a}, cast(floor(({a} - 0.5) / 2) as int) + 1))"
    step = "abs(({a} - 0.5) / 2 - floor(({a} - 0.5) / 2))"
    rows = base.select("*", F.explode(F.array(*[F.struct(F.expr((far if p else near).format(a="i")).alias("si"), F.expr((far if q else near).format(a="j")).alias("sj"), ((F.expr(step.format(a="i")) if p else 1 - F.expr(step.format(a="i"))) * (F.expr(step.format(a="j")) if q else 1 - F.expr(step.format(a="j")))).alias("k")) for p in (0, 1) for q in (0, 1)])).alias("n"))
    parts = rows.select("frame_id", "i", "j", "y", "n.*").join(uv.select("frame_id", F.col("i").alias("si"), F.col("j").alias("sj"), "u", "v"), ["frame_id", "si", "sj"])
    return parts.groupBy("frame_id", "i", "j", "y").agg(F.sum(F.col("k") * F.col("u")).alias("u"), F.sum(F.col("k") * F.col("v")).alias("v"))
