"""Block layout, masks and vector arithmetic: all of it as column expressions.

unfold and fold keep a frame's pixels in one row and index arrays, so neither shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.schema import FRAMES


def frames_of(df: DataFrame, id_col: str, data_col: str, h: int, w: int, c: int = 1) -> DataFrame:
    """A table of flat vectors as frames."""
    return df.select(F.col(id_col).cast("long").alias("frame_id"), F.lit(h).alias("res"), F.lit(h).alias("h"), F.lit(w).alias("w"), F.lit(c).alias("c"), F.col(data_col).cast("array<float>").alias("data"))


def pixels(frames: DataFrame) -> DataFrame:
    """(frame_id, i, j, ch, x): one row per value."""
    exploded = frames.select("frame_id", "w", "c", F.posexplode("data").alias("p", "x"))
    return exploded.select("frame_id", F.expr("cast(p div (w * c) as int)").alias("i"), F.expr("cast((p div c) % w as int)").alias("j"), (F.col("p") % F.col("c")).cast("int").alias("ch"), F.col("x").cast("double").alias("x"))


def unfold(frames: DataFrame, win: int) -> DataFrame:
    """Non-overlapping win x win blocks, values by channel, row and column; needs h and w divisible."""
    grid = frames.select("*", F.explode(F.expr(f"sequence(0, h div {win} - 1)")).alias("bi")).select("*", F.explode(F.expr(f"sequence(0, w div {win} - 1)")).alias("bj"))
    at = f"((bi * {win} + (o % {win * win}) div {win}) * w + bj * {win} + o % {win}) * c + o div {win * win}"
    vec = F.expr(f"transform(sequence(0, c * {win * win} - 1), o -> cast(data[{at}] as double))")
    return grid.select("frame_id", F.col("bi").cast("int").alias("bi"), F.col("bj").cast("int").alias("bj"), vec.alias("vec"))


def fold(blocks: DataFrame, win: int, h: int, w: int, c: int = 1) -> DataFrame:
    """The exact inverse of unfold: frames from their blocks, one aggregation by frame."""
    nb = w // win
    by_frame = blocks.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct((F.col("bi") * nb + F.col("bj")).alias("at"), "vec"))).alias("bs"))
    p_row, p_col, ch = f"(p div {w * c})", f"((p div {c}) % {w})", f"(p % {c})"
    value = f"cast(bs[({p_row} div {win}) * {nb} + {p_col} div {win}].vec[{ch} * {win * win} + ({p_row} % {win}) * {win} + {p_col} % {win}] as float)"
    return by_frame.select("frame_id", F.lit(h).alias("res"), F.lit(h).alias("h"), F.lit(w).alias("w"), F.lit(c).alias("c"), F.expr(f"transform(sequence(0, {h * w * c - 1}), p -> {value})").alias("data"))


def numpy_frames(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(frame_id, h x w x c array) of each row of a batch of frames."""
    for i, h, w, c, d in zip(*[batch.column(n).to_pylist() for n in ("frame_id", "h", "w", "c")], batch.column("data")):
        yield i, d.values.to_numpy(zero_copy_only=False).reshape(h, w, c)


def frame_batch(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    shape = [r[1].shape for r in rows]
    flat = pa.array([r[1].astype(np.float32).ravel() for r in rows], pa.list_(pa.float32()))
    columns = [pa.array([r[0] for r in rows], pa.int64())] + [pa.array([s[k] for s in shape], pa.int32()) for k in (0, 0, 1, 2)]
    return pa.RecordBatch.from_arrays([*columns, flat], names=["frame_id", "res", "h", "w", "c", "data"])


def map_frames(frames: DataFrame, fn) -> DataFrame:
    """frames with fn(h x w x c array) -> array applied to each, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield frame_batch([(i, fn(x)) for i, x in numpy_frames(batch)])

    return frames.mapInArrow(run, FRAMES)


def _pad(x: np.ndarray, halo: int, pad: str) -> np.ndarray:
    mode = {"reflect": "reflect", "zeros": "constant", "symmetric": "symmetric"}[pad]
    return np.pad(x, ((halo, halo), (halo, halo), (0, 0)), mode)


def unfold_overlapping(frames: DataFrame, block: int, halo: int, pad: str = "reflect") -> DataFrame:
    """Blocks with a halo of neighbouring pixels, values row by row with channels innermost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, x in numpy_frames(batch):
                padded, side = _pad(x, halo, pad), block + 2 * halo
                rows += [(i, r, s, padded[r * block : r * block + side, s * block : s * block + side].astype(np.float64).ravel()) for r in range(x.shape[0] // block) for s in range(x.shape[1] // block)]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())))], names=["frame_id", "bi", "bj", "vec"])

    return frames.mapInArrow(run, "frame_id long, bi int, bj int, vec array<double>")


def fold_overlapping(blocks: DataFrame, block: int, halo: int, h: int, w: int, c: int = 1) -> DataFrame:
    """Frames from the centres of blocks with a halo."""
    side = block + 2 * halo
    centre = F.expr(f"transform(sequence(0, {c * block * block - 1}), o -> vec[(({halo} + (o % {block * block}) div {block}) * {side} + {halo} + o % {block}) * {c} + o div {block * block}])")
    return fold(blocks.withColumn("vec", centre), block, h, w, c)


def crop_origins(frames: DataFrame, size: int, stride: int) -> DataFrame:
    """(frame_id, i, j) of the full size x size crops at the stride."""
    grid = frames.select("frame_id", "h", "w", F.explode(F.expr(f"sequence(0, h - 1, {stride})")).alias("i")).where(f"i + {size} <= h")
    return grid.select("frame_id", "w", "i", F.explode(F.expr(f"sequence(0, w - 1, {stride})")).alias("j")).where(f"j + {size} <= w").select("frame_id", "i", "j")


def crops(frames: DataFrame, size: int, stride: int) -> DataFrame:
    """Full crops as frames, numbered by frame and place."""
    grid = frames.select("*", F.explode(F.expr(f"sequence(0, h - 1, {stride})")).alias("i")).where(f"i + {size} <= h").select("*", F.explode(F.expr(f"sequence(0, w - 1, {stride})")).alias("j")).where(f"j + {size} <= w")
    data = F.expr(f"transform(sequence(0, {size * size} * c - 1), p -> data[((i + p div ({size} * c)) * w + j) * c + p % ({size} * c)])")
    number = F.xxhash64("frame_id", "i", "j")
    return grid.select(number.alias("frame_id"), F.lit(size).alias("res"), F.lit(size).alias("h"), F.lit(size).alias("w"), "c", data.alias("data"))


def batch_ids(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows in batches of n by order, the short tail kept as a batch of its own.

    Ranks come from counts of range partitions, so no task sorts the whole table."""
    parts = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    ranked = parts.withColumn("_rank", rank)
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_n"), F.min(order).alias("_low"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_before", before).select("_part", "_before")
    return ranked.join(starts, "_part").withColumn("batch", F.expr(f"(_before + _rank - 1) div {n}")).drop("_part", "_rank", "_before")


def pool_2x2(px: DataFrame) -> DataFrame:
    """Means of 2 x 2 pixels per channel."""
    return px.groupBy("frame_id", F.expr("i div 2").cast("int").alias("i"), F.expr("j div 2").cast("int").alias("j"), "ch").agg(F.avg("x").alias("x"))


def remove_mean(px: DataFrame) -> DataFrame:
    """x less its frame's mean rounded half to even, and that mean."""
    mean = F.rint(F.avg("x").over(Window.partitionBy("frame_id")))
    return px.withColumn("mean", mean).withColumn("x", F.col("x") - F.col("mean"))


def add_mean(px: DataFrame) -> DataFrame:
    return px.withColumn("x", F.col("x") + F.col("mean")).drop("mean")


def prefix(vec: Column | str, n: int) -> Column:
    """The first n dimensions; all for -1."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return v if n < 0 else F.slice(v, 1, n)


def truncate(vec: str, t: int) -> Column:
    """Dimensions from t on become zero."""
    return F.transform(F.col(vec), lambda x, i: F.when(i < t, x).otherwise(F.lit(0.0)))


def residual(a: Column, b: Column) -> Column:
    """a - b over b's dimensions; a's further dimensions stay."""
    return F.transform(a, lambda x, i: x - F.coalesce(F.get(b, i), F.lit(0.0)))


def mean_square(v: Column, area: int | None = None) -> Column:
    """Squares summed and divided by the width, or by area."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / (F.size(v) if area is None else F.lit(area))


def distortions(df: DataFrame, x: str = "vec", ix: str = "ivec", area: int | None = None) -> DataFrame:
    """mse, omse and dmse = omse - mse of each block and its reconstruction.

    Of coefficients of an orthonormal transform, area is the number of values of the frame a block
    stands for: energies are the same in both domains, so that gives the frame's own mean squares."""
    out = df.withColumn("mse", mean_square(F.zip_with(x, ix, lambda a, b: a - b), area)).withColumn("omse", mean_square(F.col(x), area))
    return out.withColumn("dmse", F.col("omse") - F.col("mse"))


def skip_mask(df: DataFrame, th: float | Column) -> DataFrame:
    return df.withColumn("coded", F.col("dmse") > th)


def zero_skipped(df: DataFrame, vec: str = "ivec") -> DataFrame:
    return df.withColumn(vec, F.when(F.col("coded"), F.col(vec)).otherwise(F.transform(vec, lambda x: x * 0.0)))


def same_shape(frames: DataFrame, h: int, w: int, c: int) -> DataFrame:
    return frames.where((F.col("h") == h) & (F.col("w") == w) & (F.col("c") == c))


def remap(df: DataFrame, col: str, mapping: DataFrame, source: str, target: str, default: int | None = None) -> DataFrame:
    """col through a table of pairs; what has none becomes default (null if none is given)."""
    pairs = mapping.select(F.col(source).alias(col), F.col(target).alias("_to"))
    joined = df.join(pairs, col, "left")
    return joined.withColumn(col, F.coalesce("_to", F.lit(default))).drop("_to")


def resolution_loss(fine: DataFrame, coarse: DataFrame, coarse_residual: DataFrame, upsample) -> DataFrame:
    """fine - upsample(coarse - coarse_residual), matched by frame_id."""
    side = lambda d, n: d.select("frame_id", F.col("data").alias(n))
    base = coarse.join(side(coarse_residual, "r"), "frame_id").withColumn("data", F.zip_with("data", "r", lambda a, b: a - b)).drop("r")
    return fine.join(side(upsample(base), "u"), "frame_id").withColumn("data", F.zip_with("data", "u", lambda a, b: (a - b).cast("float"))).drop("u")
