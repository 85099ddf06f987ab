"""Principal components and channel-wise multi-level transforms.

Covariances are aggregates over rows, partial sums per partition; only d x d matrices reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DIM = 4_096
"""Width of vectors whose covariance may come to the driver."""


@dataclass(frozen=True)
class Kernel:
    """Rows are components by falling variance; applied without taking the mean away."""

    matrix: np.ndarray
    variances: np.ndarray
    mean: np.ndarray

    def quantised(self) -> Kernel:
        m = int(127 / np.abs(self.matrix).max()) - 1
        return Kernel(np.round(self.matrix * m) / m, self.variances, self.mean)


def vectors(column: pa.ListArray) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def as_column(x: np.ndarray) -> pa.ListArray:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def moments(df: DataFrame, vec: str = "vec", by: str | None = None) -> dict:
    """Count, sum and sum of products of the vectors, by key (None alone without one)."""
    fields = "k long, n long, s array<double>, p array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            x = vectors(batch.column("v"))
            keys = batch.column("k").to_numpy()
            for k in np.unique(keys).tolist():
                part = x[keys == k]
                have = sums.setdefault(k, [0, 0.0, 0.0])
                have[0] += len(part)
                have[1] = have[1] + part.sum(0)
                have[2] = have[2] + part.T @ part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v[0] for v in sums.values()]), pa.array([v[1] for v in sums.values()], pa.list_(pa.float64())), pa.array([v[2].ravel() for v in sums.values()], pa.list_(pa.float64()))], names=["k", "n", "s", "p"])

    source = df.select((F.col(by).cast("long") if by else F.lit(0).cast("long")).alias("k"), F.col(vec).cast("array<double>").alias("v"))
    parts = source.mapInArrow(partial, fields)
    s = parts.select("k", "n", F.posexplode("s").alias("i", "x")).groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    dims = s.groupBy("k").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    p = parts.select("k", F.posexplode("p").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    out = {}
    for r in dims.join(p, "k").toLocalIterator():
        mean = np.array([v.x for v in r.s]) / r.n
        if len(mean) > MAX_DIM:
            raise ValueError(f"vectors of more than {MAX_DIM} values")
        out[r.k if by else None] = (r.n, mean, np.array([v.x for v in r.p]).reshape(len(mean), -1))
    return out


def covariance(df: DataFrame, dims: int, vec: str = "vec") -> DataFrame:
    """(a, b, cov) over the first dims dimensions, population covariance, as one SQL aggregate."""
    pairs = [(a, b) for a in range(dims) for b in range(a, dims)]
    x = [F.get(F.col(vec), F.lit(i)).cast("double").alias(f"x{i}") for i in range(dims)]
    one = df.select(*x).agg(*[F.covar_pop(f"x{a}", f"x{b}").alias(f"c{a}_{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{a}_{b}").alias("cov")) for a, b in pairs]))
    return one.select(rows.alias("r")).select("r.*")


def kernel_of(n: int, mean: np.ndarray, products: np.ndarray) -> Kernel:
    values, columns = np.linalg.eigh(products / n - np.outer(mean, mean))
    order = np.argsort(values)[::-1]
    rows = columns[:, order].T
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])  # the largest entry is positive
    return Kernel(rows * signs[:, None], np.maximum(values[order], 0), mean)


def pca_fit(df: DataFrame, vec: str = "vec", quantise: bool = False) -> Kernel:
    kernel = kernel_of(*moments(df, vec)[None])
    return kernel.quantised() if quantise else kernel


def apply_matrix(df: DataFrame, matrix: np.ndarray, vec: str = "vec") -> DataFrame:
    """vec times the transposed matrix, in batches."""
    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == vec else f.dataType.simpleString()}" for f in df.schema)
    at = df.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = as_column(vectors(columns[at]) @ matrix.T) if batch.num_rows else pa.array([], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, schema)


def pca_transform(df: DataFrame, kernel: Kernel, vec: str = "vec") -> DataFrame:
    return apply_matrix(df, kernel.matrix, vec)


def pca_inverse(df: DataFrame, kernel: Kernel, vec: str = "vec") -> DataFrame:
    """Exact if the kernel has all components."""
    return apply_matrix(df, kernel.matrix.T, vec)


@dataclass(frozen=True)
class ChannelTransform:
    """Kernels of each level: one at level 0, one per descending channel further on."""

    windows: tuple[int, ...]
    split: int
    kernels: tuple[tuple[Kernel, ...], ...]
    channels: int

    def descending(self, level: int) -> int:
        """Channels of a level that go one level deeper."""
        width = self.windows[0] ** 2 * self.channels if level == 0 else self.descending(level - 1) * self.windows[level] ** 2
        return 0 if level == len(self.windows) - 1 else min(self.split + 1, width)

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Of an h x w x c image, each level's grid of the channels that stop there."""
        out = []
        for level, win in enumerate(self.windows):
            x = np.concatenate([grid(part, win) @ k.matrix.T for part, k in zip(_parts(x, level), self.kernels[level])], 2)
            keep = self.descending(level)
            out.append(x[:, :, keep:])
            x = x[:, :, :keep]
        return out

    def inverse_level(self, deep: np.ndarray, level: int) -> np.ndarray:
        """One level up: the full grid of a level to the image it was made from."""
        win, step, parts = self.windows[level], deep.shape[2] // len(self.kernels[level]), []
        for k, kernel in enumerate(self.kernels[level]):
            parts.append(ungrid(deep[:, :, k * step : (k + 1) * step] @ kernel.matrix, win))
        return np.concatenate(parts, 2)

    def inverse(self, levels: list[np.ndarray], down_to: int = 0, only_deepest: bool = False) -> np.ndarray:
        """The image of all levels, or of the deepest alone with the other bands at zero."""
        deep = levels[-1]
        for level in range(len(levels) - 1, down_to - 1, -1):
            image = self.inverse_level(deep, level)
            if level:
                rest = levels[level - 1]
                deep = np.concatenate([image, np.zeros_like(rest) if only_deepest else rest], 2)
        return image


def _parts(x: np.ndarray, level: int) -> list[np.ndarray]:
    return [x] if level == 0 else [x[:, :, i : i + 1] for i in range(x.shape[2])]


def grid(x: np.ndarray, win: int) -> np.ndarray:
    """h/win x w/win x (c win win) blocks of an image, channel-major."""
    h, w, c = x.shape
    return x.reshape(h // win, win, w // win, win, c).transpose(0, 2, 4, 1, 3).reshape(h // win, w // win, -1)


def ungrid(b: np.ndarray, win: int) -> np.ndarray:
    h, w, d = b.shape
    c = d // win**2
    return b.reshape(h, w, c, win, win).transpose(0, 3, 1, 4, 2).reshape(h * win, w * win, c)


def channel_fit(frames: DataFrame, windows: tuple[int, ...], split: int = 0) -> ChannelTransform:
    """Fits level after level, each on all frames: one aggregate of moments by channel per level."""
    from blockloom.operators.layout import numpy_frames

    channels = frames.select("c").first()[0]
    fitted = ChannelTransform(tuple(windows), split, (), channels)
    for level in range(len(windows)):
        done = fitted

        def samples(batches, done=done, level=level):
            for batch in batches:
                keys, rows = [], []
                for _, x in numpy_frames(batch):
                    x = x.astype(np.float64)
                    for i in range(level):
                        x = np.concatenate([grid(p, done.windows[i]) @ k.matrix.T for p, k in zip(_parts(x, i), done.kernels[i])], 2)[:, :, : done.descending(i)]
                    for k, part in enumerate(_parts(x, level)):
                        g = grid(part, done.windows[level])
                        rows.append(g.reshape(-1, g.shape[2]))
                        keys.append(np.full(len(rows[-1]), k))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), as_column(np.concatenate(rows))], names=["channel", "vec"])

        found = moments(frames.mapInArrow(samples, "channel long, vec array<double>"), "vec", "channel")
        fitted = ChannelTransform(done.windows, split, (*done.kernels, tuple(kernel_of(*found[k]) for k in sorted(found))), channels)
    return fitted


def level_batch(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    """(frame, level, h x w x d array) as one batch with a row for each place."""
    at = [np.indices(g.shape[:2]).reshape(2, -1).astype(np.int32) for _, _, g in rows]
    n = [a.shape[1] for a in at]
    column = lambda k, kind: pa.array(np.repeat([r[k] for r in rows], n), kind)
    places = np.concatenate(at, 1) if at else np.zeros((2, 0), np.int32)
    vecs = pa.concat_arrays([as_column(g.reshape(m, -1)) for (_, _, g), m in zip(rows, n)]) if rows else pa.array([], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([column(0, pa.int64()), column(1, pa.int32()), pa.array(places[0]), pa.array(places[1]), vecs], names=["frame_id", "level", "bi", "bj", "vec"])


def channel_transform(frames: DataFrame, transform: ChannelTransform) -> DataFrame:
    """(frame_id, level, bi, bj, vec): the channels of each level that stop there."""
    from blockloom.operators.layout import numpy_frames

    def run(batches):
        for batch in batches:
            yield level_batch([(i, level, g) for i, x in numpy_frames(batch) for level, g in enumerate(transform.forward(x.astype(np.float64)))])

    return frames.mapInArrow(run, "frame_id long, level int, bi int, bj int, vec array<double>")


def channel_inverse(coeffs: DataFrame, transform: ChannelTransform, only_deepest: bool = False) -> DataFrame:
    """Frames from the coefficients; a frame's levels meet in one group, as large as the frame."""
    from blockloom.operators.layout import frame_batch
    from blockloom.schema import FRAMES

    def run(group: pa.Table) -> pa.Table:
        level, bi, bj = (group.column(n).to_numpy() for n in ("level", "bi", "bj"))
        vecs = group.column("vec").combine_chunks()
        levels = []
        for k in range(len(transform.windows)):
            at = np.flatnonzero(level == k)
            at = at[np.lexsort((bj[at], bi[at]))]
            levels.append(vectors(vecs.take(pa.array(at))).reshape(bi[at].max() + 1, bj[at].max() + 1, -1))
        return pa.Table.from_batches([frame_batch([(group.column("frame_id")[0].as_py(), transform.inverse(levels, 0, only_deepest))])])

    return coeffs.groupBy("frame_id").applyInArrow(run, FRAMES)


def per_frame_pca(frames: DataFrame, inverse: bool = False, quantise: bool = False) -> DataFrame:
    """Components of each frame's own pixels over channels: data becomes them, kernel is the matrix."""
    from blockloom.operators.layout import numpy_frames

    def run(batches):
        for batch in batches:
            rows, kernels = [], []
            for i, x in numpy_frames(batch):
                v = x.reshape(-1, x.shape[2]).astype(np.float64)
                kernel = kernel_of(len(v), v.mean(0), v.T @ v)
                kernel = kernel.quantised() if quantise else kernel
                rows.append((i, (v @ kernel.matrix.T).reshape(x.shape)))
                kernels.append(kernel.matrix.ravel())
            from blockloom.operators.layout import frame_batch

            out = frame_batch(rows)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(kernels, pa.list_(pa.float64()))], names=[*out.schema.names, "kernel"])

    def back(batches):
        from blockloom.operators.layout import frame_batch

        for batch in batches:
            kernels = batch.column("kernel").to_pylist()
            yield frame_batch([(i, (x.reshape(-1, x.shape[2]) @ np.array(k).reshape(x.shape[2], -1)).reshape(x.shape)) for (i, x), k in zip(numpy_frames(batch), kernels)])

    from blockloom.schema import FRAMES

    return frames.mapInArrow(back, FRAMES) if inverse else frames.mapInArrow(run, FRAMES + ", kernel array<double>")


def per_frame_channel_transform(frames: DataFrame, windows: tuple[int, ...], split: int = 0) -> DataFrame:
    """The multi-level transform fitted on each frame by itself: (frame_id, level, bi, bj, vec)."""
    from blockloom.operators.layout import numpy_frames

    def run(batches):
        for batch in batches:
            rows = []
            for i, x in numpy_frames(batch):
                t, y = ChannelTransform(tuple(windows), split, (), x.shape[2]), x.astype(np.float64)
                for level, win in enumerate(windows):
                    samples = [grid(p, win).reshape(-1, p.shape[2] * win * win) for p in _parts(y, level)]
                    t = ChannelTransform(t.windows, split, (*t.kernels, tuple(kernel_of(len(s), s.mean(0), s.T @ s) for s in samples)), x.shape[2])
                    y = np.concatenate([grid(p, win) @ k.matrix.T for p, k in zip(_parts(y, level), t.kernels[level])], 2)[:, :, : t.descending(level)]
                rows += [(i, level, g) for level, g in enumerate(t.forward(x.astype(np.float64)))]
            yield level_batch(rows)

    return frames.mapInArrow(run, "frame_id long, level int, bi int, bj int, vec array<double>")
