"""Frames in and out: image folders, raw planar files, codebook files and batches.

Readers use Spark's binaryFile source, so they see any file system Spark does; writers go through
Spark's own sinks.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from blockloom.operators.layout import batch_ids, crops, frame_batch, numpy_frames
from blockloom.operators.resample import pyramid
from blockloom.schema import FRAMES


def decode_image(data: bytes) -> np.ndarray | None:
    """h x w x 3 blue-green-red values of a portable pixmap or graymap or an .npy array; of other
    formats where an imaging library is installed; None for what can't be read.  A PNG or JPEG file
    without that library is an error, not a file that can't be read."""
    head = re.match(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    try:
        if head:
            w, h, c = int(head[2]), int(head[3]), 3 if head[1] == b"P6" else 1
            x = np.frombuffer(data, ">u2" if int(head[4]) > 255 else np.uint8, h * w * c, head.end()).reshape(h, w, c)
        elif data[:6] == b"\x93NUMPY":
            x = np.load(io.BytesIO(data), allow_pickle=False)
            x = x[:, :, None] if x.ndim == 2 else x
        else:
            try:
                from PIL import Image
            except ImportError:
                if data.startswith((b"\x89PNG", b"\xff\xd8\xff")):
                    raise
                return None
            x = np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except (ValueError, OSError):
        return None
    return np.repeat(x, 3, 2) if x.shape[2] == 1 else x[:, :, ::-1]


def _to_color(x: np.ndarray, color: str) -> np.ndarray:
    from blockloom.functions.color import TO_YUV

    if color == "BGR":
        return x
    rgb = x[:, :, ::-1].astype(np.float64)
    return rgb if color == "RGB" else (rgb - 127) @ np.array(TO_YUV).T


def read_images(spark: SparkSession, path: str | list[str], color: str = "BGR", limit: int = -1, seed: int | None = None, names: list[str] | None = None) -> DataFrame:
    """Images below a folder as frames; files that can't be decoded are left out.

    seed shuffles before limit takes its first (-1 and 0: all); names keeps the files so called.
    frame_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    if names is not None:
        files = files.where(F.element_at(F.split("path", "/"), -1).isin(names))
    if limit > 0:
        files = files.orderBy(F.rand(seed) if seed is not None else F.col("path")).limit(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, decode_image(b.as_py())) for i, b in zip(batch.column("id").to_pylist(), batch.column("content"))]
            rows = [(i, _to_color(x, color)) for i, x in rows if x is not None]
            if rows:
                yield frame_batch(rows)

    return files.select(F.xxhash64("path").alias("id"), "content").mapInArrow(run, FRAMES)


def load_sets(spark: SparkSession, folders: dict[str, str], sizes: list[int], limit: int = -1, color: str = "BGR") -> DataFrame:
    """Named folders with all their sizes: frames with the set's name."""
    out = None
    for name, path in sorted(folders.items()):
        part = pyramid(read_images(spark, path, color, limit), sizes).withColumn("set", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def patch_pyramid(frames: DataFrame, sizes: list[int], stride: int) -> DataFrame:
    """Full crops of the largest size, and each of them at all sizes from there down."""
    return pyramid(crops(frames, max(sizes), stride), sizes)


def write_frames(frames: DataFrame, path: str, per_file: int = 0, mode: str = "error") -> None:
    """Parquet by resolution, at most per_file frames a file; the last file may hold fewer."""
    writer = frames.write.mode(mode).partitionBy("res")
    (writer.option("maxRecordsPerFile", per_file) if per_file else writer).parquet(path)


def read_frames(spark: SparkSession, path: str, res: int | None = None) -> DataFrame:
    frames = spark.read.schema(FRAMES).parquet(path)
    return frames if res is None else frames.where(F.col("res") == res)


def _planar(x: np.ndarray, kind: str) -> bytes:
    flat = np.moveaxis(np.round(x), 2, 0)
    return flat.astype("<i2").tobytes() if kind == "SHORT" else np.clip(flat, 0, 255).astype(np.uint8).tobytes()


def to_raw(frames: DataFrame, kind: str = "SHORT", offset: int = 0) -> DataFrame:
    """(frame_id, raw): each frame's planes, little-endian 16-bit or unsigned 8-bit after offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, _planar(x.astype(np.float64) + offset, kind)) for i, x in numpy_frames(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["frame_id", "raw"])

    return frames.mapInArrow(run, "frame_id long, raw binary")


class _RawWriter(DataSourceWriter):
    """Each task writes one file of its frames, in the order they come; a file counts once it has its
    final name, which a task that is run again takes anew."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows):
        fs, base = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}.raw"
        draft = f"{base}/_{uuid.uuid4().hex}"
        n = 0
        with fs.open_output_stream(draft) as out:
            for row in rows:
                out.write(bytes(row.raw))
                n += 1
        if n:
            fs.move(draft, f"{base}/{name}")
        else:
            fs.delete_file(draft)
        return WriterCommitMessage()


class RawFrames(DataSource):
    """Sink of (frame_id, raw) rows: folders of raw planar files without a header."""

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def writer(self, schema, overwrite):
        return _RawWriter(self.options["path"], overwrite)


def write_raw(frames: DataFrame, path: str, kind: str = "SHORT", offset: int = 0, files: int = 1) -> None:
    """Frames as raw planar files below path, by frame_id: each file holds a range of them."""
    frames.sparkSession.dataSource.register(RawFrames)
    ordered = frames.repartitionByRange(files, "frame_id").sortWithinPartitions("frame_id")
    to_raw(ordered, kind, offset).write.format("raw_frames").mode("append").option("path", path).save()


def from_raw(raw: DataFrame, size: int, channels: int = 3, kind: str = "SHORT", offset: int = 0) -> DataFrame:
    """Frames of (frame_id, raw) rows that hold one or more frames each, numbered on within a row."""
    width = size * size * channels * (2 if kind == "SHORT" else 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, data in zip(batch.column("frame_id").to_pylist(), batch.column("raw").to_pylist()):
                x = np.frombuffer(data[: len(data) // width * width], "<i2" if kind == "SHORT" else np.uint8).reshape(-1, channels, size, size)
                rows += [(i + k, np.moveaxis(f, 0, 2).astype(np.float32) - offset) for k, f in enumerate(x)]
            if rows:
                yield frame_batch(rows)

    return raw.select("frame_id", "raw").mapInArrow(run, FRAMES)


def read_raw(spark: SparkSession, path: str, size: int, channels: int = 3, kind: str = "SHORT", offset: int = 0, stride: int = 1 << 32) -> DataFrame:
    """Frames of raw planar files; a file's frames are numbered from its rank by path times stride."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    ranks = batch_ids(files.select("path"), "path", 1).withColumnRenamed("batch", "rank")
    numbered = files.join(ranks, "path")
    return from_raw(numbered.select((F.col("rank").cast("long") * stride).alias("frame_id"), F.col("content").alias("raw")), size, channels, kind, offset)


def parse_codebook(data: bytes, k: int, win: int, kind: str = "SHORT", channels: int = 3) -> np.ndarray:
    """k centroids of a state file: a header, then rows filled up with zeros to 32 bytes."""
    dim, width = win * win * channels, 2 if kind == "SHORT" else 1
    row = 32 * -(-dim * width // 32) // width
    head = (8 + 2 * width) * row + 16
    values = np.frombuffer(data, "<i2" if width == 2 else np.uint8, row * k, head).reshape(k, row)
    if values[:, dim:].any():
        raise ValueError("the padding of a codebook row is not zero")
    return values[:, :dim].astype(np.float64)


def read_codebook(spark: SparkSession, path: str, k: int, win: int, kind: str = "SHORT", channels: int = 3) -> DataFrame:
    """(cid, centroid) of a state file."""
    from blockloom.operators.cluster import codebook_frame

    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    return codebook_frame(spark, parse_codebook(bytes(content), k, win, kind, channels))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) without reading contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")
