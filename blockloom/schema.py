"""Tables of the engine and its configuration.

frames: one row per image, data row-major (h, w, c).  blocks: one row per block of a frame, vec channel-major
(c, row, column).  Layouts are fixed by columns, never inferred from array widths.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "frame_id long, res int, h int, w int, c int, data array<float>"
BLOCKS = "frame_id long, bi int, bj int, vec array<double>"
CODEBOOK = "cid int, centroid array<double>"
RD_POINTS = "model string, bpp double, mse double"
RAW_BLOCKS = "frame_id long, bi int, bj int, vec array<float>"


def session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session with the settings the engine's queries expect."""
    conf = {"spark.sql.shuffle.partitions": shuffle_partitions, "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false"}
    builder = SparkSession.builder.master(master).appName("blockloom")
    for k, v in conf.items():
        builder = builder.config(k, str(v))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.  A session that
    names none gets one of its own only if all its tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="blockloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later plans start from its files, whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/blockloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def check_dim(df: DataFrame, col: str, dim: int) -> DataFrame:
    """df, failing at the first row whose vector is not dim wide."""
    bad = F.raise_error(F.concat(F.lit(f"{col} must have {dim} values, not "), F.size(col).cast("string")))
    return df.withColumn(col, F.when(F.size(col) == dim, F.col(col)).otherwise(bad))


@dataclass(frozen=True)
class LevelConfig:
    clusters: tuple[int, ...]
    dims: tuple[int, ...]


@dataclass(frozen=True)
class ResolutionConfig:
    resolution: int
    windows: tuple[int, ...]
    transform_split: int
    lagrange: float
    levels: tuple[LevelConfig, ...] = field(default=())


def load_config(path: str) -> list[ResolutionConfig]:
    """Per-resolution settings from JSON: levels finest first, as their windows are."""
    with open(path) as f:
        raw = json.load(f)
    out = []
    for res in raw["resolution_list"]:
        r = raw[str(res)]
        levels = tuple(LevelConfig(tuple(r[f"n_cluster_list-{n}"]), tuple(r[f"n_dim_list-{n}"])) for n in r["level_list"])
        out.append(ResolutionConfig(int(r["id"]), tuple(r["win_list"]), int(r["transform_split"]), float(r["Lagrange_multip"]), levels))
    return out
