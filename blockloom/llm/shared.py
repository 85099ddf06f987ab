"""Folders, written tables and column handling that the operators here have in common.

Intermediate tables are written to the folder named by ``spark.checkpoint.dir``, which every
executor can reach, so a lost executor never takes a result with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.schema import shared_dir

BATCH_BYTES = 8 << 20
"""Bytes of one batch of rows that goes to a Python worker."""
NULL_ID = (1 << 63) - 1
"""Stands for a null id inside packed arrays; it sorts after every other id."""


_SCOPES: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/blockloom/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside are deleted at its end; results are read from them lazily, so
    they must be used or written elsewhere before.  Without a scope the tables stay."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python in batches of at most BATCH_BYTES.

    A batch stands in the JVM, on its way and in the worker at once, once for each running task; the
    default of 64 MB takes more of an executor than the operators' own state."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key, "67108864b")
    if size in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))


def written(df: DataFrame, name: str, gather: bool = False) -> DataFrame:
    """df as a table written to the shared folder: later plans start from its files.

    gather: df is little that wide tasks leave; adaptive execution puts it into as many files as its own
    size asks for, not one a task.  Each file costs requests to the store, and on a local folder without
    Hadoop's native library three processes that the executor starts."""
    path = new_path(df.sparkSession, name)
    schema = df.schema
    (df.hint("rebalance") if gather else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def two_columns(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(_id, _text, carried...) of docs; whatever else docs has, however it is named, is left out.

    Ids are whole numbers, as ties go to the smaller one; another type is an error before any work is
    done, and not one of a row in the middle of a job."""
    bound_batches(docs.sparkSession)
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    kind = docs.select(q(id_col)).schema[0].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)) and not (isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision <= 18):
        raise TypeError(f"{id_col} must be a whole number, not {kind.simpleString()}: number the rows first")
    return docs.select(q(id_col).cast("long").alias("_id"), q(text_col).cast("string").alias("_text"), *[q(c).alias("_c" + c) for c in carry])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
