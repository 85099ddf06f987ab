"""Blocks of documents: the unit that moves between the passes of the operators on repeated text.

A block is a few MB of neighbouring rows of one input partition, held as one compressed Arrow batch.
Passes exchange compact arrays keyed by (block, shard of the hash space): a key that occurs a
million times in a block is sent once, so no key, however frequent, makes one task large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import kernels as K
from blockloom.llm.shared import NULL_ID, shuffle_width, written

BLOCK_BYTES = 2 << 20
SHARD_KEYS = 2_000_000
"""Keys of one shard of the hash space, at most about as many: it bounds a task's memory."""


def slices(batch: pa.RecordBatch, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about block_bytes of text, at least a row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
    offs = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    i = 0
    while i < batch.num_rows:
        j = min(max(i + 1, int(np.searchsorted(offs, offs[i] + block_bytes, "right")) - 1), i + 20_000)
        yield batch.slice(i, j - i)
        i = j


def pack(docs: DataFrame, count: Callable[[pa.RecordBatch], int], name: str) -> DataFrame:
    """Writes (block long, n_keys long, blob binary) for (_id, _text, ...); count gives a block's keys."""
    block_bytes = BLOCK_BYTES

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        for batch in batches:
            for part in slices(batch, block_bytes):
                sink = pa.BufferOutputStream()
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema)
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "n_keys": pa.array([int(count(part))], pa.int64()), "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
                number += 1
        K.release()

    return written(docs.mapInArrow(packed, "block long, n_keys long, blob binary"), name)


def unpack(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as stream:
        return pa.Table.from_batches(list(stream), stream.schema).combine_chunks().to_batches()[0]


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def shards_for(blocks: DataFrame) -> tuple[int, int]:
    """Shards of the hash space for all keys of the blocks, and the number of keys."""
    keys = blocks.agg(F.sum("n_keys")).first()[0] or 0
    return max(1, min(shuffle_width(blocks.sparkSession), keys // 20_000 + 1), -(-keys // SHARD_KEYS)), keys


def cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of the ascending 64-bit keys begins, and the end."""
    edges = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def with_masks(blocks: DataFrame, masks: DataFrame) -> DataFrame:
    """Each block with the answers that came back for it: (kind, shard, mask) in one array."""
    gathered = masks.groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "mask")).alias("masks"))
    return blocks.join(gathered, "block", "left")


def mask_of(masks: list | None, kind: str, edges: np.ndarray) -> np.ndarray:
    """The answers of one kind put together again over all shards; False where none came."""
    out = np.zeros(edges[-1], bool)
    for m in masks or ():
        if m["kind"] == kind:
            a, b = edges[m["shard"]], edges[m["shard"] + 1]
            out[a:b] = K.unpack_bits(m["mask"], b - a)
    return out
