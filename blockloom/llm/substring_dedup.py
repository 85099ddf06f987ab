"""Substring dedup: a count-min prefilter over word windows, then exact grouping of what it flags.

Pass 1: every block (a piece of one input partition) sends the distinct fingerprints of its windows
to the shards of the fingerprint space.  A shard adds the blocks' sketches into one count-min sketch
(``depth`` rows of saturating counters, their width following the shard's keys) and answers for each
fingerprint whether its estimated number of blocks and occurrences is two or more.  A sketch never
underestimates, so no repeated window is lost; the fingerprint's width follows the number of windows.
Pass 2: only flagged windows are grouped, by two independent 64-bit hashes of their words, and each
group's smallest document id decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockloom.llm import blocks as B
from blockloom.llm import kernels as K
from blockloom.llm.shared import two_columns, written

_U = np.uint64


def sketch_width(n: int) -> int:
    return 1 << max(10, int(4 * max(n, 1) - 1).bit_length())


def sketch_cells(keys: np.ndarray, width: int, row: int) -> np.ndarray:
    """The cell of each key in one row of a sketch of a power-of-two width."""
    odd = _U(0x9E3779B97F4A7C15 if row == 0 else (0xC2B2AE3D27D4EB4F + 2 * row) & (1 << 64) - 1)
    return ((keys * odd) >> _U(64 - (width.bit_length() - 1))).astype(np.int64)


def add_sketches(parts: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """Sum of the partial sketches of lists of distinct keys; counters stop at 2."""
    width = sketch_width(sum(map(len, parts)))
    rows = []
    for row in range(depth):
        total = np.zeros(width, np.uint32)
        for keys in parts:
            np.add.at(total, sketch_cells(keys, width, row), 1)
        rows.append(np.minimum(total, 2).astype(np.uint8))
    return rows


def estimates(rows: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    return np.min([r[sketch_cells(keys, len(r), i)] for i, r in enumerate(rows)], axis=0)


def flag_repeated(blocks: DataFrame, keys_of, shards: int, n_keys: int, depth: int, name: str) -> DataFrame:
    """(block, kind, shard, mask): which of a block's distinct sorted keys may occur elsewhere.

    keys_of(batch) gives the 64-bit hashes of a block; they are cut to log2(n_keys) + 8 bits."""
    bits = min(64, max(24, n_keys.bit_length() + 8))
    sent = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("block").to_pylist(), batch.column("blob")):
                keys = K.distinct(keys_of(B.unpack(blob.as_py())) >> _U(64 - bits) << _U(64 - bits))
                edges = B.cuts(keys, shards)
                yield B.emit([(s, number, K.pack_sorted(keys[a:b] >> _U(64 - bits))) for s, (a, b) in enumerate(zip(edges, edges[1:])) if b > a], sent)
        K.release()

    answer = pa.schema([("block", pa.int64()), ("kind", pa.string()), ("shard", pa.int32()), ("mask", pa.binary())])

    def judge(group: pa.Table) -> pa.Table:
        parts = [K.unpack_sorted(x) << _U(64 - bits) for x in group.column("keys").to_pylist()]
        rows = add_sketches(parts, depth)
        masks = [estimates(rows, keys) >= 2 for keys in parts]
        shard = group.column("shard")[0].as_py()
        return pa.Table.from_batches([B.emit([(b, "first", shard, K.pack_bits(m)) for b, m in zip(group.column("block").to_pylist(), masks) if m.any()], answer)], schema=answer)

    return written(blocks.select("block", "blob").mapInArrow(send, "shard int, block long, keys binary").groupBy("shard").applyInArrow(judge, "block long, kind string, shard int, mask binary"), name)


def candidates(hashes: np.ndarray, masks: list | None, shards: int, n_keys: int) -> np.ndarray:
    """Which of a block's windows the prefilter flagged, or which occur twice in the block itself."""
    bits = min(64, max(24, n_keys.bit_length() + 8))
    cut = hashes >> _U(64 - bits) << _U(64 - bits)
    keys, inverse, n = np.unique(cut, return_inverse=True, return_counts=True)
    return (B.mask_of(masks, "first", B.cuts(keys, shards)) | (n > 1))[inverse]


class _Groups:
    """A block's flagged windows by two hashes, ascending, with the smallest document id of each."""

    def __init__(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray):
        order = np.lexsort((two, one))
        one, two, ids = one[order], two[order], ids[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        at = np.flatnonzero(new)
        self.one, self.two = one[at], two[at]
        self.least = np.minimum.reduceat(ids, at) if len(at) else ids
        self.group = np.empty(len(one), np.int64)
        self.group[order] = np.cumsum(new) - 1


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, depth: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes every word covered by a window of words that also starts in a document with a smaller id.

    Returns one row for each row of docs: id, the carried columns, n_words, n_removed (long),
    removed (array of [start, end) word ranges), kept_text (kept words joined by one space) and,
    where nothing was removed, the text as it was in full_text (else kept_text).

    Null or empty texts and texts shorter than a window keep all their words (none for null:
    kept_text is ''). Rows that repeat an id are one document's: windows they share are kept in both.
    A null id counts as the largest. Empty tables give empty results. Other columns are ignored.
    """
    source = two_columns(docs, id_col, text_col, carry)

    def parts(batch: pa.RecordBatch):
        data, offs = K.text_bytes(batch.column("_text"))
        starts, ends, first = K.words(data, offs, K.NOT_SPACE)
        return data, starts, ends, first

    def windows(batch: pa.RecordBatch, which: int = 0):
        data, starts, ends, first = parts(batch)
        return K.window_hashes(K.hash_words(data, starts, ends, which), first, window, which)

    def n_windows(batch: pa.RecordBatch) -> int:
        return int(np.maximum(np.diff(parts(batch)[3]) - window + 1, 0).sum())

    packed = B.pack(source, n_windows, "substring-blocks")
    shards, n_keys = B.shards_for(packed)
    first_masks = flag_repeated(packed, lambda b: windows(b)[0], shards, n_keys, depth, "substring-flags")

    def groups(batch: pa.RecordBatch, masks: list | None):
        one, at, doc = windows(batch)
        flagged = candidates(one, masks, shards, n_keys)
        two = windows(batch, 1)[0] if flagged.any() else one
        ids = B.ids_of(batch)[doc[flagged]]
        return _Groups(one[flagged], two[flagged], ids), at[flagged], ids

    sent = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("one", pa.binary()), ("two", pa.binary()), ("least", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob, masks in zip(batch.column("block").to_pylist(), batch.column("blob"), batch.column("masks")):
                g, _, _ = groups(B.unpack(blob.as_py()), masks.as_py())
                edges = B.cuts(g.one, shards)
                yield B.emit([(s, number, K.pack_sorted(g.one[a:b]), K.pack_any(g.two[a:b]), K.pack_any(g.least[a:b])) for s, (a, b) in enumerate(zip(edges, edges[1:])) if b > a], sent)

    answer = pa.schema([("block", pa.int64()), ("kind", pa.string()), ("shard", pa.int32()), ("mask", pa.binary())])

    def judge(group: pa.Table) -> pa.Table:
        one = [K.unpack_sorted(x) for x in group.column("one").to_pylist()]
        least = [K.unpack_any(x, np.int64) for x in group.column("least").to_pylist()]
        all_least = np.concatenate(least)
        g = _Groups(np.concatenate(one), np.concatenate([K.unpack_any(x) for x in group.column("two").to_pylist()]), all_least)
        earlier = np.split(g.least[g.group] < all_least, np.cumsum([len(x) for x in one])[:-1])
        shard = group.column("shard")[0].as_py()
        return pa.Table.from_batches([B.emit([(b, "second", shard, K.pack_bits(m)) for b, m in zip(group.column("block").to_pylist(), earlier) if m.any()], answer)], schema=answer)

    flagged = B.with_masks(packed, first_masks).select("block", "blob", "masks")
    second_masks = written(flagged.mapInArrow(send, "shard int, block long, one binary, two binary, least binary").groupBy("shard").applyInArrow(judge, "block long, kind string, shard int, mask binary"), "substring-hits")
    out_schema = source.select("_id", *["_c" + c for c in carry]).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out_schema) + ", n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_text string, full_text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, masks in zip(batch.column("blob"), batch.column("masks")):
                docs_, masks_ = B.unpack(blob.as_py()), masks.as_py()
                data, starts, ends, first = parts(docs_)
                g, at, ids = groups(docs_, masks_)
                earlier = B.mask_of(masks_, "second", B.cuts(g.one, shards))
                hit = earlier[g.group] | (ids > g.least[g.group]) if len(ids) else np.zeros(0, bool)
                gone = K.covered(len(starts), at[hit], window)
                raw, before = data.tobytes(), np.concatenate(([0], np.cumsum(gone)))
                n_gone = before[first[1:]] - before[first[:-1]]
                kept, spans, full = [], [], []
                texts = docs_.column("_text").to_pylist()
                for i, (a, b) in enumerate(zip(first, first[1:])):
                    if n_gone[i]:
                        cuts_ = K.runs(gone[a:b])
                        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(*cuts_)])
                        stay = np.flatnonzero(~gone[a:b]) + a
                        kept.append(b" ".join([raw[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist())]).decode())
                        full.append(kept[-1])
                    else:
                        spans.append([])
                        kept.append(b" ".join((texts[i] or "").encode().split()).decode())
                        full.append(texts[i])
                yield pa.RecordBatch.from_arrays(
                    [docs_.column(f.name) for f in out_schema] + [pa.array(np.diff(first), pa.int64()), pa.array(n_gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string()), pa.array(full, pa.string())],
                    names=[*out_schema.names, "n_words", "n_removed", "removed", "kept_text", "full_text"],
                )
        K.release()

    both = B.with_masks(packed, first_masks.unionByName(second_masks)).select("blob", "masks")
    return both.mapInArrow(cut, fields).toDF(id_col, *carry, "n_words", "n_removed", "removed", "kept_text", "full_text")
