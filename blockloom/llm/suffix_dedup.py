"""Suffix-array dedup of byte strings that occur twice, with linear grouping construction.

Every ``length``-byte string holds one sampled anchor: the gram of half its length whose hash is least.
A string can only repeat if its anchor does, so a sketch of anchors (the one of substring_dedup) first
leaves the contexts of repeated anchors: the bytes of all strings that share one anchor.  Contexts with
the same anchor meet in one shard; equal ones become one.  The different ones are cut to what each has
in common with any other of its anchor, and a suffix array over them, built by Lyndon groups, puts
equal strings side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from blockloom.llm import blocks as B
from blockloom.llm import kernels as K
from blockloom.llm.shared import two_columns, written
from blockloom.llm.substring_dedup import candidates, flag_repeated

_U = np.uint64
TEXT_BYTES = 1 << 17
"""Contexts of several anchors share one suffix array up to this size."""
SHARD_ANCHORS = 200_000
"""Anchors of one shard, at most about as many: a shard holds the contexts of the repeated ones."""


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array in linear time over integer symbols, without renaming and recursion.

    First pass: groups of suffixes, at the start those with one symbol in common, are met from the
    highest down.  Each suffix of a group finds its previous smaller suffix by pointers already set;
    those that precede members of the group leave their own group for new ones just above it, the more
    members the higher, as their Lyndon prefixes grow by as many copies of the group's.  Second pass:
    from the least suffix up, each one places the suffix before it, and along its pointers those whose
    order that settles, at the front of their groups."""
    n = len(text)
    symbols = sorted(set(text))
    number = {s: i for i, s in enumerate(symbols)}
    group = [number[s] for s in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(symbols) - 1))
    above = list(range(1, len(symbols) + 1))
    previous, met = [-1] * n, bytearray(n)
    g, order = len(symbols) - 1, []
    while g >= 0:
        own = members[g] = [i for i in members[g] if group[i] == g]
        order.append(g)
        for i in own:
            met[i] = 1
        calls: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and met[j]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                calls[j] = calls.get(j, 0) + 1
        if calls:
            by_calls: dict[int, list[int]] = {}
            for j in sorted(calls):
                by_calls.setdefault(calls[j], []).append(j)
            for times in sorted(by_calls, reverse=True):
                made: dict[int, int] = {}
                for j in by_calls[times]:
                    old = group[j]
                    new = made.get(old)
                    if new is None:
                        new = made[old] = len(members)
                        members.append([])
                        over = above[old]
                        below.append(old)
                        above.append(over)
                        above[old] = below[over] = new
                    members[new].append(j)
                    group[j] = new
        g = below[g]
    front, at = {}, 0
    for g in reversed(order):
        front[g] = at
        at += len(members[g])
    out, placed = [-1] * n, bytearray(n)

    def place(j: int) -> None:
        while j >= 0 and not placed[j]:
            out[front[group[j]]] = j
            front[group[j]] += 1
            placed[j] = 1
            j = previous[j]

    place(n - 1)
    for i in range(n):
        place(out[i] - 1)
    return out


def anchors(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings of ``length`` bytes within texts: each anchor's place and hash, and the first and
    last start of the strings that have it."""
    gram, span = length - length // 2 + 1, length // 2
    n_strings = len(data) - length + 1
    empty = np.zeros(0, np.int64)
    if n_strings <= 0:
        return empty, np.zeros(0, _U), empty, empty
    h, place_bits, piece = K.ROLLING, 21, 1 << 17
    places, hashes, lows, highs = [], [], [], []
    filled = np.flatnonzero(offs[1:] - offs[:-1] >= length)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[offs[filled]] += 1
    inside[offs[filled + 1] - length + 1] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    up, down = h.powers(piece + length + 2)
    for at in range(0, n_strings, piece):
        starts = min(piece, n_strings - at)
        if not inside[at : at + starts].any():
            continue
        part = data[at : at + starts + length - 1]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(h.values[part] * up[: len(part)], out=sums[1:])
        grams = len(part) - gram + 1
        full = K.mix((sums[gram:] - sums[:grams]) * down[:grams])
        least = full >> _U(place_bits) << _U(place_bits) | np.arange(grams, dtype=_U)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: starts], least[span - width : span - width + starts])
        where = (least[:starts] & _U((1 << place_bits) - 1)).astype(np.int64)
        valid = np.flatnonzero(inside[at : at + starts])
        where = where[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (where[1:] != where[:-1]) | (valid[1:] != valid[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(valid)) - 1
        places.append(where[first] + at)
        hashes.append(K.mix(full[where[first]]))  # least hashes are small ones; mixed anew they spread over all shards
        lows.append(valid[first] + at)
        highs.append(valid[last] + at)
    if not places:
        return empty, np.zeros(0, _U), empty, empty
    places, hashes, lows, highs = (np.concatenate(x) for x in (places, hashes, lows, highs))
    # A run that a slice's edge cut in two is one again.
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] != places[:-1]) | (lows[1:] != highs[:-1] + 1)
    first = np.flatnonzero(new)
    return places[first], hashes[first], lows[first], highs[np.append(first[1:], len(places)) - 1]


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two strings have in common at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        middle = (low + n) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle
    return low


def _cut_to_shared(contexts: list[tuple[bytes, int]], length: int) -> list[tuple[int, int]]:
    """For each (bytes, anchor's place) the range it may share with another one, by neighbours in the
    order of what follows the anchor and of what precedes it; (0, 0) if no string fits in."""
    right, left = [0] * len(contexts), [0] * len(contexts)
    for best, keys in ((right, [c[p:] for c, p in contexts]), (left, [c[:p][::-1] for c, p in contexts])):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        for i, j in zip(order, order[1:]):
            n = _common(keys[i], keys[j])
            best[i], best[j] = max(best[i], n), max(best[j], n)
    return [(p - a, p + b) if a + b >= length else (0, 0) for (_, p), a, b in zip(contexts, left, right)]


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which starts of ``length``-byte strings in it occur at another place of them."""
    text: list[int] = []
    begins = []
    for k, s in enumerate(strings):
        begins.append(len(text))
        text.extend(s)
        text.append(-1 - k)
    joined = b"\0".join(strings)
    owner_end = np.zeros(len(text), np.int64)
    for b, s in zip(begins, strings):
        owner_end[b : b + len(s) + 1] = b + len(s)
    ends = owner_end.tolist()
    twice = bytearray(len(text))
    last = -1
    for p in suffix_array(text):
        if p + length <= ends[p]:
            if last >= 0 and joined[last : last + length] == joined[p : p + length]:
                twice[p] = twice[last] = 1
            last = p
        else:
            last = -1
    flags = np.frombuffer(bytes(twice), np.uint8).astype(bool)
    return [flags[b : b + max(0, len(s) - length + 1)] for b, s in zip(begins, strings)]


class _Judge:
    """Decides which strings of contexts occur elsewhere; contexts are (bytes, anchor's place)."""

    def __init__(self, length: int, text_bytes: int):
        self.length, self.text_bytes = length, text_bytes
        self.verdict: dict[tuple[bytes, int], np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.wanted: list[tuple[list[tuple[tuple[bytes, int], int]], int, bytes, bool]] = []
        self.size = 0

    def solve(self) -> None:
        """Strings that wait, in one suffix array; their verdicts go to all contexts they came from."""
        if self.wanted:
            strings = list(self.number)
            found = repeated_starts(strings, self.length)
            for owners, low, piece, several in self.wanted:
                hits = found[self.number[piece]]
                hits = np.ones(len(hits), bool) if several else hits
                for context, at in owners:
                    self.verdict[context][at + low : at + low + len(hits)] |= hits
        self._clear()

    def add(self, contexts: dict[tuple[bytes, int], int]) -> None:
        """All different contexts of one anchor and how often each occurs (2 for more)."""
        for c, n in contexts.items():
            self.verdict[c] = np.full(len(c[0]) - self.length + 1, n > 1)
        if len(contexts) > 1:
            whole = {c: ([(c, 0)], n) for c, n in contexts.items()}
            self._part(whole, 0, max(p for _, p in contexts))

    def _part(self, pieces: dict[tuple[bytes, int], tuple[list, int]], low: int, high: int) -> None:
        """pieces: what contexts have of the strings that begin low..high bytes before the anchor.

        Too many of them for one suffix array are parted by content: strings that begin at most
        ``middle`` bytes before the anchor agree in what follows it, the others in what precedes it."""
        if len(pieces) < 2:
            return
        if sum(len(b) for b, _ in pieces) <= self.text_bytes:
            self._queue(pieces)
            return
        if low == high:
            return  # single strings: equal ones are one piece already
        middle, length = (low + high) // 2, self.length
        parts: dict[tuple[int, bytes], dict[tuple[bytes, int], tuple[list, int]]] = {}
        for (b, p), (owners, n) in pieces.items():
            for half, least, most in ((0, low, middle), (1, middle + 1, high)):
                first, last = p - min(most, p), p - max(least, p - (len(b) - length))
                if first > last:
                    continue
                cut, place = b[first : last + length], p - first
                shared = b[p : p + length - middle] if half == 0 else b[p - middle - 1 : p]
                group = parts.setdefault((half, shared), {})
                have = group.get((cut, place))
                moved = [(c, at + first) for c, at in owners]
                group[cut, place] = (have[0] + moved, have[1] + n) if have else (moved, n)
        for (half, _), group in parts.items():
            for (b, _), (owners, n) in group.items():
                if n > 1:
                    for context, at in owners:
                        self.verdict[context][at : at + len(b) - length + 1] = True
            self._part(group, low if half == 0 else middle + 1, middle if half == 0 else high)

    def _queue(self, pieces: dict[tuple[bytes, int], tuple[list, int]]) -> None:
        several = list(pieces)
        shared: dict[bytes, list] = {}
        for c, (low, high) in zip(several, _cut_to_shared(several, self.length)):
            if high > low:
                shared.setdefault(c[0][low:high], []).append((pieces[c], low))
        for piece, found in shared.items():
            if piece not in self.number:
                self.number[piece] = len(self.number)
                self.size += len(piece)
            twice = len(found) > 1 or found[0][0][1] > 1
            for (owners, _), low in found:
                self.wanted.append((owners, low, piece, twice))
        if self.size > self.text_bytes:
            self.solve()


def judge_contexts(groups: dict[int, dict[tuple[bytes, int], int]], length: int, text_bytes: int = TEXT_BYTES) -> dict[tuple[bytes, int], np.ndarray]:
    """groups: by anchor hash, each different context and how often it occurs (2 for more).  For each
    context: which of its strings occur elsewhere."""
    judge = _Judge(length, text_bytes)
    for contexts in groups.values():
        judge.add(contexts)
    judge.solve()
    return judge.verdict


class _Contexts:
    """A block's different contexts of repeated anchors, by anchor hash and bytes."""

    def __init__(self, batch: pa.RecordBatch, masks: list | None, shards: int, n_keys: int, length: int):
        self.data, self.offs = K.text_bytes(batch.column("_text"))
        places, hashes, self.low, self.high = anchors(self.data, self.offs, length)
        keep = np.flatnonzero(candidates(hashes, masks, shards, n_keys))
        self.low, self.high = self.low[keep], self.high[keep]
        raw = self.data.tobytes()
        seen: dict[tuple[int, bytes, int], list[int]] = {}
        for i, (h, a, b, p) in enumerate(zip(hashes[keep].tolist(), self.low.tolist(), self.high.tolist(), places[keep].tolist())):
            seen.setdefault((h, raw[a : b + length], p - a), []).append(i)
        self.keys = sorted(seen)
        self.of = np.zeros(len(keep), np.int64)
        for k, key in enumerate(self.keys):
            self.of[seen[key]] = k
        self.several = np.array([len(seen[k]) > 1 for k in self.keys], bool)
        self.hashes = np.array([k[0] for k in self.keys], _U)
        self.starts = np.array([len(k[1]) - length + 1 for k in self.keys], np.int64)
        self.edges = B.cuts(self.hashes, shards)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, depth: int = 2, text_bytes: int = TEXT_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes every byte covered by a string of ``length`` bytes that starts at another place too.

    Texts are UTF-8 bytes, strings lie within one text, places may be in the same text and overlap, and
    strings are judged on the input. Returns for each row of docs: id, carried columns, n_bytes,
    n_removed, removed (array of [start, end) byte ranges, as long as they go) and kept (binary).

    Null and empty texts have no bytes; shorter texts than ``length`` keep all. Rows that repeat (whole
    or in their id) are different texts: equal ones remove each other. Null ids stay null. Empty
    tables give empty results, and columns not named are ignored.
    """
    source = two_columns(docs, id_col, text_col, carry)

    def hashes_of(batch: pa.RecordBatch) -> np.ndarray:
        return anchors(*K.text_bytes(batch.column("_text")), length)[1]

    packed = B.pack(source, lambda b: len(hashes_of(b)), "suffix-blocks")
    shards, n_keys = B.shards_for(packed)
    shards = max(shards, -(-n_keys // SHARD_ANCHORS))
    first_masks = flag_repeated(packed, hashes_of, shards, n_keys, depth, "suffix-flags")
    sent = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("places", pa.binary()), ("sizes", pa.binary()), ("several", pa.binary()), ("bytes", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for number, blob, masks in zip(batch.column("block").to_pylist(), batch.column("blob"), batch.column("masks")):
                c = _Contexts(B.unpack(blob.as_py()), masks.as_py(), shards, n_keys, length)
                rows = []
                for s, (a, b) in enumerate(zip(c.edges, c.edges[1:])):
                    if b > a:
                        keys = c.keys[a:b]
                        rows.append((s, number, K.pack_sorted(c.hashes[a:b]), press(np.array([k[2] for k in keys], np.uint16).tobytes()), press(np.array([len(k[1]) for k in keys], np.uint16).tobytes()), K.pack_bits(c.several[a:b]), press(b"".join([k[1] for k in keys]))))
                yield B.emit(rows, sent)

    answer = pa.schema([("block", pa.int64()), ("kind", pa.string()), ("shard", pa.int32()), ("mask", pa.binary()), ("bits", pa.int64())])

    def judge(group: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        groups: dict[int, dict[tuple[bytes, int], int]] = {}
        lists: list[list[tuple[bytes, int]]] = []
        for hashes, places, sizes, several, raw in zip(*[group.column(n).to_pylist() for n in ("hashes", "places", "sizes", "several", "bytes")]):
            hashes, places, sizes = K.unpack_sorted(hashes).tolist(), np.frombuffer(open_(places), np.uint16).tolist(), np.frombuffer(open_(sizes), np.uint16).tolist()
            raw, at, own = open_(raw), 0, []
            for h, p, n, two in zip(hashes, places, sizes, K.unpack_bits(several, len(sizes)).tolist()):
                key = (raw[at : at + n], p)
                at += n
                contexts = groups.setdefault(h, {})
                contexts[key] = min(2, contexts.get(key, 0) + 1 + two)
                own.append(key)
            lists.append(own)
        verdict = judge_contexts(groups, length, text_bytes)
        shard = group.column("shard")[0].as_py()
        rows = []
        for number, own in zip(group.column("block").to_pylist(), lists):
            mask = np.concatenate([verdict[k] for k in own])
            if mask.any():
                rows.append((number, "second", shard, K.pack_bits(mask), len(mask)))
        return pa.Table.from_batches([B.emit(rows, answer)], schema=answer)

    flagged = B.with_masks(packed, first_masks).select("block", "blob", "masks")
    fields = "shard int, block long, hashes binary, places binary, sizes binary, several binary, bytes binary"
    second_masks = written(flagged.mapInArrow(send, fields).groupBy("shard").applyInArrow(judge, "block long, kind string, shard int, mask binary, bits long"), "suffix-hits").drop("bits")
    out_schema = source.select("_id", *["_c" + c for c in carry]).schema
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out_schema) + ", n_bytes long, n_removed long, removed array<struct<start: long, end: long>>, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, masks in zip(batch.column("blob"), batch.column("masks")):
                docs_, masks_ = B.unpack(blob.as_py()), masks.as_py()
                c = _Contexts(docs_, masks_, shards, n_keys, length)
                bit_at = np.concatenate(([0], np.cumsum(c.starts)))
                bits = B.mask_of(masks_, "second", bit_at[c.edges])
                n = c.high - c.low + 1
                begins = np.repeat(c.low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                source_bit = np.repeat(bit_at[c.of] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                gone = K.covered(len(c.data), begins[bits[source_bit]], length)
                spans, kept, removed = [], [], []
                for a, b in zip(c.offs.tolist(), c.offs[1:].tolist()):
                    part = gone[a:b]
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(*K.runs(part))] if part.any() else [])
                    removed.append(sum(s["end"] - s["start"] for s in spans[-1]))
                    kept.append(c.data[a:b][~part].tobytes() if removed[-1] else c.data[a:b].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [docs_.column(f.name) for f in out_schema] + [pa.array(np.diff(c.offs), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=[*out_schema.names, "n_bytes", "n_removed", "removed", "kept"],
                )
        K.release()

    both = B.with_masks(packed, first_masks.unionByName(second_masks)).select("blob", "masks")
    return both.mapInArrow(cut, types).toDF(id_col, *carry, "n_bytes", "n_removed", "removed", "kept")
