"""Best-fit packing of token sequences by bin completion over the histogram of lengths.

Lengths are whole numbers up to the capacity, so the histogram (at most ``capacity`` counts, however
many documents there are) is all the planner needs.  It branches on the undominated fillings around
the largest remaining length, prunes by the waste that one sequence less would allow, and keeps the
best solution of best-fit decreasing or an earlier branch as incumbent.  The plan is a list of
patterns with multiplicities; rows find their places by their rank among the rows of their length.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm import kernels as K
from blockloom.llm.blocks import BLOCK_BYTES, slices
from blockloom.llm.shared import two_columns, written

LOG = logging.getLogger(__name__)
CAPACITY = 2_048
STEPS = 8_000
"""Fillings that the search for a plan tries, at most."""
KEPT_FRAMES = 8
"""Open nodes of the search whose enumeration is kept; those above are enumerated anew when reached."""
CACHED_BYTES = 48 << 20
"""Memory, roughly, of one generation of words whose ids a Python worker keeps; it keeps two."""
BROADCAST_ROWS = 200_000
"""Counts by part and length, at most, that are broadcast to the pieces; more are joined by shuffle."""

Pattern = tuple[tuple[int, ...], int]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on the histogram: bins that look alike are filled together."""
    rooms: dict[int, list[list]] = {}
    free: list[int] = []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = next((f for f in free if f >= size), None)  # ascending: the tightest room
            if at is None:
                per = capacity // size
                full, rest = divmod(left, per)
                made = [[[size] * per, full]] * bool(full) + [[[size] * rest, 1]] * bool(rest)
                left = 0
            else:
                group = rooms[at].pop()
                per = at // size
                use = min(group[1], left // per)
                if use:
                    made = [[group[0] + [size] * per, use]]
                    left -= use * per
                else:
                    use = 1
                    made = [[group[0] + [size] * left, 1]]
                    left = 0
                if group[1] > use:
                    rooms[at].append([group[0], group[1] - use])
                if not rooms[at]:
                    del rooms[at]
                    free.remove(at)
            for items, n in made:
                room = capacity - sum(items)
                if room not in rooms:
                    rooms[room] = []
                    free.insert(bisect_right(free, room), room)
                rooms[room].append([items, n])
    return [(tuple(items), n) for groups in rooms.values() for items, n in groups]


def reachable(sizes: list[int], left: dict[int, int], room: int) -> list[int]:
    """Bit t of entry i: items of the i smallest sizes, as many as there are, can fill exactly t of the room."""
    full, out = (1 << room + 1) - 1, [1]
    for size in sizes:
        if size > room:
            break
        sums, n, k = out[-1], min(left[size], room // size), 1
        while n > 0:
            k = min(k, n)
            sums |= sums << k * size
            n, k = n - k, 2 * k
        out.append(sums & full)
    return out


def dominated(items: tuple[int, ...], waste: int, spare: int) -> bool:
    """Whether some of the items and the room they leave could be traded for one larger item that is
    left over (Martello and Toth's dominance): what then comes free can be packed wherever that item can.

    items are descending; bit x of spare tells that an item of size x is left over."""
    sums, low = 1, 0  # sums that items of at most `low` make; for an item to trade in, all of them are smaller

    def trade(high: int) -> int:
        reached, span = sums, 0
        while span < waste:
            step = min(span + 1, waste - span)
            reached |= reached << step
            span += step
        return reached & spare & ((1 << high + 1) - (1 << low + 1))

    for size, run in groupby(reversed(items)):
        if trade(size):
            return True
        for _ in run:
            sums |= sums << size
        low = size
    return bool(trade(max(low, spare.bit_length())))


def fillings(sizes: list[int], left: dict[int, int], room: int, waste: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Undominated fillings of a room that waste at most ``waste``, with their waste: least waste first,
    then larger items first.  ``left`` must stand as it was whenever the next one is asked for."""
    sizes = sizes[: bisect_right(sizes, room)]
    reach = reachable(sizes, left, room)
    spare = sum(1 << s for s in sizes)

    def fill(i: int, target: int) -> Iterator[tuple[int, ...]]:
        if target == 0:
            yield ()
            return
        while i:
            i -= 1
            for k in range(min(left[sizes[i]], target // sizes[i]), 0, -1):
                rest = target - k * sizes[i]
                if reach[i] >> rest & 1:
                    for others in fill(i, rest):
                        yield (sizes[i],) * k + others

    for wasted in range(min(waste, room) + 1):
        if reach[-1] >> room - wasted & 1:
            for items in fill(len(sizes), room - wasted):
                used_up = sum(1 << s for s, n in Counter(items).items() if n == left[s])
                if not dominated(items, wasted, spare ^ used_up):
                    yield items, wasted


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by dual feasible functions.

    For k = 1, 2, ... a size s counts floor((k + 1) s / capacity) / k, or s / capacity where (k + 1) s
    is a multiple of the capacity; k of them bound how many items share a sequence."""
    if not counts:
        return 0
    sizes, n = (np.array(x, np.int64) for x in zip(*sorted(counts.items())))
    best = -(-int((sizes * n).sum()) // capacity)
    for k in range(1, capacity):
        whole, rest = np.divmod((k + 1) * sizes, capacity)
        best = max(best, -(-int((np.where(rest == 0, k * sizes, whole * capacity) * n).sum()) // (k * capacity)))
    return best


@dataclass(frozen=True)
class Plan:
    """patterns (lengths, how many sequences); bound: no packing has fewer sequences; proven: none has
    fewer than this one; steps: fillings that were tried."""

    patterns: list[Pattern]
    bound: int
    proven: bool
    steps: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def plan(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Plan:
    """Packs the histogram by branch and bound over fillings of the largest length that is left.

    A branch applies one filling as often as the counts and the waste allow, or once; so all packings
    can be reached.  A branch ends where what it wasted leaves no room for one sequence less than the
    incumbent.  The search ends when the incumbent meets the bound, when nothing is left to try, or
    after ``steps`` fillings; then Plan.proven is False."""
    counts = {s: n for s, n in counts.items() if n > 0}
    if any(s > capacity or s < 1 for s in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    total, bound = sum(s * n for s, n in counts.items()), lower_bound(counts, capacity)
    best = best_fit_decreasing(counts, capacity)
    best_size = sum(n for _, n in best)
    left, sizes = dict(counts), sorted(counts)

    def take(items: tuple[int, ...], times: int) -> None:
        for s in items:
            left[s] -= times
        for s in {s for s in items if left[s] == 0}:
            sizes.pop(bisect_right(sizes, s) - 1)

    def give(items: tuple[int, ...], times: int) -> None:
        for s in {s for s in items if left[s] == 0}:
            insort(sizes, s)
        for s in items:
            left[s] += times

    def choices(largest: int, waste: int) -> Iterator[tuple[tuple[int, ...], int, int]]:
        """(items, waste, times) of a sequence with the largest length; left is as it was at the start
        whenever the next one is asked for, but for the largest item itself."""
        for items, wasted in fillings(list(sizes), left, capacity - largest, waste):
            items = (largest, *items)
            times = min((left[s] + (s == largest)) // k for s, k in Counter(items).items())
            yield items, wasted, times
            if times > 1:
                yield items, wasted, 1

    # A frame is a node of the tree: its choices, how many were taken, and the one in force.
    frames: list[list] = []
    wasted, tried, opened = 0, 0, True
    while best_size > bound and tried < steps:
        if opened:
            allowed = (best_size - 1) * capacity - total - wasted
            if not sizes and allowed >= 0:
                best = [(items, n) for _, _, (items, _, n) in frames]
                best_size = sum(n for _, n in best)
                opened = False
                continue
            frames.append([None, 0, None])
            if len(frames) > KEPT_FRAMES:
                frames[-1 - KEPT_FRAMES][0] = None  # made anew when the search comes back to it
        elif not frames:
            return Plan(sorted(best, reverse=True), bound, True, tried)
        frame = frames[-1]
        if frame[2]:
            items, w, n = frame[2]
            give(items, n)
            wasted -= w * n
            frame[2] = None
        allowed = (best_size - 1) * capacity - total - wasted
        found = None
        if sizes and allowed >= 0:
            largest = sizes[-1]
            left[largest] -= 1
            if left[largest] == 0:
                sizes.pop()
            if frame[0] is None:
                frame[0] = islice(choices(largest, allowed), frame[1], None)
            found = next(frame[0], None)
            left[largest] += 1
            if left[largest] == 1:
                sizes.append(largest)
        if found is None or found[1] > allowed:
            frames.pop()
            opened = False
            continue
        frame[1] += 1
        tried += 1
        items, w, n = found
        n = max(1, min(n, allowed // w)) if w else n
        frame[2] = (items, w, n)
        take(items, n)
        wasted += w * n
        opened = True
    return Plan(sorted(best, reverse=True), bound, best_size == bound, tried)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves,
    the others for the next free ones from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class _WordIds(dict):
    """Ids of white-space-free words as little-endian bytes; words of a text are encoded on their own.

    Two generations of words are kept: what was met since the last turn survives the next one.  The
    tokenizer lower-cases and parts a word from the mark that ends it, so neither form is kept twice;
    words of Latin letters alone go straight to its merges.  A tokenizer that does otherwise on the
    probes gets whole texts."""

    PROBES = ("The, word. and THE É, é naïve Straße", "don't 'S 12,3 x<|y a.b ,. \u2019re\n ß")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.older, self.weight = Tokenizer.from_file(path), {"": b""}, 0
        self.merges, self.letters = self.tokenizer.model.tokenize, str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        try:
            self.by_word = all(self._split(p) == self._whole(p) for p in self.PROBES)
        except Exception:  # a model without merges
            self.by_word = False

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(word) > 1 and word[-1] in ".," and word[-2].isalpha() and len(word[-2].lower()) == 1:
            return self[word[:-1]] + self[word[-1]]
        if word.isascii() and word.isalpha() and not word.islower():
            return self[word.lower()]
        ids = self.older.get(word)
        if ids is None:
            if word.isalpha() and (word.isascii() or max(word) < "\u0100"):
                raw = word.lower().encode().decode("latin-1").translate(self.letters)
                ids = np.array([t.id for t in self.merges(raw)], "<u4").tobytes()
            else:
                ids = self._whole(word)
        if len(word) <= 64:
            if self.weight > CACHED_BYTES:
                self.older, self.weight = dict(self), 0
                self.clear()
            self.weight += 160 + 2 * len(word) + len(ids)  # a word, its ids and their place
            self[word] = ids
        return ids

    def _split(self, text: str) -> bytes:
        return b"".join([self[w] for w in text.replace("\n", " ").split(" ")])

    def encode(self, text: str) -> bytes:
        return self._split(text) if self.by_word else self._whole(text)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Tokens of whole texts with an end id, longer ones cut: _id, piece, start, length, ids_crc32,
    part and rank (the row's number among those of its length in its part), and raw if asked: the ids
    as little-endian 32-bit numbers.

    The tokenizer file drops white space and splits at it, so a word's ids don't depend on its
    neighbours; splitting at spaces and line feeds lets workers keep the ids of words they have met."""
    kinds = {"_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int64(), "rank": pa.int64()} | ({"raw": pa.binary()} if ids else {})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, ranks = (task.partitionId() if task else 0), np.zeros(capacity + 1, np.int64)
        encoder = K.CACHES.get(tokenizer) or K.CACHES.setdefault(tokenizer, _WordIds(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        for batch in (part_ for whole in batches for part_ in slices(whole, BLOCK_BYTES)):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
                raw = encoder.encode(text or "") + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    piece = raw[at : at + 4 * capacity]
                    n = len(piece) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(piece), part, int(ranks[n]), piece)[: len(kinds)])
                    ranks[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds.values())], names=list(kinds))
        K.release()

    fields = "_id long, piece int, start long, length long, ids_crc32 long, part long, rank long" + ", raw binary" * ids
    return two_columns(docs, id_col, text_col).mapInArrow(cut, fields)


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank.

    Ranks from one row's first up to the next row's lie in consecutive sequences at the same offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for items, n in patterns:
        offset = 0
        for size in items:
            rows.append((size, used.get(size, 0), sequence, offset))
            used[size] = used.get(size, 0) + n
            offset += size
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, steps: int = STEPS) -> DataFrame:
    """Packs all texts, none dropped, into sequences of at most ``capacity`` tokens.

    One row for each piece: id, piece (from 0), start (its text's tokens before it), length, ids_crc32
    (of the ids as little-endian unsigned 32-bit numbers), sequence_id, offset, and ids if asked.
    Null and empty texts are just the end id; longer texts than the capacity are cut into full pieces
    and a rest. Repeated rows are packed as often as they come, null ids stay null, an empty table
    gives an empty result, and columns not named are ignored.  ``steps`` bounds the search for a plan
    (see plan); how it ended goes to this module's log.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, ids), "pieces")
    by_part = written(pieces.groupBy("part", "length").count(), "piece-counts")
    histogram = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    found = plan(histogram, capacity, steps)
    LOG.info("packing: %d sequences, at least %d needed, %s after %d fillings", found.sequences, found.bound, "proven" if found.proven else "search ended unproven", found.steps)
    places = slots(found.patterns)  # at most as many patterns as fillings were tried and best fit made
    shared = docs.sparkSession.sparkContext.broadcast((places[:, 0] << 40 | places[:, 1], places[:, 1], places[:, 2], places[:, 3]))
    before = by_part.select("part", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    few = by_part.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ranked = pieces.join(F.broadcast(before) if few else before.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.CACHES.clear()  # a worker that has cut texts may hold words
        keys, first, sequence, offset = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 40 | rank, "right") - 1
            made = [batch.column(c) for c in kept] + [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])] + ([_lists(batch.column("raw"))] if ids else [])
            yield pa.RecordBatch.from_arrays(made, names=[*kept, "sequence_id", "offset", *["ids"] * ids])
        K.release()

    kept = ("_id", "piece", "start", "length", "ids_crc32")
    done = ranked.mapInArrow(place, "_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * ids)
    return done.select(F.col("_id").alias(id_col), *kept[1:], "sequence_id", "offset", *["ids"] * ids)


def _lists(column: pa.Array) -> pa.Array:
    """Bytes of 32-bit numbers as lists of them, without copying."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // 4 if len(column) else np.zeros(1, np.int32)
    numbers = pa.Array.from_buffers(pa.int32(), int(at[-1]), [None, data]) if len(column) else pa.array([], pa.int32())
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), numbers)
