"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over words of all items.  A document's words stream through it, which gives
at every word the length of the longest item passage that ends there; spans whose length reaches
``window`` words (or a whole shorter item) are hits, and documents or spans over the length or
coverage limits go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import kernels as K
from blockloom.llm.blocks import BLOCK_BYTES, slices
from blockloom.llm.shared import two_columns, written

AUTOMATON_BYTES = 1 << 20
"""Text of the items in one automaton, at most; more items make more automata, one pass each."""


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[int]] = []
        for _, seq in items:
            last, path = 0, []
            for word in seq:
                last = self._extend(last, word)
                path.append(last)
            ends.append(path)
        self.found: dict[int, set[int]] = {}
        self.shorts: dict[int, list[tuple[int, int]]] = {}
        for number, (path, (_, seq)) in enumerate(zip(ends, items)):
            if 0 < len(seq) < window:
                self.shorts.setdefault(path[-1], []).append((len(seq), number))
            for state in path[window - 1 :]:
                self.found.setdefault(self._of_length(state, window), set()).add(number)
        self.short_below = [False] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short_below[state] = state in self.shorts or self.short_below[self.link[state]]

    def _of_length(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _clone(self, p: int, q: int, word: int) -> int:
        made = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = made
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = made
            p = self.link[p]
        return made

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
        made = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = made
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return made

    def stream(self, seq: list[int]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hits as (end, words), the numbers of the items they belong to, and the longest match."""
        state = size = longest = 0
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        nexts, link, length, window = self.next, self.link, self.length, self.window
        for end, word in enumerate(seq, 1):
            while state and word not in nexts[state]:
                state = link[state]
                size = length[state]
            to = nexts[state].get(word)
            if to is None:
                size = 0
                continue
            state, size = to, size + 1
            longest = max(longest, size)
            if size >= window:
                at = self._of_length(state, window)
                hits.append((end, window))
                items |= self.found.get(at, ())
            if self.short_below[state]:
                at = state
                while at > 0:
                    for n, number in self.shorts.get(at, ()):
                        if n <= size:
                            hits.append((end, n))
                            items.add(number)
                    at = link[at]
        return hits, items, longest


class _Index:
    """The automaton with the words it knows; a document's stretches that can hold a hit reach it.

    A stretch is a longest run of words whose neighbours all occur side by side in some item, so
    every hit of two words or more lies within one."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        items = [x for x in items if x[1]]
        data = np.frombuffer("\n".join(t for _, t in items).encode(), np.uint8)
        offs = np.concatenate(([0], np.cumsum([len(t.encode()) + 1 for _, t in items]))).astype(np.int64)
        offs[-1:] = len(data)
        data = K.LOWER[data]
        starts, ends, first = K.words(data, offs, K.ALNUM)
        hashed = K.hash_words(data, starts, ends)
        self.known = K.distinct(hashed)
        numbers = np.searchsorted(self.known, hashed)
        self.names = [i for i, _ in items]
        seqs = [numbers[a:b].tolist() for a, b in zip(first, first[1:])]
        self.pairs = K.distinct(K.window_hashes(hashed, first, 2)[0])
        filled = [len(s) for s in seqs if s]
        self.least = min([window, *filled])
        self.automaton = SuffixAutomaton([(n, s) for n, s in zip(self.names, seqs)], window)

    @staticmethod
    def _in(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(sorted_values):
            return np.zeros(len(values), bool)
        return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values

    def stretches(self, hashed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.least < 2:
            mask = self._in(self.known, hashed)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            a, b = K.runs(mask)
            inner = [np.flatnonzero(np.diff(doc[x:y])) + x + 1 for x, y in zip(a, b)] if len(a) else []
            cuts = np.concatenate(inner) if inner else np.zeros(0, np.int64)
            return np.sort(np.concatenate((a, cuts))), np.sort(np.concatenate((b, cuts)))
        pair, at, _ = K.window_hashes(hashed, first, 2)
        mask = np.zeros(len(hashed) + 1, bool)
        mask[at[self._in(self.pairs, pair)]] = True
        a, b = K.runs(mask)
        long = b - a >= self.least - 1
        return a[long], b[long] + 1

    def scan(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[int]], np.ndarray]:
        """Of a batch: word starts and ends, first words, hit words, each text's items and longest match."""
        data = K.LOWER[data]
        starts, ends, first = K.words(data, offs, K.ALNUM)
        hashed = K.hash_words(data, starts, ends)
        hit, longest = np.zeros(len(starts), bool), np.zeros(len(offs) - 1, np.int64)
        items: list[set[int]] = [set() for _ in range(len(offs) - 1)]
        if len(self.known):
            a, b = self.stretches(hashed, first)
            texts = np.searchsorted(first, a, "right") - 1
            for x, y, d in zip(a.tolist(), b.tolist(), texts.tolist()):
                found, which, best = self.automaton.stream(np.searchsorted(self.known, hashed[x:y]).tolist())
                longest[d] = max(longest[d], best)
                items[d] |= which
                for end, n in found:
                    hit[x + end - n : x + end] = True
        return starts, ends, first, hit, items, longest


def _chunks(items: list[tuple[str, str]], limit: int) -> list[list[tuple[str, str]]]:
    out, size = [[]], 0
    for item in items:
        n = len((item[1] or "").encode())
        if out[-1] and size + n > limit:
            out.append([])
            size = 0
        out[-1].append(item)
        size += n
    return out


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    window: int = 10, max_span: int | None = None, max_coverage: float | None = None, automaton_bytes: int = AUTOMATON_BYTES, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Finds passages of test items in texts and cuts them out.

    Words are the runs of ASCII letters and digits and of any other non-ASCII characters, lower-cased
    in A-Z.  A window is ``window`` consecutive words of an item; a shorter item is one window.
    Returns for each row of docs: id, carried columns, n_words, n_hit, longest (words of the longest
    item passage met in a stretch that could hold a hit), item_ids (sorted as strings), contaminated
    (n_hit > 0), rejected (a removed span longer than max_span words, or more than max_coverage of
    the words hit; False where neither limit is given), spans (hit word ranges) and clean_text: the
    text without the bytes from the first to the last word of each hit span.

    Null texts have no words, give no hits and come back null; items with null or wordless text
    match nothing; null item ids are left out of item_ids. Rows that repeat are judged one by one.
    Empty tables give empty or hit-free results. Other columns are ignored.  Items beyond
    ``automaton_bytes`` of text are split over several automata, each streamed by its own pass.
    """
    spark = docs.sparkSession
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    wanted = items.select(q(item_id_col).cast("string").alias("i"), q(item_text_col).cast("string").alias("t")).where("t is not null")
    total = wanted.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    source = two_columns(docs, id_col, text_col, carry)
    n_parts = -(-total // automaton_bytes) if total else 1
    if n_parts == 1:
        groups: Iterator[list[tuple[str, str]]] = iter([[(r.i, r.t) for r in wanted.collect()]])
    else:
        part = F.pmod(F.xxhash64("i", "t"), F.lit(int(n_parts)))
        kept = written(wanted.withColumn("p", part), "benchmark-items")
        groups = ([(r.i, r.t) for r in kept.where(F.col("p") == k).collect()] for k in range(n_parts))
    extra = source.select(*["_c" + c for c in carry]).schema
    types = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)
    found = "n_words long, longest long, items array<string>, spans array<struct<start: long, end: long>>"
    current = source.withColumns({"n_words": F.lit(0).cast("long"), "longest": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<start: long, end: long>>")})
    chunks = (chunk for group in groups for chunk in _chunks(group, 4 * automaton_bytes))
    chunk = next(chunks)
    while (after := next(chunks, None)) is not None:
        index = spark.sparkContext.broadcast(_Index(chunk, window))
        current = written(current.mapInArrow(_scanner(index, extra.names, False), f"_id long, _text string{types}, {found}"), "decontamination-pass")
        chunk = after
    index = spark.sparkContext.broadcast(_Index(chunk, window))
    done = current.mapInArrow(_scanner(index, extra.names, True), f"_id long{types}, {found}, clean_text string")
    hit_words = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    limits = F.lit(False)
    if max_span is not None:
        limits = limits | F.exists("spans", lambda s: s["end"] - s["start"] > max_span)
    if max_coverage is not None:
        limits = limits | (hit_words > F.col("n_words") * F.lit(float(max_coverage)))
    return done.select(F.col("_id").alias(id_col), *[F.col(f"`_c{c}`").alias(c) for c in carry], "n_words", hit_words.alias("n_hit"), "longest", F.array_sort("items").alias("item_ids"), (hit_words > 0).alias("contaminated"), limits.alias("rejected"), "spans", "clean_text")


def _span_list(mask: np.ndarray) -> list[dict]:
    return [{"start": int(a), "end": int(b)} for a, b in zip(*K.runs(mask))]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut_out(text: str, spans: list[dict], starts: np.ndarray, ends: np.ndarray) -> str:
    """The text without the bytes from the first to the last word of each span."""
    raw, keep, at = text.encode(), [], 0
    for s in spans:
        keep.append(raw[at : starts[s["start"]]])
        at = int(ends[s["end"] - 1])
    return b"".join([*keep, raw[at:]]).decode()


def _scanner(index, extra: list[str], last: bool):
    """Adds one automaton's hits to the rows' earlier ones; the last one cuts the texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in (part for whole in batches for part in slices(whole, BLOCK_BYTES)):
            data, offs = K.text_bytes(batch.column("_text"))
            starts, ends, first, hit, items, longest = known.scan(data, offs)
            before = np.concatenate(([0], np.cumsum(hit)))
            touched = before[first[1:]] > before[first[:-1]]
            spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for i in np.flatnonzero(touched):
                mask = hit[first[i] : first[i + 1]].copy()
                for s in spans[i]:
                    mask[s["start"] : s["end"]] = True
                spans[i] = _span_list(mask)
            names = [sorted({*old, *(known.names[n] for n in new if known.names[n] is not None)}) for old, new in zip(old_items, items)]
            made = [pa.array(np.diff(first), pa.int64()), pa.array(np.maximum(longest, batch.column("longest").to_numpy()), pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, _SPANS)]
            columns = ["_id", *([] if last else ["_text"]), *extra]
            if last:
                texts = batch.column("_text").to_pylist()
                for i, s in enumerate(spans):
                    if s:
                        a, b = first[i], first[i + 1]
                        texts[i] = _cut_out(texts[i], s, starts[a:b] - offs[i], ends[a:b] - offs[i])
                made.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *made], names=[*columns, "n_words", "longest", "items", "spans", *["clean_text"] * last])

    return scan
