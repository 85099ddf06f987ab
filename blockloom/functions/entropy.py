"""Entropy coders.  Rates that a histogram gives are SQL; bit-serial coders run per stream in batches."""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bits_of(values: Iterable[int], width: int) -> str:
    """Whole numbers as bits of a fixed width, most significant first."""
    return "".join(format(int(v), f"0{width}b") for v in values)


def numbers_of(bits: str, width: int) -> list[int]:
    return [int(bits[i : i + width], 2) for i in range(0, len(bits) - width + 1, width)]


def pack_bits(bits: str) -> bytes:
    """Bits as bytes, most significant first, the last byte filled with zeros."""
    return np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48).tobytes()


def unpack_bits(data: bytes, n: int | None = None) -> str:
    return (np.unpackbits(np.frombuffer(data, np.uint8), count=n) + 48).tobytes().decode()


def huffman_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths of symbols with positive counts; a single symbol has one bit."""
    heap = [(n, s, [s]) for s, n in counts.items() if n > 0]
    lengths = {s: 0 for _, s, _ in heap}
    if len(heap) == 1:
        return {heap[0][1]: 1}
    heapq.heapify(heap)
    while len(heap) > 1:
        n, a, x = heapq.heappop(heap)
        m, b, y = heapq.heappop(heap)
        for s in x + y:
            lengths[s] += 1
        heapq.heappush(heap, (n + m, min(a, b), x + y))
    return lengths


def canonical_codes(lengths: dict[int, int]) -> dict[int, str]:
    """Prefix codes of given lengths, assigned by length and symbol."""
    codes, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        codes[s] = format(code, f"0{n}b")
        code, last = code + 1, n
    return codes


class Huffman:
    """A code from counts; an unknown symbol is an error."""

    def __init__(self, counts: dict[int, int]):
        self.lengths = huffman_lengths(counts)
        self.codes = canonical_codes(self.lengths)

    @classmethod
    def flat(cls, symbols: int) -> Huffman:
        return cls({s: 1 for s in range(1 << max(0, symbols - 1).bit_length())})

    def encode(self, symbols: Iterable[int]) -> str:
        return "".join([self.codes[int(s)] for s in symbols])

    def decode(self, bits: str) -> list[int]:
        back, out, at = {c: s for s, c in self.codes.items()}, [], ""
        for b in bits:
            at += b
            if at in back:
                out.append(back[at])
                at = ""
        if at:
            raise ValueError("the stream ends within a code")
        return out


def huffman_bits(counts: DataFrame, by: list[str] | None = None, smooth: int = 0) -> DataFrame:
    """Total bits of (symbol, n) rows under the code of n + smooth, by key; one key's counts per group,
    bounded by the alphabet."""
    by = by or []

    def total(group: pd.DataFrame) -> pd.DataFrame:
        n = dict(zip(group["symbol"].tolist(), (group["n"] + smooth).tolist()))
        lengths = huffman_lengths(n)
        bits = sum(k * lengths.get(s, 0) for s, k in zip(group["symbol"].tolist(), group["n"].tolist()))
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in by}, "bits": [int(bits)]})

    kinds = {f.name: f.dataType.simpleString() for f in counts.schema}
    keyed = counts if by else counts.withColumn("_all", F.lit(0))
    out = keyed.groupBy(*(by or ["_all"])).applyInPandas(total, ", ".join([f"{k} {kinds[k]}" for k in by] + ["bits long"]))
    return out


class FrequencyTable:
    """Counts of symbols with cumulative sums; checked against use outside the alphabet."""

    def __init__(self, counts: Iterable[int]):
        self.counts = [int(c) for c in counts]
        if not self.counts or min(self.counts) < 0:
            raise ValueError("counts must be given and not negative")
        self._sums: list[int] | None = None

    @classmethod
    def flat(cls, symbols: int) -> FrequencyTable:
        return cls([1] * symbols)

    @property
    def sums(self) -> list[int]:
        if self._sums is None:
            self._sums = [0, *accumulate(self.counts)]
        return self._sums

    @property
    def total(self) -> int:
        return self.sums[-1]

    def increment(self, symbol: int) -> None:
        self.counts[symbol] += 1
        self._sums = None

    def range_of(self, symbol: int) -> tuple[int, int]:
        if not 0 <= symbol < len(self.counts):
            raise ValueError(f"symbol {symbol} is not in the alphabet")
        return self.sums[symbol], self.sums[symbol + 1]


class _Range:
    """Interval arithmetic that coder and decoder share: low and high within a fixed number of bits."""

    def __init__(self, bits: int):
        self.bits, self.low, self.high = bits, 0, (1 << bits) - 1
        self.half, self.quarter, self.mask = 1 << bits - 1, 1 << bits - 2, (1 << bits) - 1

    def narrow(self, table: FrequencyTable, symbol: int) -> None:
        a, b = table.range_of(symbol)
        if a == b:
            raise ValueError(f"symbol {symbol} has no frequency")
        if table.total > min(self.quarter + 2, (1 << 62) // (1 << self.bits)):
            raise ValueError("the total of the frequencies is too large")
        width = self.high - self.low + 1
        self.low, self.high = self.low + a * width // table.total, self.low + b * width // table.total - 1
        while True:
            if not (self.low ^ self.high) & self.half:
                self.settled()
                self.low, self.high = self.low << 1 & self.mask, self.high << 1 & self.mask | 1
            elif self.low & ~self.high & self.quarter:
                self.pending()
                self.low, self.high = self.low << 1 ^ self.half, (self.high ^ self.half) << 1 | self.half | 1
            else:
                return


class RangeEncoder(_Range):
    def __init__(self, bits: int = 32):
        super().__init__(bits)
        self.out: list[str] = []
        self.waiting = 0

    def settled(self) -> None:
        bit = self.low >> self.bits - 1
        self.out.append(f"{bit}" + f"{1 - bit}" * self.waiting)
        self.waiting = 0

    def pending(self) -> None:
        self.waiting += 1

    def finish(self) -> str:
        """All bits, closed by one and filled up to whole bytes."""
        bits = "".join(self.out) + "1"
        return bits + "0" * (-len(bits) % 8)


class RangeDecoder(_Range):
    def __init__(self, stream: str, bits: int = 32):
        super().__init__(bits)
        self.stream, self.at = stream, bits
        self.code = int(stream[:bits].ljust(bits, "0"), 2)

    def _bit(self) -> int:
        self.at += 1
        return int(self.stream[self.at - 1]) if self.at <= len(self.stream) else 0

    def settled(self) -> None:
        self.code = self.code << 1 & self.mask | self._bit()

    def pending(self) -> None:
        self.code = self.code & self.half | self.code << 1 & self.mask >> 1 | self._bit()

    def read(self, table: FrequencyTable) -> int:
        width = self.high - self.low + 1
        value = ((self.code - self.low + 1) * table.total - 1) // width
        symbol = int(np.searchsorted(table.sums, value, "right")) - 1
        self.narrow(table, symbol)
        return symbol


def range_encode(symbols: Iterable[int], alphabet: int, counts: Iterable[int] | None = None, bits: int = 32) -> str:
    """Symbols and an end mark under fixed counts (plus one end), or adaptively from flat counts."""
    table = FrequencyTable.flat(alphabet + 1) if counts is None else FrequencyTable([*counts, 1])
    coder = RangeEncoder(bits)
    for s in [*symbols, alphabet]:
        coder.narrow(table, int(s))
        if counts is None:
            table.increment(int(s))
    return coder.finish()


def range_decode(stream: str, alphabet: int, counts: Iterable[int] | None = None, bits: int = 32) -> list[int]:
    table = FrequencyTable.flat(alphabet + 1) if counts is None else FrequencyTable([*counts, 1])
    decoder, out = RangeDecoder(stream, bits), []
    while (s := decoder.read(table)) != alphabet:
        out.append(s)
        if counts is None:
            table.increment(s)
    return out


# Interval sizes of the adaptive binary coder's states, and how far a miss steps back.
INTERVALS = (
    0x59EB, 0x5522, 0x504F, 0x4B85, 0x4639, 0x415E, 0x3C3D, 0x375E, 0x32B4, 0x2E17, 0x299A, 0x2516, 0x1EDF, 0x1AA9, 0x174E, 0x1424,
    0x119C, 0x0F6B, 0x0D51, 0x0BB6, 0x0A40, 0x0861, 0x0706, 0x05CD, 0x04DE, 0x040F, 0x0363, 0x02D4, 0x025C, 0x01F8, 0x01A4, 0x0160,
    0x0125, 0x00F6, 0x00CB, 0x00AB, 0x008F, 0x0068, 0x004E, 0x003B, 0x002C, 0x001A, 0x000D, 0x0006, 0x0003, 0x0001,
)
STEPS_BACK = (-1, 1, 1, 1, 1, 1, 1, 1, 2, 1, 2, 1, 1, 1, 1, 1, 1, 2, 2, 1, 2, 2, 2, 2, 1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 1, 2, 2, 2, 2, 2, 3, 2, 2, 2, 1)
FIRST_STATE = 12


def binary_bits(symbols: Iterable[int]) -> int:
    """Bits the adaptive binary coder emits for a stream: one at each renormalisation, one a carry."""
    size, code, state, likely, carry, bits = 0x10000, 0, FIRST_STATE, 0, False, 0
    for s in symbols:
        part = INTERVALS[state]
        size -= part
        hit = s == likely
        if hit and size >= 0x8000:
            continue
        if (size < part) == hit:  # the larger interval goes to the likelier symbol
            carry = carry or size + code > 0xFFFF
            code, size = (code + size) & 0xFFFF, part
        if hit:
            state = min(state + 1, len(INTERVALS) - 1)
        else:
            state -= STEPS_BACK[state]
            if STEPS_BACK[state] < 0:
                likely = 1 - likely
        bits += 1 + carry
        carry = False
        while size < 0x8000:
            size *= 2
        code = code << 1 & 0xFFFF
    return bits


def mask_stream_bits(contexts: DataFrame, mask: str = "coded", by: list[str] | None = None, frames_per_slice: int = 0) -> DataFrame:
    """(by, bits) of a mask coded by one adaptive state per context, all frames in order.

    A context's symbols depend on all before them, so each context is one ordered stream: the bits
    of a stream travel packed per frame, and the coder reads them frame after frame.  With
    frames_per_slice the states begin anew after so many frame ids, which bounds a stream and lets
    slices be coded side by side, at a few more bits."""
    by = by or []
    sliced = contexts.withColumn("_slice", F.floor(F.col("frame_id") / frames_per_slice) if frames_per_slice else F.lit(0).cast("long"))
    per_frame = sliced.groupBy(*by, "ctx", "_slice", "frame_id").agg(F.array_sort(F.collect_list(F.struct("bi", "bj", F.col(mask).cast("int").alias("m")))).alias("ms"))
    packed = per_frame.select(*by, "ctx", "_slice", "frame_id", F.array_join(F.transform("ms", lambda s: s["m"].cast("string")), "").alias("bits"))
    kinds = {f.name: f.dataType.simpleString() for f in contexts.schema}

    def count(group: pd.DataFrame) -> pd.DataFrame:
        stream = "".join(group.sort_values("frame_id")["bits"])
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in by}, "n": [binary_bits(b == "1" for b in stream)]})

    counted = packed.groupBy(*by, "ctx", "_slice").applyInPandas(count, ", ".join([f"{k} {kinds[k]}" for k in by] + ["n long"]))
    return counted.groupBy(*by).agg(F.sum("n").alias("bits"))


def context_code_lengths(histogram: DataFrame) -> DataFrame:
    """(ctx, symbol, length): a Huffman code for each context's counts."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        lengths = huffman_lengths(dict(zip(group["symbol"].tolist(), group["n"].tolist())))
        return pd.DataFrame({"ctx": group["ctx"].iloc[0], "symbol": list(lengths), "length": list(lengths.values())})

    return histogram.groupBy("ctx").applyInPandas(fit, "ctx string, symbol int, length int")


def context_bits(rows: DataFrame, codes: DataFrame, symbols: int, symbol: str = "label") -> DataFrame:
    """Total bits of symbols under their context's code; an unseen context has a flat one."""
    flat = max(1, (symbols - 1).bit_length())
    counts = rows.groupBy("ctx", F.col(symbol).cast("int").alias("symbol")).agg(F.count("*").alias("n"))
    return counts.join(codes, ["ctx", "symbol"], "left").agg(F.sum(F.col("n") * F.coalesce("length", F.lit(flat))).alias("bits"))
