"""Quality rules as a short-circuit cascade.

Each rule compares statistics of a text.  On a sample the cost of each rule and the share it rejects
are measured; the cascade then runs the rules in the order of rejections per cost, and computes a
rule's statistics only for the texts that no earlier rule rejected.  The verdict does not depend on
the order.  A caller that wants all statistics has the rest of them computed after the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import kernels as K
from blockloom.llm.blocks import BLOCK_BYTES, slices
from blockloom.llm.shared import two_columns

SAMPLE_ROWS = 2_000
"""Rows on which costs and selectivities are estimated, at most."""
SAMPLE_TEXT_BYTES = 16_384
"""Longer texts take no part in the estimate, so that the sample stays within 32 MB; all are judged."""

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Texts:
    """A batch of texts, cut into words once.  A statistic is computed when a rule first asks for it, for
    the rows it asks for, and kept, so no rule and no later reader computes it again."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.data, self.offs = data, offs
        self.starts, self.ends, self.first = found or K.words(data, offs, K.NOT_SPACE)
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # values, and for which rows they stand
        self._part: tuple[np.ndarray, Texts] | None = None

    def __len__(self) -> int:
        return len(self.offs) - 1

    def take(self, rows: np.ndarray) -> Texts:
        """Some rows, ascending, as a batch of their own; their words are not looked for again."""
        if len(rows) == len(self):
            return self
        if self._part is None or not np.array_equal(self._part[0], rows):
            sizes, n_words = np.diff(self.offs)[rows], np.diff(self.first)[rows]
            offs, first = (np.concatenate(([0], np.cumsum(x))) for x in (sizes, n_words))
            byte, word = (np.arange(o[-1]) + np.repeat(whole[rows] - o[:-1], n) for o, whole, n in ((offs, self.offs, sizes), (first, self.first, n_words)))
            moved = np.repeat(offs[:-1] - self.offs[rows], n_words)
            self._part = rows, Texts(self.data[byte], offs, (self.starts[word] + moved, self.ends[word] + moved, first))
        return self._part[1]

    def get(self, name: str, rows: np.ndarray) -> np.ndarray:
        """A statistic of some rows."""
        values, have = self.known.setdefault(name, (np.zeros(len(self), np.int64), np.zeros(len(self), bool)))
        lacking = rows[~have[rows]]
        if len(lacking):
            values[lacking] = STATISTICS[name](self.take(lacking))
            have[lacking] = True
        return values[rows]

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes of a table's kind in each text."""
        sums = np.concatenate(([0], np.cumsum(table[self.data])))
        return sums[self.offs[1:]] - sums[self.offs[:-1]]

    def word_chars(self) -> np.ndarray:
        heads = np.concatenate(([0], np.cumsum(K.NOT_SPACE[self.data] & ((self.data & 0xC0) != 0x80))))
        return heads[self.offs[1:]] - heads[self.offs[:-1]]

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them that equal an earlier line of their text."""
        dup, all_ = np.zeros(len(self), np.int64), np.zeros(len(self), np.int64)
        raw = self.data.tobytes()
        for i, (a, b) in enumerate(zip(self.offs[:-1].tolist(), self.offs[1:].tolist())):
            lines = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
            all_[i], dup[i] = len(lines), len(lines) - len(set(lines))
        return all_, dup

    def repeat_words(self) -> np.ndarray:
        """Words in 3-word windows that their text holds twice or more."""
        hashed = K.hash_words(self.data, self.starts, self.ends)
        keys, at, doc = K.window_hashes(hashed, self.first, 3)
        order = np.lexsort((keys, doc))
        same = (keys[order][1:] == keys[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        sums = np.concatenate(([0], np.cumsum(K.covered(len(hashed), at[twice], 3))))
        return sums[self.first[1:]] - sums[self.first[:-1]]


STATISTICS: dict[str, Callable[[Texts], np.ndarray]] = {
    "n_words": lambda t: np.diff(t.first),
    "n_bytes": lambda t: np.diff(t.offs),
    "word_chars": lambda t: t.word_chars(),
    "n_symbols": lambda t: t.count(_SYMBOL),
    "n_upper": lambda t: t.count(_UPPER),
    "n_letters": lambda t: t.count(_LETTER),
    "n_lines": lambda t: t.lines[0],
    "n_dup_lines": lambda t: t.lines[1],
    "n_repeat_words": lambda t: t.repeat_words(),
}


@dataclass(frozen=True)
class Rule:
    """Rejects rows by some statistics, which come in the order they are named."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]

    def __call__(self, texts: Texts, rows: np.ndarray) -> np.ndarray:
        return self.rejects(*[texts.get(n, rows) for n in self.needs])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("symbols_to_words", ("n_symbols", "n_words"), lambda s, n: s > 0.3 * n),
    Rule("upper_case", ("n_upper", "n_letters"), lambda u, n: _share(u, n) > 0.5),
    Rule("few_letters", ("n_letters", "n_bytes"), lambda n, b: _share(n, b) < 0.3),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (_share(c, n) < 2) | (_share(c, n) > 15)),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: d > 0.5 * n),
    Rule("repeated_trigrams", ("n_repeat_words", "n_words"), lambda r, n: 2 * r > n),
)


def order_rules(sample: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[tuple[str, float, float]]:
    """(rule, seconds a row, share rejected) in the order of rejections per second; ties by name.

    A rule's cost is that of its statistics and its comparison; cutting texts into words is paid once
    by all of them and belongs to none."""
    whole = K.text_bytes(pa.array(sample, pa.string()))
    found = K.words(*whole, K.NOT_SPACE)
    measured = []
    for rule in rules:
        texts = Texts(*whole, found)
        began = time.perf_counter()
        rejected = rule(texts, np.arange(len(texts)))
        cost = (time.perf_counter() - began) / max(len(sample), 1)
        measured.append((rule.name, cost, float(np.mean(rejected)) if len(sample) else 0.0))
    return sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-12), m[0]))


def cascade(texts: Texts, rules: list[Rule]) -> np.ndarray:
    """For each text the number of the rule that rejected it first, or -1; a rule's statistics are
    computed only for texts that no earlier rule rejected."""
    verdict, alive = np.full(len(texts), -1), np.arange(len(texts))
    for number, rule in enumerate(rules):
        if not len(alive):
            break
        bad = rule(texts, alive)
        verdict[alive[bad]] = number
        alive = alive[~bad]
    return verdict


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7, statistics: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Judges whole texts by all rules: id, carried columns, kept and rejected_by (the rule that
    rejected first, null if kept), with statistics also n_words, word_chars, n_symbols, n_dup_lines
    and n_repeat_words.

    Null and empty texts have no words and no lines, and fail few_words.  Rows that repeat are judged
    alike. A null id stays null. An empty table gives an empty result; columns not named are ignored.
    """
    source = two_columns(docs, id_col, text_col, carry)
    few = source.select("_text").where(F.coalesce(F.octet_length("_text"), F.lit(0)) <= SAMPLE_TEXT_BYTES)
    sample = [r._text for r in few.sample(fraction=0.02, seed=seed).limit(sample_rows).collect()] or [r._text for r in few.limit(sample_rows).collect()]
    ordered = [m[0] for m in order_rules(sample, rules)]
    names = [f.name for f in source.schema if f.name != "_text"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")
    numbers = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") if statistics else ()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name = {r.name: r for r in rules}
        chain = [by_name[n] for n in ordered]
        for batch in (part for whole in batches for part in slices(whole, BLOCK_BYTES)):
            texts = Texts(*K.text_bytes(batch.column("_text")))
            verdict = cascade(texts, chain)
            out = [batch.column(n) for n in names] + [pa.array(verdict < 0), pa.array([None if v < 0 else ordered[v] for v in verdict], pa.string())]
            out += [pa.array(texts.get(n, np.arange(len(texts))), pa.int64()) for n in numbers]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "kept", "rejected_by", *numbers])

    done = source.mapInArrow(judge, types + ", kept boolean, rejected_by string" + "".join(f", {n} long" for n in numbers))
    return done.select(F.col("_id").alias(id_col), *[F.col(f"`_c{c}`").alias(c) for c in carry], "kept", "rejected_by", *numbers)
