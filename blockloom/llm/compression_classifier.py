"""Quality classifier by compression: two zstandard dictionaries, one built from good and one from bad
labelled texts.  A text is compressed with both, piece by piece over its whole length; the normalised
difference of the sizes goes through a logistic calibration fitted on labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.shared import two_columns

TRAIN_ROWS = 2_000
"""Labelled rows of each class that train the model, at most: the first by a hash of their id."""
TRAIN_BYTES = 8 << 20
"""Bytes of text of each class that train the model, at most; a text over the rest is left out."""
DICTIONARY_BYTES = 110_000
PIECE_BYTES = 512
LEVEL = 3


def _pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; of too little text to train on, the text itself."""
    pieces = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(**options)
    made = zstandard.ZstdCompressionDict(dictionary)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=made, **options)


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def differences(self, texts: list[str | None]) -> np.ndarray:
        """(bytes with the bad dictionary - bytes with the good one) / their sum; 0 for empty texts."""
        good, bad = _compressor(self.good), _compressor(self.bad)
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            pieces = _pieces(text)
            g, b = sum(len(good.compress(p)) for p in pieces), sum(len(bad.compress(p)) for p in pieces)
            out[i] = (b - g) / (b + g) if pieces else 0.0
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(texts) + self.offset, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, prior: float = 0.5, ridge: float = 1e-4, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one feature by Newton steps.

    The classes weigh as their shares among all labels (prior: that of the good), so that a score is
    the probability of a good label however many rows of each class were taken to fit."""
    scale = max(float(np.std(x)), 1e-9)
    w = np.where(y == 1, prior / max((y == 1).sum(), 1), (1 - prior) / max((y == 0).sum(), 1))
    a, beta = np.column_stack((x / scale, np.ones(len(x)))), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (w * (p - y)) + ridge * beta * [1, 0]
        hessian = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag([ridge, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def held_out(id_col) -> F.Column:
    """Rows whose labels nothing is learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> CompressionModel:
    """Fits on at most train_rows rows of each class that are not held out.

    Half of them build the dictionaries and the other half calibrate; with fewer than two rows of a
    class, all do both. Null labels, ids and texts are left out; of rows that repeat an id the shortest text
    trains, ties to the first in order; without both classes every score is 0.5."""
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    known = labels.select(q(id_col).cast("long").alias("_id"), q(label_col).cast("int").alias("y")).where("_id is not null and y in (0, 1)").where(~held_out(F.col("_id")))
    prior = known.agg(F.avg("y")).first()[0] or 0.5
    order = F.xxhash64("_id")
    wanted = [(r._id, r.y) for y in (0, 1) for r in known.where(F.col("y") == y).distinct().orderBy(order, "_id").limit(train_rows).collect()]
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame(wanted, "_id long, y int"))
    rows = two_columns(docs, id_col, text_col).join(chosen, "_id").where("_text is not null and length(_text) > 0")
    few = rows.where(F.octet_length("_text") <= train_bytes // 8).groupBy("_id", "y").agg(F.min(F.struct(F.octet_length("_text").alias("n"), "_text")).alias("m")).select("_id", "y", "m.n", "m._text")
    texts: dict[int, list[str]] = {0: [], 1: []}
    left = {0: train_bytes, 1: train_bytes}
    for r in few.orderBy(order, "_id", "y").toLocalIterator():
        if r.n <= left[r.y]:
            left[r.y] -= r.n
            texts[r.y].append(r._text)
    if not texts[0] or not texts[1]:
        return CompressionModel(b"", b"", 0.0, 0.0)
    split = {y: (t[::2], t[1::2] or t) for y, t in texts.items()}
    plain = CompressionModel(_dictionary(split[1][0]), _dictionary(split[0][0]), 1.0, 0.0)
    x = plain.differences(split[1][1] + split[0][1])
    y = np.array([1] * len(split[1][1]) + [0] * len(split[0][1]))
    return CompressionModel(plain.good, plain.bad, *calibrate(x, y, prior))


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """Scores whole texts: id, carried columns, held_out, score (0 to 1, higher: likelier good),
    predicted (1 from 0.5 on) and, if asked, the text.

    Null and empty texts get the calibration's score of no difference. Repeated rows score alike, null
    ids stay null and are not held out, empty tables give empty results, other columns are ignored.
    """
    source = two_columns(docs, id_col, text_col, carry)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if keep_text or f.name != "_text")
    names = [n for n in source.columns if keep_text or n != "_text"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = shared.value.scores(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(values, pa.float64())], names=[*names, "score"])

    done = source.mapInArrow(judge, types + ", score double")
    text = [F.col("_text").alias(text_col)] if keep_text else []
    return done.select(F.col("_id").alias(id_col), *[F.col(f"`_c{c}`").alias(c) for c in carry], *text, held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """fit() on the labelled rows, then score() of all rows."""
    known = {k: v for k, v in names.items() if k in ("id_col", "text_col")}
    model = fit(docs, labels, **known, **{k: v for k, v in names.items() if k in ("label_col", "train_rows", "train_bytes")})
    return score(docs, model, **known, **{k: v for k, v in names.items() if k in ("carry", "keep_text")})
