"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets are one class from the start.  The signatures of class
representatives are banded; candidates of one bucket are compared batch by batch of their signatures
and dropped as soon as the posterior probability of the wanted similarity falls under the chosen miss
probability; survivors are verified exactly on full sets.  Verification goes in rounds, so that large
groups of near copies don't turn into all their pairs: first each candidate with the smallest member
of the bucket it shares most bands with, then, only where a bucket still holds several components,
each outsider with its likeliest partner, then every pair that is left, where it meets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import kernels as K
from blockloom.llm.shared import two_columns, written

BANDS, ROWS, BATCH = 32, 4, 32
"""A pair at similarity 0.8 shares no band of 32 x 4 with probability 5e-8."""
BROADCAST_IDS = 500_000
"""Ids of candidates, at most, that are broadcast to pick their texts; more are joined by shuffle."""
CELL = 4_096
"""Members of one bucket that one group compares; larger buckets are split into a grid of cells."""
SET_CELL, SET_CELL_BYTES = 512, 32 << 20
"""The same where members bring their full sets, and about how many bytes of sets they bring."""
_U = np.uint64
_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=_U) * _U(2) + _U(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=_U)


@lru_cache
def least_matches(threshold: float, miss: float, batch: int = BATCH, size: int = BANDS * ROWS) -> tuple[int, ...]:
    """For each number of compared values (batch, 2 batch, ...) the fewest matches that are not pruned.

    With a uniform prior P(J >= t | m of n match) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(batch, size + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's distinct hashes of k-word shingles, ascending; of fewer words all make one."""
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offs, K.NOT_SPACE)
    hashed = K.hash_words(data, starts, ends)
    keys, _, doc = K.window_hashes(hashed, first, k)
    bounds = np.searchsorted(doc, np.arange(len(first)))
    counts = np.diff(first)
    out = []
    for i, n in enumerate(counts):
        if n == 0:
            out.append(keys[:0])
        elif n < k:
            out.append(K.window_hashes(hashed[first[i] : first[i + 1]], np.array([0, n]), int(n))[0] ^ _U(int(n)))
        else:
            out.append(K.distinct(keys[bounds[i] : bounds[i + 1]]))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row of 32-bit numbers for each set (zeros for an empty one)."""
    out = np.zeros((len(sets), BANDS * ROWS), np.uint32)
    filled = [i for i, s in enumerate(sets) if len(s)]
    step = 1 << 15  # rows of the concatenation at once stay within the cache
    at = 0
    while at < len(filled):
        end, size = at, 0
        while end < len(filled) and (size == 0 or size + len(sets[filled[end]]) <= step):
            size += len(sets[filled[end]])
            end += 1
        group = filled[at:end]
        values = np.concatenate([sets[i] for i in group])
        begins = np.cumsum([0] + [len(sets[i]) for i in group[:-1]])
        for j in range(BANDS * ROWS):
            out[group, j] = np.minimum.reduceat((values * _MULTIPLY[j] + _ADD[j]) >> _U(32), begins)
        at = end
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = sigs.reshape(len(sigs), BANDS, ROWS).astype(_U)
    total = np.arange(BANDS, dtype=_U)[None, :] + _U(1)
    for r in range(ROWS):
        total = K.mix(total * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return total.view(np.int64)


def survivors(one: np.ndarray, many: np.ndarray, threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of many that may reach the threshold with one, and their matches; batch after batch."""
    alive, matches = np.arange(len(many)), np.zeros(len(many), np.int64)
    for b, least in enumerate(least_matches(threshold, miss)):
        part = slice(b * BATCH, (b + 1) * BATCH)
        matches = matches + (many[alive, part] == one[part]).sum(1)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
        if not len(alive):
            break
    return alive, matches


def _sketch(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = shingle_sets(*K.text_bytes(batch.column("_text")), k)
                sigs = signatures(sets)
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([s.tobytes() for s in sigs], pa.binary())], names=["_id", "n_shingles", "print", "sig"])
        K.release()

    return sketch


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
        keys, n = band_keys(sigs), batch.num_rows
        ids, sizes = batch.column("node").to_numpy(), batch.column("n_shingles").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(np.repeat(ids, BANDS)), pa.array(np.repeat(sizes, BANDS))], names=["key", "band", "node", "n_shingles"])


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = shingle_sets(*K.text_bytes(batch.column("_text")), k)
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([s.tobytes() for s in signatures(found)], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "sig", "set"])
        K.release()

    return sets


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, for ascending arrays of distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(K.distinct(np.concatenate((a, b))))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int, miss: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (sa, sb, xa, xb) in enumerate(zip(*[batch.column(c) for c in ("sig_a", "sig_b", "set_a", "set_b")])):
                one, many = np.frombuffer(sa.as_buffer(), np.uint32), np.frombuffer(sb.as_buffer(), np.uint32)[None, :]
                if len(survivors(one, many, percent / 100, miss)[0]) and similar(np.frombuffer(xa.as_buffer(), _U), np.frombuffer(xb.as_buffer(), _U), percent):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    return verify


class _Cell:
    """Outsiders and members of one cell, and the pairs of them that the signatures leave.

    A pair counts in the bucket of the first band it shares, so it is looked at once."""

    def __init__(self, group: pa.Table, threshold: float, miss: float):
        self.threshold, self.miss = threshold, miss
        self.band = group.column("band")[0].as_py()
        self.node, self.comp, outside, member = (group.column(c).to_numpy() for c in ("node", "comp", "outside", "member"))
        self.sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
        self.outsiders, self.members = np.flatnonzero(outside), np.flatnonzero(member)

    def partners(self, x: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of others that may be linked with row x, the likeliest first, and their matches."""
        found, matches = survivors(self.sigs[x], self.sigs[others], self.threshold, self.miss)
        at = others[found]
        first = (self.sigs[at] == self.sigs[x]).reshape(len(at), BANDS, ROWS).all(2).argmax(1) == self.band
        at, matches = at[first], matches[first]
        order = np.lexsort((self.node[at], -matches))
        return at[order], matches[order]


def _likeliest(threshold: float, miss: float):
    """(x, y, matches): each outsider's likeliest partner in another component of its cell."""

    def choose(group: pa.Table) -> pa.Table:
        c = _Cell(group, threshold, miss)
        rows = []
        for x in c.outsiders:
            at, matches = c.partners(x, c.members[c.comp[c.members] != c.comp[x]])
            if len(at):
                rows.append((c.node[x], c.node[at[0]], matches[0]))
        return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("x", "y", "matches"))})

    return choose


def _linked(threshold: float, miss: float, percent: int):
    """(a, b): exactly verified links that join components of a cell; a pair whose components are
    already one needs no look, so a cell gives fewer links than it has nodes."""

    def link(group: pa.Table) -> pa.Table:
        c = _Cell(group, threshold, miss)
        blobs = group.column("set").to_pylist()
        names, comp = np.unique(c.comp, return_inverse=True)
        parent = list(range(len(names)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        rows = []
        for x in c.outsiders:
            own = np.frombuffer(blobs[x], _U)
            for y in c.partners(x, c.members[comp[c.members] != comp[x]])[0]:
                i, j = find(comp[x]), find(comp[y])
                if i != j and similar(own, np.frombuffer(blobs[y], _U), percent):
                    parent[max(i, j)] = min(i, j)
                    rows.append((c.node[x], c.node[y]))
        return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate("ab")})

    return link


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp): the smallest node reachable, by alternating large-star and small-star steps.

    Every step is aggregation with partial sums and joins, written before the next begins."""
    current = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), name)
    state = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lower, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        current = written(small, name)
        told = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == state:
            break
        state = told
    return current.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """Links documents whose shingle sets have 100 * |intersection| >= percent * |union|.

    Words are lower-cased in A-Z and split at ASCII white space; a document's set holds its distinct
    shingles of ``shingle`` words, or its whole word sequence if it has fewer.  Returns for each row of
    docs: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id).

    Null and empty texts have no shingles and link with nothing.  Rows that repeat an id are linked
    each by its own text, all under that id.  A null id links with nothing: component_id is null and kept true.
    Empty tables give empty results; other columns are ignored. ``miss`` is the posterior probability
    under which signatures rule a pair out.
    """
    source = two_columns(docs, id_col, text_col)
    sketched = written(source.mapInArrow(_sketch(shingle), "_id long, n_shingles long, print binary, sig binary"), "near-sketches")
    classes = sketched.where("print is not null and _id is not null").groupBy("print").agg(F.min(F.struct("_id", "sig", "n_shingles")).alias("m")).select("print", F.col("m._id").alias("node"), F.col("m.sig").alias("sig"), F.col("m.n_shingles").alias("n_shingles"))
    classes = written(classes, "near-classes")
    banded = classes.select("node", "sig", "n_shingles").mapInArrow(_bands, "key long, band int, node long, n_shingles long")
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.count("*").alias("n")).where("hub < top")
    buckets = written(banded.join(hubs.drop("top"), "key"), "near-buckets", gather=True)
    ids = written(buckets.select("node").distinct(), "near-candidates")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = source.join(F.broadcast(ids) if few else ids, F.col("_id") == F.col("node"), "left_semi")
    sets = written(wanted.where("_text is not null").mapInArrow(_sets(shingle), "node long, sig binary, set binary"), "near-sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) that are links.  A hub a may have any number of pairs; adaptive execution parts
        such a key of a sorted join, each part with its own copy of the hub's row."""
        side = lambda s: sets.select(F.col("node").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("set").alias(f"set_{s}"))
        return written(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sig_a", "sig_b", "set_a", "set_b").mapInArrow(_verify(percent, miss), "a long, b long"), name, gather=True)

    # Round one: each candidate and the hub it shares most bands with.
    shared = buckets.where("node != hub").groupBy("node", "hub").count()
    star = shared.groupBy("node").agg(F.max(F.struct("count", (-F.col("hub")).alias("minus"))).alias("m")).select((-F.col("m.minus")).alias("a"), F.col("node").alias("b"))
    edges = verified(star, "near-links")

    def cells(comp: DataFrame, size: int, set_bytes: int | None = None) -> DataFrame:
        """Members of buckets that hold several components; a cell has at most about ``size`` members
        (and ``set_bytes`` of their sets) and as many outsiders, those not in the bucket's largest component."""
        rows = buckets.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).drop("n", "hub")
        per = rows.groupBy("key", "comp").agg(F.count("*").alias("count"), F.sum(F.col("n_shingles") * 8).alias("bytes"))
        sums = per.groupBy("key").agg(F.max(F.struct("count", (-F.col("comp")).alias("minus"), "bytes")).alias("m"), F.sum("count").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("comps")).where("comps > 1")
        parts = lambda n, b: (F.greatest(F.ceil(n / size), F.ceil(b / set_bytes)) if set_bytes else F.ceil(n / size)).cast("int")
        sums = sums.select("key", (-F.col("m.minus")).alias("main"), parts(F.col("n"), F.col("bytes")).alias("wide"), parts(F.col("n") - F.col("m.count"), F.col("bytes") - F.col("m.bytes")).alias("high"))
        mixed = rows.drop("n_shingles").join(sums, "key").withColumn("out", F.col("comp") != F.col("main"))
        mixed = mixed.withColumn("col", F.pmod(F.xxhash64("node"), F.col("wide")).cast("int")).withColumn("row", F.pmod(F.xxhash64("node", F.lit(1)), F.col("high")).cast("int"))
        as_member = mixed.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("high") - 1))).withColumns({"outside": F.lit(False), "member": F.lit(True)})
        as_out = mixed.where("out").withColumn("col", F.explode(F.sequence(F.lit(0), F.col("wide") - 1))).withColumns({"outside": F.lit(True), "member": F.lit(False)})
        return as_member.unionByName(as_out).groupBy("key", "band", "row", "col", "node", "comp").agg(F.max("outside").alias("outside"), F.max("member").alias("member"))

    # Round two: each outsider's likeliest partner.
    likely = cells(components(edges), CELL).join(classes.select("node", "sig"), "node").groupBy("key", "row", "col").applyInArrow(_likeliest(percent / 100, miss), "x long, y long, matches long")
    best = likely.groupBy("x").agg(F.max(F.struct("matches", (-F.col("y")).alias("minus"))).alias("m")).select("x", (-F.col("m.minus")).alias("y"))
    edges = edges.unionByName(verified(best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-links"))
    # Round three: all pairs left over, verified where they meet.
    comp = components(edges)
    last = written(cells(comp, SET_CELL, SET_CELL_BYTES).join(sets, "node").groupBy("key", "row", "col").applyInArrow(_linked(percent / 100, miss, percent), "a long, b long"), "near-links", gather=True)
    if last.limit(1).count():
        comp = components(edges.unionByName(last))
    per_class = classes.select("print", "node").join(comp, "node", "left").select("print", F.coalesce("comp", "node").alias("comp"))
    rows = sketched.select("_id", "n_shingles", "print")
    # Texts without shingles have no print and meet in no join.
    rows = rows.where("print is not null").join(per_class, "print", "left").select("_id", "n_shingles", "comp").unionByName(rows.where("print is null").select("_id", "n_shingles", F.lit(None).cast("long").alias("comp")))
    component = F.when(F.col("_id").isNotNull(), F.coalesce("comp", "_id"))
    return rows.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))
