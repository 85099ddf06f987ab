"""Substring dedup, suffix-array dedup and near-dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from samples import documents, edge_rows, prose

from blockloom.llm import kernels as K
from blockloom.llm.near_dedup import least_matches, near_dedup, similar, survivors
from blockloom.llm.substring_dedup import add_sketches, estimates, substring_dedup
from blockloom.llm.suffix_dedup import anchors, judge_contexts, repeated_starts, suffix_array, suffix_dedup

BIG = (1 << 63) - 1


def key(i):
    return BIG if i is None else i


def brute_words(rows, k):
    least = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for a in range(len(w) - k + 1):
            x = tuple(w[a : a + k])
            least[x] = min(least.get(x, BIG), key(i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if least[tuple(w[a : a + k])] < key(i):
                gone[a : a + k] = [True] * k
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def order(rows):
    return sorted(rows, key=str)


def test_substring_dedup_edges(spark):
    rows = edge_rows()
    got = substring_dedup(documents(spark, rows), window=13, carry=("lang", "k")).collect()
    assert order((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == order(brute_words(rows, 13))
    assert all(r.lang == "en" and r.k == 9 for r in got)
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert (r.full_text == r.kept_text) if r.n_removed else ((r.doc_id, r.full_text) in rows)


def test_substring_dedup_sees_all_blocks(spark, monkeypatch):
    from blockloom.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(blocks, "SHARD_KEYS", 3_000)
    rng = random.Random(1)
    shared = [prose(rng, 30) for _ in range(4)]
    rows = [(i * 7 % 101, " ".join(rng.choice(shared) if rng.random() < 0.3 else prose(rng, rng.randint(1, 60)) for _ in range(3))) for i in range(101)]
    got = substring_dedup(documents(spark, rows).repartition(5), window=8).collect()
    assert order((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == order(brute_words(rows, 8))


def test_empty_tables(spark):
    none = documents(spark, []).where("false")
    assert substring_dedup(none).count() == 0
    assert suffix_dedup(none).count() == 0
    assert near_dedup(none).count() == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(4)
    parts = [np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64)) for _ in range(4)]
    parts.append(parts[0][:100])
    sums = add_sketches(parts, 2)
    assert (estimates(sums, parts[4]) == 2).all()
    assert (estimates(sums, parts[1]) >= 1).all() and (estimates(sums, parts[1]) == 1).mean() > 0.8


def test_suffix_array_sorts_suffixes():
    rng = random.Random(3)
    for _ in range(400):
        x = [rng.randint(0, rng.choice([0, 1, 3])) for _ in range(rng.randint(1, 50))]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_anchors_cover_every_string_once():
    rng = random.Random(5)
    for length in (6, 7, 20):
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 80))) for _ in range(6)]
        offs = np.cumsum([0] + [len(t) for t in texts])
        places, _, low, high = anchors(np.frombuffer(b"".join(texts), np.uint8), offs, length)
        starts = [s for a, b in zip(low, high) for s in range(a, b + 1)]
        assert starts == [s for a, b in zip(offs, offs[1:]) for s in range(a, b - length + 1)]
        assert all(b <= p <= a + length // 2 for p, a, b in zip(places, low, high))


@pytest.mark.parametrize("size", [1, 30, 10_000])
def test_judged_contexts_match_brute_force(size):
    rng = random.Random(6)
    for _ in range(80):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 14))) for _ in range(rng.randint(1, 6))]
        contexts = Counter()
        for t in texts:
            contexts[(t, 4)] = min(2, contexts[(t, 4)] + 1)
        got = judge_contexts({1: dict(contexts)}, 8, size)
        for (t, p), mask in got.items():
            for s, hit in enumerate(mask):
                aligned = sum((u[s - p + q : s - p + q + 8] == t[s : s + 8]) * n for (u, q), n in contexts.items() if 0 <= s - p + q <= len(u) - 8)
                anywhere = sum(n * sum(u[x : x + 8] == t[s : s + 8] for x in range(len(u) - 7)) for (u, _), n in contexts.items())
                # With real anchors equal strings are aligned; without them unaligned ones may go unseen.
                assert hit or aligned <= 1
                assert not hit or anywhere > 1


def test_repeated_starts():
    got = repeated_starts([b"abcdefgh", b"xxcdefgxx", b"zz"], 4)
    assert [x.tolist() for x in got] == [[False, False, True, True, False], [False, False, True, True, False, False], []]


@pytest.mark.parametrize(("length", "size"), [(40, 1 << 17), (200, 1 << 17), (40, 100), (200, 2)])
def test_suffix_dedup_edges(spark, length, size):
    rows = [r for r in edge_rows() if r[0] != 19] + [(19, prose(random.Random(2), 3_000))]
    got = suffix_dedup(documents(spark, rows), length=length, text_bytes=size, carry=("source",)).collect()
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[s : s + length] for _, t in raw for s in range(len(t) - length + 1))
    want = []
    for i, t in raw:
        gone = K.covered(len(t), np.array([s for s in range(len(t) - length + 1) if seen[t[s : s + length]] > 1], np.int64), length) if t else np.zeros(0, bool)
        want.append((i, len(t), int(gone.sum()), len(K.runs(gone)[0]), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    assert order((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in got) == order(want)


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    for i, s in sets.items():
        both = Counter(j for g in s for j in inverted[g] if j < i)
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_dedup_matches_brute_force(spark):
    rng, rows = random.Random(1), []
    vocabulary = [f"w{i}" for i in range(2_000)]
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.choice([1, 2, 3, 40])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            base = w if rng.random() < 0.3 else base
            rows.append((len(rows) * 3 % 1_009, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, "a b"), (5003, "A b"), (5004, "a b c"), (5005, " "), (None, rows[0][1])]
    got = near_dedup(documents(spark, rows), shingle=4).collect()
    want = brute_components([r for r in rows if r[0] is not None], 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_near_dedup_splits_large_buckets(spark, monkeypatch):
    from blockloom.llm import near_dedup as module

    monkeypatch.setattr(module, "CELL", 8)
    monkeypatch.setattr(module, "SET_CELL", 5)
    rng = random.Random(9)
    base, rows = [f"v{i}" for i in range(60)], []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = near_dedup(documents(spark, rows), shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 80)


def test_near_dedup_gathers_few_links_in_few_files(spark, monkeypatch):
    from blockloom.llm import near_dedup as module

    files, write = {}, module.written

    def counted(df, name, **how):
        out = write(df, name, **how)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(module, "written", counted)
    rng, rows = random.Random(4), []
    for i in range(1_500):
        w = [f"u{rng.randrange(10**6)}" for _ in range(2_000 if i < 40 else 20)]
        rows.append((2 * i, " ".join(w)))
        if i < 40:
            w[7] = "changed"
            rows.append((2 * i + 1, " ".join(w)))
    wide = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {c: spark.conf.get(c) for c in wide}
    try:
        for c, x in wide.items():
            spark.conf.set(c, x)
        got = near_dedup(documents(spark, rows), shingle=4).collect()
    finally:
        for c, x in before.items():
            spark.conf.set(c, x)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 80)
    assert max(files["near-links"]) == 1 and files["near-buckets"][0] <= 2


def test_bayesian_bounds():
    least = least_matches(0.8, 1e-7)
    assert len(least) == 4 and list(least) == sorted(least) and all(m < 0.8 * n for m, n in zip(least, (32, 64, 96, 128)))
    one = np.arange(128, dtype=np.uint32)
    many = np.stack([one, one + 1000, np.where(one % 10 < 9, one, 0)])
    assert survivors(one, many, 0.8, 1e-7)[0].tolist() == [0, 2]
    a = np.arange(10, dtype=np.uint64)
    assert similar(a, a[:8], 80) and not similar(a, a[:7], 80)


def thue_morse(n, letters="ab"):
    w = letters[0]
    while len(w) < n:
        w += w.translate(str.maketrans(letters, letters[::-1]))
    return w


def test_hashes_tell_words_of_mirrored_repeats_apart(spark):
    """Words and windows that a polynomial hash modulo 2^64 takes for equal, for any of its bases."""
    from blockloom.llm.decontamination import decontaminate
    from blockloom.llm.quality_rules import Texts

    one, two = thue_morse(1_024), thue_morse(1_024, "ba")
    for which in (0, 1):
        data, offs = K.text_bytes(pa.array([one, two, one[:200], two[:200], " ".join(one), " ".join(two)]))
        starts, ends, first = K.words(data, offs, K.NOT_SPACE)
        hashed = K.hash_words(data, starts, ends, which)
        assert len(set(hashed[:4].tolist())) == 4
        keys, _, doc = K.window_hashes(hashed, first, 1_024, which)
        assert len(set(keys.tolist())) == 2 == len(doc)
    filler = prose(random.Random(4), 30).split()
    rows = [(1, " ".join([*filler[:6], one, *filler[6:12]])), (2, " ".join([*filler[:6], two, *filler[6:12]])), (3, " ".join([one, two, one, two, one]))]
    got = substring_dedup(documents(spark, rows), window=13).collect()
    assert order((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == order(brute_words(rows, 13)) and not any(r.n_removed for r in got)
    near = near_dedup(documents(spark, rows), shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near} == brute_components(rows, 4, 80)
    items = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate(documents(spark, rows), items).collect()} == {1: 13, 2: 0, 3: 0}
    assert Texts(*K.text_bytes(pa.array([" ".join([one, "x", "y", two, "x", "y"])]))).repeat_words().tolist() == [0]


def test_ids_of_another_type_are_refused_at_once(spark):
    docs = spark.createDataFrame([("http://a", "text")], "doc_id string, text string")
    for run in (substring_dedup, suffix_dedup, near_dedup):
        with pytest.raises(TypeError, match="whole number"):
            run(docs)


def test_tables_of_a_scope_are_deleted(spark):
    from pathlib import Path

    from blockloom.llm.shared import shared_dir, temporary

    folder = Path(shared_dir(spark).removeprefix("file://")) / "blockloom"
    before = set(folder.glob("*")) if folder.exists() else set()
    with temporary(spark):
        assert near_dedup(documents(spark, [(1, "a b c d e f"), (2, "a b c d e f")])).where("kept").count() == 1
        assert set(folder.glob("*")) > before
    assert set(folder.glob("*")) == before
