"""The corpus pipeline, stage by stage, against plain Python."""

import random
from collections import defaultdict

import numpy as np
from samples import prose
from test_repeats import brute_components, brute_words
from test_text import LETTERS, lower

import corpus_pipeline as pipeline
from blockloom.llm import compression_classifier
from blockloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path


def tables(spark, folder):
    rng = random.Random(11)
    shared, leak = prose(rng, 40), prose(rng, 25)
    rows = [(i, prose(rng, rng.randint(60, 150))) for i in range(60)]
    rows += [(100 + i, " | ".join(prose(rng, 70).upper().split())) for i in range(30)]
    near = rows[3][1].split(" ")
    near[len(near) // 2] = "changed"
    rows += [(200, rows[3][1]), (201, " ".join(near)), (202, prose(rng, 50) + "\n" + shared), (203, shared + " " + prose(rng, 60)), (204, prose(rng, 40) + " " + leak + " " + prose(rng, 30)), (205, leak + " " + prose(rng, 4)), (206, prose(rng, 3_000)), (207, None), (208, "")]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, prose(rng, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return leak


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    leak = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    outputs = []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        outputs.append((docs, out))
        docs = out
    (first, good), (_, single), (_, cut), (_, clean), (_, packed) = outputs
    assert all(out.columns == columns for _, out in outputs[:-1])

    model = compression_classifier.fit(first, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    before = texts(first)
    score = dict(zip(before, model.scores(list(before.values()))))
    assert texts(good) == {i: t for i, t in before.items() if score[i] >= pipeline.REJECT_BELOW}
    assert sum(i < 60 for i in texts(good)) >= 58 and not any(100 <= i < 130 for i in texts(good))

    component = brute_components(list(texts(good).items()), 5, 80)
    assert texts(single) == {i: t for i, t in texts(good).items() if component[i][1] == i}
    assert 3 in texts(single) and not {200, 201} & set(texts(single))

    want = {i: (n, t) for i, _, n, t in brute_words(list(texts(single).items()), 13)}
    for r in cut.collect():
        n, t = want.pop(r.doc_id)
        assert r.text == (t if n else texts(single)[r.doc_id]) and (r.n_chars == len(r.text) if r.text else True)
    assert not want

    windows = {tuple(w[a : a + 10]) for w in [LETTERS.findall(lower(leak))] for a in range(len(w) - 9)}
    hits = defaultdict(int)
    for i, t in texts(cut).items():
        w = LETTERS.findall(lower(t))
        mark = np.zeros(len(w), bool)
        for a in range(len(w) - 9):
            if tuple(w[a : a + 10]) in windows:
                mark[a : a + 10] = True
        hits[i] = (int(mark.sum()), len(w))
    after = texts(clean)
    assert set(after) == {i for i, (h, n) in hits.items() if h <= pipeline.MAX_COVERAGE * n}
    for i, t in after.items():
        w = LETTERS.findall(lower(t))
        assert t == texts(cut)[i] if not hits[i][0] else len(w) == hits[i][1] - hits[i][0]
        assert not any(tuple(w[a : a + 10]) in windows for a in range(len(w) - 9))

    encoder, got, room = Tokenizer.from_file(tokenizer_path()), defaultdict(dict), defaultdict(int)
    for r in packed.collect():
        got[r.doc_id][r.piece] = list(r.ids)
        room[r.sequence_id] += r.length
    ids = {i: [x for k in sorted(p) for x in p[k]] for i, p in got.items()}
    assert ids == {i: [*encoder.encode(t or "", add_special_tokens=False).ids, 0] for i, t in after.items()}
    assert max(room.values()) <= 2048 and len(room) == -(-sum(map(len, ids.values())) // 2048)
    whole = pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed.collect())


def test_near_dedup_stage_judges_rows_that_repeat_an_id(spark, tmp_path):
    rng = random.Random(2)
    base, alone, other = prose(rng, 80), prose(rng, 80), prose(rng, 80)
    rows = [(1, base), (5, base), (5, alone), (5, alone), (6, other), (6, other), (None, base), (7, None), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_dedup_stage(spark, docs, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, base), (5, alone), (6, other), (7, None), (8, "")], key=str)
    got = sorted(r.doc_id for r in pipeline.near_dedup_stage(spark, docs.where("doc_id in (1, 8)"), str(tmp_path)).collect())
    assert got == [1, 8]


def test_registered_names():
    import __spark_entry__ as entry

    assert [n for n in QUERIES if n.startswith("op")] == list(QUERIES) and {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert {"pipeline", *QUERIES} <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert 4 <= len(pipeline.STAGES) <= 5
