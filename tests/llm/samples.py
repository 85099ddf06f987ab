"""Small tables with nulls, empty and long texts, ties, repeats and columns whose names clash."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text long, block string, masks int, node int, sig string, part string, path string, k int"


def documents(spark, rows):
    extra = ("x", 1, "b", 2, 3, "s", "p", "q", 9)
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), *extra) for i, t in rows], SCHEMA)


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice("the of and to in a is that for on with as was by are this from at or an".split()) if rng.random() < 0.4 else "".join(rng.choice(["an", "er", "thin", "ou", "ble", "st", "hé"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    out = " ".join(words)
    return out.replace(" er", ".\nEr", 3)


def edge_rows() -> list[tuple]:
    rng = random.Random(7)
    base, passage = prose(rng, 120), prose(rng, 60)
    near = base.split(" ")
    near[60] = "changed"
    rows = [(5, base), (3, base), (9, " ".join(near)), (None, base), (11, None), (12, ""), (13, " \n\t "), (14, "one two"), (15, "One two"), (16, prose(rng, 40) + " " + passage + " " + prose(rng, 40)), (17, passage), (18, prose(rng, 30) + "\n" + passage), (19, prose(rng, 40_000)), (20, "aaaa " * 300), (21, "é" * 500), (5, prose(rng, 80)), (22, base), (22, base)]
    return rows
