"""License scans in DataFrame functions alone: sparse TF-IDF cosine of whole texts, stretches of words
and lines to templates, then inheritance from the nearest ancestor directory by joins on path prefixes.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import cache, reduce
from itertools import accumulate
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.shared import written

# Identifiers and the wording of their notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
}
SPDX = ("MIT", "ISC", "Apache-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
TITLES = {
    "MIT": "MIT License",
    "MIT#1": "The MIT License",
    "MIT#2": "The MIT License (MIT)",
    "ISC": "ISC License",
    "Apache-2.0": "Apache License, Version 2.0",
    "GPL": "GNU GENERAL PUBLIC LICENSE",
    "LGPL": "GNU LESSER GENERAL PUBLIC LICENSE",
    "AGPL": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "MPL-2.0": "Mozilla Public License Version 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "CC0-1.0": "CC0 1.0 Universal",
    **{re.sub("-only$|-or-later$", "", x) + "#spdx" + str(i): f"SPDX-License-Identifier: {x}" for i, x in enumerate(SPDX)},
}
"""Lines that name a license; what follows # only tells templates of one license apart.  A title
without a version names the family."""
STEPS = 10
"""Stretches start at every tenth of a template's words, so one lies within a twentieth of any place."""
WORD = "[0-9a-z]+"
# Words of ordinary prose, which tell nothing about licenses; only speed depends on them.
PROSE = frozenset("a all an and any are as at be but by can do each for from had has have how if in into is it its may more must no not of on one only or other our out shall so such than that the their them then there these they this those to under up use was we were what when where which who will with would you your".split())
BROADCAST_ROWS = 200_000
"""Texts in question, at most, whose numbers are broadcast to pick them; more are joined by shuffle."""
FEW_TERMS = 130
"""Templates of more terms are looked for by the number of their terms that a text holds."""
MAX_TERMS = 20_000
"""Terms of all templates together, at most: their weights travel in the plan."""


@cache
def full_texts() -> dict[str, str]:
    """Whole licenses and the standard notices of file headers, by license, or license#notice."""
    folder = Path(__file__).parent / "licenses"
    return {p.name.removesuffix(".txt").replace(".notice", "#notice"): p.read_text(encoding="utf-8") for p in sorted(folder.glob("*.txt"))}


def _terms(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def weights(templates: dict[str, str], damped: bool = False) -> tuple[dict[str, float], float, dict[str, dict[str, float]]]:
    """Inverse document frequencies of the templates' terms, that of any other term, and each
    template's weights divided by their length.  idf = 1 + ln((1 + N) / (1 + df)); damped counts are
    1 + ln(count), so that in long texts common words don't outweigh the telling ones."""
    counts = {k: Counter(_terms(t)) for k, t in templates.items()}
    if damped:
        counts = {k: Counter({w: 1 + math.log(v) for w, v in c.items()}) for k, c in counts.items()}
    df = Counter(w for c in counts.values() for w in c)
    n = len(templates)
    idf = {w: 1 + math.log((1 + n) / (1 + d)) for w, d in df.items()}
    out = {}
    for k, c in counts.items():
        norm = math.sqrt(sum((v * idf[w]) ** 2 for w, v in c.items())) or 1.0
        out[k] = {w: v * idf[w] / norm for w, v in c.items()}
    if len(idf) > MAX_TERMS:
        raise ValueError(f"the templates have {len(idf)} terms; at most {MAX_TERMS} can travel in the plan")
    return idf, 1 + math.log(1 + n), out


def _literals(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k in sorted(values) for x in (k, values[k])])


def _q(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def line_scores(files: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(key, line_no, license, score) of the lines of whole texts that score at least the threshold.

    A line whose terms hold too little of a template's weight to reach the threshold, whatever else it
    has (by Cauchy's inequality), isn't scored; that loses no line."""
    idf, other, norm = weights(templates)
    lines = files.select("_key", F.posexplode(F.split("_text", "\n")).alias("line_no", "line"))
    known = F.array(*[F.lit(w) for w in sorted(idf)])
    lines = lines.where(F.lower("line").rlike(one_of({x for w in norm.values() for x in needed(w, threshold)})))
    lines = _once(lines, "terms", F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(0)))
    # The part of a line that isn't of a template's terms must be short against the part that is: with k
    # words of known terms their weights make at most k^2 of the largest idf^2, each other word makes one.
    k = F.size(F.filter("terms", lambda x: F.array_contains(known, x)))
    others = F.size(F.array_except("terms", known))
    lines = lines.where(others * (threshold * threshold / (1 - threshold * threshold)) <= k * k + 1e-6)
    lines = _once(lines, "hits", F.array_intersect("terms", known))
    held = []
    for name in sorted(norm):
        square = _literals({w: v * v for w, v in norm[name].items()})
        share = F.aggregate("hits", F.lit(0.0), lambda a, w: a + F.coalesce(F.element_at(square, w), F.lit(0.0)))  # noqa: B023
        held.append(F.when(share >= threshold * threshold - 1e-9, F.lit(name)))
    lines = lines.withColumn("fits", F.array_compact(F.array(*held))).where(F.size("fits") > 0)
    idf_map = _literals(idf)
    terms = lines.select("_key", "line_no", "fits", F.explode("terms").alias("term")).groupBy("_key", "line_no", "fits", "term").agg(F.count("*").alias("tf"))
    terms = terms.withColumn("w", F.col("tf") * F.coalesce(F.element_at(idf_map, F.col("term")), F.lit(other)))
    of = [F.sum(F.col("w") * F.coalesce(F.element_at(_literals(norm[n]), F.col("term")), F.lit(0.0))).alias(f"d{i}") for i, n in enumerate(sorted(norm))]
    sums = terms.groupBy("_key", "line_no", "fits").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"), *of)
    scored = F.array(*[F.struct(F.lit(n).alias("license"), (F.col(f"d{i}") / F.col("len")).alias("score")) for i, n in enumerate(sorted(norm))])
    fit = sums.select("_key", "line_no", "fits", F.explode(scored).alias("s")).where(F.array_contains("fits", F.col("s.license")) & (F.col("s.score") >= threshold))
    return fit.select("_key", "line_no", "s.license", "s.score")


def _constant(value: object, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), schema)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: filters and lambdas would repeat a plain one."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _lookup(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table that travels in the plan."""
    return F.broadcast(spark.range(0, 1, 1, 1).select(F.explode(_constant(rows, f"array<struct<{schema}>>")).alias("s")).select("s.*"))


def needed(weights_of: dict[str, float], threshold: float) -> list[str]:
    """Terms of a template of which every text that scores the threshold holds at least one.

    What scores c holds terms of at least c * c of the template's squared weight (Cauchy's
    inequality), so it can't lack all of a set that weighs more than the rest."""
    held, out = 0.0, []
    for x in sorted(weights_of, key=lambda x: (x in PROSE, -weights_of[x], x)):
        if held > 1 - threshold * threshold + 1e-9:
            break
        held += weights_of[x] ** 2
        out.append(x)
    return out


def one_of(terms: set[str]) -> str:
    """A pattern that finds any of the terms as a whole word of lower-cased text, as a tree of letters:
    its time doesn't grow with the number of terms."""

    def branch(words: list[str]) -> str:
        by_letter: dict[str, list[str]] = {}
        for w in words:
            by_letter.setdefault(w[:1], []).append(w[1:])
        ends = by_letter.pop("", None)
        parts = [letter + branch(rest) for letter, rest in sorted(by_letter.items())]
        if not parts:
            return ""
        return "(?:" + "|".join(parts) + ")" + ("?" if ends else "")

    return "(?<![0-9a-z])" + branch(sorted(terms)) + "(?![0-9a-z])"


def candidates(rows: DataFrame, families: dict[str, dict[str, dict[str, float]]], threshold: float) -> DataFrame:
    """The rows that can hold a text, stretch or line scoring the threshold, with _terms, _n (a number
    of the row) and the templates in question (_fits, as family:name).

    Of whole texts only patterns are asked at first: one of the needed terms of a template of few
    terms, or as many terms of one of many as that share of its weight takes at least.  Texts that
    pass are cut into words and weighed.  Only some terms of a template are looked for; the others
    count as held, so that neither step loses a text."""
    spark, looked, some, many, least_many = rows.sparkSession, [], set(), set(), []
    for family, norm in families.items():
        for name, w in norm.items():
            held, part = 0.0, {}
            for x in sorted(w, key=lambda x: (x in PROSE, -w[x], x)):
                if held >= (0.6 if len(w) > 60 else 0.95):
                    break
                part[x] = w[x] ** 2
                held += part[x]
            least = threshold * threshold - (1 - held) - 1e-9
            looked += [{"term": x, "fit": f"{family}:{name}", "share": v, "least": least} for x, v in part.items()]
            if len(w) <= FEW_TERMS:
                some |= set(needed(w, threshold))
            else:
                many |= set(part)
                sums = accumulate(sorted(part.values(), reverse=True))
                least_many.append(1 + sum(v < least for v in sums))
    low = F.lower("_text")
    pass_ = low.rlike(one_of(some)) if some else F.lit(False)
    if many:
        pass_ = pass_ | (F.regexp_count(low, F.lit(one_of(many))) >= min(least_many))
    read = written(rows.where(pass_).select(F.monotonically_increasing_id().alias("_n"), "*"), "license-reads")
    words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    hits = read.select("_n", F.explode(F.array_distinct(words)).alias("term")).join(_lookup(spark, looked, "term string, fit string, share double, least double"), "term")
    sums = hits.groupBy("_n", "fit").agg(F.sum("share").alias("share"), F.first("least").alias("least")).where("share >= least")
    fits = written(sums.groupBy("_n").agg(F.collect_set("fit").alias("_fits")), "license-fits")
    few = fits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return read.join(F.broadcast(fits) if few else fits, "_n").withColumn("_terms", words)


def stretch_scores(texts: DataFrame, family: str, templates: dict[str, str], threshold: float, damped: bool, whole: bool) -> DataFrame:
    """(key, license, score) of the stretches of words, as long as a template, and (whole) of the whole
    texts that score at least the threshold.  Lines and comment marks don't matter to either.

    Only stretches with enough of the template's squared weight (see candidates) are scored."""
    spark = texts.sparkSession
    idf, other, norm = weights(templates, damped)
    size = {n: len(_terms(t)) for n, t in templates.items()}
    about = [{"fit": f"{family}:{n}", "license": n.split("#")[0], "m": size[n], "step": max(1, size[n] // STEPS), "squares": {w: v * v for w, v in norm[n].items()}} for n in sorted(norm)]
    about = _lookup(spark, about, "fit string, license string, m int, step int, squares map<string, double>")
    at = texts.select("_key", "_terms", F.explode("_fits").alias("fit")).join(about, "fit")
    at = _once(at, "_w", F.transform("_terms", lambda x: F.coalesce(F.element_at("squares", x), F.lit(0.0))))
    last = F.greatest(F.lit(0), F.size("_terms") - F.col("m"))
    starts = F.array_union(F.sequence(F.lit(0), last, F.col("step")), F.array(last))
    holds = lambda s: F.aggregate(F.slice("_w", s + 1, F.col("m")), F.lit(0.0), lambda a, x: a + x) >= threshold * threshold - 1e-9
    spans = F.transform(F.filter(starts, holds), lambda s: F.struct(s.alias("start"), F.col("m").alias("n")))
    if whole:
        spans = F.array_union(spans, F.array(F.struct(F.lit(0).alias("start"), F.size("_terms").alias("n"))))
    at = at.select("_key", "fit", "license", "_terms", F.explode(spans).alias("span"))
    unit = ["_key", "fit", "license", "span"]
    terms = at.select(*unit, F.explode(F.slice("_terms", F.col("span.start") + 1, F.col("span.n"))).alias("term")).groupBy(*unit, "term").agg(F.count("*").cast("double").alias("tf"))
    if damped:
        terms = terms.withColumn("tf", 1 + F.log("tf"))
    terms = terms.join(_lookup(spark, [{"term": w, "idf": v} for w, v in sorted(idf.items())], "term string, idf double"), "term", "left")
    terms = terms.join(_lookup(spark, [{"fit": f"{family}:{n}", "term": w, "norm": v} for n in sorted(norm) for w, v in sorted(norm[n].items())], "fit string, term string, norm double"), ["fit", "term"], "left")
    w = F.col("tf") * F.coalesce("idf", F.lit(other))
    sums = terms.groupBy(*unit).agg((F.sum(w * F.coalesce("norm", F.lit(0.0))) / F.sqrt(F.sum(w * w))).alias("score"))
    return sums.where(F.col("score") >= threshold).select("_key", "license", "score")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = 0.8, license_names: str = "(?i)^(licen[cs]e|copying|notice)([.-].*)?$", texts: dict[str, str] | None = None, titles: dict[str, str] | None = None) -> DataFrame:
    """The license of every file: its own best one, else that of the nearest directory above with a
    license file.

    Own: first a whole license or a file header's notice (texts), compared with the whole text and with
    stretches of as many words as the template; else a single line that is a template's sentence or
    a title; else a stretch of words anywhere that is a sentence, as when it is wrapped or follows a name.

    Returns id, path, own_license, own_score, license, and inherited_from (the directory; null if the
    license is the file's own or there is none).  Best, among those of the first kind found: the highest score rounded to 9 digits, ties
    to the first license name. A directory with several license files takes their best likewise.
    Null and empty texts have no license of their own; a null path inherits nothing. Rows that repeat
    (id and path) are judged together by all their texts and come back once. Empty tables give
    empty results; other columns are ignored.  A path's directories are joined one row each, so work
    follows the depth of paths, and the table of directories with licenses is aggregated before joining.
    """
    templates = TEMPLATES if templates is None else templates
    rows = files.select(F.struct(_q(id_col).cast("long").alias("id"), _q(path_col).cast("string").alias("path")).alias("_key"), _q(text_col).cast("string").alias("_text"))
    texts, titles = full_texts() if texts is None else texts, TITLES if titles is None else titles
    families = {"text": (texts, True), "line": (titles, False), "sentence": (templates, False)}
    families = {k: v for k, v in families.items() if v[0]}
    held = candidates(rows.where("_text is not null"), {k: weights(*v)[2] for k, v in families.items()}, threshold)
    # One row is one text: rows that repeat a key are scored apart and judged together.
    held = written(held.withColumn("_key", F.struct(F.col("_n").alias("n"), F.col("_key").alias("k"))).drop("_n"), "license-texts")
    of = lambda family: held.where(F.exists("_fits", lambda x: x.startswith(family + ":")))
    found = []
    if "text" in families:
        found.append(stretch_scores(held, "text", texts, threshold, True, True).select("_key", F.lit(0).alias("kind"), "license", "score"))
    if "line" in families:
        found.append(line_scores(of("line"), titles, threshold).select("_key", F.lit(1).alias("kind"), F.substring_index("license", "#", 1).alias("license"), "score"))
    if "sentence" in families:
        found.append(line_scores(of("sentence"), templates, threshold).select("_key", F.lit(1).alias("kind"), "license", "score"))
        found.append(stretch_scores(held, "sentence", templates, threshold, False, False).select("_key", F.lit(2).alias("kind"), "license", "score"))
    own = reduce(DataFrame.unionByName, found).select(F.col("_key.k").alias("_key"), "kind", "license", F.round("score", 9).alias("score"))
    own = own.groupBy("_key").agg(F.min(F.struct("kind", (-F.col("score")).alias("minus"), "license")).alias("b")).select("_key", F.col("b.license").alias("own_license"), (-F.col("b.minus")).alias("own_score"))
    own = written(own, "license-lines")
    path = F.col("_key.path")
    base, above = F.substring_index(path, "/", -1), F.when(F.instr(path, "/") > 0, F.expr("substring(_key.path, 1, length(_key.path) - length(substring_index(_key.path, '/', -1)) - 1)")).when(path.isNotNull(), F.lit(""))
    declared = own.where(base.rlike(license_names)).groupBy(above.alias("dir")).agg(F.min(F.struct((-F.col("own_score")).alias("minus"), "own_license")).alias("b")).select("dir", F.col("b.own_license").alias("dir_license"))
    keys = rows.select("_key").distinct().join(own, "_key", "left")
    # Directories are few beside files: each distinct one looks up its ancestors once.
    dirs = keys.where("own_license is null and _key.path is not null").select(above.alias("at")).distinct()
    ups = dirs.withColumn("depth", F.explode(F.expr("sequence(0, if(at = '', 0, size(split(at, '/'))))"))).withColumn("dir", F.expr("substring_index(at, '/', depth)"))
    nearest = ups.join(declared, "dir").groupBy("at").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("n"))
    joined = keys.withColumn("at", F.when(F.col("own_license").isNull(), above)).join(nearest, "at", "left")
    return joined.select(F.col("_key.id").alias(id_col), F.col("_key.path").alias(path_col), "own_license", "own_score", F.coalesce("own_license", "n.dir_license").alias("license"), F.when(F.col("own_license").isNull(), F.col("n.dir")).alias("inherited_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """documents as a tree of files: source/lang/shelf/file, some license files higher up.

    The tables have no paths.  A file that is nothing but a few lines (at most 40 words) is named
    LICENSE.<doc_id>, the others <doc_id>.txt; a shelf holds a hundred ids.  Of the LICENSE files those
    whose id ends in 0 lie in source, those whose id ends in 1 in source/lang."""
    short = F.coalesce(~F.col("text").rlike("^(?:[^0-9A-Za-z]*+[0-9A-Za-z]++){41}"), F.lit(False))
    name = F.when(short, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    shelf = F.when(~short | ~F.coalesce(F.col("doc_id") % 10 <= 1, F.lit(False)), F.expr("cast(doc_id div 100 as string)"))
    lang = F.when(~short | ~F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False)), F.col("lang"))
    return docs.select("doc_id", F.concat_ws("/", "source", lang, shelf, name).alias("path"), "text")


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license string, text string")
