"""Queries over the test tables, one for each operator, and DuckDB SQL that gives the same rows.

The 64 values of an embedding are one 8 x 8 frame; lineitem's measures are the large set of vectors.
Doubles are rounded to six digits on both sides, as sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import color, entropy, metrics
from blockloom.operators import aggregates, cluster, context, layout, linear, resample
from blockloom.plans import rd, vq
from blockloom.schema import LevelConfig, ResolutionConfig

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.frames_of(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 8)


def _px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.pixels(_frames(spark, sf_dir)).drop("ch")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.unfold(_frames(spark, sf_dir), 2)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))


def _book(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    return _vectors(spark, sf_dir).where(F.col("vec_id") < k).select(F.col("vec_id").cast("int").alias("cid"), F.col("vec").alias("centroid"))


def _block_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).where("frame_id = 0").select((F.col("bi") * 4 + F.col("bj")).alias("cid"), F.col("vec").alias("centroid"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assign(_vectors(spark, sf_dir), cluster.codebook_array(_book(spark, sf_dir)))


def _scaled(blocks: DataFrame) -> DataFrame:
    """Block values a hundredfold, so that thresholds from 1 up part them."""
    return blocks.withColumn("vec", F.transform("vec", lambda x: x * 100))


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _scaled(_blocks(spark, sf_dir))
    return vq.quantise(blocks, cluster.codebook_array(_scaled(_block_book(spark, sf_dir).withColumnRenamed("centroid", "vec")).withColumnRenamed("vec", "centroid")), -1)


# SQL fragments: pixels, blocks, codebooks and nearest codewords.
_PX = "px AS (SELECT vec_id AS frame_id, CAST((p - 1) // 8 AS INTEGER) AS i, CAST((p - 1) % 8 AS INTEGER) AS j, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings))"
_BLK = _PX + ", blk AS (SELECT frame_id, CAST(i // 2 AS INTEGER) AS bi, CAST(j // 2 AS INTEGER) AS bj, list(x ORDER BY i, j) AS vec FROM px GROUP BY ALL)"
_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"


def _nearest(rows: str, keys: str, book: str, out: str) -> str:
    return f"{out} AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY d2, label) AS k FROM (SELECT r.*, CAST(b.cid AS INTEGER) AS label, b.c, {_D2.format(a='r.vec', b='b.c')} AS d2 FROM {rows} r, {book} b)) WHERE k = 1)"


_VEC = "v AS (SELECT vec_id, embedding AS vec FROM embeddings), b0 AS (SELECT vec_id AS cid, embedding AS c FROM embeddings WHERE vec_id < 8)"
_LAB = f"WITH {_VEC}, {_nearest('v', 'vec_id', 'b0', 'lab')}"
_COD = f"""WITH {_BLK}, sb AS (SELECT frame_id, bi, bj, list_transform(vec, lambda x: x * 100) AS vec FROM blk), bk AS (SELECT bi * 4 + bj AS cid, vec AS c FROM sb WHERE frame_id = 0),
{_nearest('sb', 'frame_id, bi, bj', 'bk', 'near')}, cod AS (SELECT frame_id, bi, bj, vec, label, d2 / 4 AS mse, list_sum(list_transform(vec, lambda x: x * x)) / 4 AS omse, list_sum(list_transform(vec, lambda x: x * x)) / 4 - d2 / 4 AS dmse FROM near)"""


@query(f"WITH {_BLK} SELECT frame_id, bi, bj, vec[1] AS v0, vec[2] AS v1, vec[3] AS v2, vec[4] AS v3 FROM blk")
def unfold_2x2(spark, sf_dir):
    return _blocks(spark, sf_dir).select("frame_id", "bi", "bj", *[F.col("vec")[i].alias(f"v{i}") for i in range(4)])


@query("SELECT vec_id AS frame_id, 0 AS n_diff FROM embeddings")
def fold_roundtrip(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    back = layout.fold(layout.unfold(frames, 2), 2, 8, 8).select("frame_id", F.col("data").alias("b"))
    diff = F.size(F.filter(F.zip_with("data", "b", lambda x, y: x != y), lambda d: d))
    return frames.join(back, "frame_id").select("frame_id", diff.alias("n_diff"))


@query("SELECT vec_id AS frame_id, 0 AS n_diff FROM embeddings")
def overlap_roundtrip(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    back = layout.fold_overlapping(layout.unfold_overlapping(frames, 4, 1), 4, 1, 8, 8).select("frame_id", F.col("data").alias("b"))
    diff = F.size(F.filter(F.zip_with("data", "b", lambda x, y: x != y), lambda d: d))
    return frames.join(back, "frame_id").select("frame_id", diff.alias("n_diff"))


@query(f"WITH {_PX} SELECT frame_id, CAST(i // 2 AS INTEGER) AS i, CAST(j // 2 AS INTEGER) AS j, round(avg(x), 6) AS x FROM px GROUP BY ALL")
def pool_2x2_mean(spark, sf_dir):
    return layout.pool_2x2(layout.pixels(_frames(spark, sf_dir))).select("frame_id", "i", "j", r6("x").alias("x"))


@query(f"WITH {_PX} SELECT frame_id, CAST(i // 2 AS INTEGER) AS i, CAST(j // 2 AS INTEGER) AS j, x FROM px WHERE i % 2 = 1 AND j % 2 = 1")
def nearest_downsample(spark, sf_dir):
    return resample.nearest_half(layout.pixels(_frames(spark, sf_dir))).drop("ch")


@query(f"WITH {_PX}, m AS (SELECT frame_id, round_even(avg(x * 1000), 0) AS mean FROM px GROUP BY 1) SELECT frame_id, i, j, round(x * 1000 - mean, 6) AS x, mean FROM px JOIN m USING (frame_id)")
def frame_mean_removed(spark, sf_dir):
    out = layout.remove_mean(_px(spark, sf_dir).withColumn("x", F.col("x") * 1000))
    return out.select("frame_id", "i", "j", r6("x").alias("x"), "mean")


_RGB = "rgb AS (SELECT frame_id, CAST((i * 8 + j) // 3 AS INTEGER) AS t, max(x * 255) FILTER ((i * 8 + j) % 3 = 0) AS b, max(x * 255) FILTER ((i * 8 + j) % 3 = 1) AS g, max(x * 255) FILTER ((i * 8 + j) % 3 = 2) AS r FROM px WHERE i * 8 + j < 63 GROUP BY ALL)"


def _rgb(spark, sf_dir):
    at = F.col("i") * 8 + F.col("j")
    px = _px(spark, sf_dir).where(at < 63).withColumn("x", F.col("x") * 255)
    return px.groupBy("frame_id", F.expr("cast((i * 8 + j) div 3 as int)").alias("t")).agg(*[F.max(F.when(at % 3 == k, F.col("x"))).alias(n) for k, n in enumerate("bgr")])


@query(f"""WITH {_PX}, {_RGB} SELECT frame_id, t, round(0.299 * (r - 127) + 0.587 * (g - 127) + 0.114 * (b - 127), 6) AS y,
round(-0.14713 * (r - 127) - 0.28886 * (g - 127) + 0.436 * (b - 127), 6) AS u, round(0.615 * (r - 127) - 0.51499 * (g - 127) - 0.10001 * (b - 127), 6) AS v FROM rgb""")
def yuv_projection(spark, sf_dir):
    return color.rgb_to_yuv(_rgb(spark, sf_dir)).select("frame_id", "t", *[r6(c).alias(c) for c in "yuv"])


@query(f"""WITH {_PX}, {_RGB}, yuv AS (SELECT frame_id, t, 0.299 * (r - 127) + 0.587 * (g - 127) + 0.114 * (b - 127) AS y, -0.14713 * (r - 127) - 0.28886 * (g - 127) + 0.436 * (b - 127) AS u, 0.615 * (r - 127) - 0.51499 * (g - 127) - 0.10001 * (b - 127) AS v FROM rgb)
SELECT frame_id, t, round(y + 1.13983 * v + 127, 6) AS r, round(y - 0.39465 * u - 0.58060 * v + 127, 6) AS g, round(y + 2.03211 * u + 127, 6) AS b FROM yuv""")
def yuv_roundtrip(spark, sf_dir):
    """Back from luma and chroma; the matrices are inverse to each other only up to their five digits."""
    back = color.yuv_to_rgb(color.rgb_to_yuv(_rgb(spark, sf_dir)))
    return back.select("frame_id", "t", *[r6(c).alias(c) for c in "rgb"])


@query("SELECT vec_id AS frame_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM embeddings, range(0, 5, 2) a(i), range(0, 5, 2) b(j)")
def crop_origins(spark, sf_dir):
    return layout.crop_origins(_frames(spark, sf_dir), 4, 2)


@query("SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS batch FROM embeddings")
def batch_ids(spark, sf_dir):
    return layout.batch_ids(_table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 64)


@query(f"{_LAB} SELECT vec_id, label, round(d2, 6) AS d2 FROM lab")
def l2_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select("vec_id", "label", r6("d2").alias("d2"))


@query(f"{_LAB} SELECT vec_id, label, round(d2, 6) AS d2 FROM lab")
def l2_assign_expression(spark, sf_dir):
    return cluster.assign_sql(_vectors(spark, sf_dir), _book(spark, sf_dir)).select("vec_id", "label", r6("d2").alias("d2"))


def _update_sql(lab: str, book: str, out: str) -> str:
    return f"""{out}m AS (SELECT label AS cid, p, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS p FROM {lab}) GROUP BY ALL),
{out} AS (SELECT b.cid, coalesce(list(m ORDER BY p) FILTER (m IS NOT NULL), any_value(b.c)) AS c FROM {book} b LEFT JOIN {out}m USING (cid) GROUP BY b.cid)"""


def _flat_book(book: DataFrame) -> DataFrame:
    return book.select("cid", F.posexplode("centroid").alias("d", "m")).select("cid", "d", r6("m").alias("m"))


_FLAT = "SELECT CAST(cid AS INTEGER) AS cid, CAST(d - 1 AS INTEGER) AS d, round(CAST(m AS DOUBLE), 6) AS m FROM (SELECT cid, unnest(c) AS m, generate_subscripts(c, 1) AS d FROM {})"


@query(f"{_LAB}, {_update_sql('lab', 'b0', 'b1')} {_FLAT.format('b1')}")
def centroid_update(spark, sf_dir):
    return _flat_book(cluster.update(_assigned(spark, sf_dir), _book(spark, sf_dir)))


@query(f"{_LAB}, {_update_sql('lab', 'b0', 'b1')}, {_nearest('v', 'vec_id', 'b1', 'lab1')}, {_update_sql('lab1', 'b1', 'b2')}, {_nearest('v', 'vec_id', 'b2', 'lab2')}, {_update_sql('lab2', 'b2', 'b3')} {_FLAT.format('b3')}")
def lloyd_3_iters(spark, sf_dir):
    book, _ = cluster.kmeans(_vectors(spark, sf_dir), cluster.codebook_array(_book(spark, sf_dir)), rounds=3, stop=-1.0)
    return _flat_book(cluster.codebook_frame(spark, book))


@query(f"{_LAB} SELECT label, count(*) AS n, round(sum(d2), 6) AS sse FROM lab GROUP BY label")
def sse_by_cluster(spark, sf_dir):
    return _assigned(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), r6(F.sum("d2")).alias("sse"))


def _kkz_sql() -> str:
    sql = "WITH v AS (SELECT vec_id, embedding AS vec FROM embeddings), m AS (SELECT list(m ORDER BY p) AS c FROM (SELECT p, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS p FROM v) GROUP BY p))"
    sql += f", s0 AS (SELECT vec_id, vec, {_D2.format(a='vec', b='m.c')} AS d FROM v, m), k0 AS (SELECT vec_id, vec FROM s0 ORDER BY d DESC, vec_id LIMIT 1)"
    for n in range(1, 4):
        sql += f", s{n} AS (SELECT s.vec_id, s.vec, least(s.d, {_D2.format(a='s.vec', b='k.vec')}) AS d FROM s{n - 1} s, k{n - 1} k), k{n} AS (SELECT vec_id, vec FROM s{n} ORDER BY d DESC, vec_id LIMIT 1)"
    return sql + " " + " UNION ALL ".join(f"SELECT {n} AS step, vec_id FROM k{n}" for n in range(4))


@query(_kkz_sql())
def kkz_4(spark, sf_dir):
    vecs = _vectors(spark, sf_dir)
    chosen = cluster.farthest_points(vecs, 4, "vec_id")
    steps = cluster.codebook_frame(spark, chosen).select(F.col("cid").alias("step"), F.col("centroid").alias("vec"))
    return F.broadcast(steps).join(vecs, "vec").groupBy("step").agg(F.min("vec_id").alias("vec_id"))


@query("WITH b AS (SELECT vec_id AS cid, embedding AS c FROM embeddings WHERE vec_id < 8), r AS (SELECT e.vec_id, CAST(e.label AS INTEGER) AS label, coalesce(b.c, (SELECT c FROM b WHERE cid = 0)) AS c FROM embeddings e LEFT JOIN b ON b.cid = e.label) SELECT vec_id, label, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS d, CAST(unnest(c) AS DOUBLE) AS x FROM r")
def decode_lookup(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"))
    return cluster.decode(rows, _book(spark, sf_dir)).select("vec_id", "label", F.posexplode("ivec").alias("d", "x"))


@query(f"{_COD} SELECT label, count(*) AS n, round(sum(mse * 4), 6) AS energy FROM cod GROUP BY label")
def residual_energy(spark, sf_dir):
    rest = _coded(spark, sf_dir).withColumn("rest", layout.residual(F.col("vec"), F.col("ivec")))
    return rest.groupBy("label").agg(F.count("*").alias("n"), r6(F.sum(layout.mean_square(F.col("rest")) * 4)).alias("energy"))


@query(f"{_COD} SELECT frame_id, bi, bj, label, round(mse, 6) AS mse, round(omse, 6) AS omse, round(dmse, 6) AS dmse FROM cod")
def block_dmse(spark, sf_dir):
    return _coded(spark, sf_dir).select("frame_id", "bi", "bj", "label", *[r6(c).alias(c) for c in ("mse", "omse", "dmse")])


@query(f"{_COD} SELECT label, count(*) AS n, count(*) FILTER (dmse > 50) AS coded FROM cod GROUP BY label")
def skip_mask_counts(spark, sf_dir):
    return layout.skip_mask(_coded(spark, sf_dir), 50.0).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("coded").cast("long")).alias("coded"))


def _huffman_sql(counts: str, by: str, smooth: int) -> str:
    """Bits of (by, symbol, n) under the code of n + smooth, by joining the two lightest groups in turn."""
    pick = "q[1].w + q[2].w AS w, least(q[1].s, q[2].s) AS s, q[1].n + q[2].n AS n"
    return f"""hq AS (SELECT {by}, list_sort(list({{'w': n + {smooth}, 's': symbol, 'n': n}}) FILTER (n + {smooth} > 0)) AS q FROM {counts} GROUP BY {by}),
hm({by}, q, bits) AS (SELECT {by}, q, CASE WHEN len(q) = 1 THEN q[1].n ELSE 0 END FROM hq UNION ALL SELECT {by}, list_sort(list_append(q[3:], {{'w': q[1].w + q[2].w, 's': least(q[1].s, q[2].s), 'n': q[1].n + q[2].n}})), bits + q[1].n + q[2].n FROM hm WHERE len(q) > 1),
hb AS (SELECT {by}, CAST(bits AS BIGINT) AS bits FROM hm WHERE len(q) = 1)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


# Needs cod and ths (k, th): what is coded at each threshold, and its label bits.
_GRID_HEAD = f"""tot AS (SELECT count(*) AS n, sum(omse) AS o FROM cod), c AS (SELECT k, th, count(label) AS coded, coalesce(sum(mse), 0) AS m, coalesce(sum(omse), 0) AS o FROM ths LEFT JOIN cod ON dmse > th GROUP BY ALL),
lc AS (SELECT k, s.label AS symbol, count(cod.label) AS n FROM ths CROSS JOIN (SELECT unnest(range(16)) AS label) s LEFT JOIN cod ON cod.dmse > th AND cod.label = s.label GROUP BY ALL), {_huffman_sql('lc', 'k', 1)},
lb AS (SELECT k, bits AS b FROM hb), f AS (SELECT count(*) AS frames FROM embeddings), p AS (SELECT k, th, coded, m, c.o, tot.n, tot.o AS all_o, coded / tot.n AS p FROM c, tot)"""
_GRID = _recursive(f"""{_COD}, mx AS (SELECT log2(least(1e5, greatest(10.0, max(dmse)))) / 80 AS aa FROM cod), ths AS (SELECT CAST(k AS INTEGER) AS k, round_even(pow(2.0, aa * k) * 100, 0) / 100 AS th FROM mx, range(80) g(k)), {_GRID_HEAD},
h AS (SELECT *, CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -p * log2(p) - (1 - p) * log2(1 - p) END AS h FROM p), g AS (SELECT k, th, coded, (floor(h * n) + 1 + b) / frames AS r, (m + all_o - h.o) / n AS d FROM h JOIN lb USING (k), f), grid AS (SELECT *, d + 1e5 * r / frames / 1048576 * pow(1.3, 5) AS cost FROM g, f)""")


def _grid(spark, sf_dir):
    return rd.rd_grid(_coded(spark, sf_dir), 16, _frames(spark, sf_dir).count(), 1e5, 3)


@query(f"{_GRID} SELECT k, round(th, 6) AS th, coded, round(r, 6) AS r, round(d, 6) AS d, round(cost, 6) AS cost FROM grid")
def rd_threshold_grid(spark, sf_dir):
    return _grid(spark, sf_dir).select("k", r6("th").alias("th"), "coded", *[r6(c).alias(c) for c in ("r", "d", "cost")])


@query(f"{_GRID} SELECT k, round(th, 6) AS th, coded, round(cost, 6) AS cost FROM grid ORDER BY cost, k LIMIT 1")
def best_threshold(spark, sf_dir):
    return rd.best(_grid(spark, sf_dir)).select("k", r6("th").alias("th"), "coded", r6("cost").alias("cost"))


@query(f"{_GRID}, l AS (SELECT k, cost >= lag(cost) OVER (ORDER BY k) AS rose FROM grid) SELECT count(*) AS met FROM l WHERE k <= coalesce((SELECT min(k) FROM l WHERE rose), 79)")
def early_stop_scan(spark, sf_dir):
    return rd.early_stop(_grid(spark, sf_dir)).agg(F.count("*").alias("met"))


@query(f"{_COD} SELECT label, CAST(floor(dmse / 20) AS INTEGER) AS bin, count(*) AS n FROM cod GROUP BY ALL")
def gain_bins(spark, sf_dir):
    return _coded(spark, sf_dir).groupBy("label", F.floor(F.col("dmse") / 20).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""{_COD}, t AS (SELECT CAST(th AS DOUBLE) AS th FROM (SELECT unnest([0, 20, 50, 100]) AS th)), p AS (SELECT th, count(*) FILTER (dmse > th) / count(*) AS p FROM t, cod GROUP BY th)
SELECT th, round(CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -p * log2(p) - (1 - p) * log2(1 - p) END, 6) AS bits FROM p""")
def mask_entropy_by_threshold(spark, sf_dir):
    ths = F.explode(F.array(*[F.lit(float(t)) for t in (0, 20, 50, 100)]))
    p = _coded(spark, sf_dir).select("dmse", ths.alias("th")).groupBy("th").agg(F.avg((F.col("dmse") > F.col("th")).cast("double")).alias("p"))
    h = F.when((F.col("p") <= 0) | (F.col("p") >= 1), F.lit(0.0)).otherwise(-F.col("p") * F.log2("p") - (1 - F.col("p")) * F.log2(1 - F.col("p")))
    return p.select("th", r6(h).alias("bits"))


@query("SELECT CAST(s AS INTEGER) AS symbol, count(label) AS n FROM range(12) r(s) LEFT JOIN embeddings ON label = s GROUP BY s")
def label_hist(spark, sf_dir):
    return aggregates.histogram(_table(spark, sf_dir, "embeddings"), "label", 12)


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT round(sum(-(n / t) * log2(n / t + 1e-10)), 6) AS bits FROM (SELECT n, sum(n) OVER () AS t FROM c)")
def label_entropy(spark, sf_dir):
    return aggregates.entropy(aggregates.histogram(_table(spark, sf_dir, "embeddings"), "label")).select(r6("bits").alias("bits"))


@query("WITH c AS (SELECT CAST(label AS INTEGER) AS symbol, count(*) AS n FROM embeddings GROUP BY 1), r AS (SELECT symbol, row_number() OVER (ORDER BY n DESC, symbol) - 1 AS rank FROM c) SELECT vec_id, CAST(rank AS INTEGER) AS rank FROM embeddings JOIN r ON symbol = label")
def freq_rank_relabel(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("rank"))
    ranks = aggregates.frequency_rank(aggregates.histogram(rows, "rank"))
    return layout.remap(rows, "rank", ranks.select(F.col("symbol"), F.col("rank").cast("int").alias("to")), "symbol", "to").select("vec_id", "rank")


@query(f"{_COD}, g AS (SELECT CAST(s AS INTEGER) AS cid, avg(dmse) AS gain FROM range(16) r(s) LEFT JOIN cod ON label = s GROUP BY s) SELECT cid, round(gain, 6) AS gain, CAST(row_number() OVER (ORDER BY gain DESC NULLS LAST, cid) - 1 AS INTEGER) AS rank FROM g")
def codeword_gain_rank(spark, sf_dir):
    return aggregates.gain_rank(_coded(spark, sf_dir), 16).select("cid", r6("gain").alias("gain"), F.col("rank").cast("int").alias("rank"))


def _nested(spark, sf_dir):
    vecs, book = _vectors(spark, sf_dir), _book(spark, sf_dir)
    ranks = book.select("cid", F.col("cid").alias("rank"))
    return vecs, aggregates.prefix_codebooks(book, ranks, [2, 4, 8])


_NESTED = f"WITH {_VEC}, d AS (SELECT v.vec_id, b.cid, {_D2.format(a='v.vec', b='b.c')} AS d2 FROM v, b0 b), n AS (SELECT kmidx, size, vec_id, min(d2) AS d2 FROM d JOIN (VALUES (0, 2), (1, 4), (2, 8)) s(kmidx, size) ON cid < size GROUP BY ALL)"


@query(f"{_NESTED} SELECT kmidx, round(sum(d2), 6) AS sse FROM n GROUP BY 1")
def prefix_codebook_sse(spark, sf_dir):
    vecs, nested = _nested(spark, sf_dir)
    out = None
    for kmidx in range(3):
        book = cluster.codebook_array(nested.where(F.col("kmidx") == kmidx))
        part = cluster.assign(vecs, book).agg(r6(F.sum("d2")).alias("sse")).select(F.lit(kmidx).alias("kmidx"), "sse")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{_NESTED} SELECT kmidx, round(avg(d2) + 0.05 * log2(any_value(size)), 6) AS cost FROM n GROUP BY 1 ORDER BY avg(d2) + 0.05 * log2(any_value(size)), kmidx LIMIT 1")
def best_codebook(spark, sf_dir):
    vecs, nested = _nested(spark, sf_dir)
    costs = None
    for kmidx, size in enumerate((2, 4, 8)):
        book = cluster.codebook_array(nested.where(F.col("kmidx") == kmidx))
        part = cluster.assign(vecs, book).agg((F.avg("d2") + 0.05 * F.log2(F.lit(float(size)))).alias("cost")).select(F.lit(kmidx).alias("kmidx"), "cost")
        costs = part if costs is None else costs.unionByName(part)
    return rd.best(costs, among="kmidx").select("kmidx", r6("cost").alias("cost"))


def _at(value: str, dy: int, dx: int, table: str, alias: str) -> str:
    return f"LEFT JOIN {table} {alias} ON {alias}.frame_id = a.frame_id AND {alias}.bi = a.bi + ({dy}) AND {alias}.bj = a.bj + ({dx})"


_DOWN, _ALONG = "PARTITION BY frame_id, bj ORDER BY bi", "PARTITION BY frame_id, bi ORDER BY bj"
_CTX = f"""{_COD}, m AS (SELECT frame_id, bi, bj, label, dmse > 20 AS coded, CASE WHEN dmse > 20 THEN label END AS v FROM cod),
m1 AS (SELECT *, lag(v) OVER ({_DOWN}) AS n, lag(v, 2) OVER ({_DOWN}) AS nn, lag(v) OVER ({_ALONG}) AS w, lag(v, 2) OVER ({_ALONG}) AS ww FROM m),
m2 AS (SELECT *, lead(n) OVER ({_ALONG}) AS ne, lag(n) OVER ({_ALONG}) AS nw FROM m1), ctx AS (SELECT frame_id, bi, bj, label, coded, coalesce(n, ne, nn, -1) || '~' || coalesce(w, nw, ww, -1) AS ctx FROM m2)"""


def _contexts(spark, sf_dir):
    return context.label_contexts(layout.skip_mask(_coded(spark, sf_dir), 20.0))


@query(f"{_CTX} SELECT frame_id, bi, bj, ctx FROM ctx")
def ctx_up_left(spark, sf_dir):
    return _contexts(spark, sf_dir).select("frame_id", "bi", "bj", "ctx")


@query(f"{_CTX}, k AS (SELECT ctx, label, count(*) AS n FROM ctx WHERE coded GROUP BY ALL) SELECT c.ctx, CAST(s AS INTEGER) AS symbol, coalesce(n, 0) + 1 AS n FROM (SELECT DISTINCT ctx FROM k) c CROSS JOIN range(16) r(s) LEFT JOIN k ON k.ctx = c.ctx AND k.label = s")
def ctx_hist(spark, sf_dir):
    return context.context_histogram(_contexts(spark, sf_dir).where("coded"), 16)


_MASK = f"{_PX}, m AS (SELECT frame_id, i AS bi, j AS bj, CAST(x > 0 AS INTEGER) AS v FROM px)"


def _mask(spark, sf_dir):
    return _px(spark, sf_dir).select("frame_id", F.col("i").alias("bi"), F.col("j").alias("bj"), (F.col("x") > 0).alias("coded"))


@query(f"WITH {_MASK} SELECT coalesce(nw.v, 0) || '~' || coalesce(n.v, 0) || '~' || coalesce(ne.v, 0) || '~' || coalesce(w.v, 0) AS ctx, a.v AS symbol, count(*) AS n FROM m a {_at('v', -1, -1, 'm', 'nw')} {_at('v', -1, 0, 'm', 'n')} {_at('v', -1, 1, 'm', 'ne')} {_at('v', 0, -1, 'm', 'w')} GROUP BY ALL")
def cabac_ctx_counts(spark, sf_dir):
    return context.mask_contexts(_mask(spark, sf_dir)).groupBy("ctx", F.col("coded").cast("int").alias("symbol")).agg(F.count("*").alias("n"))


@query(f"""WITH {_MASK} SELECT CASE WHEN a.bi = 0 AND a.bj = 0 THEN -1 WHEN a.bi = 0 THEN -3 WHEN a.bj = 0 THEN -7 ELSE nw.v END || '~' || CASE WHEN a.bi = 0 THEN -3 ELSE n.v END || '~' || CASE WHEN a.bi = 0 AND a.bj = 7 THEN -2 WHEN a.bi = 0 THEN -3 WHEN a.bj = 7 THEN -8 ELSE ne.v END || '~' || CASE WHEN a.bj = 0 THEN -7 ELSE w.v END AS ctx,
a.v AS symbol, count(*) AS n FROM m a {_at('v', -1, -1, 'm', 'nw')} {_at('v', -1, 0, 'm', 'n')} {_at('v', -1, 1, 'm', 'ne')} {_at('v', 0, -1, 'm', 'w')} GROUP BY ALL""")
def cabac_border_ctx_counts(spark, sf_dir):
    return context.mask_contexts(_mask(spark, sf_dir), border_aware=True).groupBy("ctx", F.col("coded").cast("int").alias("symbol")).agg(F.count("*").alias("n"))


_S = "list_sort([0, 1, 2])"
_PUT = "CASE WHEN list_contains({l}, {x}) THEN {{'l': {l}, 'at': {at}}} ELSE {{'l': list_concat(list_slice({l}, 1, {at}), [{x}], list_slice({l}, {at} + 2, 3)), 'at': {at} - 1}} END"
_MPM = f"""{_COD}, z AS (SELECT a.frame_id, a.bi, a.bj, a.label, coalesce(nw.label, 0) AS x1, coalesce(n.label, 0) AS x2, coalesce(w.label, 0) AS x3 FROM cod a {_at('v', -1, -1, 'cod', 'nw')} {_at('v', -1, 0, 'cod', 'n')} {_at('v', 0, -1, 'cod', 'w')}),
s1 AS (SELECT *, {_PUT.format(l='[0, 1, 2]', at='2', x='x1')} AS s FROM z), s2 AS (SELECT * EXCLUDE (s), {_PUT.format(l='s.l', at='s.at', x='x2')} AS s FROM s1), s3 AS (SELECT * EXCLUDE (s), {_PUT.format(l='s.l', at='s.at', x='x3')} AS s FROM s2),
md AS (SELECT frame_id, CAST(coalesce(nullif(list_position(list_sort(s.l), label), 0) - 1, 3) AS INTEGER) AS mode FROM s3)"""


@query(f"{_MPM} SELECT mode, count(*) AS n FROM md GROUP BY mode")
def mpm_mode_counts(spark, sf_dir):
    return context.mpm_modes(_coded(spark, sf_dir)).groupBy("mode").agg(F.count("*").alias("n"))


@query(f"{_MPM} SELECT frame_id, CAST(sum(2 + CASE WHEN mode = 3 THEN 4 ELSE 0 END) AS BIGINT) AS bits FROM md GROUP BY 1")
def mpm_bits(spark, sf_dir):
    return context.mpm_bits(_coded(spark, sf_dir), 16)


@query("SELECT a, b, round(cov, 6) + 0.0 AS cov FROM (SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, covar_pop(CAST(embedding[a + 1] AS DOUBLE), CAST(embedding[b + 1] AS DOUBLE)) AS cov FROM embeddings, range(64) x(a), range(64) y(b) WHERE a <= b GROUP BY ALL)")
def covariance_matrix(spark, sf_dir):
    n, mean, products = linear.moments(_vectors(spark, sf_dir))[None]
    cov = products / n - np.outer(mean, mean)
    return spark.createDataFrame([(a, b, round(float(cov[a, b]), 6) + 0.0) for a in range(64) for b in range(a, 64)], "a int, b int, cov double")


@query("SELECT a, b, round(cov, 6) AS cov FROM (SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, covar_pop(CAST(embedding[a + 1] AS DOUBLE), CAST(embedding[b + 1] AS DOUBLE)) AS cov FROM embeddings, range(6) x(a), range(6) y(b) WHERE a <= b GROUP BY ALL)")
def covariance_expressions(spark, sf_dir):
    """The same as aggregate expressions, for vectors of few dimensions: the first six here."""
    return linear.covariance(_vectors(spark, sf_dir), 6).select("a", "b", r6("cov").alias("cov"))


_SIGNS = ((1, 1, 1, 1), (1, 1, -1, -1), (1, -1, 1, -1), (1, -1, -1, 1))
_SIGNED = ", ".join("round((" + " + ".join(f"({v}) * vec[{i + 1}]" for i, v in enumerate(row)) + f") / 2, 6) + 0.0 AS k{n}" for n, row in enumerate(_SIGNS))


@query(f"WITH {_BLK} SELECT frame_id, bi, bj, {_SIGNED} FROM blk")
def pca_apply_fixed(spark, sf_dir):
    out = linear.apply_matrix(_blocks(spark, sf_dir), np.array(_SIGNS) / 2)
    return out.select("frame_id", "bi", "bj", *[(r6(F.col("vec")[k]) + 0.0).alias(f"k{k}") for k in range(4)])


@query(f"WITH {_PX}, q AS (SELECT frame_id, avg(pow(x * 255 - round_even(x * 255, 0), 2)) AS mse, avg(abs(x * 255 - round_even(x * 255, 0))) AS mad FROM px GROUP BY 1) SELECT round(avg(mse), 4) AS mse, round(avg(mad), 4) AS mad, round(avg(10 * log10(255.0 * 255 / mse)), 4) AS psnr, round(sqrt(avg(mse)), 4) AS rmse FROM q")
def mse_psnr(spark, sf_dir):
    a = _frames(spark, sf_dir).withColumn("data", F.transform("data", lambda x: x.cast("double") * 255))
    b = a.withColumn("data", F.transform("data", lambda x: F.rint(x)))
    return metrics.quality(a, b).select(*[F.round(c, 4).alias(c) for c in ("mse", "mad", "psnr", "rmse")])


@query(f"{_COD} SELECT bi, round(sum(b) OVER (ORDER BY bi), 6) AS total_bits FROM (SELECT bi, sum(dmse) AS b FROM cod GROUP BY bi)")
def cumulative_bits(spark, sf_dir):
    sums = _coded(spark, sf_dir).groupBy("bi").agg(F.sum("dmse").alias("bits"))
    return aggregates.running_bits(sums, "bi").select("bi", r6("total_bits").alias("total_bits"))


@query("SELECT CAST(label AS INTEGER) AS symbol, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, symbol LIMIT 3")
def top3_labels(spark, sf_dir):
    return aggregates.most_common(_table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("label")), "label")


@query("SELECT CAST(p - 1 AS INTEGER) AS d, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY p")
def global_mean(spark, sf_dir):
    return aggregates.global_mean(_vectors(spark, sf_dir)).select("d", r6("mean").alias("mean"))


@query(f"{_COD} SELECT bi, round(avg(CASE WHEN dmse > 50 THEN mse ELSE omse END), 6) AS d, round(max(dmse), 6) AS max_dmse FROM cod GROUP BY bi")
def stage_distortion(spark, sf_dir):
    rows = layout.skip_mask(_coded(spark, sf_dir), 50.0)
    return aggregates.stage_distortion(rows, ["bi"]).join(aggregates.largest_gain(rows, ["bi"]), "bi").select("bi", r6("d").alias("d"), r6("max_dmse").alias("max_dmse"))


@query(f"{_LAB} SELECT count(*) FILTER (lab.label <> e.label) AS mismatches FROM lab JOIN embeddings e USING (vec_id)")
def mismatch_check(spark, sf_dir):
    return aggregates.mismatches(_assigned(spark, sf_dir), _table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("int")), ["vec_id"], "label")


_LI = "[l_quantity / 50, l_extendedprice / 105000, l_discount * 10, l_tax * 12]"
_LI_BOOK = [[q, p, d, t] for q in (0.25, 0.75) for p in (0.2, 0.6) for d, t in ((0.25, 0.5), (0.75, 0.5))]


def _lineitem(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    return rows.select(F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 105000, F.col("l_discount") * 10, F.col("l_tax") * 12).alias("vec"))


@query(f"""WITH b AS (SELECT * FROM (VALUES {', '.join(f'({i}, {c})' for i, c in enumerate(_LI_BOOK))}) t(cid, c)), v AS (SELECT row_number() OVER () AS id, {_LI} AS vec FROM lineitem), {_nearest('v', 'id', 'b', 'lab')}
SELECT label, count(*) AS n, round(avg(vec[1]), 5) AS m0, round(avg(vec[2]), 5) AS m1, round(avg(vec[3]), 5) AS m2, round(avg(vec[4]), 5) AS m3 FROM lab GROUP BY label""")
def lineitem_centroids(spark, sf_dir):
    labelled = cluster.assign(_lineitem(spark, sf_dir), np.array(_LI_BOOK))
    return labelled.groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col("vec")[i]), 5).alias(f"m{i}") for i in range(4)])


@query(f"WITH v AS (SELECT {_LI} AS vec FROM lineitem) SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(covar_pop(vec[a + 1], vec[b + 1]), 6) AS cov, round(avg(vec[a + 1]), 6) AS mean FROM v, range(4) x(a), range(4) y(b) WHERE a <= b GROUP BY ALL")
def lineitem_moments(spark, sf_dir):
    n, mean, products = linear.moments(_lineitem(spark, sf_dir))[None]
    cov = products / n - np.outer(mean, mean)
    return spark.createDataFrame([(a, b, round(float(cov[a, b]), 6), round(float(mean[a]), 6)) for a in range(4) for b in range(a, 4)], "a int, b int, cov double, mean double")


@query()
def pca_fit(spark, sf_dir):
    kernel = linear.pca_fit(_blocks(spark, sf_dir))
    return spark.createDataFrame([(i, float(v), [float(x) for x in row]) for i, (v, row) in enumerate(zip(kernel.variances, kernel.matrix))], "component int, variance double, kernel array<double>")


@query("SELECT vec_id AS frame_id, 0 AS wrong FROM embeddings")
def channel_transform_roundtrip(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    fitted = linear.channel_fit(frames, (2, 2), 1)
    back = linear.channel_inverse(linear.channel_transform(frames, fitted), fitted)
    return metrics.frame_errors(frames, back).select("frame_id", (F.col("mse") > 1e-9).cast("int").alias("wrong"))


@query("SELECT vec_id AS frame_id, 0 AS wrong FROM embeddings")
def range_coder_roundtrip(spark, sf_dir):
    """Each frame's sixteen labels through the adaptive range coder and back."""
    rows = _coded(spark, sf_dir).groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("bi", "bj", "label"))).alias("ls"))

    def run(batches):
        for p in batches:
            wrong = []
            for ls in p["ls"]:
                symbols = [int(x["label"]) for x in ls]
                wrong.append(int(entropy.range_decode(entropy.range_encode(symbols, 16), 16) != symbols))
            yield pd.DataFrame({"frame_id": p["frame_id"], "wrong": wrong})

    return rows.mapInPandas(run, "frame_id long, wrong int")


def _weights_sql(name: str, n_in: int, n_out: int) -> str:
    """(o, i, k): the share of input i in output o under the three-lobed kernel, widened when shrinking."""
    ratio, scale = n_in / n_out, max(1.0, n_in / n_out)
    t = f"((i + 0.5 - (o + 0.5) * {ratio}) / {scale})"
    kernel = f"CASE WHEN {t} = 0 THEN 1.0 WHEN abs({t}) < 3 THEN 3 * sin(pi() * {t}) * sin(pi() * {t} / 3) / (pi() * pi() * {t} * {t}) ELSE 0.0 END"
    return f"{name} AS (SELECT o, i, k / sum(k) OVER (PARTITION BY o) AS k FROM (SELECT o, i, {kernel} AS k FROM range({n_out}) a(o), range({n_in}) b(i)))"


def _resampled_sql(name: str, source: str, weights: str) -> str:
    return f"{name} AS (SELECT frame_id, CAST(a.o AS INTEGER) AS i, CAST(b.o AS INTEGER) AS j, round_even(sum(a.k * b.k * x), 0) AS x FROM {source} p JOIN {weights} a ON a.i = p.i JOIN {weights} b ON b.i = p.j GROUP BY ALL)"


_PX255 = "p8 AS (SELECT frame_id, i, j, CAST(CAST(x AS FLOAT) * CAST(255 AS FLOAT) AS DOUBLE) AS x FROM px)"
_PYRAMID = f"WITH {_PX}, {_PX255}, {_weights_sql('w84', 8, 4)}, {_weights_sql('w42', 4, 2)}, {_resampled_sql('p4', 'p8', 'w84')}, {_resampled_sql('p2', 'p4', 'w42')}"


def _bright(spark, sf_dir):
    """Frames with values times 255."""
    return _frames(spark, sf_dir).withColumn("data", F.transform("data", lambda x: (x * 255).cast("float")))


@query(f"{_PYRAMID} SELECT frame_id, 8 AS res, i, j, round(x, 4) AS x FROM p8 UNION ALL SELECT frame_id, 4, i, j, x + 0.0 FROM p4 UNION ALL SELECT frame_id, 2, i, j, x + 0.0 FROM p2")
def lanczos_pyramid(spark, sf_dir):
    sized = resample.pyramid(_bright(spark, sf_dir), [2, 4, 8])
    return sized.select("frame_id", "res", F.posexplode("data").alias("p", "v")).select("frame_id", "res", F.expr("cast(p div res as int)").alias("i"), F.expr("cast(p % res as int)").alias("j"), (F.round(F.col("v").cast("double"), 4) + 0.0).alias("x"))


_SSIM = f"""WITH {_PX}, {_PX255}, q AS (SELECT frame_id, i, j, x, round_even(x, 0) AS y FROM p8), w AS (SELECT frame_id, a, b, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c
FROM q, range(2) r(a), range(2) s(b) WHERE i BETWEEN a AND a + 6 AND j BETWEEN b AND b + 6 GROUP BY ALL)
SELECT frame_id, round(avg((2 * mx * my + 6.5025) * (2 * c + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225))), 6) AS ssim FROM w GROUP BY 1"""


@query(_SSIM)
def structural_similarity(spark, sf_dir):
    a = _bright(spark, sf_dir)
    return metrics.similarity(a, a.withColumn("data", F.transform("data", lambda x: F.rint(x).cast("float")))).select("frame_id", r6("ssim").alias("ssim"))


@query()
def vq_fit_encode(spark, sf_dir):
    """Two levels with two stages and one stage: what each stage chose."""
    frames = _frames(spark, sf_dir).withColumn("data", F.transform("data", lambda x: (x * 255).cast("float")))
    config = ResolutionConfig(8, (2, 2), 0, 3e4, (LevelConfig((8,), (-1,)), LevelConfig((8, 8), (2, -1))))
    _, choices = vq.encode(frames, vq.fit(frames, config))
    rows = [(c["level"], c["position"], c["codebook"], float(c["th"]), int(c["coded"]), float(c["r"]), float(c["d"])) for c in choices]
    return spark.createDataFrame(rows, "level int, position int, codebook int, th double, coded long, r double, d double")


from blockloom import value_queries  # noqa: E402, F401  registers the rest here


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest codewords, what they gain, the skip mask, and a summary by label."""
    rows = layout.skip_mask(_coded(spark, sf_dir), 50.0)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("coded").cast("long")).alias("coded"), r6(F.avg("dmse")).alias("gain"))


QUERIES = {"flagship": flagship, **QUERIES}
ORACLE_SQL["flagship"] = f"{_COD} SELECT label, count(*) AS n, count(*) FILTER (dmse > 50) AS coded, round(avg(dmse), 6) AS gain FROM cod GROUP BY label"
