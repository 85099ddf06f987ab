"""Further queries, one for each operator that queries.py doesn't show, with the values they give.

They register with queries.py and use its fixtures.  Files go to the shared folder of the session.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from blockloom.functions import color, entropy, metrics
from blockloom.operators import aggregates, cluster, context, layout, linear, resample
from blockloom.plans import decode_cost, rd, vq
from blockloom.queries import (
    _ALONG, _BLK, _COD, _CTX, _D2, _DOWN, _GRID_HEAD, _LAB, _MASK, _PX, _PX255, _PYRAMID, _RGB, _VEC,
    _assigned, _block_book, _blocks, _book, _bright, _coded, _contexts, _frames, _huffman_sql, _mask, _px, _recursive, _resampled_sql, _rgb, _scaled, _table, _vectors, _weights_sql, query, r6,
)
from blockloom.schema import shared_dir
from blockloom.sources import images
from blockloom.streaming import encode


def _values(frames, width: int = 8, digits: int = 4):
    """(frame_id, i, j, x) of one-channel frames."""
    rows = frames.select("frame_id", F.posexplode("data").alias("p", "v"))
    return rows.select("frame_id", F.expr(f"cast(p div {width} as int)").alias("i"), F.expr(f"cast(p % {width} as int)").alias("j"), (F.round(F.col("v").cast("double"), digits) + 0.0).alias("x"))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/blockloom/{name}-{uuid.uuid4().hex}"


def _put(spark, path: str, data: bytes) -> None:
    """A file wherever Spark's file systems reach."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()


# Layout, colour and arithmetic.


@query(f"WITH {_PX}, c AS (SELECT frame_id, CAST(a AS INTEGER) AS ci, CAST(b AS INTEGER) AS cj, i - a AS i, j - b AS j, x FROM px, range(0, 5, 2) r(a), range(0, 5, 2) s(b) WHERE i BETWEEN a AND a + 3 AND j BETWEEN b AND b + 3) SELECT frame_id, ci, cj, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(x, 4) + 0.0 AS x FROM c")
def crop_values(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    places = layout.crop_origins(frames, 4, 2).select(F.xxhash64("frame_id", "i", "j").alias("crop"), F.col("frame_id").alias("whole"), F.col("i").alias("ci"), F.col("j").alias("cj"))
    made = _values(layout.crops(frames, 4, 2), 4).withColumnRenamed("frame_id", "crop")
    return made.join(places, "crop").select(F.col("whole").alias("frame_id"), "ci", "cj", "i", "j", "x")


@query(f"WITH {_PX} SELECT frame_id, i, j, CAST(greatest(0, least(255, CAST(trunc(x * 900) AS INTEGER))) AS SMALLINT) AS x FROM px")
def clip_values(spark, sf_dir):
    return _px(spark, sf_dir).select("frame_id", "i", "j", color.clip(F.col("x") * 900).alias("x"))


@query(f"WITH {_PX} SELECT frame_id, CAST(p AS INTEGER) AS p, round(x, 6) + 0.0 AS x FROM (SELECT frame_id, i * 8 + j - (i * 8 + j) % 3 + 2 - (i * 8 + j) % 3 AS p, x FROM px WHERE i * 8 + j < 63)")
def channel_swap(spark, sf_dir):
    pixels = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), color.swap_channels(F.slice("embedding", 1, 63)).alias("d"))
    return pixels.select("frame_id", F.posexplode("d").alias("p", "v")).select("frame_id", "p", (F.round(F.col("v").cast("double"), 6) + 0.0).alias("x"))


_HALF = f"{_PX}, h AS (SELECT frame_id, CAST(i // 2 AS INTEGER) AS i, CAST(j // 2 AS INTEGER) AS j, avg(x * 100) AS u, avg(x * x * 100) AS v FROM px GROUP BY ALL)"


@query(f"""WITH {_HALF}, t AS (SELECT o, greatest(0, least(3, CAST(floor((o - 0.5) / 2) AS INTEGER) + d)) AS s, CASE d WHEN 0 THEN 1 - ((o - 0.5) / 2 - floor((o - 0.5) / 2)) ELSE (o - 0.5) / 2 - floor((o - 0.5) / 2) END AS k FROM range(8) a(o), range(2) b(d))
SELECT px.frame_id, px.i, px.j, round(sum(a.k * b.k * u), 6) + 0.0 AS u, round(sum(a.k * b.k * v), 6) + 0.0 AS v FROM px JOIN t a ON a.o = px.i JOIN t b ON b.o = px.j JOIN h ON h.frame_id = px.frame_id AND h.i = a.s AND h.j = b.s GROUP BY ALL""")
def chroma_up(spark, sf_dir):
    """Chroma pooled to half size and spread to full size again."""
    yuv = _px(spark, sf_dir).select("frame_id", "i", "j", F.col("x").alias("y"), (F.col("x") * 100).alias("u"), (F.col("x") * F.col("x") * 100).alias("v"))
    return color.to_444(*color.to_420(yuv)).select("frame_id", "i", "j", (r6("u") + 0.0).alias("u"), (r6("v") + 0.0).alias("v"))


@query(f"WITH {_PX} SELECT frame_id, i, j, round(x * 1000, 6) + 0.0 AS x FROM px")
def frame_mean_added_back(spark, sf_dir):
    out = layout.add_mean(layout.remove_mean(_px(spark, sf_dir).withColumn("x", F.col("x") * 1000)))
    return out.select("frame_id", "i", "j", (r6("x") + 0.0).alias("x"))


@query(f"WITH {_PX}, {_PX255}, {_weights_sql('w816', 8, 16)}, {_resampled_sql('p16', 'p8', 'w816')} SELECT frame_id, i, j, x + 0.0 AS x FROM p16")
def lanczos_double(spark, sf_dir):
    return _values(resample.resize_to(_bright(spark, sf_dir), 16), 16)


_SPLIT = f"{_PYRAMID}, {_weights_sql('w48', 4, 8)}, {_resampled_sql('u8', 'p4', 'w48')}, rest AS (SELECT frame_id, i, j, CAST(CAST(p8.x - u8.x AS FLOAT) AS DOUBLE) AS r, u8.x AS u FROM p8 JOIN u8 USING (frame_id, i, j))"


@query(f"{_SPLIT} SELECT frame_id, i, j, round(r, 4) + 0.0 AS x FROM rest")
def pyramid_rest(spark, sf_dir):
    return _values(resample.pyramid_split(_bright(spark, sf_dir))[1])


@query(f"{_SPLIT} SELECT frame_id, i, j, round(CAST(CAST(r + u AS FLOAT) AS DOUBLE), 3) + 0.0 AS x FROM rest")
def pyramid_joined(spark, sf_dir):
    return _values(resample.pyramid_join(*resample.pyramid_split(_bright(spark, sf_dir))), digits=3)


@query(f"{_SPLIT}, c AS (SELECT frame_id, i, j, CAST(CAST(x - x / 4 AS FLOAT) AS DOUBLE) AS x FROM p4), {_resampled_sql('v8', 'c', 'w48')} SELECT frame_id, i, j, round(CAST(CAST(p8.x - v8.x AS FLOAT) AS DOUBLE), 3) + 0.0 AS x FROM p8 JOIN v8 USING (frame_id, i, j)")
def resolution_loss_values(spark, sf_dir):
    """What a fine size lacks of a coarse one less what was coded of it (a quarter here)."""
    fine = _bright(spark, sf_dir)
    coarse = resample.resize_to(fine, 4)
    coded = coarse.withColumn("data", F.transform("data", lambda x: x / 4))
    return _values(layout.resolution_loss(fine, coarse, coded, lambda d: resample.resize_to(d.withColumn("data", F.col("data").cast("array<float>")), 8)), digits=3)


@query(f"WITH {_BLK} SELECT frame_id, bi, bj, v AS prefix_sum, round(vec[1] + vec[2] + vec[3], 6) + 0.0 AS cut_sum, 2 AS n_prefix, 4 AS n_cut FROM (SELECT *, round(vec[1] + vec[2], 6) + 0.0 AS v FROM blk)")
def dim_prefix_truncate(spark, sf_dir):
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    rows = _blocks(spark, sf_dir).withColumns({"p": layout.prefix("vec", 2), "t": layout.truncate("vec", 3)})
    return rows.select("frame_id", "bi", "bj", (r6(total("p")) + 0.0).alias("prefix_sum"), (r6(total("t")) + 0.0).alias("cut_sum"), F.size("p").alias("n_prefix"), F.size("t").alias("n_cut"))


@query(f"{_COD} SELECT frame_id, bi, bj, CAST(d - 1 AS INTEGER) AS d, round(CASE WHEN dmse > 50 THEN c ELSE 0 END, 6) + 0.0 AS x FROM (SELECT cod.frame_id, cod.bi, cod.bj, dmse, unnest(bk.c) AS c, generate_subscripts(bk.c, 1) AS d FROM cod JOIN bk ON bk.cid = cod.label)")
def zeroed_blocks(spark, sf_dir):
    rows = layout.zero_skipped(layout.skip_mask(_coded(spark, sf_dir), 50.0))
    return rows.select("frame_id", "bi", "bj", F.posexplode("ivec").alias("d", "v")).select("frame_id", "bi", "bj", "d", (r6("v") + 0.0).alias("x"))


@query("SELECT vec_id AS frame_id FROM embeddings WHERE vec_id % 3 = 0")
def shape_filter(spark, sf_dir):
    """Frames of one shape among frames of three."""
    frames = _frames(spark, sf_dir).withColumn("h", F.when(F.col("frame_id") % 3 == 0, 8).when(F.col("frame_id") % 3 == 1, 4).otherwise(16))
    return layout.same_shape(frames.withColumn("w", F.expr("cast(64 div h as int)")), 8, 8, 1).select("frame_id")


# Sources and sinks.


def _image_folder(spark, sf_dir, n: int = 12) -> tuple[str, dict[str, int]]:
    """A folder with graymaps of the first vectors (an .npy array for every third) and one broken file."""
    import io

    path, names = _folder(spark, "images"), {}
    for r in _table(spark, sf_dir, "embeddings").where(F.col("vec_id") < n).select("vec_id", "embedding").collect():  # n rows
        x = np.floor(np.abs(np.array(r.embedding, np.float32)) * np.float32(255)).astype(np.uint8).reshape(8, 8)
        if r.vec_id % 3:
            name, data = f"{r.vec_id}.pgm", b"P5\n# values\n8 8\n255\n" + x.tobytes()
        else:
            sink = io.BytesIO()
            np.save(sink, x)
            name, data = f"{r.vec_id}.npy", sink.getvalue()
        names[name] = r.vec_id
        _put(spark, f"{path}/{r.vec_id % 2}/{name}", data)
    _put(spark, f"{path}/0/broken.pgm", b"P5\n8 8\n255\nshort")
    return path, names


def _named(frames, files, names: dict[str, int]):
    """frames of files with the vector's number in place of the path's hash."""
    numbers = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return frames.join(files.select(F.xxhash64("path").alias("frame_id"), F.element_at(numbers, F.element_at(F.split("path", "/"), -1)).cast("long").alias("vec_id")), "frame_id")


_GRAY = f"{_PX}, g AS (SELECT frame_id AS vec_id, i * 8 + j AS q, floor(abs(CAST(x AS FLOAT)) * CAST(255 AS FLOAT)) AS x FROM px WHERE frame_id < 12)"


def _bgr(frames):
    return frames.select("vec_id", F.posexplode("data").alias("p", "v")).select("vec_id", "p", F.col("v").cast("double").alias("x"))


def _files_below(spark, path):
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


@query(f"WITH {_GRAY} SELECT vec_id, CAST(q * 3 + c AS INTEGER) AS p, CAST(x AS DOUBLE) AS x FROM g, range(3) r(c)")
def image_folder(spark, sf_dir):
    """All images below a folder; the broken file is left out."""
    path, names = _image_folder(spark, sf_dir)
    return _bgr(_named(images.read_images(spark, path), _files_below(spark, path), names))


@query(f"WITH {_GRAY} SELECT vec_id, CAST(q * 3 + c AS INTEGER) AS p, CAST(x AS DOUBLE) AS x FROM g, range(3) r(c) WHERE vec_id IN (1, 2, 6)")
def image_list(spark, sf_dir):
    path, names = _image_folder(spark, sf_dir)
    return _bgr(_named(images.read_images(spark, path, color="RGB", names=["1.pgm", "2.pgm", "6.npy"]), _files_below(spark, path), names))


@query("SELECT name, CAST(length AS BIGINT) AS length FROM (SELECT vec_id || '.pgm' AS name, 84 AS length FROM embeddings WHERE vec_id < 12 AND vec_id % 3 > 0 AND vec_id % 2 = 0 UNION ALL SELECT 'broken.pgm', 16)")
def file_list(spark, sf_dir):
    path, _ = _image_folder(spark, sf_dir)
    return images.list_files(spark, f"{path}/0", "*.pgm").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query(f"WITH {_GRAY}, p8 AS (SELECT vec_id AS frame_id, CAST(q // 8 AS INTEGER) AS i, CAST(q % 8 AS INTEGER) AS j, x FROM g), {_weights_sql('w84', 8, 4)}, {_resampled_sql('p4', 'p8', 'w84')} SELECT s.set, 8 AS res, frame_id AS vec_id, i, j, CAST(x AS DOUBLE) AS x FROM p8 JOIN (VALUES ('even', 0), ('odd', 1)) s(set, r) ON frame_id % 2 = r UNION ALL SELECT s.set, 4, frame_id, i, j, x + 0.0 FROM p4 JOIN (VALUES ('even', 0), ('odd', 1)) s(set, r) ON frame_id % 2 = r")
def image_sets(spark, sf_dir):
    """Two folders, each at two sizes, in one table."""
    path, names = _image_folder(spark, sf_dir)
    sets = _named(images.load_sets(spark, {"even": f"{path}/0", "odd": f"{path}/1"}, [4, 8]), _files_below(spark, path), names)
    rows = sets.select("set", "res", "vec_id", F.posexplode("data").alias("p", "v")).where("p % 3 = 0")
    return rows.select("set", "res", "vec_id", F.expr("cast(p div 3 div res as int)").alias("i"), F.expr("cast(p div 3 % res as int)").alias("j"), (F.col("v").cast("double") + 0.0).alias("x"))


@query(f"WITH {_PX}, {_PX255} SELECT frame_id, i, j, round(x, 4) + 0.0 AS x FROM p8 UNION ALL SELECT -1, -1, -1, ceil(count(DISTINCT frame_id) / 100) FROM p8")
def frame_shards(spark, sf_dir):
    """Written by size, at most a hundred frames a file, and read again; row -1 says how many files."""
    path = _folder(spark, "shards")
    images.write_frames(_bright(spark, sf_dir).coalesce(1), path, per_file=100)
    back = _values(images.read_frames(spark, path, 8))
    return back.unionByName(_files_below(spark, path).agg(F.count("*").cast("double").alias("x")).select(F.lit(-1).cast("long").alias("frame_id"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "x"))


@query(f"{_PYRAMID} SELECT frame_id, 4 AS res, i, j, x + 0.0 AS x FROM p4 UNION ALL SELECT frame_id, 2, i, j, x + 0.0 FROM p2")
def spatial_dump(spark, sf_dir):
    """One folder a size; two of the sizes are read back."""
    path = _folder(spark, "spatial")
    images.write_frames(resample.pyramid(_bright(spark, sf_dir), [2, 4, 8]), path)
    return _values(images.read_frames(spark, path, 4), 4).withColumn("res", F.lit(4)).unionByName(_values(images.read_frames(spark, path, 2), 2).withColumn("res", F.lit(2)))


@query(f"WITH {_PX}, c AS (SELECT frame_id, CAST(a AS INTEGER) AS ci, CAST(b AS INTEGER) AS cj, CAST(i - a AS INTEGER) AS i, CAST(j - b AS INTEGER) AS j, CAST(CAST(x AS FLOAT) * CAST(255 AS FLOAT) AS DOUBLE) AS x FROM px, range(0, 5, 4) r(a), range(0, 5, 4) s(b) WHERE i BETWEEN a AND a + 3 AND j BETWEEN b AND b + 3), {_weights_sql('w42', 4, 2)} SELECT frame_id, ci, cj, CAST(a.o AS INTEGER) AS i, CAST(b.o AS INTEGER) AS j, round_even(sum(a.k * b.k * x), 0) + 0.0 AS x FROM c JOIN w42 a ON a.i = c.i JOIN w42 b ON b.i = c.j GROUP BY ALL")
def patch_pyramid_half(spark, sf_dir):
    """Crops of 4 x 4 and their halves; the halves are shown."""
    frames = _bright(spark, sf_dir)
    places = layout.crop_origins(frames, 4, 4).select(F.xxhash64("frame_id", "i", "j").alias("crop"), F.col("frame_id").alias("whole"), F.col("i").alias("ci"), F.col("j").alias("cj"))
    halves = _values(images.patch_pyramid(frames, [2, 4], 4).where("res = 2"), 2).withColumnRenamed("frame_id", "crop")
    return halves.join(places, "crop").select(F.col("whole").alias("frame_id"), "ci", "cj", "i", "j", "x")


@query(f"WITH {_PX} SELECT frame_id, i, j, round_even(CAST(CAST(x AS FLOAT) * CAST(1000 AS FLOAT) AS DOUBLE), 0) + 0.0 AS x FROM px")
def raw_frames(spark, sf_dir):
    """16-bit planar files and back; the ids are those of one file's frames in order."""
    path = _folder(spark, "raw")
    images.write_raw(_frames(spark, sf_dir).withColumn("data", F.transform("data", lambda x: (x * 1000).cast("float"))), path)
    return _values(images.read_raw(spark, path, 8, 1))


@query(f"{_LAB.split(', lab AS')[0]} SELECT CAST(cid AS INTEGER) AS cid, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS d, round_even(CAST(unnest(c) AS DOUBLE) * 1000, 0) + 0.0 AS x FROM (SELECT cid, c[1:12] AS c FROM b0)")
def codebook_file(spark, sf_dir):
    """A state file of eight words of 2 x 2 x 3 values, its rows filled up to 32 bytes."""
    words = np.rint(cluster.codebook_array(_book(spark, sf_dir))[:, :12] * 1000).astype("<i2")
    rows = np.zeros((8, 16), "<i2")
    rows[:, :12] = words
    path = _folder(spark, "codebook") + ".state"
    _put(spark, path, b"\1" * (12 * 16 + 16) + rows.tobytes())
    return images.read_codebook(spark, path, 8, 2).select("cid", F.posexplode("centroid").alias("d", "v")).select("cid", "d", (F.col("v") + 0.0).alias("x"))


# Ranks, scores, codebooks.


@query(f"{_LAB} SELECT round(avg(CAST(lab.label = e.label AS DOUBLE)), 6) AS accuracy FROM lab JOIN embeddings e USING (vec_id)")
def accuracy(spark, sf_dir):
    rows = _assigned(spark, sf_dir).join(_table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("truth")), "vec_id")
    return aggregates.accuracy(rows, "truth", "label").select(r6("accuracy").alias("accuracy"))


_TOP = "p AS (SELECT vec_id, CAST(label AS INTEGER) AS label, unnest(embedding[1:16]) AS p, generate_subscripts(embedding[1:16], 1) - 1 AS i FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS k FROM p)"


@query(f"WITH {_TOP}, h AS (SELECT vec_id, bool_or(i = label) FILTER (k <= 3) AS hit FROM k GROUP BY 1) SELECT round(avg(CAST(hit AS DOUBLE)), 6) AS score FROM h")
def top_3_score(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("label", F.slice("embedding", 1, 16).alias("p"))
    return aggregates.top_n_score(rows, "label", "p", 3).select(r6("score").alias("score"))


@query(f"""WITH {_TOP}, a AS (SELECT vec_id, min(k) FILTER (i = label) AS place FROM k GROUP BY 1), s AS (SELECT vec_id AS frame_id, 'hit' AS scheme, 1 + CASE WHEN place = 1 THEN 0 ELSE 4 END AS bits FROM a
UNION ALL SELECT vec_id, 'top3', 2 + CASE WHEN place <= 3 THEN 0 ELSE 4 END FROM a UNION ALL SELECT vec_id, 'escape', CASE WHEN place = 1 THEN 1 WHEN place <= 3 THEN 3 ELSE 7 END FROM a) SELECT frame_id, scheme, CAST(bits AS BIGINT) AS bits FROM s""")
def predicted_mode_bits(spark, sf_dir):
    """Bits of labels that a classifier proposes, under three ways to say whether it is right."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), "label", F.slice("embedding", 1, 16).alias("p"))
    out = None
    for scheme in ("hit", "top3", "escape"):
        part = context.predicted_mode_bits(rows, 16, "p", scheme=scheme).select("frame_id", F.lit(scheme).alias("scheme"), F.col("bits").cast("long").alias("bits"))
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH n AS (SELECT vec_id AS cid, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) * (vec_id + 1) AS e FROM embeddings WHERE vec_id < 8) SELECT CAST(cid AS INTEGER) AS cid, CAST(row_number() OVER (ORDER BY e, cid) AS INTEGER) AS rank FROM n")
def energy_rank(spark, sf_dir):
    grown = _book(spark, sf_dir).withColumn("centroid", F.transform("centroid", lambda x: x * F.sqrt(F.col("cid") + 1.0)))
    return cluster.energy_rank(grown).select("cid", F.col("rank").cast("int").alias("rank"))


@query(f"WITH v AS (SELECT vec_id, embedding AS vec FROM embeddings), d AS (SELECT v.vec_id, b.vec_id AS cid, {_D2.format(a='v.vec', b='b.vec')} AS d2 FROM v, v b WHERE b.vec_id < 40), n AS (SELECT kmidx, size, vec_id, min(d2) AS d2 FROM d JOIN (VALUES (0, 8), (1, 16), (2, 32), (3, 40)) s(kmidx, size) ON cid < size GROUP BY ALL) SELECT size, round(sum(d2), 6) AS sse FROM n GROUP BY 1")
def fixed_prefix_sse(spark, sf_dir):
    vecs, book = _vectors(spark, sf_dir), _book(spark, sf_dir, 40)
    sizes = aggregates.fixed_prefixes(40)
    nested = aggregates.prefix_codebooks(book, book.select("cid", F.col("cid").alias("rank")), sizes)
    out = None
    for kmidx, size in enumerate(sizes):
        part = cluster.assign(vecs, cluster.codebook_array(nested.where(F.col("kmidx") == kmidx))).agg(r6(F.sum("d2")).alias("sse")).select(F.lit(size).alias("size"), "sse")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{_LAB} SELECT vec_id, label, CAST(0 AS INTEGER) AS few, round(d2, 6) AS d2 FROM lab UNION ALL SELECT vec_id, CAST(vec_id AS INTEGER), 1, 0.0 FROM embeddings WHERE vec_id < 8")
def given_centres(spark, sf_dir):
    """Centres that are given stay as they are; of no more rows than words, the rows are the words."""
    vecs = _vectors(spark, sf_dir)
    given = cluster.assign(vecs, cluster.fit_codebook(vecs, 8, "vec_id", centres=cluster.codebook_array(_book(spark, sf_dir)))).withColumn("few", F.lit(0))
    some = vecs.where("vec_id < 8")
    few = cluster.assign(some, cluster.fit_codebook(some, 9, "vec_id")).withColumn("few", F.lit(1))
    return given.unionByName(few).select("vec_id", "label", "few", (r6("d2") + 0.0).alias("d2"))


# Transforms.


_COV = f"WITH {_BLK}, c AS (" + " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b, covar_pop(vec[{a + 1}], vec[{b + 1}]) AS v FROM blk" for a in range(4) for b in range(4)) + "), m AS (SELECT " + ", ".join(f"max(v) FILTER (a = {a} AND b = {b}) AS c{a}{b}" for a in range(4) for b in range(4)) + " FROM c)"


def _minor(rows: tuple[int, ...]) -> str:
    """A principal minor by the signs of permutations."""
    from itertools import permutations

    out = []
    for p in permutations(rows):
        sign = (-1) ** sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p)))
        out.append(f"({sign}) * " + " * ".join(f"c{a}{b}" for a, b in zip(rows, p)))
    return "(" + " + ".join(out) + ")"


def _symmetric_sql() -> str:
    from itertools import combinations

    parts = [" + ".join(_minor(c) for c in combinations(range(4), k)) for k in range(1, 5)]
    return _COV + " " + " UNION ALL ".join(f"SELECT {k + 1} AS k, round(({p}) * 10 ** {4 * (k + 1)}, 4) AS e FROM m" for k, p in enumerate(parts))


@query(_symmetric_sql())
def pca_variances(spark, sf_dir):
    """The elementary symmetric sums of the variances: those of the covariance's eigenvalues, which the
    SQL takes from its principal minors."""
    poly = np.poly(linear.pca_fit(_blocks(spark, sf_dir)).variances * 1e4)
    return spark.createDataFrame([(k, round(float((-1) ** k * poly[k]), 4)) for k in range(1, 5)], "k int, e double")


@query(f"{_COV} SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(v * 1e4, 4) + 0.0 AS cov, CAST(a = b AS DOUBLE) + 0.0 AS unit FROM c")
def pca_kernel(spark, sf_dir):
    """The covariance put together again from the fitted components, and that they are orthonormal."""
    k = linear.pca_fit(_blocks(spark, sf_dir))
    cov, unit = k.matrix.T @ np.diag(k.variances) @ k.matrix * 1e4, np.round(k.matrix @ k.matrix.T, 9)
    return spark.createDataFrame([(a, b, round(float(cov[a, b]), 4) + 0.0, float(abs(unit[a, b])) + 0.0) for a in range(4) for b in range(4)], "a int, b int, cov double, unit double")


@query(f"WITH {_BLK} SELECT frame_id, bi, bj, " + ", ".join(f"round(vec[{i + 1}], 6) + 0.0 AS v{i}" for i in range(4)) + " FROM blk")
def pca_inverse(spark, sf_dir):
    kernel = linear.pca_fit(_blocks(spark, sf_dir))
    back = linear.pca_inverse(linear.pca_transform(_blocks(spark, sf_dir), kernel), kernel)
    return back.select("frame_id", "bi", "bj", *[(r6(F.col("vec")[i]) + 0.0).alias(f"v{i}") for i in range(4)])


@query(f"WITH {_PX} SELECT frame_id, round(sum(x * x), 4) AS energy, round(sum(x), 2) + 0.0 AS total FROM px GROUP BY 1")
def channel_transform_energy(spark, sf_dir):
    """Coefficients of both levels hold the frame's energy; the deepest alone and the rest give its sum."""
    frames = _frames(spark, sf_dir)
    fitted = linear.channel_fit(frames, (2, 2), 1)
    coeffs = linear.channel_transform(frames, fitted)
    energy = coeffs.select("frame_id", F.explode("vec").alias("x")).groupBy("frame_id").agg(F.round(F.sum(F.col("x") * F.col("x")), 4).alias("energy"))
    back = _values(linear.channel_inverse(coeffs, fitted), digits=7).groupBy("frame_id").agg((F.round(F.sum("x"), 2) + 0.0).alias("total"))
    return energy.join(back, "frame_id")


@query(f"WITH {_PX} SELECT frame_id, round(sum(x * x), 4) AS energy FROM px GROUP BY 1")
def per_frame_transform_energy(spark, sf_dir):
    coeffs = linear.per_frame_channel_transform(_frames(spark, sf_dir), (2, 2), 1)
    return coeffs.select("frame_id", F.explode("vec").alias("x")).groupBy("frame_id").agg(F.round(F.sum(F.col("x") * F.col("x")), 4).alias("energy"))


@query("SELECT vec_id AS frame_id, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS p, floor(unnest(e) * CAST(1000 AS FLOAT)) + 0.0 AS x FROM (SELECT vec_id, embedding[1:63] AS e FROM embeddings)")
def per_frame_colour_back(spark, sf_dir):
    """Each frame's own colour components and back: whole numbers come back but for rounding."""
    whole = F.transform(F.slice("embedding", 1, 63), lambda x: F.floor(x * F.lit(1000).cast("float")))
    rgb = layout.frames_of(_table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("d")), "vec_id", "d", 3, 7, 3)
    back = linear.per_frame_pca(linear.per_frame_pca(rgb), inverse=True)
    return back.select("frame_id", F.posexplode("data").alias("p", "v")).select("frame_id", "p", (F.rint(F.col("v").cast("double")) + 0.0).alias("x"))


# Coders.


@query(_recursive(f"{_COD}, hc AS (SELECT bi, CAST(s AS INTEGER) AS symbol, count(label) AS n FROM (SELECT DISTINCT bi FROM cod) CROSS JOIN range(16) r(s) LEFT JOIN cod USING (bi) WHERE label IS NULL OR label = s GROUP BY ALL), hd AS (SELECT a.bi, CAST(s AS INTEGER) AS symbol, coalesce(n, 0) AS n FROM (SELECT DISTINCT bi FROM cod) a CROSS JOIN range(16) r(s) LEFT JOIN hc ON hc.bi = a.bi AND hc.symbol = s), {_huffman_sql('hd', 'bi', 1)} SELECT bi, bits FROM hb"))
def huffman_by_row(spark, sf_dir):
    """One code a row of blocks, of counts gathered over all frames."""
    rows = _coded(spark, sf_dir)
    every = rows.select("bi").distinct().withColumn("symbol", F.explode(F.sequence(F.lit(0), F.lit(15))))
    counts = every.join(rows.groupBy("bi", F.col("label").alias("symbol")).agg(F.count("*").alias("n")), ["bi", "symbol"], "left").fillna(0, ["n"])
    return entropy.huffman_bits(counts, ["bi"], smooth=1)


@query(_recursive(f"{_CTX}, cs AS (SELECT ctx, label, count(*) AS k FROM ctx WHERE coded GROUP BY ALL), hd AS (SELECT c.ctx, CAST(s AS INTEGER) AS symbol, coalesce(k, 0) AS n FROM (SELECT DISTINCT ctx FROM cs) c CROSS JOIN range(16) r(s) LEFT JOIN cs ON cs.ctx = c.ctx AND cs.label = s), {_huffman_sql('hd', 'ctx', 1)} SELECT CAST(sum(bits) AS BIGINT) AS bits FROM hb"))
def context_coder_bits(spark, sf_dir):
    """Labels under a code for each context of labels above and to the left."""
    rows = _contexts(spark, sf_dir).where("coded")
    return entropy.context_bits(rows, entropy.context_code_lengths(context.context_histogram(rows, 16)), 16).select(F.col("bits").cast("long").alias("bits"))


@query(_recursive(f"{_COD}, hd AS (SELECT 0 AS all_, CAST(label AS INTEGER) AS symbol, count(*) AS n FROM cod GROUP BY ALL), {_huffman_sql('hd', 'all_', 1)} SELECT bits FROM hb"))
def huffman_rate(spark, sf_dir):
    return entropy.huffman_bits(aggregates.histogram(_coded(spark, sf_dir), "label"), smooth=1)


_THS = [0.0, 20.0, 50.0, 100.0]


@query(f"""{_COD}, g AS (SELECT label AS l, label % 5 AS grp FROM (SELECT unnest(range(16)) AS label)), t AS (SELECT CAST(th AS DOUBLE) AS th FROM (SELECT unnest({_THS}) AS th)),
m AS (SELECT th, frame_id, bi, bj, label, dmse > th AS coded, CASE WHEN dmse > th THEN grp END AS v FROM cod JOIN g ON l = label, t), m1 AS (SELECT *, lag(v) OVER ({_DOWN.replace('BY frame_id', 'BY th, frame_id', 1)}) AS n, lag(v, 2) OVER ({_DOWN.replace('BY frame_id', 'BY th, frame_id', 1)}) AS nn, lag(v) OVER ({_ALONG.replace('BY frame_id', 'BY th, frame_id', 1)}) AS w, lag(v, 2) OVER ({_ALONG.replace('BY frame_id', 'BY th, frame_id', 1)}) AS ww FROM m),
m2 AS (SELECT *, lead(n) OVER ({_ALONG.replace('BY frame_id', 'BY th, frame_id', 1)}) AS ne, lag(n) OVER ({_ALONG.replace('BY frame_id', 'BY th, frame_id', 1)}) AS nw FROM m1), k AS (SELECT coalesce(n, ne, nn, -1) || '~' || coalesce(w, nw, ww, -1) AS ctx, label, count(*) AS k FROM m2 WHERE coded GROUP BY ALL)
SELECT c.ctx, CAST(s AS INTEGER) AS symbol, coalesce(k, 0) + 1 AS n FROM (SELECT DISTINCT ctx FROM k) c CROSS JOIN range(16) r(s) LEFT JOIN k ON k.ctx = c.ctx AND k.label = s""")
def threshold_context_hist(spark, sf_dir):
    """Contexts of codeword groups (five here), counted over four thresholds in one scan."""
    groups = spark.range(16).select(F.col("id").cast("int").alias("cid"), (F.col("id") % 5).cast("int").alias("group"))
    return context.threshold_histogram(_coded(spark, sf_dir), 16, _THS, groups)


def _binary_sql() -> str:
    """The adaptive binary coder as a recursion over the symbols of each context's stream."""
    table = ", ".join(f"({i}, {q}, {b})" for i, (q, b) in enumerate(zip(entropy.INTERVALS, entropy.STEPS_BACK)))
    last = len(entropy.INTERVALS) - 1
    return f"""{_MASK}, b AS (SELECT m.frame_id, bi, bj, v, CASE WHEN bi = 0 AND bj = 0 THEN -1 WHEN bi = 0 THEN -3 WHEN bj = 0 THEN -7 ELSE lag(n) OVER ({_ALONG}) END || '~' || CASE WHEN bi = 0 THEN -3 ELSE n END || '~' || CASE WHEN bi = 0 AND bj = 7 THEN -2 WHEN bi = 0 THEN -3 WHEN bj = 7 THEN -8 ELSE lead(n) OVER ({_ALONG}) END || '~' || CASE WHEN bj = 0 THEN -7 ELSE lag(v) OVER ({_ALONG}) END AS ctx FROM (SELECT *, lag(v) OVER ({_DOWN}) AS n FROM m) m),
s AS MATERIALIZED (SELECT ctx, list(v ORDER BY frame_id, bi, bj) AS l FROM b GROUP BY 1), q(i, part, back) AS (VALUES {table}), ql AS MATERIALIZED (SELECT list(part ORDER BY i) AS parts, list(back ORDER BY i) AS backs FROM q),
go(ctx, pos, size, code, state, likely, bits) AS (SELECT ctx, 0, 65536, 0, {entropy.FIRST_STATE}, 0, 0 FROM s
UNION ALL SELECT ctx, pos + 1, CASE WHEN quiet THEN rest ELSE CAST(pow(2, 16 - least(16, CAST(floor(log2(kept)) AS INTEGER) + 1)) AS INTEGER) * kept END, CASE WHEN quiet THEN code ELSE (moved * 2) & 65535 END,
CASE WHEN quiet THEN state WHEN hit THEN least(state + 1, {last}) ELSE state - back END, CASE WHEN NOT quiet AND NOT hit AND backs[state - back + 1] < 0 THEN 1 - likely ELSE likely END, bits + CASE WHEN quiet THEN 0 ELSE 1 + CAST(swap AND rest + code > 65535 AS INTEGER) END
FROM (SELECT *, CASE WHEN swap THEN part ELSE rest END AS kept, CASE WHEN swap THEN (code + rest) & 65535 ELSE code END AS moved FROM (SELECT *, hit AND rest >= 32768 AS quiet, (rest < part) = hit AS swap FROM (SELECT g.*, size - parts[state + 1] AS rest, parts[state + 1] AS part, backs[state + 1] AS back, backs, l[pos + 1] = likely AS hit FROM go g JOIN s USING (ctx), ql WHERE pos < len(l)))))"""


@query(f"WITH RECURSIVE {_binary_sql()} SELECT CAST(sum(bits) AS BIGINT) AS bits FROM (SELECT ctx, arg_max(bits, pos) AS bits FROM go GROUP BY ctx)")
def mask_coder_bits(spark, sf_dir):
    """A mask under one adaptive state for each context, its symbols in order over all frames."""
    return entropy.mask_stream_bits(context.mask_contexts(_mask(spark, sf_dir), border_aware=True)).select(F.col("bits").cast("long").alias("bits"))


@query(f"{_COD}, s AS (SELECT frame_id, string_agg(format('{{:04b}}', label), '' ORDER BY bi, bj) AS bits FROM cod GROUP BY 1) SELECT frame_id, bits, upper(string_agg(format('{{:02x}}', CAST(CAST(bits[i * 8 + 1 : i * 8 + 8] AS BIT) AS INTEGER)), '' ORDER BY i)) AS packed, 0 AS wrong FROM s, range(8) r(i) GROUP BY ALL")
def label_bit_strings(spark, sf_dir):
    """Labels as four bits each, packed into bytes and read back."""
    rows = _coded(spark, sf_dir).groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("bi", "bj", "label"))).alias("ls"))

    def run(batches):
        for p in batches:
            labels = [[int(x["label"]) for x in ls] for ls in p["ls"]]
            bits = [entropy.bits_of(x, 4) for x in labels]
            packed = [entropy.pack_bits(b) for b in bits]
            wrong = [int(entropy.numbers_of(entropy.unpack_bits(d, len(b)), 4) != x) for d, b, x in zip(packed, bits, labels)]
            yield p[["frame_id"]].assign(bits=bits, packed=[d.hex().upper() for d in packed], wrong=wrong)

    return rows.mapInPandas(run, "frame_id long, bits string, packed string, wrong int")


@query(_recursive(f"""{_COD}, ths AS (SELECT CAST(k AS INTEGER) AS k, k * 100.0 AS th FROM range(800) g(k)), {_GRID_HEAD}, h AS (SELECT *, 2.75 * p + 0.00276 AS h FROM p),
g AS (SELECT k, th, coded, CASE WHEN coded = 0 THEN 0 ELSE (floor(h * n) + 1 + b) / frames END AS r, (m + all_o - h.o) / n AS d FROM h JOIN lb USING (k), f), grid AS (SELECT *, d + 3e6 * r / 1048576 * pow(1.1, 5) AS cost FROM g, f),
s AS (SELECT *, max(CAST(cost > last AS INTEGER)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS risen FROM (SELECT *, lag(cost) OVER (ORDER BY k) AS last FROM grid))
SELECT k, th, coded, round(r, 6) AS r, round(d, 6) AS d, round(cost, 6) AS cost FROM s WHERE coalesce(risen, 0) = 0 ORDER BY s.cost, k LIMIT 1"""))
def stepped_thresholds(spark, sf_dir):
    """The scan of thresholds 0, 100, ... with a Huffman code for each."""
    out = rd.stepped_search(_coded(spark, sf_dir), 16, _frames(spark, sf_dir).count(), 3e6, 3)
    return out.select("k", "th", "coded", *[r6(c).alias(c) for c in ("r", "d", "cost")])


@query(_recursive(f"""{_CTX.replace('dmse > 20', 'dmse > 50')}, cs AS (SELECT ctx, label, count(*) AS k FROM ctx WHERE coded GROUP BY ALL), hd AS (SELECT c.ctx, CAST(s AS INTEGER) AS symbol, coalesce(k, 0) AS n FROM (SELECT DISTINCT ctx FROM cs) c CROSS JOIN range(16) r(s) LEFT JOIN cs ON cs.ctx = c.ctx AND cs.label = s), {_huffman_sql('hd', 'ctx', 1)} SELECT 0 AS k, CAST(sum(bits) AS BIGINT) AS bits FROM hb"""))
def label_coder_bits(spark, sf_dir):
    """A context coder fitted at one threshold, each codeword a group of its own, and what it takes there."""
    rows = _coded(spark, sf_dir)
    codes = entropy.context_code_lengths(context.threshold_histogram(rows, 16, [50.0]))
    by_context = codes.groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct("symbol", "length"))).alias("ls")).collect()
    coder = vq.LabelCoder(tuple(range(16)), {r.ctx: tuple(x.length for x in r.ls) for r in by_context})
    return coder.bits(rows, [50.0]).select("k", F.col("bits").cast("long").alias("bits"))


# Curves and costs.

# Published points of three models.
_MAIN = ((0.00496, 728.073348), (0.03195, 397.644531), (0.05903, 289.792297), (0.08069, 231.719757), (0.10219, 197.07225))
_OTHERS = {"main": _MAIN, "other": ((0.00559, 736.44), (0.03459, 388.59), (0.0594, 291.0), (0.09298, 242.2)), "third": ((0.00560, 735.41), (0.0321, 399.9), (0.06, 292.5), (0.11, 199.0))}
_POINTS = "pts(model, bpp, mse) AS (VALUES " + ", ".join(f"('{m}', {b}, {e})" for m, ps in _OTHERS.items() for b, e in ps) + ")"


def _fit_sql(x: str, y: str, out: str) -> str:
    """Area under the cubic of least squares between the common ends, by orthogonal polynomials and
    Simpson's rule, which is exact for cubics."""
    return f"""{out}x AS (SELECT model, {x} AS x, {y} AS y FROM p), {out}r AS (SELECT a.model, greatest(min(a.x), (SELECT min(x) FROM {out}x WHERE model = 'main')) AS lo, least(max(a.x), (SELECT max(x) FROM {out}x WHERE model = 'main')) AS hi FROM {out}x a GROUP BY 1),
{out}e AS (SELECT b.model, r.model AS other, CASE k WHEN 0 THEN lo WHEN 1 THEN (lo + hi) / 2 ELSE hi END AS x, CASE k WHEN 1 THEN 4 ELSE 1 END AS k FROM {out}r r JOIN (SELECT DISTINCT model FROM p) b ON b.model IN (r.model, 'main'), range(3) z(k)),
{out}0 AS (SELECT model, NULL AS other, x, y, NULL AS k, 1.0 AS p0 FROM {out}x UNION ALL SELECT model, other, x, NULL, k, 1.0 FROM {out}e),
{out}1 AS (SELECT *, x - avg(x) FILTER (y IS NOT NULL) OVER w AS p1 FROM {out}0 WINDOW w AS (PARTITION BY model)),
{out}2 AS (SELECT *, (x - sum(x * p1 * p1) FILTER (y IS NOT NULL) OVER w / sum(p1 * p1) FILTER (y IS NOT NULL) OVER w) * p1 - sum(p1 * p1) FILTER (y IS NOT NULL) OVER w / count(y) OVER w AS p2 FROM {out}1 WINDOW w AS (PARTITION BY model)),
{out}3 AS (SELECT *, (x - sum(x * p2 * p2) FILTER (y IS NOT NULL) OVER w / sum(p2 * p2) FILTER (y IS NOT NULL) OVER w) * p2 - sum(p2 * p2) FILTER (y IS NOT NULL) OVER w / sum(p1 * p1) FILTER (y IS NOT NULL) OVER w * p1 AS p3 FROM {out}2 WINDOW w AS (PARTITION BY model)),
{out}4 AS (SELECT *, {' + '.join(f'p{d} * sum(y * p{d}) FILTER (y IS NOT NULL) OVER w / sum(p{d} * p{d}) FILTER (y IS NOT NULL) OVER w' for d in range(4))} AS f FROM {out}3 WINDOW w AS (PARTITION BY model)),
{out} AS (SELECT other AS model, (sum(k * f) FILTER (model = other AND rn = 1) - sum(k * f) FILTER (model = 'main' AND rn2 = 1)) / 6 AS gap FROM (SELECT *, row_number() OVER (PARTITION BY model, other, x) AS rn, row_number() OVER (PARTITION BY model, other, x) AS rn2 FROM {out}4 WHERE y IS NULL) GROUP BY 1)"""


@query(f"WITH {_POINTS}, p AS (SELECT model, bpp, 10 * log10(65025.0 / mse) AS psnr FROM pts), {_fit_sql('ln(bpp)', 'psnr', 'g')}, {_fit_sql('psnr', 'ln(bpp)', 'h')} SELECT model, round(g.gap, 4) + 0.0 AS bd_psnr, round((exp(h.gap) - 1) * 100, 4) + 0.0 AS bd_rate FROM g JOIN h USING (model)")
def bd_rate(spark, sf_dir):
    points = spark.createDataFrame([(m, *p) for m, ps in _OTHERS.items() for p in ps], "model string, bpp double, mse double")
    return metrics.bd_table(points, "main").select("model", *[(F.round(c, 4) + 0.0).alias(c) for c in ("bd_psnr", "bd_rate")])


_CURVE = "c AS (SELECT DISTINCT round(l_quantity, 4) AS x, round(l_extendedprice / 1000 + l_discount, 7) AS y FROM lineitem WHERE l_orderkey < 30)"


@query(f"WITH {_CURVE}, e AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM c a JOIN c b ON (a.x, a.y) <> (b.x, b.y) JOIN c q ON true GROUP BY ALL HAVING min((b.x - a.x) * (q.y - a.y) - (b.y - a.y) * (q.x - a.x)) >= 0 AND count(*) FILTER ((b.x - a.x) * (q.y - a.y) - (b.y - a.y) * (q.x - a.x) = 0 AND NOT (q.x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) AND q.y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y))) = 0), v AS (SELECT ax AS x, ay AS y FROM e UNION SELECT bx, by_ FROM e) SELECT x, y FROM v WHERE (x, y) <> (SELECT (x, y) FROM v ORDER BY x, y LIMIT 1)")
def rd_hull(spark, sf_dir):
    """Corners of the hull of a set of points, the first left out."""
    rows = _table(spark, sf_dir, "lineitem").where("l_orderkey < 30").select(F.round("l_quantity", 4).alias("x"), F.round(F.col("l_extendedprice") / 1000 + F.col("l_discount"), 7).alias("y")).distinct()
    return spark.createDataFrame(metrics.hull([(r.x, r.y) for r in rows.collect()]), "x double, y double")


@query(f"WITH {_POINTS} SELECT model, CAST(bpp AS DOUBLE) AS bpp, CAST(mse AS DOUBLE) AS mse FROM pts WHERE bpp < 0.06")
def displayed_points(spark, sf_dir):
    points = spark.createDataFrame([(m, *p) for m, ps in _OTHERS.items() for p in ps], "model string, bpp double, mse double")
    return metrics.displayed(points, 0.06)


@query("SELECT 'p' AS part, CAST(sum(pow(256 // pow(2, k), 2) * 4 * 7) + 80 * 256 * 256 AS DOUBLE) AS operations FROM range(1, 4) r(k)")
def decode_operations(spark, sf_dir):
    """Operations to decode three levels of 2 x 2 windows at 256 after nothing but a doubling from 128."""
    cost = decode_cost.inverse_transform_cost([2, 2, 2], 256) + decode_cost.upsample_cost(256)
    return spark.createDataFrame([("p", cost.value)], "part string, operations double")


@query(f"{_COD} SELECT frame_id, bi, bj, label, dmse > 50 AS coded FROM cod")
def streaming_encode(spark, sf_dir):
    """Frames that arrive as files of a stream, encoded with a fixed codebook."""
    path = _folder(spark, "stream")
    frames = _frames(spark, sf_dir).withColumn("data", F.transform("data", lambda x: (x * 100).cast("float")))
    frames.repartition(3).write.parquet(f"{path}/in")
    book = cluster.codebook_array(_scaled(_block_book(spark, sf_dir).withColumnRenamed("centroid", "vec")).withColumnRenamed("vec", "centroid"))
    encode.encode_stream(encode.stream_frames(spark, f"{path}/in", 2), book, 2, 50.0, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("frame_id", "bi", "bj", "label", "coded")


@query(f"""{_COD}, one AS (SELECT frame_id, bi, bj, label, mse, omse, dmse, vec, c FROM cod JOIN bk ON bk.cid = cod.label) SELECT skipped, frame_id, bi, bj, round(list_sum(list_transform(list_zip(vec, c), lambda z: CASE WHEN skipped = 0 AND dmse > 40 THEN z[2] ELSE 0 END)), 5) + 0.0 AS total FROM one, (SELECT unnest([0, 1]) AS skipped)""")
def stage_skip_list(spark, sf_dir):
    """A stage with one codebook and threshold, and the same model with the stage named in the skip list."""
    blocks = _scaled(_blocks(spark, sf_dir))
    book = cluster.codebook_array(_scaled(_block_book(spark, sf_dir).withColumnRenamed("centroid", "vec")).withColumnRenamed("vec", "centroid"))
    coded = layout.zero_skipped(vq.quantise(blocks, book, -1, 40.0))
    total = F.aggregate("ivec", F.lit(0.0), lambda a, x: a + x)
    kept = coded.select(F.lit(0).alias("skipped"), "frame_id", "bi", "bj", (F.round(total, 5) + 0.0).alias("total"))
    frames = layout.fold(blocks, 2, 8, 8)
    model = vq.Model(vq.ResolutionConfig(8, (2,), 0, 1e4), None, [vq.Stage(0, 0, -1, (book,), (40.0,))])
    none, _ = vq.encode(frames, model, skip=frozenset({(0, 0)}))
    left = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return kept.unionByName(none.select(F.lit(1).alias("skipped"), "frame_id", "bi", "bj", (F.round(left, 5) + 0.0).alias("total")))
