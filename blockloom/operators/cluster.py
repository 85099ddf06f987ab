"""Nearest codewords, farthest-point initialisation and k-means.

Codebooks have a bounded number of rows (CODEBOOK_ROWS) and travel with the plan; each step is one
pass over the vectors that brings k partial sums to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.linear import vectors
from blockloom.schema import saved

CODEBOOK_ROWS = 65_536
REFRESH = 32
"""Chosen points after which the distances carried so far are written."""
CHUNK_CELLS = 1 << 22
"""Distances computed at once: it bounds a task's memory whatever k is."""


def codebook_frame(df_or_spark, centroids: np.ndarray) -> DataFrame:
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centroids)], "cid int, centroid array<double>")


def codebook_array(codebook: DataFrame) -> np.ndarray:
    """The centroids in the order of cid."""
    rows = codebook.orderBy("cid").limit(CODEBOOK_ROWS + 1).collect()
    if len(rows) > CODEBOOK_ROWS:
        raise ValueError(f"a codebook has more than {CODEBOOK_ROWS} rows")
    return np.array([r.centroid for r in rows], np.float64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance; ties to the lowest number.

    |x|^2 - 2 x.c + |c|^2 by matrix product leaves, but for rounding, one candidate a row; where
    rounding could hide another, the candidates' differences are squared and summed."""
    label, d2 = np.zeros(len(x), np.int32), np.zeros(len(x))
    norms, step = (centroids * centroids).sum(1), max(1, CHUNK_CELLS // max(1, len(centroids)))
    reach = np.abs(centroids).max(initial=0.0)
    for at in range(0, len(x), step):
        part = x[at : at + step]
        d = norms - 2 * (part @ centroids.T)
        best = d.argmin(1)
        least = d[np.arange(len(part)), best]
        slack = 1e-12 * part.shape[1] * (np.abs(part).max(1, initial=0.0) + reach) ** 2
        for i in np.flatnonzero((d <= (least + slack)[:, None]).sum(1) > 1):
            near = np.flatnonzero(d[i] <= least[i] + slack[i])
            best[i] = near[((part[i] - centroids[near]) ** 2).sum(1).argmin()]
        label[at : at + step] = best
        d2[at : at + step] = ((part - centroids[best]) ** 2).sum(1)
    return label, d2


def assign(df: DataFrame, centroids: np.ndarray, vec: str = "vec", dims: int = -1) -> DataFrame:
    """df with label and d2 of the nearest centroid over the first dims dimensions: no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", label int, d2 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            x = vectors(batch.column(vec))
            label, d2 = nearest(x[:, : book.shape[1] if dims < 0 else dims], book) if len(x) else (np.zeros(0, np.int32), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label), pa.array(d2)], names=[*batch.schema.names, "label", "d2"])

    return df.mapInArrow(run, schema)


def assign_sql(df: DataFrame, codebook: DataFrame, vec: str = "vec") -> DataFrame:
    """The same as expressions: a one-row codebook and array functions, for small codebooks."""
    one = codebook.agg(F.array_sort(F.collect_list(F.struct("cid", "centroid"))).alias("_book"))
    d2 = lambda c: F.aggregate(F.zip_with(F.col(vec), c["centroid"], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("_book", lambda c: F.struct(d2(c).alias("d2"), c["cid"].alias("cid"))))
    return df.join(F.broadcast(one)).withColumn("_best", best).withColumns({"label": F.col("_best.cid"), "d2": F.col("_best.d2")}).drop("_book", "_best")


def decode(labels: DataFrame, codebook: DataFrame, out: str = "ivec") -> DataFrame:
    """Centroids by label; a label without one gets that of label 0."""
    book = F.broadcast(codebook.select(F.col("cid").alias("label"), F.col("centroid").alias(out)))
    first = F.broadcast(codebook.where("cid = 0").select(F.col("centroid").alias("_first")))
    return labels.join(book, "label", "left").join(first).withColumn(out, F.coalesce(out, "_first")).drop("_first")


def vector_sums(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(label, d, sum, n): sums by cluster and dimension with partial aggregation."""
    return df.select("label", F.posexplode(vec).alias("d", "x")).groupBy("label", "d").agg(F.sum(F.col("x").cast("double")).alias("sum"), F.count("*").alias("n"))


def update(df: DataFrame, codebook: DataFrame, vec: str = "vec") -> DataFrame:
    """One update of the centroids of assigned vectors; an empty cluster keeps its own."""
    means = vector_sums(df, vec).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", (F.col("sum") / F.col("n")).alias("m")))).alias("ms"))
    joined = codebook.join(means.withColumnRenamed("label", "cid"), "cid", "left")
    return joined.select("cid", F.coalesce(F.transform("ms", lambda s: s["m"]), "centroid").alias("centroid"))


def _step(df: DataFrame, centroids: np.ndarray, vec: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums and counts by cluster, and the squared error, of one pass."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        sums, n, sse = np.zeros_like(book), np.zeros(len(book), np.int64), np.zeros(len(book))
        for batch in batches:
            x = vectors(batch.column(vec))
            if len(x):
                label, d2 = nearest(x, book)
                np.add.at(sums, label, x)
                n += np.bincount(label, minlength=len(book))
                sse += np.bincount(label, d2, len(book))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at]), pa.array(sse[at]), pa.array(list(sums[at]), pa.list_(pa.float64()))], names=["cid", "n", "sse", "sums"])

    parts = df.select(F.col(vec).cast("array<double>").alias(vec)).mapInArrow(run, "cid long, n long, sse double, sums array<double>")
    by_dim = parts.select("cid", "n", "sse", F.posexplode("sums").alias("d", "x")).groupBy("cid", "d").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.sum("x").alias("x"))
    rows = by_dim.groupBy("cid").agg(F.max("n").alias("n"), F.max("sse").alias("sse"), F.array_sort(F.collect_list(F.struct("d", "x"))).alias("xs")).collect()  # k rows
    sums, n, sse = np.zeros_like(centroids), np.zeros(len(centroids), np.int64), 0.0
    for r in rows:
        sums[r.cid], n[r.cid] = [v.x for v in r.xs], r.n
        sse += r.sse
    return sums, n, sse


def farthest_points(df: DataFrame, k: int, key: str, vec: str = "vec") -> np.ndarray:
    """Farthest from the mean first, then each time farthest from the mean and all chosen points; ties
    to the lowest key.

    Each vector carries its least squared distance so far, written every REFRESH points, so that a
    point costs at most REFRESH distances a vector, however many were chosen before."""
    source = df.select(F.col(key).alias("_key"), F.col(vec).cast("array<double>").alias(vec))
    mean = source.select(F.posexplode(vec).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m")).orderBy("d").collect()
    chosen, fresh = [], [[r.m for r in mean]]
    current = source.withColumn("_least", F.lit(float("inf")))
    for _ in range(k):
        nearer = assign(current, np.array(fresh), vec).withColumn("_least", F.least("_least", "d2")).drop("label", "d2")
        if len(fresh) >= REFRESH:
            current, fresh = saved(nearer, "least-distances"), []
            nearer = current
        top = nearer.agg(F.max_by(vec, F.struct("_least", F.col("_key").cast("decimal(38,0)") * -1)).alias("v")).first()
        chosen.append(list(top.v))
        fresh.append(chosen[-1])
    return np.array(chosen)


def kmeans(df: DataFrame, start: np.ndarray, vec: str = "vec", stop: float = 1e-3, rounds: int = 300, rule: str = "sse") -> tuple[np.ndarray, list[float]]:
    """Lloyd steps from given centroids; returns them and the error before each update.

    rule sse stops when the error per vector changes less than stop; rmse when its root does.  The
    vectors should be cached or written by the caller: every round reads them once."""
    book, errors = np.asarray(start, np.float64), []
    for _ in range(rounds):
        sums, n, sse = _step(df, book, vec)
        total = max(1, int(n.sum()))
        errors.append(sse)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
        if len(errors) > 1:
            last = errors[-2]
            change = abs(sse - last) / total if rule == "sse" else abs((last / total) ** 0.5 - (sse / total) ** 0.5)
            if change < stop:
                break
    return book, errors


def fit_codebook(df: DataFrame, k: int, key: str, vec: str = "vec", centres: np.ndarray | None = None, **options) -> np.ndarray:
    """A codebook of k words: given centres as they are; else all vectors if there are no more than k;
    else farthest points and Lloyd steps, then by falling frequency (ties by the order found)."""
    if centres is not None:
        return np.asarray(centres, np.float64)
    few = df.select(F.col(vec).cast("array<double>").alias(vec), F.col(key).alias("_key")).orderBy("_key").limit(k + 1).collect()
    if len(few) <= k:
        return np.array([r[vec] for r in few])
    book, _ = kmeans(df, farthest_points(df, k, key, vec), vec, **options)
    _, n, _ = _step(df, book, vec)
    return book[np.argsort(-n, kind="stable")]


def fast_codebook(df: DataFrame, k: int, vec: str = "vec", rounds: int = 300, seed: int = 1, points: tuple[int, int] = (39, 1024)) -> np.ndarray:
    """k-means from random vectors, on at most points[1] * k vectors sampled by hash of their content."""
    n = df.count()
    sample = df.sample(min(1.0, points[1] * k / max(n, 1)), seed).select(F.col(vec).cast("array<double>").alias(vec))
    start = sample.orderBy(F.xxhash64(vec, F.lit(seed))).limit(k).collect()
    return kmeans(sample, np.array([r[vec] for r in start]), vec, rounds=rounds)[0]


def mixture_posterior(df: DataFrame, k: int, vec: str = "vec", seed: int = 1):
    """Posterior probabilities of a Gaussian mixture fitted on the vectors, as a column."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector, vector_to_array

    source = df.withColumn("_features", array_to_vector(F.col(vec).cast("array<double>")))
    model = GaussianMixture(k=k, featuresCol="_features", probabilityCol="_p", predictionCol="label", seed=seed).fit(source)
    return model.transform(source).withColumn("posterior", vector_to_array("_p")).drop("_features", "_p")


def energy_rank(codebook: DataFrame) -> DataFrame:
    """(cid, rank) by rising squared norm."""
    from pyspark.sql import Window

    norm = F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x)
    return codebook.select("cid", F.row_number().over(Window.orderBy(norm, "cid")).alias("rank"))
