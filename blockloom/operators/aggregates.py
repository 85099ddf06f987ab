"""Histograms, entropies, ranks, prefixes and running totals over labels and distortions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """(symbol, n) counts; with bins every symbol from 0 on has a row. bins must exceed the largest."""
    counts = df.groupBy(F.col(col).alias("symbol")).agg(F.count("*").alias("n"))
    if bins is None:
        return counts
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("symbol"))
    return every.join(counts, "symbol", "left").select("symbol", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def entropy(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bits a symbol of (symbol, n) rows, by key: the sum of -p log2(p + 1e-10)."""
    window = Window.partitionBy(*(by or []))
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(window))
    return p.groupBy(*(by or [])).agg(F.sum(-F.col("p") * F.log2(F.col("p") + 1e-10)).alias("bits"))


def frequency_rank(counts: DataFrame) -> DataFrame:
    """(symbol, n, rank from 0) by falling count, ties to the lower symbol."""
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "symbol")) - 1)


def gain_rank(labelled: DataFrame, k: int) -> DataFrame:
    """(cid, gain, rank from 0): codewords by falling mean dmse; those never used come last."""
    every = labelled.sparkSession.range(k).select(F.col("id").cast("int").alias("cid"))
    gains = every.join(labelled.groupBy(F.col("label").alias("cid")).agg(F.avg("dmse").alias("gain")), "cid", "left")
    return gains.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("gain"), "cid")) - 1)


def doubling_prefixes(k: int, first: int = 8) -> list[int]:
    out = []
    while first < k:
        out.append(first)
        first *= 2
    return out


def fixed_prefixes(k: int) -> list[int]:
    # Sizes of nested codebooks.
    return [n for n in (8, 16, 32, 64, 128, 256, 1024, 2048) if n < k] + [k]


def prefix_codebooks(codebook: DataFrame, ranks: DataFrame, sizes: list[int]) -> DataFrame:
    """(kmidx, cid, centroid): for each size the codewords of the highest ranks, renumbered by rank."""
    spark: SparkSession = codebook.sparkSession
    grid = spark.createDataFrame(list(enumerate(sizes)), "kmidx int, size int")
    ranked = codebook.join(ranks.select("cid", "rank"), "cid")
    return ranked.join(F.broadcast(grid), F.col("rank") < F.col("size")).select("kmidx", F.col("rank").cast("int").alias("cid"), "centroid")


def stage_distortion(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of mse where coded and omse elsewhere."""
    return df.groupBy(*(by or [])).agg(F.avg(F.when(F.col("coded"), F.col("mse")).otherwise(F.col("omse"))).alias("d"))


def largest_gain(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.max("dmse").alias("max_dmse"))


def global_mean(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.select(F.posexplode(vec).alias("d", "x")).groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def running_bits(df: DataFrame, order: str, bits: str = "bits", by: list[str] | None = None) -> DataFrame:
    window = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total_bits", F.sum(bits).over(window))


def most_common(df: DataFrame, col: str, n: int = 3) -> DataFrame:
    return df.groupBy(F.col(col).alias("symbol")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol").limit(n)


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], col: str) -> DataFrame:
    """How many rows of two tables differ in a column."""
    joined = a.select(*keys, F.col(col).alias("_a")).join(b.select(*keys, F.col(col).alias("_b")), keys, "full")
    return joined.agg(F.count(F.when(~F.col("_a").eqNullSafe(F.col("_b")), 1)).alias("mismatches"))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def top_n_score(df: DataFrame, truth: str, probabilities: str, n: int = 3) -> DataFrame:
    """Share of rows whose class is among the n likeliest; equal ones by lower class."""
    pairs = F.transform(F.col(probabilities), lambda p, i: F.struct((-p).alias("p"), i.alias("i")))
    top = F.transform(F.slice(F.array_sort(pairs), 1, n), lambda s: s["i"])
    return df.agg(F.avg(F.array_contains(top, F.col(truth).cast("int")).cast("double")).alias("score"))
