"""Contexts from causal neighbours, as windows over rows and columns of each frame's grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Codes of places outside the grid, by neighbour and edge.
BORDER_TOP_LEFT, BORDER_TOP_RIGHT, BORDER_TOP, BORDER_LEFT, BORDER_RIGHT = -1, -2, -3, -7, -8


def _grids(by: str = "frame_id"):
    return Window.partitionBy(by, "bj").orderBy("bi"), Window.partitionBy(by, "bi").orderBy("bj")


def neighbours(df: DataFrame, value: str, default: Column | int | None = None, by: str = "frame_id") -> DataFrame:
    """Adds n, nw, ne, w, nn, ww: the values at fixed places of a full grid, default outside it."""
    down, along = _grids(by)
    out = df.withColumns({"_n": F.lag(value, 1).over(down), "_nn": F.lag(value, 2).over(down), "_w": F.lag(value, 1).over(along), "_ww": F.lag(value, 2).over(along)})
    out = out.withColumns({"_nw": F.lag("_n", 1).over(along), "_ne": F.lead("_n", 1).over(along)})
    fill = default if isinstance(default, Column) else F.lit(default)
    return out.withColumns({k: F.coalesce(F.col("_" + k), fill) for k in ("n", "nw", "ne", "w", "nn", "ww")}).drop("_n", "_nn", "_w", "_ww", "_nw", "_ne")


def label_contexts(df: DataFrame, label: str = "label", coded: str = "coded", groups: DataFrame | None = None) -> DataFrame:
    """Adds ctx = up~left.  up is the value above, else above right, else two above; left that to the
    left, else above left, else two to the left; a skipped block and a place outside count as -1.
    With groups (cid, group) of the codewords the values are groups, without them labels."""
    if groups is not None:
        df = df.join(F.broadcast(groups.select(F.col("cid").alias(label), F.col("group").alias("_g"))), label, "left")
    value = F.when(F.col(coded), F.col("_g" if groups is not None else label)).cast("int")
    known = neighbours(df.withColumn("_v", value), "_v")
    up, left = F.coalesce("n", "ne", "nn", F.lit(-1)), F.coalesce("w", "nw", "ww", F.lit(-1))
    return known.withColumn("ctx", F.concat_ws("~", up.cast("string"), left.cast("string"))).drop("_v", "_g", "n", "nw", "ne", "w", "nn", "ww")


CODEWORD_GROUPS = 31


def codeword_groups(codebook: DataFrame, n: int = CODEWORD_GROUPS, rounds: int = 300) -> DataFrame:
    """(cid, group): the codewords clustered into at most n groups, so that contexts stay few.

    A codebook is bounded, so its k-means is small; groups are numbered by falling frequency."""
    from blockloom.operators import cluster

    words = codebook.select("cid", F.col("centroid").alias("vec"))
    centres = cluster.fit_codebook(words, n, "cid", rounds=rounds)
    return cluster.assign(words, centres).select("cid", F.col("label").alias("group"))


def mask_contexts(df: DataFrame, mask: str = "coded", border_aware: bool = False, parent: str | None = None) -> DataFrame:
    """Adds ctx of the neighbours nw, n, ne, w of a mask: 0 outside the grid, or codes by edge."""
    known = neighbours(df.withColumn("_m", F.col(mask).cast("int")), "_m")
    if border_aware:
        last = F.max("bj").over(Window.partitionBy("frame_id"))
        top, left, right = F.col("bi") == 0, F.col("bj") == 0, F.col("bj") == last
        codes = {
            "nw": F.when(top & left, BORDER_TOP_LEFT).when(top, BORDER_TOP).when(left, BORDER_LEFT).otherwise(F.col("nw")),
            "n": F.when(top, BORDER_TOP).otherwise(F.col("n")),
            "ne": F.when(top & right, BORDER_TOP_RIGHT).when(top, BORDER_TOP).when(right, BORDER_RIGHT).otherwise(F.col("ne")),
            "w": F.when(left, BORDER_LEFT).otherwise(F.col("w")),
        }
    else:
        codes = {k: F.coalesce(k, F.lit(0)) for k in ("nw", "n", "ne", "w")}
    parts = [F.col(parent).cast("int").cast("string")] if parent else []
    ctx = F.concat_ws("~", *parts, *[codes[k].cast("string") for k in ("nw", "n", "ne", "w")])
    return known.withColumn("ctx", ctx).drop("_m", "n", "nw", "ne", "w", "nn", "ww")


def context_histogram(df: DataFrame, symbols: int, symbol: str = "label") -> DataFrame:
    """(ctx, symbol, n): counts that start at one for every symbol of a context that occurs."""
    counts = df.groupBy("ctx", F.col(symbol).cast("int").alias("symbol")).agg(F.count("*").alias("k"))
    every = counts.select("ctx").distinct().withColumn("symbol", F.explode(F.sequence(F.lit(0), F.lit(symbols - 1))))
    return every.join(counts, ["ctx", "symbol"], "left").select("ctx", "symbol", (F.coalesce("k", F.lit(0)) + 1).cast("long").alias("n"))


def threshold_contexts(df: DataFrame, thresholds: list[float], groups: DataFrame | None = None) -> DataFrame:
    """(k, ctx, label) of the blocks coded at each threshold: contexts change with the mask.

    Neighbours come from one windowed scan, as pairs of value and dmse; each row then says its own
    context at every threshold it passes, so thresholds cost no further shuffle."""
    if groups is not None:
        df = df.join(F.broadcast(groups.select(F.col("cid").alias("label"), F.col("group").alias("_g"))), "label", "left")
    value = F.struct(F.col("dmse").alias("d"), F.col("_g" if groups is not None else "label").cast("int").alias("v"))
    known = neighbours(df.withColumn("_v", value), "_v", F.lit(None))
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(th)).alias("th")) for k, th in enumerate(thresholds)])
    rows = known.withColumn("_s", F.explode(F.filter(steps, lambda s: F.col("dmse") > s["th"])))
    at = lambda *places: F.coalesce(*[F.when(F.col(f"{p}.d") > F.col("_s.th"), F.col(f"{p}.v")) for p in places], F.lit(-1)).cast("string")
    return rows.select(F.col("_s.k").alias("k"), F.concat_ws("~", at("n", "ne", "nn"), at("w", "nw", "ww")).alias("ctx"), F.col("label").cast("int").alias("label"))


def threshold_histogram(df: DataFrame, symbols: int, thresholds: list[float], groups: DataFrame | None = None) -> DataFrame:
    """The context histogram accumulated over skip thresholds."""
    return context_histogram(threshold_contexts(df, thresholds, groups), symbols)


def mpm_modes(df: DataFrame, init: tuple[int, int, int] = (0, 1, 2), label: str = "label") -> DataFrame:
    """Adds mode of each label: 0..2 if it is in the sorted list of its likely labels, else 3, and rank
    among the labels that are not.

    The list starts as init; the labels nw, n, w that are not in it yet replace its places 2, 1, 0."""
    known = neighbours(df, label, F.lit(init[0]))
    start = F.array(*[F.lit(x) for x in init])

    def put(state: Column, x: Column) -> Column:
        new = F.transform(state["l"], lambda v, i: F.when(i == state["at"], x).otherwise(v))
        return F.when(F.array_contains(state["l"], x), state).otherwise(F.struct(new.alias("l"), (state["at"] - 1).alias("at")))

    state = F.aggregate(F.array(*[F.col(c).cast("int") for c in ("nw", "n", "w")]), F.struct(start.alias("l"), F.lit(2).alias("at")), put)
    listed = known.withColumn("_l", F.array_sort(state["l"]))
    at = F.array_position("_l", F.col(label).cast("int")).cast("int")
    mode = F.when(at > 0, at - 1).otherwise(F.lit(3))
    below = F.size(F.filter("_l", lambda v: v < F.col(label)))
    return listed.withColumns({"mode": mode.cast("int"), "rank": F.when(at > 0, at - 1).otherwise(F.col(label) - below).cast("int")}).drop("_l", "n", "nw", "ne", "w", "nn", "ww")


def mpm_bits(df: DataFrame, codewords: int, init: tuple[int, int, int] = (0, 1, 2)) -> DataFrame:
    """(frame_id, bits): two bits a label, and the index bits of those outside the list."""
    length = int(codewords - 4).bit_length()
    return mpm_modes(df, init).groupBy("frame_id").agg(F.sum(2 + F.when(F.col("mode") == 3, length).otherwise(0)).alias("bits"))


def predicted_mode_bits(df: DataFrame, codewords: int, probabilities: str, label: str = "label", scheme: str = "hit") -> DataFrame:
    """(frame_id, bits) when a classifier proposes labels from their neighbours.

    hit: one bit, and the index if the likeliest is wrong.  top3: two bits, and the index if none of
    three is right.  escape: one bit for the likeliest, else two more for the next ones or the index."""
    length = int(codewords - 1).bit_length()
    pairs = F.transform(F.col(probabilities), lambda p, i: F.struct((-p).alias("p"), i.alias("i")))
    top = F.transform(F.slice(F.array_sort(pairs), 1, 3), lambda s: s["i"])
    at = F.array_position(top, F.col(label).cast("int"))
    bits = {"hit": 1 + F.when(at == 1, 0).otherwise(length), "top3": 2 + F.when(at > 0, 0).otherwise(length), "escape": F.when(at == 1, 1).when(at > 0, 3).otherwise(3 + length)}[scheme]
    return df.groupBy("frame_id").agg(F.sum(bits).alias("bits"))


def fit_label_predictor(df: DataFrame, label: str = "label", init: int = 0, trees: int = 20, seed: int = 1) -> DataFrame:
    """df with probabilities of each label from its four causal neighbours, by a random forest over
    classes 0 up to the largest label (classes that never occur get probability 0)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = neighbours(df, label, F.lit(init)).withColumn("_y", F.col(label).cast("double"))
    rows = VectorAssembler(inputCols=["nw", "n", "w", "ne"], outputCol="_x").transform(known)
    model = RandomForestClassifier(featuresCol="_x", labelCol="_y", probabilityCol="_p", rawPredictionCol="_r", predictionCol="predicted", numTrees=trees, seed=seed).fit(rows)
    return model.transform(rows).withColumn("probabilities", vector_to_array("_p")).drop("_x", "_y", "_p", "_r", "nw", "n", "w", "ne", "nn", "ww")
