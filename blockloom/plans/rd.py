"""Rate-distortion choice of skip thresholds and codebooks, the whole grid in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.entropy import huffman_bits

STEPS = 80


@dataclass(frozen=True)
class RdRule:
    """How bits become cost.  Fixed values: the defaults are the variants' constants.

    step: thresholds 0, step, 2 step, ... below TOP instead of powers of two; free_if_empty: nothing
    coded costs no bits."""

    growth: float = 1.3
    twice_per_frame: bool = True
    threshold_decimals: int = 2
    mask: str = "entropy"
    step: int = 0
    free_if_empty: bool = False


SPATIAL = RdRule()
PLAIN = RdRule(twice_per_frame=False, threshold_decimals=3, mask="linear")
STEPPED = RdRule(growth=1.1, twice_per_frame=False, mask="proportional", step=100, free_if_empty=True)
TOP = 80_000


def threshold_grid(max_dmse: DataFrame, rule: RdRule = SPATIAL) -> DataFrame:
    """Adds k and th: 2 ** (k log2(min(1e5, max(10, max_dmse))) / 80), rounded, for k = 0..79, or the
    rule's steps."""
    if rule.step:
        grid = max_dmse.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(TOP // rule.step - 1))))
        return grid.withColumn("th", (F.col("k") * rule.step).cast("double"))
    aa = F.log2(F.least(F.lit(1e5), F.greatest(F.lit(10.0), F.col("max_dmse")))) / STEPS
    scale = 10.0**rule.threshold_decimals
    grid = max_dmse.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))
    return grid.withColumn("th", F.rint(F.pow(F.lit(2.0), aa * F.col("k")) * scale) / scale)


def mask_bits(n: Column, coded: Column, rule: RdRule = SPATIAL) -> Column:
    """Estimated bits of a skip mask."""
    p = coded / n
    h = F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))
    if rule.mask == "linear":
        h = 5.5 * F.least(p, 1 - p) + 0.00276
    elif rule.mask == "proportional":
        h = 2.75 * p + 0.00276
    return F.floor(h * n) + 1


def ideal_label_bits(coded_counts: DataFrame, by: list[str]) -> DataFrame:
    """Ideal code length of coded labels under their own add-one counts."""
    n = coded_counts.withColumn("s", F.col("n") + 1)
    total = F.sum("s").over(Window.partitionBy(*by))
    return n.withColumn("b", -F.col("n") * F.log2(F.col("s") / total)).groupBy(*by).agg(F.sum("b").alias("label_bits"))


def rd_grid(
    blocks: DataFrame, k: int, frames: int, lagrange: float, level: int, rule: RdRule = SPATIAL, by: list[str] | None = None,
    labels: str = "huffman", context_bits: DataFrame | None = None, real_mask_bits: DataFrame | None = None,
) -> DataFrame:
    """(by, k, th, coded, r, d, cost) for all thresholds at once.

    Each block is counted in the highest threshold it passes; sums from the top down give every
    threshold's totals, so blocks are read once and not once a threshold.  Label bits are those of a
    Huffman code refitted at each threshold on the coded labels and one of every codeword, or (labels
    = ideal) the ideal length under those counts.  Where (by, k, bits) of a fitted context coder are
    given, the lesser counts, a stream of at most one bit aside; given bits of a coded mask (by, k,
    bits) stand in for the estimate."""
    by = by or []
    grid = threshold_grid(blocks.groupBy(*by).agg(F.max("dmse").alias("max_dmse")), rule).drop("max_dmse")
    ths = grid.groupBy(*by).agg(F.array_sort(F.collect_list("th")).alias("ths"))
    rows = blocks.join(F.broadcast(ths), by) if by else blocks.join(F.broadcast(ths))
    passed = rows.withColumn("k", F.size(F.filter("ths", lambda t: t < F.col("dmse"))) - 1)
    part = passed.groupBy(*by, "k", "label").agg(F.count("*").alias("n"), F.sum("mse").alias("mse"), F.sum("omse").alias("omse"))
    symbols = blocks.sparkSession.range(k).select(F.col("id").cast("int").alias("label"))
    cells = grid.join(F.broadcast(symbols)).join(part.where("k >= 0"), [*by, "k", "label"], "left").fillna(0, ["n", "mse", "omse"])
    down = Window.partitionBy(*by, "label").orderBy(F.desc("k"))
    cells = cells.withColumns({c: F.sum(c).over(down) for c in ("n", "mse", "omse")})
    total = part.groupBy(*by).agg(F.sum("n").alias("all_n"), F.sum("omse").alias("all_omse"))
    counts = cells.select(*by, "k", F.col("label").alias("symbol"), "n")
    spent = huffman_bits(counts, [*by, "k"], smooth=1).withColumnRenamed("bits", "label_bits") if labels == "huffman" else ideal_label_bits(counts, [*by, "k"])
    if context_bits is not None:
        spent = spent.join(context_bits.withColumnRenamed("bits", "_c"), [*by, "k"], "left")
        spent = spent.withColumn("label_bits", F.when(F.col("_c") > 1, F.least("label_bits", "_c")).otherwise(F.col("label_bits"))).drop("_c")
    sums = cells.groupBy(*by, "k", "th").agg(F.sum("n").alias("coded"), F.sum("mse").alias("m"), F.sum("omse").alias("o"))
    sums = sums.join(spent, [*by, "k"])
    sums = sums.join(F.broadcast(total), by) if by else sums.join(F.broadcast(total))
    mask = mask_bits(F.col("all_n"), F.col("coded"), rule)
    if real_mask_bits is not None:
        sums, mask = sums.join(real_mask_bits.withColumnRenamed("bits", "_m"), [*by, "k"], "left"), F.coalesce(F.col("_m"), mask)
    r = (mask + F.col("label_bits")) / frames
    r = F.when(F.col("coded") > 0, r).otherwise(F.lit(0.0)) if rule.free_if_empty else r
    out = sums.withColumn("r", r).withColumn("d", (F.col("m") + F.col("all_omse") - F.col("o")) / F.col("all_n"))
    return out.withColumn("cost", cost(F.col("d"), F.col("r"), frames, lagrange, level, rule)).select(*by, "k", "th", "coded", "r", "d", "cost")


def cost(d: Column, r: Column, frames: int, lagrange: float, level: int, rule: RdRule = SPATIAL) -> Column:
    per = frames if rule.twice_per_frame else 1
    return d + lagrange * r / per / 1024**2 * rule.growth ** (8 - level)


def best(grid: DataFrame, by: list[str] | None = None, among: str = "k") -> DataFrame:
    """The row of least cost, ties to the lowest number."""
    rest = [c for c in grid.columns if c not in (by or [])]
    return grid.groupBy(*(by or [])).agg(F.min(F.struct("cost", among, *[c for c in rest if c not in ("cost", among)])).alias("b")).select(*(by or []), "b.*")


def early_stop(grid: DataFrame, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """The rows a scan meets that ends at the first cost not below the one before it (strict: above it)."""
    over = Window.partitionBy(*(by or [])).orderBy("k")
    ends = F.col("cost") > F.col("_last") if strict else F.col("cost") >= F.col("_last")
    risen = F.max(F.coalesce(ends.cast("int"), F.lit(0))).over(over.rowsBetween(Window.unboundedPreceding, -1))
    return grid.withColumn("_last", F.lag("cost").over(over)).withColumn("_risen", F.coalesce(risen, F.lit(0))).where("_risen = 0").drop("_last", "_risen")


def stepped_search(blocks: DataFrame, k: int, frames: int, lagrange: float, level: int) -> DataFrame:
    """The best threshold among 0, 100, ... 79,900, as a scan finds it that ends when the cost rises:
    a Huffman code for each threshold, growth 1.1 a level."""
    return best(early_stop(rd_grid(blocks, k, frames, lagrange, level, STEPPED), strict=True))
