"""Vector quantisation of frames with rate-distortion choice: fit, encode, decode.

A stage is (level, position, list of codebooks); what it codes is taken away and the next stage sees
the rest.  Stages run from the coarsest level to the finest, resolutions from the smallest up.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions import entropy
from blockloom.operators import aggregates, cluster, context, layout, linear, resample
from blockloom.plans import rd
from blockloom.schema import FRAMES, ResolutionConfig, saved


@dataclass(frozen=True)
class LabelCoder:
    """A code for each context of codeword groups: the group of each codeword, and by context the code
    lengths of all labels (bounded by the contexts of at most 31 groups)."""

    groups: tuple[int, ...]
    lengths: dict[str, tuple[int, ...]]

    @classmethod
    def fit(cls, quantised: DataFrame, codebook: np.ndarray, thresholds: list[float]) -> LabelCoder:
        groups = context.codeword_groups(cluster.codebook_frame(quantised, codebook))
        codes = entropy.context_code_lengths(context.threshold_histogram(quantised, len(codebook), thresholds, groups))
        by_context = codes.groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct("symbol", "length"))).alias("ls"))
        return cls(tuple(r.group for r in groups.orderBy("cid").collect()), {r.ctx: tuple(x.length for x in r.ls) for r in by_context.collect()})

    def bits(self, quantised: DataFrame, thresholds: list[float]) -> DataFrame:
        """(k, bits) of the labels coded at each threshold; an unseen context has a flat code."""
        spark = quantised.sparkSession
        groups = spark.createDataFrame(list(enumerate(self.groups)), "cid int, group int")
        codes = spark.createDataFrame([(c, s, n) for c, ns in self.lengths.items() for s, n in enumerate(ns)], "ctx string, symbol int, length int")
        counts = context.threshold_contexts(quantised, thresholds, groups).groupBy("k", "ctx", F.col("label").alias("symbol")).agg(F.count("*").alias("n"))
        flat = max(1, (len(self.groups) - 1).bit_length())
        return counts.join(F.broadcast(codes), ["ctx", "symbol"], "left").groupBy("k").agg(F.sum(F.col("n") * F.coalesce("length", F.lit(flat))).alias("bits"))


def mask_bits_by_threshold(quantised: DataFrame, thresholds: list[float]) -> DataFrame:
    """(k, bits) of each threshold's mask under the adaptive binary coder: for few frames, as every
    threshold is a mask of its own."""
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(th)).alias("th")) for k, th in enumerate(thresholds)])
    rows = quantised.select("frame_id", "bi", "bj", "dmse", F.explode(steps).alias("s"))
    rows = rows.select((F.col("frame_id") * len(thresholds) + F.col("s.k")).alias("frame_id"), F.col("s.k").alias("k"), "bi", "bj", (F.col("dmse") > F.col("s.th")).alias("coded"))
    return entropy.mask_stream_bits(context.mask_contexts(rows, "coded", border_aware=True), by=["k"])


@dataclass(frozen=True)
class Stage:
    level: int
    position: int
    dims: int
    codebooks: tuple[np.ndarray, ...]
    thresholds: tuple[float, ...]
    coders: tuple[LabelCoder, ...] = ()
    """One for each codebook, or none: then labels cost what their Huffman code takes."""


def _file(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A path's file system, which may be any that pyarrow knows, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _exists(path: str) -> bool:
    fs, at = _file(path)
    return fs.get_file_info(at).type == pyarrow.fs.FileType.File


@dataclass
class Model:
    config: ResolutionConfig
    transform: linear.ChannelTransform | None
    stages: list[Stage] = field(default_factory=list)

    def save(self, path: str) -> None:
        kernels = [[[k.matrix.tolist(), k.variances.tolist(), k.mean.tolist()] for k in level] for level in self.transform.kernels] if self.transform else None
        stages = [[s.level, s.position, s.dims, [b.tolist() for b in s.codebooks], list(s.thresholds), [[c.groups, c.lengths] for c in s.coders]] for s in self.stages]
        fs, at = _file(path)
        with fs.open_output_stream(at) as f:
            f.write(json.dumps({"kernels": kernels, "stages": stages, "channels": self.transform.channels if self.transform else None}).encode())

    @classmethod
    def load(cls, path: str, config: ResolutionConfig) -> Model:
        fs, at = _file(path)
        with fs.open_input_stream(at) as f:
            raw = json.loads(f.read())
        kernels = raw["kernels"] and tuple(tuple(linear.Kernel(*(np.array(x) for x in k)) for k in level) for level in raw["kernels"])
        transform = linear.ChannelTransform(config.windows, config.transform_split, kernels, raw["channels"]) if kernels else None
        return cls(config, transform, [Stage(a, b, c, tuple(np.array(x) for x in d), tuple(e), tuple(LabelCoder(tuple(g), {k: tuple(v) for k, v in ls.items()}) for g, ls in coders)) for a, b, c, d, e, coders in raw["stages"]])


def quantise(blocks: DataFrame, codebook: np.ndarray, dims: int, th: float | None = None, area: int | None = None) -> DataFrame:
    """Blocks with label, ivec, mse, omse, dmse and coded: nearest codeword, decoded and masked."""
    n = codebook.shape[1]
    labelled = cluster.assign(blocks.drop("label", "d2"), codebook, "vec", n if dims < 0 else min(dims, n))
    decoded = cluster.decode(labelled, cluster.codebook_frame(blocks, codebook))
    width = F.size("vec")
    wide = decoded.withColumn("ivec", F.concat("ivec", F.array_repeat(F.lit(0.0), width - n)))
    out = layout.distortions(wide, area=area)
    return layout.skip_mask(out, -1.0 if th is None else th)


def fit_stage(blocks: DataFrame, level: int, position: int, k: int, dims: int, lagrange: float, frames: int, rule: rd.RdRule = rd.SPATIAL, sizes=aggregates.doubling_prefixes, rounds: int = 300, area: int | None = None, context_coder: bool = False) -> Stage:
    """A codebook of k words, its nested prefixes by gain, and each one's best skip threshold.

    While fitting, labels cost their Huffman code; context_coder fits the context coders for encoding."""
    short = blocks.withColumn("vec", layout.prefix("vec", dims)).withColumn("_key", F.xxhash64("frame_id", "bi", "bj")).persist()
    full = cluster.fit_codebook(short, k, "_key", rounds=rounds)
    short.unpersist()
    labelled = quantise(blocks, full, dims, area=area)
    ranks = [r.cid for r in aggregates.gain_rank(labelled, len(full)).orderBy("rank").collect()]  # k rows
    books = [full[ranks[:n]] for n in sizes(len(full)) if n < len(full)] + [full]
    thresholds, coders = [], []
    for book in books:
        quantised = quantise(blocks, book, dims, area=area).persist()
        grid = rd.rd_grid(quantised, len(book), frames, lagrange, level, rule).persist()
        thresholds.append(float(rd.best(grid).first().th))
        if context_coder:
            coders.append(LabelCoder.fit(quantised, book, [r.th for r in grid.orderBy("k").collect()]))
        grid.unpersist()
        quantised.unpersist()
    return Stage(level, position, dims, tuple(books), tuple(thresholds), tuple(coders))


def encode_stage(blocks: DataFrame, stage: Stage, lagrange: float, frames: int, rule: rd.RdRule = rd.SPATIAL, real_mask: bool = False, area: int | None = None) -> tuple[DataFrame, dict]:
    """The cheapest codebook and threshold for these blocks: coded blocks and what the choice costs.

    Labels cost the lesser of their context coder, if the stage has one, and their Huffman code;
    real_mask (for few frames) takes each threshold's mask under the adaptive binary coder for the
    estimate, in the choice as in r."""
    best, chosen, held = None, None, None
    for number, book in enumerate(stage.codebooks):
        quantised = quantise(blocks, book, stage.dims, area=area).persist()
        ths = [r.th for r in rd.threshold_grid(quantised.agg(F.max("dmse").alias("max_dmse")), rule).orderBy("k").collect()] if stage.coders or real_mask else []
        given = {"context_bits": stage.coders[number].bits(quantised, ths) if stage.coders else None, "real_mask_bits": mask_bits_by_threshold(quantised, ths) if real_mask else None}
        top = rd.best(rd.rd_grid(quantised, len(book), frames, lagrange, stage.level, rule, **given)).first()
        if best is None or top.cost < best["cost"]:
            if best:
                held.unpersist()
            best, chosen, held = {"codebook": number, **top.asDict()}, layout.skip_mask(quantised, top.th), quantised
        else:
            quantised.unpersist()
    if real_mask:
        masked = context.mask_contexts(chosen, "coded", border_aware=True)
        best["mask_bits"] = entropy.mask_stream_bits(masked).first().bits
    return layout.zero_skipped(chosen), best


def rest_of(coded: DataFrame) -> DataFrame:
    """What a stage leaves: the blocks less what it coded."""
    return coded.select("frame_id", "bi", "bj", layout.residual(F.col("vec"), F.col("ivec")).alias("vec"))


def fit_plain(frames: DataFrame, win: int, k: tuple[int, ...], lagrange: float, level: int = 3) -> Model:
    """Without a transform: blocks of the frames themselves, stage after stage on what is left."""
    n = frames.count()
    blocks = layout.unfold(frames, win)
    config = ResolutionConfig(0, (win,), 0, lagrange)
    model = Model(config, None)
    for position, size in enumerate(k):
        blocks = saved(blocks, "stage-blocks")
        stage = fit_stage(blocks, level, position, size, -1, lagrange, n, rd.PLAIN, aggregates.fixed_prefixes)
        model.stages.append(stage)
        blocks = rest_of(encode_stage(blocks, stage, lagrange, n, rd.PLAIN)[0])
    return model


def area_of(config: ResolutionConfig, level: int, channels: int) -> int:
    """Values of the frame that one block of a level stands for."""
    return int(np.prod(config.windows[: level + 1])) ** 2 * channels


def fit(frames: DataFrame, config: ResolutionConfig, rounds: int = 300, path: str | None = None, context_coder: bool = False) -> Model:
    """With channel-wise transforms: levels from the coarsest, each with its positions in turn.

    With a path the model is saved there after every stage, and stages found there are not fitted again."""
    n = frames.count()
    model = Model.load(path, config) if path and _exists(path) else Model(config, linear.channel_fit(frames, config.windows, config.transform_split))
    known = {(s.level, s.position): s for s in model.stages}
    coeffs = linear.channel_transform(frames, model.transform)
    for level in range(len(config.windows) - 1, -1, -1):
        area = area_of(config, level, model.transform.channels)
        blocks = coeffs.where(F.col("level") == level).drop("level")
        for position, (k, dims) in enumerate(zip(config.levels[level].clusters, config.levels[level].dims)):
            blocks = saved(blocks, "stage-blocks")  # every round of the stage reads them, and no earlier stage runs again
            stage = known.get((level, position))
            if stage is None:
                stage = fit_stage(blocks, level, position, k, dims, config.lagrange, n, rounds=rounds, area=area, context_coder=context_coder)
                model.stages.append(stage)
                if path:
                    model.save(path)
            blocks = rest_of(encode_stage(blocks, stage, config.lagrange, n, area=area)[0])
    return model


def encode(frames: DataFrame, model: Model, real_mask: bool = False, skip: frozenset[tuple[int, int]] = frozenset()) -> tuple[DataFrame, list[dict]]:
    """(frame_id, level, bi, bj, vec) of what all stages coded, summed, and each stage's choice with
    the bits so far.  Stages named in skip as (level, position) code nothing."""
    n = frames.count()
    coeffs = linear.channel_transform(frames, model.transform) if model.transform else layout.unfold(frames, model.config.windows[0]).withColumn("level", F.lit(0))
    decoded, choices, rule, bits = None, [], rd.SPATIAL if model.transform else rd.PLAIN, 0.0
    for level in sorted({s.level for s in model.stages}, reverse=True):
        blocks = coeffs.where(F.col("level") == level).drop("level") if model.transform else coeffs.drop("level")
        area = area_of(model.config, level, model.transform.channels) if model.transform else None
        whole = blocks
        for stage in (s for s in model.stages if s.level == level and (level, s.position) not in skip):
            coded, choice = encode_stage(blocks, stage, model.config.lagrange, n, rule, real_mask, area)
            bits += choice["r"]
            choices.append({"level": level, "position": stage.position, **choice, "bits_so_far": bits})
            blocks = saved(rest_of(coded), "stage-rest")
        left = blocks.withColumnRenamed("vec", "rest")
        part = whole.join(left, ["frame_id", "bi", "bj"]).select("frame_id", F.lit(level if model.transform else 0).alias("level"), "bi", "bj", F.zip_with("vec", "rest", lambda a, b: a - b).alias("vec"))
        decoded = part if decoded is None else decoded.unionByName(part)
    return decoded, choices


def reconstruct(coded: DataFrame, model: Model, h: int, w: int, c: int = 1) -> DataFrame:
    if model.transform:
        return linear.channel_inverse(coded, model.transform)
    return layout.fold(coded, model.config.windows[0], h, w, c)


def fit_resolutions(frames: DataFrame, configs: list[ResolutionConfig]) -> dict[int, Model]:
    """One model per resolution; each after the first sees what the ones before could not say."""
    models: dict[int, Model] = {}
    ordered = sorted(configs, key=lambda c: c.resolution)
    data, before = resample.resize_to(frames, ordered[0].resolution), None
    shift = lambda d, by: d.withColumn("data", F.transform("data", lambda x: (x + by).cast("float")))
    data = shift(data, -128.0)
    for config, after in pairwise([*ordered, None]):
        model = fit(data, config)
        models[config.resolution] = model
        if after is None:
            break
        coded, _ = encode(data, model)
        made = reconstruct(coded, model, config.resolution, config.resolution)
        base = made if before is None else _add(made, resample.resize_to(before, config.resolution))
        before = base
        fine = shift(resample.resize_to(frames, after.resolution), -128.0)
        data = _add(fine, resample.resize_to(base, after.resolution), -1.0)
    return models


def encode_resolutions(frames: DataFrame, models: dict[int, Model]) -> tuple[DataFrame, list[dict]]:
    """The reconstruction at the largest resolution, and every stage's choice with running bits."""
    shift = lambda d, by: d.withColumn("data", F.transform("data", lambda x: (x + by).cast("float")))
    base, choices, bits = None, [], 0.0
    for resolution in sorted(models):
        model = models[resolution]
        data = shift(resample.resize_to(frames, resolution), -128.0)
        up = None if base is None else resample.resize_to(base, resolution)
        coded, made = encode(data if up is None else _add(data, up, -1.0), model)
        for c in made:
            bits += c["r"]
            choices.append({"resolution": resolution, **c, "bits_so_far": bits})
        out = reconstruct(coded, model, resolution, resolution)
        base = out if up is None else _add(out, up)
    return shift(base, 128.0), choices


def _add(a: DataFrame, b: DataFrame, sign: float = 1.0) -> DataFrame:
    side = b.select("frame_id", F.col("data").alias("_b"))
    return a.join(side, "frame_id").withColumn("data", F.zip_with("data", "_b", lambda x, y: (x + sign * y).cast("float"))).drop("_b").select("frame_id", "res", "h", "w", "c", "data")


def planes(frames: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Per-image colour components as one-channel frames less their rounded mean, and (frame_id,
    kernel, means) to undo it."""
    turned = linear.per_frame_pca(frames, quantise=True)
    c = turned.select("c").first()[0]
    out, means = [], []
    for k in range(c):
        data = F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda p: F.get(F.col("data"), p * c + k))  # noqa: B023
        one = turned.withColumn("data", data).withColumn("c", F.lit(1))
        mean = F.rint(F.aggregate("data", F.lit(0.0), lambda s, x: s + x) / F.size("data"))
        one = one.withColumn("mean", mean)
        means.append(one.select("frame_id", F.col("mean").alias(f"mean_{k}")))
        out.append(one.withColumn("data", F.transform("data", lambda x: (x - F.col("mean")).cast("float"))).select("frame_id", "res", "h", "w", "c", "data"))
    side = turned.select("frame_id", "kernel")
    for m in means:
        side = side.join(m, "frame_id")
    return out, side


def join_planes(parts: list[DataFrame], side: DataFrame) -> DataFrame:
    """Frames of all channels from their component planes."""
    joined = side
    for k, part in enumerate(parts):
        joined = joined.join(part.select("frame_id", *(["res", "h", "w"] if k == 0 else []), F.transform("data", lambda x: x).alias(f"p{k}")), "frame_id")
    n = len(parts)
    pick = F.array(*[F.struct(F.col(f"p{k}").alias("d"), F.col(f"mean_{k}").alias("m")) for k in range(n)])
    data = F.expr(f"transform(sequence(0, h * w * {n} - 1), p -> cast(_parts[p % {n}].d[p div {n}] + _parts[p % {n}].m as float))")
    whole = joined.withColumn("_parts", pick).withColumn("data", data).withColumn("c", F.lit(n)).select("frame_id", "res", "h", "w", "c", "data", "kernel")
    return linear.per_frame_pca(whole, inverse=True)


def fit_planes(frames: DataFrame, configs: list[ResolutionConfig], rounds: int = 300, path: str | None = None) -> list[Model]:
    """One model for each colour component of the frames, the strongest component first.

    With a path each model is saved at path.0, path.1, ... after every stage, and goes on from there."""
    parts, _ = planes(frames)
    return [fit(part, config, rounds, path and f"{path}.{k}") for k, (part, config) in enumerate(zip(parts, configs, strict=True))]


def encode_planes(frames: DataFrame, models: list[Model]) -> tuple[DataFrame, list[list[dict]]]:
    """Frames rebuilt from their coded colour components, and the choices of each component."""
    parts, side = planes(frames)
    size = frames.select("h", "w").first()
    back, choices = [], []
    for part, model in zip(parts, models, strict=True):
        coded, made = encode(part, model)
        back.append(reconstruct(coded, model, size.h, size.w))
        choices.append(made)
    return join_planes(back, side), choices


def spatial_stages(frames: DataFrame, windows: tuple[int, ...], k: int, thresholds: tuple[float, ...]) -> tuple[DataFrame, list[np.ndarray]]:
    """Fixed thresholds, from large blocks to small: each window's codebook on what is left over.

    Returns the frames of what remains and the codebooks."""
    rest, books = frames, []
    for win, th in zip(windows, thresholds):
        shape = rest.select("h", "w", "c").first()
        blocks = layout.unfold(rest, win).withColumn("_key", F.xxhash64("frame_id", "bi", "bj"))
        books.append(cluster.fit_codebook(blocks, k, "_key"))
        coded = layout.zero_skipped(quantise(blocks.drop("_key"), books[-1], -1, th))
        rest = layout.fold(rest_of(coded), win, shape.h, shape.w, shape.c)
    return rest, books


def frames_from_arrays(spark, images: dict[int, np.ndarray]) -> DataFrame:
    """Small sets of images as frames."""
    table = pa.Table.from_batches([layout.frame_batch(sorted(images.items()))])
    return spark.createDataFrame(table, FRAMES)
