"""Invariants of operators and round trips of coders."""

import random

import numpy as np
import pytest

from blockloom.functions import color, entropy, metrics
from blockloom.operators import aggregates, cluster, context, layout, linear, resample
from blockloom.plans import decode_cost, rd, vq
from blockloom.schema import LevelConfig, ResolutionConfig, load_config
from blockloom.sources import images


def picture(seed: int, size: int, c: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:size, 0:size]
    return np.clip(128 + 60 * np.sin(x / 3 + seed)[:, :, None] + 40 * np.cos(y / 5)[:, :, None] + rng.normal(0, 6, (size, size, c)), 0, 255).astype(np.float32)


@pytest.fixture(scope="module")
def frames(spark):
    return vq.frames_from_arrays(spark, {i: picture(i, 16) for i in range(6)}).cache()


def test_unfold_orders_channels_first(spark):
    x = np.arange(4 * 4 * 2, dtype=np.float32).reshape(4, 4, 2)
    frames = vq.frames_from_arrays(spark, {1: x})
    got = {(r.bi, r.bj): r.vec for r in layout.unfold(frames, 2).collect()}
    assert got[0, 1] == [*x[:2, 2:, 0].ravel(), *x[:2, 2:, 1].ravel()]
    assert layout.fold(layout.unfold(frames, 2), 2, 4, 4, 2).first().data == x.ravel().tolist()
    assert np.array_equal(linear.ungrid(linear.grid(x, 2), 2), x)


def test_batches_keep_the_tail(spark):
    got = layout.batch_ids(spark.range(10).repartition(3), "id", 4).orderBy("id").collect()
    assert [r.batch for r in got] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_crops(frames):
    got = layout.crops(frames, 8, 4)
    assert got.count() == 6 * 9 and {len(r.data) for r in got.collect()} == {64}


@pytest.mark.parametrize("kind", ["nearest", "bilinear", "bicubic", "lanczos"])
def test_resampling(kind):
    for n, m in ((16, 8), (8, 16), (16, 4)):
        w = resample.weights(n, m, kind)
        assert np.allclose(w.sum(1), 1)
    assert (resample.resize_array(np.full((8, 8, 1), 9.0), 4, 4, kind) == 9).all()


def test_pyramid_is_exact(frames):
    low, rest = resample.pyramid_split(frames)
    back = resample.pyramid_join(low, rest)
    assert metrics.frame_errors(frames, back).agg({"mse": "max"}).first()[0] < 1e-6
    assert sorted(r.res for r in resample.pyramid(frames, [4, 8, 16]).select("res").distinct().collect()) == [4, 8, 16]


def test_channel_transform_keeps_energy(frames):
    fitted = linear.channel_fit(frames, (2, 2, 2), 1)
    coeffs = linear.channel_transform(frames, fitted)
    back = linear.channel_inverse(coeffs, fitted)
    assert metrics.frame_errors(frames, back).agg({"mse": "max"}).first()[0] < 1e-6
    energy = sum(float(np.square(r.vec).sum()) for r in coeffs.collect())
    assert abs(energy / sum(float(np.square(r.data).sum()) for r in frames.collect()) - 1) < 1e-6
    assert linear.per_frame_channel_transform(frames, (2, 2), 1).count() == 6 * (64 + 16)


def test_planes_round_trip(spark):
    colours = vq.frames_from_arrays(spark, {i: picture(i, 8, 3) for i in range(3)})
    parts, side = vq.planes(colours)
    back = vq.join_planes(parts, side)
    assert metrics.frame_errors(colours, back).agg({"mse": "max"}).first()[0] < 3  # the kernels are quantised


def test_coded_planes(spark):
    colours = vq.frames_from_arrays(spark, {i: picture(i, 8, 3) for i in range(4)})
    config = ResolutionConfig(8, (2,), 0, 1e3, (LevelConfig((8,), (-1,)),))
    back, choices = vq.encode_planes(colours, vq.fit_planes(colours, [config] * 3, rounds=3))
    assert len(choices) == 3 and metrics.quality(colours, back).first().mse < 2_500


def test_resolutions(frames):
    configs = [ResolutionConfig(n, (2,), 0, 1e3, (LevelConfig((8,), (-1,)),)) for n in (8, 16)]
    back, choices = vq.encode_resolutions(frames, vq.fit_resolutions(frames, configs))
    assert [c["resolution"] for c in choices] == [8, 16] and metrics.quality(frames, back).first().mse < 2_500


def test_color(spark):
    rows = spark.createDataFrame([(1, 0, j, float(10 * j), 20.0, 30.0) for j in range(4)] + [(1, 1, j, float(j), 2.0, 3.0) for j in range(4)], "frame_id int, i int, j int, y double, u double, v double")
    y, uv = color.to_420(rows)
    full = color.to_444(y, uv)
    assert full.count() == 8 and abs(full.agg({"u": "avg"}).first()[0] - 11) < 1e-9
    assert spark.range(1).select(color.clip(layout.F.lit(300.5)), color.clip(layout.F.lit(-3.2))).first()[:] == (255, 0)


def test_kmeans_error_never_rises(frames):
    blocks = layout.unfold(frames, 2).withColumn("key", layout.F.xxhash64("frame_id", "bi", "bj"))
    start = cluster.farthest_points(blocks, 6, "key")
    book, errors = cluster.kmeans(blocks, start)
    assert all(b <= a + 1e-6 for a, b in zip(errors, errors[1:])) and book.shape == (6, 4)
    far = np.full((1, 4), 1e9)
    kept, _ = cluster.kmeans(blocks, np.concatenate([start[:2], far]), rounds=2)
    assert (kept[2] == far[0]).all()
    assert len(cluster.fit_codebook(blocks.limit(3), 8, "key")) == 3
    assert cluster.fast_codebook(blocks, 4, rounds=3).shape == (4, 4)
    assert cluster.mixture_posterior(blocks, 2).count() == 384


def test_nearest_ties_go_to_the_lowest():
    label, d2 = cluster.nearest(np.array([[1.0, 1.0]]), np.array([[0.0, 1.0], [2.0, 1.0]]))
    assert label.tolist() == [0] and d2.tolist() == [1.0]


def test_huffman():
    rng = random.Random(1)
    for _ in range(50):
        counts = {s: rng.randint(1, 99) for s in range(rng.randint(1, 30))}
        coder = entropy.Huffman(counts)
        assert sum(2.0**-n for n in coder.lengths.values()) == (1.0 if len(counts) > 1 else 0.5)
        symbols = rng.choices(list(counts), k=40)
        assert coder.decode(coder.encode(symbols)) == symbols
    with pytest.raises(KeyError):
        coder.encode([999])


def test_range_coder():
    rng = random.Random(2)
    for _ in range(20):
        symbols = [min(9, int(rng.expovariate(0.6))) for _ in range(rng.randint(0, 300))]
        assert entropy.range_decode(entropy.range_encode(symbols, 10), 10) == symbols
        counts = [max(1, symbols.count(s)) for s in range(10)]
        stream = entropy.range_encode(symbols, 10, counts)
        assert entropy.range_decode(stream, 10, counts) == symbols and len(stream) % 8 == 0
    with pytest.raises(ValueError, match="no frequency"):
        entropy.range_encode([3], 4, [1, 1, 1, 0])


def test_bits_and_binary_coder():
    assert entropy.numbers_of(entropy.bits_of([3, 0, 7], 3), 3) == [3, 0, 7]
    assert entropy.unpack_bits(entropy.pack_bits("10110"), 5) == "10110"
    assert entropy.binary_bits([0] * 2_000) < 60 < entropy.binary_bits([i * i % 7 % 2 for i in range(200)])


def test_context_predictors(spark):
    rows = spark.createDataFrame([(f, i, j, (i + j) % 3) for f in range(3) for i in range(4) for j in range(4)], "frame_id int, bi int, bj int, label int")
    predicted = context.fit_label_predictor(rows, trees=5)
    assert aggregates.top_n_score(predicted, "label", "probabilities", 3).first().score == 1.0
    for scheme in ("hit", "top3", "escape"):
        assert context.predicted_mode_bits(predicted, 3, "probabilities", scheme=scheme).count() == 3
    assert aggregates.accuracy(predicted, "label", "predicted").first().accuracy > 0.6


def test_fit_encode_and_save(frames, tmp_path):
    config = ResolutionConfig(16, (2, 2), 0, 3e4, (LevelConfig((8,), (-1,)), LevelConfig((8, 8), (2, -1))))
    model = vq.fit(frames, config, rounds=5)
    coded, choices = vq.encode(frames, model, real_mask=True)
    back = vq.reconstruct(coded, model, 16, 16)
    silent = frames.withColumn("data", layout.F.transform("data", lambda x: x * 0))
    assert metrics.quality(frames, back).first().mse < 0.3 * metrics.quality(frames, silent).first().mse
    assert len(choices) == 3 and all(c["mask_bits"] >= 0 for c in choices) and choices[2]["bits_so_far"] >= choices[1]["bits_so_far"]
    path = str(tmp_path / "model.json")
    model.save(path)
    assert [s.thresholds for s in vq.Model.load(path, config).stages] == [s.thresholds for s in model.stages]
    model.stages.pop()
    model.save(path)
    assert len(vq.fit(frames, config, rounds=5, path=path).stages) == 3
    assert len(vq.encode(frames, model, skip=frozenset({(1, 0)}))[1]) == 1


def test_plain_and_spatial(frames):
    model = vq.fit_plain(frames, 4, (4,), 1e4)
    coded, choices = vq.encode(frames, model)
    assert metrics.quality(frames, vq.reconstruct(coded, model, 16, 16)).first().mse < 9_000 and len(choices) == 1
    rest, books = vq.spatial_stages(frames, (4, 2), 3, (10.0, 1.0))
    assert len(books) == 2 and metrics.quality(frames, rest).first().mse > 0


def test_rd_rules(spark):
    grid = rd.threshold_grid(spark.createDataFrame([(1024.0,)], "max_dmse double")).orderBy("k").collect()
    assert grid[0].th == 1.0 and len(grid) == 80 and abs(grid[40].th - 32.0) < 0.01
    costs = spark.createDataFrame([(0, 5.0), (1, 3.0), (2, 3.0), (3, 1.0)], "k int, cost double")
    assert [r.k for r in rd.early_stop(costs).orderBy("k").collect()] == [0, 1, 2]
    assert rd.best(costs).first().k == 3


def test_metrics():
    a = picture(1, 64)
    assert abs(metrics.ms_ssim_pair(a, a) - 1) < 1e-9 and metrics.ssim_pair(a, 255 - a, 11)[0] < 0.5
    r, p = [0.1, 0.2, 0.4, 0.8], [30.0, 33.0, 36.0, 38.0]
    assert abs(metrics.bd_rate(r, p, [x / 2 for x in r], p) + 50) < 1e-6
    assert abs(metrics.bd_psnr(r, p, r, [x + 1 for x in p]) - 1) < 1e-9
    assert abs(metrics.bd_rate(r, p, [x / 2 for x in r], p, piecewise=True) + 50) < 1e-6
    assert metrics.hull([(0, 0), (1, 2), (2, 0), (1, 0.5)]) == [(1, 2), (2, 0)]


def test_sources(spark, tmp_path, frames):
    (tmp_path / "img").mkdir()
    x = (picture(3, 8, 3)).astype(np.uint8)
    (tmp_path / "img/a.ppm").write_bytes(b"P6\n8 8\n255\n" + x[:, :, ::-1].tobytes())
    (tmp_path / "img/b.ppm").write_bytes(b"P6\n8 8\n255\nshort")
    np.save(tmp_path / "img/c.npy", x[:, :, ::-1])
    got = images.read_images(spark, str(tmp_path / "img")).collect()
    assert len(got) == 2 and all(r.data == x.astype(float).ravel().tolist() for r in got)
    assert images.read_images(spark, str(tmp_path / "img"), limit=2, seed=3).count() >= 1
    assert images.read_images(spark, str(tmp_path / "img"), names=["a.ppm"]).count() == 1
    images.write_frames(frames, str(tmp_path / "frames"), per_file=4)
    assert images.read_frames(spark, str(tmp_path / "frames"), 16).count() == 6
    back = images.from_raw(images.to_raw(frames, "SHORT"), 16, 1)
    assert metrics.quality(back, frames).first().mad <= 0.5
    raw = images.to_raw(frames, "UCHAR", 0).orderBy("frame_id").first().raw
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/0.data").write_bytes(bytes(raw) * 3)
    assert images.read_raw(spark, str(tmp_path / "raw"), 16, 1, "UCHAR").count() == 3
    book = np.zeros((2, 16), "<i2")
    book[:, :12] = 7
    state = bytes((8 + 4) * 16 + 16) + book.tobytes()
    assert (images.parse_codebook(state, 2, 2) == 7).all()
    assert images.list_files(spark, str(tmp_path / "img"), "*.ppm").count() == 2
    assert images.patch_pyramid(frames, [4, 8], 8).count() == 6 * 4 * 2


def test_streamed_encoding(spark, frames, tmp_path):
    from blockloom.streaming.encode import encode_stream, stream_frames

    frames.write.parquet(str(tmp_path / "in"))
    book = np.array([[0.0] * 4, [128.0] * 4, [200.0] * 4])
    query = encode_stream(stream_frames(spark, str(tmp_path / "in")), book, 2, 1.0, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6 * 64


def test_config_and_cost(tmp_path):
    (tmp_path / "c.json").write_text('{"resolution_list": [8], "8": {"id": 8, "level_list": [8, 4], "win_list": [2, 2], "transform_split": 1, "Lagrange_multip": 3, "n_cluster_list-8": [8], "n_dim_list-8": [2], "n_cluster_list-4": [8, 9], "n_dim_list-4": [3, -1]}}')
    config = load_config(str(tmp_path / "c.json"))[0]
    assert config.levels[1].clusters == (8, 9) and config.windows == (2, 2)
    cost = decode_cost.decode_cost({8: [2, 2], 16: [4]})
    assert cost.value == 16 * 4 * 7 + 4 * 4 * 7 + 16 * 16 * 31 + 80 * 256 and "80" in cost.text


def test_overlap_and_distinct_shapes(frames):
    blocks = layout.unfold_overlapping(frames, 4, 2, "symmetric")
    assert {len(r.vec) for r in blocks.collect()} == {64}
    assert layout.same_shape(frames, 16, 16, 1).count() == 6
    with pytest.raises(Exception, match="must have 5 values"):
        from blockloom.schema import check_dim

        check_dim(layout.unfold(frames, 2), "vec", 5).collect()


def test_bd_table_refuses_a_longer_anchor(spark):
    points = spark.range(10_001).selectExpr("'main' AS model", "(id + 1) / 1000 AS bpp", "1000 / (id + 1) AS mse")
    with pytest.raises(ValueError, match="more than 10000 points"):
        metrics.bd_table(points, "main")


def test_context_coders_never_cost_more(frames, tmp_path):
    blocks = layout.unfold(frames, 2)
    stage = vq.fit_stage(blocks, 0, 0, 6, -1, 1e4, 6, rounds=5, context_coder=True)
    assert len(stage.coders) == len(stage.codebooks) and all(len(set(c.groups)) <= context.CODEWORD_GROUPS for c in stage.coders)
    plain = vq.Stage(stage.level, stage.position, stage.dims, stage.codebooks, stage.thresholds)
    with_coder, without = (vq.encode_stage(blocks, s, 1e4, 6)[1] for s in (stage, plain))
    assert with_coder["cost"] <= without["cost"] + 1e-9
    config = ResolutionConfig(16, (2,), 0, 1e4)
    vq.Model(config, None, [stage]).save(str(tmp_path / "model.json"))
    back = vq.Model.load(str(tmp_path / "model.json"), config).stages[0]
    assert back.coders == stage.coders and back.thresholds == stage.thresholds


def test_real_mask_bits_enter_the_choice(frames):
    blocks = layout.unfold(frames, 4)
    book = cluster.fit_codebook(blocks.withColumn("key", blocks.frame_id * 100 + blocks.bi * 10 + blocks.bj), 4, "key", rounds=3)
    quantised = vq.quantise(blocks, book, -1)
    grid = rd.rd_grid(quantised, 4, 6, 1e5, 3).orderBy("k").collect()
    ths = [r.th for r in grid]
    mask = {r.k: r.bits for r in vq.mask_bits_by_threshold(quantised, ths).collect()}
    real = rd.rd_grid(quantised, 4, 6, 1e5, 3, real_mask_bits=vq.mask_bits_by_threshold(quantised, ths)).orderBy("k").collect()
    one = layout.skip_mask(quantised, ths[5])
    assert mask[5] == entropy.mask_stream_bits(context.mask_contexts(one, border_aware=True)).first().bits
    n = quantised.count()
    for a, b in zip(grid, real):
        p = a.coded / n
        h = 0 if p in (0, 1) else -p * np.log2(p) - (1 - p) * np.log2(1 - p)
        assert abs((b.r - a.r) * 6 - (mask[a.k] - (int(h * n) + 1))) < 1e-6


def test_nearest_agrees_with_squared_differences():
    rng = np.random.default_rng(5)
    for scale, shift in ((1, 0), (1e-3, 1e3), (1, 1e6)):
        book = rng.normal(shift, scale, (40, 8))
        book[7] = book[3]
        x = np.concatenate([rng.normal(shift, scale, (300, 8)), book, (book[:1] + book[1:2]) / 2])
        label, d2 = cluster.nearest(x, book)
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (d[np.arange(len(x)), label] == d.min(1)).all() and (d2 == d.min(1)).all() and 7 not in label
