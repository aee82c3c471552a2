"""Hand-computed grids and NumPy cross-checks."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelrel import model
from pixelrel.functions import pixel, rng
from pixelrel.operators import crops, defects, degrade, inject, integral, mask, merging, metrics, numbering, quantiles, splits, stars, stencil, stretch
from pixelrel.plans import combos
from pixelrel.sources import codecs, files, ledger
from pixelrel.streaming import arrivals


def grid(spark, image, name="a"):
    image = np.asarray(image, float)
    image = image[..., None] if image.ndim == 2 else image
    return spark.createDataFrame([(name, y, x, c, float(image[y, x, c])) for y in range(image.shape[0]) for x in range(image.shape[1]) for c in range(image.shape[2])], model.PIXELS)


def dense(df, value="v"):
    rows = df.collect()
    out = np.full([1 + max(r[k] for r in rows) for k in ("y", "x", "c")], np.nan)
    for r in rows:
        out[r.y, r.x, r.c] = r[value]
    return out


def masked(spark, valid, name="a"):
    return spark.createDataFrame([(name, y, x, bool(v)) for (y, x), v in np.ndenumerate(np.asarray(valid))], "image_id string, y int, x int, valid boolean")


def test_frames_and_pixels_are_inverse(spark):
    ramp = np.arange(60.0).reshape(4, 5, 3)
    frames = model.frames_from_pixels(grid(spark, ramp))
    assert (frames.first().height, frames.first().width, frames.first().channels) == (4, 5, 3)
    assert (dense(model.pixels_from_frames(frames)) == ramp).all()
    grey = spark.createDataFrame([("g", 1, 2, 1, [1.0, 2.0]), ("f", 1, 1, 4, [1.0, 2.0, 3.0, 4.0])], model.FRAMES)
    assert sorted((r.image_id, r.x, r.c, r.v) for r in model.pixels_from_frames(grey).collect()) == [("f", 0, 0, 1.0), ("f", 0, 1, 2.0), ("f", 0, 2, 3.0)] + [("g", x, c, x + 1.0) for x in (0, 1) for c in range(3)]


def test_stretch_of_flat_and_broken_values(spark):
    flat = stretch.stretch_params(grid(spark, np.full((6, 6), 2.0))).first()
    assert flat.white > flat.black == 2.0
    odd = grid(spark, [[float("nan"), float("inf"), float("-inf")], [0.0, 1.0, 2.0]])
    out = dense(stretch.stretch(odd))
    assert np.isfinite(out).all() and out.min() >= 0 and out.max() <= 1
    cleaned = [r.v for r in odd.select(pixel.finite_or_largest(F.col("v")).alias("v")).collect()]
    assert cleaned[0] == 0 and cleaned[1] == -cleaned[2] == pixel.MAX_FLOAT32


def test_stretch_is_monotone(spark):
    v = np.linspace(-1, 3, 50).reshape(5, 10)
    assert (np.diff(dense(stretch.stretch(grid(spark, v))).ravel()) >= 0).all()


@pytest.mark.parametrize("shape", [(9, 7), (3, 2), (1, 5)])
def test_stencils_reflect_like_numpy(spark, shape):
    image = np.random.default_rng(1).normal(size=shape)
    px = grid(spark, image)
    pad = lambda r, s: np.pad(image, ((r, s), (r, s)), mode="symmetric")
    windows = lambda r, s: np.lib.stride_tricks.sliding_window_view(pad(r, s), (r + s + 1,) * 2)
    assert np.allclose(dense(stencil.local_median(px), "med")[..., 0], np.median(windows(2, 2), axis=(2, 3)))
    assert np.allclose(dense(mask.local_variance(px.withColumn("c", F.lit(1))).withColumn("c", F.lit(0)), "mean")[..., 0], windows(8, 7).mean(axis=(2, 3)))
    taps = np.array(stencil.gaussian_taps(1.5))
    assert len(taps) == 13 and np.allclose(dense(stencil.gaussian(px, 1.5))[..., 0], np.einsum("yxab,a,b->yx", windows(6, 6), taps, taps))
    assert stencil.gaussian(px, 0) is px


def test_mask_threshold_and_margin(spark):
    px = grid(spark, np.random.default_rng(2).normal(size=(20, 18, 3)))
    valid = dense(mask.validity_mask(px, 0.5, margin=3).withColumn("c", F.lit(0)).withColumn("v", F.col("valid").cast("int")))[..., 0]
    assert valid[:3].sum() == valid[-3:].sum() == valid[:, :3].sum() == valid[:, -3:].sum() == 0 and valid.sum() == 14 * 12
    assert not mask.validity_mask(grid(spark, np.ones((4, 4, 3)))).where("valid").count()


@pytest.mark.parametrize("size,inclusive,want", [(8, False, 0), (9, False, 1), (8, True, 1)])
def test_candidates_leave_out_the_last_origin(spark, size, inclusive, want):
    got = integral.candidates(masked(spark, np.ones((size, size))), 8, inclusive).collect()
    assert [(r.y, r.x) for r in got] == [(0, 0)] * want


def test_patch_sums_and_prefix_sums(spark):
    m = np.random.default_rng(3).integers(0, 2, (10, 12))
    cells = masked(spark, m).withColumn("n", F.col("valid").cast("int"))
    sums = {(r.y, r.x): r.n for r in integral.patch_sums(cells, 4, "n").collect()}
    assert sums == {(y, x): m[y : y + 4, x : x + 4].sum() for y in range(6) for x in range(8)}
    sat = {(r.y, r.x): r.sat for r in integral.prefix_sum(cells, "n").collect()}
    assert all(sat[y, x] == m[: y + 1, : x + 1].sum() for y in range(10) for x in range(12))


def test_defects_per_channel_and_transplant_of_all(spark):
    image = np.random.default_rng(4).normal(0.5, 0.01, (9, 9, 3))
    image[4, 4, 1], image[0, 0, 2] = 5.0, -5.0
    px = grid(spark, image)
    found = defects.detect(px)
    bad = {(r.y, r.x, r.c) for r in found.where("bad").collect()}
    assert {(4, 4, 1), (0, 0, 2)} <= bad and len(bad) < 6
    fixed = defects.correct(found)
    out = dense(fixed)
    assert abs(out[4, 4, 1] - 0.5) < 0.1 and out[4, 4, 0] == image[4, 4, 0]
    other = grid(spark, np.zeros((9, 9, 3)))
    moved, added = dense(defects.transplant(other, px, fixed)), dense(defects.transplant(other, px, fixed, "additive"))
    assert (moved[4, 4] == image[4, 4]).all() and moved[8, 8].sum() == 0
    assert math.isclose(added[4, 4, 1], image[4, 4, 1] - out[4, 4, 1]) and added[4, 4, 0] == 0
    assert not defects.detect(grid(spark, np.ones((6, 6)))).where("bad").count()
    ignored = masked(spark, np.arange(81).reshape(9, 9) != 40)
    assert (4, 4, 1) not in {(r.y, r.x, r.c) for r in defects.detect(px, ignored).where("bad").collect()}
    grown = {(r.y, r.x) for r in stencil.dilate(spark.createDataFrame([("a", 0, 1, 0)], "image_id string, y int, x int, c int"), 1, model.dims(px)).collect()}
    assert grown == {(0, 1), (0, 0), (0, 2), (1, 1)}
    n = defects.counts(found).first()
    assert n.n_bad == len({b[:2] for b in bad}) and math.isclose(n.bad_pct, 100 * n.n_bad / 81)


def test_quantising(spark):
    v = spark.createDataFrame([((k + 0.5) / 65535,) for k in range(6)] + [(-1.0,), (2.0,)], "v double")
    got = v.select(pixel.quantise_truncating(F.col("v")).alias("t"), pixel.quantise_rounding(F.col("v")).alias("r")).collect()
    assert [g.t for g in got] == [0, 1, 2, 3, 4, 5, 0, 65535] and [g.r for g in got[:6]] == [0, 2, 2, 4, 4, 6] and (got[6].r, got[7].r) == (0, 65535)


def test_turns_are_those_of_numpy(spark):
    image = np.arange(12.0).reshape(3, 4)
    for h in (False, True):
        for v in (False, True):
            for k in range(4):
                want = np.rot90(np.flipud(np.fliplr(image) if h else image) if v else np.fliplr(image) if h else image, k)
                y, x = pixel.turned(F.col("y"), F.col("x"), F.lit(3), F.lit(4), F.lit(h), F.lit(v), F.lit(k))
                got = np.zeros(want.shape)
                for r in grid(spark, image).select(y.alias("y"), x.alias("x"), "v").collect():
                    got[r.y, r.x] = r.v
                assert (got == want).all()


def spline_weights(n_in, n_out):
    """The n_out x n_in matrix of corner-aligned cubic-spline resampling with mirrored borders, by a dense solve."""
    if n_in == 1:
        return np.ones((n_out, 1))
    prefilter = np.diag(np.full(n_in, 4 / 6)) + np.diag(np.full(n_in - 1, 1 / 6), 1) + np.diag(np.full(n_in - 1, 1 / 6), -1)
    prefilter[0, 1] = prefilter[-1, -2] = 2 / 6
    taps = np.zeros((n_out, n_in))
    for j in range(n_out):
        at = j * (n_in - 1) / (n_out - 1) if n_out > 1 else 0.0
        for i in range(math.floor(at) - 1, math.floor(at) + 3):
            d = abs(at - i)
            m = abs(i) % (2 * (n_in - 1))
            taps[j, m if m < n_in else 2 * (n_in - 1) - m] += (4 - 6 * d * d + 3 * d**3) / 6 if d < 1 else (2 - d) ** 3 / 6 if d < 2 else 0.0
    return np.linalg.solve(prefilter.T, taps.T).T


@pytest.mark.parametrize("shape,new", [((12, 9), (3, 2)), ((3, 5), (12, 21)), ((7, 2), (7, 5)), ((1, 4), (4, 1)), ((40, 33), (10, 8)), ((2, 1), (1, 3))])
def test_spline_zoom_equals_a_dense_solve(spark, shape, new):
    image = np.random.default_rng(5).random((*shape, 2))
    size = spark.createDataFrame([("a", *shape, *new)], "image_id string, height int, width int, new_height int, new_width int")
    got = dense(degrade.resize(grid(spark, image), size))
    want = np.einsum("ij,jkc,lk->ilc", spline_weights(shape[0], new[0]), image, spline_weights(shape[1], new[1]))
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-12)


@pytest.mark.parametrize("shape,new", [((600, 3), (150, 9)), ((257, 2), (700, 2)), ((513, 1), (1, 2))])
def test_long_lines_are_resized_in_blocks(spark, shape, new):
    """Blocks make what a whole line makes; no window runs along a line, and borders give no rows of their own."""
    image = np.random.default_rng(6).random((*shape, 1))
    size = spark.createDataFrame([("a", *shape, *new)], "image_id string, height int, width int, new_height int, new_width int")
    made = degrade.resize(grid(spark, image), size)
    whole = lambda rows, n: degrade.resampled(rows, 0, 0, rows.shape[1], rows.shape[1], n)[1]
    want = whole(whole(image[..., 0].T, new[0]).T, new[1])
    assert np.allclose(dense(made)[..., 0], want, atol=1e-12)
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_degrade_keeps_the_shape(spark):
    image = np.random.default_rng(5).random((13, 10, 3))
    got = dense(degrade.degrade(grid(spark, image)))
    assert got.shape == image.shape and got.min() >= 0 and got.max() <= 1 and got.var() < image.var()
    down = dense(degrade.zoom_down(grid(spark, image[..., :1])))[..., 0]
    want = spline_weights(13, 3) @ image[..., 0] @ spline_weights(10, 2).T
    assert np.allclose(down, np.clip(want, 0, 1))
    target = spark.createDataFrame([("a", 15, 8)], "image_id string, height int, width int")
    cut = dense(degrade.match_shape(grid(spark, image), target))
    assert cut.shape == (15, 8, 3) and cut[13:].sum() == 0 and (cut[:13] == image[:, :8]).all()


def test_crops_are_deterministic_and_good(spark):
    image = np.random.default_rng(6).random((30, 28, 3))
    image[:15] = 0.0
    px, valid = grid(spark, image), masked(spark, np.ones((30, 28)))
    made = crops.crop_manifest(px, valid, 8, 20).collect()
    again = crops.crop_manifest(px.repartition(7), valid.repartition(3), 8, 20).collect()
    assert sorted(made) == sorted(again) and 10 < len(made) <= 20
    cut = crops.extract(px, spark.createDataFrame(made), 8)
    for r in made:
        want = image[r.y : r.y + 8, r.x : r.x + 8]
        assert want.mean() >= 0.05 and r.y < 22 and r.x < 20
        want = np.rot90(np.flipud(want) if r.flip_v and not r.flip_h else np.flipud(np.fliplr(want)) if r.flip_v else np.fliplr(want) if r.flip_h else want, r.rot_k)
        assert (dense(cut.where(F.col("crop_index") == r.crop_index)) == want).all()
    out = spark.createDataFrame([("a", 0, 23, 0), ("a", 1, 22, 20), ("b", 0, 0, 0)], "image_id string, crop_index int, y int, x int")
    assert {(r.image_id, r.crop_index): r.reason for r in crops.rejected(out, model.dims(px), 8).collect()} == {("a", 0): "out of bounds", ("b", 0): "no frame"}
    whole = crops.patches(px, spark.createDataFrame(made), 8).first()
    assert len(whole.data) == 192 and whole.name.startswith("a_00")


def test_components(spark):
    soft = np.zeros((8, 8))
    soft[1, 1] = soft[2, 2] = 0.5  # diagonal neighbours are apart
    soft[4, 4:7] = soft[5, 4] = soft[5, 6] = soft[6, 4:7] = 0.9  # a ring is one
    df = grid(spark, soft).withColumnRenamed("v", "alpha")
    got = {(r.y, r.x): r.label for r in stars.components(df).collect()}
    assert got[1, 1] == 1 and got[2, 2] == 2 and {got[y, x] for y, x in got if y > 3} == {3}


def flood(m):
    """Labels of 4-connected pixels in raster order."""
    want, n = np.zeros(m.shape, int), 0
    for a, b in zip(*np.nonzero(m)):
        if not want[a, b]:
            n += 1
            todo = [(a, b)]
            while todo:
                i, j = todo.pop()
                if 0 <= i < m.shape[0] and 0 <= j < m.shape[1] and m[i, j] and not want[i, j]:
                    want[i, j] = n
                    todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
    return want


@pytest.mark.parametrize("shape,density", [((14, 150), 0.5), ((60, 9), 0.6), ((12, 12), 1.0), ((5, 5), 0.0), ((25, 140), 0.62)])
def test_components_equal_a_flood_fill(spark, shape, density):
    images = {name: np.random.default_rng(i).random(shape) < density for i, name in enumerate("ab")}
    soft = grid(spark, images["a"] * 0.5, "a").union(grid(spark, images["b"] * 0.5, "b")).withColumnRenamed("v", "alpha").repartition(5)
    got = {k: np.zeros(shape, int) for k in images}
    for r in stars.components(soft).collect():
        got[r.image_id][r.y, r.x] = r.label
    assert all((got[k] == flood(m)).all() for k, m in images.items())


def test_star_library(spark):
    image, soft = np.full((12, 12, 3), 0.5), np.zeros((12, 12))
    soft[3:5, 3:5], soft[8:10, 8:10], soft[0, 11] = 0.8, 0.6, 0.9
    px, df = grid(spark, image), grid(spark, soft).withColumnRenamed("v", "alpha")
    labelled = stars.components(df)
    valid = np.ones((12, 12))
    valid[11, 11] = 0  # inside the second star's padded box
    boxes = stars.boxes(labelled, model.dims(px), masked(spark, valid))
    (box,) = boxes.collect()
    assert (box.area, box.y0, box.y1, box.x0, box.x1) == (4, 1, 7, 1, 7)
    cut = stars.stamps(px, labelled, boxes)
    (star,) = stars.catalogue(cut, boxes).collect()
    assert (star.star_id, star.h, star.w) == (0, 6, 6) and math.isclose(star.peak, 0.4) and math.isclose(star.flux, 4 * 3 * 0.4)
    d = stars.densities(stars.catalogue(cut, boxes), spark.createDataFrame([("a", 143), ("b", 10), ("c", 0)], "image_id string, valid_area long")).collect()
    assert {r.source: r.density for r in d} == {"a": 1 / 143, "b": 0.0}


@pytest.mark.parametrize("size", [2, 3])
def test_paste_clips_and_centres(spark, size):
    base = grid(spark, np.full((5, 5, 1), 0.75))
    stamp = spark.createDataFrame([(0, y, x, 0, 1.0, 0.5) for y in range(size) for x in range(size)], "star_id long, dy int, dx int, c int, rgb double, alpha double")
    at = spark.createDataFrame([("a", 0, 0, 0, 0, size / 2, False, False, 0, 1.0)], inject.PLACED)
    got = dense(inject.paste(base, at, stamp, model.dims(base)))[..., 0]
    n = size - size // 2
    assert (got[:n, :n] == 1).all() and got.sum() == 0.75 * 25 + 0.25 * n * n


def test_greedy_placement_is_the_sequential_rule(spark):
    stars_ = spark.createDataFrame([(0, 4, 4), (1, 9, 5)], "star_id long, h int, w int")
    size = spark.createDataFrame([("a", 60, 60), ("NGC_1234_stack_001", 40, 50), ("NGC_1234_stack_002", 40, 50)], "image_id string, height int, width int")
    counts = spark.createDataFrame([("a", 120), ("NGC_1234_stack_001", 20), ("NGC_1234_stack_002", 20), ("none", 3)], "image_id string, n_stars long")
    placed = inject.place(inject.valid_pixels(size), counts, stars_)
    rows = sorted(placed.collect())
    assert len(rows) > 60 and inject.conflicts(placed).count() == 0
    assert rows == sorted(inject.place(inject.valid_pixels(size.repartition(3)), counts.repartition(2), stars_).collect())
    twin = {r.image_id: [(q.seq, q.cy, q.cx) for q in rows if q.image_id == r.image_id] for r in rows}
    assert twin["NGC_1234_stack_001"] != twin["NGC_1234_stack_002"]  # the whole name counts
    want, held = [], {}
    for r in sorted(inject.tries(inject.valid_pixels(size), counts, stars_).collect(), key=lambda r: (r.image_id, r.seq, r.attempt)):
        own = held.setdefault(r.image_id, {})
        if r.seq not in own and all((r.cy - y) ** 2 + (r.cx - x) ** 2 >= (0.55 * (r.radius + o)) ** 2 for y, x, o in own.values()):
            own[r.seq] = (r.cy, r.cx, r.radius)
            want.append(tuple(r)[:-1])
    assert [tuple(r) for r in rows] == sorted(want)


def test_conflicts_and_open_pixels(spark):
    size = spark.createDataFrame([("a", 60, 60), ("b", 40, 50)], "image_id string, height int, width int")
    close = spark.createDataFrame([("a", 0, 0, 5, 5, 2.0, False, False, 0, 1.0), ("a", 1, 0, 6, 6, 2.0, False, False, 0, 1.0), ("a", 2, 0, 30, 30, 2.0, False, False, 0, 1.0)], inject.PLACED)
    assert [(r.seq_a, r.seq_b) for r in inject.conflicts(close).collect()] == [(0, 1)]
    none = masked(spark, np.zeros((40, 50)), "b")
    assert inject.valid_pixels(size.where("image_id = 'b'"), none).count() == 2000


def test_keyed_choices(spark):
    k = spark.range(4000).select(rng.key(1, "x", "id").alias("k"))
    u = [r.u for r in k.select(rng.uniform(F.col("k")).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02


def test_star_counts_are_poisson(spark):
    rated = spark.range(3000).select(F.col("id").cast("string").alias("image_id"), F.when(F.col("id") % 3 == 0, 0.0).when(F.col("id") % 3 == 1, 4.0).otherwise(60.0).alias("rate"))
    found = inject.arrivals(rated).join(rated, "image_id").groupBy("rate").agg(F.avg("n_stars").alias("mean"), F.var_samp("n_stars").alias("var"), F.count("*").alias("n")).collect()
    assert {r.rate: r.n for r in found} == {0.0: 1000, 4.0: 1000, 60.0: 1000}
    for r in found:
        assert abs(r["mean"] - r.rate) <= 4 * math.sqrt(r.rate / 1000) and abs(r["var"] - r.rate) <= 0.2 * r.rate


def test_densities_are_drawn_from_those_there_are(spark):
    valid = spark.range(2000).select(F.concat(F.lit("i"), (F.col("id") % 200).cast("string")).alias("image_id"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"))
    rich = spark.createDataFrame([("a", 5.0), ("b", 0.0)], "source string, density double")
    n = [r.n_stars for r in inject.expected_counts(valid, rich).collect()]
    assert len(n) == 200 and 60 < sum(v == 0 for v in n) < 140 and all(v == 0 or 15 < v < 100 for v in n)
    assert {r.n_stars for r in inject.expected_counts(valid, rich.limit(0)).collect()} == {0}


def test_numbering_is_that_of_one_window(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).cast("int").alias("o"), (F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    for block in (None, F.floor(F.col("o") / 16)):
        got = numbering.running(numbering.numbered(rows, ["o"], ["g"], block), ["o"], ["g"], block, s=F.col("v")).collect()
        by = {g: sorted((r for r in got if r.g == g), key=lambda r: r.o) for g in range(3)}
        for own in by.values():
            assert [r.k for r in own] == list(range(len(own))) and [r.s for r in own] == list(np.cumsum([r.v for r in own]))
    assert [r.k for r in numbering.numbered(rows.limit(0), ["o"]).collect()] == []
    assert sorted(r.k for r in numbering.numbered(rows, ["o"]).collect()) == list(range(500))


@pytest.mark.parametrize("kind", ["normal", "steps", "outlier", "one", "equal", "infinite"])
def test_quantiles_are_exact(spark, kind):
    own = np.random.default_rng(3)
    made = {
        "normal": own.standard_normal(1001), "steps": own.integers(-3, 4, 500) / 4.0, "outlier": np.r_[own.random(300) * 1e-9, 1e300, -1e300, 5e-324],
        "one": np.array([2.5]), "equal": np.full(37, 0.1), "infinite": np.r_[np.full(5, np.inf), np.full(5, -np.inf), own.random(90)],
    }[kind]
    df = spark.createDataFrame([("g", float(v)) for v in made] + [("g", None), ("h", 1.0), ("null", None)], "g string, v double").repartition(4)
    shares = [0.0, 0.01, 0.5, 0.8, 0.997, 1.0]
    got = {r.g: r.p for r in quantiles.quantiles(df, ["g"], F.col("v"), shares).collect()}
    assert got.keys() == {"g", "h"} and got["h"] == [1.0] * 6
    at = np.array(shares) * (len(made) - 1)
    s = np.sort(made)
    lo, hi = s[np.floor(at).astype(int)], s[np.ceil(at).astype(int)]
    with np.errstate(invalid="ignore"):
        want = np.where(lo == hi, lo, lo + (hi - lo) * (at - np.floor(at)))
    assert np.allclose(got["g"], want, rtol=1e-12, atol=0, equal_nan=True)


def test_combinations():
    assert combos.combo_names() == ["stars", "defects", "stars_defects", "lowres", "stars_lowres", "defects_lowres", "stars_defects_lowres"]


def test_ema_folds_like_its_closed_form(spark):
    df = spark.createDataFrame([("a", t, float(t * t % 7)) for t in range(20)] + [("b", 0, 3.0)], "run string, t int, v double")
    folded = {(r.run, r.t): r.ema for r in metrics.ema(df, ["run"], "t", "v", 0.9).collect()}
    last = {r.run: r.ema for r in metrics.last_ema(df, ["run"], "t", "v", 0.9).collect()}
    assert math.isclose(folded["a", 19], last["a"]) and folded["b", 0] == last["b"] == 3.0


@pytest.mark.parametrize("beta", [0.999, 0.5, 0.01])
def test_ema_of_a_long_run_equals_the_recursion(spark, beta):
    values = np.random.default_rng(8).standard_normal(3000)
    df = spark.createDataFrame([("a", t * 3, float(v)) for t, v in enumerate(values)], "run string, t int, v double").repartition(4)
    got = {r.t // 3: r.ema for r in metrics.ema(df, ["run"], "t", "v", beta).collect()}
    e = values[0]
    for t, v in enumerate(values):
        e = v if t == 0 else beta * e + (1 - beta) * v
        assert math.isclose(got[t], e, rel_tol=1e-9, abs_tol=1e-12)


def test_exact_split_is_exact(spark):
    out = splits.exact_split(spark.range(1003), "id", 0.15).groupBy("role").count().collect()
    assert {r.role: r["count"] for r in out} == {"val": 150, "train": 853}
    whole = splits.exact_split(spark.range(10), "id", 0.0)
    assert whole.where("role = 'val'").count() == 0


def test_merging(spark):
    rows = [("a", 0, 0, 1.0), ("a", 0, 1, -0.1), ("b", 0, 0, -0.4), ("b", 0, 1, -2.0), ("c", 0, 0, 3.0), ("c", 0, 1, 0.2)]
    v = spark.createDataFrame(rows, "task string, param int, idx int, value double")
    assert {r.idx: r.value for r in merging.elect_and_mean(v).collect()} == {0: 2.0, 1: -1.05}
    assert {r.idx: round(r.value, 6) for r in merging.task_arithmetic(v, {"b": 0.0}).collect()} == {0: 4.0, 1: 0.1}
    assert merging.trim(v, 0.5).count() == 3


def test_codecs_round_trip(spark, tmp_path):
    image = np.random.default_rng(8).random((5, 4, 3)).astype(np.float32)
    assert (codecs.channels_last(codecs.read_fits(codecs.write_fits(np.moveaxis(image, -1, 0)))) == image).all()
    assert (codecs.read_npy(codecs.write_npy(image)) == image).all()
    q = np.rint(image * 65535).astype(np.uint16)
    assert (np.rint(codecs.read_tiff(codecs.write_tiff(q)) * 65535) == q).all()
    assert (np.rint(codecs.read_tiff(codecs.write_tiff(q[..., 0].astype(np.uint8))) * 255)[..., 0] == q[..., 0].astype(np.uint8)).all()
    for bad in (b"", b"SIMPLE", b"II*\0junkjunk"):
        with pytest.raises(Exception):
            codecs.read_tiff(bad)
    with pytest.raises(ValueError):
        codecs.to_hwc(np.zeros((2, 5, 7)))
    assert codecs.to_hwc(np.zeros((3, 5, 3))).shape == (5, 3, 3) and codecs.channels_last(np.zeros((3, 5, 3))).shape == (3, 5, 3)

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fits").write_bytes(codecs.write_fits(np.moveaxis(image, -1, 0)))
    (folder / "b.fit").write_bytes(b"broken")
    frames = {r.image_id: r for r in files.read_frames(spark, str(folder), "fits").collect()}
    assert frames["b"].data is None and frames["b"].reject and np.allclose(frames["a"].data, image.ravel())
    good = files.read_frames(spark, str(folder), "fits").where("reject is null")
    for kind, values in (("npy", "float"), ("fits", "float"), ("tiff", "rint16"), ("tiff", "trunc16")):
        out = f"file://{tmp_path}/{kind}-{values}"
        files.write_frames(good, out, kind, values)
        (back,) = files.read_frames(spark, out, kind).collect()
        assert back.image_id == "a" and np.allclose(back.data, image.ravel(), atol=2e-5)


def test_manifest_json_round_trip(spark, tmp_path):
    made = spark.createDataFrame([("a", 0, 1, 2, True, False, 3), ("b", 4, 5, 6, False, True, 0)], model.CROPS)
    text = files.manifest_json(made, 8, 42).first().value
    assert json.loads(text)["patch_size"] == 8
    (tmp_path / "m.json").write_text(text)
    assert sorted(files.read_manifest(spark, str(tmp_path / "m.json")).collect()) == sorted(made.collect())


def test_arrivals_skip_what_is_done(spark, tmp_path):
    schema = "image_id string, v double"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1.0), ("b", 2.0)], schema).write.parquet(source)
    run = lambda n: arrivals.process(arrivals.arrivals(spark, source, schema), lambda df: df.withColumn("v", F.col("v") * 2), out, str(tmp_path / f"state{n}")).awaitTermination()
    run(0)
    spark.createDataFrame([("c", 3.0)], schema).write.mode("append").parquet(source)
    run(0)
    run(1)  # a new stream sees all files again
    assert sorted(tuple(r) for r in ledger.read(spark, out).collect()) == [("a", 2.0), ("b", 4.0), ("c", 6.0)]


def test_crops_over_the_edge_and_uneven_shapes_are_rejected(spark):
    grid = lambda name, h, w: [(name, y, x, 0, float(y * w + x)) for y in range(h) for x in range(w)]
    frame = spark.createDataFrame(grid("a", 6, 6) + grid("b", 6, 6) + grid("c", 2, 2), model.PIXELS)
    target = spark.createDataFrame(grid("a", 6, 6) + grid("b", 5, 6), model.PIXELS)
    manifest = spark.createDataFrame([("a", 0, 2, 2, False, False, 0), ("a", 1, 3, 2, False, False, 0), ("b", 0, 0, 0, True, False, 1), ("z", 0, 0, 0, False, False, 0)], model.CROPS)
    got = crops.extract(frame, manifest, 4)
    assert {(r.image_id, r.crop_index, r.n) for r in got.groupBy("image_id", "crop_index").agg(F.count("*").alias("n")).collect()} == {("a", 0, 16), ("b", 0, 16)}
    assert {(r.image_id, r.side) for r in crops.pairs(frame, target, manifest, 4).collect()} == {("a", "input"), ("a", "target")}
    assert {tuple(r) for r in crops.rejected(manifest, model.dims(frame), 4).collect()} == {("a", 1, "out of bounds"), ("z", 0, "no frame")}
    assert {tuple(r) for r in crops.shape_rejects(frame, 4, target=target).collect()} == {("b", "target of another shape"), ("c", "too small")}


def test_keys_missing_in_json(spark):
    rows = spark.createDataFrame([('{"b": 1}',), ('{"a": 1, "b": 2, "z": 3}',), ("no json",)], "value string")
    assert [r.m for r in rows.select(files.keys_missing(F.col("value"), ["b", "c", "a"]).alias("m")).collect()] == [["a", "c"], ["c"], None]
