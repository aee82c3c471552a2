"""Image files as a data source, ledgers, datasets and star libraries: round trips, faults and reruns."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelrel import model, storage
from pixelrel.functions import rng
from pixelrel.operators import merging, overlay, pretext, search
from pixelrel.sources import codecs, datasets, files, frames, ledger, library


def frame_rows(spark, images):
    rows = [(name, *image.shape, [float(v) for v in image.ravel()]) for name, image in images.items()]
    return spark.createDataFrame(rows, model.FRAMES)


def shown(df):
    return {r.image_id: np.array(r.data, np.float32).reshape(r.height, r.width, r.channels) for r in df.collect()}


# frames -----------------------------------------------------------------------------------------------------------------
def test_frames_through_files(spark, tmp_path):
    own = np.random.default_rng(1)
    images = {f"img_{i}": own.random((5 + i, 4, 3)).astype(np.float32) for i in range(7)}
    rows = frame_rows(spark, images).repartition(3)
    for kind in ("npy", "fits"):
        files.write_frames(rows, f"file://{tmp_path}/{kind}", kind)
        back = shown(files.read_frames(spark, f"file://{tmp_path}/{kind}", kind, maxPartitionBytes="300"))
        assert back.keys() == images.keys() and all((back[k] == images[k]).all() for k in images)
    assert files.read_frames(spark, f"file://{tmp_path}/npy", "npy", maxPartitionBytes="300").rdd.getNumPartitions() > 3
    assert sorted(os.listdir(tmp_path / "npy")) == [f"img_{i}.npy" for i in range(7)]


def test_modes_for_malformed_files(spark, tmp_path):
    (tmp_path / "a.npy").write_bytes(codecs.write_npy(np.ones((2, 2, 3), np.float32)))
    (tmp_path / "b.npy").write_bytes(b"broken")
    (tmp_path / "c.npy").write_bytes(b"")
    (tmp_path / "_hidden.npy").write_bytes(b"broken")
    (tmp_path / "d.txt").write_bytes(b"not asked for")
    read = lambda **o: {r.image_id: r for r in files.read_frames(spark, str(tmp_path), "npy", **o).collect()}
    rows = read()
    assert rows.keys() == {"a", "b", "c"} and rows["a"].reject is None and rows["b"].data is None and rows["b"].reject and rows["c"].reject
    assert read(mode="dropmalformed").keys() == {"a"}
    with pytest.raises(Exception, match="b.npy"):
        read(mode="FAILFAST")
    with pytest.raises(Exception, match="mode one of"):
        read(mode="whatever")


def test_float_tiff_only_if_allowed(spark, tmp_path):
    image = np.random.default_rng(2).random((5, 4, 1)).astype(np.float32)
    data = bytearray(codecs.write_tiff(np.zeros((5, 4, 1), np.uint16)))
    n = int.from_bytes(data[8:10], "little")
    entries = [bytes(data[10 + 12 * i : 22 + 12 * i]) for i in range(n)]
    made = []
    for e in entries:
        tag = int.from_bytes(e[:2], "little")
        made.append(e[:8] + {258: (32).to_bytes(4, "little"), 279: (80).to_bytes(4, "little")}.get(tag, e[8:]))
        if tag == 284:
            made.append(b"\x53\x01\x03\x00\x01\x00\x00\x00\x03\x00\x00\x00")  # sample format: float
    start = 8 + 2 + 12 * len(made) + 4
    made = [e[:8] + start.to_bytes(4, "little") if e[:2] == b"\x11\x01" else e for e in made]
    (tmp_path / "f.tif").write_bytes(bytes(data[:8]) + len(made).to_bytes(2, "little") + b"".join(made) + bytes(4) + image.astype("<f4").tobytes())
    assert files.read_frames(spark, str(tmp_path), "tiff").first().reject
    assert np.allclose(files.read_frames(spark, str(tmp_path), "tiff", allowFloat="true").first().data, image.ravel())


def packed_tiff(image, how, predictor=1):
    """The plain TIFF of an image with its strip packed by another writer than the library's."""
    import zlib

    plain, wide = codecs.write_tiff(image), image.astype(image.dtype.newbyteorder("<"))
    diff = np.diff(wide, axis=1, prepend=np.zeros_like(wide[:, :1])).astype(wide.dtype) if predictor == 2 else wide
    raw = diff.tobytes()
    if how == 8:
        body = zlib.compress(raw)
    elif how == 1:
        body = raw
    elif how == 32773:
        body = b"".join(bytes([0, b]) for b in raw)
    else:
        table, codes, word = {bytes([i]): i for i in range(256)}, [(256, 9)], b""
        n = 258
        width = lambda n: 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        for b in raw:
            if word + bytes([b]) in table:
                word += bytes([b])
                continue
            codes.append((table[word], width(n)))
            table[word + bytes([b])] = n
            n, word = n + 1, bytes([b])
            if n == 4094:
                codes.append((256, 12))
                table, n = {bytes([i]): i for i in range(256)}, 258
        codes += [(table[word], width(n)), (257, width(n + 1))]
        bits = "".join(format(c, f"0{w}b") for c, w in codes)
        body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    count = int.from_bytes(plain[8:10], "little")
    entries = [plain[10 + 12 * i : 22 + 12 * i] for i in range(count)] + [(317).to_bytes(2, "little") + b"\x03\x00\x01\x00\x00\x00" + predictor.to_bytes(4, "little")]
    rest = 8 + 2 + 12 * len(entries) + 4
    bits_at, strip = rest, rest + 8
    value = {259: how, 273: strip, 279: len(body)} | ({258: bits_at} if image.shape[-1] > 2 else {})
    entries = [e[:8] + value[t].to_bytes(4, "little") if (t := int.from_bytes(e[:2], "little")) in value else e for e in entries]
    depth = (image.dtype.itemsize * 8).to_bytes(2, "little") * 3
    return plain[:8] + len(entries).to_bytes(2, "little") + b"".join(entries) + bytes(4) + depth.ljust(8, b"\0") + body


@pytest.mark.parametrize("how,predictor", [(1, 1), (1, 2), (8, 1), (8, 2), (32773, 1), (5, 1), (5, 2)])
def test_packed_tiffs(how, predictor):
    own = np.random.default_rng(9)
    smooth = np.cumsum(own.integers(0, 3, (40, 50, 3)), axis=1)
    for image in (smooth.astype(np.uint16) * 37, (smooth % 256).astype(np.uint8), own.integers(0, 65536, (30, 40, 3)).astype(np.uint16)):
        data = packed_tiff(image, how, predictor)
        assert (np.rint(codecs.read_tiff(data) * float(np.iinfo(image.dtype).max)) == image).all()
    with pytest.raises(ValueError):
        codecs.read_tiff(packed_tiff(image, 8)[:-40])


def test_packbits_runs():
    assert codecs._packbits(bytes([254, 7, 128, 2, 1, 2, 3, 129, 9])) == bytes([7] * 3 + [1, 2, 3] + [9] * 128)


def test_png_round_trip():
    for c in (1, 3):
        image = np.random.default_rng(c).integers(0, 256, (5, 7, c)).astype(np.uint8)
        assert (np.rint(codecs.read_png(codecs.write_png(image)) * 255) == image).all()
    with pytest.raises(ValueError):
        codecs.read_png(b"no")


def test_commit_overwrite_and_abort(spark, tmp_path):
    one, two = frame_rows(spark, {"a": np.ones((1, 1, 3))}), frame_rows(spark, {"b": np.zeros((1, 1, 3))})
    out = f"file://{tmp_path}/out"
    files.write_frames(one, out)
    files.write_frames(two, out)
    assert sorted(os.listdir(tmp_path / "out")) == ["a.npy", "b.npy"]
    files.write_frames(one, out, mode="overwrite")
    assert os.listdir(tmp_path / "out") == ["a.npy"]
    with pytest.raises(Exception, match="two frames"):
        files.write_frames(two.union(two), out)
    bad = two.withColumn("height", F.lit(9))  # can't be reshaped
    with pytest.raises(Exception):
        files.write_frames(bad, out)
    assert os.listdir(tmp_path / "out") == ["a.npy"]  # nothing staged stays
    with pytest.raises(Exception, match="values"):
        files.write_frames(one, out, "tiff", "float")


def test_attempts_that_do_not_count_leave_no_file(tmp_path):
    import pyarrow as pa

    writer = frames.FrameWriter({"path": f"file://{tmp_path}/out", "kind": "npy"}, False)
    batch = pa.record_batch({"image_id": ["a"], "height": [1], "width": [2], "channels": [1], "data": pa.array([[1.0, 2.0]], pa.list_(pa.float32()))})
    writer.write(iter([batch]))  # this attempt is lost
    writer.commit([writer.write(iter([batch])), None])
    assert os.listdir(tmp_path / "out") == ["a.npy"]


def test_masks_and_listings(spark, tmp_path):
    valid = np.random.default_rng(3).random((5, 7)) < 0.5
    mask = spark.createDataFrame([("m", y, x, bool(v)) for (y, x), v in np.ndenumerate(valid)], "image_id string, y int, x int, valid boolean")
    files.write_frames(files.mask_frames(mask), f"file://{tmp_path}/npy", "npy", "bool")
    files.write_frames(files.mask_frames(mask), f"file://{tmp_path}/tif", "tiff", "mask")
    assert np.load(tmp_path / "npy" / "m.npy").dtype == bool
    for kind, folder in (("npy", "npy"), ("tiff", "tif")):
        assert sorted(files.read_masks(spark, f"file://{tmp_path}/{folder}", kind).collect()) == sorted(mask.collect())
    both = files.listings(spark, (str(tmp_path / "npy"), "npy"), (str(tmp_path / "tif"), "tiff")).collect()
    assert [(r.image_id, r.suffix, r.place) for r in sorted(both, key=lambda r: r.place)] == [("m", "npy", 0), ("m", "tif", 1)]


# ledgers ------------------------------------------------------------------------------------------------------------------
def test_ledger_adds_each_key_once(spark, tmp_path):
    out, schema = f"file://{tmp_path}/out", "k string, n int, v double, kind string"
    first = spark.createDataFrame([("a", 1, 1.0, "x"), ("a", 1, 2.0, "y"), ("b", 1, 3.0, "x")], schema)
    assert ledger.append(first, out, ["k", "n"], by=["kind"]) == {"given": 2, "written": 2}
    assert ledger.append(first, out, ["k", "n"], by=["kind"]) == {"given": 2, "written": 0}
    more = spark.createDataFrame([("b", 1, 9.0, "x"), ("b", 2, 4.0, "y")], schema)
    assert ledger.append(more, out, ["k", "n"], lambda rows: rows.withColumn("v", F.col("v") * 10), by=["kind"]) == {"given": 2, "written": 1}
    assert ledger.append(more.limit(0), out, ["k", "n"], by=["kind"]) == {"given": 0, "written": 0}
    want = sorted([*(tuple(r) for r in first.collect()), ("b", 2, 40.0, "y")])
    assert sorted(tuple(r[c] for c in first.columns) for r in ledger.read(spark, out).collect()) == want
    assert sorted((r.given, r.written) for r in ledger.commits(spark, out).collect()) == [(2, 1), (2, 2)]


def test_a_batch_that_broke_off_does_not_count(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    ledger.append(rows, out, ["k"])
    lost = spark.createDataFrame([("c", 3.0)], "k string, v double")
    lost.withColumn("batch", F.lit("lost")).write.mode("append").partitionBy("batch").parquet(f"{out}/data")
    ledger._bucketed(lost.select("k"), ["k"], ledger.BUCKETS).withColumn("batch", F.lit("lost")).write.mode("append").partitionBy("bucket", "batch").parquet(f"{out}/keys")
    assert {r.k for r in ledger.read(spark, out).collect()} == {"a", "b"}
    assert ledger.append(lost, out, ["k"])["written"] == 1
    assert sorted(tuple(r) for r in ledger.read(spark, out).collect()) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]


def test_scratch_tables_go(spark):
    with storage.Scratch(spark) as scratch:
        table = scratch.table(spark.range(5), "some")
        (path,) = scratch.paths
        assert table.count() == 5 and storage.exists(spark, path)
    assert not storage.exists(spark, path)


# datasets -----------------------------------------------------------------------------------------------------------------
def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_pairs_are_by_stem(spark):
    got = datasets.paired(paths(spark, "in/a.npy", "in/b.npy", "in/d.npy", "more/d.npy"), paths(spark, "out/a.npy", "out/c.npy", "out/d.npy"))
    assert sorted((r.stem, r.input, r.target, r.issue) for r in got.collect()) == [("a", "in/a.npy", "out/a.npy", None), ("b", "in/b.npy", None, "no target"), ("c", None, "out/c.npy", "no input"), ("d", "in/d.npy", "out/d.npy", "duplicate")]
    good = datasets.dataset(paths(spark, "in/z.npy", "in/a.npy"), paths(spark, "out/a.npy", "out/z.npy"))
    assert sorted((r.i, r.stem) for r in good.collect()) == [(0, "a"), (1, "z")]
    for left, right in ((["a.npy"], []), ([], [])):
        with pytest.raises(ValueError):
            datasets.dataset(paths(spark, *left), paths(spark, *right))


def test_split_manifests_and_their_preference(spark, tmp_path):
    pairs = spark.createDataFrame([(f"s{i}", f"in/s{i}.npy", f"out/s{i}.npy") for i in range(25)], "stem string, input string, target string")
    rows = datasets.split(pairs, 0.1)
    assert rows.where("role = 'val' and side = 'input'").count() == 2 and rows.count() == 50
    datasets.write_split(rows, f"file://{tmp_path}/new")
    whole = json.loads(datasets.split_json(rows).first().value)
    assert {k: len(v) for k, v in whole.items()} == {"train_input": 23, "train_target": 23, "val_input": 2, "val_target": 2}
    (tmp_path / "old.json").write_text(json.dumps({**{k: [] for k in whole}, "val_input": ["x"], "other": ["y"]}, indent=2))
    (tmp_path / "bad.json").write_text('{"val_input": []}')
    order = [f"file://{tmp_path}/{n}" for n in ("missing", "new", "old.json")]
    assert sorted(datasets.read_split(spark, *order).collect()) == sorted(rows.collect())
    assert [tuple(r) for r in datasets.read_split(spark, order[0], order[2]).collect()] == [("x", "val", "input")]
    with pytest.raises(ValueError, match="train_input"):
        datasets.read_split(spark, f"file://{tmp_path}/bad.json")
    with pytest.raises(ValueError, match="no split"):
        datasets.read_split(spark, order[0])


def test_patches_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(c, f"i{i}", k, s, [float(k)] * 12) for c in ("stars", "lowres") for i in range(3) for k in range(4) for s in ("input", "target")], "combo string, image_id string, crop_index int, side string, data array<float>")
    out = f"file://{tmp_path}/sink"
    assert datasets.write_patches(rows.where("image_id <> 'i2'"), out) == {"given": 16, "written": 16}
    assert datasets.write_patches(rows, out) == {"given": 24, "written": 8}
    got = datasets.read_patches(spark, out)
    assert got.count() == 48 and got.where("name = 'i2_0003' and combo = 'stars'").count() == 2
    assert got.where("combo = 'stars' and side = 'input'").count() == 12


# star libraries -------------------------------------------------------------------------------------------------------
def test_star_library_files(spark, tmp_path):
    own = np.random.default_rng(4)
    shapes = {0: (3, 2), 1: (1, 4), 5000: (2, 2)}
    stars = spark.createDataFrame([(i, h, w, 0.5, 2.0, "a") for i, (h, w) in shapes.items()], "star_id long, h int, w int, peak double, flux double, source string")
    cells = [(i, y, x, c, float(np.float32(own.random())), float(np.float32(0.1 * y + x))) for i, (h, w) in shapes.items() for y in range(h) for x in range(w) for c in range(3)]
    stamps = spark.createDataFrame(cells, "star_id long, dy int, dx int, c int, rgb double, alpha double")
    dens = spark.createDataFrame([("a", 0.25), ("b", 0.0)], "source string, density double")
    library.write_library(stars, stamps.repartition(5), dens, out := f"file://{tmp_path}/lib")
    listed, back, fields = library.read_library(spark, out)
    assert sorted((r.star_id, r.file, r.h, r.w) for r in listed.collect()) == [(0, "star_000000.npz", 3, 2), (1, "star_000001.npz", 1, 4), (5000, "star_005000.npz", 2, 2)]
    assert sorted(tuple(r) for r in back.collect()) == sorted(cells) and sorted(fields.collect()) == sorted(dens.collect())
    library.write_library(stars.limit(0), stamps.limit(0), dens, out)
    with pytest.raises(ValueError, match="empty"):
        library.read_library(spark, out)


# previews, noise, chains, search ----------------------------------------------------------------------------------------
def pixel_rows(spark, image, name="a"):
    return spark.createDataFrame([(name, *at, float(v)) for at, v in np.ndenumerate(image)], model.PIXELS)


def test_preview_of_masks(spark):
    image = np.zeros((40, 20, 3))
    image[..., 1] = np.arange(800.0).reshape(40, 20)
    valid = np.ones((40, 20), bool)
    valid[:8] = False
    rows = lambda m, name: [(name, y, x, bool(v)) for (y, x), v in np.ndenumerate(m)]
    mask = spark.createDataFrame(rows(valid, "a") + rows(~np.ones((40, 20), bool), "b") + rows(valid, "c"), "image_id string, y int, x int, valid boolean")
    px = pixel_rows(spark, image).union(pixel_rows(spark, image, "b")).union(pixel_rows(spark, image * 0 + 3, "c"))
    got = {}
    for r in overlay.preview(px, mask, 10).collect():
        got.setdefault(r.image_id, {})[r.y, r.x] = (r.red, r.green, r.blue)
    assert all(len(v) == 50 and max(v) == (9, 4) for v in got.values())  # 40 x 20 to 10 x 5
    assert {got["a"][0, x] for x in range(5)} == {overlay.RED} and set(got["b"].values()) == {overlay.RED}
    lo, hi = np.percentile(np.arange(160.0, 800), [1, 99.5])
    block = np.floor(np.clip((image[20:24, 4:8, 1] - lo) / (hi - lo), 0, 1) * 255)
    assert got["a"][5, 1] == (int(block.mean() + 0.5),) * 3 and got["c"][5, 1] == (0, 0, 0)


def test_normals_come_from_their_keys(spark):
    k = spark.range(20000).select(rng.normal(rng.key(1, "a", "id"), rng.key(1, "b", "id")).alias("n"))
    n = np.array([r.n for r in k.collect()])
    assert abs(n.mean()) < 0.03 and abs(n.std() - 1) < 0.03 and abs((n**3).mean()) < 0.1 and abs((n**4).mean() - 3) < 0.25
    again = np.array([r.n for r in spark.range(20000).repartition(7).select("id", rng.normal(rng.key(1, "a", "id"), rng.key(1, "b", "id")).alias("n")).orderBy("id").collect()])
    assert (np.sort(n) == np.sort(again)).all()


def test_chains_have_one_to_three_different_steps(spark):
    images = spark.range(600).select(F.col("id").cast("string").alias("image_id"))
    held = {}
    for r in pretext.chains(images).collect():
        held.setdefault((r.image_id, r.zeroed), []).append((r.step, r.operation))
    assert len(held) == 600 and 30 < sum(z for _, z in held) < 95
    assert {len(v) for v in held.values()} == {1, 2, 3} and all(len({o for _, o in v}) == len(v) and sorted(s for s, _ in v) == list(range(len(v))) for v in held.values())
    first = [o for v in held.values() for s, o in v if s == 0]
    assert all(100 < first.count(o) < 200 for o in pretext.OPERATIONS)


def test_conditions_keep_shape_and_follow_their_chain(spark):
    own = np.random.default_rng(6)
    images = {f"i{k}": own.random((17, 16, 3)) for k in range(6)}
    px = None
    for name, image in images.items():
        px = pixel_rows(spark, image, name) if px is None else px.union(pixel_rows(spark, image, name))
    rows = pretext.conditions(px).collect()
    assert sorted((r.image_id, r.y, r.x, r.c) for r in rows) == sorted((n, y, x, c) for n in images for y in range(17) for x in range(16) for c in range(3))
    again = pretext.conditions(px.repartition(5)).collect()
    assert all(math.isclose(a.v, b.v, abs_tol=1e-9) for a, b in zip(sorted(rows), sorted(again)))
    zeroed = {r.image_id for r in pretext.chains(px.select("image_id").distinct()).where("zeroed").collect()}
    for name, image in images.items():
        got = np.zeros(image.shape)
        for r in rows:
            if r.image_id == name:
                got[r.y, r.x, r.c] = r.v
        assert (got == 0).all() if name in zeroed else 0 < np.abs(got - image).max() <= 1
    spots = pretext.occlusion(pixel_rows(spark, images["i0"])).collect()
    changed = sum(abs(r.v - images["i0"][r.y, r.x, r.c]) > 1e-12 for r in spots)
    assert abs(np.mean([r.v for r in spots]) - images["i0"].mean()) < 1e-9 and 0 < changed <= 3 * 12


def test_grid_search_equals_merging_each_point(spark):
    own = np.random.default_rng(7)
    vectors = own.standard_normal((3, 6, 5)) * np.array([1.0, 2.0, 0.5])[:, None, None]
    rows = [(f"t.{k}", p, i, float(vectors[k, p, i])) for k, p, i in np.ndindex(vectors.shape) if not (k == 2 and p == 0)]
    vectors[2, 0] = 0  # a row that is missing is 0
    df = spark.createDataFrame(rows, "task string, param int, idx int, value double")
    names, products, n = search.gram(df)
    flat = vectors.reshape(3, -1)
    assert names == ["t.0", "t.1", "t.2"] and n == 30 and np.allclose(products, flat @ flat.T)
    values, keep = (0.0, 0.4, 1.0), 6
    points = [[values[c // 3**i % 3] for i in range(3)] for c in range(27)]

    def ranking(cands, size):
        aims = [np.array(f) @ flat for f in search.folders(3, size)]
        mse = np.array([[((np.array(points[c]) @ flat - a) ** 2).mean() for c in cands] for a in aims])
        z = (mse - mse.mean(axis=1, keepdims=True)) / mse.std(axis=1, keepdims=True)
        return dict(zip(cands, z.mean(axis=0)))

    one = ranking(range(27), 1)
    first = sorted(one, key=lambda c: (round(one[c], 9), c))[:keep]
    two = ranking(first, 2)
    found, _ = search.best_weights(df, values, keep)
    got = found.collect()
    assert sorted(r.candidate for r in got) == sorted(first) and all(math.isclose(r.score, two[r.candidate], abs_tol=1e-6) for r in got)
    best = min(first, key=lambda c: (round(two[c], 9), c))
    merged = {(r.param, r.idx): r.value for r in search.merge_best(df, values, keep).collect()}
    want = (np.array(points[best]) @ flat).reshape(6, 5)
    assert all(math.isclose(v, want[k], abs_tol=1e-9) for k, v in merged.items()) and len(merged) == 30
    assert merging.task_arithmetic(df).count() == 30
