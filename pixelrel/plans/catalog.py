"""The registered queries: each a plan over the driver's tables with, where SQL can say it, the same result as SQL.

Rasters come from the embeddings table (one image a label). SQL is put together from named blocks; a query's text names
the blocks it needs. Values are rounded to 6 places on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import pixel, rng
from ..operators import crops, defects, degrade, inject, integral, mask, merging, metrics, overlay, pretext, search, splits, stars, stencil, stretch
from ..operators.joins import shuffled
from ..sources import datasets, files
from ..sources import library as star_files
from ..storage import materialize, new_path
from . import combos

P, N_CROPS, SEED, TRIES = 8, 12, 42, 10
THRESHOLD, MARGIN, SIGMA, STAR, AREA, PAD = 0.0145, 2, 3.0, 0.93, 2, 1

BLOCKS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def block(name: str, text: str) -> None:
    BLOCKS[name] = text


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = _with(sql)
        return f

    return register


def _with(text: str) -> str:
    needed: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & BLOCKS.keys() - needed:
            needed.add(name)
            todo.append(BLOCKS[name])
    parts = [f"{n} AS ({BLOCKS[n]})" for n in BLOCKS if n in needed]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + text


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _key(purpose: str, *parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{SEED}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}, '{purpose}')), 1, 8) AS BIGINT)"


def _reflect(i: str, n: str) -> str:
    m = f"((({i}) % (2*{n})) + 2*{n}) % (2*{n})"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE 2*{n} - 1 - {m} END"


# rasters ------------------------------------------------------------------------------------------------------------
def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw(spark: SparkSession, d: str) -> DataFrame:
    return model.pixels_from_vectors(table(spark, d, "embeddings"))


def stretched(spark: SparkSession, d: str) -> DataFrame:
    return stretch.stretch(raw(spark, d))


def valid(spark: SparkSession, d: str) -> DataFrame:
    return mask.validity_mask(raw(spark, d), THRESHOLD)


def written(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stretched frames and their masks as tables, for queries that read them more than once."""
    rows = materialize(raw(spark, d), "raw")
    return materialize(stretch.stretch(rows), "frames"), materialize(mask.validity_mask(rows, THRESHOLD), "masks")


block("vectors", "SELECT CAST(label AS VARCHAR) AS image_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS y, embedding FROM embeddings")
block("places", "SELECT CAST(unnest(range(63)) AS INTEGER) AS p")
block("pixels", "SELECT image_id, y, p // 3 AS x, p % 3 AS c, CAST(embedding[p + 1] AS DOUBLE) AS v FROM vectors, places")
block("dims", "SELECT image_id, max(y) + 1 AS height, max(x) + 1 AS width FROM pixels GROUP BY image_id")
block("params", "SELECT image_id, c, b AS black, CASE WHEN w <= b THEN b + 1e-10 ELSE w END AS white FROM (SELECT image_id, c, quantile_cont(v, 0.01) AS b, quantile_cont(v, 0.997) AS w FROM pixels GROUP BY ALL)")
block("stretched", "SELECT image_id, y, x, c, asinh(8 * greatest(0, least(1, (v - black) / (white - black)))) / asinh(8) AS v FROM pixels JOIN params USING (image_id, c)")


@query("pixels", f"SELECT image_id, y, x, c, {s6('v')} FROM pixels")
def _(spark, d):
    return raw(spark, d).select("image_id", "y", "x", "c", *r6("v"))


@query("stretch_params", f"SELECT image_id, c, {s6('black', 'white')} FROM params")
def _(spark, d):
    return stretch.stretch_params(raw(spark, d)).select("image_id", "c", *r6("black", "white"))


@query("stretch_params_linked", f"SELECT image_id, c, {s6('black', 'white')} FROM (SELECT image_id, quantile_cont(v, 0.01) AS black, quantile_cont(v, 0.997) AS white FROM pixels GROUP BY ALL), (SELECT CAST(unnest(range(3)) AS INTEGER) AS c)")
def _(spark, d):
    return stretch.stretch_params(raw(spark, d), linked=True).select("image_id", "c", *r6("black", "white"))


@query("stretch_pixels", f"SELECT image_id, y, x, c, {s6('v')} FROM stretched")
def _(spark, d):
    return stretched(spark, d).select("image_id", "y", "x", "c", *r6("v"))


@query("stretch_summary", "SELECT image_id, round(avg(v), 6) AS mean, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM stretched GROUP BY image_id")
def stretch_summary(spark, d):
    return stretched(spark, d).groupBy("image_id").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.min("v"), 6).alias("lo"), F.round(F.max("v"), 6).alias("hi"))


@query("stretch_paired", f"SELECT image_id, y, x, c, {s6('v')}, 'noisy' AS side FROM stretched UNION ALL SELECT image_id, y, x, c, round(asinh(8 * greatest(0, least(1, (v * 0.5 - black) / (white - black)))) / asinh(8), 6), 'paired' FROM pixels JOIN params USING (image_id, c)")
def _(spark, d):
    noisy = raw(spark, d)
    return stretch.stretch_paired(noisy, noisy.withColumn("v", F.col("v") * 0.5)).select("image_id", "y", "x", "c", *r6("v"), "side")


# masks --------------------------------------------------------------------------------------------------------------
block("offs16", "SELECT CAST(unnest(range(-8, 8)) AS INTEGER) AS o")
block("green", "SELECT * FROM pixels WHERE c = 1")
block("boxy", f"SELECT p.image_id, p.y, p.x, avg(q.v) AS m, avg(q.v * q.v) AS q FROM green p JOIN dims d USING (image_id) CROSS JOIN offs16 JOIN green q ON q.image_id = p.image_id AND q.x = p.x AND q.y = {_reflect('p.y + o', 'd.height')} GROUP BY ALL")
block("boxes16", f"SELECT p.image_id, p.y, p.x, avg(q.m) AS mean, greatest(0, avg(q.q) - avg(q.m) * avg(q.m)) AS var FROM boxy p JOIN dims d USING (image_id) CROSS JOIN offs16 JOIN boxy q ON q.image_id = p.image_id AND q.y = p.y AND q.x = {_reflect('p.x + o', 'd.width')} GROUP BY ALL")
block("mask", f"SELECT image_id, y, x, var > {THRESHOLD} AS valid FROM boxes16")


@query("box_mean", f"SELECT image_id, y, x, {s6('mean', 'var')} FROM boxes16")
def _(spark, d):
    return mask.local_variance(raw(spark, d)).select("image_id", "y", "x", *r6("mean", "var"))


@query("valid_mask", "SELECT image_id, y, x, valid FROM mask")
def _(spark, d):
    return valid(spark, d)


@query("mask_margin", f"SELECT image_id, y, x, valid AND y >= {MARGIN} AND x >= {MARGIN} AND y < height - {MARGIN} AND x < width - {MARGIN} AS valid FROM mask JOIN dims USING (image_id)")
def _(spark, d):
    return mask.validity_mask(raw(spark, d), THRESHOLD, margin=MARGIN)


@query("valid_fraction", "SELECT image_id, round(100 * avg(CAST(valid AS INTEGER)), 6) AS valid_pct, count(*) FILTER (valid) AS valid_area FROM mask GROUP BY image_id")
def _(spark, d):
    return mask.valid_fraction(valid(spark, d)).select("image_id", *r6("valid_pct"), "valid_area")


# prefix sums and candidates -------------------------------------------------------------------------------------------
@query("prefix_sum", "SELECT image_id, y, x, CAST(sum(s) OVER (PARTITION BY image_id, y ORDER BY x) AS BIGINT) AS sat FROM (SELECT image_id, y, x, sum(CAST(valid AS BIGINT)) OVER (PARTITION BY image_id, x ORDER BY y) AS s FROM mask)")
def _(spark, d):
    return integral.prefix_sum(valid(spark, d).withColumn("n", F.col("valid").cast("long")), "n").select("image_id", "y", "x", "sat")


_SQUARE = f"q.y >= p.y AND q.y < p.y + {P} AND q.x >= p.x AND q.x < p.x + {P}"
block("patchsum", f"SELECT p.image_id, p.y, p.x, CAST(count(*) FILTER (q.valid) AS BIGINT) AS n FROM mask p JOIN dims d USING (image_id) JOIN mask q ON q.image_id = p.image_id AND {_SQUARE} WHERE p.y < height - {P} AND p.x < width - {P} GROUP BY ALL")
block("origins", f"SELECT image_id, y, x FROM patchsum WHERE n = {P * P}")
block("patchstat", f"SELECT p.image_id, p.y, p.x, avg(q.v) AS mean, var_pop(q.v) AS var FROM mask p JOIN dims d USING (image_id) JOIN stretched q ON q.image_id = p.image_id AND {_SQUARE} WHERE p.y <= height - {P} AND p.x <= width - {P} GROUP BY ALL")


@query("patch_sum", "SELECT image_id, y, x, n FROM patchsum")
def _(spark, d):
    return integral.patch_sums(valid(spark, d).withColumn("n", F.col("valid").cast("long")), P, "n")


@query("candidates", "SELECT image_id, y, x FROM origins")
def _(spark, d):
    return integral.candidates(valid(spark, d), P)


@query("patch_quality", f"SELECT image_id, y, x, {s6('mean', 'var')}, mean >= 0.05 AND var >= 1e-5 AS good FROM patchstat")
def _(spark, d):
    return integral.patch_stats(stretched(spark, d), P).select("image_id", "y", "x", *r6("mean", "var"), integral.good().alias("good"))


# defects ------------------------------------------------------------------------------------------------------------
block("offs5", "SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS o")
block("medians", f"SELECT p.image_id, p.y, p.x, p.c, any_value(p.v) AS v, median(q.v) AS med FROM stretched p JOIN dims d USING (image_id) CROSS JOIN offs5 a CROSS JOIN offs5 b JOIN stretched q ON q.image_id = p.image_id AND q.c = p.c AND q.y = {_reflect('p.y + a.o', 'd.height')} AND q.x = {_reflect('p.x + b.o', 'd.width')} GROUP BY p.image_id, p.y, p.x, p.c")
block("residual", "SELECT m.*, v - med AS res, valid FROM medians m JOIN mask USING (image_id, y, x)")
block("mids", "SELECT image_id, c, median(res) FILTER (valid) AS mid FROM residual GROUP BY ALL")
block("sigmas", "SELECT image_id, c, coalesce(1.4826 * median(abs(res - mid)) FILTER (valid), 0) AS sigma FROM residual JOIN mids USING (image_id, c) GROUP BY ALL")
block("flagged", f"SELECT image_id, y, x, c, v, med, valid AND sigma > 0 AND abs(res) > {SIGMA} * sigma AS bad FROM residual JOIN sigmas USING (image_id, c)")
block("corrected", "SELECT image_id, y, x, c, CASE WHEN bad THEN med ELSE v END AS v FROM flagged")
block("differs", "SELECT a.image_id, a.y, a.x FROM stretched a JOIN corrected b USING (image_id, y, x, c) GROUP BY ALL HAVING sum(abs(a.v - b.v)) > 1e-6")
block("composite", "SELECT image_id, y, x, c, v * 0.5 AS v FROM corrected")


def found(spark, d, grow: int = 0) -> DataFrame:
    return defects.detect(stretched(spark, d), valid(spark, d), SIGMA, grow)


def repaired(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames, masks and corrected frames, each written once."""
    frame, where = written(spark, d)
    return frame, where, materialize(defects.correct(defects.detect(frame, where, SIGMA)), "corrected")


@query("local_median", f"SELECT image_id, y, x, c, {s6('med')} FROM medians")
def _(spark, d):
    return stencil.local_median(stretched(spark, d)).select("image_id", "y", "x", "c", *r6("med"))


@query("robust_sigma", f"SELECT image_id, c, {s6('sigma')} FROM sigmas")
def _(spark, d):
    return defects.robust_sigma(materialize(defects.residuals(stretched(spark, d), valid(spark, d)), "residuals")).select("image_id", "c", *r6("sigma"))


@query("defect_flags", "SELECT image_id, y, x, c FROM flagged WHERE bad")
def _(spark, d):
    return found(spark, d).where("bad").select("image_id", "y", "x", "c")


@query("defect_counts", "SELECT image_id, count(*) FILTER (bad) AS n_bad, round(100 * avg(CAST(bad AS INTEGER)), 6) AS bad_pct FROM (SELECT image_id, y, x, bool_or(bad) AS bad FROM flagged GROUP BY ALL) GROUP BY image_id")
def _(spark, d):
    return defects.counts(found(spark, d)).select("image_id", "n_bad", *r6("bad_pct"))


@query("corrected_pixels", f"SELECT image_id, y, x, c, {s6('v')} FROM corrected")
def _(spark, d):
    return defects.correct(found(spark, d)).select("image_id", "y", "x", "c", *r6("v"))


@query("dilated_mask", "SELECT DISTINCT image_id, f.y + a AS y, f.x + b AS x, c FROM flagged f JOIN dims USING (image_id) CROSS JOIN (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS a) CROSS JOIN (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS b) WHERE bad AND abs(a) + abs(b) <= 2 AND f.y + a >= 0 AND f.x + b >= 0 AND f.y + a < height AND f.x + b < width")
def _(spark, d):
    return found(spark, d, grow=2).where("bad").select("image_id", "y", "x", "c")


def _transplant(spark, d, how: str) -> DataFrame:
    source, _, fixed = repaired(spark, d)
    return defects.transplant(fixed.withColumn("v", F.col("v") * 0.5), source, fixed, how).select("image_id", "y", "x", "c", *r6("v"))


_MOVED = "SELECT k.image_id, k.y, k.x, k.c, round(CASE WHEN t.image_id IS NOT NULL THEN {} ELSE k.v END, 6) AS v FROM composite k JOIN stretched o USING (image_id, y, x, c) JOIN corrected f USING (image_id, y, x, c) LEFT JOIN differs t ON t.image_id = k.image_id AND t.y = k.y AND t.x = k.x"


@query("defect_delta_replace", _MOVED.format("o.v"))
def _(spark, d):
    return _transplant(spark, d, "replace")


@query("defect_delta_additive", _MOVED.format("k.v + o.v - f.v"))
def _(spark, d):
    return _transplant(spark, d, "additive")


# quantising ---------------------------------------------------------------------------------------------------------
@query("quantise_trunc", "SELECT image_id, y, x, c, CAST(floor(least(65535, greatest(0, round(v, 9) * 65535))) AS INTEGER) AS q FROM stretched")
def _(spark, d):
    return stretched(spark, d).select("image_id", "y", "x", "c", pixel.quantise_truncating(F.round("v", 9)).alias("q"))


@query("quantise_rint", "SELECT image_id, y, x, c, CAST(round_even(greatest(0, least(1, round(v, 9))) * 65535, 0) AS INTEGER) AS q FROM stretched")
def _(spark, d):
    return stretched(spark, d).select("image_id", "y", "x", "c", pixel.quantise_rounding(F.round("v", 9)).alias("q"))


@query("to_u8", "SELECT image_id, y, x, c, CAST(floor(least(255, greatest(0, round(v, 9) * 255))) AS INTEGER) AS q FROM stretched")
def _(spark, d):
    return stretched(spark, d).select("image_id", "y", "x", "c", pixel.quantise_truncating(F.round("v", 9), 255).alias("q"))


@query("dequantise", "SELECT image_id, y, x, c, round(floor(least(65535, greatest(0, round(v, 9) * 65535))) / 65535, 6) AS v FROM stretched")
def _(spark, d):
    return combos.requantised(stretched(spark, d).withColumn("v", F.round("v", 9))).select("image_id", "y", "x", "c", *r6("v"))


# low resolution -----------------------------------------------------------------------------------------------------
block("taps", "SELECT d, exp(-0.5 * (d / 1.5) ** 2) / sum(exp(-0.5 * (d / 1.5) ** 2)) OVER () AS t FROM (SELECT CAST(unnest(range(-6, 7)) AS INTEGER) AS d)")
block("blury", f"SELECT p.image_id, p.y, p.x, p.c, sum(q.v * t) AS v FROM stretched p JOIN dims s USING (image_id) CROSS JOIN taps JOIN stretched q ON q.image_id = p.image_id AND q.c = p.c AND q.x = p.x AND q.y = {_reflect('p.y + d', 's.height')} GROUP BY ALL")
block("blurred", f"SELECT p.image_id, p.y, p.x, p.c, sum(q.v * t) AS v FROM blury p JOIN dims s USING (image_id) CROSS JOIN taps JOIN blury q ON q.image_id = p.image_id AND q.c = p.c AND q.y = p.y AND q.x = {_reflect('p.x + d', 's.width')} GROUP BY ALL")


@query("gaussian_blur", f"SELECT image_id, y, x, c, {s6('v')} FROM blurred")
def _(spark, d):
    return stencil.gaussian(stretched(spark, d), 1.5).select("image_id", "y", "x", "c", *r6("v"))


def _mirror(i: str, n: str) -> str:
    m = f"((({i}) % greatest(1, 2*{n} - 2)) + greatest(1, 2*{n} - 2)) % greatest(1, 2*{n} - 2)"
    return f"CASE WHEN {n} = 1 THEN 0 WHEN {m} < {n} THEN {m} ELSE 2*{n} - 2 - {m} END"


block("kernel", "SELECT d, -6 * z / (1 - z * z) * z ** abs(d) AS h FROM (SELECT CAST(unnest(range(-30, 31)) AS INTEGER) AS d, sqrt(3.0) - 2 AS z)")
block("spots", "SELECT CAST(unnest(range(-1, 3)) AS INTEGER) AS s")


def _zoom_blocks(name: str, source: str, sizes: str) -> None:
    """Blocks name_cy, name_y, name_cx and name: source at new sizes (n_y, n_x to m_y, m_x), clipped."""
    for axis, other, src, out in (("y", "x", source, f"{name}_y"), ("x", "y", f"{name}_y", f"{name}_x")):
        n, m = f"z.n_{axis}", f"z.m_{axis}"
        block(f"{name}_c{axis}", f"SELECT p.image_id, p.y, p.x, p.c, sum(q.v * h) AS v FROM {src} p JOIN {sizes} z USING (image_id) CROSS JOIN kernel JOIN {src} q ON q.image_id = p.image_id AND q.c = p.c AND q.{other} = p.{other} AND q.{axis} = {_mirror(f'p.{axis} + d', n)} GROUP BY ALL")
        single = f"{n} = 1 OR {m} = 1"
        block(f"{name}_j{axis}", f"SELECT *, CASE WHEN one THEN 0.0 ELSE (j * (n - 1) - b * (m - 1)) / (m - 1) END AS t FROM (SELECT *, CASE WHEN one THEN 0 ELSE j * (n - 1) // (m - 1) END AS b FROM (SELECT z.image_id, {n} AS n, {m} AS m, {single} AS one, CAST(unnest(range({m})) AS INTEGER) AS j FROM {sizes} z))")
        weight = "CASE s WHEN -1 THEN (1 - t) ** 3 WHEN 0 THEN 3 * t ** 3 - 6 * t ** 2 + 4 WHEN 1 THEN -3 * t ** 3 + 3 * t ** 2 + 3 * t + 1 ELSE t ** 3 END / 6"
        block(out, f"SELECT g.image_id, g.j AS {axis}, q.{other}, q.c, sum(q.v * {weight}) AS v FROM {name}_j{axis} g CROSS JOIN spots JOIN {name}_c{axis} q ON q.image_id = g.image_id AND q.{axis} = {_mirror('g.b + s', 'g.n')} GROUP BY g.image_id, g.j, q.{other}, q.c")
    block(name, f"SELECT image_id, y, x, c, greatest(0, least(1, v)) AS v FROM {name}_x")


def _degrade_blocks(name: str, blurred: str) -> None:
    _zoom_blocks(f"{name}down", blurred, "shrunk")
    _zoom_blocks(name, f"{name}down", "grown")


block("shrunk", "SELECT image_id, height AS n_y, width AS n_x, CAST(greatest(1, round_even(height / 4, 0)) AS INTEGER) AS m_y, CAST(greatest(1, round_even(width / 4, 0)) AS INTEGER) AS m_x FROM dims")
block("grown", "SELECT image_id, m_y AS n_y, m_x AS n_x, n_y AS m_y, n_x AS m_x FROM shrunk")
_zoom_blocks("smaller", "stretched", "shrunk")
_degrade_blocks("lowered", "blurred")


@query("spline_down", f"SELECT image_id, y, x, c, {s6('v')} FROM smaller")
def _(spark, d):
    return degrade.zoom_down(materialize(stretched(spark, d), "frames")).select("image_id", "y", "x", "c", *r6("v"))


@query("spline_roundtrip", f"SELECT image_id, y, x, c, {s6('v')} FROM lowered")
def _(spark, d):
    return degrade.degrade(materialize(stretched(spark, d), "frames")).select("image_id", "y", "x", "c", *r6("v"))


@query("match_shape", f"SELECT g.image_id, g.y, g.x, g.c, round(coalesce(s.v, 0), 6) AS v FROM (SELECT image_id, y, x, c FROM (SELECT image_id, CAST(unnest(range(height + 2)) AS INTEGER) AS y FROM dims) JOIN (SELECT image_id, CAST(unnest(range(width - 3)) AS INTEGER) AS x FROM dims) USING (image_id) CROSS JOIN (SELECT CAST(unnest(range(3)) AS INTEGER) AS c)) g LEFT JOIN stretched s USING (image_id, y, x, c)")
def _(spark, d):
    source = stretched(spark, d)
    target = model.dims(source).select("image_id", (F.col("height") + 2).alias("height"), (F.col("width") - 3).alias("width"))
    return degrade.match_shape(source, target).select("image_id", "y", "x", "c", *r6("v"))


# crops --------------------------------------------------------------------------------------------------------------
block("ranked", "SELECT image_id, y, x, row_number() OVER (PARTITION BY image_id ORDER BY y, x) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM origins")
block("tries", f"SELECT image_id, n, crop_index, attempt FROM (SELECT DISTINCT image_id, n FROM ranked) CROSS JOIN (SELECT CAST(unnest(range({N_CROPS})) AS INTEGER) AS crop_index) CROSS JOIN (SELECT CAST(unnest(range({TRIES})) AS INTEGER) AS attempt)")
block("accepted", f"SELECT t.image_id, crop_index, arg_min(r.y, attempt) AS y, arg_min(r.x, attempt) AS x FROM tries t JOIN ranked r ON r.image_id = t.image_id AND r.k = {_key('position', 't.image_id', 'crop_index', 'attempt')} % t.n JOIN patchstat s ON s.image_id = r.image_id AND s.y = r.y AND s.x = r.x WHERE mean >= 0.05 AND var >= 1e-5 GROUP BY ALL")
_AUG = _key("augment", "image_id", "crop_index")
block("crops", f"SELECT *, {_AUG} & 1 = 1 AS flip_h, ({_AUG} >> 1) & 1 = 1 AS flip_v, CAST(({_AUG} >> 2) & 3 AS INTEGER) AS rot_k FROM accepted")
_FX = f"CASE WHEN flip_h THEN {P - 1} - (q.x - k.x) ELSE q.x - k.x END"
_FY = f"CASE WHEN flip_v THEN {P - 1} - (q.y - k.y) ELSE q.y - k.y END"
_CUT = (
    "SELECT image_id, crop_index, CASE rot_k WHEN 1 THEN {m} - fx WHEN 2 THEN {m} - fy WHEN 3 THEN fx ELSE fy END AS y, CASE rot_k WHEN 1 THEN fy WHEN 2 THEN {m} - fx WHEN 3 THEN {m} - fy ELSE fx END AS x, c, v "
    "FROM (SELECT k.image_id, crop_index, rot_k, q.c, q.v, {fx} AS fx, {fy} AS fy FROM crops k JOIN {src} q ON q.image_id = k.image_id AND q.y >= k.y AND q.y < k.y + {p} AND q.x >= k.x AND q.x < k.x + {p})"
)
block("cut", _CUT.format(m=P - 1, fx=_FX, fy=_FY, src="stretched", p=P))
block("cutfixed", _CUT.format(m=P - 1, fx=_FX, fy=_FY, src="corrected", p=P))


def manifest(frame: DataFrame, where: DataFrame) -> DataFrame:
    return crops.crop_manifest(frame, where, P, N_CROPS, SEED, TRIES)


@query("crop_manifest", "SELECT image_id, crop_index, y, x, flip_h, flip_v, rot_k FROM crops")
def _(spark, d):
    return manifest(*written(spark, d))


@query("crop_extract", f"SELECT image_id, crop_index, y, x, c, {s6('v')} FROM cut")
def _(spark, d):
    frame, where = written(spark, d)
    return crops.extract(frame, manifest(frame, where), P).select("image_id", "crop_index", "y", "x", "c", *r6("v"))


@query("augment_remap", "SELECT image_id, crop_index, CAST(sum(x + 10 * y) AS BIGINT) AS total, CAST(count(DISTINCT (y, x)) AS BIGINT) AS cells FROM cut GROUP BY ALL")
def _(spark, d):
    frame, where = written(spark, d)
    cut = crops.extract(frame, manifest(frame, where), P)
    return cut.groupBy("image_id", "crop_index").agg(F.sum((F.col("x") + F.col("y") * 10).cast("long")).alias("total"), F.count_distinct("y", "x").alias("cells"))


block("moved", "SELECT image_id, crop_index, y + 3 * (crop_index % 4) AS y, x FROM crops")


@query("crop_rejects", f"SELECT image_id, crop_index, 'out of bounds' AS reason FROM moved JOIN (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM pixels GROUP BY image_id) USING (image_id) WHERE y + {P} > h OR x + {P} > w")
def _(spark, d):
    moved = manifest(*written(spark, d)).withColumn("y", F.col("y") + 3 * (F.col("crop_index") % 4))
    return crops.rejected(moved, model.dims(raw(spark, d)), P)


@query(
    "shape_rejects",
    "SELECT image_id, CASE WHEN t IS NULL THEN 'no target' WHEN t <> h THEN 'target of another shape' END AS reason FROM (SELECT image_id, max(y) AS h, max(y) FILTER (y < 45 AND image_id <> '3') AS t FROM pixels GROUP BY image_id) WHERE t IS NULL OR t <> h",
)
def _(spark, d):
    rows = raw(spark, d)
    return crops.shape_rejects(rows, P, target=rows.where((F.col("y") < 45) & (F.col("image_id") != "3")))


@query("without_prefix", "SELECT page_id, CASE WHEN (SELECT bool_and(starts_with(url, 'http')) FROM pages) THEN url[5:] ELSE url END AS url FROM pages")
def _(spark, d):
    return merging.without_prefix(table(spark, d, "pages").select("page_id", "url"), "url", "http")


_SIDES = "SELECT image_id, crop_index, y, x, c, round(v, 6) + 0.0 AS v, 'input' AS side FROM {a} UNION ALL SELECT image_id, crop_index, y, x, c, round(v, 6) + 0.0, 'target' FROM {b}"
PAIR = ["image_id", "crop_index", "y", "x", "c"]


@query("pairs_sr", _SIDES.format(a="cut", b="cutfixed"))
def _(spark, d):
    frame, where, fixed = repaired(spark, d)
    return crops.built_pairs(frame, fixed, where, P, N_CROPS, SEED, TRIES).select(*PAIR, *r6("v"), "side")


block("sustat", f"SELECT p.image_id, p.y, p.x, avg(q.v) AS mean, var_pop(q.v) AS var FROM mask p JOIN dims d USING (image_id) JOIN blurred q ON q.image_id = p.image_id AND {_SQUARE} WHERE p.y <= height - {P} AND p.x <= width - {P} GROUP BY ALL")
block("suaccepted", f"SELECT t.image_id, crop_index, arg_min(r.y, attempt) AS y, arg_min(r.x, attempt) AS x FROM tries t JOIN ranked r ON r.image_id = t.image_id AND r.k = {_key('position', 't.image_id', 'crop_index', 'attempt')} % t.n JOIN sustat s ON s.image_id = r.image_id AND s.y = r.y AND s.x = r.x WHERE mean >= 0.05 AND var >= 1e-5 GROUP BY ALL")
block("sucrops", f"SELECT *, {_AUG} & 1 = 1 AS flip_h, ({_AUG} >> 1) & 1 = 1 AS flip_v, CAST(({_AUG} >> 2) & 3 AS INTEGER) AS rot_k FROM suaccepted")
block("sulow", _CUT.replace("FROM crops k", "FROM sucrops k").format(m=P - 1, fx=_FX, fy=_FY, src="blurred", p=P))
block("sufull", _CUT.replace("FROM crops k", "FROM sucrops k").format(m=P - 1, fx=_FX, fy=_FY, src="stretched", p=P))


@query("pairs_su", _SIDES.format(a="sulow", b="sufull"))
def _(spark, d):
    """The gate looks at the blurred side."""
    frame, where = written(spark, d)
    return crops.built_pairs(materialize(stencil.gaussian(frame, 1.5), "low"), frame, where, P, N_CROPS, SEED, TRIES).select(*PAIR, *r6("v"), "side")


@query("patch_names", "SELECT image_id, crop_index, image_id || '_' || lpad(CAST(crop_index AS VARCHAR), 4, '0') AS name, CAST(count(*) AS INTEGER) AS n, round(sum(v), 3) AS total FROM cut GROUP BY ALL")
def _(spark, d):
    frame, where = written(spark, d)
    made = crops.patches(frame, manifest(frame, where), P)
    return made.select("image_id", "crop_index", "name", F.size("data").alias("n"), F.round(F.aggregate("data", F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


block("rich", f"SELECT o.image_id, o.y, o.x FROM origins o JOIN differs t ON t.image_id = o.image_id AND t.y >= o.y AND t.y < o.y + {P} AND t.x >= o.x AND t.x < o.x + {P} GROUP BY ALL")
block("richranked", "SELECT image_id, y, x, row_number() OVER (PARTITION BY image_id ORDER BY y, x) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM rich")
block("wanting", f"SELECT t.*, r.m, r.m IS NOT NULL AND {_key('pool', 't.image_id', 'crop_index')} / 4294967296.0 < 0.8 AS from_rich FROM tries t LEFT JOIN (SELECT DISTINCT image_id, n AS m FROM richranked) r ON r.image_id = t.image_id")
block("drawn", f"SELECT t.image_id, crop_index, attempt, from_rich, CASE WHEN from_rich THEN b.y ELSE a.y END AS y, CASE WHEN from_rich THEN b.x ELSE a.x END AS x FROM (SELECT *, {_key('position', 'image_id', 'crop_index', 'attempt')} AS h FROM wanting) t LEFT JOIN ranked a ON a.image_id = t.image_id AND a.k = h % t.n LEFT JOIN richranked b ON b.image_id = t.image_id AND b.k = h % t.m")


@query("defect_biased_crops", "SELECT image_id, crop_index, from_rich, arg_min(d.y, attempt) AS y, arg_min(d.x, attempt) AS x FROM drawn d JOIN patchstat s USING (image_id, y, x) WHERE mean >= 0.05 AND var >= 1e-5 GROUP BY ALL")
def _(spark, d):
    frame, where, fixed = repaired(spark, d)
    return crops.defect_biased_crops(frame, defects.difference(frame, fixed), where, P, N_CROPS, SEED, TRIES).select("image_id", "crop_index", "from_rich", "y", "x")


block("iraccepted", "SELECT image_id, crop_index, arg_min(d.y, attempt) AS y, arg_min(d.x, attempt) AS x FROM drawn d JOIN patchstat s USING (image_id, y, x) WHERE mean >= 0.05 AND var >= 1e-5 GROUP BY ALL")
block("ircrops", f"SELECT *, {_AUG} & 1 = 1 AS flip_h, ({_AUG} >> 1) & 1 = 1 AS flip_v, CAST(({_AUG} >> 2) & 3 AS INTEGER) AS rot_k FROM iraccepted")
block("irbad", _CUT.replace("FROM crops k", "FROM ircrops k").format(m=P - 1, fx=_FX, fy=_FY, src="stretched", p=P))
block("irfixed", _CUT.replace("FROM crops k", "FROM ircrops k").format(m=P - 1, fx=_FX, fy=_FY, src="corrected", p=P))


@query("pairs_ir", _SIDES.format(a="irbad", b="irfixed"))
def _(spark, d):
    """Four fifths of the crops are drawn where defects are."""
    frame, where, fixed = repaired(spark, d)
    return crops.built_pairs(frame, fixed, where, P, N_CROPS, SEED, TRIES, crops.DEFECT_RATIO).select(*PAIR, *r6("v"), "side")


# stars --------------------------------------------------------------------------------------------------------------
block("bright", f"SELECT image_id, y, x, v AS alpha, y * 1000 + x AS id FROM stretched WHERE c = 0 AND v > {STAR}")
block("reach", "SELECT image_id, id, id AS seen, y, x FROM bright UNION SELECT r.image_id, r.id, b.id, b.y, b.x FROM reach r JOIN bright b ON b.image_id = r.image_id AND abs(b.y - r.y) + abs(b.x - r.x) = 1")
block("roots", "SELECT image_id, id, min(seen) AS root FROM reach GROUP BY ALL")
block("labelled", "SELECT b.image_id, b.y, b.x, b.alpha, CAST(dense_rank() OVER (PARTITION BY b.image_id ORDER BY root) AS INTEGER) AS label FROM bright b JOIN roots r USING (image_id, id)")
block("allboxes", f"SELECT image_id, label, count(*) AS area, greatest(min(y) - {PAD}, 0) AS y0, least(max(y) + 1 + {PAD}, any_value(height)) AS y1, greatest(min(x) - {PAD}, 0) AS x0, least(max(x) + 1 + {PAD}, any_value(width)) AS x1 FROM labelled JOIN dims USING (image_id) GROUP BY image_id, label HAVING count(*) >= {AREA}")
block("starboxes", "SELECT * FROM allboxes b WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.image_id = b.image_id AND NOT m.valid AND m.y >= y0 AND m.y < y1 AND m.x >= x0 AND m.x < x1)")
block("stampcells", "SELECT b.image_id, b.label, s.y - b.y0 AS dy, s.x - b.x0 AS dx, s.c, s.v AS rgb, coalesce(l.alpha, 0) AS alpha FROM starboxes b JOIN stretched s ON s.image_id = b.image_id AND s.y >= y0 AND s.y < y1 AND s.x >= x0 AND s.x < x1 LEFT JOIN labelled l ON l.image_id = s.image_id AND l.y = s.y AND l.x = s.x AND l.label = b.label")
block("starstats", "SELECT image_id, label, max(rgb * alpha) AS peak, sum(rgb * alpha) AS flux FROM stampcells GROUP BY ALL")
block("starlist", "SELECT row_number() OVER (ORDER BY image_id, label) - 1 AS star_id, y1 - y0 AS h, x1 - x0 AS w, peak, flux, image_id AS source, label FROM starstats JOIN starboxes USING (image_id, label)")
block("areas", "SELECT image_id AS source, count(*) FILTER (valid) AS area FROM mask GROUP BY ALL")
block("dens", "SELECT a.source, count(s.star_id) / a.area AS density FROM areas a LEFT JOIN starlist s USING (source) WHERE a.area > 0 GROUP BY a.source, a.area")


def soft(frame: DataFrame) -> DataFrame:
    return frame.where("c = 0").select("image_id", "y", "x", F.col("v").alias("alpha"))


def library(frame: DataFrame, where: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The star catalogue and its stamps (star_id, dy, dx, c, rgb, alpha), each written once."""
    labelled = materialize(stars.components(soft(frame), STAR), "labelled")
    boxes = materialize(stars.boxes(labelled, model.dims(frame), where, AREA, PAD), "boxes")
    cut = materialize(stars.stamps(frame, labelled, boxes), "stamps")
    listed = materialize(stars.catalogue(cut, boxes), "stars")
    named = cut.join(shuffled(listed.select("star_id", F.col("source").alias("image_id"), "label")), ["image_id", "label"])
    return listed, named.select("star_id", "dy", "dx", "c", "rgb", "alpha")


@query("components", f"SELECT image_id, y, x, {s6('alpha')}, label FROM labelled")
def _(spark, d):
    return stars.components(soft(stretched(spark, d)), STAR).select("image_id", "y", "x", *r6("alpha"), "label")


@query("star_catalogue", f"SELECT star_id, h, w, {s6('peak', 'flux')}, source, label FROM starlist")
def _(spark, d):
    return library(*written(spark, d))[0].select("star_id", "h", "w", *r6("peak", "flux"), "source", "label")


@query("star_stamps", f"SELECT star_id, dy, dx, c, {s6('rgb', 'alpha')} FROM stampcells t JOIN starlist s ON s.source = t.image_id AND s.label = t.label")
def _(spark, d):
    return library(*written(spark, d))[1].select("star_id", "dy", "dx", "c", *r6("rgb", "alpha"))


def _densities(spark, d) -> DataFrame:
    frame, where = written(spark, d)
    return stars.densities(library(frame, where)[0], mask.valid_fraction(where).select("image_id", "valid_area"))


@query("field_density", f"SELECT source, {s6('density')} FROM dens")
def _(spark, d):
    return _densities(spark, d).select("source", *r6("density"))


@query("density_stats", "SELECT round(avg(density), 6) AS mean, round(min(density), 6) AS lo, round(max(density), 6) AS hi FROM dens")
def _(spark, d):
    return _densities(spark, d).agg(F.round(F.avg("density"), 6).alias("mean"), F.round(F.min("density"), 6).alias("lo"), F.round(F.max("density"), 6).alias("hi"))


def _hashed(size: DataFrame, listed: DataFrame) -> DataFrame:
    """Ten placements an image, all drawn by hash, without separation."""
    rows = size.withColumn("n", F.lit(listed.count())).select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("seq"))
    k = lambda purpose: rng.key(SEED, purpose, "image_id", "seq")
    turn = k("turn")
    drawn = rows.select(
        "image_id", "seq", rng.choice(k("star"), F.col("n")).alias("star_id"), rng.choice(k("cy"), F.col("height")).cast("int").alias("cy"), rng.choice(k("cx"), F.col("width")).cast("int").alias("cx"),
        (rng.bits(turn, 0) == 1).alias("flip_h"), (rng.bits(turn, 1) == 1).alias("flip_v"), rng.bits(turn, 2, 2).alias("rot_k"), (1 + (rng.uniform(k("light")) * 2 - 1) * inject.JITTER).alias("scale"),
    )
    return drawn.join(listed.select("star_id", (F.greatest("h", "w") / 2).alias("radius")), "star_id")


_T = _key("turn", "image_id", "seq")
block("nstars", "SELECT count(*) AS n FROM starlist")
block("hashed", f"SELECT image_id, seq, {_key('star', 'image_id', 'seq')} % n AS star_id, {_key('cy', 'image_id', 'seq')} % height AS cy, {_key('cx', 'image_id', 'seq')} % width AS cx, {_T} & 1 = 1 AS flip_h, ({_T} >> 1) & 1 = 1 AS flip_v, ({_T} >> 2) & 3 AS rot_k, 1 + ({_key('light', 'image_id', 'seq')} / 4294967296.0 * 2 - 1) * 0.15 AS scale FROM dims CROSS JOIN nstars CROSS JOIN (SELECT CAST(unnest(range(10)) AS INTEGER) AS seq)")
block("placed", "SELECT p.*, s.h, s.w, greatest(s.h, s.w) / 2 AS radius FROM hashed p JOIN starlist s USING (star_id)")
block("turnedcells", "SELECT p.image_id, p.cy, p.cx, p.h, p.w, p.rot_k, p.scale, t.c, t.rgb, t.alpha, CASE WHEN flip_v THEN p.h - 1 - dy ELSE dy END AS fy, CASE WHEN flip_h THEN p.w - 1 - dx ELSE dx END AS fx FROM placed p JOIN starlist s USING (star_id) JOIN stampcells t ON t.image_id = s.source AND t.label = s.label")
_LIGHT = "SELECT image_id, c, cy - (CASE WHEN rot_k % 2 = 1 THEN w ELSE h END) // 2 + (CASE rot_k WHEN 1 THEN w - 1 - fx WHEN 2 THEN h - 1 - fy WHEN 3 THEN fx ELSE fy END) AS y, cx - (CASE WHEN rot_k % 2 = 1 THEN h ELSE w END) // 2 + (CASE rot_k WHEN 1 THEN fy WHEN 2 THEN w - 1 - fx WHEN 3 THEN h - 1 - fy ELSE fx END) AS x, rgb * alpha * scale AS a FROM {cells}"
block("light", _LIGHT.format(cells="turnedcells"))
block("added", "SELECT image_id, y, x, c, sum(a) AS a FROM light GROUP BY ALL")


@query("paste_field", "SELECT b.image_id, b.y, b.x, b.c, round(least(1, b.v + coalesce(a.a, 0)), 6) AS v FROM stretched b LEFT JOIN added a USING (image_id, y, x, c)")
def _(spark, d):
    base, where = written(spark, d)
    listed, cut = library(base, where)
    return inject.paste(base, _hashed(model.dims(base), listed), cut, model.dims(base)).select("image_id", "y", "x", "c", *r6("v"))


@query("proximity_conflicts", "SELECT a.image_id, a.seq AS seq_a, b.seq AS seq_b FROM placed a JOIN placed b ON a.image_id = b.image_id AND a.seq < b.seq WHERE (a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2 < (0.55 * (a.radius + b.radius)) ** 2")
def _(spark, d):
    frame, where = written(spark, d)
    return inject.conflicts(_hashed(model.dims(frame), library(frame, where)[0]))


def field(frame: DataFrame, where: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Placements of a synthetic star field on each image, and the stamps."""
    listed, cut = library(frame, where)
    open_ = inject.valid_pixels(model.dims(frame), where)
    density = stars.densities(listed, mask.valid_fraction(where).select("image_id", "valid_area"))
    counts = materialize(inject.expected_counts(open_, density, seed=SEED), "counts")
    return inject.place(open_, counts, inject.pool(listed, seed=SEED), seed=SEED), cut


block("openpix", "SELECT image_id, y, x FROM mask m WHERE valid OR NOT EXISTS (SELECT 1 FROM mask o WHERE o.image_id = m.image_id AND o.valid)")
block("openranked", "SELECT image_id, y, x, row_number() OVER (PARTITION BY image_id ORDER BY y, x) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM openpix")
block("denslist", "SELECT density, row_number() OVER (ORDER BY source, density) - 1 AS k, count(*) OVER () AS n FROM dens")
block("rates", f"SELECT image_id, density * o.n AS rate FROM (SELECT DISTINCT image_id, n FROM openranked) o JOIN denslist d ON d.k = {_key('density', 'image_id')} % d.n")
block("gaps", f"SELECT image_id, rate, i, -ln(({_key('arrival', 'image_id', 'i')} + 1) / 4294967296.0) AS gap FROM (SELECT image_id, rate, unnest(range(CAST(ceil(rate + sqrt(rate) * 10 + 20) AS INTEGER) + 1)) AS i FROM rates)")
block("starcounts", "SELECT image_id, count(*) FILTER (upto <= rate) AS n_stars FROM (SELECT image_id, rate, sum(gap) OVER (PARTITION BY image_id ORDER BY i) AS upto FROM gaps) GROUP BY image_id")
block("poollist", f"SELECT star_id, h, w, row_number() OVER (ORDER BY star_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT * FROM starlist ORDER BY {_key('pool', 'star_id')}, star_id LIMIT 5000)")
block("seqs", "SELECT image_id, CAST(unnest(range(n_stars)) AS INTEGER) AS seq FROM starcounts")
block("trying", f"SELECT image_id, seq, attempt, star_id, greatest(h, w) / 2 AS radius, {_key('place', 'image_id', 'seq', 'attempt')} AS pick FROM (SELECT s.*, p.* FROM seqs s JOIN poollist p ON p.i = {_key('stamp', 's.image_id', 's.seq')} % p.n) CROSS JOIN (SELECT CAST(unnest(range(30)) AS INTEGER) AS attempt)")
block("tried", "SELECT t.image_id, seq, list(struct_pack(y := o.y, x := o.x, r := radius, star_id := star_id) ORDER BY attempt) AS tries FROM trying t JOIN openranked o ON o.image_id = t.image_id AND o.k = t.pick % o.n GROUP BY t.image_id, seq")
_NEAR = "(c.y - p.y) ** 2 + (c.x - p.x) ** 2 < (0.55 * (c.r + p.r)) ** 2"
block(
    "walk",
    "SELECT DISTINCT image_id, -1 AS seq, list_slice(tries, 1, 0) AS held, tries[0] AS got FROM tried WHERE seq = 0 UNION ALL SELECT image_id, seq, CASE WHEN len(free) > 0 THEN list_append(held, free[1]) ELSE held END, free[1] FROM "
    f"(SELECT w.image_id, t.seq, w.held, list_filter(t.tries, lambda c: len(list_filter(w.held, lambda p: {_NEAR})) = 0) AS free FROM walk w JOIN tried t ON t.image_id = w.image_id AND t.seq = w.seq + 1)",
)
_G = _key("turn", "image_id", "seq")
block("greedy", f"SELECT image_id, seq, got.star_id AS star_id, got.y AS cy, got.x AS cx, got.r AS radius, {_G} & 1 = 1 AS flip_h, ({_G} >> 1) & 1 = 1 AS flip_v, CAST(({_G} >> 2) & 3 AS INTEGER) AS rot_k, 1 + ({_key('light', 'image_id', 'seq')} / 4294967296.0 * 2 - 1) * 0.15 AS scale FROM walk WHERE got IS NOT NULL")


@query("place_greedy", f"SELECT image_id, seq, star_id, cy, cx, radius, flip_h, flip_v, rot_k, {s6('scale')} FROM greedy")
def _(spark, d):
    placed = field(*written(spark, d))[0]
    return placed.select(*[c for c in placed.columns if c != "scale"], *r6("scale"))


@query("star_counts", "SELECT image_id, n_stars FROM starcounts")
def _(spark, d):
    frame, where = written(spark, d)
    density = stars.densities(library(frame, where)[0], mask.valid_fraction(where).select("image_id", "valid_area"))
    return inject.expected_counts(inject.valid_pixels(model.dims(frame), where), density, seed=SEED)


# combinations -------------------------------------------------------------------------------------------------------
def _branches(spark, d) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """The seven branches, the clean frames and the crops; what several of them share is written once."""
    original, where, clean = repaired(spark, d)
    placed, cut = field(original, where)
    starred = materialize(inject.paste(clean, materialize(placed, "placed"), cut, model.dims(clean)), "starred")
    return combos.branches(clean, starred, original, clean), clean, manifest(original, where)


def _blur_blocks(name: str, source: str) -> None:
    block(f"{name}_v", f"SELECT p.image_id, p.y, p.x, p.c, sum(q.v * t) AS v FROM {source} p JOIN dims s USING (image_id) CROSS JOIN taps JOIN {source} q ON q.image_id = p.image_id AND q.c = p.c AND q.x = p.x AND q.y = {_reflect('p.y + d', 's.height')} GROUP BY ALL")
    block(name, f"SELECT p.image_id, p.y, p.x, p.c, sum(q.v * t) AS v FROM {name}_v p JOIN dims s USING (image_id) CROSS JOIN taps JOIN {name}_v q ON q.image_id = p.image_id AND q.c = p.c AND q.y = p.y AND q.x = {_reflect('p.x + d', 's.width')} GROUP BY ALL")


block("greedycells", "SELECT p.image_id, p.cy, p.cx, s.h, s.w, p.rot_k, p.scale, t.c, t.rgb, t.alpha, CASE WHEN flip_v THEN s.h - 1 - dy ELSE dy END AS fy, CASE WHEN flip_h THEN s.w - 1 - dx ELSE dx END AS fx FROM greedy p JOIN starlist s USING (star_id) JOIN stampcells t ON t.image_id = s.source AND t.label = s.label")
block("greedylight", _LIGHT.format(cells="greedycells"))
block("greedyadded", "SELECT image_id, y, x, c, sum(a) AS a FROM greedylight GROUP BY ALL")
block("starred", "SELECT b.image_id, b.y, b.x, b.c, least(1, greatest(0, least(1, b.v)) + coalesce(a.a, 0)) AS v FROM corrected b LEFT JOIN greedyadded a USING (image_id, y, x, c)")
block("requantised", "SELECT image_id, y, x, c, floor(least(65535, greatest(0, v * 65535))) / 65535 AS v FROM starred")
_blur_blocks("cleanblur", "corrected")
_blur_blocks("starblur", "requantised")
_degrade_blocks("cleanlow", "cleanblur")
_degrade_blocks("starlow", "starblur")
block("plainparts", " UNION ALL ".join(f"SELECT '{k}' AS combo, * FROM {v}" for k, v in {"": "corrected", "stars": "starred", "lowres": "cleanlow", "stars_lowres": "starlow"}.items()))
_DEFECT = "CASE combo WHEN '' THEN 'defects' WHEN 'stars' THEN 'stars_defects' WHEN 'lowres' THEN 'defects_lowres' ELSE 'stars_defects_lowres' END"
block("allparts", f"SELECT combo, image_id, y, x, c, v FROM plainparts WHERE combo <> '' UNION ALL SELECT {_DEFECT}, k.image_id, k.y, k.x, k.c, CASE WHEN t.image_id IS NOT NULL THEN o.v ELSE k.v END FROM plainparts k JOIN stretched o USING (image_id, y, x, c) LEFT JOIN differs t ON t.image_id = k.image_id AND t.y = k.y AND t.x = k.x")
_CUTS = _CUT.replace("SELECT image_id, crop_index,", "SELECT combo, image_id, crop_index,").replace("SELECT k.image_id,", "SELECT q.combo, k.image_id,")
block("combocut", _CUTS.format(m=P - 1, fx=_FX, fy=_FY, src="allparts", p=P))
block("combopairs", "SELECT combo, image_id, crop_index, 'input' AS side, y, x, c, v FROM combocut UNION ALL SELECT combo, image_id, crop_index, 'target', y, x, c, v FROM cutfixed CROSS JOIN (SELECT DISTINCT combo FROM allparts)")
block("targethash", "SELECT combo, image_id, crop_index, md5(string_agg(concat_ws(',', y, x, c, round(v, 9)), ';' ORDER BY y, x, c)) AS h FROM combopairs WHERE side = 'target' GROUP BY ALL")


_NAMED = "rtrim((CASE WHEN mask & 1 = 1 THEN 'stars_' ELSE '' END) || (CASE WHEN mask & 2 = 2 THEN 'defects_' ELSE '' END) || (CASE WHEN mask & 4 = 4 THEN 'lowres_' ELSE '' END), '_')"


@query("combo_names", f"SELECT image_id, CAST(mask AS INTEGER) AS mask, {_NAMED} AS combo, height * width AS area FROM dims, (SELECT unnest(range(1, 8)) AS mask)")
def _(spark, d):
    """What is to be made: each image in each combination."""
    names = F.posexplode(F.array(*map(F.lit, combos.combo_names()))).alias("at", "combo")
    planned = model.dims(raw(spark, d)).select("image_id", (F.col("height") * F.col("width")).alias("area"), names)
    return planned.select("image_id", (F.col("at") + 1).alias("mask"), "combo", "area")


@query("combo_union", "SELECT combo, image_id, count(*) AS n, round(avg(v), 6) AS mean, round(max(v), 6) AS hi FROM allparts GROUP BY ALL")
def _(spark, d):
    return combos.union(_branches(spark, d)[0]).groupBy("combo", "image_id").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v"), 6).alias("hi"))


@query("merged_crops", f"SELECT combo, image_id, crop_index, side, y, x, c, {s6('v')} FROM combopairs")
def _(spark, d):
    parts, clean, chosen = _branches(spark, d)
    return combos.merged_pairs(parts, clean, chosen, P).select("combo", "image_id", "crop_index", "side", "y", "x", "c", *r6("v"))


@query("alignment_check", "SELECT image_id, crop_index, count(*) AS combos, count(DISTINCT h) AS targets FROM targethash GROUP BY ALL")
def _(spark, d):
    parts, clean, chosen = _branches(spark, d)
    return combos.alignment(combos.merged_pairs(parts, clean, chosen, P))


# files --------------------------------------------------------------------------------------------------------------
def _through(spark, frames: DataFrame, kind: str, values: str = "float") -> DataFrame:
    """Frames written as files and read again."""
    files.write_frames(frames, folder := new_path(spark, "files"), kind, values)
    return files.read_frames(spark, folder, kind, mode="FAILFAST")


@query("npy_files", f"SELECT image_id, y, x, c, {s6('v')} FROM pixels")
def _(spark, d):
    return model.pixels_from_frames(_through(spark, model.frames_from_pixels(raw(spark, d)), "npy")).select("image_id", "y", "x", "c", *r6("v"))


@query("fits_files", "SELECT image_id, max(y) + 1 AS height, max(x) + 1 AS width, round(sum(v), 3) AS total, round(sum(v * (y * 7 + x * 3 + c)), 3) AS placed FROM pixels GROUP BY image_id")
def _(spark, d):
    back = model.pixels_from_frames(_through(spark, model.frames_from_pixels(raw(spark, d)), "fits"))
    place = F.col("y") * 7 + F.col("x") * 3 + F.col("c")
    return back.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.round(F.sum("v"), 3).alias("total"), F.round(F.sum(F.col("v") * place), 3).alias("placed"))


@query("tiff_files", "SELECT image_id, y, x, c, CAST(round_even(greatest(0, least(1, CAST(CAST(v AS FLOAT) AS DOUBLE))) * 65535, 0) AS INTEGER) AS q FROM stretched")
def _(spark, d):
    back = model.pixels_from_frames(_through(spark, model.frames_from_pixels(stretched(spark, d)), "tiff", "rint16"))
    return back.select("image_id", "y", "x", "c", F.rint(F.col("v") * 65535).cast("int").alias("q"))


@query("mask_files", "SELECT image_id, y, x, valid FROM mask")
def _(spark, d):
    files.write_frames(files.mask_frames(valid(spark, d)), folder := new_path(spark, "files"), "npy", "bool")
    return files.read_masks(spark, folder)


def _sides_of(spark, d) -> DataFrame:
    """Hosts of pages as patch files: the pages of even id are inputs, of ids that 3 divides targets."""
    path = F.concat(F.regexp_extract("url", "://([^/]*)", 1), F.lit("/p"), F.expr("page_id div 4"), F.lit(".npy"))
    return table(spark, d, "pages").select("page_id", path.alias("path"))


block("patchfiles", "SELECT page_id, 'p' || (page_id // 4) AS stem, regexp_extract(url, '://([^/]*)', 1) || '/p' || (page_id // 4) || '.npy' AS path FROM pages")
block("lefts", "SELECT stem, min(path) AS input, count(*) AS n FROM patchfiles WHERE page_id % 2 = 0 GROUP BY stem")
block("rights", "SELECT stem, min(path) AS target, count(*) AS m FROM patchfiles WHERE page_id % 3 = 0 GROUP BY stem")


@query("paired_dataset", "SELECT stem, input, target, CASE WHEN input IS NULL THEN 'no input' WHEN target IS NULL THEN 'no target' WHEN n > 1 OR m > 1 THEN 'duplicate' END AS issue FROM lefts FULL JOIN rights USING (stem)")
def _(spark, d):
    found = _sides_of(spark, d)
    return datasets.paired(found.where("page_id % 2 = 0"), found.where("page_id % 3 = 0"))


@query("patch_sink", "SELECT combo, side, image_id, crop_index, image_id || '_' || lpad(CAST(crop_index AS VARCHAR), 4, '0') AS name, CAST(count(*) AS INTEGER) AS n, round(sum(v), 3) AS total FROM (SELECT 'defects' AS combo, 'input' AS side, * FROM cut UNION ALL SELECT 'defects', 'target', * FROM cutfixed) GROUP BY ALL")
def _(spark, d):
    """Written twice; the second time all pairs are there already."""
    frame, where, fixed = repaired(spark, d)
    chosen = materialize(manifest(frame, where), "crops")
    sides = [crops.patches(df, chosen, P).withColumn("side", F.lit(side)) for df, side in ((frame, "input"), (fixed, "target"))]
    made = materialize(sides[0].unionByName(sides[1]).withColumn("combo", F.lit("defects")), "patches")
    folder = new_path(spark, "sink")
    datasets.write_patches(made, folder)
    datasets.write_patches(made, folder)
    total = F.round(F.aggregate("data", F.lit(0.0), lambda a, v: a + v), 3)
    return datasets.read_patches(spark, folder).select("combo", "side", "image_id", "crop_index", "name", F.size("data").alias("n"), total.alias("total"))


def _library_files(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    frame, where = written(spark, d)
    listed, cut = library(frame, where)
    densities = stars.densities(listed, mask.valid_fraction(where).select("image_id", "valid_area"))
    star_files.write_library(listed, cut, densities, folder := new_path(spark, "library"))
    return star_files.read_library(spark, folder)


@query("library_catalogue", f"SELECT star_id, 'star_' || lpad(CAST(star_id AS VARCHAR), 6, '0') || '.npz' AS file, h, w, {s6('peak', 'flux', 'density')}, source FROM starlist JOIN dens USING (source)")
def _(spark, d):
    listed, _, densities = _library_files(spark, d)
    return listed.join(densities, "source").select("star_id", "file", "h", "w", *r6("peak", "flux", "density"), "source")


@query("library_stamps", f"SELECT star_id, dy, dx, c, {s6('rgb', 'alpha')} FROM (SELECT star_id, dy, dx, c, CAST(CAST(rgb AS FLOAT) AS DOUBLE) AS rgb, CAST(CAST(t.alpha AS FLOAT) AS DOUBLE) AS alpha FROM stampcells t JOIN starlist s ON s.source = t.image_id AND s.label = t.label)")
def _(spark, d):
    return _library_files(spark, d)[1].select("star_id", "dy", "dx", "c", *r6("rgb", "alpha"))


@query("manifest_files", "SELECT image_id, crop_index, y, x, flip_h, flip_v, rot_k FROM crops")
def _(spark, d):
    files.manifest_json(manifest(*written(spark, d)), P, SEED).write.text(folder := new_path(spark, "manifest"))
    return files.read_manifest(spark, folder)


@query("frame_listing", "SELECT image_id, CASE WHEN image_id IN ('0', '1', '2') THEN 'fits' ELSE 'npy' END AS suffix, CASE WHEN image_id IN ('0', '1', '2') THEN 0 ELSE 1 END AS place FROM dims WHERE image_id <> '9'")
def _(spark, d):
    """Two folders with files of two kinds, one listing after the other."""
    made = materialize(model.frames_from_pixels(raw(spark, d)), "made")
    first = F.col("image_id").isin("0", "1", "2")
    folder = new_path(spark, "files")
    files.write_frames(made.where(first), f"{folder}/a", "fits")
    files.write_frames(made.where(~first & (F.col("image_id") != "9")), f"{folder}/b", "npy")
    return files.listings(spark, (f"{folder}/a", "fits"), (f"{folder}/b", "npy")).select("image_id", "suffix", "place")


@query("required_keys", "SELECT event_id, CASE WHEN json_valid(props) THEN array_to_string(list_filter(['k', 'loss', 'step'], lambda x: NOT list_contains(json_keys(props), x)), ',') END AS missing FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(files.keys_missing(F.col("props"), ["k", "loss", "step"]), ",").alias("missing"))


@query("preview_indices", "SELECT i, page_id FROM (SELECT DISTINCT user_id * 37 AS i FROM events) JOIN (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS k, count(*) OVER () AS n FROM pages) ON i % n = k")
def _(spark, d):
    asked = events(spark, d).select((F.col("user_id") * 37).alias("i")).distinct()
    return splits.wrapped(table(spark, d, "pages").select("page_id"), asked, "page_id")


@query("star_pool", f"SELECT star_id, h, w FROM starlist ORDER BY {_key('pool', 'star_id')}, star_id LIMIT 7")
def _(spark, d):
    """A draw without replacement."""
    return inject.pool(library(*written(spark, d))[0], 7, SEED)


@query("widest_star", "SELECT source, max(greatest(h, w) / 2) AS radius, count(*) AS n FROM starlist GROUP BY source")
def _(spark, d):
    return library(*written(spark, d))[0].groupBy("source").agg(F.max(F.greatest("h", "w") / 2).alias("radius"), F.count("*").alias("n"))


@query("open_pixels", "SELECT d.image_id, count(*) AS n, CAST(sum(m.y * 3 + m.x) AS BIGINT) AS placed FROM dims d JOIN mask m USING (image_id) WHERE d.image_id IN ('1', '4', '7') OR m.valid OR NOT EXISTS (SELECT 1 FROM mask o WHERE o.image_id = d.image_id AND o.valid) GROUP BY d.image_id")
def _(spark, d):
    """Where stars may go: two masks without a valid pixel and an image without a mask are open throughout."""
    frame, where = written(spark, d)
    part = where.where("image_id <> '7'").withColumn("valid", F.col("valid") & ~F.col("image_id").isin("1", "4"))
    place = (F.col("y") * 3 + F.col("x")).cast("long")
    return inject.valid_pixels(model.dims(frame), part).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(place).alias("placed"))


@query("grey_and_rgba", "SELECT image_id, y, x, c, round(CASE WHEN CAST(image_id AS INTEGER) % 2 = 0 THEN g ELSE v END, 6) AS v FROM pixels JOIN (SELECT image_id, y, x, v AS g FROM pixels WHERE c = 0) USING (image_id, y, x)")
def _(spark, d):
    """Frames of one channel get three, of frames with four the last goes: even images lose all but the first channel, odd
    ones get a fourth."""
    rows, even = materialize(raw(spark, d), "raw"), F.col("image_id").cast("int") % 2 == 0
    fourth = rows.where(~even & (F.col("c") == 2)).withColumn("c", F.lit(3))
    made = rows.where(~even | (F.col("c") == 0)).unionByName(fourth)
    return model.pixels_from_frames(_through(spark, model.frames_from_pixels(made), "npy")).select("image_id", "y", "x", "c", *r6("v"))


# previews -----------------------------------------------------------------------------------------------------------
SMALL = 16
block("greyed", "SELECT g.image_id, g.y, g.x, g.v, m.valid FROM green g JOIN mask m USING (image_id, y, x)")
block("greyused", "SELECT image_id, v FROM (SELECT *, bool_or(valid) OVER (PARTITION BY image_id) AS any_valid FROM greyed) WHERE valid OR NOT any_valid")
block("greyrange", "SELECT image_id, CASE WHEN lo < hi THEN b END AS black, CASE WHEN lo < hi THEN CASE WHEN w <= b THEN b + 1e-6 ELSE w END END AS white FROM (SELECT image_id, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.01) AS b, quantile_cont(v, 0.995) AS w FROM greyused GROUP BY image_id)")
block("smalldims", f"SELECT image_id, height, width, CAST(greatest(1, floor(height * s)) AS INTEGER) AS th, CAST(greatest(1, floor(width * s)) AS INTEGER) AS tw FROM (SELECT *, least({SMALL} / height, {SMALL} / width, 1.0) AS s FROM dims)")
block("smallcells", "SELECT image_id, CAST(y * th // height AS INTEGER) AS ty, CAST(x * tw // width AS INTEGER) AS tx, height, width, th, tw, y, x, valid, CASE WHEN black IS NULL THEN 0 ELSE floor(255 * greatest(0, least(1, (v - black) / (white - black)))) END AS level FROM greyed JOIN smalldims USING (image_id) JOIN greyrange USING (image_id)")
block("smallpix", "SELECT image_id, ty, tx, CAST(floor(avg(level) + 0.5) AS INTEGER) AS level, bool_or(valid) FILTER (y = (2 * ty + 1) * height // (2 * th) AND x = (2 * tx + 1) * width // (2 * tw)) AS seen FROM smallcells GROUP BY image_id, ty, tx")


@query("overlay_preview", "SELECT image_id, ty AS y, tx AS x, CASE WHEN seen THEN level ELSE 220 END AS red, CASE WHEN seen THEN level ELSE 50 END AS green, CASE WHEN seen THEN level ELSE 50 END AS blue FROM smallpix")
def _(spark, d):
    return overlay.preview(raw(spark, d), valid(spark, d), SMALL)


@query("preview_files", "SELECT image_id, ty AS y, tx AS x, CASE WHEN seen THEN level ELSE 220 END AS red, CASE WHEN seen THEN level ELSE 50 END AS green, CASE WHEN seen THEN level ELSE 50 END AS blue FROM smallpix")
def _(spark, d):
    made = overlay.preview_frames(overlay.preview(raw(spark, d), valid(spark, d), SMALL))
    back = model.pixels_from_frames(_through(spark, made, "png", "u8"))
    level = lambda c: F.max(F.when(F.col("c") == c, F.rint(F.col("v") * 255).cast("int")))
    return back.groupBy("image_id", "y", "x").agg(level(0).alias("red"), level(1).alias("green"), level(2).alias("blue"))


# splits and set operations ------------------------------------------------------------------------------------------
block("docsplit", f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_key('split', 'doc_id')}, doc_id) <= floor(count(*) OVER () * 0.1) THEN 'val' ELSE 'train' END AS role FROM documents")


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source")


@query("split_exact", "SELECT doc_id, role FROM docsplit")
def _(spark, d):
    return splits.exact_split(docs(spark, d).select("doc_id"), "doc_id")


@query("split_manifest", "SELECT 'in/' || doc_id || '.npy' AS path, role, 'input' AS side FROM docsplit UNION ALL SELECT 'out/' || doc_id || '.npy', role, 'target' FROM docsplit")
def _(spark, d):
    name = lambda folder: F.concat(F.lit(f"{folder}/"), F.col("doc_id").cast("string"), F.lit(".npy"))
    pairs = docs(spark, d).select(F.col("doc_id").alias("stem"), name("in").alias("input"), name("out").alias("target"))
    datasets.write_split(datasets.split(pairs), folder := new_path(spark, "split"))
    return datasets.read_split(spark, f"{folder}-none", folder)


@query("leakage", "SELECT text FROM (SELECT text FROM documents JOIN docsplit USING (doc_id) WHERE role = 'train') INTERSECT SELECT text FROM (SELECT text FROM documents JOIN docsplit USING (doc_id) WHERE role = 'val')")
def _(spark, d):
    whole = splits.exact_split(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return splits.leakage(whole.where("role = 'train'"), whole.where("role = 'val'"), "text")


@query("unaccounted", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def _(spark, d):
    labels = table(spark, d, "labels")
    return splits.unaccounted(docs(spark, d), labels.where("quality = 1"), labels.where("toxic = 1"), key="doc_id")


@query("attributed", "SELECT DISTINCT d.doc_id, 'good' AS source FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 UNION ALL SELECT DISTINCT d.doc_id, 'toxic' FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1")
def _(spark, d):
    labels = table(spark, d, "labels")
    return splits.attributed(docs(spark, d), {"good": labels.where("quality = 1"), "toxic": labels.where("toxic = 1")}, "doc_id")


@query("incremental_pending", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def _(spark, d):
    labels = table(spark, d, "labels")
    return splits.pending(docs(spark, d).select("doc_id", "lang"), labels.where("quality = 1"), labels.where("toxic = 0"), key="doc_id")


@query("run_counters", "SELECT CASE WHEN l.doc_id IS NULL THEN 'skipped' ELSE 'ok' END AS status, count(*) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY ALL")
def _(spark, d):
    done = table(spark, d, "labels").select("doc_id").distinct().withColumn("done", F.lit(True))
    rows = docs(spark, d).join(done, "doc_id", "left").withColumn("status", F.when(F.col("done"), "ok").otherwise("skipped"))
    return splits.status_counts(rows)


block("files", "SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS stem, CASE page_id % 3 WHEN 0 THEN 'tif' WHEN 1 THEN 'npy' ELSE 'png' END AS suffix FROM pages")


@query("format_pref", "SELECT stem, suffix, page_id FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY CASE suffix WHEN 'npy' THEN 1 ELSE 2 END, page_id) AS n FROM files WHERE suffix IN ('npy', 'tif')) WHERE n = 1")
def _(spark, d):
    suffix = F.when(F.col("page_id") % 3 == 0, "tif").when(F.col("page_id") % 3 == 1, "npy").otherwise("png")
    files = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("stem"), suffix.alias("suffix"), "page_id")
    return splits.preferred(files, "stem", "suffix", ["npy", "tif"])


@query("composite_listing", "SELECT stem, suffix, page_id FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY CASE suffix WHEN 'tif' THEN 1 ELSE 2 END, page_id) AS n FROM files WHERE suffix IN ('npy', 'tif')) WHERE n = 1")
def _(spark, d):
    suffix = F.when(F.col("page_id") % 3 == 0, "tif").when(F.col("page_id") % 3 == 1, "npy").otherwise("png")
    files = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("stem"), suffix.alias("suffix"), "page_id")
    return splits.composites(files, "stem", "suffix")


@query("path_stem", "SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*', ''), '[^/]*$'), '[.][^./]*$', '') AS stem FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", model.stem(F.regexp_replace("url", "[?#].*", "")).alias("stem"))


# runs: events as training histories ---------------------------------------------------------------------------------
def events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


@query("latest_checkpoint", "SELECT user_id, max(event_id) AS epoch, arg_max('ckpt_' || event_type || '_' || event_id || '.pt', event_id) AS path FROM events GROUP BY user_id")
def _(spark, d):
    named = events(spark, d).withColumn("path", F.format_string("ckpt_%s_%d.pt", F.col("event_type"), F.col("event_id")))
    dated = named.withColumn("epoch", metrics.checkpoint_epoch(F.col("path")).cast("long"))
    return dated.groupBy("user_id").agg(F.max("epoch").alias("epoch"), F.max_by("path", "epoch").alias("path"))


@query("keep_last_n", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2 AS keep FROM events")
def _(spark, d):
    return metrics.keep_last(events(spark, d), ["user_id"], "event_id").select("event_id", "user_id", "keep")


@query("best_so_far", "SELECT event_id, user_id, round(best, 6) AS best, best IS NULL OR value < best AS improved FROM (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events)")
def _(spark, d):
    return metrics.best_so_far(events(spark, d), ["user_id"], "event_id", "value").select("event_id", "user_id", *r6("best"), "improved")


block("steps", "SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events")


@query("ema", "SELECT user_id, round(sum(value * 0.9 ** (n - 1 - t) * CASE WHEN t = 0 THEN 1.0 ELSE 0.1 END), 6) AS ema FROM steps GROUP BY user_id")
def _(spark, d):
    return metrics.last_ema(events(spark, d), ["user_id"], "event_id", "value", 0.9).select("user_id", *r6("ema"))


block("batches", "SELECT user_id AS run, event_id // 1000 AS epoch, event_type AS split, event_id % 7 AS batch, value AS loss FROM events")


@query("epoch_loss", "SELECT run, epoch, split, round(avg(m), 6) AS loss FROM (SELECT run, epoch, split, batch, avg(loss) AS m FROM batches GROUP BY ALL) GROUP BY ALL")
def _(spark, d):
    rows = events(spark, d).select(F.col("user_id").alias("run"), F.expr("event_id div 1000").alias("epoch"), F.col("event_type").alias("split"), (F.col("event_id") % 7).alias("batch"), F.col("value").alias("loss"))
    return metrics.epoch_loss(rows).select("run", "epoch", "split", *r6("loss"))


block("scored", "SELECT event_type AS folder, user_id % 20 AS candidate, avg(value) AS score FROM events GROUP BY ALL")
block("zs", "SELECT folder, candidate, coalesce((score - avg(score) OVER (PARTITION BY folder)) / nullif(stddev_pop(score) OVER (PARTITION BY folder), 0), 0) AS z FROM scored")
block("stage1", "SELECT candidate FROM zs GROUP BY candidate ORDER BY avg(z), candidate LIMIT 8")
block("zs2", "SELECT candidate, coalesce((score - avg(score) OVER (PARTITION BY folder)) / nullif(stddev_pop(score) OVER (PARTITION BY folder), 0), 0) AS z FROM scored WHERE candidate IN (SELECT candidate FROM stage1)")


def scored(spark, d) -> DataFrame:
    return events(spark, d).groupBy(F.col("event_type").alias("folder"), (F.col("user_id") % 20).alias("candidate")).agg(F.avg("value").alias("score"))


@query("zscore_rank", "SELECT candidate, round(avg(z), 6) AS score FROM zs GROUP BY candidate")
def _(spark, d):
    return metrics.candidate_scores(metrics.zscores(scored(spark, d), "folder", "candidate", "score"), "candidate").select("candidate", *r6("score"))


@query("topk_two_stage", "SELECT candidate, round(avg(z), 6) AS score FROM zs2 GROUP BY candidate ORDER BY avg(z), candidate LIMIT 3")
def _(spark, d):
    return metrics.two_stage_top(scored(spark, d), "folder", "candidate", "score", 8, 3).select("candidate", *r6("score"))


@query("mse_psnr", "SELECT image_id, round(m, 9) AS mse, CASE WHEN m > 0 THEN round(10 * log10(1 / m), 6) END AS psnr FROM (SELECT a.image_id, avg((a.v - b.v) ** 2) AS m FROM stretched a JOIN corrected b USING (image_id, y, x, c) GROUP BY ALL)")
def _(spark, d):
    frame, _, fixed = repaired(spark, d)
    return metrics.mse_psnr(frame, fixed).select("image_id", F.round("mse", 9).alias("mse"), *r6("psnr"))


# diffusion schedule -------------------------------------------------------------------------------------------------
_F = "pow(cos(({} / 200.0 + 0.008) / 1.008 * pi() / 2), 2)"
block("betas", f"SELECT t, greatest(1e-4, least(0.9999, 1 - {_F.format('(t + 1)')} / {_F.format('t')})) AS beta FROM (SELECT CAST(unnest(range(200)) AS INTEGER) AS t)")
block("schedule", "SELECT t, beta, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS alpha_bar FROM betas")
block("schedule2", "SELECT *, lag(alpha_bar, 1, 1.0) OVER (ORDER BY t) AS alpha_bar_prev FROM schedule")


@query("noise_schedule", f"SELECT event_id, t, {s6('beta', 'alpha_bar', 'alpha_bar_prev')}, round(beta * (1 - alpha_bar_prev) / (1 - alpha_bar), 6) AS posterior_variance FROM (SELECT event_id, CAST({_key('step', 'event_id')} % 200 AS INTEGER) AS t FROM events) JOIN schedule2 USING (t)")
def _(spark, d):
    """Training steps (events) with the step of the diffusion that each draws."""
    drawn = events(spark, d).select("event_id", rng.choice(rng.key(SEED, "step", "event_id"), F.lit(200)).cast("int").alias("t"))
    return drawn.join(metrics.noise_schedule(spark), "t").select("event_id", "t", *r6("beta", "alpha_bar", "alpha_bar_prev", "posterior_variance"))


@query("forward_noise", "SELECT image_id, y, x, c, round(sqrt(alpha_bar) * (2 * v - 1) + sqrt(1 - alpha_bar) * (v - 0.5), 6) AS noisy, round(sqrt(alpha_bar) * (v - 0.5) - sqrt(1 - alpha_bar) * (2 * v - 1), 6) AS v_target FROM stretched JOIN schedule ON t = (y * 7 + x * 3 + c) % 200")
def _(spark, d):
    rows = stretched(spark, d).select("image_id", "y", "x", "c", pixel.to_signed_unit(F.col("v")).alias("s"), (F.col("v") - 0.5).alias("e"), ((F.col("y") * 7 + F.col("x") * 3 + F.col("c")) % 200).alias("t"))
    return metrics.forward_noise(rows, metrics.noise_schedule(spark), "s", "e").select("image_id", "y", "x", "c", *r6("noisy", "v_target"))


_NOISE = f"sqrt(-2 * ln(({_key('noise', 'image_id', 'y', 'x', 'c')} + 1) / 4294967296.0)) * cos({_key('turn', 'image_id', 'y', 'x', 'c')} / 4294967296.0 * 2 * pi())"
block("noised", f"SELECT image_id, y, x, c, 2 * v - 1 AS s, {_NOISE} AS e, CAST({_key('step', 'image_id')} % 200 AS INTEGER) AS t FROM stretched")


@query("drawn_noise", "SELECT image_id, y, x, c, t, round(sqrt(alpha_bar) * s + sqrt(1 - alpha_bar) * e, 6) AS noisy, round(sqrt(alpha_bar) * e - sqrt(1 - alpha_bar) * s, 6) AS v_target FROM noised JOIN schedule USING (t)")
def _(spark, d):
    rows = metrics.drawn_noise(stretched(spark, d), seed=SEED).withColumn("s", pixel.to_signed_unit(F.col("v")))
    return metrics.forward_noise(rows, metrics.noise_schedule(spark), "s", "noise").select("image_id", "y", "x", "c", "t", *r6("noisy", "v_target"))


block("pretextops", " UNION ALL ".join(f"SELECT image_id, '{op}' AS operation, {_key(op, 'image_id')} AS k FROM dims" for op in pretext.OPERATIONS))


@query("pretext_chains", f"SELECT image_id, {_key('zero', 'image_id')} / 4294967296.0 < 0.1 AS zeroed, CAST(n AS INTEGER) AS step, operation FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY k, operation) - 1 AS n FROM pretextops) WHERE n <= {_key('length', 'image_id')} % 3")
def _(spark, d):
    return pretext.chains(raw(spark, d).select("image_id").distinct(), SEED)


@query("signed_unit", "SELECT image_id, y, x, c, round(greatest(0, least(1, (3 * v - 1.5 + 1) / 2)), 6) AS v FROM stretched")
def _(spark, d):
    return stretched(spark, d).select("image_id", "y", "x", "c", F.round(pixel.from_signed_unit(F.col("v") * 3 - 1.5), 6).alias("v"))


# merging: labels as tasks ------------------------------------------------------------------------------------
block("tasks", "SELECT image_id AS task, y AS param, x * 3 + c AS idx, v AS value FROM pixels")
block("trimmed", "SELECT t.* FROM tasks t JOIN (SELECT task, quantile_cont(abs(value), 0.8) AS cut FROM tasks GROUP BY task) USING (task) WHERE abs(value) >= cut")
_ELECT = "SELECT param, idx, round(avg(value), 6) AS value FROM {0} JOIN (SELECT param, idx, sign(sum(value)) AS s FROM {0} GROUP BY ALL) USING (param, idx) WHERE sign(value) = s AND s <> 0 GROUP BY ALL"
block("dropped", f"SELECT task, param, idx, value / 0.5 AS value FROM tasks WHERE NOT {_key('dare', 'task', 'param', 'idx')} / 4294967296.0 < 0.5")
block("droptrim", "SELECT t.* FROM dropped t JOIN (SELECT task, quantile_cont(abs(value), 0.8) AS cut FROM dropped GROUP BY task) USING (task) WHERE abs(value) >= cut")


def tasks(spark, d) -> DataFrame:
    return raw(spark, d).select(F.col("image_id").alias("task"), F.col("y").alias("param"), (F.col("x") * 3 + F.col("c")).alias("idx"), F.col("v").alias("value"))


@query("task_arithmetic", "SELECT param, idx, round(0.3 * sum(value), 6) AS value FROM tasks GROUP BY ALL")
def _(spark, d):
    return merging.task_arithmetic(tasks(spark, d), scale=0.3).select("param", "idx", *r6("value"))


@query("ties_merge", _ELECT.format("trimmed"))
def _(spark, d):
    return merging.ties(tasks(spark, d)).select("param", "idx", *r6("value"))


@query("dare_ties", _ELECT.format("droptrim"))
def _(spark, d):
    return merging.dare_ties(tasks(spark, d), drop=0.5).select("param", "idx", *r6("value"))


block("norms", "SELECT task, sqrt(sum(value ** 2)) AS norm FROM tasks GROUP BY task")


@query("task_cosine", "SELECT a, b, round(dot / na.norm / nb.norm, 6) AS cosine FROM (SELECT a.task AS a, b.task AS b, sum(a.value * b.value) AS dot FROM tasks a JOIN tasks b ON a.param = b.param AND a.idx = b.idx AND a.task < b.task GROUP BY ALL) JOIN norms na ON na.task = a JOIN norms nb ON nb.task = b")
def _(spark, d):
    return merging.cosine(tasks(spark, d)).select("a", "b", *r6("cosine"))


# merging: a grid of weights -------------------------------------------------------------------------------------------
GRID, KEPT = (0.1, 0.3), 8
block("gramdots", "SELECT a.task AS a, b.task AS b, sum(a.value * b.value) AS dot FROM tasks a JOIN tasks b ON a.param = b.param AND a.idx = b.idx GROUP BY ALL")
block("tasklist", "SELECT task, row_number() OVER (ORDER BY task) - 1 AS i FROM (SELECT DISTINCT task FROM tasks)")
block("points", f"SELECT candidate, task, CASE (candidate >> i) & 1 WHEN 0 THEN {GRID[0]} ELSE {GRID[1]} END AS w FROM (SELECT unnest(range(CAST(1 << (SELECT count(*) FROM tasklist) AS BIGINT))) AS candidate), tasklist")
block("aims", "SELECT '1' AS stage, a.task AS folder, t.task, CASE WHEN t.task = a.task THEN 1.0 ELSE 0.0 END AS aim FROM tasklist a, tasklist t UNION ALL SELECT '2', a.task || '+' || b.task, t.task, CASE WHEN t.task IN (a.task, b.task) THEN 1.0 ELSE 0.0 END FROM tasklist a, tasklist b, tasklist t WHERE a.i < b.i")
block("aimdots", "SELECT stage, folder, t.task, sum(g.dot * aim) AS d FROM aims JOIN tasklist t ON true JOIN gramdots g ON g.a = t.task AND g.b = aims.task GROUP BY ALL")
block("aimnorms", "SELECT stage, folder, sum(a.aim * d.d) AS nn FROM aims a JOIN aimdots d USING (stage, folder, task) GROUP BY ALL")
block("selfdots", "SELECT candidate, sum(p.w * q.w * dot) AS ww FROM points p JOIN points q USING (candidate) JOIN gramdots ON a = p.task AND b = q.task GROUP BY candidate")
block("gridscores", "SELECT stage, folder, candidate, (any_value(ww) - 2 * sum(p.w * d.d) + any_value(nn)) / (SELECT count(DISTINCT (param, idx)) FROM tasks) AS score FROM points p JOIN aimdots d USING (task) JOIN aimnorms USING (stage, folder) JOIN selfdots USING (candidate) GROUP BY stage, folder, candidate")
_Z = "SELECT candidate, avg(z) AS score FROM (SELECT candidate, coalesce((score - avg(score) OVER (PARTITION BY folder)) / nullif(stddev_pop(score) OVER (PARTITION BY folder), 0), 0) AS z FROM gridscores WHERE {}) GROUP BY candidate"
block("gridfirst", f"SELECT candidate, score AS stage_one FROM ({_Z.format("stage = '1'")}) ORDER BY score, candidate LIMIT {KEPT}")
block("gridsecond", _Z.format("stage = '2' AND candidate IN (SELECT candidate FROM gridfirst)"))


@query("lambda_grid", f"SELECT candidate, {s6('stage_one', 'score')} FROM gridfirst JOIN gridsecond USING (candidate)")
def _(spark, d):
    return search.best_weights(tasks(spark, d), GRID, KEPT)[0].select("candidate", *r6("stage_one", "score"))


@query("lambda_merge", "SELECT param, idx, round(sum(value * w), 6) AS value FROM tasks JOIN points USING (task) WHERE candidate = (SELECT candidate FROM gridsecond ORDER BY score, candidate LIMIT 1) GROUP BY param, idx")
def _(spark, d):
    return search.merge_best(tasks(spark, d), GRID, KEPT).select("param", "idx", *r6("value"))
