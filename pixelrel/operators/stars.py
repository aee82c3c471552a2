"""Star components, stamps, catalogue and densities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize
from . import numbering
from .graph import connected_components
from .joins import shuffled

THRESHOLD, MIN_AREA, PAD = 0.1, 4, 2
#: Pixels of a cell in which runs meet; roots of a block in which they are numbered.
CELL, BLOCK = 64, 4_096
AT = ["image_id", "y", "x"]


def row_runs(pixels: DataFrame) -> DataFrame:
    """Adds x0, where the run of neighbouring pixels of the row begins that a pixel belongs to."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    begins = F.coalesce(F.lag("x").over(row) != F.col("x") - 1, F.lit(True))
    start = F.last(F.when(begins, F.col("x")), ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    return pixels.withColumn("x0", start)


def components(soft: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(image_id, y, x, alpha, label) of the pixels over the threshold: labels from 1 of 4-connected pixels, in raster
    order of their first pixel. Runs of a row are nodes, numbered in raster order; runs of neighbouring rows that overlap
    are links, found by the CELL-wide cells that both touch. No image meets in one task."""
    bright = materialize(row_runs(soft.where(F.col("alpha") > threshold).select(*AT, "alpha")), "bright")
    spans = bright.groupBy("image_id", "y", "x0").agg(F.max("x").alias("x1"))
    runs = materialize(numbering.numbered(spans, ["image_id", "y", "x0"], name="run"), "runs")
    cell = F.explode(F.sequence(F.floor(F.col("x0") / CELL), F.floor(F.col("x1") / CELL)))
    lower = runs.select("image_id", "y", "run", "x0", "x1", cell.alias("cell"))
    upper = lower.select("image_id", (F.col("y") + 1).alias("y"), "cell", F.col("run").alias("above"), F.col("x0").alias("l"), F.col("x1").alias("r"))
    links = lower.join(shuffled(upper), ["image_id", "y", "cell"]).where((F.col("l") <= F.col("x1")) & (F.col("r") >= F.col("x0"))).select(F.col("above").alias("a"), F.col("run").alias("b"))
    rooted = runs.join(shuffled(connected_components(links).withColumnRenamed("node", "run")), "run", "left").withColumn("root", F.coalesce("component", "run"))
    roots = rooted.where("root = run").select("image_id", "root")  # a component's smallest run number is its first
    labels = numbering.numbered(roots, ["root"], ["image_id"], F.floor(F.col("root") / BLOCK), "label")
    named = rooted.join(shuffled(labels), ["image_id", "root"]).select("image_id", "y", "x0", (F.col("label") + 1).cast("int").alias("label"))
    return bright.join(shuffled(named), ["image_id", "y", "x0"]).select(*AT, "alpha", "label")


def boxes(labelled: DataFrame, size: DataFrame, mask: DataFrame | None = None, min_area: int = MIN_AREA, pad: int = PAD) -> DataFrame:
    """(image_id, label, area, y0, y1, x0, x1): padded boxes (ends exclusive) of components of at least min_area pixels
    whose padded box is valid throughout."""
    found = labelled.groupBy("image_id", "label").agg(F.count("*").alias("area"), F.min("y").alias("a"), F.max("y").alias("b"), F.min("x").alias("l"), F.max("x").alias("r")).where(F.col("area") >= min_area)
    y0, y1 = F.greatest(F.col("a") - pad, F.lit(0)), F.least(F.col("b") + 1 + pad, F.col("height"))
    x0, x1 = F.greatest(F.col("l") - pad, F.lit(0)), F.least(F.col("r") + 1 + pad, F.col("width"))
    out = found.join(F.broadcast(size), "image_id").select("image_id", "label", "area", y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1"))
    if mask is None:
        return out
    cells = box_cells(out)
    touched = cells.join(shuffled(mask.where(~F.col("valid")).select(*AT)), AT).select("image_id", "label").distinct()
    return out.join(shuffled(touched), ["image_id", "label"], "left_anti")


def box_cells(found: DataFrame) -> DataFrame:
    """(image_id, label, y, x, y0, x0) of every cell of the boxes."""
    rows = found.withColumn("y", F.explode(F.sequence("y0", F.col("y1") - 1)))
    return rows.withColumn("x", F.explode(F.sequence("x0", F.col("x1") - 1))).select("image_id", "label", "y", "x", "y0", "x0")


def stamps(original: DataFrame, labelled: DataFrame, found: DataFrame) -> DataFrame:
    """(image_id, label, dy, dx, c, rgb, alpha): real pixels of the box; alpha is 0 outside of the component itself."""
    cells = box_cells(found).join(shuffled(original.select(*AT, "c", F.col("v").alias("rgb"))), AT)
    own = cells.join(shuffled(labelled.select(*AT, "label", "alpha")), [*AT, "label"], "left")
    return own.select("image_id", "label", (F.col("y") - F.col("y0")).alias("dy"), (F.col("x") - F.col("x0")).alias("dx"), "c", "rgb", F.coalesce("alpha", F.lit(0.0)).alias("alpha"))


def catalogue(cut: DataFrame, found: DataFrame) -> DataFrame:
    """(star_id, h, w, peak, flux, source, label): ids run over images in order of their name, then labels from 0; an
    image's ids start after the counts of the images before it, so no window spans all stars."""
    light = F.col("rgb") * F.col("alpha")
    stats = cut.groupBy("image_id", "label").agg(F.max(light).alias("peak"), F.sum(light).alias("flux"), F.max("alpha").alias("top")).where("top > 0")
    stars = stats.join(shuffled(found), ["image_id", "label"])
    counts = stars.groupBy("image_id").agg(F.count("*").alias("n"))
    before = counts.select("image_id", (F.sum("n").over(Window.orderBy("image_id")) - F.col("n")).alias("first"))  # a row an image
    star_id = F.col("first") + F.row_number().over(Window.partitionBy("image_id").orderBy("label")) - 1
    return stars.join(F.broadcast(before), "image_id").select(star_id.alias("star_id"), (F.col("y1") - F.col("y0")).alias("h"), (F.col("x1") - F.col("x0")).alias("w"), "peak", "flux", F.col("image_id").alias("source"), "label")


def densities(stars: DataFrame, valid_area: DataFrame) -> DataFrame:
    """(source, density): stars by valid area (image_id, valid_area) for images with any, starless ones included."""
    n = stars.groupBy("source").agg(F.count("*").alias("n"))
    areas = valid_area.where(F.col("valid_area") > 0).withColumnRenamed("image_id", "source")
    return areas.join(n, "source", "left").select("source", (F.coalesce("n", F.lit(0)) / F.col("valid_area")).alias("density"))
