"""Synthetic star fields: greedy placement as rounds of joins, pasting as a join and a sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel, rng
from ..storage import materialize
from . import numbering
from .joins import shuffled

MIN_SEP, ATTEMPTS, JITTER, POOL, SEED = 0.55, 30, 0.15, 5_000, 43
AT = ["image_id", "y", "x"]
PLACED = "image_id string, seq int, star_id long, cy int, cx int, radius double, flip_h boolean, flip_v boolean, rot_k int, scale double"
PLACED_COLUMNS = [c.split()[0] for c in PLACED.split(", ")]
#: Gaps of a block in which they are summed.
BLOCK = 4_096


def pool(stars: DataFrame, size: int = POOL, seed: int = SEED) -> DataFrame:
    """(star_id, h, w) of at most size stars, drawn without replacement by hash."""
    return stars.withColumn("k", rng.key(seed, "pool", "star_id")).orderBy("k", "star_id").limit(size).select("star_id", "h", "w")


def valid_pixels(size: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(image_id, y, x) where stars may go: the mask's valid pixels; all of an image without a mask or a valid pixel."""
    grid = size.select("image_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    if mask is None:
        return grid
    some = F.broadcast(mask.where("valid").select("image_id").distinct())
    return mask.where("valid").select(*AT).unionByName(grid.join(some, "image_id", "left_anti"))


def expected_counts(valid: DataFrame, densities: DataFrame, scale: float = 1.0, seed: int = SEED) -> DataFrame:
    """(image_id, n_stars): Poisson counts at a density drawn from the empirical ones (none without densities)."""
    listed = numbering.numbered(densities.select("source", "density"), ["source", "density"])
    n = max(1, listed.count())
    area = valid.groupBy("image_id").agg(F.count("*").alias("area")).withColumn("k", rng.choice(rng.key(seed, "density", "image_id"), F.lit(n)))
    rated = area.join(listed.select("k", "density"), "k", "left").select("image_id", (F.coalesce("density", F.lit(0.0)) * scale * F.col("area")).alias("rate"))
    return arrivals(rated, seed)


def arrivals(rated: DataFrame, seed: int = SEED) -> DataFrame:
    """(image_id, n_stars): how many exponential gaps, drawn by hash, fit into the rate, which is a Poisson count. Gaps
    are made for ten deviations over the rate, beyond which less than one in 1e20 counts lies."""
    most = F.ceil(F.col("rate") + F.sqrt("rate") * 10 + 20).cast("int")
    gaps = rated.select("image_id", "rate", F.explode(F.sequence(F.lit(0), most)).alias("i"))
    gap = -F.log((rng.key(seed, "arrival", "image_id", "i") + 1) / F.lit(float(1 << 32)))
    at = numbering.running(gaps.withColumn("gap", gap), ["i"], ["image_id"], F.floor(F.col("i") / BLOCK), at=F.col("gap"))
    return at.groupBy("image_id").agg(F.count_if(F.col("at") <= F.col("rate")).alias("n_stars"))


def tries(valid: DataFrame, counts: DataFrame, stars: DataFrame, attempts: int = ATTEMPTS, jitter: float = JITTER, seed: int = SEED) -> DataFrame:
    """PLACED and attempt: for each star of a field what it is and how it is turned, and the places it tries in turn, all
    drawn by hash from the image's whole name."""
    listed = numbering.numbered(stars.select("star_id", "h", "w"), ["star_id"], name="i")
    n = max(1, listed.count())
    k = lambda purpose, *more: rng.key(seed, purpose, "image_id", "seq", *more)
    wanted = counts.where("n_stars > 0").select("image_id", F.explode(F.sequence(F.lit(0), (F.col("n_stars") - 1).cast("int"))).alias("seq"))
    turn, radius = k("turn"), F.greatest("h", "w") / 2
    drawn = wanted.withColumn("i", rng.choice(k("stamp"), F.lit(n))).join(F.broadcast(listed), "i").select(
        "image_id", "seq", "star_id", radius.alias("radius"), (rng.bits(turn, 0) == 1).alias("flip_h"), (rng.bits(turn, 1) == 1).alias("flip_v"), rng.bits(turn, 2, 2).alias("rot_k"),
        (1 + (rng.uniform(k("light")) * 2 - 1) * jitter).alias("scale"), F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"),
    )
    area = valid.groupBy("image_id").agg(F.count("*").alias("area"))
    at = drawn.join(F.broadcast(area), "image_id").withColumn("k", rng.choice(k("place", "attempt"), F.col("area"))).drop("area")
    places = numbering.numbered(valid.select(*AT), ["y", "x"], ["image_id"], F.col("y"))
    return at.join(shuffled(places), ["image_id", "k"]).select(*[F.col({"cy": "y", "cx": "x"}.get(c, c)).alias(c) for c in PLACED_COLUMNS], "attempt")


def place(valid: DataFrame, counts: DataFrame, stars: DataFrame, min_sep: float = MIN_SEP, attempts: int = ATTEMPTS, jitter: float = JITTER, seed: int = SEED) -> DataFrame:
    """PLACED rows: each star takes the first of its tries that keeps min_sep x (r1 + r2) from all placed before it.

    The rule has one solution, and it is found in rounds: with a choice for every star, each star chooses anew, the first
    of its tries that keeps its distance to the choices of the stars before it. After n rounds the first n stars of every
    image are right, so the choices stop changing, in practice after as many rounds as stars hang on each other in a row.
    A round is one join of tries with choices by grid cell."""
    all_ = tries(valid, counts, stars, attempts, jitter, seed)
    cell = F.greatest(F.lit(1.0), F.ceil(F.lit(2 * min_sep) * (stars.agg(F.max(F.greatest("h", "w") / 2)).first()[0] or 0)))
    made = materialize(all_.withColumn("gy", F.floor(F.col("cy") / cell)).withColumn("gx", F.floor(F.col("cx") / cell)), "tries")
    step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    a, b = made.alias("a"), F.col
    d2 = F.pow(b("a.cy") - b("b.by"), 2) + F.pow(b("a.cx") - b("b.bx"), 2)
    same = (b("a.image_id") == b("b.image_of")) & (b("a.gy") == b("b.ny")) & (b("a.gx") == b("b.nx"))
    close = same & (b("b.before") < b("a.seq")) & (d2 < F.pow((b("a.radius") + b("b.rb")) * min_sep, 2))

    def chosen(open_: DataFrame) -> DataFrame:
        first = open_.groupBy("image_id", "seq").agg(F.min_by(F.struct("attempt", "cy", "cx", "radius", "gy", "gx"), "attempt").alias("t"))
        return materialize(first.select("image_id", "seq", "t.*"), "choices")

    choices = chosen(made)
    while True:
        near = choices.withColumn("dy", step).withColumn("dx", step)
        around = near.select(F.col("image_id").alias("image_of"), F.col("seq").alias("before"), F.col("cy").alias("by"), F.col("cx").alias("bx"), F.col("radius").alias("rb"), (F.col("gy") + F.col("dy")).alias("ny"), (F.col("gx") + F.col("dx")).alias("nx"))
        again = chosen(a.join(shuffled(around.alias("b")), close, "left_anti"))
        settled = again.count() == choices.count() and again.join(shuffled(choices), ["image_id", "seq", "attempt"], "left_anti").isEmpty()
        choices = again
        if settled:
            return made.join(shuffled(choices.select("image_id", "seq", "attempt")), ["image_id", "seq", "attempt"]).select(*PLACED_COLUMNS)


def conflicts(placements: DataFrame, min_sep: float = MIN_SEP) -> DataFrame:
    """(image_id, seq_a, seq_b) of placements too close to each other: a bucketed proximity join."""
    top = placements.groupBy("image_id").agg(F.max("radius").alias("top"))
    sized = placements.join(top, "image_id").withColumn("cell", F.greatest(F.lit(1.0), F.ceil(F.col("top") * 2 * min_sep)))
    own = sized.select("image_id", "seq", "cy", "cx", "radius", F.floor(F.col("cy") / F.col("cell")).alias("gy"), F.floor(F.col("cx") / F.col("cell")).alias("gx"))
    step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    around = own.withColumn("dy", step).withColumn("dx", step).select("image_id", F.col("seq").alias("seq_b"), F.col("cy").alias("by"), F.col("cx").alias("bx"), F.col("radius").alias("rb"), (F.col("gy") + F.col("dy")).alias("gy"), (F.col("gx") + F.col("dx")).alias("gx"))
    d2 = F.pow(F.col("cy") - F.col("by"), 2) + F.pow(F.col("cx") - F.col("bx"), 2)
    close = (F.col("seq") < F.col("seq_b")) & (d2 < F.pow((F.col("radius") + F.col("rb")) * min_sep, 2))
    return own.join(shuffled(around), ["image_id", "gy", "gx"]).where(close).select("image_id", F.col("seq").alias("seq_a"), "seq_b")


def paste(base: DataFrame, placements: DataFrame, stamps: DataFrame, size: DataFrame) -> DataFrame:
    """Adds the stamps' light: min(1, base + sum of rgb x alpha x scale). Sums replace the sequence of clipped additions
    (all terms are non-negative for a jitter of at most 1). stamps: (star_id, dy, dx, c, rgb, alpha); centred by floor division."""
    shape = stamps.groupBy("star_id").agg((F.max("dy") + 1).alias("h"), (F.max("dx") + 1).alias("w"))
    cells = placements.join(shuffled(shape), "star_id").join(shuffled(stamps), "star_id")
    ty, tx = pixel.turned(F.col("dy"), F.col("dx"), F.col("h"), F.col("w"), F.col("flip_h"), F.col("flip_v"), F.col("rot_k"))
    quarter = F.col("rot_k") % 2 == 1
    th, tw = F.when(quarter, F.col("w")).otherwise(F.col("h")), F.when(quarter, F.col("h")).otherwise(F.col("w"))
    y, x = F.col("cy") - F.floor(th / 2) + ty, F.col("cx") - F.floor(tw / 2) + tx
    light = cells.select("image_id", y.cast("int").alias("y"), x.cast("int").alias("x"), "c", (F.col("rgb") * F.col("alpha") * F.col("scale")).alias("add"))
    inside = (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") < F.col("width"))
    total = light.join(F.broadcast(size), "image_id").where(inside).groupBy(*AT, "c").agg(F.sum("add").alias("add"))
    return base.join(shuffled(total), [*AT, "c"], "left").select(*AT, "c", F.least(F.lit(1.0), pixel.clip(F.col("v")) + F.coalesce("add", F.lit(0.0))).alias("v"))
