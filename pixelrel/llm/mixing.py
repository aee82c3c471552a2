"""Mixing sources to target weights: how many words of each document a training mix takes.

Sources get shares of the mix by weight, capped at a multiple of their size, and what a cap cuts off goes to the others
(the water level at which capped and uncapped targets add up, found on the sources' own sizes). A target is complete
epochs over the source first, and then a fractional one: Efraimidis-Spirakis sampling without replacement, in which a
document's key is an exponential variable divided by its quality weight. Documents are taken in order of their keys until
the running sum of words reaches the budget; the document that crosses it gives only the words that are missing.

Keys come from a hash of doc_id, so reruns agree. The order and the running sum of a source are cut into ranges (see
numbering), so a source with a third of all rows isn't one task.

Cases: a null text has size 0; null sources are one source, after all others; a null doc_id is drawn like any other.
Repeated rows are documents of their own; among rows with one id and size it is open which comes first, they differ in
nothing else. Sources and documents without words take 0. No documents, no rows. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import numbering
from .common import materialize

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2, 13
WORD, BITS = r"[^\x20\x09-\x0D]+", 52


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, words: Column) -> Column:
    """1 to 4: a point each for 50 words or more, words of 3 to 10 characters on average, and four fifths of letters."""
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    points = [words >= 50, (solid >= words * 3) & (solid <= words * 10), letters * 5 >= solid * 4]
    return F.lit(1) + sum(F.coalesce(p, F.lit(False)).cast("int") for p in points)


def draw(seed: int, weight: Column) -> Column:
    """An exponential variable by weight, from a hash of doc_id."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, BITS // 4), 16, 10).cast("long")
    return -F.log((h + 1) / F.lit(float(1 << BITS))) / weight


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(no_source, name, source_size, target double) of (no_source, name, source_size)."""
    place = numbering.numbered(sizes, ["no_source", "name"], name="place")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = place.withColumn("w", w).withColumn("ratio", F.col("source_size") * cap / F.col("w"))
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    if not whole.w:
        return sizes.withColumn("target", F.lit(0.0))
    filled = numbering.running(weighed, ["ratio", "place"], capped=F.col("source_size"), weight=F.col("w"))
    left = F.lit(share * whole.size) - cap * (F.col("capped") - F.col("source_size"))
    level = left / (F.lit(whole.w) - (F.col("weight") - F.col("w")))  # if all sources before are at their cap
    found = filled.select("ratio", "place", level.alias("level")).where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "place"))).first()[0]
    target = F.col("source_size") * float(cap) if found is None else F.least(F.col("source_size") * float(cap), F.col("w") * F.lit(found))
    return weighed.select("no_source", "name", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of documents (doc_id, source, text)."""
    words = docs.select("doc_id", F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"), size(F.col("text")).alias("size"), "text")
    drawn = materialize(words.select("doc_id", "no_source", "name", "size", draw(seed, quality(F.col("text"), F.col("size"))).alias("key")), "drawn")
    goals = materialize(targets(drawn.groupBy("no_source", "name").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    summed = numbering.running(drawn, ["key", "doc_id", "size"], ["no_source", "name"], upto=F.col("size")).join(goals, ["no_source", "name"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("upto") - F.col("size"))))
    return summed.select("doc_id", F.when(~F.col("no_source"), F.col("name")).alias("source"), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def op13_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


_WORD = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = f"""WITH words AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
  length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS solid, length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) AS letters FROM documents),
drawn AS (SELECT doc_id, source, size, -ln((CAST('0x' || substr(md5(concat_ws('|', '{SEED}', CAST(doc_id AS VARCHAR))), 1, 13) AS BIGINT) + 1) / 4503599627370496.0)
  / (1 + CAST(size >= 50 AS INTEGER) + coalesce(CAST(solid >= 3 * size AND solid <= 10 * size AS INTEGER), 0) + coalesce(CAST(letters * 5 >= solid * 4 AS INTEGER), 0)) AS key FROM words),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM drawn GROUP BY source),
filled AS (SELECT s, w, 2 * s / w AS ratio, (1.5 * sum(s) OVER () - 2 * (sum(s) OVER o - s)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level FROM sources WINDOW o AS (ORDER BY 2 * s / w, source NULLS LAST)),
goals AS (SELECT source, s, least(2.0 * s, w * (SELECT arg_min(level, ratio) FROM filled WHERE level <= ratio)) AS target FROM sources),
summed AS (SELECT doc_id, d.size, s, target, CASE WHEN s > 0 THEN CAST(floor(target) AS BIGINT) // s ELSE 0 END AS epochs, sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto FROM drawn d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, s AS source_size, CAST(target AS DOUBLE) AS target, CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * s - (upto - size))) AS BIGINT) AS taken FROM summed"""
