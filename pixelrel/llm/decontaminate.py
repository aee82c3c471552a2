"""Benchmark decontamination by spaced seeds, DataFrame functions only.

Fixed masks of SPAN tokens ignore some positions, so a seed still matches where tokens there were substituted. The
seeds of every position of every document are joined with those of the benchmark items; around each hit the item is
laid over the document along the hit's diagonal, and the overlap is verified: in some window of WINDOW tokens (the
whole item, if shorter) at least the share AGREE must be equal.

From WHOLE tokens on no accepted overlap is without a seed. Shorter items have masks of their own, laid over the whole
item: it is cut into more parts than tokens may differ, and each mask leaves out as many parts as that.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# fixed values: 1 is a compared position, 0 an ignored one
MASKS = ("11101001", "11010011", "10100111")
SPAN, WINDOW, AGREE = len(MASKS[0]), 13, 0.8
#: Benchmark seeds are broadcast up to so many rows (24 bytes each), beyond that both sides are shuffled by seed.
BROADCAST_SEEDS = 500_000
#: Items under so many tokens have masks of their own.
WHOLE = 12


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits, in order."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(words: Column) -> Column:
    """len(MASKS) seed hashes for each start, in order; an empty array for fewer than SPAN tokens."""

    def at(i: Column) -> list[Column]:
        return [F.xxhash64(F.lit(m), *(F.get(words, i + j) for j, used in enumerate(mask) if used == "1")) for m, mask in enumerate(MASKS)]

    starts = F.sequence(F.lit(0), F.size(words) - SPAN)
    return F.when(F.size(words) >= SPAN, F.flatten(F.transform(starts, lambda i: F.array(*at(i)))))


def _seed_rows(rows: DataFrame, key: str, at: str) -> DataFrame:
    found = rows.select(key, F.posexplode(seeds(F.col("words"))).alias("p", "seed"))
    return found.select(key, "seed", F.expr(f"cast(p div {len(MASKS)} as int)").alias(at))


def short_masks(n: int) -> list[tuple[int, str]]:
    """(place, mask) over an item of n tokens, such that any tokens that may differ are all outside of some mask."""
    may = n - math.ceil(n * AGREE)
    parts = min(n, may + 2) if may else 1
    cuts = [k * n // parts for k in range(parts + 1)]
    found = []
    for left in combinations(range(parts), may):
        used = [k for p in range(parts) if p not in left for k in range(cuts[p], cuts[p + 1])]
        found.append((used[0], "".join("01"[k in used] for k in range(used[0], used[-1] + 1))))
    return found


def _short_hits(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """(doc_id, item_id, diagonal) where a mask of an item under WHOLE tokens agrees; only masks of lengths that occur are sought."""
    lengths = sorted(r.n for r in items.select(F.size("words").alias("n")).where(f"n between 1 and {WHOLE - 1}").distinct().collect())
    masks = sorted({mask for n in lengths for _, mask in short_masks(n)})
    if not masks:
        return None
    seed = lambda mask, at: F.xxhash64(F.lit(mask), *(F.get("words", at + j) for j, used in enumerate(mask) if used == "1"))
    theirs = reduce(DataFrame.union, [
        items.where(F.size("words") == n).select("item_id", F.lit(n).alias("n"), F.explode(F.array(*[F.struct(seed(mask, F.lit(at)).alias("seed"), F.lit(at).alias("at")) for at, mask in short_masks(n)])).alias("s")).select("item_id", "n", "s.*")
        for n in lengths
    ]).distinct()
    if theirs.count() <= BROADCAST_SEEDS:
        theirs = F.broadcast(theirs)
    # a mask that goes beyond the document's end has no seed
    every = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array(*[F.when(i + len(mask) <= F.size("words"), seed(mask, i)) for mask in masks]))
    ours = docs.where(F.size("words") > 0).select("doc_id", F.posexplode(F.flatten(every)).alias("p", "seed")).where("seed is not null")
    met = ours.join(theirs, "seed").select("doc_id", "item_id", "n", (F.expr(f"cast(p div {len(masks)} as int)") - F.col("at")).alias("diagonal"))
    # where no token may differ, one hit tells as much as all
    exact = F.col("n") == F.ceil(F.col("n") * AGREE)
    first = met.where(exact).groupBy("doc_id", "item_id").agg(F.min("diagonal").alias("diagonal"))
    return first.union(met.where(~exact).select("doc_id", "item_id", "diagonal").distinct())


def _named(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).where(F.col(key).isNotNull() & F.col("text").isNotNull())


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched int, compared int): the best verified overlap of each document and benchmark item.

    Rows with a null id or text match nothing, nor do texts without a token. Rows that repeat a doc_id count as one
    document with several texts. The whole of every text is read.
    """
    items = materialize(_named(benchmark, "item_id").select("item_id", tokens(F.col("text")).alias("words")), "items")
    theirs = _seed_rows(items.where(F.size("words") >= WHOLE), "item_id", "at").distinct()
    texts = _named(docs, "doc_id").select("doc_id", tokens(F.col("text")).alias("words"))
    ours = _seed_rows(texts, "doc_id", "i")
    if theirs.count() <= BROADCAST_SEEDS:
        theirs = F.broadcast(theirs)
    hits = ours.join(theirs, "seed").select("doc_id", "item_id", (F.col("i") - F.col("at")).alias("diagonal")).distinct()
    short = _short_hits(texts, items)
    hits = hits.union(short) if short is not None else hits
    hits = materialize(hits.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonal")).alias("hits")), "hits")

    # only documents with a hit are tokenised again; each hit takes along its stretch of the document
    # a stretch ends with the item, whose length is at most the longest item's
    longest = items.agg(F.max(F.size("words"))).first()[0] or 0
    laid = _named(docs, "doc_id").join(hits, "doc_id").select("doc_id", "hits", tokens(F.col("text")).alias("w"))
    stretch = F.transform("hits", lambda h: F.struct(
        h["item_id"].alias("item_id"), F.least(h["diagonal"], F.lit(0)).alias("before"),
        F.slice(F.col("w"), F.greatest(h["diagonal"], F.lit(0)) + 1, F.lit(longest)).alias("part"),
    ))
    laid = laid.select("doc_id", F.explode(stretch).alias("s")).select("doc_id", "s.*")
    both = laid.join(items, "item_id")
    same = F.transform("words", lambda w, j: F.coalesce(F.get(F.col("part"), j + F.col("before")) == w, F.lit(False)).cast("int"))
    size = F.least(F.size("words"), F.lit(WINDOW))
    counted = both.select("doc_id", "item_id", same.alias("same"), size.alias("compared"))
    inside = F.transform(F.sequence(F.lit(0), F.size("same") - F.col("compared")), lambda s: F.aggregate(F.slice(F.col("same"), s + 1, F.col("compared")), F.lit(0), lambda a, b: a + b))
    best = counted.select("doc_id", "item_id", "compared", F.array_max(inside).alias("matched")).where(F.col("matched") >= F.ceil(F.col("compared") * AGREE))
    return best.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("compared").alias("compared"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, without those that overlap a benchmark item. Null doc_ids stay."""
    goes = overlaps(docs, benchmark).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(goes, docs["doc_id"] == goes["__gone"], "left_anti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_EQUAL = {m: [j for j, used in enumerate(mask) if used == "1"] for m, mask in enumerate(MASKS)}
_TOKENS = "[x for x in regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+') if x <> '']"


def _sql(docs: str, benchmark: str) -> str:
    """The same result as SQL over relations with doc_id, text and item_id, text."""
    spaced = lambda a: " UNION ALL ".join(
        f"SELECT {a}id, i, {m} AS mask, " + " || ' ' || ".join(f"w[i + {j + 1}]" for j in used) + f" AS seed FROM {a}at" for m, used in _EQUAL.items()
    )
    return f"""
WITH dt AS (SELECT doc_id AS did, {_TOKENS.format("text")} AS w FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
bt AS (SELECT item_id AS bid, {_TOKENS.format("text")} AS w FROM {benchmark} WHERE item_id IS NOT NULL AND text IS NOT NULL),
dat AS (SELECT did, w, unnest(range(0, len(w) - {SPAN - 1})) AS i FROM dt WHERE len(w) >= {SPAN}),
bat AS (SELECT bid, w, unnest(range(0, len(w) - {SPAN - 1})) AS i FROM bt WHERE len(w) >= {SPAN}),
ds AS ({spaced("d")}), bs AS ({spaced("b")}),
hits AS (SELECT DISTINCT ds.did, bs.bid, ds.i - bs.i AS diagonal FROM ds JOIN bs USING (mask, seed)),
cells AS (
  SELECT h.did, h.bid, h.diagonal, j, len(bt.w) AS n, CASE WHEN h.diagonal + j >= 0 AND dt.w[h.diagonal + j + 1] = bt.w[j + 1] THEN 1 ELSE 0 END AS same
  FROM hits h JOIN dt ON dt.did = h.did JOIN (SELECT *, unnest(range(0, len(w))) AS j FROM bt) bt ON bt.bid = h.bid
),
sums AS (
  SELECT did, bid, n, j, least(n, {WINDOW}) AS compared,
    sum(same) OVER (PARTITION BY did, bid, diagonal ORDER BY j ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS matched
  FROM cells
)
SELECT did AS doc_id, bid AS item_id, CAST(max(matched) AS INTEGER) AS matched, CAST(max(compared) AS INTEGER) AS compared
FROM sums WHERE j >= compared - 1 AND matched >= ceil(compared * {AGREE}) GROUP BY did, bid"""


ORACLE_SQL = _sql("documents", "benchmark")
