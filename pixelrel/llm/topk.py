"""Exact top-k by inner product over a pivot-distance index.

Equal vectors are one entry that keeps its K + 1 smallest ids: no other copy can reach a result. With M the largest
squared norm, the added coordinate sqrt(M - |x|^2) turns the largest inner product into the smallest Euclidean
distance, so the triangle inequality holds: an entry at distance r from its nearest pivot lies no nearer to query q
than |d(q, pivot) - r|. Entries are keyed by (pivot, distance ring); rings are cut to BLOCK rows.

The directory has a row an annulus, PIVOTS x (RINGS + 1) at most, and only that reaches the driver and the tasks; an
annulus of many entries is dealt by hash into blocks of about BLOCK, which are numbered and need no rows of their own.

Search is in two steps: a block of each of the nearest annuli gives a lower bound of a query's k-th score, then the
query goes to every block of every annulus whose triangle bound reaches that score. Queries travel in packs, so the rows
that are shuffled are packs times blocks, and a task scores one block against one pack.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

K, PIVOTS, PIVOT_SAMPLE, RINGS, BLOCK = 5, 64, 4_096, 32, 4_096
#: Queries that travel together, such packs in a task, annuli of the first step beyond those that hold K entries.
PACK, PACKS, PROBES = 256, 64, 4


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * component), computed in double. Vectors that are null, empty, or hold a
    null or non-finite component take no part, nor do rows without vec_id."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & ~F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    )
    return good.select("vec_id", F.transform("v", lambda v: F.floor(v * scale)).alias("x"))


def entries(rows: DataFrame, k: int = K) -> DataFrame:
    """(vec_id, x) to distinct vectors (x, ids array<long>: the k + 1 smallest), salted first: the copies of one
    vector may be a third of all rows."""
    few = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, k + 1)
    dealt = rows.groupBy("x", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(few(F.collect_list("vec_id")).alias("ids"))
    return dealt.groupBy("x").agg(few(F.flatten(F.collect_list("ids"))).alias("ids"))


def _pivots(rows: DataFrame) -> np.ndarray:
    """PIVOTS vectors far apart, chosen from a bounded sample by hash."""
    drawn = rows.select("x").orderBy(F.xxhash64("x"), "x").limit(PIVOT_SAMPLE).collect()
    sample = np.array([r.x for r in drawn], np.float64)
    chosen = [0]
    near = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(PIVOTS, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def build_index(rows: DataFrame, top: float, pivots: np.ndarray) -> DataFrame:
    """Entries with their annulus: (pivot int, ring int, distance double, x, ids, extra double)."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = _matrix(f["x"])
                extra = np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))
                d2 = (x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1)
                near = d2.argmin(axis=1)
                full = np.sqrt(np.maximum(d2[np.arange(len(x)), near], 0) + extra * extra)
                yield f.assign(pivot=near.astype(np.int32), distance=full, extra=extra)

    placed = rows.mapInPandas(place, "x array<long>, ids array<long>, pivot int, distance double, extra double")
    width = max(1.0, 2 * float(np.sqrt(top)) / RINGS)
    ring = placed.withColumn("ring", F.floor(F.col("distance") / width).cast("int"))
    sizes = ring.groupBy("pivot", "ring").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("x"), F.ceil(F.col("n") / BLOCK)).cast("int")
    return ring.join(F.broadcast(sizes), ["pivot", "ring"]).withColumn("block", block).drop("n")  # PIVOTS x rings rows at most


def search(queries: DataFrame, vectors: DataFrame, k: int = K, scale: int = 256) -> DataFrame:
    """(query_id, rank int, vec_id, score): for each query row (vec_id, embedding) its k highest inner products among
    all rows of another vec_id, ties to the smaller vec_id; fewer if there are fewer. Repeated query rows count once.
    Vectors and queries of another length than the vectors' commonest (the longer of equally common ones) take no part."""
    rows = materialize(entries(integers(vectors, scale), k), "entries")
    lengths = rows.groupBy(F.size("x").alias("n")).agg(F.sum(F.size("ids")).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    if lengths:
        rows = rows.where(F.size("x") == lengths.n)
    top = rows.agg(F.max(F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v * v))).first()[0]
    if top is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots, p2 = (p := _pivots(rows)), (p * p).sum(axis=1)
    index = materialize(build_index(rows, float(top), pivots), "index")
    # the directory: a row an annulus, so PIVOTS x (RINGS + 1) at most
    annuli = index.groupBy("pivot", "ring").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count("*").alias("n"), (F.max("block") + 1).alias("blocks")).orderBy("pivot", "ring").toPandas()
    ap, lo, hi, blocks = (annuli[c].to_numpy() for c in ("pivot", "lo", "hi", "blocks"))
    n = annuli["n"].to_numpy() // blocks  # about what a block holds
    keys = (annuli["pivot"].to_numpy(np.int64) << 40) | (annuli["ring"].to_numpy(np.int64) << 20)
    asked = materialize(integers(queries, scale).where(F.size("x") == lengths.n).select(F.col("vec_id").alias("query_id"), "x").distinct(), "queries")
    parts = max(1, -(-asked.count() // (PACK * PACKS)))

    def bounds(x: np.ndarray) -> np.ndarray:
        """For each query and annulus, what no inner product exceeds. Queries and pivots have added coordinate 0."""
        q2 = (x * x).sum(axis=1)[:, None]
        d = np.sqrt(np.maximum(q2 - 2 * x @ pivots.T + p2, 0))[:, ap]
        gap = np.maximum(np.maximum(lo - d, d - hi), 0)
        return (q2 + top - gap * gap) / 2

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), PACK):
                f = frame.iloc[at : at + PACK]
                x = _matrix(f["x"])
                up = bounds(x)
                if "least" in f:
                    go = up + 1e-6 * (1 + np.abs(up)) >= f["least"].to_numpy()[:, None]
                else:  # the annuli that promise most, until they hold k others
                    order = np.argsort(-up, axis=1, kind="stable")
                    some = np.arange(len(n)) < (np.cumsum(n[order], axis=1) < k + 1).sum(axis=1)[:, None] + PROBES
                    go = np.zeros(up.shape, bool)
                    np.put_along_axis(go, order, some, axis=1)
                ids, short, part = f["query_id"].to_numpy(), x.astype("<i2" if np.abs(x).max() < 32_000 else "<i8"), zlib.crc32(str(f["query_id"].iloc[0]).encode()) % parts
                hit = np.flatnonzero(go.any(axis=0))
                first, last = (0, blocks[hit] - 1) if "least" in f else (at // PACK % blocks[hit],) * 2  # every block, or one
                yield pd.DataFrame({"key": keys[hit], "first": first, "last": last, "part": part, "qids": [ids[go[:, j]].tolist() for j in hit], "qx": [short[go[:, j]].tobytes() for j in hit]})

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            right = right.iloc[right["ids"].str[0].argsort(kind="stable")]  # by smallest id: of equal scores the first ones count
            e, ids = np.array(right["x"].tolist(), np.int64), right["ids"].tolist()
            for qids, qx in zip(left["qids"], left["qx"]):
                q = np.frombuffer(qx, f"<i{len(qx) // len(qids) // e.shape[1]}").reshape(len(qids), -1)
                small = float(np.abs(q).max()) * float(np.abs(e).max()) * e.shape[1] < 2**53  # then products are exact in double
                s = q.astype(float) @ e.T.astype(float) if small else q.astype(np.int64) @ e.T
                at = max(0, s.shape[1] - k - 1)
                least = np.partition(s, at, axis=1)[:, at]
                for a, row in enumerate(s):
                    best = np.r_[np.flatnonzero(row > least[a]), np.flatnonzero(row == least[a])[: k + 1]]
                    out += [(qids[a], v, int(row[b])) for b in best for v in ids[b] if v != qids[a]]
        found = pd.DataFrame(np.array(out, np.int64).reshape(-1, 3), columns=["query_id", "vec_id", "score"])
        return found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)

    key = F.shiftleft(F.col("pivot").cast("long"), 40) + F.shiftleft(F.col("ring").cast("long"), 20) + F.col("block")
    held = index.select(key.alias("key"), "x", "ids")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def visit(some: DataFrame) -> DataFrame:
        sent = some.mapInPandas(route, "key long, first int, last int, part int, qids array<long>, qx binary")
        opened = sent.select("key", F.explode(F.sequence("first", "last")).alias("block"), "part", "qids", "qx")
        routed = materialize(opened.select((F.col("key") + F.col("block")).alias("key"), "part", "qids", "qx"), "routed")
        asked = routed.select(F.col("key").alias("asked"), F.col("part").alias("of")).distinct()  # annuli go where queries ask for them
        asked_of = held.join(asked, F.col("key") == F.col("asked")).select(F.col("asked").alias("key"), F.col("of").alias("part"), "x", "ids").groupBy("key", "part")
        found = routed.groupBy("key", "part").cogroup(asked_of).applyInPandas(score, "query_id long, vec_id long, score long")
        return found.withColumn("rank", F.row_number().over(best))

    least = visit(asked).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least"))
    bounded = materialize(asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "bounds")
    return visit(bounded).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors.where("vec_id % 50 = 0"), vectors)
