"""Centroid clustering with exact results: Lloyd's rounds over integer vectors, screened in single precision.

A task multiplies its vectors with all centroids in float32. Each product comes with an interval that holds the exact
value: rounding the two inputs and summing n products costs at most gamma(n + 2) * |c| * |x| in whatever order the
library adds (gamma(m) = m u / (1 - m u), u = 2 ** -24). Centroids whose lower bound exceeds the smallest upper bound
are out; where more than one is left, distances are computed in integers, and of equal ones the lowest number wins.

Tasks hand back a row a centroid with counts and sums, so a round shuffles little whatever the input is, and the driver
gets the new centroids only (clusters x components). Components are integers kept in doubles, which hold
floor(256 * x) of any float exactly. Sums travel as two limbs, so that they are exact too.

Cases: null or wrongly sized vectors, null or non-finite components, and components of 2 ** 128 or more (no float has
such) take no part. A row with a null vec_id is clustered like any other but never starts a centroid. Repeated rows
count as often as they occur. Fewer vectors than centroids start fewer centroids; without vectors the result is empty.
A distance or an inertia beyond a long is null. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

CENTROIDS, ROUNDS, COMPONENTS, SCALE, SEED = 40, 5, 64, 256, 2
#: int64 holds the squared distance of 64 components below SMALL; a limb; what no float component reaches.
SMALL, LIMB, HUGE, LONG = 1 << 27, 1 << 62, float(1 << 128), (1 << 63) - 1


def kept(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id long, x array<double>): floor(scale * component) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") == components)
    good = v.where(~F.exists("v", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) >= HUGE)))
    # floor() of a double is a long, so numbers beyond 2 ** 52, which are whole already, stay as they are
    return good.select("vec_id", F.transform("v", lambda a: F.when(F.abs(a * scale) < float(1 << 52), F.floor(a * scale).cast("double")).otherwise(a * scale)).alias("x"))


def first_centroids(rows: DataFrame, n: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The n vectors of smallest hash of their vec_id, in its order; of equal ids the smaller vector comes first."""
    named = rows.where("vec_id is not null").withColumn("h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")), 256))
    return [[int(c) for c in r.x] for r in named.orderBy("h", "x").limit(n).collect()]


class Assigner:
    """The nearest of a few centroids for many vectors, exactly."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = np.array(centroids, object)
        self.squares = np.array([float(sum(c * c for c in row)) for row in centroids])
        self.norms = np.sqrt(self.squares) * (1 + 2**-40)
        self.small = max(abs(c) for row in centroids for c in row) < SMALL
        self.single = self.exact.astype(float).astype(np.float32).T
        m = (self.exact.shape[1] + 2) * 2.0**-24
        self.gamma = m / (1 - m)
        if self.small:
            self.exact = self.exact.astype(np.int64)

    def shortlist(self, x: np.ndarray) -> np.ndarray:
        """(rows x centroids) False where a centroid can't be nearest. Bounds are those of |c|^2 - 2 c.x."""
        with np.errstate(all="ignore"):
            near = self.squares - 2 * (x.astype(np.float32) @ self.single).astype(float)
            size = np.sqrt((x * x).sum(axis=1))[:, None] * (1 + 2**-40) * self.norms
            error = 2 * self.gamma * size * (1 + 2**-20) + 2.0**-40 * (self.squares + 2 * size)
            error[~np.isfinite(near) | ~np.isfinite(error)] = np.inf
            near[~np.isfinite(near)] = 0.0
            return near - error <= (near + error).min(axis=1)[:, None]

    def distances(self, x: np.ndarray, rows: np.ndarray, cs: np.ndarray) -> np.ndarray:
        """Exact squared distances of pairs (row, centroid)."""
        if self.small and np.abs(x).max(initial=0.0) < SMALL:
            d = x[rows].astype(np.int64) - self.exact[cs]
            return (d * d).sum(axis=1)
        whole = np.array([[int(a) for a in r] for r in x], object)
        d = whole[rows] - self.exact[cs].astype(object)
        return (d * d).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row, and the squared distance."""
        rows, cs = np.nonzero(self.shortlist(x))  # by row, then by number
        d = self.distances(x, rows, cs)
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        least = np.minimum.reduceat(d, starts)
        hit = np.flatnonzero(d == np.repeat(least, np.diff(np.r_[starts, len(rows)])))
        first = hit[np.r_[True, rows[hit][1:] != rows[hit][:-1]]]
        return cs[first], least


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def next_centroids(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: each non-empty centroid becomes the floor of its vectors' mean."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, n = Assigner(centroids), len(centroids)
        counts, totals = np.zeros(n, np.int64), np.zeros((n, len(centroids[0])), object)
        for f in frames:
            if not len(f):
                continue
            x = _matrix(f["x"])
            cs = near.nearest(x)[0]
            counts += np.bincount(cs, minlength=n)
            if np.abs(x).max() < SMALL:
                part = np.zeros(totals.shape, np.int64)
                np.add.at(part, cs, x.astype(np.int64))
                totals = totals + part
            else:
                for c, row in zip(cs, x):
                    totals[c] += [int(a) for a in row]
        used = np.flatnonzero(counts)
        limbs = [[divmod(int(t), LIMB) for t in totals[c]] for c in used]
        if limbs:
            yield pd.DataFrame({"cluster": used.astype(np.int32), "n": counts[used], "high": [[Decimal(h) for h, _ in row] for row in limbs], "low": [[lo for _, lo in row] for row in limbs]})

    parts = rows.select("x").mapInPandas(sums, "cluster int, n long, high array<decimal(38,0)>, low array<long>")
    flat = parts.select("cluster", "n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "v"))
    whole = flat.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("v.high").alias("high"), F.sum(F.col("v.low").cast("decimal(38,0)")).alias("low"))
    out = [list(c) for c in centroids]
    for r in whole.collect():  # clusters x components
        out[r.cluster][r["at"]] = (int(r.high) * LIMB + int(r.low)) // r.n
    return out


def assign(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster int, distance long)."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = Assigner(centroids)
        for f in frames:
            if len(f):
                cs, d = near.nearest(_matrix(f["x"]))
                yield pd.DataFrame({"vec_id": f["vec_id"], "cluster": cs.astype(np.int32), "distance": pd.array([int(a) if a <= LONG else None for a in d], "Int64")})

    return rows.mapInPandas(place, "vec_id long, cluster int, distance long")


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, n: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of (vec_id, embedding), and the final centroids."""
    rows = materialize(kept(vectors, components, scale), "vectors")
    centroids = first_centroids(rows, n, seed)
    if not centroids:
        return rows.limit(0).selectExpr("vec_id", "0 as cluster", "0L as distance"), []
    for _ in range(rounds):
        centroids = next_centroids(rows, centroids)
    return materialize(assign(rows, centroids), "assigned"), centroids


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = assigned.groupBy("cluster").agg(F.when(F.count_if(F.col("distance").isNull()) == 0, exact).alias("s")).collect()  # a row a cluster
    total = None if any(r.s is None for r in per) else sum(int(r.s) for r in per)
    fits = lambda v: None if v is None or v > LONG else int(v)
    told = spark.createDataFrame([(r.cluster, fits(r.s), fits(total), digest(centroids[r.cluster])) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # CENTROIDS rows at most


def _oracle_sql(n: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the same rounds, all centroids against all vectors in whole numbers."""
    near = "SELECT vec_id, row, CAST(arg_min(k, (d, k)) AS INTEGER) AS k, min(d) AS d FROM (SELECT f.vec_id, f.row, c.k, sum((f.x - c.x) * (f.x - c.x)) AS d FROM flat f JOIN c{r} c USING (i) GROUP BY ALL) GROUP BY ALL"
    parts = [
        "good AS (SELECT vec_id, row_number() OVER () AS row, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        "flat AS MATERIALIZED (SELECT vec_id, row, i, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM good, (SELECT unnest(range(1, 65)) AS i))",
        f"c0 AS MATERIALIZED (SELECT k, i, x FROM flat JOIN (SELECT row, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM good ORDER BY k LIMIT {n}) USING (row))",
    ]
    for r in range(rounds):
        parts.append(f"n{r} AS MATERIALIZED ({near.format(r=r)})")
        parts.append(f"m{r} AS (SELECT k, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM n{r} JOIN flat USING (row) GROUP BY ALL)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, CASE WHEN n IS NULL THEN c.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x FROM c{r} c LEFT JOIN m{r} m ON m.k = c.k AND m.i = c.i)")
    parts.append(f"last AS MATERIALIZED ({near.format(r=rounds)})")
    parts.append(f"names AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k)")
    return f"WITH {', '.join(parts)} SELECT vec_id, k AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM last JOIN names USING (k)"


ORACLE_SQL = _oracle_sql()
