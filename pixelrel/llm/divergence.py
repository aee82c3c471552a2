"""Source divergence audit: how far the word use of the sources of a language lies apart, and which terms stand out.

Tasks count terms of whole texts and combine them before the shuffle. Terms in enough documents of a language are dealt
out by hash into blocks of about TERMS; a block is one dense int64 matrix of groups by terms. In it each group is
broadcast against all that follow, which gives a block's share of every pair, and its best terms. Shares are summed and
the best of the blocks merged by Spark. All arithmetic is in whole numbers.

Cases: null text, lang and source are ''. A row is a document, whatever its id, so repeated rows count again. Groups
without terms, and languages without a kept term, have pairs (all probabilities alike, or value 0). Texts of any length
are cut into pieces between words. No documents, no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_ROWS, materialize

MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Terms a block; cells of a block's matrix; distinct terms that a task holds before it hands its counts on; bytes of a piece of text.
TERMS, CELLS, HELD, PIECE = 4_096, 1 << 22, 400_000, 1 << 20
#: A-Z to a-z; all other ASCII that no term holds to a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    data, at = data.translate(TABLE), 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uses: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in uses.items():
            terms = list(found)
            for i in range(0, len(terms), BATCH_ROWS):
                some = terms[i : i + BATCH_ROWS]
                yield pa.record_batch({
                    "lang": pa.array([lang] * len(some), pa.string()), "source": pa.array([source] * len(some), pa.string()), "term": pa.array(some, pa.binary()).cast(pa.string()),
                    "n": pa.array([found[t] for t in some], pa.int64()), "docs": pa.array([docs[lang, source][t] for t in some], pa.int64()),
                })
        uses.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            own: set[bytes] = set()
            for words in pieces(text):
                uses[lang, source].update(words)
                own.update(words)
            docs[lang, source].update(own)
        if sum(map(len, uses.values())) > HELD:
            yield from out()
    yield from out()


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, first): occurrences of the terms in at least min_docs documents of their language; first
    marks one row of each term. docs: (lang, source, text) without nulls."""
    counted = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    met = counted.repartition("lang", "term")  # the only shuffle: sums and windows below keep it
    summed = met.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    marked = summed.withColumn("docs", F.sum("docs").over(term)).withColumn("first", (F.row_number().over(term.orderBy("source")) == 1).cast("int"))
    return marked.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "first")


def probability(count: np.ndarray, n: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (n + 2 terms)) by long division, three digits at a time: exact up to sums of 2 ** 53."""
    whole, rest = np.divmod(count + 2, n + 2 * terms)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, n + 2 * terms)
        whole = whole * 1000 + digit
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _tile(key, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """One block of a language: shares of pairs (part pair, item the later source), and the best terms of each group."""
    groups = groups.sort_values("source", key=lambda s: s.map(str.encode))
    names, (g, t) = groups["source"].tolist(), (len(groups), 0)
    terms = sorted(cells["term"].unique(), key=str.encode)
    t, at = len(terms), {s: i for i, s in enumerate(names)}
    counts = np.zeros((g, t), np.int64)
    counts[cells["source"].map(at).to_numpy(int), cells["term"].map({w: i for i, w in enumerate(terms)}).to_numpy(int)] = cells["n"].to_numpy(np.int64)
    n, v = groups["words"].to_numpy(np.int64), int(groups["terms"].iloc[0])
    p = probability(counts, n[:, None], v) if t else counts
    out: list[tuple[str, str, str, int]] = []
    for i in range(g - 1):
        shares = divergence(p[i], p[i + 1 :]).sum(axis=1)
        out += zip(["pair"] * len(shares), [names[i]] * len(shares), names[i + 1 :], shares.tolist())
    if t:
        q = probability(counts.sum(axis=0), n.sum(), v)
        for i in range(g):
            hit = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            f = divergence(p[i][hit], q[hit])
            best = np.argsort(-f, kind="stable")[:TOP]  # terms are in their order already
            out += [("term", names[i], terms[hit[b]], int(f[b])) for b in best]
    return pd.DataFrame(out, columns=["part", "source", "item", "value"]).assign(lang=key[0])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source)."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = materialize(kept_counts(rows, min_docs), "terms")
    words = counts.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    terms = counts.groupBy("lang").agg(F.sum("first").alias("terms"))
    groups = rows.select("lang", "source").distinct().join(words, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["words", "terms"])
    many = groups.groupBy("lang").agg(F.count("*").alias("many"))
    wide = F.greatest(F.lit(64), F.least(F.lit(TERMS), F.floor(F.lit(CELLS) / F.col("many"))))
    sized = materialize(groups.join(many, "lang").select("lang", "source", "words", "terms", F.greatest(F.lit(1), F.ceil(F.col("terms") / wide)).cast("int").alias("blocks")), "groups")
    cells = counts.join(sized.select("lang", "blocks").distinct(), "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term", "n")
    each = sized.select(F.col("lang").alias("of"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("no"), "source", "words", "terms")
    tiles = cells.groupBy("lang", "block").cogroup(each.groupBy("of", "no")).applyInPandas(_tile, "lang string, part string, source string, item string, value long")
    found = materialize(tiles, "tiles")
    half = found.where("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    pairs = half.union(half.select("lang", "part", "item", "source", "value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).select("lang", "source", "part", "item", "value", "rank")
    return ranked(pairs).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= TOP))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_P = "1 + (1000000000 * (CAST({c} AS HUGEINT) + 2)) // ({n} + 2 * v)"
_F = "CAST(((p - q) * (p - q)) // (p + q) AS BIGINT)"
ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {MIN_DOCS}),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
vs AS (SELECT lang, (SELECT count(*) FROM kept k WHERE k.lang = l.lang) AS v FROM (SELECT DISTINCT lang FROM groups) l),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
grid AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
ps AS MATERIALIZED (SELECT lang, source, term, n, {_P.format(c="n", n="sum(n) OVER (PARTITION BY lang, source)")} AS p FROM grid JOIN vs USING (lang)),
qs AS (SELECT lang, term, {_P.format(c="n", n="sum(n) OVER (PARTITION BY lang)")} AS q FROM (SELECT lang, term, sum(n) AS n FROM grid GROUP BY ALL) JOIN vs USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN
  (SELECT x.lang, x.source, y.source AS item, CAST(sum({_F.replace("q", "y.p").replace("(p", "(x.p")}) AS BIGINT) AS value FROM ps x JOIN ps y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, {_F} AS value FROM ps JOIN qs USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term) WHERE rank <= {TOP}"""
