"""Toxicity by weak supervision.

1. A lexicon is mined from labelled rows outside the held-out fold (at most SAMPLE of them, drawn by hash): words and
   word beginnings that mark toxic documents by occurring, or by occurring densely (once in DENSE words or more).
2. Voters: a lexicon voter for each of the first VOTERS roots (it votes toxic if a term of its root occurs) and as many
   for dense terms, and pattern voters.
3. A generative label model (EM) estimates each voter's accuracy under either class and the correlations of voters
   within a class; a voter correlated with others counts for less. The given label is one more voter.
4. A linear classifier is trained on the posterior labels and scores every whole text; labels, lang, source and
   doc_id never enter a score.

The sample's bound makes all fitted state (LEXICON terms, voters, weights) bounded; scoring is a map over all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled sample, terms kept, toxic documents a term needs, how often likelier it must be in them.
SAMPLE, LEXICON, MIN_TOXIC, LIFT = 12_000, 512, 4, 5
VOTERS, PREFIXES = 64, (4, 5, 6)
#: A term is dense in a text if it makes up a DENSE-th of the words or more. Its name then begins with MARK.
DENSE, MARK = 150, "+"
ROUNDS, RIDGE, CUT = 25, 0.1, 0.7
_WORD = re.compile(r"[^\W\d_]+")
_BURST = re.compile(r"[!?]{2,}")


def terms(text: str) -> set[str]:
    """The distinct words of a whole text and, marked by a final *, their beginnings; those that are dense twice, marked and not."""
    words = Counter(_WORD.findall(text.lower()))
    found = Counter(words)
    for w, c in words.items():
        for n in PREFIXES:
            if len(w) > n:
                found[w[:n] + "*"] += c
    least = words.total() / DENSE
    return {*found, *(MARK + t for t, c in found.items() if c >= least)}


def root(term: str) -> str:
    """What terms of one voter share: the first letters, and whether they are dense."""
    return term[: PREFIXES[0] + (term[0] == MARK)]


def patterns(text: str) -> list[bool]:
    """Pattern voters: shouting, bursts of ! and ?, and one token that fills most of the text."""
    letters = sum(map(str.isalpha, text)) if text.isupper() else 0
    words = text.split()
    return [letters > 20, len(_BURST.findall(text)) > 2, len(words) > 20 and len(set(words)) < len(words) / 5]


PATTERNS = len(patterns(""))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of at most about SAMPLE labelled rows outside the held-out fold, the same for any partitioning."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, SAMPLE / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return texts.join(F.broadcast(drawn), "doc_id")  # at most about SAMPLE rows of 12 bytes


def mine(rows: DataFrame) -> list[str]:
    """The LEXICON terms that tell toxic documents best, best first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [(t, y) for x, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()) for t in terms(x)]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())], ["term", "toxic"])

    n, toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not toxic or toxic == n:
        return []
    counted = rows.select("text", "toxic").mapInArrow(count, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    p1, p0, p = F.col("t") / toxic, (F.col("n") - F.col("t")) / (n - toxic), F.col("n") / n
    z = (p1 - p0) / F.sqrt(p * (1 - p + 1 / n) * (1 / toxic + 1 / (n - toxic)))
    best = counted.where(F.col("t") >= MIN_TOXIC).where(p1 > LIFT * p0).select("term", z.alias("z")).orderBy(F.desc("z"), "term").limit(LEXICON)
    return [r.term for r in best.collect()]


def label_model(votes: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row of 0/1 votes; accuracies, correlations and discounts of the voters."""
    v = np.column_stack([votes, gold]).astype(float)
    post = np.clip(gold.astype(float), 0.05, 0.95)
    for _ in range(ROUNDS):
        rates, inside = [], np.zeros((v.shape[1],) * 2)
        for w in (post, 1 - post):
            rate = (w @ v + 1) / (w.sum() + 2)
            rates.append(rate)
            d = (v - rate) * np.sqrt(w)[:, None]
            cov = d.T @ d / w.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            inside += np.abs(cov / np.outer(sd, sd)) * w.mean()
        np.fill_diagonal(inside, 0)
        inside[inside < 3 / np.sqrt(len(v))] = 0  # what chance alone would show
        discount = 1 / (1 + inside.sum(axis=1))
        discount[-1] = 1  # the given label
        hit, miss = np.log(rates[0] / rates[1]), np.log((1 - rates[0]) / (1 - rates[1]))
        logit = np.log(post.mean() / (1 - post.mean())) + v @ (discount * hit) + (1 - v) @ (discount * miss)
        post = np.clip(1 / (1 + np.exp(-logit)), 1e-4, 1 - 1e-4)
    return post, {"toxic_rate": rates[0], "clean_rate": rates[1], "correlation": inside, "discount": discount}


def fit_linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge on soft labels, by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))]).astype(float)
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.full(x.shape[1] - 1, RIDGE), 1e-3]
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), grad)
    return w


class Model:
    """lexicon terms with their weights, pattern weights and the intercept."""

    def __init__(self, lexicon: list[str], weights: np.ndarray, voters: dict | None = None):
        self.weight = dict(zip(lexicon, weights[: len(lexicon)].tolist()))
        self.pattern, self.intercept, self.voters = weights[len(lexicon) : -1].tolist(), float(weights[-1]), voters
        known = {t.removeprefix(MARK) for t in self.weight}
        #: (weight of a term that occurs, further weight if it is dense) by term
        self.words = {t: (self.weight.get(t, 0.0), self.weight.get(MARK + t, 0.0)) for t in known}
        self.starts = {n: {t[:-1] for t in known if t[-1] == "*" and len(t) == n + 1} for n in PREFIXES}

    def score(self, text: str) -> float:
        hits: dict[str, int] = {}
        words = Counter(_WORD.findall(text.lower()))
        for w, c in words.items():
            if w in self.words:
                hits[w] = hits.get(w, 0) + c
            for n, known in self.starts.items():
                if len(w) > n and w[:n] in known:
                    hits[w[:n] + "*"] = hits.get(w[:n] + "*", 0) + c
        least = words.total() / DENSE
        found = sum(self.words[t][0] + (self.words[t][1] if c >= least else 0.0) for t, c in hits.items())
        total = self.intercept + found + sum(w for w, v in zip(self.pattern, patterns(text)) if v)
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Without labelled rows of both classes every text scores the share of toxic rows (0 if there are none)."""
    rows = sample(docs, labels)
    lexicon = mine(rows)
    if not lexicon:
        n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        p = np.clip(toxic / n if n else 0.0, 1e-6, 1 - 1e-6)
        return Model([], np.r_[np.zeros(PATTERNS), np.log(p / (1 - p))])
    at = {t: i for i, t in enumerate(lexicon)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, kind = batch.column("text").to_pylist(), pa.list_(pa.int32())
            hits = [sorted(at[t] for t in terms(t_) if t in at) + [len(at) + i for i, v in enumerate(patterns(t_)) if v] for t_ in x]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(hits, kind)], ["doc_id", "toxic", "hits"])

    # at most about SAMPLE short rows reach the driver
    got = rows.select("doc_id", "text", "toxic").mapInArrow(features, "doc_id long, toxic int, hits array<int>").collect()
    got.sort(key=lambda r: (r.doc_id, r.hits))
    x, gold = np.zeros((len(got), len(lexicon) + PATTERNS), np.float32), np.array([r.toxic for r in got])
    for i, r in enumerate(got):
        x[i, r.hits] = 1
    roots = list(dict.fromkeys(map(root, lexicon)))  # terms of one root share a voter
    kept = [r for dense in (False, True) for r in [r for r in roots if (r[0] == MARK) == dense][:VOTERS]]
    owner = np.array(list(map(root, lexicon)))
    votes = np.column_stack([x[:, : len(lexicon)][:, owner == r].any(axis=1) for r in kept] + [x[:, len(lexicon) :]])
    post, voters = label_model(votes, gold)
    return Model(lexicon, fit_linear(x, post), voters)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; a null text scores as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
