"""Language identification by hyperdimensional profiles.

Every letter has a random +1/-1 vector (seeded by its code point), an n-gram is the product of its letters' vectors,
each rolled by its place, a document is the sum of its n-grams, and a language is the sum of its documents' unit
vectors. Documents and languages are compared by cosine, both without the part that all languages share.
Training sums vectors in tasks and then by (language, coordinate); DIM numbers a language reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM, NGRAM, SEED, CACHE, DOCS, TEMPERATURE = 1024, 3, 7, 16_384, 128, 0.05
#: Below this cosine to every language a document isn't text of any of them.
REJECT_BELOW = 0.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=4096)
def _letter(code: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, DIM).astype(np.float32) * 2 - 1


def ngrams(text: str) -> np.ndarray:
    """Packed letter n-grams of the whole text; all that isn't a letter is one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.where(_letters()[codes], codes, 0)
    codes = np.r_[0, codes, 0]
    codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
    return (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:] if len(codes) > 2 else codes[:0]


class NgramVectors:
    """Bound n-gram vectors, made when first met; starts anew when CACHE are held."""

    def __init__(self) -> None:
        self.at: dict[int, int] = {}
        self.rows = np.zeros((CACHE, DIM), np.float32)

    def of(self, grams: list[int]) -> np.ndarray:
        if len(self.at) + len(grams) > CACHE:
            self.at = {}
        for g in grams:
            if g not in self.at:
                self.rows[len(self.at)] = np.roll(_letter(g >> 42), 2) * np.roll(_letter((g >> 21) & 0x1FFFFF), 1) * _letter(g & 0x1FFFFF)
                self.at[g] = len(self.at)
        return self.rows[[self.at[g] for g in grams]]


def vectors(texts: list[str | None], bound: NgramVectors) -> np.ndarray:
    """Unit document vectors (zero for texts without a letter)."""
    grams = [ngrams(t or "") for t in texts]
    out = np.zeros((len(texts), DIM), np.float32)
    doc = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    known, where = np.unique(np.concatenate(grams), return_inverse=True)
    for at in range(0, len(known), CACHE // 4):
        part, mine = known[at : at + CACHE // 4], (where >= at) & (where < at + CACHE // 4)
        counts = np.bincount(doc[mine] * len(part) + where[mine] - at, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        out += counts.astype(np.float32) @ bound.of(part.tolist())
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _documents(docs: DataFrame, *more: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"), *more)


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """Language profiles from rows with a doc_id outside the held-out fold, a language and a letter."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound, total = NgramVectors(), {}
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            for at in range(0, batch.num_rows, DOCS):
                found = vectors(batch.column("text").slice(at, DOCS).to_pylist(), bound)
                for name in set(lang[at : at + DOCS]):
                    mine = found[lang[at : at + DOCS] == name]
                    total[name] = total.get(name, 0) + mine[mine.any(axis=1)].sum(axis=0, dtype=np.float64)
        for name, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(x)], ["lang", "i", "x"])

    rows = _documents(docs, F.col("lang").cast("string").alias("lang")).where("not held_out and doc_id is not null and lang is not null and text is not null")
    found = rows.mapInArrow(sums, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for lang, i, x in found:
        out.setdefault(lang, np.zeros(DIM))[i] = x
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if v.any()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cosine) for each row; und, 0 and 0 for a null text, one without a letter or no profiles."""
    names = [*profiles, UNKNOWN]
    plain = np.array([*profiles.values()], np.float32).reshape(-1, DIM)
    shared = plain.mean(axis=0) if len(profiles) > 1 else np.zeros(DIM, np.float32)
    own = plain - shared
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = NgramVectors()
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                x = vectors(part.column("text").to_pylist(), bound)
                rest = x - (x @ shared)[:, None] / max(float(shared @ shared), 1e-9) * shared
                cos = rest / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-9) @ own.T
                known = x.any(axis=1) & bool(len(profiles))
                best = np.where(known, cos.argmax(axis=1) if len(profiles) else 0, len(profiles))
                e = np.exp((cos - cos.max(axis=1, keepdims=True)) / TEMPERATURE) if len(profiles) else np.zeros((len(x), 1))
                score = np.where(known, e.max(axis=1) / np.maximum(e.sum(axis=1), 1e-9), 0.0)
                near = np.where(known, (x @ plain.T).max(axis=1) if len(profiles) else 0, 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array([names[i] for i in best]), pa.array(score.astype(float)), pa.array(near.astype(float))], ["doc_id", "held_out", "lang_pred", "score", "cosine"])

    return _documents(docs).mapInArrow(guess, "doc_id long, held_out boolean, lang_pred string, score double, cosine double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents, without those in no learned language: und, or a cosine under REJECT_BELOW. Null doc_ids stay."""
    goes = identify(docs).where((F.col("lang_pred") == UNKNOWN) | (F.col("cosine") < REJECT_BELOW))
    goes = goes.where("doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(goes, docs["doc_id"] == goes["__gone"], "left_anti")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
