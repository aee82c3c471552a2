"""Best-fit decreasing packing of token sequences, with a segment tree over remaining capacities.

Tokenising happens once, in tasks; only (doc_id, piece, start, length, crc) rows go on. Pieces are dealt by hash to
shards of about SHARD pieces each, all drawn from the same mix of lengths, and every shard is packed by itself, so a
task's memory is bounded and a shard leaves at most a few sequences open. Each piece finds the tightest open
sequence in log2(CAPACITY) steps.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, materialize, runs, sorted_runs

CAPACITY, SHARD, END = 2048, 65_536, 0
SPECIAL = {"<|endoftext|>": 50256}
TOKENIZER = "byte_bpe_50k.tiktoken"  # the vocabulary of byte_bpe_50k.json as ranks: the same ids, at a quarter of the time
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(TOKENIZER), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("documents", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(text: str, path: str = "") -> list[int]:
    """The ids of a text, the special token's string included, without the end id."""
    return _encoding(path).encode(text, allowed_special="all", disallowed_special=())


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for the first, which takes the remainder."""
    head = n if n <= capacity else n % capacity or capacity
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "") -> DataFrame:
    """documents to pieces; a null text counts as empty (its end id alone), each row of the input is cut by itself."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*token_ids(text.as_py() or "", tokenizer), END], "<u4")
                for k, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


class OpenSequences:
    """Open sequences by remaining capacity; a segment tree over the capacities counts them."""

    def __init__(self, capacity: int):
        self.leaf = 1 << capacity.bit_length()
        self.count, self.at, self.made, self.capacity = [0] * (2 * self.leaf), {}, 0, capacity

    def _add(self, room: int, n: int) -> None:
        i = room + self.leaf
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of an open sequence that holds need."""
        i = need + self.leaf
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaf:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaf

    def put(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        room = self.tightest(length)
        if room is None:
            room, seq = self.capacity, self.made
            self.made += 1
        else:
            seq = self.at[room].pop()
            self._add(room, -1)
        if room > length:
            self.at.setdefault(room - length, []).append(seq)
            self._add(room - length, 1)
        return seq, self.capacity - room


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces given in decreasing length."""
    bins = OpenSequences(capacity)
    placed = np.array([bins.put(n) for n in lengths.tolist()], np.int64).reshape(-1, 2)
    return placed[:, 0], placed[:, 1]


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "") -> DataFrame:
    """documents to (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row a piece; no row is dropped."""
    cut = materialize(pieces(docs, capacity, tokenizer), "pieces")
    shards = max(1, -(-cut.count() // SHARD))
    names = cut.columns

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_runs(batches, "shard"):
            at = runs(part["shard"])
            for s, e in zip(at[:-1], at[1:]):
                seq, offset = best_fit(part["length"][s:e], capacity)
                cols = [pa.array(part[n][s:e], from_pandas=True) if n != "doc_id" else pa.array(part[n][s:e], mask=~part["known"][s:e]) for n in names]
                out = pa.RecordBatch.from_arrays([*cols, pa.array(seq + (int(part["shard"][s]) << 40)), pa.array(offset)], [*names, "sequence_id", "offset"])
                for i in range(0, out.num_rows, BATCH_ROWS):
                    yield out.slice(i, BATCH_ROWS)

    dealt = cut.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), *names[1:], F.col("doc_id").isNotNull().alias("known"), F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).alias("shard"))
    grouped = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece")
    return grouped.mapInArrow(fill, f"{PIECES}, sequence_id long, offset long")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
