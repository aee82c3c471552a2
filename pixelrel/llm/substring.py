"""Removal of repeated word sequences by suffix trees, partitioned by prefix.

A suffix starts at every word that WINDOW words follow; only its first WINDOW words matter here. Suffixes are grouped by
the anchor of that prefix: the ANCHOR-gram of smallest hash in it, set by content, so equal prefixes always share a
group, and a group is a bundle of subtrees. Groups that one document fills are dropped before any text is shipped (a
first pass counts the documents of an anchor, a second one keeps the anchors that several have);
neighbouring suffixes of one group travel as one passage. In a group the suffixes are sorted word by word; those that
share their first WINDOW words are an internal node of that depth, and whatever starts in it after the node's smallest
doc_id is a repeat. Runs of such starts along a document are its maximal repeats.

Groups of more than GROUP suffixes don't fit a task: they are split by the longest prefix, all WINDOW words, and by
document, and the smallest doc_ids of the parts are compared in a second step. Words are compared, not hashes; hashes
only deal the suffixes out.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_ROWS, materialize, runs, sorted_runs

WINDOW, ANCHOR = 13, 5
#: Suffixes of a group that a task sorts at most; suffixes in a passage; parts by document of a larger group's node.
GROUP, PASSAGE, SALTS = 65_536, 64, 32
_ODD = np.array([xxhash.xxh64_intdigest(f"word {i}") | 1 for i in range(WINDOW)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_word = xxhash.xxh64_intdigest


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all sequences of n neighbouring words."""
    size = max(len(words) - n + 1, 0)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out += words[j : j + size] * _ODD[j]
    return out


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word, words), np.uint64, len(words))


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """k-gram hashes, and for each window the place of its anchor (the leftmost of equal ones)."""
    grams = _grams(words, ANCHOR)
    if len(words) < WINDOW:
        return grams, np.zeros(0, np.int64)
    order = grams * _MIX
    order ^= order >> np.uint64(29)
    view = np.lib.stride_tricks.sliding_window_view(order, WINDOW - ANCHOR + 1)
    return grams, view.argmin(axis=1) + np.arange(len(view))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (anchor, doc_id, suffixes): how many suffixes of a document each anchor has."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, cols = batch.slice(at, 256), []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                grams, place = anchors(_hashes(text.as_py().encode().split()))
                found, counts = np.unique(grams[place], return_counts=True)
                cols.append((found.view(np.int64), np.full(len(found), doc, np.int64), counts))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols)], ["anchor", "doc_id", "suffixes"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their shared anchors to passages of up to PASSAGE neighbouring suffixes of one group."""
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
    names = ["anchor", "large", "doc_id", "row", "start", "suffixes", "words"]
    for batch in batches:
        out: list[tuple] = []
        for doc, row, text, shared in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), batch.column("anchors")):
            words = text.as_py().encode().split()
            grams, place = anchors(_hashes(words))
            mine = grams[place].view(np.int64)
            known, large = shared.values.field("anchor").to_numpy(), shared.values.field("large").to_numpy(zero_copy_only=False)
            order = np.argsort(known)
            known, large = known[order], large[order]
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            edges = runs(mine)
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if known[at[s]] == mine[s]:
                    for i in range(s, e, PASSAGE):
                        n = min(PASSAGE, e - i)
                        out.append((int(mine[s]), bool(large[at[s]]), doc, row, i, n, b" ".join(words[i : i + n + WINDOW - 1]).decode()))
            if len(out) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def repeated_suffixes(passages: list[str], docs: list[int], counts: list[int]) -> list[int]:
    """The suffixes of one group that also start in a smaller doc_id: 2 * PASSAGE times the passage's number, plus the place in it."""
    suffixes = []
    for i, (text, doc, n) in enumerate(zip(passages, docs, counts)):
        words = text.split(" ")
        suffixes += [(words[k : k + WINDOW], doc, 2 * PASSAGE * i + k) for k in range(n)]
    suffixes.sort(key=itemgetter(0, 1))
    out, node, first = [], None, 0
    for prefix, doc, code in suffixes:
        if prefix != node:  # the next internal node of depth WINDOW; its smallest doc_id comes first
            node, first = prefix, doc
        elif doc > first:
            out.append(code)
    return out


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages sorted by anchor to their repeats: (doc_id, row, start, suffixes), a row a run."""
    for part in sorted_runs(batches, "anchor"):
        at, codes = runs(part["anchor"]), []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            found = repeated_suffixes(part["words"][s:e].tolist(), part["doc_id"][s:e].tolist(), part["suffixes"][s:e].tolist())
            codes.append(np.array(found, np.int64) + 2 * PASSAGE * s)
        code = np.sort(np.concatenate(codes))
        edge = np.flatnonzero(np.diff(code, prepend=-2) != 1)
        length = np.diff(np.r_[edge, len(code)])
        i, k = code[edge] // (2 * PASSAGE), code[edge] % (2 * PASSAGE)
        yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"][i]), pa.array(part["row"][i]), pa.array((part["start"][i] + k).astype(np.int32)), pa.array(length.astype(np.int32))], ["doc_id", "row", "start", "suffixes"])


def _large_groups(passages: DataFrame) -> DataFrame:
    """(doc_id, row, start, suffixes) of the repeats in groups that are dealt by whole prefix and document."""
    words = F.split("words", " ")
    prefixes = F.transform(F.sequence(F.lit(0), F.col("suffixes") - 1), lambda k: F.array_join(F.slice(words, k + 1, F.lit(WINDOW)), " "))
    rows = passages.select("doc_id", "row", "start", F.posexplode(prefixes).alias("k", "prefix")).select("doc_id", "row", (F.col("start") + F.col("k")).alias("start"), "prefix")
    part = Window.partitionBy("prefix", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    rows = materialize(rows.withColumn("first", F.min("doc_id").over(part)), "large")
    later = rows.where("doc_id > first")
    firsts = rows.where("doc_id = first").withColumn("first", F.min("doc_id").over(Window.partitionBy("prefix"))).where("doc_id > first")
    return later.union(firsts).select("doc_id", "row", "start", F.lit(1).alias("suffixes"))


def covered(starts: np.ndarray, suffixes: np.ndarray, n: int) -> np.ndarray:
    """Which of n words the windows cover that begin in these runs of starts."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + suffixes - 1 + WINDOW, -1)
    return np.cumsum(delta[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, texts, n_words, spans = batch.slice(at, 256), [], [], []
            for text, row, copy, found in zip(part.column("text"), part.column("row").to_pylist(), part.column("copy").to_pylist(), part.column("found")):
                words = (text.as_py() or "").encode().split()
                gone = np.full(len(words), bool(copy) and len(words) >= WINDOW)
                if not copy and found.is_valid:
                    mine, start, suffixes = (found.values.field(c).to_numpy() for c in ("row", "start", "suffixes"))
                    gone = covered(start[mine == row], suffixes[mine == row], len(words))
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False])).reshape(-1, 2)
                spans.append([{"start": int(s), "end": int(e)} for s, e in edge])
                texts.append(b" ".join(w for w, g in zip(words, gone) if not g).decode() if len(edge) else b" ".join(words).decode())
                n_words.append(len(words))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "spans", "text"])


def _copies(named: DataFrame) -> DataFrame:
    """(doc_id, copied array<long>): the rows of a document whose whole text a smaller doc_id has; all their windows start there."""
    prints = materialize(named.select("doc_id", F.sha2("text", 256).alias("digest"), F.xxhash64("text").alias("row")), "prints")
    # the copies of one text may be a third of all rows: judged by part first, then the first of each part
    part = Window.partitionBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    dealt = prints.withColumn("first", F.min("doc_id").over(part))
    firsts = dealt.where("doc_id = first").withColumn("first", F.min("doc_id").over(Window.partitionBy("digest")))
    later = dealt.where("doc_id > first").union(firsts.where("doc_id > first"))
    return materialize(later.groupBy("doc_id").agg(F.collect_set("row").alias("copied")), "copies")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """documents to (doc_id, n_words long, spans array<struct<start,end>>, text): a row for each row of the input.

    spans are the word ranges that windows cover which also start in a document of smaller doc_id; text has the words
    left, joined by one space. Null or empty texts have no words and empty text; a row without doc_id is neither cut
    nor a source; rows that repeat a doc_id aren't sources of each other. Whole texts, no cap on the size of a group.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = src.where("doc_id is not null and text is not null")
    rest = src.where("doc_id is null or text is null")
    copied = _copies(named)
    texts = named.repartition("doc_id").join(copied, "doc_id", "left").select(
        "doc_id", "text", F.xxhash64("text").alias("row"), F.coalesce(F.array_contains("copied", F.xxhash64("text")), F.lit(False)).alias("copy")
    )
    sources = texts.where("not copy").select("doc_id", "row", "text")
    pairs = sources.select("doc_id", "text").mapInArrow(_anchor_rows, "anchor long, doc_id long, suffixes long")
    # counted where the rows are, then joined back: an anchor that a third of all documents share is sorted in no single task
    shared = pairs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("suffixes").alias("n")).where("lo < hi")
    groups = shared.select("anchor", (F.col("n") > GROUP).alias("large"))
    known = pairs.join(groups, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "large")).alias("anchors"))
    passages = materialize(sources.join(known, "doc_id").mapInArrow(_passages, "anchor long, large boolean, doc_id long, row long, start int, suffixes int, words string"), "passages")
    small = passages.where("not large").drop("large").repartition("anchor").sortWithinPartitions("anchor")
    repeats = small.mapInArrow(_subtrees, "doc_id long, row long, start int, suffixes int").union(_large_groups(passages.where("large")))
    found = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("row", "start", "suffixes")).alias("found"))
    cut = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, text string"
    whole = rest.select("doc_id", "text", F.lit(0).cast("long").alias("row"), F.lit(False).alias("copy"), F.lit(None).cast("array<struct<row:long,start:int,suffixes:int>>").alias("found"))
    return texts.join(found, "doc_id", "left").select(*whole.columns).union(whole).mapInArrow(_cut, cut)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
