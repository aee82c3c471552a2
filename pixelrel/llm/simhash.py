"""SimHash near-duplicates by pivot distance tables.

Fingerprints of equal value are one node. Blocks of the fingerprint (pairs of five, by the pigeonhole: at 3
differing bits two of five blocks agree) deal the nodes out; inside a group a table of Hamming distances to
reference fingerprints orders the nodes, the largest coordinate difference discards pairs, and what survives is
verified by XOR and popcount. Groups over SPLIT_AT nodes are split into overlapping bands of their distances to the
first two pivots, so none grows with the data. Each group gives the links of a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, runs, sorted_runs

SEED, SHINGLE, DISTANCE = 42, 3, 3
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}", seed=SEED) for i in range(16)], np.uint64)
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BAND, SPLIT_AT = DISTANCE + 1, 2_000
#: Lower-cases A-Z and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_hash = xxhash.xxh64_intdigest


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the text's word shingles; 0 for a null text or one without words."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return _hash(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1)[: 1 - SHINGLE].tolist()
    h = np.fromiter([_hash(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """documents to (doc_id, fp long), a row for each row of the input."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def spanning_links(fp: np.ndarray, rep: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of one group under "at most DISTANCE differing bits"."""
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fp, rep, table = fp[order], rep[order], table[order]
    first, open_, out = table[:, 0], np.ones(len(fp), bool), []
    lo, hi = np.searchsorted(first, first - DISTANCE, "left"), np.searchsorted(first, first + DISTANCE, "right")
    for seed in range(len(fp)):
        if not open_[seed]:
            continue
        open_[seed], frontier = False, [seed]
        while frontier:
            i = frontier.pop()
            near = np.flatnonzero(open_[lo[i] : hi[i]]) + lo[i]
            if len(near):
                near = near[np.abs(table[near] - table[i]).max(axis=1) <= DISTANCE]
                near = near[np.bitwise_count(fp[near] ^ fp[i]) <= DISTANCE]
                open_[near] = False
                frontier += near.tolist()
                out += [(int(rep[i]), int(rep[j])) for j in near]
    return out


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in sorted_runs(batches, "g"):
        at, fp, rep = runs(part["g"]), part["fp"].view(np.uint64), part["rep"]
        links: list[tuple[int, int]] = []
        for s, e in zip(at[:-1], at[1:]):
            if e - s > 1:
                links += spanning_links(fp[s:e], rep[s:e])
        ab = np.array(links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])


def links(nodes: DataFrame) -> DataFrame:
    """(fp, rep) with distinct fp to links (a, b) between reps that connect all that lies within DISTANCE bits."""
    mask = lambda bs: sum(((1 << n) - 1) << at for at, n in bs)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(signed(mask(two))))) for t, two in enumerate(combinations(BLOCKS, 2))]
    keyed = nodes.select("fp", "rep", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(sizes, "key")
    dealt = members.withColumn("cell", F.lit(0))
    for pivot in PIVOTS[:2]:
        d = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(pivot.astype(np.int64)))))
        # a node also visits the next band: two nodes within DISTANCE meet in the higher of their bands
        bands = F.array_distinct(F.array(F.floor(d / BAND).cast("int"), F.floor((d + DISTANCE) / BAND).cast("int")))
        band = F.explode(F.when(F.col("n") > SPLIT_AT, bands).otherwise(F.array(F.lit(0))))
        dealt = dealt.withColumn("band", band).withColumn("cell", F.col("cell") * 32 + F.col("band"))
    dealt = dealt.select(F.xxhash64("key", "cell").alias("g"), "fp", "rep")
    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(_link_groups, "a long, b long")


def components(docs: DataFrame) -> DataFrame:
    """documents to (doc_id, fp long, component_id): a row for each row of the input.

    Null and wordless texts have fingerprint 0 and link like any other. A null doc_id gets the component of the
    documents it is linked with, or null. Repeated rows stay. No cap on groups or partners.
    """
    fps = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = connected_components(links(nodes))
    classes = nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, without those that share a component with a smaller doc_id. Null doc_ids stay."""
    goes = components(docs).where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(goes, docs["doc_id"] == goes["__gone"], "left_anti")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
