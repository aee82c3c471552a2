"""WARC archives with a two-level capture index.

Writing: each task writes one archive of gzip members into the shared folder under a name of its own, so a task that
runs again leaves an unused file and nothing wrong. Captures (key, id, file, offset, length) are sorted by reversed
host into shards of compressed blocks; a sparse directory (the first key of each block) ends each shard.
Reading: a key goes to its shard by the shards' first keys, a binary search in the shard's directory gives the block,
one range read and a binary search inside the block give the capture, and a range read gives the record.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path

MIN_REVISIT, BLOCK, LEVEL, DATE = 100, 1_000, 6, "1970-01-01T00:00:00Z"
#: Records that lie together are read at once, up to so many bytes; a file is dealt to readers in stretches of STRETCH.
READ_AT_ONCE, STRETCH = 1 << 20, 8 << 20
CAPTURES = "key string, capture long, file string, offset long, length long"
NO_ID = -(1 << 63)


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: com,example,www)/a?b. Empty for a null URL."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.coalesce(F.regexp_replace(key, r"[\x00-\x20]", "%20"), F.lit(""))


def capture_key(pages: DataFrame) -> list[Column]:
    return [url_key(F.col("url").cast("string")).alias("key"), F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("capture")]


def _open(folder: str, name: str, write: bool = False):
    system, path = fs.FileSystem.from_uri(f"{folder}/{name}")
    return system.open_output_stream(path, compression=None) if write else system.open_input_file(path)


def record(capture: int, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the record with the same payload."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{capture}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(c if c > " " else "%20" for c in url or "urn:unknown"), f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers is None:
        body = http + payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the records of pages (page_id, url, html); returns CAPTURES. A null html is an empty payload.

    Of payloads of MIN_REVISIT bytes that are equal, the smallest page_id's is a response and the others revisit it.
    Rows without page_id, and rows that repeat the smallest page_id, are responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(*capture_key(pages), F.col("url").cast("string").alias("url"), html.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = rows.where((F.octet_length("payload") >= MIN_REVISIT) & (F.col("capture") != NO_ID))
    first = large.groupBy("digest").agg(F.min("capture").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    marked = rows.join(first, "digest", "left").withColumn("refers", F.when(F.col("capture") > F.col("first"), F.col("first")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, offset = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                offsets, sizes = [], []
                for row in zip(*(batch.column(c) for c in ("capture", "url", "payload", "digest", "refers"))):
                    out = out or _open(folder, name, write=True)
                    member = gzip.compress(record(*(v.as_py() for v in row)), LEVEL, mtime=0)
                    out.write(member)
                    offsets.append(offset)
                    sizes.append(len(member))
                    offset += len(member)
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("capture"), pa.array([name] * len(sizes), pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], ["key", "capture", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path)
    return materialize(marked.select("key", "capture", "url", "payload", "digest", "refers").mapInArrow(write, CAPTURES), "captures")


def build_index(captures: DataFrame, folder: str) -> list[tuple[str, int, str]]:
    """Writes the index shards; returns (first key, first capture, shard file) of each, sorted: one row a shard."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, offset, block, directory = f"{uuid.uuid4().hex}.cdx", None, 0, [], []

        def end_block() -> None:
            nonlocal out, offset, block
            out = out or _open(folder, name, write=True)
            packed = zlib.compress("\n".join("\t".join(map(str, line)) for line in block).encode(), LEVEL)
            directory.append([block[0][0], block[0][1], offset, len(packed)])
            out.write(packed)
            offset, block = offset + len(packed), []

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns)):
                block.append(line)
                if len(block) == BLOCK:
                    end_block()
        if block:
            end_block()
        if out:
            packed = zlib.compress(json.dumps(directory).encode(), LEVEL)
            out.write(packed + struct.pack("<qq", offset, len(packed)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]]), pa.array([name])], ["key", "capture", "shard"])

    order = ["key", "capture", "file", "offset", "length"]
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.select(*order).repartitionByRange(n, "key", "capture").sortWithinPartitions("key", "capture", "file", "offset")
    shards = materialize(ranged.mapInArrow(write, "key string, capture long, shard string"), "shards")
    return sorted(((r.key, r.capture, r.shard) for r in shards.collect()), key=lambda r: (r[0].encode(), r[1]))


class Shard:
    """One index shard: its directory, and the block read last."""

    def __init__(self, folder: str, name: str):
        self.file = _open(folder, name)
        size = self.file.size()
        at, length = struct.unpack("<qq", self.file.read_at(16, size - 16))
        rows = json.loads(zlib.decompress(self.file.read_at(length, at)))
        self.firsts, self.places, self.held = [(k.encode(), c) for k, c, _, _ in rows], [(o, n) for _, _, o, n in rows], (-1, [], [])

    def block(self, i: int) -> tuple[list, list]:
        if self.held[0] != i:
            at, length = self.places[i]
            lines = [x.split("\t") for x in zlib.decompress(self.file.read_at(length, at)).decode().split("\n")]
            self.held = (i, [(x[0].encode(), int(x[1])) for x in lines], lines)
        return self.held[1:]

    def find(self, key: str, capture: int) -> Iterator[list[str]]:
        wanted = (key.encode(), capture)
        for i in range(max(0, bisect_left(self.firsts, wanted) - 1), bisect_right(self.firsts, wanted)):
            keys, lines = self.block(i)
            yield from lines[bisect_left(keys, wanted) : bisect_right(keys, wanted)]


def lookup(keys: DataFrame, shards: list[tuple[str, int, str]], folder: str) -> DataFrame:
    """(key, capture) to the CAPTURES of those that are archived; each distinct pair is looked up once."""
    firsts, names = [(k.encode(), c) for k, c, _ in shards], [s for _, _, s in shards]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [(k.encode(), c) for k, c in zip(batch.column("key").to_pylist(), batch.column("capture").to_pylist())]
            # equal pairs may run over a shard's end: all shards that can hold them
            spans = [range(max(0, bisect_left(firsts, w) - 1), bisect_right(firsts, w)) for w in wanted]
            at = pa.array([i for i, s in enumerate(spans) for _ in s], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("capture").take(at), pa.array([names[j] for s in spans for j in s], pa.string())], ["key", "capture", "shard"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = shard = None
        for batch in batches:
            found = []
            for key, capture, where in zip(*(batch.column(c).to_pylist() for c in ("key", "capture", "shard"))):
                if where != name:
                    name, shard = where, Shard(folder, where)
                found += [(k, int(c), f, int(o), int(n)) for k, c, f, o, n in shard.find(key, capture)]
            columns = list(zip(*found)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "capture", "file", "offset", "length"])

    routed = keys.select("key", "capture").distinct().mapInArrow(route, "key string, capture long, shard string")
    return routed.repartition("shard").sortWithinPartitions("shard", "key", "capture").mapInArrow(search, CAPTURES)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records at these places: (page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to).

    A response's length and digest are those of the payload read; a revisit has none and gives those it was written with."""
    number = lambda urn: None if urn is None else int(urn[len("<urn:page:") : -1])

    def describe(data: bytes) -> tuple:
        fields, payload = parse(data)
        kind, capture = fields["warc-type"], number(fields["warc-record-id"])
        whole = kind == "response"
        size = len(payload) if whole else int(fields["x-payload-length"])
        digest = hashlib.sha256(payload).hexdigest() if whole else fields["warc-payload-digest"].removeprefix("sha256:")
        return (None if capture == NO_ID else capture, fields["warc-target-uri"], kind, payload if whole else None, size, digest, number(fields.get("warc-refers-to")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source, size = None, None, 0
        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        for batch in batches:
            out, start, data = [], 0, b""
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    name, source, start, data = file, _open(folder, file), 0, b""
                    size = source.size()
                if not start <= offset <= offset + length <= start + len(data):
                    start, data = offset, source.read_at(min(max(length, READ_AT_ONCE), size - offset), offset)
                out.append(describe(gzip.decompress(data[offset - start : offset - start + length])))
                if len(out) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    dealt = captures.repartition("file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def archive(pages: DataFrame) -> tuple[str, list[tuple[str, int, str]]]:
    """Writes archives and index of pages into a new folder; gives the folder and the shards' first keys."""
    folder = new_path(pages.sparkSession, "warc")
    return folder, build_index(write_archives(pages, folder), folder)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder, shards = archive(pages)
    found = lookup(pages.select(*capture_key(pages)), shards, folder)
    return read_records(found, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
