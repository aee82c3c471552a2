"""A Spark data source for image files: spark.read.format("frames") and df.write.format("frames"), one frame a file.

Options of both: path, kind (npy, fits, tiff or png). Reading also takes mode (PERMISSIVE puts the reason into the reject
column, DROPMALFORMED leaves the file out, FAILFAST raises), allowFloat (unscaled float TIFFs) and maxPartitionBytes.
Files are sorted by path and dealt into partitions by size. Writing also takes values: float, trunc16 or rint16 (16 bits,
truncated or rounded half to even), mask (0 or 255), u8 (truncated, a preview) or bool. Tasks write into a staging folder of the run; the commit
moves the files of the attempts that counted, an abort deletes the folder, so a task that runs twice leaves one file.
The formats don't say which axis is which: an array whose first axis is 1, 3 or 4 long is read as channels first.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..model import FRAMES
from . import codecs

SUFFIXES = {"fits": (".fits", ".fit", ".FITS"), "npy": (".npy",), "tiff": (".tif", ".tiff"), "png": (".png",)}
VALUES = {"fits": ("float",), "npy": ("float", "bool"), "tiff": ("trunc16", "rint16", "mask"), "png": ("u8",)}
SCHEMA = f"{FRAMES}, reject string, path string"
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
PARTITION_BYTES = 128 << 20


def decoder(kind: str, allow_float: bool = False) -> Callable[[bytes], np.ndarray]:
    """Bytes to height x width x channels."""
    return {
        "fits": lambda b: codecs.channels_last(codecs.read_fits(b)),
        "npy": lambda b: codecs.to_hwc(codecs.read_npy(b)),
        "tiff": lambda b: codecs.to_hwc(codecs.read_tiff(b, allow_float)),
        "png": codecs.read_png,
    }[kind]


def encoded(image: np.ndarray, kind: str, values: str) -> bytes:
    if values in ("trunc16", "rint16"):
        wide = image.astype(float)
        image = (np.clip(wide * 65535, 0, 65535) if values == "trunc16" else np.rint(np.clip(wide, 0, 1) * 65535)).astype(np.uint16)
    elif values == "mask":
        image = np.where(image > 0, 255, 0).astype(np.uint8)
    elif values == "u8":
        return codecs.write_png(np.clip(image.astype(float) * 255, 0, 255).astype(np.uint8))
    elif values == "bool":
        image = (image > 0)[..., 0] if image.shape[-1] == 1 else image > 0
    if kind == "fits":
        return codecs.write_fits(np.moveaxis(image, -1, 0))
    return codecs.write_tiff(image) if kind == "tiff" else codecs.write_npy(image)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "npy")
        self.mode, self.bytes = options.get("mode", MODES[0]).upper(), int(options.get("maxPartitionBytes", PARTITION_BYTES))
        self.allow_float = options.get("allowFloat", "false").lower() == "true"
        if self.kind not in SUFFIXES or self.mode not in MODES:
            raise ValueError(f"kind is one of {', '.join(SUFFIXES)}, mode one of {', '.join(MODES)}")

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(SUFFIXES[self.kind]) and not posixpath.relpath(f.path, root).startswith(("_", "."))]
        parts, size = [[]], 0
        for f in sorted(found, key=lambda f: f.path):
            if parts[-1] and size + f.size > self.bytes:
                parts.append([])
                size = 0
            parts[-1].append(f.path)
            size += f.size
        return [Files(tuple(p)) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, decode = fs.FileSystem.from_uri(self.path)[0], decoder(self.kind, self.allow_float)
        for path in partition.paths:
            try:
                with system.open_input_stream(path, compression=None) as f:
                    image = decode(f.read()).astype(np.float32)
                yield self._row(path, image, None)
            except (ValueError, KeyError, IndexError, EOFError) as e:
                if self.mode == "FAILFAST":
                    raise ValueError(f"{path}: {e}") from e
                if self.mode == "PERMISSIVE":
                    yield self._row(path, None, str(e))

    def _row(self, path: str, image: np.ndarray | None, reject: str | None) -> pa.RecordBatch:
        stem = posixpath.basename(path).rpartition(".")[0]
        shape = [None] * 3 if image is None else image.shape
        flat = np.zeros(0, np.float32) if image is None else image.ravel()
        data = pa.array([None], pa.list_(pa.float32())) if image is None else pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array([stem]), *[pa.array([n], pa.int32()) for n in shape], data, pa.array([reject], pa.string()), pa.array([path])], names=[f.split()[0] for f in SCHEMA.split(", ")])


@dataclass
class Staged(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]  # where a file lies and the name that it gets


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind = options["path"], options.get("kind", "npy")
        self.values, self.overwrite = options.get("values", "float"), overwrite
        if self.values not in VALUES.get(self.kind, ()):
            raise ValueError(f"kinds and their values: {VALUES}")
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = fs.FileSystem.from_uri(self.path)
        folder, files = f"{root}/{self.staging}/{uuid.uuid4().hex}", []
        system.create_dir(folder)
        for batch in iterator:
            shapes = zip(*[batch.column(c).to_pylist() for c in ("image_id", "height", "width", "channels")])
            for (name, *shape), data in zip(shapes, batch.column("data")):
                staged, final = f"{folder}/{len(files)}", f"{name}{SUFFIXES[self.kind][0]}"
                with system.open_output_stream(staged, compression=None) as out:
                    out.write(encoded(data.values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(shape), self.kind, self.values))
                files.append((staged, final))
        return Staged(tuple(files))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        files = [f for m in messages if m for f in m.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("two frames have one image_id")
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root)):
                if old.type == fs.FileType.File and old.path.endswith(SUFFIXES[self.kind]):
                    system.delete_file(old.path)
        for staged, name in files:
            system.move(staged, f"{root}/{name}")
        self._clear(system, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(FrameSource)
    return spark
