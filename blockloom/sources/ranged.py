"""Files read by range: a folder as blocks, and headers without the rest of their files.

Nothing here holds a file: a partition is a list of (path, first byte, bytes), which a worker reads block by block through
Arrow's file systems (local and shared folders, HDFS, S3, GCS by their URIs).  Files may be larger than any row can be.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

from blockloom.session import BATCH_BYTES, bounded_batches, ship

DEFAULT_BLOCK = 262_144
PARTITION_BYTES = 64 << 20
MOST_HEADER = 100_000_000
#: A first look at a header of unknown length, and how it grows.
FIRST_LOOK = 1 << 20
SCHEMA = "path string, size long, block_index long, file_offset long, block_size long, data binary"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def listing(path: str) -> list[tuple[str, int]]:
    """(relative path, size) of all files below a folder, sorted; a single file has its base name."""
    system, top = file_system(path)
    info = system.get_file_info(top)
    if info.type == fs.FileType.File:
        return [(info.base_name, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    top = top.rstrip("/")
    found = system.get_file_info(fs.FileSelector(top, recursive=True))
    return sorted((x.path[len(top) + 1 :], x.size) for x in found if x.type == fs.FileType.File)


def location(top: str, path: str) -> str:
    """Where a listed file is, in its file system."""
    system, base = file_system(top)
    return base if system.get_file_info(base).type == fs.FileType.File else f"{base.rstrip('/')}/{path}"


class _Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges  # (path, size of the file, first byte, bytes)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.top = options["path"]
        self.block = int(options.get("block_size", DEFAULT_BLOCK))
        self.part_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        if self.block <= 0:
            raise ValueError("block_size must be positive")
        # Chosen by option: Spark keeps one reader for all queries on a loaded source, so filters pushed by one would hold for the next.
        self.paths = set(json.loads(options["only"])) if "only" in options else None

    def partitions(self):
        step = max(1, self.part_bytes // self.block) * self.block
        parts, ranges, held = [], [], 0
        for path, size in listing(self.top):
            if self.paths is not None and path not in self.paths:
                continue
            for a in range(0, size, step):
                n = min(step, size - a)
                if held and held + n > self.part_bytes:
                    parts.append(_Ranges(ranges))
                    ranges, held = [], 0
                ranges.append((path, size, a, n))
                held += n
        return [*parts, _Ranges(ranges)]

    def read(self, partition):
        system, _ = file_system(self.top)
        for path, size, first, n in partition.ranges:
            with system.open_input_file(location(self.top, path)) as f:
                for a in range(first, first + n, self.block):
                    k = min(self.block, size - a)
                    data = f.read_at(k, a)
                    if len(data) != k:
                        raise OSError(f"{path} became shorter while it was read")
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([a // self.block]), pa.array([a]), pa.array([k]), pa.array([data], pa.binary())], names=["path", "size", "block_index", "file_offset", "block_size", "data"])


class FileBlocks(DataSource):
    """``spark.read.format("fileblocks").option("block_size", n).load(folder)``: the blocks of all files, or of those of the option ``only`` (a JSON list)."""

    @classmethod
    def name(cls):
        return "fileblocks"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return _Reader(self.options)


def file_blocks(spark: SparkSession, path: str, block_size: int = DEFAULT_BLOCK, partition_bytes: int = PARTITION_BYTES, paths: list[str] | None = None) -> DataFrame:
    """(file_id, path, size, block_index, file_offset, block_size, data) of all files below a folder, or of some, read by range."""
    ship(spark)
    bounded_batches(spark)
    spark.dataSource.register(FileBlocks)
    found = spark.read.format("fileblocks").option("block_size", block_size).option("partition_bytes", partition_bytes)
    found = (found if paths is None else found.option("only", json.dumps(paths))).load(path)
    return found.withColumn("file_id", F.xxhash64("path"))


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, path, size) of all files below a folder, from its listing alone."""
    ship(spark)
    return spark.createDataFrame(listing(path), "path string, size long").withColumn("file_id", F.xxhash64("path"))


def _head(f, path: str, size: int) -> bytes:
    """As much of a file as its header takes, by its kind; the beginning of other files."""
    low = path.lower()
    if low.endswith(".safetensors"):
        n = int.from_bytes(f.read_at(min(8, size), 0), "little")
        return f.read_at(min(size, 8 + n if n <= MOST_HEADER else 16), 0)
    if low.endswith(".gguf"):
        from blockloom.sources import gguf

        look = min(size, FIRST_LOOK)
        while True:
            data = f.read_at(look, 0)
            try:
                whole = "cut off" not in gguf.parse(data)["warnings"]
            except gguf.GgufError:
                whole = True
            if whole or look >= min(size, MOST_HEADER):
                return data
            look = min(size, MOST_HEADER, 8 * look)
    return f.read_at(min(size, MOST_HEADER if low.endswith(".json") else FIRST_LOOK), 0)


def heads(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """(file_id, path, size, content) of files, with no more content than their headers (whole JSON files)."""
    listed = file_list(spark, path) if files is None else files.select("path", "size", "file_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(path)
        for batch in batches:
            for i, (name, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                with system.open_input_file(location(path, name)) as f:
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 1) for c in (2, 0, 1)], pa.array([_head(f, name, size)], pa.binary())], names=["file_id", "path", "size", "content"])

    return listed.select("path", "size", "file_id").mapInArrow(run, "file_id long, path string, size long, content binary")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all files below a folder, each read once from beginning to end; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(path)
        for batch in batches:
            names, out = batch.column(0).to_pylist(), []
            for name in names:
                digest, n = hashlib.sha256(), 0
                with system.open_input_stream(location(path, name)) as f:
                    while data := f.read(1 << 22):
                        digest.update(data)
                        n += len(data)
                out.append((n, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], names=["path", "bytes", "sha256"])

    return file_list(spark, path).select("path").mapInArrow(run, "path string, bytes long, sha256 string")


def read_range(path: str, name: str, offset: int, length: int) -> bytes:
    """Bytes of one listed file; fewer where it ends."""
    if offset < 0 or length < 0:
        raise ValueError("offset and length must not be negative")
    system, _ = file_system(path)
    with system.open_input_file(location(path, name)) as f:
        return f.read_at(max(0, min(length, f.size() - offset)), offset) if offset < f.size() else b""


def with_data(places: DataFrame, top: str) -> DataFrame:
    """Block descriptions (path, file_offset, block_size, wanted) with ``data``, read where ``wanted``: only descriptions ever move."""
    ship(places.sparkSession)
    bounded_batches(places.sparkSession)
    names = ["path", "file_offset", "block_size", "wanted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(top)
        at, f = None, None
        for batch in batches:
            out, first, held = [], 0, 0
            for i, (path, offset, n, wanted) in enumerate(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names], strict=True)):
                if wanted and held and held + n > BATCH_BYTES:
                    yield batch.slice(first, i - first).append_column("data", pa.array(out, pa.binary()))
                    out, first, held = [], i, 0
                if wanted and path != at:
                    at, f = path, system.open_input_file(location(top, path))
                out.append(f.read_at(n, offset) if wanted else None)
                held += n if wanted else 0
            if out:
                yield batch.slice(first).append_column("data", pa.array(out, pa.binary()))

    return places.mapInArrow(run, StructType([*places.schema.fields, StructField("data", BinaryType())]))


def write_blocks(blocks: DataFrame, out_dir: str) -> int:
    """Write plain blocks (path, block_index, data) as files below a folder that all executors share; returns their number.

    A file is written beside its target and takes its name when it is whole, so a task that is run again does no harm.
    """
    from blockloom.operators.classify import is_safe_path

    if blocks.where(~is_safe_path(F.col("path"))).take(1):
        raise ValueError("unsafe path among the blocks")
    ship(blocks.sparkSession)
    bounded_batches(blocks.sparkSession)
    system, top = file_system(out_dir)
    system.create_dir(top, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, f, done = None, None, None, 0

        def close() -> int:
            if at is None:
                return 0
            f.close()
            system.move(part, f"{top.rstrip('/')}/{at}")
            return 1

        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column(0)[i].as_py()
                if path != at:
                    done += close()
                    target = f"{top.rstrip('/')}/{path}"
                    system.create_dir(os.path.dirname(target), recursive=True)
                    at, part = path, f"{target}.{uuid.uuid4().hex}.part"
                    f = system.open_output_stream(part)
                f.write(batch.column(2)[i].as_py() or b"")
        done += close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    dealt = blocks.select("path", "block_index", "data").repartition("path").sortWithinPartitions("path", "block_index")
    return dealt.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
