"""Archives: packing, reading, verifying and unpacking.

An archive is a folder of two Parquet tables and a manifest, written and read by all executors in parallel:

* ``blocks``: one row per block, with its place, hashes of content and payload, codec, and the payload unless an equal
  block comes earlier (``dedup_ref`` names it) or a base archive holds it (``base_ref``);
* ``files``: one row per file; ``manifest``: one JSON row.

``write_single`` and the ``blockarchive`` data source handle the single-file form: magic, big-endian manifest length,
JSON manifest, payloads, index.  The index lists files and their blocks in sections of bounded size, each compressed JSON,
followed by a directory of the sections, its length and ``END``; only the directory is ever read whole, and tasks read
the sections.  Files whose manifest lists all blocks itself, as older ones do, are read as well.  Its sink is one file, so
payloads and sections, made by the executors, stream through the driver one partition at a time.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from blockloom import codecs
from blockloom.functions.block_codecs import with_decoding, with_encoding
from blockloom.operators import artifacts
from blockloom.operators import blocks as B
from blockloom.operators import tensors as T
from blockloom.operators.classify import is_safe_path
from blockloom.session import bounded_batches, cut, ship
from blockloom.sources import ranged, safetensors

VERSION = 7
MAGIC = b"BLKARC\x01\x00"
#: The last bytes of a single file that has an index.
END = b"BLKIDX\x01\x00"
MOST_MANIFEST = 100 << 20
#: A section of the index ends after so many blocks, or files, or bytes of payloads.
SECTION_ROWS, SECTION_BYTES = 4096, 16 << 20
#: Payloads travel to the single file, and blocks come from it, about so many bytes at a time.
CHUNK_BYTES = 4 << 20
TOOL = "blockloom"
#: Descriptions of blocks (some 150 bytes each) that may be broadcast.
BROADCAST_BLOCKS = 500_000


# numpy's name of each tensor dtype.
NUMPY_TYPES = {"BOOL": "?", "U8": "u1", "I8": "i1", "I16": "<i2", "I32": "<i4", "I64": "<i8", "F16": "<f2", "F32": "<f4", "F64": "<f8"}


class ArchiveError(ValueError):
    pass


# --- packing ---


def placed_blocks(prints: DataFrame, block_size: int, dedup: bool = True, base: DataFrame | None = None) -> DataFrame:
    """(file_id, block_index, global_id, content_sha256, dedup_ref, base_ref) of blocks by their hashes alone; no bytes are shuffled.

    The hashes are taken once and written, since several steps read them.
    """
    prints = cut(prints.select("file_id", "path", "block_index", "block_size", "content_sha256"))
    ids = cut(B.global_ids(prints, block_size))
    keep = ["file_id", "block_index", "global_id", "content_sha256", "dedup_ref"]
    where = B.dedup_refs(ids).select(*keep) if dedup else ids.withColumn("dedup_ref", F.lit(-1).cast("long")).select(*keep)
    if base is None:
        return cut(where.withColumn("base_ref", F.lit(None).cast("long")))
    first = base.where("dedup_ref < 0 and base_ref is null").groupBy("content_sha256").agg(F.min("global_id").alias("base_ref"))
    return cut(where.join(first, "content_sha256", "left"))


def encoded_blocks(files: DataFrame, block_size: int, codec: str = "auto", level: int | None = None, dedup: bool = True, base: DataFrame | None = None, tensor_aware: bool = False, quantised: DataFrame | None = None, source: str | None = None, jobs: int = 1) -> DataFrame:
    """Blocks of files (file_id, path, size, content) as they are stored, sorted in each partition, encoded after the last exchange.

    Only hashes are shuffled to find duplicates; blocks that need no payload are not encoded.  With tensor_aware a
    block of a safetensors file is encoded by the dtype of the tensor that holds its first byte; files of ``quantised`` (file_id)
    get no planes, and a column ``codec_wanted`` of the files names a codec for each of them.  With a ``source`` folder the files' content is their headers at most: only descriptions of blocks are
    dealt, and bytes are read by range where they are hashed and again where they are encoded.
    """
    spark = files.sparkSession
    if "codec_wanted" not in files.columns:
        files = files.withColumn("codec_wanted", F.lit(None).cast("string"))
    blocks = ranged.file_blocks(spark, source, block_size) if source else B.split_blocks(files, block_size)
    where = placed_blocks(blocks.withColumn("content_sha256", F.sha2("data", 256)), block_size, dedup, base)
    stored = (F.col("dedup_ref") < 0) & F.col("base_ref").isNull()
    if source:
        named = where.join(files.select("file_id", "path", "size", "codec_wanted"), "file_id")
        offset = F.col("block_index") * block_size
        placed = named.withColumn("file_offset", offset).withColumn("block_size", F.least(F.lit(block_size).cast("long"), F.col("size") - offset)).withColumn("wanted", stored)
        placed = placed.repartitionByRange(jobs, "path", "block_index") if jobs > 1 else placed.repartitionByRange("path", "block_index")
    else:
        # Descriptions of at most BROADCAST_BLOCKS blocks go to the bytes; beyond that both are dealt.
        placed = blocks.join(F.broadcast(where) if where.count() <= BROADCAST_BLOCKS else where, ["file_id", "block_index"])
    if quantised is not None:
        planeless = quantised.select("file_id", F.lit(quantised_codec(codec)).alias("planeless"))
        placed = placed.join(planeless, "file_id", "left").withColumn("codec_wanted", F.coalesce("planeless", "codec_wanted")).drop("planeless")
    if tensor_aware:
        t = safetensors.tensors(files.where(F.lower("path").endswith(".safetensors"))).join(files.select("file_id", "path"), "path")
        owners = T.attribute(where.select("file_id", (F.col("block_index") * block_size).alias("file_offset")), t.withColumn("byte_offset", F.col("byte_offset") + F.col("header_size")), block_size).select("file_id", "file_offset", "tensor_name")
        placed = placed.join(owners, ["file_id", "file_offset"], "left").join(t.select("file_id", F.col("name").alias("tensor_name"), F.col("dtype").alias("tensor_dtype"), F.col("shape").alias("tensor_shape")), ["file_id", "tensor_name"], "left")
    else:
        placed = placed.select("*", F.lit(None).cast("string").alias("tensor_name"), F.lit(None).cast("string").alias("tensor_dtype"), F.lit(None).cast("array<bigint>").alias("tensor_shape"))
    order = ["path", "block_index"]
    if source:
        return with_encoding(ranged.with_data(placed.sortWithinPartitions(*order), source), codec, level, "tensor_dtype", choice="codec_wanted")
    return with_encoding(placed.withColumn("data", F.when(stored, F.col("data"))), codec, level, "tensor_dtype", choice="codec_wanted").sortWithinPartitions(*order)


def quantised_codec(codec: str) -> str:
    """Float and byte planes do not suit quantised GGUF data: such a request becomes zstd."""
    return "zstd" if codec in ("auto", "floatplane", "byteplane") else codec


STORED = ["path", "block_index", "block_size", "codec", "codec_metadata", "payload"]


def in_order(batches: Iterator) -> Iterator[tuple[str, int, bytes | None]]:
    """(path, block_index, data) of batches of stored blocks, one at a time; null where a payload is missing or broken."""
    for batch in batches:
        for i in range(batch.num_rows):
            path, index, size, codec, meta, payload = (batch.column(k)[i].as_py() for k in range(6))
            try:
                yield path, index, None if payload is None else codecs.decode(payload, codec, int(size), json.loads(meta or "{}"))
            except Exception:  # noqa: BLE001  hostile payloads raise anything
                yield path, index, None


def file_hashes(stored: DataFrame) -> DataFrame:
    """(path, n_blocks, bytes, sha256) of files from their stored blocks, decoded in order and one at a time: only payloads are dealt, no file is ever held."""
    ship(stored.sparkSession)
    bounded_batches(stored.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, digest, n, size = None, hashlib.sha256(), 0, 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([n]), pa.array([size]), pa.array([digest.hexdigest()])], names=["path", "n_blocks", "bytes", "sha256"])

        for path, _, data in in_order(batches):
            if path != at:
                if at is not None:
                    yield made()
                at, digest, n, size = path, hashlib.sha256(), 0, 0
            digest.update(data or b"")
            n, size = n + 1, size + len(data or b"")
        if at is not None:
            yield made()

    dealt = stored.select(*STORED).repartition("path").sortWithinPartitions("path", "block_index")
    return dealt.mapInArrow(run, "path string, n_blocks long, bytes long, sha256 string")


def fingerprint(files: DataFrame) -> str:
    """The SHA-256 of an archive's content: of its files' hashes, in the order of their hashes by path (sums only, so nothing is collected)."""
    one = F.sha2(F.concat_ws("\0", "path", F.col("size").cast("string"), "sha256"), 256)
    parts = [F.sum(F.conv(F.substring(one, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"p{i}") for i in range(8)]
    row = files.agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256("|".join(str(x) for x in row).encode()).hexdigest()


def pack(files: DataFrame, path: str, block_size: int = B.DEFAULT_BLOCK, codec: str = "auto", level: int | None = None, dedup: bool = True, base: str | None = None, artifact_type: str = "unknown", artifact_metadata: dict | None = None, tensor_aware: bool = False, gguf_aware: bool = False, jobs: int = 1, source: str | None = None) -> dict:
    """Write the folder form and return its manifest.  ``artifact_type="detect"`` finds out what the files are.

    ``files`` have their content, or (see ``pack_folder``) with ``source`` only their headers.  ``jobs`` over 1 is the number of
    tasks that encode.
    """
    spark = files.sparkSession
    if jobs > 1 and not source:
        files = files.repartition(jobs)
    if "file_id" not in files.columns:
        files = files.withColumn("file_id", F.xxhash64("path"))
    if files.where(~is_safe_path(F.col("path"))).take(1):
        raise ArchiveError("unsafe path among the files")
    if files.groupBy("path").count().where("count > 1").take(1):
        raise ArchiveError("a path occurs more than once")
    base_blocks = spark.read.parquet(f"{path_of(base)}/blocks") if base else None
    if artifact_type == "detect":
        found = artifacts.artifact(files)
        artifact_type, artifact_metadata = found["artifact_type"], found["artifact_metadata"]
    quantised = None
    if gguf_aware:
        quantised = artifacts.quantised_files(files).join(files.select("path", "file_id"), "path").select("file_id").distinct()
    out = encoded_blocks(files, block_size, codec, level, dedup, base_blocks, tensor_aware, quantised, source, jobs).drop("size")
    keep = ["global_id", "file_id", "path", "block_index", "file_offset", "block_size", "content_sha256", "codec", "codec_metadata", "compressed_size", "payload_sha256", "dedup_ref", "base_ref", "tensor_name", "tensor_dtype", "tensor_shape", "payload"]
    out.select(*keep).write.mode("errorifexists").parquet(f"{path}/blocks")
    if source:
        files = files.join(ranged.file_digests(spark, source).select("path", "sha256"), "path", "left")
    else:
        files = files.withColumn("sha256", F.sha2("content", 256))
    files.select("file_id", "path", "size", "sha256", F.lit(block_size).alias("block_size")).write.parquet(f"{path}/files")
    b, f = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/files")
    n = b.agg(F.count("*"), F.count_if(F.col("dedup_ref") >= 0), F.coalesce(F.sum("compressed_size"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("dedup_ref") >= 0, F.col("block_size"))), F.lit(0)), F.count("base_ref")).first()
    m = f.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    manifest = {
        "version": VERSION, "tool": TOOL, "created_at": datetime.datetime.now(datetime.UTC).isoformat(), "artifact_type": artifact_type, "artifact_metadata": artifact_metadata or {}, "total_files": m[0], "total_blocks": n[0],
        "total_original_size": m[1], "total_compressed_size": n[2], "deduplication": {"enabled": dedup, "duplicate_blocks": n[1], "saved_bytes": n[3]},
        "delta": {"enabled": base is not None, "base": base, "base_sha256": fingerprint(spark.read.parquet(f"{path_of(base)}/files")) if base else None, "referenced_blocks": n[4]}, "parallelism": {"jobs": jobs} if jobs > 1 else {}, "index": {"version": 1, "has_block_offsets": True, "has_file_index": True, "has_tensor_index": tensor_aware},
        "runtime_hints": {"partial_file_access": True, "tensor_access": "limited" if tensor_aware else "none", "compressed_inference": False},
    }
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.parquet(f"{path}/manifest")
    return manifest


def pack_folder(spark: SparkSession, source: str, path: str, block_size: int = B.DEFAULT_BLOCK, **how) -> dict:
    """Pack all files below a folder (or one file) of any size: they are read by range, and no row holds more than a block."""
    return pack(cut(ranged.heads(spark, source)), path, block_size, source=source, **how)


def path_of(path: str | None) -> str:
    if not path:
        raise ArchiveError("no path")
    return path.rstrip("/")


# --- reading ---


class Archive:
    """Partial access to the folder form; filters reach the Parquet scan, so only touched blocks are read."""

    def __init__(self, spark: SparkSession, path: str, base: str | None = None):
        self.spark, self.path = spark, path_of(path)
        self.files = spark.read.parquet(f"{self.path}/files")
        self.blocks = spark.read.parquet(f"{self.path}/blocks")
        self.base = Archive(spark, base) if base else None

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, *_) -> None:
        """Nothing is held open; the form is for ``with`` blocks."""

    def manifest(self) -> dict:
        return upgraded(json.loads(self.spark.read.parquet(f"{self.path}/manifest").first()["manifest"]))

    def get_block(self, global_id: int) -> dict:
        """A block's description without its payload; KeyError if there is none."""
        row = self.blocks.where(F.col("global_id") == global_id).drop("payload").first()
        if row is None:
            raise KeyError(global_id)
        return row.asDict()

    def blocks_of(self, path: str) -> DataFrame:
        """The blocks of a file in order, without payloads."""
        return self.blocks.where(F.col("path") == path).drop("payload").orderBy("block_index")

    def read_block(self, global_id: int) -> bytes:
        """The content of one block, checked against its hash."""
        row = self.decoded(self.blocks.where(F.col("global_id") == global_id)).first()
        if row is None:
            raise KeyError(global_id)
        if row["error"] or hashlib.sha256(row["data"]).hexdigest() != row["content_sha256"]:
            raise ArchiveError(f"block {global_id}: {row['error'] or 'content differs from its checksum'}")
        return bytes(row["data"])

    def list_files(self) -> list[str]:
        return [r["path"] for r in self.files.select("path").orderBy("path").toLocalIterator()]

    def get_file_info(self, path: str) -> dict | None:
        row = self.files.where(F.col("path") == path).first()
        return row.asDict() if row else None

    def resolved(self, blocks: DataFrame | None = None) -> DataFrame:
        """Blocks with their own payload or that of the block they refer to (an equi join on ids)."""
        b = self.blocks if blocks is None else blocks
        own = b.where(F.col("payload").isNotNull())
        parts = ["payload", "codec", "codec_metadata", "payload_sha256", "compressed_size"]
        refs = b.where(F.col("dedup_ref") >= 0).drop(*parts)
        source = self.blocks.select(F.col("global_id").alias("_id"), *parts)
        out = own.unionByName(refs.join(source, F.col("dedup_ref") == F.col("_id"), "left").select(*b.columns))
        if self.base:
            away = b.where((F.col("dedup_ref") < 0) & F.col("base_ref").isNotNull()).drop(*parts)
            there = self.base.blocks.select(F.col("global_id").alias("_id"), *parts)
            out = out.unionByName(away.join(there, F.col("base_ref") == F.col("_id"), "left").select(*b.columns))
            # A duplicate of a block that the base holds has no payload of its own.
            lost = out.where(F.col("payload").isNull() & (F.col("dedup_ref") >= 0)).drop(*parts)
            via = self.blocks.where(F.col("base_ref").isNotNull()).select(F.col("global_id").alias("_own"), F.col("base_ref").alias("_id"))
            found = lost.join(via, F.col("dedup_ref") == F.col("_own")).drop("_own").join(there, "_id").select(*b.columns)
            out = out.where(F.col("payload").isNotNull()).unionByName(found)
        return out

    def decoded(self, blocks: DataFrame | None = None) -> DataFrame:
        return with_decoding(self.resolved(blocks))

    def read_files(self, paths: list[str] | None = None) -> DataFrame:
        """(path, data, sha256, ok) of the files, reassembled; empty files have no blocks and come from the file table."""
        f = self.files if paths is None else self.files.where(F.col("path").isin(paths))
        b = self.blocks if paths is None else self.blocks.where(F.col("path").isin(paths))
        whole = B.reconstruct(self.decoded(b).select("file_id", "path", "block_index", "data"))
        joined = f.join(whole.select("path", "data"), "path", "left").withColumn("data", F.coalesce("data", F.lit(b"")))
        return joined.select("path", "size", "data", "sha256", (F.sha2("data", 256) == F.col("sha256")).alias("ok"))

    def read_file(self, path: str) -> bytes:
        row = self.read_files([path]).first()
        if row is None:
            raise KeyError(path)
        if not row["ok"]:
            raise ArchiveError(f"{path}: content differs from its checksum")
        return bytes(row["data"])

    def read_file_range(self, path: str, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0:
            raise ValueError("offset and length must not be negative")
        if not self.files.where(F.col("path") == path).take(1):
            raise KeyError(path)
        hit = B.range_overlap(self.blocks.where(F.col("path") == path), offset, length)
        row = B.read_range(self.decoded(hit).select("file_id", "path", "block_index", "file_offset", "block_size", "data"), offset, length).first()
        return bytes(row["data"]) if row else b""

    def read_tensor(self, path: str, name: str) -> bytes:
        """Exactly the bytes of a tensor of a safetensors file: the header by one range read, the data by another."""
        n = int.from_bytes(self.read_file_range(path, 0, 8), "little")
        entry = json.loads(self.read_file_range(path, 8, n))[name]
        a, b = entry["data_offsets"]
        return self.read_file_range(path, 8 + n + a, b - a)

    def list_tensors(self) -> list[str]:
        """Tensors that blocks are attributed to (of archives packed with tensor_aware)."""
        return [r["tensor_name"] for r in self.blocks.where("tensor_name is not null").select("tensor_name").distinct().orderBy("tensor_name").toLocalIterator()]

    def get_tensor_info(self, name: str) -> dict | None:
        row = self.blocks.where(F.col("tensor_name") == name).groupBy("path", "tensor_dtype", "tensor_shape").agg(F.array_sort(F.collect_list("global_id")).alias("block_ids")).first()
        return row.asDict() if row else None

    def load_tensor(self, path: str, name: str):
        """A tensor as a numpy array in its shape; BF16, which numpy lacks, comes as the float32 values that it stands for."""
        import numpy as np

        n = int.from_bytes(self.read_file_range(path, 0, 8), "little")
        entry = json.loads(self.read_file_range(path, 8, n))[name]
        if entry["dtype"] == "BF16":
            return (np.frombuffer(self.read_tensor(path, name), "<u2").astype("<u4") << 16).view("<f4").reshape(entry["shape"])
        if entry["dtype"] not in NUMPY_TYPES:
            raise ArchiveError(f"numpy has no {entry['dtype']}")
        return np.frombuffer(self.read_tensor(path, name), NUMPY_TYPES[entry["dtype"]]).reshape(entry["shape"])

    def load_torch(self, path: str, name: str):
        """The tensor as a torch one (BF16 as bfloat16), where torch is installed."""
        try:
            import torch
        except ImportError:
            raise ArchiveError("torch is not installed") from None
        n = int.from_bytes(self.read_file_range(path, 0, 8), "little")
        made = torch.from_numpy(self.load_tensor(path, name).copy())
        return made.to(torch.bfloat16) if json.loads(self.read_file_range(path, 8, n))[name]["dtype"] == "BF16" else made

    def extract_tensor(self, path: str, name: str, out_dir: str) -> str:
        """Write a tensor's bytes to <safe name>.bin below out_dir."""
        target = os.path.join(out_dir, name.translate(str.maketrans("/\\:", "___")) + ".bin")
        os.makedirs(out_dir, exist_ok=True)
        with open(target, "wb") as o:
            o.write(self.read_tensor(path, name))
        return target

    def unpack(self, out_dir: str, patterns: list[str] | None = None) -> int:
        """Write the files below out_dir (a folder that all executors share); all paths are checked first."""
        from blockloom.operators.classify import first_match

        f = self.files if not patterns else self.files.where(first_match(F.col("path"), patterns).isNotNull())
        if f.where(~is_safe_path(F.col("path"))).take(1):
            raise ArchiveError("unsafe path in the archive")
        system, top = ranged.file_system(out_dir)
        local = os.path.realpath(top) if isinstance(system, fs.LocalFileSystem) else None
        system.create_dir(top, recursive=True)

        def write(batches: Iterator) -> Iterator:
            """Blocks in order into a file beside the target, which takes its name once the checksum is right."""
            import pyarrow as pa

            state: dict = {}

            def close() -> int:
                if not state:
                    return 0
                state["out"].close()
                if state["digest"].hexdigest() != state["sha256"]:
                    system.delete_file(state["part"])
                    raise ArchiveError(f"{state['path']}: content differs from its checksum")
                system.move(state["part"], state["target"])
                state.clear()
                return 1

            done = 0
            for path, sha, data in ((p, x["sha256"][0].as_py(), d) for batch in batches for x in (batch.slice(i, 1) for i in range(batch.num_rows)) for p, _, d in in_order([x])):
                if state.get("path") != path:
                    done += close()
                    target = f"{top.rstrip('/')}/{path}"
                    if local and (os.path.islink(target) or os.path.commonpath([local, os.path.realpath(target)]) != local):
                        raise ArchiveError(f"{path}: leaves the folder")
                    system.create_dir(os.path.dirname(target), recursive=True)
                    part = f"{target}.{uuid.uuid4().hex}.part"
                    state.update(path=path, sha256=sha, target=target, part=part, out=system.open_output_stream(part), digest=hashlib.sha256())
                state["out"].write(data or b"")
                state["digest"].update(data or b"")
            done += close()
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

        wanted = f.select("path", "sha256")
        some = self.resolved(self.blocks.join(wanted.select("path"), "path", "left_semi")).select(*STORED).join(wanted, "path", "right")
        ship(self.spark)
        bounded_batches(self.spark)
        dealt = some.select(*STORED, "sha256").repartition("path").sortWithinPartitions("path", "block_index")
        return dealt.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    # --- verification ---

    def errors(self, full: bool = True) -> DataFrame:
        """(path, block_index, error) of everything that is wrong; full also decodes and compares contents."""
        where = ["path", "block_index"]
        unsafe = self.files.where(~is_safe_path(F.col("path"))).select("path", F.lit(None).cast("long").alias("block_index"), F.lit("unsafe path").alias("error"))
        sizes = self.blocks.groupBy("path").agg(F.sum("block_size").alias("total"))
        wrong = self.files.join(sizes, "path", "left").where(F.coalesce("total", F.lit(0)) != F.col("size")).select("path", F.lit(None).cast("long").alias("block_index"), F.lit("block sizes do not add up").alias("error"))
        paths = self.files.groupBy("path").count().where("count > 1").select("path", F.lit(None).cast("long").alias("block_index"), F.lit("path occurs twice").alias("error"))
        twice = self.blocks.groupBy(*where).count().where("count > 1").select(*where, F.lit("block occurs twice").alias("error"))
        known = self.blocks.where(F.col("codec").isNotNull() & ~F.col("codec").isin(codecs.registered())).select(*where, F.lit("unknown codec").alias("error"))
        refs = B.invalid_refs(self.blocks.select("global_id", "dedup_ref")).join(self.blocks.select("global_id", *where), "global_id").select(*where, F.concat(F.lit("dedup reference "), "reason").alias("error"))
        payload = self.blocks.where(F.col("payload").isNotNull() & (F.sha2("payload", 256) != F.col("payload_sha256"))).select(*where, F.lit("payload checksum differs").alias("error"))
        out = unsafe.unionByName(wrong).unionByName(paths).unionByName(twice).unionByName(known).unionByName(refs).unionByName(payload)
        if not self.base:
            away = self.blocks.where("base_ref is not null").select(*where, F.lit("base archive missing").alias("error"))
            out = out.unionByName(away)
        else:
            there = self.base.blocks.select(F.col("global_id").alias("base_ref"), F.lit(True).alias("there"))
            gone = self.blocks.where("base_ref is not null").join(there, "base_ref", "left").where("there is null").select(*where, F.lit("block missing in the base archive").alias("error"))
            out = out.unionByName(gone)
        if full:
            d = self.decoded()
            hashed = file_hashes(self.resolved()).withColumnRenamed("sha256", "is_sha256")
            files = self.files.join(hashed, "path", "left").withColumn("is_sha256", F.coalesce("is_sha256", F.sha2(F.lit(b""), 256)))
            out = out.unionByName(files.where("is_sha256 <> sha256").select("path", F.lit(None).cast("long").alias("block_index"), F.lit("file checksum differs").alias("error")))
            broken = d.where(F.col("error").isNotNull()).select(*where, "error")
            differs = d.where(F.col("error").isNull() & (F.sha2("data", 256) != F.col("content_sha256"))).select(*where, F.lit("content checksum differs").alias("error"))
            out = out.unionByName(broken).unionByName(differs)
        return out

    def verify(self, full: bool = True) -> dict:
        found = self.errors(full).groupBy("error").agg(F.count("*").alias("n"), F.min("path").alias("example")).collect()
        errors = {r["error"]: {"count": r["n"], "example": r["example"]} for r in found}
        m, is_ = self.manifest(), self.totals().first().asDict()
        wrong = [k for k, v in is_.items() if m.get(k) != v]
        if wrong:
            errors["manifest totals differ"] = {"count": len(wrong), "example": wrong[0]}
        told = m["delta"].get("base_sha256")
        if self.base and told and told != fingerprint(self.base.files):
            errors["another base archive"] = {"count": 1, "example": self.base.path}
        return {"integrity": "FAILED" if errors else "OK", "errors": errors, "total_files": is_["total_files"], "total_blocks": is_["total_blocks"], "restored_size": is_["total_original_size"], "compressed_size": is_["total_compressed_size"]}

    def totals(self) -> DataFrame:
        """One row of what the tables hold, measured: files, blocks, bytes before and after."""
        f = self.files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_original_size"))
        b = self.blocks.agg(F.count("*").alias("total_blocks"), F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("total_compressed_size"))
        return f.join(b)  # one row each

    def codec_usage(self, *by: str) -> DataFrame:
        """Blocks and bytes by codec (duplicates as "duplicate", blocks of the base as "base") and, with ``by``, by path or tensor dtype."""
        name = F.when(F.col("dedup_ref") >= 0, "duplicate").when(F.col("base_ref").isNotNull(), "base").otherwise(F.col("codec")).alias("codec")
        return self.blocks.groupBy(*by, name).agg(F.count("*").alias("blocks"), F.sum("block_size").alias("bytes"), F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("compressed"))

    def inspect(self) -> dict:
        """The manifest with measured totals, codec usage, dtypes, tensors and what elision and the base save."""
        saved = self.blocks.agg(F.coalesce(F.sum(F.when(F.col("dedup_ref") >= 0, F.col("block_size"))), F.lit(0)).alias("dedup"), F.coalesce(F.sum(F.when(F.col("base_ref").isNotNull() & (F.col("dedup_ref") < 0), F.col("block_size"))), F.lit(0)).alias("delta"), F.count("tensor_name").alias("attributed")).first()
        total = self.totals().first().asDict()
        return {
            "manifest": self.manifest(), "totals": total, "ratio": total["total_compressed_size"] / total["total_original_size"] if total["total_original_size"] else 1.0,
            "codecs": {r["codec"]: {"blocks": r["blocks"], "bytes": r["bytes"], "compressed": r["compressed"]} for r in self.codec_usage().collect()},
            "dtypes": {r["tensor_dtype"]: r["n"] for r in self.blocks.where("tensor_dtype is not null").groupBy("tensor_dtype").agg(F.count("*").alias("n")).collect()},
            "dedup_saved_bytes": saved["dedup"], "delta_saved_bytes": saved["delta"], "has_tensor_data": saved["attributed"] > 0,
        }


#: What manifests of older versions lack, with the value that it has for them.
DEFAULTS: dict = {
    "version": 1, "tool": TOOL, "created_at": None, "artifact_type": "unknown", "artifact_metadata": {}, "total_files": 0, "total_blocks": 0, "total_original_size": 0, "total_compressed_size": 0,
    "deduplication": {"enabled": False, "duplicate_blocks": 0, "saved_bytes": 0}, "delta": {"enabled": False, "base": None, "base_sha256": None, "referenced_blocks": 0}, "parallelism": {},
    "index": {"version": 0, "has_block_offsets": False, "has_file_index": False, "has_tensor_index": False}, "runtime_hints": {"partial_file_access": False, "tensor_access": "none", "compressed_inference": False},
}


def upgraded(manifest: dict) -> dict:
    """A manifest of any known version as the present one: what it lacks is filled in, what is unknown stays."""
    version = manifest.get("version", 1)
    if not isinstance(version, int) or not 1 <= version <= VERSION:
        raise ArchiveError(f"manifest version {version!r} is not supported")
    filled = dict(manifest)
    for key, value in DEFAULTS.items():
        if isinstance(value, dict):
            filled[key] = value | (manifest.get(key) or {})
        else:
            filled.setdefault(key, value)
    return filled


def report(found: dict) -> str:
    """The outcome of verify() as text."""
    lines = [f"Files: {found['total_files']}", f"Blocks: {found['total_blocks']}", f"Restored size: {found['restored_size']} bytes", f"Compressed size: {found['compressed_size']} bytes"]
    if found["restored_size"]:
        lines.append(f"Ratio: {found['compressed_size'] / found['restored_size']:.2%}")
    lines.append(f"Integrity: {found['integrity']}")
    return "\n".join(lines + [f"  {e}: {x['count']}, such as {x['example']}" for e, x in found["errors"].items()])


# --- the single-file form ---


def _sections(batches: Iterator) -> Iterator:
    """Files with their blocks, a row each and in order, as sections of the index."""
    import pyarrow as pa

    files, rows, size = [], 0, 0

    def made():
        raw = zlib.compress(json.dumps({"files": files}).encode())
        row = [files[0]["path"], files[-1]["path"], size, hashlib.sha256(raw).hexdigest(), raw]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["first", "last", "payloads", "sha256", "data"])

    for r in (r for batch in batches for i in range(0, batch.num_rows, 500) for r in batch.slice(i, 500).to_pylist()):
        block = r.pop("block")
        if not files or files[-1]["path"] != r["path"]:
            files.append(r | {"blocks": []})
        if block is not None:
            files[-1]["blocks"].append(block)
            size += block["compressed_size"] or 0
        rows += 1
        if rows >= SECTION_ROWS or size >= SECTION_BYTES:
            yield made()
            files, rows, size = [], 0, 0
    if files:
        yield made()


def _chunks(batches: Iterator) -> Iterator:
    """Payloads in order, joined to fewer rows."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        for payload in batch.column(0):
            held.append(payload.as_py())
            n += len(held[-1])
            if n >= CHUNK_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["data"])
                held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["data"])


def write_single(archive: Archive, path: str, magic: bytes = MAGIC) -> int:
    """Write the folder form as one file; duplicates point at the payload of their canonical block.  Returns its size."""
    ship(archive.spark)
    bounded_batches(archive.spark)
    blocks = archive.blocks
    parts = [F.col("codec"), F.col("codec_metadata").alias("metadata"), F.col("compressed_size").cast("long").alias("compressed_size"), F.col("payload_sha256").alias("hash")]
    stored = blocks.where(F.col("payload").isNotNull())
    places = B.running_total(stored.select(F.col("global_id").alias("_id"), *parts), ["_id"], "compressed_size", "offset")
    own = F.when(F.col("dedup_ref") >= 0, F.col("dedup_ref")).otherwise(F.col("global_id")).alias("_id")
    named = blocks.select("path", F.col("block_index").alias("index"), F.col("global_id").alias("id"), F.col("block_size").alias("original_size"), "content_sha256", "dedup_ref", own)
    block = F.struct("index", "id", "original_size", "content_sha256", "codec", "metadata", "compressed_size", "hash", "offset", "dedup_ref").alias("block")
    listed = archive.files.join(named.join(places, "_id", "left").select("path", block), "path", "left").orderBy("path", "block.index")
    body = json.dumps(archive.manifest()).encode()
    directory = []
    with open(path, "wb") as o:
        o.write(magic + struct.pack(">Q", len(body)) + body)
        for r in stored.select("global_id", "payload").orderBy("global_id").select("payload").mapInArrow(_chunks, "data binary").toLocalIterator():
            o.write(r["data"])
        for r in listed.mapInArrow(_sections, "first string, last string, payloads long, sha256 string, data binary").toLocalIterator():
            directory.append({"offset": o.tell(), "size": len(r["data"])} | {k: r[k] for k in ("sha256", "first", "last", "payloads")})
            o.write(r["data"])
        raw = zlib.compress(json.dumps(directory).encode())
        o.write(raw + struct.pack(">Q", len(raw)) + END)
        return o.tell()


def _inflated(raw: bytes, what: str):
    """The value of compressed JSON of at most MOST_MANIFEST bytes."""
    try:
        inflater = zlib.decompressobj()
        body = inflater.decompress(raw, MOST_MANIFEST)
        if not inflater.eof:
            raise ArchiveError(f"{what} too large or truncated")
        return json.loads(body)
    except (zlib.error, ValueError) as e:
        raise e if isinstance(e, ArchiveError) else ArchiveError(f"invalid {what}: {e}") from e


def read_single_directory(path: str, start: int) -> list[dict]:
    """The sections of a single file's index: where each is, its checksum, first and last path, and how many bytes of payloads it names."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        f.seek(max(size - 16, 0))
        tail = f.read(16)
        if size - 16 < start or tail[8:] != END:
            raise ArchiveError("index missing or truncated")
        (n,) = struct.unpack(">Q", tail[:8])
        if n > MOST_MANIFEST or start + n > size - 16:
            raise ArchiveError("directory of the index too large or truncated")
        f.seek(size - 16 - n)
        found = _inflated(f.read(n), "directory of the index")
    keys = ("offset", "size", "payloads")
    if not isinstance(found, list) or not all(isinstance(x, dict) and all(isinstance(x.get(k), int) for k in keys) and all(isinstance(x.get(k), str) for k in ("sha256", "first", "last")) for x in found):
        raise ArchiveError("invalid directory of the index")
    if any(x["offset"] < start or not 0 <= x["size"] <= MOST_MANIFEST or x["offset"] + x["size"] > size - 16 - n for x in found):
        raise ArchiveError("a section lies outside the index")
    return found


def read_single_section(path: str, section: dict) -> list[dict]:
    """The files of a section, each with its blocks there; a file of many blocks goes on in the next section."""
    with open(path, "rb") as f:
        f.seek(section["offset"])
        raw = f.read(section["size"])
    if hashlib.sha256(raw).hexdigest() != section["sha256"]:
        raise ArchiveError("a section of the index differs from its checksum")
    return _inflated(raw, "section of the index")["files"]


def read_single_manifest(path: str, magic: bytes = MAGIC) -> tuple[dict, int]:
    """(manifest, start of the payloads); hostile headers are refused."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(16)
        if len(head) < 16 or head[:8] != magic:
            raise ArchiveError("bad magic or truncated header")
        (n,) = struct.unpack(">Q", head[8:])
        if n > MOST_MANIFEST:
            raise ArchiveError("manifest too large")
        if 16 + n > size:
            raise ArchiveError("truncated manifest")
        try:
            return json.loads(f.read(n).decode()), 16 + n
        except ValueError as e:
            raise ArchiveError(f"invalid manifest: {e}") from e


class _Part(InputPartition):
    """Blocks to read: described by ``rows``, or by sections of the index, whose payloads lie behind ``start``."""

    def __init__(self, rows: list[tuple], sections: list[dict], start: int):
        self.rows, self.sections, self.start = rows, sections, start


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.magic = options["path"], bytes.fromhex(options.get("magic_hex", MAGIC.hex()))
        self.part_bytes = int(options.get("partition_bytes", 64 << 20))
        # Chosen by option: Spark keeps one reader for all queries on a loaded source, so filters pushed by one would hold for the next.
        self.paths = set(json.loads(options["only"])) if "only" in options else None

    def partitions(self):
        manifest, start = read_single_manifest(self.path, self.magic)
        if "files" in manifest:
            return self.listed(manifest["files"], start)
        parts, sections, size = [], [], 0
        for s in read_single_directory(self.path, start):
            if self.paths is not None and not any(s["first"] <= p <= s["last"] for p in self.paths):
                continue
            sections.append(s)
            size += s["payloads"]
            if size >= self.part_bytes:
                parts.append(_Part([], sections, start))
                sections, size = [], 0
        return [*parts, _Part([], sections, start)]

    def listed(self, files: list[dict], start: int) -> list[_Part]:
        """Of older files, whose manifest lists all blocks and describes payloads at their first block only."""
        by_id = {b["id"]: b for f in files for b in f["blocks"]}
        parts, rows, size = [], [], 0
        for f in files:
            for row in self.described(f, start, by_id):
                rows.append(row)
                size += row[6]
                if size >= self.part_bytes:
                    parts.append(_Part(rows, [], start))
                    rows, size = [], 0
        return [*parts, _Part(rows, [], start)]

    def described(self, f: dict, start: int, by_id: dict | None = None) -> Iterator[tuple]:
        """What it takes to read each block of a file."""
        if self.paths is not None and f["path"] not in self.paths:
            return
        for b in f["blocks"]:
            s = by_id[b["dedup_ref"]] if by_id and b["dedup_ref"] >= 0 else b
            if s["offset"] is None:
                raise ArchiveError(f"{f['path']}, block {b['index']}: its payload is not in this file")
            yield f["path"], b["index"], b["original_size"], b["content_sha256"], s["codec"], s["metadata"], s["compressed_size"], s["hash"], start + s["offset"]

    def read(self, partition):
        """Batches of about CHUNK_BYTES: rows would be gathered by the thousand, whatever the size of their blocks."""
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

        def made():
            columns = [pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["path", "block_index", "block_size", "content_sha256", "codec", "data"])

        held, size = [], 0
        named = (row for s in partition.sections for f in read_single_section(self.path, s) for row in self.described(f, partition.start))
        with open(self.path, "rb") as f:
            for path, index, original, sha, name, meta, n, payload_sha, at in partition.rows or named:
                f.seek(at)
                payload = f.read(n)
                if len(payload) != n or hashlib.sha256(payload).hexdigest() != payload_sha:
                    raise ArchiveError(f"{path}, block {index}: payload is short or differs from its checksum")
                data = codecs.decode(payload, name, original, json.loads(meta or "{}"))
                held.append((path, index, original, sha, name, data))
                size += len(data)
                if size >= CHUNK_BYTES or len(held) >= SECTION_ROWS:
                    yield made()
                    held, size = [], 0
        if held:
            yield made()


class BlockArchive(DataSource):
    """``spark.read.format("blockarchive").load(file)``: decoded blocks of a single-file archive, or of the files of the option ``only`` (a JSON list)."""

    @classmethod
    def name(cls):
        return "blockarchive"

    def schema(self):
        return "path string, block_index long, block_size long, content_sha256 string, codec string, data binary"

    def reader(self, schema: StructType):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(BlockArchive)
