"""Files and blocks as DataFrames: splitting, fingerprints, ids and offsets, dedup, delta, ranges, reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.session import cut

DEFAULT_BLOCK = 262_144


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as files: (file_id, path, size, content, lang, source)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    path = F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return d.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.encode("text", "UTF-8").alias("content"), "lang", "source")


def directory_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a directory, by relative path: (path, size, content); a single file has its base name."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    top = path.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:(//)?", ""), "^" + "".join("\\" + c if c in ".+*?()[]{}|^$\\" else c for c in top.removeprefix("file:")) + "/?", "")
    return raw.select(F.when(rel == "", F.element_at(F.split("path", "/"), -1)).otherwise(rel).alias("path"), F.col("length").alias("size"), "content")


def split_blocks(files: DataFrame, block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """One row per block; the last may be short and an empty file has none.  Carries the file's other columns."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_size).cast("long")))
    cut_ = files.where("size > 0").withColumn("file_offset", at)
    return (
        cut_.withColumn("data", F.expr(f"substring(content, cast(file_offset + 1 as int), {block_size})"))
        .withColumn("block_index", F.expr(f"file_offset div {block_size}"))
        .withColumn("block_size", F.least(F.lit(block_size).cast("long"), F.col("size") - F.col("file_offset")))
        .drop("content")
    )


def fingerprints(blocks: DataFrame) -> DataFrame:
    """Blocks with the SHA-256 of their bytes, and without the bytes: only hashes travel further."""
    return blocks.withColumn("content_sha256", F.sha2("data", 256)).drop("data")


def skeleton(blocks: DataFrame) -> DataFrame:
    """Block descriptions whose hashes are still to be taken: no bytes are read for them."""
    return blocks.drop("data").withColumn("content_sha256", F.lit(""))


def running_total(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` over all rows in the given order, without a single-task window.

    Rows are range partitioned and sorted; the totals of the partitions (one number each) give every partition its
    start.  The partitioning is checkpointed, since sampling its bounds again could give others.
    """
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    totals = ranged.groupBy("_p").agg(F.sum(value).alias("_t"))
    starts = totals.withColumn("_start", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum(value).over(w), F.lit(0))
    return ranged.join(F.broadcast(starts.select("_p", "_start")), "_p").withColumn(out, (F.col("_start") + inner).cast("long")).drop("_p", "_start")


def global_ids(blocks: DataFrame, block_size: int) -> DataFrame:
    """Blocks with ``global_id``: their running number in (path, block_index) order.

    Only one row per file is ordered globally; blocks add their own index.
    """
    files = blocks.groupBy("file_id", "path").agg(F.count("*").alias("n"))
    first = running_total(files, ["path", "file_id"], "n", "first_id").select("file_id", "first_id")
    return blocks.join(first, "file_id").withColumn("global_id", F.col("first_id") + F.col("block_index")).drop("first_id")


def dedup_refs(ids: DataFrame) -> DataFrame:
    """(global_id, content_sha256, block_size, canonical_id, dedup_ref): the first block of equal content, -1 where it is itself."""
    first = ids.groupBy("content_sha256").agg(F.min("global_id").alias("canonical_id"))
    joined = ids.join(first, "content_sha256")
    return joined.withColumn("dedup_ref", F.when(F.col("canonical_id") == F.col("global_id"), F.lit(-1).cast("long")).otherwise(F.col("canonical_id")))


def dedup_groups(ids: DataFrame) -> DataFrame:
    """(content_sha256, canonical_id, total_refs, saved_bytes) of contents that occur more than once."""
    return ids.groupBy("content_sha256").agg(F.min("global_id").alias("canonical_id"), F.count("*").alias("total_refs"), (F.sum("block_size") - F.max("block_size")).alias("saved_bytes")).where("total_refs > 1")


def dedup_members(refs: DataFrame) -> DataFrame:
    """(content_sha256, canonical_id, duplicate_id): the members of every group, a row each, since a group may be too large for an array."""
    return refs.where("dedup_ref >= 0").select("content_sha256", "canonical_id", F.col("global_id").alias("duplicate_id"))


def dedup_stats(prints: DataFrame, by: list[str]) -> DataFrame:
    """Totals per group: blocks, distinct contents, duplicates and the bytes that elision saves (partial sums per content first)."""
    per = prints.groupBy(*by, "content_sha256").agg(F.count("*").alias("n"), F.max("block_size").alias("b"))
    return per.groupBy(*by).agg(F.sum("n").alias("total_blocks"), F.count("*").alias("unique_blocks"), F.sum(F.col("n") - 1).alias("duplicate_blocks"), F.sum((F.col("n") - 1) * F.col("b")).cast("long").alias("saved_bytes"))


def invalid_refs(refs: DataFrame) -> DataFrame:
    """(global_id, dedup_ref, reason): references to blocks that do not exist, or that are references themselves."""
    known = refs.select(F.col("global_id").alias("target"), F.col("dedup_ref").alias("target_ref"))
    tied = refs.where("dedup_ref >= 0").join(known, F.col("dedup_ref") == F.col("target"), "left")
    reason = F.when(F.col("target").isNull(), "missing").when(F.col("target_ref") >= 0, "chained")
    return tied.withColumn("reason", reason).where("reason is not null").select("global_id", "dedup_ref", "reason")


def delta_by_hash(new: DataFrame, base: DataFrame) -> DataFrame:
    """New blocks with the first base block of equal content anywhere (null: changed)."""
    first = base.groupBy("content_sha256").agg(F.min("global_id").alias("base_id"))
    return new.join(first, "content_sha256", "left").withColumn("is_changed", F.col("base_id").isNull())


def delta_positional(new: DataFrame, base: DataFrame) -> DataFrame:
    """New blocks against the base block at the same place of the same path."""
    b = base.select("path", "block_index", F.col("content_sha256").alias("base_sha256"))
    return new.join(b, ["path", "block_index"], "left").withColumn("is_changed", ~F.col("content_sha256").eqNullSafe(F.col("base_sha256")))


def file_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per path in either side: blocks that match in place over the larger block count."""
    x = a.select("path", "block_index", F.col("content_sha256").alias("sa"))
    y = b.select("path", "block_index", F.col("content_sha256").alias("sb"))
    both = x.join(y, ["path", "block_index"], "full_outer")
    return both.groupBy("path").agg(F.count_if(F.col("sa") == F.col("sb")).alias("matching"), F.count("*").alias("total"))


def block_similarity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, similarity) of blocks in both sides: 1 where length and SHA-256 are equal, else 0."""
    y = b.select(*keys, F.col("block_size").alias("_n"), F.col("content_sha256").alias("_s"))
    same = (F.col("block_size") == F.col("_n")) & (F.col("content_sha256") == F.col("_s"))
    return a.join(y, keys).select(*keys, F.when(same, 1.0).otherwise(0.0).alias("similarity"))


def size_similarity(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """(path, similarity) of files in both sides by their sizes alone; 0 where the smaller has less than ``least`` of the larger, 1 for two empty ones."""
    y = b.select("path", F.col("size").alias("_n"))
    top = F.greatest("size", "_n", F.lit(1))
    close = F.when((F.least("size", "_n") > 0) & (F.least("size", "_n") / top < least), 0.0).otherwise(1 - F.abs(F.col("size") - F.col("_n")) / top)
    return a.join(y, "path").select("path", close.alias("similarity"))


def range_overlap(blocks: DataFrame, start: int, length: int) -> DataFrame:
    """Blocks that overlap [start, start + length) of their file; the offset predicate reaches the scan."""
    if start < 0 or length < 0:
        raise ValueError("start and length must not be negative")
    return blocks.where((F.col("file_offset") + F.col("block_size") > start) & (F.col("file_offset") < start + length))


def read_range(blocks: DataFrame, start: int, length: int) -> DataFrame:
    """(file_id, path, data) of the byte range of every file; empty beyond a file's end."""
    hit = range_overlap(blocks, start, length)
    a, b = F.greatest(F.lit(start), F.col("file_offset")), F.least(F.lit(start + length), F.col("file_offset") + F.col("block_size"))
    part = hit.withColumn("part", F.substring("data", (a - F.col("file_offset") + 1).cast("int"), (b - a).cast("int")))
    return part.groupBy("file_id", "path").agg(F.expr("listagg(part) within group (order by block_index)").alias("data"))


def reconstruct(blocks: DataFrame) -> DataFrame:
    """(file_id, path, data): blocks of each file in order."""
    return blocks.groupBy("file_id", "path").agg(F.expr("listagg(data) within group (order by block_index)").alias("data"))


def overlap_join(blocks: DataFrame, ranges: DataFrame, block_size: int) -> DataFrame:
    """Blocks of the ranges (file_id, lo, hi): an equi join on (file_id, block index) since a range knows its blocks."""
    need = ranges.where("hi > lo").withColumn("block_index", F.explode(F.expr(f"sequence(lo div {block_size}, (hi - 1) div {block_size})")))
    return need.join(blocks, ["file_id", "block_index"])


def size_text(size):
    """Bytes as text with two decimals from 1 KB on."""
    s = size if not isinstance(size, str) else F.col(size)
    gb, mb, kb = 1 << 30, 1 << 20, 1 << 10
    two = lambda unit, by: F.format_string(f"%.2f {unit}", F.bround(s / by, 2))  # noqa: E731  ties to even
    return F.when(s >= gb, two("GB", gb)).when(s >= mb, two("MB", mb)).when(s >= kb, two("KB", kb)).otherwise(F.concat(s.cast("string"), F.lit(" bytes")))


def ratio(compressed, original):
    return F.when(F.col(original) == 0, F.lit(1.0)).otherwise(F.col(compressed) / F.col(original))
