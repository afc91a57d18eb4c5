"""Tensors as byte intervals of files, and bit planes of float columns, with built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.operators.blocks import running_total


def embedding_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an F32 tensor of one virtual file: (name, dtype, byte_offset, byte_size, embedding)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
    sized = e.select("vec_id", "embedding", (F.size("embedding") * 4).cast("long").alias("byte_size"))
    at = running_total(sized.select("vec_id", "byte_size"), ["vec_id"], "byte_size", "byte_offset").select("vec_id", "byte_offset")
    return sized.join(at, "vec_id").select("vec_id", F.concat(F.lit("emb."), F.col("vec_id")).alias("name"), F.lit("F32").alias("dtype"), "byte_offset", "byte_size", "embedding")


def attribute(blocks: DataFrame, tensors: DataFrame, block_size: int, header: int = 0) -> DataFrame:
    """Blocks (file_id, file_offset) with the tensor that holds their first byte, or null.

    A range join without a nested loop: a tensor is sent to each grid cell that it covers the start of, and a block is
    one cell, so the join is an equi join on (file_id, cell) with the interval as a residual.
    """
    cells = tensors.withColumn("lo", F.col("byte_offset") + header).withColumn("hi", F.col("byte_offset") + header + F.col("byte_size"))
    cells = cells.where("hi > lo").withColumn("cell", F.explode(F.expr(f"sequence(lo div {block_size}, (hi - 1) div {block_size})")))
    b = blocks.withColumn("cell", F.expr(f"file_offset div {block_size}"))
    c = cells.select("file_id", "cell", "lo", "hi", F.col("name").alias("tensor_name"))
    on = (b.file_id == c.file_id) & (b.cell == c.cell) & (b.file_offset >= c.lo) & (b.file_offset < c.hi)
    return b.join(c, on, "left").select(b.file_id, b.file_offset, "tensor_name", "lo")


def exact_slices(blocks: DataFrame, tensors: DataFrame, block_size: int, header: int = 0) -> DataFrame:
    """(name, block_offset, slice_start, slice_length): the exact part of every block that belongs to a tensor."""
    t = tensors.withColumn("lo", F.col("byte_offset") + header).withColumn("hi", F.col("lo") + F.col("byte_size")).where("hi > lo")
    t = t.withColumn("cell", F.explode(F.expr(f"sequence(lo div {block_size}, (hi - 1) div {block_size})")))
    b = blocks.withColumn("cell", F.expr(f"file_offset div {block_size}")).select("file_id", "cell", "file_offset", "block_size")
    start = F.greatest(F.col("lo"), F.col("file_offset"))
    end = F.least(F.col("hi"), F.col("file_offset") + F.col("block_size"))
    return t.join(b, ["file_id", "cell"]).select("name", F.col("file_offset").alias("block_offset"), (start - F.col("file_offset")).alias("slice_start"), (end - start).alias("slice_length"))


def aligned_boundaries(tensors: DataFrame, size: int, block_size: int, header: int = 0) -> DataFrame:
    """Block starts of one file: the grid and all tensor starts, with each block's length (lead over the union)."""
    spark = tensors.sparkSession
    grid = spark.range(0, max(0, size), block_size).withColumnRenamed("id", "start") if size else spark.createDataFrame([], "start long")
    starts = grid.union(tensors.select((F.col("byte_offset") + header).alias("start"))).where(F.col("start") < size).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("start")  # the boundaries of one file
    return starts.withColumn("length", F.coalesce(F.lead("start").over(w), F.lit(size)) - F.col("start"))


def tensor_index(entries: DataFrame, block_tensors: DataFrame) -> DataFrame:
    """Full outer union of declared tensors and tensors named by blocks; declarations win."""
    e = entries.select("file_id", "name", F.col("dtype").alias("d1"))
    b = block_tensors.groupBy("file_id", F.col("tensor_name").alias("name")).agg(F.count("*").alias("n_blocks"), F.min("tensor_dtype").alias("d2"))
    return e.join(b, ["file_id", "name"], "full_outer").select("file_id", "name", F.coalesce("d1", "d2").alias("dtype"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))


def float_bits(x):
    """The raw 32 bits of a float as a signed int."""
    return F.java_method(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), x).cast("int")


def values(tensors: DataFrame) -> DataFrame:
    """(vec_id, pos, bits) of all elements."""
    return tensors.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", float_bits(F.col("x")).alias("bits"))


def sign(bits):
    return F.shiftrightunsigned(bits, 31)


def exponent(bits):
    return F.shiftrightunsigned(bits, 23).bitwiseAND(255)


def mantissa(bits):
    return bits.bitwiseAND((1 << 23) - 1)


def byte_of(bits, k: int):
    """Byte k of the little-endian value."""
    return F.shiftrightunsigned(bits, 8 * k).bitwiseAND(255)
