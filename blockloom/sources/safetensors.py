"""safetensors headers with built-in functions: files (path, content) to files with errors, and to tensor rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HEADER = 100_000_000
_ENTRY = "map<string, struct<dtype: string, shape: array<bigint>, data_offsets: array<bigint>>>"


def headers(files: DataFrame) -> DataFrame:
    """(path, header_size, header json, error) of each file; header_size counts the length prefix.

    The content may be the header alone; the file's true length is its ``size``, if there is such a column.
    """
    n = F.expr("try_cast(conv(concat_ws('', transform(sequence(8, 1, -1), i -> hex(substring(content, i, 1)))), 16, 10) as decimal(20, 0))")
    size = F.col("size").cast("long") if "size" in files.columns else F.octet_length("content")
    h = files.withColumn("_n", n).withColumn("_size", size)
    error = (
        F.when(F.col("content").isNull(), "no content")
        .when(F.col("_size") < 8, "shorter than the length prefix")
        .when(F.col("_n") > MOST_HEADER, "header larger than allowed")
        .when(F.col("_n") > F.col("_size") - 8, "header beyond the end of the file")
        .when(F.hex(F.substring("content", 9, 1)) != "7B", "header is not a JSON object")
    )
    text = F.when(error.isNull(), F.expr("try_validate_utf8(cast(substring(content, 9, cast(_n as int)) as string))"))
    h = h.withColumn("error", error).withColumn("header", text)
    parsed = F.from_json("header", _ENTRY)
    bad = F.col("error").isNull() & (F.col("header").isNull() | parsed.isNull())
    return h.withColumn("error", F.when(bad, "header is not valid JSON").otherwise(F.col("error"))).select("path", F.when(F.col("error").isNull(), (F.col("_n") + 8).cast("long")).alias("header_size"), "header", "error")


def tensors(files: DataFrame) -> DataFrame:
    """(path, header_size, name, dtype, shape, byte_offset, byte_size, n_params) of all tensors of readable files."""
    h = headers(files).where("error is null")
    rows = h.select("path", "header_size", F.explode(F.from_json("header", _ENTRY)).alias("name", "t")).where("name <> '__metadata__'")
    offsets = F.col("t.data_offsets")
    return rows.select(
        "path", "header_size", "name", "t.dtype", "t.shape",
        F.get(offsets, F.lit(0)).alias("byte_offset"), (F.get(offsets, F.lit(1)) - F.get(offsets, F.lit(0))).alias("byte_size"),
        F.aggregate(F.coalesce("t.shape", F.array().cast("array<bigint>")), F.lit(1).cast("long"), lambda a, x: a * x).alias("n_params"),
    )


def summary(files: DataFrame) -> DataFrame:
    """Per file: tensors, bytes, parameters, sorted dtypes and the largest tensor."""
    return tensors(files).groupBy("path").agg(
        F.count("*").alias("tensor_count"), F.sum("byte_size").alias("total_bytes"), F.sum("n_params").alias("total_params"),
        F.array_sort(F.collect_set("dtype")).alias("dtypes"), F.max_by("name", F.struct("byte_size", -F.col("byte_offset"))).alias("largest"),
    )


def build(entries: list[tuple[str, str, list[int], bytes]], metadata: dict | None = None) -> bytes:
    """A file of (name, dtype, shape, data); for tests and demos."""
    import json
    import struct

    header, at = ({"__metadata__": metadata} if metadata else {}), 0
    for name, dtype, shape, data in entries:
        header[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(data)]}
        at += len(data)
    body = json.dumps(header).encode()
    return struct.pack("<Q", len(body)) + body + b"".join(e[3] for e in entries)
