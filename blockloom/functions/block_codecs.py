"""Arrow functions that encode and decode block columns."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from blockloom import codecs
from blockloom.codecs.select import ALIASES, FLOAT_CHAIN, FLOATS, PLAIN_CHAIN
from blockloom.session import BATCH_BYTES, bounded_batches, ship

ENCODED = "struct<codec: string, payload: binary, codec_metadata: string, compressed_size: int, payload_sha256: string, candidates_tried: int>"


def dtype_name(dtype):
    """The usual name of a dtype column, as ``codecs.normalize_dtype`` gives it."""
    name = F.upper(F.trim(dtype))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), name), name)


def candidate_chain(dtype):
    """The codecs to try for a dtype column, in order, as an array."""
    chain = lambda names: F.array(*map(F.lit, names))
    return F.when(dtype_name(dtype).isin(*FLOATS), chain(FLOAT_CHAIN)).otherwise(chain(PLAIN_CHAIN))


def with_encoding(blocks: DataFrame, codec: str = "auto", level: int | None = None, dtype: str | None = None, path: str | None = "path", choice: str | None = None) -> DataFrame:
    """Blocks (data) with codec, payload, codec_metadata, compressed_size and payload_sha256 instead of the data.

    ``dtype`` and ``path`` name columns (or are null), and ``choice`` one whose codec goes before ``codec``; the whole choice runs
    in one pass over the block.
    """
    ship(blocks.sparkSession)
    bounded_batches(blocks.sparkSession)
    if codec != "auto":
        codecs.codec(codec)

    @F.arrow_udf(ENCODED)
    def run(data: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch, types, paths, choices in data:
            out = []
            for x, t, p, own in zip(batch.to_pylist(), types.to_pylist(), paths.to_pylist(), choices.to_pylist(), strict=True):
                if x is None:
                    out.append(None)
                    continue
                made, tried = codecs.select(x, codecs.Context(t, p or "", level), own or codec)
                out.append({"codec": made.codec, "payload": made.payload, "codec_metadata": json.dumps(made.metadata, sort_keys=True), "compressed_size": len(made.payload), "payload_sha256": hashlib.sha256(made.payload).hexdigest(), "candidates_tried": tried})
            yield pa.array(out, pa.struct([("codec", pa.string()), ("payload", pa.binary()), ("codec_metadata", pa.string()), ("compressed_size", pa.int32()), ("payload_sha256", pa.string()), ("candidates_tried", pa.int32())]))

    none = F.lit(None).cast("string")
    e = run(F.col("data"), F.col(dtype) if dtype else none, F.col(path) if path else none, F.col(choice) if choice else none)
    return blocks.withColumn("_e", e).drop("data").select("*", "_e.*").drop("_e")


def with_decoding(blocks: DataFrame, size: str = "block_size") -> DataFrame:
    """Blocks with ``data`` instead of the payload, or null and the reason in ``error``; small payloads may be large blocks, so results are handed on by bytes."""
    ship(blocks.sparkSession)
    bounded_batches(blocks.sparkSession)
    plain = blocks.drop("payload")
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(names)
            data, errors, first, held = [], [], 0, 0

            def made(first: int, n: int, data: list, errors: list, rest: pa.RecordBatch = rest) -> pa.RecordBatch:
                return rest.slice(first, n).append_column("data", pa.array(data, pa.binary())).append_column("error", pa.array(errors, pa.string()))

            of = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name)).to_pylist()
            for i, (x, c, k, m) in enumerate(zip(of("payload"), of("codec"), of(size), of("codec_metadata"), strict=True)):
                try:
                    got, error = codecs.decode(x, c, int(k), json.loads(m or "{}")), None
                except Exception as e:  # noqa: BLE001  hostile payloads raise anything; each becomes an error row
                    got, error = None, f"{type(e).__name__}: {e}"
                data.append(got)
                errors.append(error)
                held += len(got or b"")
                if held > BATCH_BYTES:
                    yield made(first, i + 1 - first, data, errors)
                    data, errors, first, held = [], [], i + 1, 0
            if data:
                yield made(first, len(data), data, errors)

    return blocks.mapInArrow(run, StructType([*plain.schema.fields, StructField("data", BinaryType()), StructField("error", StringType())]))
