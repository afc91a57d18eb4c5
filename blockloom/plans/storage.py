"""Registered queries over codecs, archives and streams; oracles compare invariants, never payload bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from blockloom.codecs import candidates
from blockloom.codecs.core import QuantBlock
from blockloom.functions.block_codecs import candidate_chain, dtype_name, with_decoding, with_encoding
from blockloom.operators import blocks as B
from blockloom.operators import tensors as T
from blockloom.plans.relational import BLOCKS, BS, FILES, TENSORS
from blockloom.session import shared_dir
from blockloom.sources import archive as A
from blockloom.streaming import arrivals

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BIG = 4096


def _roundtrip(name: str, codec: str, dtypes: tuple[str, ...] = ()) -> None:
    def run(spark, d):
        b = B.split_blocks(B.document_files(spark, d), BIG)
        dtype = F.element_at(F.array(*map(F.lit, dtypes)), (F.col("file_id") % len(dtypes) + 1).cast("int")) if dtypes else F.lit(None).cast("string")
        back = with_decoding(with_encoding(b.select("path", "block_index", "block_size", dtype.alias("dtype"), F.sha2("data", 256).alias("content_sha256"), "data"), codec, dtype="dtype"))
        return back.select("path", "block_index", "block_size", F.sha2("data", 256).alias("sha256"), F.coalesce(F.sha2("data", 256) == F.col("content_sha256"), F.lit(False)).alias("ok"))

    QUERIES[name] = run
    ORACLES[name] = f"WITH {FILES}, c AS (SELECT *, unnest(generate_series(0, size - 1, {BIG})) AS o FROM files) SELECT path, CAST(o // {BIG} AS BIGINT) AS block_index, CAST(least({BIG}, size - o) AS BIGINT) AS block_size, sha256(content[o + 1 : least(o + {BIG}, size)]) AS sha256, TRUE AS ok FROM c"


for _n, _c in (("raw_roundtrip", "raw"), ("zlib_roundtrip", "zlib"), ("zstd_roundtrip", "zstd"), ("byteplane_roundtrip", "byteplane"), ("auto_select_roundtrip", "auto")):
    _roundtrip(_n, _c)
_roundtrip("gguf_quant_roundtrip", "gguf_quant_block", (*QuantBlock.PLANED, "IQ4_XS", "F16"))


def _f32_bytes(embedding):
    """The little-endian bytes of an array of floats, with built-in functions."""
    swap = lambda x: F.concat(*[F.lpad(F.hex(T.byte_of(T.float_bits(x), k)), 2, "0") for k in range(4)])
    return F.unhex(F.array_join(F.transform(embedding, swap), ""))


def floatplane_roundtrip(spark, d):
    t = T.embedding_tensors(spark, d).select("name", F.lit("F32").alias("dtype"), _f32_bytes(F.col("embedding")).alias("data"), F.col("byte_size").alias("block_size"))
    back = with_decoding(with_encoding(t.withColumn("content_sha256", F.sha2("data", 256)), "floatplane", dtype="dtype", path=None))
    return back.select("name", "block_size", (F.sha2("data", 256) == F.col("content_sha256")).alias("ok"))


QUERIES["floatplane_roundtrip"] = floatplane_roundtrip
ORACLES["floatplane_roundtrip"] = f"WITH {TENSORS} SELECT name, byte_size AS block_size, TRUE AS ok FROM tensors"


def dtype_normalize(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("BFLOAT16", " f32 ", "Float16", "float64", "i8", "FP32"))), (F.col("vec_id") % 6 + 1).cast("int"))
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", raw.alias("raw"))
    return e.select("vec_id", dtype_name(F.col("raw")).alias("dtype"), F.array_join(candidate_chain(F.col("raw")), ",").alias("chain"))


_CHAIN = "CASE WHEN dtype IN ('BF16', 'FP16', 'F16', 'FP32', 'F32') THEN 'floatplane,byteplane,zstd,zlib,raw' ELSE 'zstd,zlib,raw' END"
QUERIES["codec_candidates"] = dtype_normalize
ORACLES["codec_candidates"] = f"WITH n AS (SELECT vec_id, CASE CAST(vec_id % 6 AS INTEGER) WHEN 0 THEN 'BF16' WHEN 1 THEN 'F32' WHEN 2 THEN 'FP16' WHEN 3 THEN 'FP64' WHEN 4 THEN 'I8' ELSE 'FP32' END AS dtype FROM embeddings) SELECT vec_id, dtype, {_CHAIN} AS chain FROM n"


def codec_argmin(spark, d):
    """The relational form of the choice: the candidates' encodings as rows, the smallest by (size, priority), against what "auto" stores."""
    tried = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(n).alias("wanted")) for i, n in enumerate((*candidates(None), "auto"))])
    b = B.split_blocks(B.document_files(spark, d), BIG).withColumn("c", F.explode(tried)).select("path", "block_index", "data", "c.*")
    e, auto = with_encoding(b, choice="wanted"), F.col("wanted") == "auto"
    got = e.groupBy("path", "block_index").agg(F.min_by("codec", F.when(~auto, F.struct("compressed_size", "priority"))).alias("least"), F.max(F.when(auto, F.col("codec"))).alias("chosen"), F.min(F.when(~auto, F.col("compressed_size"))).alias("n"), F.max(F.when(auto, F.col("compressed_size"))).alias("stored"))
    return got.select("path", "block_index", ((F.col("least") == F.col("chosen")) & (F.col("n") == F.col("stored"))).alias("same"))


QUERIES["codec_argmin"] = codec_argmin
ORACLES["codec_argmin"] = f"WITH {FILES}, c AS (SELECT path, unnest(generate_series(0, size - 1, {BIG})) AS o FROM files) SELECT path, CAST(o // {BIG} AS BIGINT) AS block_index, TRUE AS same FROM c"


def _packed(spark, d, **how):
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    A.pack(B.document_files(spark, d).select("file_id", "path", "size", "content"), path, BIG, **how)
    return path


def archive_pack_unpack(spark, d):
    return A.Archive(spark, _packed(spark, d)).read_files().select("path", "size", F.sha2("data", 256).alias("sha256"), "ok")


QUERIES["archive_pack_unpack"] = archive_pack_unpack
ORACLES["archive_pack_unpack"] = f"WITH {FILES} SELECT path, CAST(size AS BIGINT) AS size, sha256(content) AS sha256, TRUE AS ok FROM files"


def archive_selective_extract(spark, d):
    a = A.Archive(spark, _packed(spark, d, codec="zstd"))
    hit = B.range_overlap(a.blocks.where(F.col("path").startswith("de/")), 1000, 5000)
    got = B.read_range(a.decoded(hit).select("file_id", "path", "block_index", "file_offset", "block_size", "data"), 1000, 5000)
    return got.select("path", F.sha2("data", 256).alias("sha256"))


QUERIES["archive_selective_extract"] = archive_selective_extract
ORACLES["archive_selective_extract"] = f"WITH {FILES} SELECT path, sha256(content[1001 : least(6000, size)]) AS sha256 FROM files WHERE size > 1000 AND path LIKE 'de/%'"


def archive_delta(spark, d):
    """A second version against the first: only changed blocks are stored, and both versions restore."""
    base = _packed(spark, d, codec="zlib")
    f = B.document_files(spark, d).where("file_id % 17 <> 0").select("file_id", "path", F.when(F.col("file_id") % 10 == 0, F.concat("content", F.encode(F.lit("x"), "UTF-8"))).otherwise(F.col("content")).alias("content"))
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    A.pack(f.withColumn("size", F.octet_length("content").cast("long")), path, BIG, codec="zlib", base=base)
    return A.Archive(spark, path, base).read_files().select("path", "size", F.sha2("data", 256).alias("sha256"), "ok")


QUERIES["archive_delta"] = archive_delta
ORACLES["archive_delta"] = f"WITH {FILES}, n AS (SELECT path, encode(CASE WHEN file_id % 10 = 0 THEN decode(content) || 'x' ELSE decode(content) END) AS content FROM files WHERE file_id % 17 <> 0) SELECT path, octet_length(content) AS size, sha256(content) AS sha256, TRUE AS ok FROM n"


def verify_full(spark, d):
    """A damaged archive: every thirteenth file's first stored payload is cut short."""
    a = A.Archive(spark, _packed(spark, d, codec="zlib", dedup=False))
    hurt = (F.col("file_id") % 13 == 0) & (F.col("block_index") == 0)
    a.blocks = a.blocks.withColumn("payload", F.when(hurt, F.expr("substring(payload, 1, octet_length(payload) - 3)")).otherwise(F.col("payload")))
    return a.errors(full=True).groupBy("path").agg(F.count_if(F.col("error") == "payload checksum differs").alias("checksum"), (F.count("*") > 1).alias("undecodable"))


QUERIES["verify_full"] = verify_full
ORACLES["verify_full"] = f"WITH {FILES} SELECT path, 1::BIGINT AS checksum, TRUE AS undecodable FROM files WHERE file_id % 13 = 0 AND size > 0"


def stream_dedup(spark, d):
    """Distinct contents of a stream of documents, as a batch would find them."""
    here = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    docs = spark.readStream.schema(schema).parquet(f"{d}/documents*.parquet")
    files = docs.where("text is not null").select(F.col("doc_id").alias("file_id"), F.octet_length("text").cast("long").alias("size"), F.encode("text", "UTF-8").alias("content"))
    arrivals.run_available(arrivals.new_contents(files, BS).select("content_sha256", "block_size"), f"{here}/out", f"{here}/state")
    return spark.read.parquet(f"{here}/out")


QUERIES["stream_dedup"] = stream_dedup
ORACLES["stream_dedup"] = f"WITH {BLOCKS} SELECT content_sha256, max(block_size) AS block_size FROM prints GROUP BY 1"
QUERIES["arrivals_windowed"] = lambda spark, d: arrivals.windowed_arrivals(spark.read.parquet(f"{d}/events.parquet"))
ORACLES["arrivals_windowed"] = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"


def arrivals_stream(spark, d):
    """The windows of a stream that its watermark has closed, each with its final count."""
    here = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    arrivals.run_available(arrivals.windowed_arrivals(events), f"{here}/out", f"{here}/state")
    return spark.read.parquet(f"{here}/out")


QUERIES["arrivals_stream"] = arrivals_stream
ORACLES["arrivals_stream"] = "WITH w AS (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
