"""Registered queries over real files and archives: each writes its files or archive into the shared folder and reads them back."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom import codecs
from blockloom.functions.block_codecs import with_decoding, with_encoding
from blockloom.operators import artifacts
from blockloom.operators import blocks as B
from blockloom.operators import classify as C
from blockloom.plans.relational import _GGML, BLOCKS, BS, FILES, REFS
from blockloom.plans.storage import _f32_bytes
from blockloom.session import shared_dir, ship
from blockloom.sources import archive as A
from blockloom.sources import gguf, ranged, safetensors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BIG = 4096
PER_FILE = 10


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _files(spark, d) -> DataFrame:
    return B.document_files(spark, d).select("file_id", "path", "size", "content")


def _packed(spark, files: DataFrame, block_size: int = BIG, **how) -> A.Archive:
    path = _fresh(spark, "archive")
    A.pack(files, path, block_size, **({"codec": "zlib"} | how))
    return A.Archive(spark, path, how.get("base"))


def _folder(spark, d) -> str:
    """The documents as a folder of files."""
    out = _fresh(spark, "folder")
    _packed(spark, _files(spark, d), 1 << 18, codec="raw").unpack(out)
    return out


# --- files by range ---


@query("source_listing", f"WITH {FILES} SELECT path, CAST(size AS BIGINT) AS size FROM files")
def _(spark, d):
    return ranged.file_list(spark, _folder(spark, d)).select("path", "size")


_CUT = f"c AS (SELECT *, unnest(generate_series(0, size - 1, {BIG})) AS o FROM files)"


@query("source_blocks", f"WITH {FILES}, {_CUT} SELECT path, CAST(o // {BIG} AS BIGINT) AS block_index, CAST(least({BIG}, size - o) AS BIGINT) AS block_size, sha256(content[o + 1 : least(o + {BIG}, size)]) AS sha256 FROM c")
def _(spark, d):
    b = ranged.file_blocks(spark, _folder(spark, d), BIG)
    return b.select("path", "block_index", "block_size", F.sha2("data", 256).alias("sha256"))


@query("source_range_read", f"WITH {FILES} SELECT path, sha256(content[1001 : least(6000, size)]) AS sha256 FROM files WHERE size > 1000")
def _(spark, d):
    return B.read_range(ranged.file_blocks(spark, _folder(spark, d), BIG), 1000, 5000).select("path", F.sha2("data", 256).alias("sha256"))


@query("source_file_hashes", f"WITH {FILES} SELECT path, CAST(size AS BIGINT) AS bytes, sha256(content) AS sha256 FROM files WHERE size > 0")
def _(spark, d):
    return ranged.file_digests(spark, _folder(spark, d)).where("bytes > 0")


@query("folder_pack_unpack", f"WITH {FILES} SELECT path, CAST(size AS BIGINT) AS size, sha256(content) AS sha256 FROM files")
def _(spark, d):
    """A folder into an archive and out into another folder, a block at a time."""
    path, out = _fresh(spark, "archive"), _fresh(spark, "folder")
    A.pack_folder(spark, _folder(spark, d), path, BIG, codec="zstd")
    A.Archive(spark, path).unpack(out)
    return ranged.file_digests(spark, out).withColumnRenamed("bytes", "size")


@query("block_sink", f"WITH {FILES} SELECT path, CAST(size AS BIGINT) AS bytes, sha256(content) AS sha256 FROM files WHERE size > 0")
def _(spark, d):
    """Plain blocks into files, without an archive."""
    out = _fresh(spark, "folder")
    ranged.write_blocks(B.split_blocks(_files(spark, d), BIG), out)
    return ranged.file_digests(spark, out)


@query("folder_inspect", f"WITH {FILES} SELECT count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_bytes, max(size) = max(size) AS largest_found, 'unknown' AS artifact_type FROM files")
def _(spark, d):
    from blockloom.cli import inspected_folder

    folder = _folder(spark, d)
    seen = inspected_folder(spark, folder, set())
    largest = ranged.file_list(spark, folder).agg(F.max("size")).first()[0]
    is_largest = dict(ranged.listing(folder))[seen["largest"]] == largest
    return spark.createDataFrame([(seen["total_files"], seen["total_bytes"], is_largest, seen["artifact_type"])], "total_files long, total_bytes long, largest_found boolean, artifact_type string")


@query("pickle_magic", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'pytorch_bin' ELSE 'unknown' END AS format FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    """Files whose names say little: their first bytes tell."""
    content = F.when(F.col("file_id") % 3 == 0, F.concat(F.unhex(F.lit("8003")), "content")).otherwise(F.col("content"))
    return _files(spark, d).select(F.col("file_id").alias("doc_id"), C.file_format(F.lit("x.bin"), content).alias("format"))


# --- archives ---


@query("ratio", f"WITH {REFS} SELECT lang, round(sum(block_size) FILTER (WHERE dedup_ref < 0) / sum(block_size)::DOUBLE, 6) AS ratio FROM refs GROUP BY lang HAVING count(*) FILTER (WHERE dedup_ref < 0) > 0")
def _(spark, d):
    """What elision alone leaves of each language's files."""
    b = _packed(spark, _files(spark, d), BS, codec="raw").blocks
    s = b.groupBy(F.element_at(F.split("path", "/"), 1).alias("lang")).agg(F.sum("compressed_size").alias("c"), F.sum("block_size").alias("o"))
    return s.where("c is not null").select("lang", F.round(B.ratio("c", "o"), 6).alias("ratio"))


@query("archive_lookup", f"WITH {BLOCKS} SELECT path, block_index, block_size, content_sha256 FROM prints WHERE path = (SELECT min(path) FROM files WHERE size > 0)")
def _(spark, d):
    """The blocks of one file, by its path."""
    a = _packed(spark, _files(spark, d), BS)
    first = a.files.where("size > 0").agg(F.min("path")).first()[0]
    return a.blocks_of(first).select("path", "block_index", "block_size", "content_sha256")


_HURT = "CASE WHEN size > 0 AND file_id % 13 = 0 THEN 'payload checksum differs' WHEN size > 0 AND file_id % 13 = 1 THEN 'unknown codec' WHEN file_id % 13 = 2 THEN 'block sizes do not add up' END"


@query("verify_quick", f"WITH {FILES}, h AS (SELECT path, {_HURT} AS error FROM files) SELECT path, error, CASE WHEN error IS NULL THEN 'OK' ELSE 'FAILED' END AS integrity FROM h")
def _(spark, d):
    """An archive with cut payloads, a codec that nobody knows, and files of another size than their blocks."""
    a = _packed(spark, _files(spark, d), dedup=False)
    kind, first = F.col("file_id") % 13, F.col("block_index") == 0
    a.blocks = a.blocks.withColumn("payload", F.when((kind == 0) & first, F.expr("substring(payload, 1, octet_length(payload) - 3)")).otherwise(F.col("payload"))).withColumn("codec", F.when((kind == 1) & first, F.lit("none such")).otherwise(F.col("codec")))
    a.files = a.files.withColumn("size", F.when(kind == 2, F.col("size") + 1).otherwise(F.col("size")))
    found = a.files.select("path").join(a.errors(full=False).select("path", "error"), "path", "left")
    return found.withColumn("integrity", F.when(F.col("error").isNull(), "OK").otherwise("FAILED"))


@query("manifest_duplicate_paths", f"WITH {BLOCKS} SELECT path, NULL::BIGINT AS block_index, 'path occurs twice' AS error FROM files WHERE file_id % 7 = 0 UNION ALL SELECT path, block_index, 'block occurs twice' FROM prints WHERE file_id % 7 = 0")
def _(spark, d):
    """An archive some of whose files are listed twice."""
    a = _packed(spark, _files(spark, d), BS)
    a.blocks = a.blocks.unionByName(a.blocks.where("file_id % 7 = 0"))
    a.files = a.files.unionByName(a.files.where("file_id % 7 = 0"))
    return a.errors(full=False).where(F.col("error").endswith("occurs twice"))


@query("archive_block_table", f"WITH {REFS} SELECT path, block_index, file_offset, block_size, content_sha256, CAST(global_id AS BIGINT) AS global_id, CAST(dedup_ref AS BIGINT) AS dedup_ref, dedup_ref < 0 AS stored FROM refs")
def _(spark, d):
    b = _packed(spark, _files(spark, d), BS).blocks
    return b.select("path", "block_index", "file_offset", "block_size", "content_sha256", "global_id", "dedup_ref", F.col("payload").isNotNull().alias("stored"))


@query("archive_file_hashes", f"WITH {FILES} SELECT path, CAST(ceil(size / {BIG}::DOUBLE) AS BIGINT) AS n_blocks, CAST(size AS BIGINT) AS bytes, sha256(content) AS sha256 FROM files WHERE size > 0")
def _(spark, d):
    return A.file_hashes(_packed(spark, _files(spark, d)).resolved())


@query("archive_inspect", f"WITH {REFS}, b AS (SELECT count(*) AS total_blocks, count(*) FILTER (WHERE dedup_ref >= 0) AS duplicate_blocks, CAST(coalesce(sum(block_size) FILTER (WHERE dedup_ref >= 0), 0) AS BIGINT) AS saved_bytes FROM refs), f AS (SELECT count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_original_size FROM files) SELECT *, FALSE AS has_tensor_data FROM b, f")
def _(spark, d):
    seen = _packed(spark, _files(spark, d), BS).inspect()
    m = seen["manifest"]
    row = (seen["totals"]["total_blocks"], m["deduplication"]["duplicate_blocks"], seen["dedup_saved_bytes"], seen["totals"]["total_files"], m["total_original_size"], seen["has_tensor_data"])
    return spark.createDataFrame([row], "total_blocks long, duplicate_blocks long, saved_bytes long, total_files long, total_original_size long, has_tensor_data boolean")


@query("archive_verify_totals", f"WITH {BLOCKS} SELECT 'OK' AS integrity, (SELECT count(*) FROM files) AS total_files, (SELECT count(*) FROM prints) AS total_blocks, (SELECT CAST(sum(size) AS BIGINT) FROM files) AS restored_size")
def _(spark, d):
    got = _packed(spark, _files(spark, d), BS).verify()
    return spark.createDataFrame([tuple(got[k] for k in ("integrity", "total_files", "total_blocks", "restored_size"))], "integrity string, total_files long, total_blocks long, restored_size long")


@query("single_file_scan", f"WITH {FILES}, {_CUT} SELECT path, CAST(o // {BIG} AS BIGINT) AS block_index, CAST(least({BIG}, size - o) AS BIGINT) AS block_size, sha256(content[o + 1 : least(o + {BIG}, size)]) AS sha256 FROM c")
def _(spark, d):
    path = ranged.file_system(_fresh(spark, "one"))[1] + ".blk"
    A.write_single(_packed(spark, _files(spark, d)), path)
    A.register(spark)
    return spark.read.format("blockarchive").load(path).select("path", "block_index", "block_size", F.sha2("data", 256).alias("sha256"))


_SWAPPED = "two AS (SELECT path, min(block_index) AS a, max(block_index) AS z FROM (SELECT path, block_index, content_sha256 FROM prints WHERE block_size = 256 AND block_index < 2) GROUP BY path HAVING count(*) = 2 AND count(DISTINCT content_sha256) = 2)"


@query("verify_swapped_blocks", f"WITH {BLOCKS}, {_SWAPPED} SELECT path, 'file checksum differs' AS error FROM two")
def _(spark, d):
    """The first two blocks of every file change places: every block is whole, and only the file's hash can tell."""
    a = _packed(spark, _files(spark, d), BS)
    full = F.count_if((F.col("block_index") < 2) & (F.col("block_size") == BS)) == 2
    swap = a.blocks.groupBy("path").agg(full.alias("swap"))
    index = F.when(F.col("swap") & (F.col("block_index") < 2), 1 - F.col("block_index")).otherwise(F.col("block_index"))
    a.blocks = a.blocks.join(swap, "path").withColumn("block_index", index).drop("swap")
    return a.errors(full=True).select("path", "error")


_NEW = "n AS (SELECT path, unnest(generate_series(0, size - 1, 4096)) AS o, size, content FROM files WHERE file_id % 5 = 0), olds AS (SELECT path, unnest(generate_series(0, size - 1, 4096)) AS o, size, content FROM files), h AS (SELECT DISTINCT sha256(content[o + 1 : least(o + 4096, size)]) AS s FROM olds)"


@query("verify_missing_base", f"WITH {FILES}, {_NEW} SELECT path, CAST(o // 4096 AS BIGINT) AS block_index, 'base archive missing' AS error FROM n WHERE sha256(content[o + 1 : least(o + 4096, size)]) IN (SELECT s FROM h)")
def _(spark, d):
    """A delta archive opened without its base: every block that lives there is named, whether or not an equal one comes before it."""
    f = _files(spark, d)
    base = _packed(spark, f)
    a = A.Archive(spark, _packed(spark, f.where("file_id % 5 = 0"), base=base.path, dedup=False).path)
    return a.errors(full=False)


@query("delta_manifest", f"WITH {FILES} SELECT TRUE AS base_known, TRUE AS ok, count(*) AS total_files FROM files WHERE file_id % 5 = 0")
def _(spark, d):
    f = _files(spark, d)
    base = _packed(spark, f)
    a = _packed(spark, f.where("file_id % 5 = 0"), base=base.path)
    m = a.manifest()
    return spark.createDataFrame([(m["delta"]["base_sha256"] == A.fingerprint(base.files), a.verify()["integrity"] == "OK", m["total_files"])], "base_known boolean, ok boolean, total_files long")


def _own_codecs(spark, d) -> A.Archive:
    own = F.element_at(F.array(*map(F.lit, ("raw", "zlib", "zstd"))), (F.col("file_id") % 3 + 1).cast("int"))
    return _packed(spark, _files(spark, d).withColumn("codec_wanted", own), BS)


_OWN = f"{REFS}, used AS (SELECT path, lang, block_size, CASE WHEN dedup_ref >= 0 THEN 'duplicate' ELSE ['raw', 'zlib', 'zstd'][CAST(file_id % 3 + 1 AS INTEGER)] END AS codec FROM refs)"


@query("codec_usage_file", f"WITH {_OWN} SELECT path, codec, count(*) AS n FROM used GROUP BY ALL")
def _(spark, d):
    return _own_codecs(spark, d).codec_usage("path").select("path", "codec", F.col("blocks").alias("n"))


@query("codec_usage_total", f"WITH {_OWN} SELECT codec, count(*) AS n, CAST(sum(block_size) AS BIGINT) AS bytes FROM used GROUP BY codec")
def _(spark, d):
    return _own_codecs(spark, d).codec_usage().select("codec", F.col("blocks").alias("n"), "bytes")


@query("distinct_codecs", f"WITH {_OWN} SELECT lang, string_agg(DISTINCT codec, ',' ORDER BY codec) FILTER (WHERE codec <> 'duplicate') AS codecs FROM used GROUP BY lang")
def _(spark, d):
    b = _own_codecs(spark, d).blocks.withColumn("lang", F.element_at(F.split("path", "/"), 1))
    named = F.array_join(F.array_sort(F.collect_set("codec")), ",")
    return b.groupBy("lang").agg(F.when(F.count("codec") > 0, named).alias("codecs"))


@query("bench_codecs", f"WITH {FILES}, c(codec) AS (VALUES {', '.join(f'({n!r})' for n in codecs.registered())}), t AS (SELECT CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(ceil(size / {BIG}::DOUBLE)) AS BIGINT) AS blocks FROM files) SELECT codec, blocks, bytes, 0::BIGINT AS wrong FROM c, t")
def _(spark, d):
    """Every codec over every block: what it restores."""
    b = B.split_blocks(_files(spark, d), BIG).withColumn("sha", F.sha2("data", 256))
    out = None
    for name in codecs.registered():
        back = with_decoding(with_encoding(b.select("path", "block_size", "sha", "data"), name))
        wrong = ~F.coalesce(F.sha2("data", 256) == F.col("sha"), F.lit(False))
        one = back.agg(F.lit(name).alias("codec"), F.count("*").alias("blocks"), F.sum("block_size").alias("bytes"), F.count_if(wrong).alias("wrong"))
        out = one if out is None else out.unionByName(one)
    return out


# --- tensors ---


def safetensors_files(spark, d) -> DataFrame:
    """Every PER_FILE embeddings as a safetensors file."""
    ship(spark)
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("embedding is not null").select("vec_id", F.expr(f"vec_id div {PER_FILE}").alias("file_id"), F.size("embedding").alias("n"), _f32_bytes(F.col("embedding")).alias("data"))

    def build(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["vec_id"])
        raw = safetensors.build([(f"emb.{r['vec_id']}", "F32", [r["n"]], r["data"]) for r in rows], {"format": "pt"})
        i = rows[0]["file_id"]
        return pa.table({"file_id": pa.array([i], pa.int64()), "path": [f"part/{i}.safetensors"], "size": pa.array([len(raw)], pa.int64()), "content": pa.array([raw], pa.binary())})

    return e.groupBy("file_id").applyInArrow(build, "file_id long, path string, size long, content binary")


_ST = f"st AS (SELECT vec_id, 'part/' || (vec_id // {PER_FILE}) || '.safetensors' AS path, 'emb.' || vec_id AS name, CAST(len(embedding) AS BIGINT) AS n, CAST(coalesce(sum(len(embedding) * 4) OVER (PARTITION BY vec_id // {PER_FILE} ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM embeddings WHERE embedding IS NOT NULL)"


@query("safetensors_headers", f"WITH {_ST} SELECT path, TRUE AS readable, count(*) + 1 AS entries FROM st GROUP BY path")
def _(spark, d):
    h = safetensors.headers(safetensors_files(spark, d))
    return h.select("path", F.col("error").isNull().alias("readable"), F.size(F.json_object_keys("header")).cast("long").alias("entries"))


@query("safetensors_tensors", f"WITH {_ST} SELECT path, name, 'F32' AS dtype, n AS n_params, byte_offset, n * 4 AS byte_size FROM st")
def _(spark, d):
    return safetensors.tensors(safetensors_files(spark, d)).select("path", "name", "dtype", "n_params", "byte_offset", "byte_size")


@query("safetensors_summary", f"WITH {_ST} SELECT path, count(*) AS tensor_count, CAST(sum(n * 4) AS BIGINT) AS total_bytes, CAST(sum(n) AS BIGINT) AS total_params, 'F32' AS dtypes, arg_max(name, n * 1000000 - (vec_id % {PER_FILE})) AS largest FROM st GROUP BY path")
def _(spark, d):
    return safetensors.summary(safetensors_files(spark, d)).withColumn("dtypes", F.array_join("dtypes", ","))


@query("archive_tensor_index", f"WITH {_ST} SELECT path, name, 'F32' AS dtype, n AS n_params FROM st")
def _(spark, d):
    """Tensors named by the blocks of an archive whose blocks are smaller than any tensor."""
    b = _packed(spark, safetensors_files(spark, d), 64, tensor_aware=True).blocks
    return b.where("tensor_name is not null").select("path", F.col("tensor_name").alias("name"), F.col("tensor_dtype").alias("dtype"), F.get("tensor_shape", F.lit(0)).alias("n_params")).distinct()


@query("archive_tensor_read", "SELECT 'emb.' || vec_id AS name, TRUE AS ok FROM embeddings WHERE embedding IS NOT NULL")
def _(spark, d):
    """Every tensor's exact bytes out of an archive, by the blocks that its range touches."""
    f = safetensors_files(spark, d)
    a = _packed(spark, f, 1024, codec="floatplane", tensor_aware=True)
    t = safetensors.tensors(f).join(f.select("path", "file_id"), "path")
    lo = F.col("header_size") + F.col("byte_offset")
    hit = B.overlap_join(a.decoded().select("file_id", "block_index", "file_offset", "block_size", "data"), t.select("file_id", "name", lo.alias("lo"), (lo + F.col("byte_size")).alias("hi")), 1024)
    x, y = F.greatest("lo", "file_offset"), F.least("hi", F.col("file_offset") + F.col("block_size"))
    part = hit.withColumn("part", F.substring("data", (x - F.col("file_offset") + 1).cast("int"), (y - x).cast("int")))
    whole = part.groupBy("name").agg(F.expr("listagg(part) within group (order by block_index)").alias("data"))
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("embedding is not null").select(F.concat(F.lit("emb."), "vec_id").alias("name"), _f32_bytes(F.col("embedding")).alias("want"))
    return e.join(whole, "name", "left").select("name", F.coalesce(F.col("data") == F.col("want"), F.lit(False)).alias("ok"))


def gguf_files(spark, d) -> DataFrame:
    """Every brand's parts as the tensors of a GGUF file."""
    ship(spark)
    p = spark.read.parquet(f"{d}/part.parquet").select("p_brand", "p_partkey", "p_size")

    def build(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["p_partkey"])
        raw = gguf.build([(f"p.{r['p_partkey']}", [r["p_size"], 32], r["p_size"] % 35, 0) for r in rows], kv=3)
        return pa.table({"path": [f"{rows[0]['p_brand']}.gguf"], "size": pa.array([len(raw)], pa.int64()), "content": pa.array([raw], pa.binary())})

    return p.groupBy("p_brand").applyInArrow(build, "path string, size long, content binary")


@query("gguf_headers", "SELECT p_brand || '.gguf' AS path, 3 AS version, 'little' AS endianness, count(*) AS tensor_count, 3::BIGINT AS kv_count, 0 AS warnings FROM part GROUP BY p_brand")
def _(spark, d):
    return gguf.read(gguf_files(spark, d)).select("path", "version", "endianness", F.col("tensor_count").cast("long").alias("tensor_count"), F.col("kv_count").cast("long").alias("kv_count"), F.size("warnings").alias("warnings"))


@query("gguf_tensors", f"{_GGML} SELECT p_brand || '.gguf' AS path, 'p.' || p_partkey AS name, ggml_type, estimated_size FROM g JOIN part USING (p_partkey)")
def _(spark, d):
    return gguf.read(gguf_files(spark, d)).select("path", F.explode("tensors").alias("t")).select("path", "t.name", "t.ggml_type", "t.estimated_size")


@query("gguf_quantised_files", f"{_GGML} SELECT DISTINCT p_brand || '.gguf' AS path FROM g JOIN part USING (p_partkey) WHERE ggml_type NOT IN ('F32', 'F16', 'BF16', 'F64')")
def _(spark, d):
    return artifacts.quantised_files(gguf_files(spark, d))


# --- directories of side files ---


def _adapters(spark, d) -> DataFrame:
    """Adapter configurations, one per document, as files of JSON."""
    t = spark.read.parquet(f"{d}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    body = F.to_json(F.struct((F.col("doc_id") % 64 + 1).alias("r"), F.concat(F.lit("base/"), "lang").alias("base_model_name_or_path"), F.lit("LORA").alias("peft_type")))
    files = t.select(F.concat(F.lit("run-"), "doc_id", F.lit("/adapter_config.json")).alias("path"), F.encode(body, "UTF-8").alias("content"))
    return files.withColumn("size", F.octet_length("content").cast("long"))


@query("lora_directory", "SELECT 'run-' || doc_id AS dir, TRUE AS is_lora, CAST(doc_id % 64 + 1 AS INTEGER) AS rank, 'base/' || lang AS base_model FROM documents WHERE lang IS NOT NULL")
def _(spark, d):
    return artifacts.lora_adapters(_adapters(spark, d)).select("dir", "is_lora", "rank", "base_model")


@query("checkpoint_directory", "SELECT 'run-' || doc_id AS dir, TRUE AS is_checkpoint, CAST(doc_id * 10 AS BIGINT) AS step FROM documents")
def _(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    body = F.to_json(F.struct((F.col("doc_id") * 10).alias("global_step"), F.lit(1.5).alias("epoch")))
    files = t.select(F.concat(F.lit("run-"), "doc_id", F.lit("/trainer_state.json")).alias("path"), F.encode(body, "UTF-8").alias("content"))
    return artifacts.checkpoints(files).select("dir", "is_checkpoint", "step")


@query("manifest_lora", "SELECT 'lora_adapter' AS artifact_type, min('run-' || doc_id) AS dir, arg_min(doc_id % 64 + 1, 'run-' || doc_id) AS rank, arg_min('base/' || lang, 'run-' || doc_id) AS base_model FROM documents WHERE lang IS NOT NULL")
def _(spark, d):
    """What a manifest says of an archive of adapters: its type, and the first adapter's configuration."""
    m = A.pack(_adapters(spark, d), _fresh(spark, "archive"), codec="zlib", artifact_type="detect")
    x = m["artifact_metadata"]
    return spark.createDataFrame([(m["artifact_type"], x["dir"], x["rank"], x["base_model"])], "artifact_type string, dir string, rank long, base_model string")


@query("manifest_gguf", f"{_GGML} SELECT 'gguf_model' AS artifact_type, 3::BIGINT AS version, ggml_type, count(*) AS n FROM g JOIN part USING (p_partkey) WHERE p_brand = (SELECT min(p_brand) FROM part) GROUP BY ggml_type")
def _(spark, d):
    """What a manifest says of an archive of GGUF files: the header and types of the first."""
    m = A.pack(gguf_files(spark, d), _fresh(spark, "archive"), codec="zlib", artifact_type="detect", gguf_aware=True)
    x = m["artifact_metadata"]
    return spark.createDataFrame([(m["artifact_type"], x["version"], k, n) for k, n in x["quantization"].items()], "artifact_type string, version long, ggml_type string, n long")
