"""Registered queries of the relational core, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.operators import blocks as B
from blockloom.operators import classify as C
from blockloom.operators import ggml as G
from blockloom.operators import tensors as T
from blockloom.session import cut

#: Block size of the queries over the small driver tables; archives use blocks.DEFAULT_BLOCK.
BS = 256

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

FILES = "files AS (SELECT doc_id AS file_id, lang || '/' || source || '/' || doc_id || '.txt' AS path, encode(text) AS content, octet_length(encode(text)) AS size, lang, source FROM documents WHERE text IS NOT NULL)"
BLOCKS = f"""{FILES}, cuts AS (SELECT *, unnest(generate_series(0, size - 1, {BS})) AS file_offset FROM files),
blocks AS (SELECT file_id, path, size, lang, source, CAST(file_offset AS BIGINT) AS file_offset, CAST(file_offset // {BS} AS BIGINT) AS block_index, CAST(least({BS}, size - file_offset) AS BIGINT) AS block_size, content[file_offset + 1 : least(file_offset + {BS}, size)] AS data FROM cuts),
prints AS (SELECT * EXCLUDE (data), sha256(data) AS content_sha256 FROM blocks)"""
IDS = f"{BLOCKS}, ids AS (SELECT *, CAST(row_number() OVER (ORDER BY path, file_id, block_index) - 1 AS BIGINT) AS global_id FROM prints)"
REFS = f"{IDS}, refs AS (SELECT *, CASE WHEN min(global_id) OVER (PARTITION BY content_sha256) = global_id THEN -1 ELSE min(global_id) OVER (PARTITION BY content_sha256) END AS dedup_ref FROM ids)"
TENSORS = "tensors AS (SELECT vec_id, 'emb.' || vec_id AS name, 'F32' AS dtype, embedding, CAST(len(embedding) * 4 AS BIGINT) AS byte_size, CAST(coalesce(sum(len(embedding) * 4) OVER (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM embeddings WHERE embedding IS NOT NULL)"


def query(name: str, sql: str | None):
    """Register a query and its oracle."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def files(spark, d):
    return B.document_files(spark, d)


def blocks(spark, d):
    return B.split_blocks(files(spark, d), BS)


def prints(spark, d):
    return B.fingerprints(blocks(spark, d))


def ids(spark, d):
    return B.global_ids(prints(spark, d), BS)


def refs(spark, d):
    return B.dedup_refs(cut(ids(spark, d).select("path", "global_id", "content_sha256", "block_size")))


# --- files and blocks ---


@query("scan_files", f"WITH {FILES} SELECT path, CAST(size AS BIGINT) AS size FROM files")
def _(spark, d):
    return files(spark, d).select("path", "size")


@query("file_sha256", f"WITH {FILES} SELECT path, sha256(content) AS sha256 FROM files")
def _(spark, d):
    return files(spark, d).select("path", F.sha2("content", 256).alias("sha256"))


@query("size_format", f"WITH {FILES}, s AS (SELECT path, CAST(size * 37 * (1::BIGINT << CAST(10 * (file_id % 4) AS INTEGER)) AS BIGINT) AS n FROM files) SELECT path, CASE WHEN n >= 1073741824 THEN format('{{:.2f}} GB', n / 1073741824.0) WHEN n >= 1048576 THEN format('{{:.2f}} MB', n / 1048576.0) WHEN n >= 1024 THEN format('{{:.2f}} KB', n / 1024.0) ELSE n || ' bytes' END AS size_text FROM s")
def _(spark, d):
    return files(spark, d).select("path", B.size_text(F.expr("size * 37 * shiftleft(1L, cast(10 * (file_id % 4) as int))")).alias("size_text"))


@query("split_blocks", f"WITH {BLOCKS} SELECT path, block_index, file_offset, block_size FROM blocks")
def _(spark, d):
    return blocks(spark, d).select("path", "block_index", "file_offset", "block_size")


@query("block_fingerprint", f"WITH {BLOCKS} SELECT path, block_index, content_sha256 FROM prints")
def _(spark, d):
    return prints(spark, d).select("path", "block_index", "content_sha256")


@query("fingerprint_skeleton", f"WITH {BLOCKS} SELECT path, block_index, block_size, '' AS content_sha256 FROM blocks")
def _(spark, d):
    return B.skeleton(blocks(spark, d)).select("path", "block_index", "block_size", "content_sha256")


@query("block_global_id", f"WITH {IDS} SELECT path, block_index, global_id FROM ids")
def _(spark, d):
    return ids(spark, d).select("path", "block_index", "global_id")


@query("block_chunk_size_lead", f"WITH {BLOCKS} SELECT path, block_index, coalesce(lead(file_offset) OVER (PARTITION BY file_id ORDER BY block_index), size) - file_offset AS chunk_size FROM blocks")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("block_index")
    return blocks(spark, d).select("path", "block_index", (F.coalesce(F.lead("file_offset").over(w), F.col("size")) - F.col("file_offset")).alias("chunk_size"))


@query("file_offset_cumsum", f"WITH {BLOCKS} SELECT path, block_index, CAST(coalesce(sum(block_size) OVER (PARTITION BY file_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM blocks")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, -1)
    return blocks(spark, d).select("path", "block_index", F.coalesce(F.sum("block_size").over(w), F.lit(0)).alias("start"))


@query("archive_offset_cumsum", f"WITH {FILES} SELECT path, CAST(coalesce(sum(size) OVER (ORDER BY path, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS archive_offset FROM files")
def _(spark, d):
    return B.running_total(files(spark, d).select("path", "file_id", "size"), ["path", "file_id"], "size", "archive_offset").select("path", "archive_offset")


# --- dedup ---


@query("dedup_stats", f"WITH {BLOCKS}, per AS (SELECT lang, content_sha256, count(*) AS n, max(block_size) AS b FROM prints GROUP BY ALL) SELECT lang, CAST(sum(n) AS BIGINT) AS total_blocks, count(*) AS unique_blocks, CAST(sum(n - 1) AS BIGINT) AS duplicate_blocks, CAST(sum((n - 1) * b) AS BIGINT) AS saved_bytes FROM per GROUP BY lang")
def _(spark, d):
    return B.dedup_stats(prints(spark, d), ["lang"])


@query("dedup_refs", f"WITH {REFS} SELECT global_id, content_sha256, dedup_ref FROM refs")
def _(spark, d):
    return refs(spark, d).select("global_id", "content_sha256", "dedup_ref")


@query("dedup_groups", f"WITH {IDS} SELECT content_sha256, min(global_id) AS canonical_id, count(*) AS total_refs, CAST(sum(block_size) - max(block_size) AS BIGINT) AS saved_bytes FROM ids GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return B.dedup_groups(ids(spark, d))


@query("dedup_members", f"WITH {REFS} SELECT content_sha256, dedup_ref AS canonical_id, global_id AS duplicate_id FROM refs WHERE dedup_ref >= 0")
def _(spark, d):
    return B.dedup_members(refs(spark, d))


@query("dedup_unique_blocks", f"WITH {REFS} SELECT global_id, block_size FROM refs WHERE dedup_ref < 0")
def _(spark, d):
    r = refs(spark, d)
    return r.join(r.where("dedup_ref >= 0").select("global_id"), "global_id", "left_anti").select("global_id", "block_size")


_BROKEN = "broken AS (SELECT global_id, CASE WHEN global_id % 97 = 5 THEN global_id + 10000000 WHEN global_id % 89 = 3 THEN global_id - 1 ELSE dedup_ref END AS dedup_ref FROM refs)"


@query("dedup_invalid_refs", f"WITH {REFS}, {_BROKEN}, r AS (SELECT a.global_id, a.dedup_ref, CASE WHEN b.global_id IS NULL THEN 'missing' WHEN b.dedup_ref >= 0 THEN 'chained' END AS reason FROM broken a LEFT JOIN broken b ON a.dedup_ref = b.global_id WHERE a.dedup_ref >= 0) SELECT * FROM r WHERE reason IS NOT NULL")
def _(spark, d):
    g = F.col("global_id")
    broken = refs(spark, d).select("global_id", F.when(g % 97 == 5, g + 10000000).when(g % 89 == 3, g - 1).otherwise(F.col("dedup_ref")).alias("dedup_ref"))
    return B.invalid_refs(broken)


# --- delta: the base is the table, the new version has changed and removed files ---

_NEW = f"""{IDS}, nf AS (SELECT file_id, path, encode(CASE WHEN file_id % 10 = 0 THEN decode(content) || 'x' ELSE decode(content) END) AS content FROM files WHERE file_id % 17 <> 0),
nb AS (SELECT file_id, path, o // {BS} AS block_index, sha256(content[o + 1 : least(o + {BS}, octet_length(content))]) AS content_sha256 FROM (SELECT *, unnest(generate_series(0, octet_length(content) - 1, {BS})) AS o FROM nf))"""


def new_version(spark, d):
    f = files(spark, d).where("file_id % 17 <> 0")
    text = F.when(F.col("file_id") % 10 == 0, F.concat("content", F.encode(F.lit("x"), "UTF-8"))).otherwise(F.col("content"))
    return B.fingerprints(B.split_blocks(f.withColumn("content", text).withColumn("size", F.octet_length("content").cast("long")), BS))


@query("delta_by_hash", f"WITH {_NEW} SELECT path, CAST(block_index AS BIGINT) AS block_index, base_id, base_id IS NULL AS is_changed FROM nb LEFT JOIN (SELECT content_sha256, min(global_id) AS base_id FROM ids GROUP BY 1) USING (content_sha256)")
def _(spark, d):
    return B.delta_by_hash(new_version(spark, d), ids(spark, d)).select("path", "block_index", "base_id", "is_changed")


@query("delta_positional", f"WITH {_NEW} SELECT nb.path, CAST(nb.block_index AS BIGINT) AS block_index, nb.content_sha256 IS DISTINCT FROM p.content_sha256 AS is_changed FROM nb LEFT JOIN prints p ON nb.path = p.path AND nb.block_index = p.block_index")
def _(spark, d):
    return B.delta_positional(new_version(spark, d), prints(spark, d)).select("path", "block_index", "is_changed")


@query("delta_plan", f"WITH {_NEW} SELECT count(*) AS total_blocks, count(*) FILTER (WHERE content_sha256 NOT IN (SELECT content_sha256 FROM prints)) AS changed_blocks, count(*) FILTER (WHERE content_sha256 IN (SELECT content_sha256 FROM prints)) AS referenced_blocks FROM nb")
def _(spark, d):
    x = B.delta_by_hash(new_version(spark, d), ids(spark, d))
    return x.agg(F.count("*").alias("total_blocks"), F.count_if("is_changed").alias("changed_blocks"), F.count_if(~F.col("is_changed")).alias("referenced_blocks"))


@query("file_similarity", f"WITH {_NEW} SELECT coalesce(nb.path, p.path) AS path, count(*) FILTER (WHERE nb.content_sha256 = p.content_sha256) AS matching, count(*) AS total FROM nb FULL JOIN prints p ON nb.path = p.path AND nb.block_index = p.block_index GROUP BY 1")
def _(spark, d):
    return B.file_similarity(new_version(spark, d), prints(spark, d))


@query("block_similarity", f"WITH {_NEW} SELECT p.path, p.block_index, CASE WHEN nb.content_sha256 = p.content_sha256 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS similarity FROM nb JOIN prints p ON nb.path = p.path AND nb.block_index = p.block_index")
def _(spark, d):
    return B.block_similarity(new_version(spark, d), prints(spark, d), ["path", "block_index"])


@query("file_similarity_size_only", f"WITH {FILES}, p AS (SELECT path, size AS x, size * (1 + file_id % 4) AS y FROM files) SELECT path, round(CASE WHEN least(x, y) > 0 AND least(x, y) / greatest(x, y, 1)::DOUBLE < 0.5 THEN 0.0 ELSE 1 - abs(x - y) / greatest(x, y, 1)::DOUBLE END, 6) AS similarity FROM p")
def _(spark, d):
    """A version in which files are once to four times as long as before."""
    f = files(spark, d)
    y = f.select("path", F.octet_length(F.expr("repeat(decode(content, 'UTF-8'), cast(1 + file_id % 4 as int))")).alias("size"))
    return B.size_similarity(y, f.select("path", "size")).select("path", F.round("similarity", 6).alias("similarity"))


# --- reads ---


@query("range_read", f"WITH {FILES} SELECT path, lower(hex(content[101 : least(800, size)])) AS data_hex FROM files WHERE size > 100")
def _(spark, d):
    return B.read_range(blocks(spark, d), 100, 700).select("path", F.lower(F.hex("data")).alias("data_hex"))


@query("read_file_concat", f"WITH {FILES} SELECT path, sha256(content) AS sha256 FROM files WHERE size > 0")
def _(spark, d):
    return B.reconstruct(blocks(spark, d)).select("path", F.sha2("data", 256).alias("sha256"))


@query("block_overlap_join", f"WITH {BLOCKS}, r AS (SELECT file_id, size // 3 AS lo, size // 3 + 300 AS hi FROM files) SELECT b.path, b.block_index FROM blocks b JOIN r ON b.file_id = r.file_id AND b.file_offset + b.block_size > r.lo AND b.file_offset < r.hi")
def _(spark, d):
    r = files(spark, d).select("file_id", F.expr("size div 3").alias("lo"), F.expr("size div 3 + 300").alias("hi"))
    return B.overlap_join(blocks(spark, d).select("file_id", "path", "block_index"), r, BS).select("path", "block_index")


@query("verify_totals", f"WITH {REFS} SELECT count(DISTINCT path) AS total_files, count(*) AS total_blocks, CAST(sum(block_size) AS BIGINT) AS restored_size, CAST(sum(CASE WHEN dedup_ref < 0 THEN block_size ELSE 0 END) AS BIGINT) AS stored_size FROM refs")
def _(spark, d):
    per = refs(spark, d).groupBy("path").agg(F.count("*").alias("n"), F.sum("block_size").alias("r"), F.sum(F.when(F.col("dedup_ref") < 0, F.col("block_size")).otherwise(0)).alias("s"))
    return per.agg(F.count("*").alias("total_files"), F.sum("n").alias("total_blocks"), F.sum("r").alias("restored_size"), F.sum("s").alias("stored_size"))


@query("manifest_validate_sizes", f"WITH {BLOCKS}, b AS (SELECT path, size, sum(block_size) - CASE WHEN max(file_id) % 11 = 0 THEN 1 ELSE 0 END AS total FROM blocks GROUP BY ALL) SELECT path, CAST(size AS BIGINT) AS size, CAST(total AS BIGINT) AS total FROM b WHERE size <> total")
def _(spark, d):
    b = blocks(spark, d).groupBy("path", "size").agg((F.sum("block_size") - F.when(F.max("file_id") % 11 == 0, 1).otherwise(0)).alias("total"))
    return b.where("size <> total").select("path", "size", "total")


# --- tensors ---


@query("tensor_block_attribution", f"WITH {TENSORS}, b AS (SELECT unnest(generate_series(0, (SELECT max(byte_offset + byte_size) + 99 FROM tensors), 1000)) AS file_offset) SELECT CAST(file_offset AS BIGINT) AS file_offset, name AS tensor_name FROM b LEFT JOIN tensors ON file_offset >= byte_offset + 100 AND file_offset < byte_offset + 100 + byte_size")
def _(spark, d):
    t = T.embedding_tensors(spark, d).withColumn("file_id", F.lit(0).cast("long"))
    size = t.agg(F.max(F.col("byte_offset") + F.col("byte_size"))).first()[0]
    b = spark.range(0, size + 100, 1000).select(F.lit(0).cast("long").alias("file_id"), F.col("id").alias("file_offset"))
    return T.attribute(b, t, 1000, header=100).select("file_offset", "tensor_name")


@query("tensor_exact_slice", f"WITH {TENSORS}, b AS (SELECT unnest(generate_series(0, (SELECT max(byte_offset + byte_size) + 99 FROM tensors), 1000)) AS o) SELECT name, CAST(o AS BIGINT) AS block_offset, CAST(greatest(byte_offset + 100, o) - o AS BIGINT) AS slice_start, CAST(least(byte_offset + 100 + byte_size, o + 1000) - greatest(byte_offset + 100, o) AS BIGINT) AS slice_length FROM b JOIN tensors ON o < byte_offset + 100 + byte_size AND o + 1000 > byte_offset + 100")
def _(spark, d):
    t = T.embedding_tensors(spark, d).withColumn("file_id", F.lit(0).cast("long"))
    size = t.agg(F.max(F.col("byte_offset") + F.col("byte_size"))).first()[0]
    b = spark.range(0, size + 100, 1000).select(F.lit(0).cast("long").alias("file_id"), F.col("id").alias("file_offset"), F.lit(1000).cast("long").alias("block_size"))
    return T.exact_slices(b, t, 1000, header=100)


@query("tensor_index_full_outer", f"WITH {TENSORS}, e AS (SELECT name, dtype FROM tensors WHERE vec_id % 3 <> 0), b AS (SELECT name, count(*) AS n FROM (SELECT 'emb.' || (vec_id // 2) AS name FROM tensors) GROUP BY 1) SELECT coalesce(e.name, b.name) AS name, coalesce(e.dtype, 'BF16') AS dtype, coalesce(n, 0) AS n_blocks FROM e FULL JOIN b ON e.name = b.name")
def _(spark, d):
    t = T.embedding_tensors(spark, d).withColumn("file_id", F.lit(0).cast("long"))
    b = t.select("file_id", F.concat(F.lit("emb."), F.expr("vec_id div 2")).alias("tensor_name"), F.lit("BF16").alias("tensor_dtype"))
    return T.tensor_index(t.where("vec_id % 3 <> 0").select("file_id", "name", "dtype"), b).select("name", "dtype", "n_blocks")


@query("tensor_boundaries_exact", f"WITH {TENSORS}, z AS (SELECT max(byte_offset + byte_size) AS n FROM tensors), s AS (SELECT byte_offset AS start FROM tensors UNION SELECT unnest(generate_series(0, (SELECT n FROM z) - 1, 1000))) SELECT CAST(start AS BIGINT) AS start, CAST(coalesce(lead(start) OVER (ORDER BY start), (SELECT n FROM z)) - start AS BIGINT) AS length FROM s")
def _(spark, d):
    t = T.embedding_tensors(spark, d)
    size = t.agg(F.max(F.col("byte_offset") + F.col("byte_size"))).first()[0]
    return T.aligned_boundaries(t, size, 1000)


_BITS = f"{TENSORS}, v AS (SELECT vec_id, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM tensors), bits AS (SELECT vec_id, pos, x::FLOAT::BIT::INTEGER AS i, CAST(x::FLOAT::BIT::INTEGER AS BIGINT) & 4294967295 AS b FROM v)"


def _plane(name, spark_expr, sql_expr):
    @query(name, f"WITH {_BITS} SELECT vec_id, CAST(sum({sql_expr}) AS BIGINT) AS total, CAST(max({sql_expr}) AS BIGINT) AS high FROM bits GROUP BY vec_id")
    def _(spark, d):
        v = T.values(T.embedding_tensors(spark, d)).withColumn("x", spark_expr(F.col("bits")).cast("long"))
        return v.groupBy("vec_id").agg(F.sum("x").alias("total"), F.max("x").alias("high"))


_plane("floatplane_f32_sign", T.sign, "b >> 31")
_plane("floatplane_f32_exponent", T.exponent, "(b >> 23) & 255")
_plane("floatplane_f32_mantissa", T.mantissa, "b & 8388607")


@query("byteplane_f32", f"WITH {_BITS}, p AS (SELECT vec_id, unnest([0, 1, 2, 3]) AS plane, b FROM bits) SELECT vec_id, plane, CAST(sum((b >> (8 * plane)) & 255) AS BIGINT) AS total FROM p GROUP BY ALL")
def _(spark, d):
    v = T.values(T.embedding_tensors(spark, d))
    planes = v.select("vec_id", F.posexplode(F.array(*[T.byte_of(F.col("bits"), k) for k in range(4)])).alias("plane", "x"))
    return planes.groupBy("vec_id", "plane").agg(F.sum("x").alias("total"))


@query("float_plane_entropy", f"WITH {_BITS}, p AS (SELECT unnest([0, 1, 2, 3]) AS plane, b FROM bits), n AS (SELECT plane, (b >> (8 * plane)) & 255 AS x, count(*) AS n FROM p GROUP BY ALL) SELECT plane, CAST(sum(n) AS BIGINT) AS n, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM n GROUP BY plane")
def _(spark, d):
    """Bits of entropy of each byte plane, which bound what an entropy coder leaves of it."""
    v = T.values(T.embedding_tensors(spark, d))
    n = v.select(F.posexplode(F.array(*[T.byte_of(F.col("bits"), k) for k in range(4)])).alias("plane", "x")).groupBy("plane", "x").agg(F.count("*").alias("n"))
    total = F.sum("n")
    return n.groupBy("plane").agg(total.alias("n"), F.round(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, 6).alias("entropy"))


@query("largest_tensor", f"WITH {TENSORS} SELECT dtype, count(*) AS tensors, CAST(sum(byte_size) AS BIGINT) AS bytes, arg_max(name, byte_size * 1000000000 - vec_id) AS largest FROM tensors GROUP BY dtype")
def _(spark, d):
    t = T.embedding_tensors(spark, d)
    return t.groupBy("dtype").agg(F.count("*").alias("tensors"), F.sum("byte_size").alias("bytes"), F.max_by("name", F.struct("byte_size", -F.col("vec_id"))).alias("largest"))


@query("first_n_tensors", f"WITH {TENSORS} SELECT name, byte_offset FROM tensors ORDER BY byte_offset LIMIT 100")
def _(spark, d):
    return T.embedding_tensors(spark, d).select("name", "byte_offset").orderBy("byte_offset").limit(100)


# --- files: predicates, top-1, samples ---


@query("glob_match", f"WITH {FILES} SELECT path FROM files WHERE path LIKE 'en/src1%' OR string_split(path, '/')[-1] LIKE 'en/src1%'")
def _(spark, d):
    return files(spark, d).where(C.matches(F.col("path"), "en/src1*")).select("path")


_MULTI = f"{FILES}, m AS (SELECT path, CASE WHEN regexp_matches(path, '^.*/src7/.*$') THEN '*/src7/*' WHEN regexp_matches(string_split(path, '/')[-1], '^[0-9]5\\.txt$') THEN '[0-9]5.txt' END AS pattern FROM files)"


@query("glob_multi", f"WITH {_MULTI} SELECT path, pattern FROM m WHERE pattern IS NOT NULL")
def _(spark, d):
    f = files(spark, d).withColumn("pattern", C.first_match(F.col("path"), ["*/src7/*", "[0-9]5.txt"]))
    return f.where("pattern is not null").select("path", "pattern")


@query("glob_skipped_count", f"WITH {_MULTI} SELECT count(*) FILTER (WHERE pattern IS NULL) AS skipped, count(pattern) AS selected FROM m")
def _(spark, d):
    f = files(spark, d).withColumn("pattern", C.first_match(F.col("path"), ["*/src7/*", "[0-9]5.txt"]))
    return f.agg(F.count_if(F.col("pattern").isNull()).alias("skipped"), F.count("pattern").alias("selected"))


_ODD = "CASE CAST(page_id % 7 AS INTEGER) WHEN 0 THEN url WHEN 1 THEN '/' || url WHEN 2 THEN 'a/../' || page_id WHEN 3 THEN 'C:' || page_id WHEN 4 THEN 'ok/' || page_id WHEN 5 THEN '  ' ELSE 'a/b..c/' || page_id END"


@query("path_safety", f"WITH p AS (SELECT page_id, {_ODD} AS path FROM pages) SELECT page_id, NOT (trim(path) = '' OR path[1] = '/' OR path[2] = ':' OR contains(path, '//') OR list_contains(string_split(path, '/'), '..')) AS safe FROM p")
def _(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.expr(_ODD.replace("AS INTEGER", "AS INT")).alias("path"))
    return p.select("page_id", C.is_safe_path(F.col("path")).alias("safe"))


@query("safe_name", "SELECT page_id, translate(url, '/\\:', '___') AS name FROM pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", C.safe_file_name(F.col("url")).alias("name"))


@query("smallest_file", f"WITH {FILES} SELECT lang, arg_min(path, (size, path)) AS path, CAST(min(size) AS BIGINT) AS size FROM files GROUP BY lang")
def _(spark, d):
    return files(spark, d).groupBy("lang").agg(F.min_by("path", F.struct("size", "path")).alias("path"), F.min("size").alias("size"))


@query("sample_1mib", f"WITH {FILES}, s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY path, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM files) SELECT path, sha256(content[1 : least(size, 1048576 - before)]) AS sha256 FROM s WHERE before < 1048576 AND size > 0")
def _(spark, d):
    f = files(spark, d)
    at = B.running_total(f.select("path", "file_id", "size"), ["path", "file_id"], "size", "before").where("before < 1048576").select("file_id", "before")
    part = F.expr("substring(content, 1, cast(least(size, 1048576 - before) as int))")
    return f.where("size > 0").join(at, "file_id").select("path", F.sha2(part, 256).alias("sha256"))


# --- quantised types ---

_TYPES = "types(type_id, type_name, bb, be) AS (VALUES " + ", ".join(f"({i}, '{n}', {b if b else 'NULL::INTEGER'}, {e if e else 'NULL::INTEGER'})" for i, n, b, e in G.TYPES) + ")"
_GGML = f"WITH {_TYPES}, t AS (SELECT p_partkey, p_size % 35 AS type_id, [p_size, 32] AS shape FROM part), g AS (SELECT t.*, coalesce(type_name, CAST(t.type_id AS VARCHAR)) AS ggml_type, CAST(ceil(shape[1] * shape[2] / be::DOUBLE) * bb AS BIGINT) AS estimated_size FROM t LEFT JOIN types USING (type_id))"


def _ggml(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size") % 35).alias("type_id"), F.array(F.col("p_size").cast("long"), F.lit(32).cast("long")).alias("shape"))
    return G.described(p)


@query("ggml_type_name", f"{_GGML} SELECT p_partkey, ggml_type FROM g")
def _(spark, d):
    return _ggml(spark, d).select("p_partkey", "ggml_type")


@query("ggml_tensor_size", f"{_GGML} SELECT p_partkey, estimated_size FROM g")
def _(spark, d):
    return _ggml(spark, d).select("p_partkey", "estimated_size")


@query("quantization_summary", f"{_GGML} SELECT ggml_type, count(*) AS n FROM g GROUP BY 1")
def _(spark, d):
    return _ggml(spark, d).groupBy("ggml_type").agg(F.count("*").alias("n"))


@query("files_with_quantized", f"{_GGML} SELECT p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part JOIN g USING (p_partkey) WHERE ggml_type NOT IN ('F32', 'F16', 'BF16', 'F64'))")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand")
    q = _ggml(spark, d).where("is_quantised").join(p, "p_partkey").select("p_brand").distinct()
    return p.join(q, "p_brand", "left_semi").select("p_brand")


# --- classifiers over synthesised names ---

_NAMES = ("model.safetensors", "adapter_model.safetensors", "model-00001-of-00003.safetensors", "weights.gguf", "pytorch_model.bin", "optimizer.pt", "last.ckpt", "tokenizer.json", "config.json", "model.safetensors.index.json", "notes.txt", "trainer_state.json")
_NAME_SQL = "CASE CAST(doc_id % 12 AS INTEGER) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"
_NAMED = f"named AS (SELECT doc_id, 'run/checkpoint-' || (doc_id % 40) * 100 AS dir, {_NAME_SQL} AS name FROM documents)"
_FORMAT = """CASE WHEN name LIKE '%.safetensors' AND (name LIKE '%lora%' OR name LIKE '%adapter%') THEN 'lora' WHEN regexp_matches(name, '^model-[0-9]+-of-[0-9]+\\.safetensors') AND name LIKE '%.safetensors' THEN 'shard'
 WHEN name LIKE '%.safetensors' THEN 'safetensors' WHEN name LIKE '%.gguf' THEN 'gguf' WHEN name = 'pytorch_model.bin' THEN 'pytorch_bin' WHEN name LIKE '%.pt' THEN 'pt' WHEN name LIKE '%.ckpt' THEN 'ckpt' WHEN name = 'tokenizer.json' THEN 'tokenizer'
 WHEN name LIKE '%.index.json' THEN 'index' WHEN name LIKE '%config.json' THEN 'config' ELSE 'unknown' END"""


def _named(spark, d):
    n = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("run/checkpoint-"), (F.col("doc_id") % 40) * 100).alias("dir"), F.expr(_NAME_SQL.replace("AS INTEGER", "AS INT")).alias("name"))
    return n.withColumn("path", F.concat_ws("/", "dir", "name"))


@query("format_classify", f"WITH {_NAMED} SELECT doc_id, {_FORMAT} AS format FROM named")
def _(spark, d):
    return _named(spark, d).select("doc_id", C.file_format(F.col("path")).alias("format"))


@query("shard_parse", f"WITH {_NAMED} SELECT doc_id, regexp_matches(name, '^model-[0-9]+-of-[0-9]+\\.safetensors') AS is_shard, CAST(nullif(regexp_extract(name, '^model-([0-9]+)-of-([0-9]+)\\.safetensors', 1), '') AS INTEGER) AS shard, CAST(nullif(regexp_extract(name, '^model-([0-9]+)-of-([0-9]+)\\.safetensors', 2), '') AS INTEGER) AS shards FROM named")
def _(spark, d):
    return _named(spark, d).select("doc_id", C.shard_parts(F.col("name")).alias("s")).select("doc_id", "s.is_shard", "s.shard", "s.shards")


_KNOWN = ", ".join(f"'{n}'" for n in C.CHECKPOINT_FILES)
_PICKLES = ", ".join(f"'{n}'" for n in C.PICKLE_FILES)


@query("checkpoint_detect", f"WITH {_NAMED} SELECT dir, count(*) FILTER (WHERE name IN ({_KNOWN})) AS known, count(*) FILTER (WHERE name IN ({_PICKLES})) AS pickles, bool_or(name = 'trainer_state.json') AS has_trainer_state, count(*) FILTER (WHERE name IN ({_KNOWN})) > 0 AS is_checkpoint FROM named GROUP BY dir")
def _(spark, d):
    return C.checkpoint_report(_named(spark, d).select("path"), F.regexp_extract("path", "^(.*)/", 1)).drop("step")


@query("checkpoint_step", f"WITH {_NAMED} SELECT dir, max(CAST(regexp_extract(dir, 'checkpoint-([0-9]+)$', 1) AS BIGINT)) AS step FROM named GROUP BY dir")
def _(spark, d):
    return C.checkpoint_report(_named(spark, d).select("path"), F.regexp_extract("path", "^(.*)/", 1)).select("dir", "step")


@query("artifact_classify", f"WITH {_NAMED}, f AS (SELECT doc_id % 60 AS model, name, {_FORMAT} AS format FROM named), a AS (SELECT model, bool_or(format = 'lora') AS l, bool_or(name IN ({_KNOWN})) AS c, bool_or(format = 'gguf') AS g, bool_or(format IN ('safetensors', 'shard')) AS s FROM f GROUP BY model) SELECT model, CASE WHEN l THEN 'lora_adapter' WHEN c THEN 'training_checkpoint' WHEN g THEN 'gguf_model' WHEN s THEN 'huggingface_model' ELSE 'unknown' END AS artifact FROM a")
def _(spark, d):
    f = _named(spark, d).withColumn("model", F.col("doc_id") % 60).withColumn("format", C.file_format(F.col("path")))
    any_ = lambda c: F.bool_or(c)
    a = f.groupBy("model").agg(any_(F.col("format") == "lora").alias("l"), any_(F.col("name").isin(*C.CHECKPOINT_FILES)).alias("c"), any_(F.col("format") == "gguf").alias("g"), any_(F.col("format").isin("safetensors", "shard")).alias("s"))
    return a.select("model", C.artifact_type(F.col("l"), F.col("c"), F.col("g"), F.col("s")).alias("artifact"))


_LORA = "t AS (SELECT vec_id // 5 AS file_id, vec_id % 5 AS ordinal, CASE WHEN vec_id % 5 = 0 THEN 'embed.weight' WHEN vec_id % 5 < 3 THEN 'q_proj.lora_A.weight' WHEN vec_id % 2 = 0 THEN 'v_proj.lora_B.weight' ELSE 'norm.bias' END AS name, [8 + vec_id % 3, 64] AS shape FROM embeddings)"


def _lora(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id")
    name = F.expr("CASE WHEN vec_id % 5 = 0 THEN 'embed.weight' WHEN vec_id % 5 < 3 THEN 'q_proj.lora_A.weight' WHEN vec_id % 2 = 0 THEN 'v_proj.lora_B.weight' ELSE 'norm.bias' END")
    return C.lora_summary(v.select(F.expr("vec_id div 5").alias("file_id"), (F.col("vec_id") % 5).alias("ordinal"), name.alias("name"), F.array(8 + F.col("vec_id") % 3, F.lit(64).cast("long")).alias("shape")))


@query("lora_modules", f"WITH {_LORA} SELECT file_id, bool_or(regexp_matches(lower(name), 'lora_[ab]')) AS is_lora, coalesce(string_agg(DISTINCT nullif(regexp_extract(name, '^(.*)\\.lora_', 1), ''), ',' ORDER BY nullif(regexp_extract(name, '^(.*)\\.lora_', 1), '')), '') AS modules FROM t GROUP BY file_id")
def _(spark, d):
    return _lora(spark, d).select("file_id", "is_lora", "modules")


@query("lora_rank", f"WITH {_LORA} SELECT file_id, CAST(arg_min(CASE WHEN lower(name) LIKE '%lora_a%' THEN shape[1] ELSE shape[2] END, ordinal) FILTER (WHERE regexp_matches(lower(name), 'lora_[ab]')) AS BIGINT) AS rank FROM t GROUP BY file_id")
def _(spark, d):
    return _lora(spark, d).select("file_id", "rank")
