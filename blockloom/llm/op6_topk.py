"""Exact top-k search by tiled matrix products.

Vectors are quantised with built-in functions, then packed: candidate rows into shards and queries into
blocks, both of bounded size, dealt by a hash of id, vector and input partition (so no id or repeated vector makes a shard
large), in 16-bit numbers where these hold them.  Each (query block, shard) pair is one tile and one key of the join that
brings both together: matrix products over strips of queries, a partial selection of k per query, and at most k rows per
query out.  The per-query lists then merge as a tree, over groups of FAN_IN lists on each level.
Every stage is a shuffle on a key whose groups are bounded, and nothing is broadcast.  What travels is every shard once per
query block and every block once per shard, so blocks and shards are as large as a task's memory allows.

Ties go to the smaller vec_id.  Candidates are all rows with another id than the query's; a repeated row is
a candidate of its own, and a query id that occurs in several rows is searched once for each distinct vector and
merged.  Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without id;
only vectors of one dimension are compared with each other.  Empty tables give an empty result.
Products are exact: float64 up to 2**53, Python integers beyond, held to the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.llm.common import bounded_batches, table

K = 5
EVERY = 50
SHARD_ROWS = 16_384
BLOCK_ROWS = 4096
#: Queries whose scores against a shard are held at once.
STRIP_ROWS = 256
FAN_IN = 32


def quantise(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v array<double> of whole numbers, dim) of the vectors that take part."""
    x = F.transform(F.col(column), lambda e: F.floor(e.cast("double") * scale).cast("double"))
    fine = F.forall(F.col(column), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    v = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column)).where(F.col("id").isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(fine, F.lit(False)))
    # floor() of a double is a long and saturates; the double route keeps large components whole.
    return v.select("id", x.alias("v"), F.size(column).alias("dim"))


def _packed(rows: DataFrame, parts: int, name: str) -> DataFrame:
    """Rows of one part and dimension as one row: ids and the matrix, both as bytes."""

    def build(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy().astype("<i8")
        m = t.column("v").combine_chunks()
        flat = np.asarray(m.flatten(), "<f8")
        if len(flat) and -(2**15) <= flat.min() and flat.max() < 2**15:
            flat = flat.astype("<i2")
        return pa.table({name: t.column("part").slice(0, 1), "dim": t.column("dim").slice(0, 1), f"{name}_ids": pa.array([ids.tobytes()], pa.binary()), f"{name}_m": pa.array([flat.tobytes()], pa.binary())})

    part = F.pmod(F.xxhash64("id", F.col("v"), F.spark_partition_id()), F.lit(parts)).cast("int")
    return rows.withColumn("part", part).groupBy("part", "dim").applyInArrow(build, f"{name} int, dim int, {name}_ids binary, {name}_m binary")


def _product(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    bound = (np.abs(q).max(initial=0) * np.abs(m).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q @ m.T).astype(np.int64)
    qi = np.array([[int(x) for x in row] for row in q], object)
    mi = np.array([[int(x) for x in row] for row in m], object)
    big = qi.dot(mi.T)
    top = 2**63 - 1
    return np.array([[max(-top - 1, min(top, x)) for x in row] for row in big], np.int64).reshape(len(q), len(m))


def _matrix(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == 2 * rows * dim else "<f8").reshape(rows, dim).astype(np.float64)


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                all_qid, mid = np.frombuffer(row["block_ids"], "<i8"), np.frombuffer(row["shard_ids"], "<i8")
                all_q, m = (_matrix(row[c + "_m"], len(row[c + "_ids"]) // 8, row["dim"]) for c in ("block", "shard"))
                order = np.argsort(mid, kind="stable")  # then ties go to the smaller id by position
                mid, m = mid[order], m[order]
                keep = min(k, len(mid))
                for a in range(0, len(all_qid), STRIP_ROWS):
                    qid = all_qid[a : a + STRIP_ROWS]
                    score = _product(all_q[a : a + STRIP_ROWS], m)
                    own = qid[:, None] == mid[None, :]
                    score[own] = np.iinfo(np.int64).min
                    # The k-th best score of each query by partial selection; all that reach it are sorted, ties by position.
                    edge = np.partition(score, len(mid) - keep, axis=1)[:, len(mid) - keep]
                    r, c = np.nonzero((score >= edge[:, None]) & ~own)
                    s = score[r, c]
                    o = np.lexsort((c, -s, r))
                    r, c, s = r[o], c[o], s[o]
                    first = np.searchsorted(r, np.arange(len(qid)))
                    kept = np.arange(len(r)) - first[r] < k
                    r, c, s = r[kept], c[kept], s[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(mid[c]), pa.array(s), pa.array(np.full(len(r), row["shard"], np.int32))], names=["query_id", "vec_id", "score", "shard"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of quantised queries against quantised candidates."""
    bounded_batches(queries.sparkSession)
    shards = max(1, -(-candidates.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    left = _packed(queries.distinct(), blocks, "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = _packed(candidates, shards, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = right.join(left.hint("shuffle_hash"), ["block", "shard", "dim"])
    lists = tiles.select("dim", "shard", "block_ids", "block_m", "shard_ids", "shard_m").mapInArrow(_tiles(k), "query_id long, vec_id long, score long, shard int")

    def best(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    level, left_over = lists.withColumnRenamed("shard", "group"), shards
    while left_over > FAN_IN:
        level = best(level.withColumn("group", F.floor(F.col("group") / FAN_IN)), "group").drop("rank")
        left_over = -(-left_over // FAN_IN)
    return best(level).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantise(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(v.where(F.col("id") % EVERY == 0), v)


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
QUERIES = {"op6_exact_topk": op6_exact_topk}
ORACLES = {"op6_exact_topk": ORACLE}
