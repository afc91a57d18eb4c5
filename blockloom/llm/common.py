"""Helpers that the corpus operators share: reading tables, batch sizes, and cutting lineage in shared storage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.session import cut, shared_dir, ship

#: Bytes of one Arrow batch sent to a Python worker; long texts would otherwise make 10,000-row batches unbounded.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by a path that only Spark needs to be able to open."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches in this session, unless they are bounded more tightly (rows alone do not bound memory), and ship the package."""
    ship(spark)
    bound_batches(spark, BATCH_BYTES)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def bound_batches(spark: SparkSession, most: int) -> None:
    """No Arrow batch of this session takes more bytes, but for single rows that do; a tighter bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))


def stash(df: DataFrame) -> DataFrame:
    """Cut the lineage of a wide result by writing it as Parquet into the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Hand memory that Arrow and the C library hold back to the system.

    Python workers live on for later tasks and stages, as the driver does, and their arrays come and go at sizes that these keep.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(results: Iterator) -> Iterator:
    """Pass results on and release memory afterwards."""
    try:
        yield from results
    finally:
        release()


#: What this worker keeps for later tasks of one operator.
KEPT: dict[tuple, object] = {}


def drop_kept() -> None:
    """Let go of what another operator's tasks left in this worker."""
    if KEPT:
        KEPT.clear()
        release()


def tidied(f, keeps: bool = False):
    """Wrap a function over batches so that its worker tidies up after each partition, and before it unless its operator ``keeps`` things."""

    def run(batches: Iterator) -> Iterator:
        if not keeps:
            drop_kept()
        return tidy(f(batches))

    return run


def texts(batch: pa.RecordBatch | pa.Array, name: str = "text") -> list[str]:
    """Texts of a batch as str, null as empty."""
    column = batch if isinstance(batch, pa.Array) else batch.column(batch.schema.get_field_index(name))
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and its offsets, without a Python object per row; null as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def quoted(name: str) -> str:
    """A column's name as SQL writes it."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder of the shared file system, whatever system that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A key with more than this share of all rows, and so many, is hot; there can be at most 1 / HOT_SHARE such keys.
HOT_SHARE, HOT_ROWS = 0.001, 1000


def join_spread(rows: DataFrame, named: DataFrame, keys: list[str], n: str, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of rows with ``named``, which has one row per key and in ``n`` how many of the ``total`` rows have it.

    Hot keys, at most 1,000 by their definition, are broadcast, so their rows stay where they are; no other key
    has more than a thousandth of the rows, so no task of the shuffled join is large.  With hot keys rows are read twice.
    """
    least = max(total * HOT_SHARE, hot_rows)
    if total <= least:
        return rows.join(named.drop(n), keys)
    hot = cut(named.where(F.col(n) > least))  # written, so that the plans below stay short
    if not hot.take(1):
        return rows.join(named.drop(n), keys)
    met = rows.join(F.broadcast(hot.drop(n)), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(named.where(F.col(n) <= least).drop(n), keys)
    return met.unionByName(rest)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def doc_hash(*columns):
    """Deterministic order and salt for rows: the hash of the given columns."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in columns])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn_if, rows: int, most_bytes: int = 200_000, id_column: str = "doc_id", column: str = "text", also: tuple[str, ...] = ()) -> pa.Table:
    """At most ``rows`` labelled rows (text, label, and columns of ``also``) for fitting, in a fixed pseudo-random order.

    The bounds hold the driver's memory: ids are drawn first, so only the drawn texts travel, and of those ``rows`` at most
    where ids repeat; texts over ``most_bytes`` are not learnt from (they are scored like all others).  An id with
    several labels counts as often.
    """
    key = F.crc32(F.col(id_column).cast("string").cast("binary"))
    drawn = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).where(learn_if(key)).select(id_column, F.col(label).cast("int").alias("label"))
    drawn = drawn.orderBy(F.xxhash64(id_column, F.lit(7)), id_column, "label").limit(rows)
    chosen = docs.select(id_column, column, *also).where((F.octet_length(column) <= most_bytes) & F.col(column).isNotNull())
    met = chosen.join(F.broadcast(drawn), id_column).select(id_column, column, "label", *also)
    got = met.orderBy(F.xxhash64(id_column, column, F.lit(7)), id_column, "label").limit(rows).toArrow()
    return got.sort_by([(id_column, "ascending"), (column, "ascending")])  # the same order on every run


def best_cut(score: np.ndarray, label: np.ndarray) -> float:
    """The middle of the range of thresholds with the highest accuracy."""
    order = np.argsort(score)
    s, y = score[order], label[order].astype(bool)
    if not len(s) or y.all() or not y.any():
        return float(np.median(s)) if len(s) else 0.0
    missed = np.concatenate([[0], np.cumsum(y)])  # positives below the cut before row i
    kept = np.concatenate([[0], np.cumsum(~y)])  # negatives below it
    gain = kept - missed
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    ends = np.concatenate([[s[0] - 1.0], s, [s[-1] + 1.0]])
    i = int(best[len(best) // 2])
    return float((ends[i] + ends[i + 1]) / 2)
