"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table (arrays with open addressing) of frequent pre-tokens and their token counts, broadcast to
all workers and probed as it is; its size is bounded by ``table_size``, whatever the corpus.  Tier two encodes what the
table misses, once for each batch, and keeps it in a bounded cache of the worker.  No pre-token is ever shuffled: the only
Spark work is one narrow projection.  The table is only a cache, so the sample that it is learnt from never changes a count.

Null texts count as empty: no bytes and no tokens.  Very long texts are counted whole, one at a time.  A column of docs
that is named like the output is replaced; other columns are kept.  Repeated rows give repeated results, an empty table an
empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import tokens
from blockloom.llm.common import bounded_batches, table, text_or_empty

MODEL = "word_bpe_49k.json"
LIMIT = 2048


def frequent_lengths(docs: DataFrame, path: str, kind: str, column: str = "text", sample_rows: int = 2000, most_bytes: int = 16_384, table_size: int = 65_536) -> tokens.FrequentLengths:
    """Tier one, learnt from about ``sample_rows`` whole texts of at most ``most_bytes``, drawn over the whole table by their hash.

    The bounds hold the driver's memory; results do not depend on the sample, since misses are encoded.
    """
    total = docs.count()
    fits = docs.select(F.col(column).alias("t")).where(F.octet_length("t") <= most_bytes)
    drawn = fits.where(F.pmod(F.xxhash64("t", F.lit(11)), F.lit(1 << 20)) < int(min(1.0, sample_rows / max(1, total)) * (1 << 20)))
    # Copies share a hash: they count once.
    rows = drawn.distinct().limit(2 * sample_rows).toArrow().column(0)
    cache = tokens.LengthCache(path, kind, most=1 << 30)
    split = [cache.pieces(x) for x in rows.to_pylist() if tokens.is_safe(x)]
    common = [x for x, _ in Counter(chain.from_iterable(split)).most_common(table_size)]
    cache.fill([common])
    return tokens.FrequentLengths(common, [cache.found[x] for x in common])


def count_tokens(docs: DataFrame, model: str | None = None, kind: str = "word_bpe", column: str = "text", table_size: int = 65_536, out: str = "n_tokens") -> DataFrame:
    """All columns of docs and the count, named ``out``; ``model`` is the path of a tokenizer's file."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = model or public_tokenizers.path(MODEL)
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs, path, kind, column, table_size=table_size))

    @F.arrow_udf("long")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = tokens.worker_cache(tokens.LengthCache, path, kind, frequent.value)
        for batch in batches:
            items = [x or "" for x in batch.to_pylist()]
            counts = np.zeros(len(items), np.int64)
            for a, b in tokens.slices(items):
                safe = [i for i in range(a, b) if tokens.is_safe(items[i])]
                split = [cache.pieces(items[i]) for i in safe]
                cache.fill(split)
                get = cache.found.__getitem__
                for i, pieces in zip(safe, split, strict=True):
                    counts[i] = sum(map(get, pieces))
                for i in set(range(a, b)).difference(safe):
                    counts[i] = cache.whole(items[i])
            yield pa.array(counts)

    return docs.withColumn(out, n_tokens(F.col(column)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLES: dict[str, str] = {}
