"""Best-fit packing of documents into sequences by the sum-of-squares rule.

Documents are tokenised and cut where they stand (one narrow map); only piece lengths and digests move.
Pieces are dealt round-robin into groups of bounded size, so that a group is one small task whatever the
corpus or its key skew.  Within a group, pieces go in from long to short, each where the sum of squares of
the counts of open bins per fill level becomes smallest: with N(h) open bins at level h, a piece of length s
moves a bin from h to h + s, and a full bin leaves the count.  All lengths of a group are known, so a bin is
opened only where no open one has room.

Null texts count as empty (one closing id); very long texts are tokenised in slices of whole texts and cut into pieces.  Ties are broken towards the fullest bin.  Repeated rows are
packed as often as they occur; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from blockloom.llm import tokens
from blockloom.llm.common import bounded_batches, quoted, table, tidied

MODEL = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 0
#: Pieces of a group.  Groups are dealt by documents; where these are so long that more pieces come, they are packed in several lots.
GROUP_ROWS = 20_000


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a possibly shorter first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(a, (first if first and a == 0 else capacity)) for a in starts]


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, offset of each item) for items in the given order; offsets are gapless within a bin."""
    count = np.zeros(capacity + 1, np.int64)  # count[h]: open bins at level h; full bins are not counted
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        if s < capacity:
            levels = np.flatnonzero(count[1 : capacity - s + 1]) + 1
            if len(levels):
                # Half the change of the sum of squares: N(h+s) - N(h) + 1, and less by N(h) alone for a full bin.
                change = np.where(levels + s == capacity, 0.5 - count[levels], count[np.minimum(levels + s, capacity)] - count[levels] + 1.0)
                k = len(change) - 1 - int(np.argmin(change[::-1]))
                h = int(levels[k])
                b = open_at[h].pop()
                count[h] -= 1
                bins[i], offsets[i] = b, h
                if h + s < capacity:
                    count[h + s] += 1
                    open_at[h + s].append(b)
                continue
        bins[i] = made
        if s < capacity:
            count[s] += 1
            open_at[s].append(made)
        made += 1
    return bins, offsets


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Pack the lengths from long to short by the sum-of-squares rule."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins[order], offsets[order] = sum_of_squares(lengths[order], capacity)
    return bins, offsets


def pieces(docs: DataFrame, model: str | None = None, kind: str = "byte_bpe", capacity: int = CAPACITY, id_column: str = "doc_id", column: str = "text", keep_ids: bool = False, cache_entries: int = tokens.MOST_ENTRIES) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, with keep_ids, the ids themselves."""
    bounded_batches(docs.sparkSession)
    path = model or public_tokenizers.path(MODEL)
    src = docs.select(id_column, column)
    extra = [pa.field("ids", pa.list_(pa.int32()))] if keep_ids else []
    ddl = f"{quoted(id_column)} {src.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = tokens.worker_cache(tokens.PreTokenCache, path, kind, most=cache_entries)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            items = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in tokens.slices(items):
                safe = [i for i in range(a, b) if tokens.is_safe(items[i])]
                split = {i: cache.pieces(items[i]) for i in safe}
                cache.fill(list(split.values()))
                get = cache.found.__getitem__
                rows, out, ids = [], [], []
                for i in range(a, b):
                    data = (b"".join(map(get, split.pop(i))) if i in split else cache.whole(items[i])) + end
                    for k, (start, n) in enumerate(cut_lengths(len(data) // 4, capacity)):
                        part = memoryview(data)[4 * start : 4 * (start + n)]
                        rows.append(i)
                        out.append((k, start, n, zlib.crc32(part)))
                        if keep_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                made = np.array(out, np.int64).reshape(-1, 4)
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(made[:, 0], pa.int32())] + [pa.array(made[:, j]) for j in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, extra[0].type)] if keep_ids else []), names=[id_column, "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return src.mapInArrow(tidied(cut, keeps=True), ddl)


def pack(items: DataFrame, n_items: int, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add sequence_id and offset to rows with a column ``length``; n_items (about) sets the number of groups, and no lot is larger than two."""
    groups = max(1, -(-n_items // group_rows))
    ddl = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, lot, held = TaskContext.get().partitionId() << 40, [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base, lot, held
            rows = pa.Table.from_batches(lot)
            bins, offsets = pack_lengths(rows.column("length").to_numpy(), capacity)
            rows = rows.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))
            base, lot, held = base + len(rows), [], 0
            yield from rows.to_batches(max_chunksize=10_000)

        for batch in batches:
            if held and held + batch.num_rows > 2 * group_rows:
                yield from packed()
            if batch.num_rows:
                lot.append(batch)
                held += batch.num_rows
        if held:
            yield from packed()

    return items.repartition(groups).mapInArrow(tidied(place, keeps=True), ddl)


def pack_documents(docs: DataFrame, model: str | None = None, kind: str = "byte_bpe", capacity: int = CAPACITY, id_column: str = "doc_id", column: str = "text", keep_ids: bool = False, group_rows: int = GROUP_ROWS, cache_entries: int = tokens.MOST_ENTRIES) -> DataFrame:
    """Pieces of all documents with their place; with keep_ids also the token ids to write the sequences from."""
    return pack(pieces(docs, model, kind, capacity, id_column, column, keep_ids, cache_entries), docs.count(), capacity, group_rows)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLES: dict[str, str] = {}
