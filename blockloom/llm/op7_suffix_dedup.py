"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id.

1. Texts are dealt into buckets of bounded size and written once, compressed, as a table bucketed for the joins below,
   so whole texts are shuffled once.
2. Winnowing picks anchors: in every window of ``length`` bytes the 24-byte string with the smallest hash.  Equal
   windows pick equal anchors at equal places, so windows whose anchor occurs only once need no comparison.  Only 32
   bits per anchor travel to find the shared ones, and one bit per anchor travels back.
3. The surroundings of shared anchors (the windows that picked them) are dealt into shards by the anchor, so equal
   windows meet in one shard.  Equal surroundings become one text with the smallest id.  Parts of a shard of
   bounded size get a suffix array each, by Larsson-Sadakane refinement in numpy; Kasai's common prefixes cut it into
   classes of equal windows; the parts' sorted classes are merged by binary search.
4. A mask of covered windows per surrounding travels back to the buckets, where bytes are removed and digested.

No step grows faster than the input: copies add their own anchors and masks only, and no pairs are made.
Null and short texts lose nothing.  Rows whose id is null or no integer count as larger than all ids; rows of one id never remove from each
other.  Repeated rows give repeated results, an empty table an empty result; extra columns are kept by ``remove_repeats``,
whatever their names, but for those that are named like the digests that are asked for.  A cut inside a character leaves
bytes that are no text: they count in the digests and are dropped from the returned text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from blockloom.llm.common import bounded_batches, drop_kept, quoted, release, remove, shared_dir, stash, table, text_or_empty, tidied, utf8

LENGTH = 50
DIGESTS = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
GRAM = 24
BUCKET_BYTES = 8 << 20
#: Text bytes whose anchors make one target, and whose shared surroundings make one shard.
TARGET_BYTES, SHARD_BYTES = 32 << 20, 4 << 20
#: Bytes that get one suffix array.
PART_BYTES = 4 << 20
#: Documents are winnowed in groups of about so many bytes.
CHUNK_BYTES = 256 << 10
_LATE = np.iinfo(np.int64).max


# --- suffix arrays ----------------------------------------------------------------------------------------


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number, zero beyond the end."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    for step, shift in ((1, 8), (2, 16), (4, 32)):
        x[:-step] = (x[:-step] << np.uint64(shift)) | x[step:]
    return x[: len(data)]


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of (at least) their first ``depth`` bytes.

    Larsson-Sadakane: sorted by the first h bytes, a group is refined by the ranks h further on, and h doubles;
    groups of one suffix are finished and never touched again.
    """
    n = len(data)
    key = words8(data)
    sa = np.argsort(key).astype(np.int32)
    sorted_key = key[sa]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    del key, sorted_key
    place = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, place, 0))
    h = 8
    loose = place[~(new & np.concatenate([new[1:], [True]]))]  # places in groups of two or more
    del place
    while h < depth and len(loose):
        sub = sa[loose]
        ahead = sub + h
        mixed = rank[sub].astype(np.int64)
        mixed *= n + depth
        # Of suffixes that end within h bytes and tie with zero bytes, the shorter comes first.
        mixed += np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + depth, np.maximum(0, n + depth - 1 - ahead))
        del ahead
        order = np.argsort(mixed)
        sub = sub[order]
        mixed = mixed[order]
        del order
        sa[loose] = sub
        new = np.concatenate([[True], mixed[1:] != mixed[:-1]])
        del mixed
        rank[sub] = loose[np.maximum.accumulate(np.where(new, np.arange(len(loose), dtype=np.int32), 0))]
        loose = loose[~(new & np.concatenate([new[1:], [True]]))]
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int, lanes: int = 1 << 15) -> np.ndarray:
    """Kasai: the common prefix of each suffix and the one before it in the array, up to ``most``.

    Going through the text, a prefix shrinks by at most one per step (``sa`` must be in order beyond ``most`` bytes); the
    text is walked in many lanes at once.
    """
    n = len(data)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.empty(n, np.int32)
    before[sa[0]], before[sa[1:]] = -1, sa[:-1]
    key, plcp = words8(data), np.zeros(n, np.int32)
    lanes = min(lanes, n)
    per = -(-n // lanes)
    base = np.arange(0, n, per)
    h = np.zeros(len(base), np.int64)
    for t in range(per):
        live = base + t < n
        # A prefix at the bound may hide a tie that the array left open: start afresh there.
        base, h = base[live], np.where(h[live] >= most, 0, np.maximum(h[live] - 1, 0))
        p = base + t
        q = before[p]
        h[q < 0] = 0
        room = np.minimum(most, n - np.maximum(p, q))
        going = np.flatnonzero((q >= 0) & (h < room))
        while len(going):
            a, b = p[going] + h[going], q[going] + h[going]
            diff = key[a] ^ key[b]
            same = np.full(len(going), 8, np.int64)
            some = diff != 0
            # Leading zero bytes of the difference.
            same[some] = 7 - (np.frexp(diff[some].astype(np.float64))[1] - 1) // 8
            # Rounding to float64 may carry into the next byte: look at that byte itself.
            fix = np.flatnonzero(some)
            over = data[np.minimum(a[fix] + same[fix], n - 1)] == data[np.minimum(b[fix] + same[fix], n - 1)]
            same[fix[over]] += 1
            h[going] = np.minimum(h[going] + same, room[going])
            going = going[(same >= 8) & (h[going] < room[going])]
        plcp[p] = h
    return plcp[sa]


def window_classes(data: np.ndarray, valid: np.ndarray, owner: np.ndarray, length: int, with_strings: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that start where ``valid``: (class of each, sorted distinct windows, smallest owner of each class)."""
    sa = suffix_array(data, length)
    lcp = common_prefixes(data, sa, length)
    group = np.cumsum(lcp < length, dtype=np.int32) - 1
    ok = valid[sa]
    at, group = sa[ok], group[ok]
    new = np.concatenate([[True], group[1:] != group[:-1]])
    heads = np.flatnonzero(new)
    number = np.cumsum(new, dtype=np.int32) - 1
    least = np.minimum.reduceat(owner[at], heads)
    # Rows of a view: an index of a number for each byte would take 8 times the strings.
    strings = np.lib.stride_tricks.sliding_window_view(data, length)[at[heads]].view(f"S{length}").ravel() if with_strings else np.zeros(0, f"S{length}")
    of = np.empty(len(data), np.int32)
    of[at] = number
    return of[valid], strings, least


def merge_classes(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The smallest owner over all parts for each part's windows; parts' sorted strings are found in each other by binary search."""
    least = [p[2].copy() for p in parts]
    for i, (_, mine, _) in enumerate(parts):
        for j in range(i):
            theirs = parts[j][1]
            at = np.searchsorted(theirs, mine)
            hit = np.flatnonzero(at < len(theirs))
            hit = hit[theirs[at[hit]] == mine[hit]]
            both = np.minimum(least[i][hit], least[j][at[hit]])
            least[i][hit] = both
            least[j][at[hit]] = both
    for i, (_, mine, _) in enumerate(parts):  # what a later part brought must reach the earlier ones
        for j in range(i + 1, len(parts)):
            theirs = parts[j][1]
            at = np.searchsorted(theirs, mine)
            hit = np.flatnonzero(at < len(theirs))
            hit = hit[theirs[at[hit]] == mine[hit]]
            least[i][hit] = np.minimum(least[i][hit], least[j][at[hit]])
    return [low[p[0]] for low, p in zip(least, parts, strict=True)]


def smallest_owners(contexts: list[bytes], owners: np.ndarray, length: int, part_bytes: int) -> np.ndarray:
    """For every window of every context, in order, the smallest owner of an equal window in any context."""
    parts, start, size = [], 0, 0
    bounds = []
    for i, c in enumerate(contexts):
        if size and size + len(c) > part_bytes:
            bounds.append((start, i))
            start, size = i, 0
        size += len(c)
    bounds.append((start, len(contexts)))
    for a, b in bounds:
        lengths = np.array([len(c) for c in contexts[a:b]])
        data = np.frombuffer(b"".join(contexts[a:b]), np.uint8)
        valid = np.arange(len(data)) + length <= np.repeat(np.cumsum(lengths), lengths)
        parts.append(window_classes(data, valid, np.repeat(owners[a:b], lengths), length, len(bounds) > 1))
    return np.concatenate(merge_classes(parts))


# --- winnowing --------------------------------------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of all anchors of a bucket of texts, in the order of the texts."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    i = 0
    while i < len(offsets) - 1:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1
        j = max(j, i + 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        for a in range(lo, hi, 4 * CHUNK_BYTES):  # a text longer than the chunk goes in overlapping pieces
            b = min(hi, a + 4 * CHUNK_BYTES + length - 1)
            out.append(_winnow(data[a:b], offsets[i : j + 1] - a, a, length))
        i = j
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _winnow(data: np.ndarray, offsets: np.ndarray, base: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, span = len(data), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = words8(data)
    m = n - GRAM + 1
    h = w[:m] * np.uint64(0x9E3779B97F4A7C15)
    h ^= w[8 : 8 + m] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h += w[16 : 16 + m] * np.uint64(0x165667B19E3779F9)
    h = _mix(h)
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    m, width = key, 1
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if span > width:
        m = np.minimum(m[: -(span - width)], m[span - width :])
    valid = np.ones(n - length + 1, bool)
    for e in offsets[1:]:
        valid[max(0, e - length + 1) : max(0, e)] = False
    s = np.flatnonzero(valid)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    pick = (m[s] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (s[1:] != s[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(s)]]) - 1
    return h[pick[new]], s[new] + base, s[last] + base


# --- the buckets ------------------------------------------------------------------------------------------

_ZSTD = 3


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets, ids = np.frombuffer(row["offsets"], np.int64), np.frombuffer(row["ids"], np.int64)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    return data, offsets, ids


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _targets(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", column: str = "text", length: int = LENGTH, keep_text: bool = True, with_digests: bool = True, part_bytes: int = PART_BYTES, bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All columns of docs, the text without its repeats (with keep_text), and with_digests n_bytes, n_removed, n_spans, kept_sha256."""
    if length < GRAM + 8:
        raise ValueError(f"windows of fewer than {GRAM + 8} bytes are not supported")
    spark = docs.sparkSession
    bounded_batches(spark)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-total // bucket_bytes))
    targets = max(1, min(buckets, -(-total // TARGET_BYTES)))
    shards = max(1, -(-total // shard_bytes))
    taken = set(DIGESTS) if with_digests else set()
    kept_columns = [c for c in docs.columns if c.lower() not in taken and (keep_text or c == id_column)]
    fields = docs.select(*[F.col(quoted(c)) for c in kept_columns]).schema

    def pack(t: pa.Table) -> pa.Table:
        drop_kept()
        t = t.combine_chunks()
        ids = t.column("order").to_numpy()
        text = t.column("text")
        data, offsets = utf8(text.chunk(0) if isinstance(text, pa.ChunkedArray) and text.num_chunks == 1 else pa.concat_arrays(text.chunks))
        sink = pa.BufferOutputStream()
        rest = t.drop_columns(["bucket", "order", "text"])
        with pa.ipc.new_stream(sink, rest.schema) as w:
            w.write_table(rest)
        put = zstandard.ZstdCompressor(_ZSTD).compress
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "offsets": pa.array([offsets.tobytes()], pa.binary()), "data": pa.array([put(data.tobytes())], pa.binary()), "rest": pa.array([put(sink.getvalue().to_pybytes())], pa.binary())})

    # Buckets by id, text and input partition: neither an id nor a text that many rows share makes one large, and a
    # recomputed task deals its rows alike, in whatever order it meets them.
    dealt = docs.select(
        *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept_columns) if c != column],
        F.pmod(F.xxhash64(id_column, column, F.spark_partition_id()), F.lit(buckets)).cast("int").alias("bucket"),
        F.coalesce(F.col(id_column).try_cast("long"), F.lit(_LATE)).alias("order"),
        F.encode(text_or_empty(column), "UTF-8").alias("text"),
    )
    name = f"blockloom_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    packed = dealt.groupBy("bucket").applyInArrow(pack, "bucket int, ids binary, offsets binary, data binary, rest binary")
    packed.write.bucketBy(int(min(buckets, 4096)), "bucket").option("compression", "none").option("path", path).saveAsTable(name)
    texts = spark.table(name)
    try:
        return _removed(texts, fields, targets, shards, length, part_bytes, column, with_digests)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def _removed(texts: DataFrame, fields, targets: int, shards: int, length: int, part_bytes: int, column: str, with_digests: bool) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, offsets, _ = _unpack(row)
            h, _, _ = anchors(data, offsets, length)
            to = _targets(h, targets)
            order = np.argsort(to, kind="stable")
            bounds = np.searchsorted(to[order], np.arange(targets + 1))
            short = (h & np.uint64(0xFFFFFFFF)).astype("<u4")[order]
            used = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), row["bucket"], np.int32)), pa.array(used.astype(np.int32)), pa.array([short[bounds[k] : bounds[k + 1]].tobytes() for k in used], pa.binary())], names=["bucket", "target", "hashes"])

    def shared(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u4") for x in t.column("hashes").to_pylist()]
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        s = every[order]
        again = np.zeros(len(s), bool)
        again[1:] = s[1:] == s[:-1]
        again[:-1] |= again[1:].copy()
        flag = np.empty(len(s), bool)
        flag[order] = again
        cuts = np.cumsum([len(x) for x in parts])[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(flag, cuts)]
        del every, order, s, again, flag
        release()
        return pa.table({"bucket": t.column("bucket"), "target": t.column("target"), "bits": pa.array(bits, pa.binary())})

    sent = texts.select("bucket", "ids", "offsets", "data").mapInArrow(tidied(send), "bucket int, target int, hashes binary")
    flags = sent.groupBy("target").applyInArrow(shared, "bucket int, target int, bits binary")
    flags = flags.groupBy("bucket").agg(F.collect_list(F.struct("target", "bits")).alias("flags"))  # one bit per anchor of the bucket

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put = zstandard.ZstdCompressor(1).compress
        for row in _rows(batches):
            data, offsets, ids = _unpack(row)
            h, first, last = anchors(data, offsets, length)
            to = _targets(h, targets)
            order = np.argsort(to, kind="stable")
            bounds = np.searchsorted(to[order], np.arange(targets + 1))
            flag = np.zeros(len(h), bool)
            for f in row["flags"]:
                a, b = bounds[f["target"]], bounds[f["target"] + 1]
                flag[order[a:b]] = np.unpackbits(np.frombuffer(f["bits"], np.uint8), count=b - a).astype(bool)
            pick = np.flatnonzero(flag)
            shard = (_mix(h[pick]) % np.uint64(shards)).astype(np.int64)
            order = pick[np.argsort(shard, kind="stable")]
            shard = np.sort(shard)
            doc = np.searchsorted(offsets, first[order], side="right") - 1
            owner, start, size = ids[doc], first[order], (last[order] - first[order] + length).astype(np.uint8)
            heads = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
            ends = np.concatenate([heads[1:], [len(shard)]])[: len(heads)]
            raw = data.tobytes()
            out = []
            for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
                body = b"".join([raw[p : p + n] for p, n in zip(start[a:b].tolist(), size[a:b].tolist(), strict=True)])
                out.append((row["bucket"], int(shard[a]), put(start[a:b].astype("<u4").tobytes()), put(owner[a:b].astype("<i8").tobytes()), size[a:b].tobytes(), put(body)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "shard", "starts", "owners", "sizes", "body"])

    around = texts.select("bucket", "ids", "offsets", "data").join(flags, "bucket").mapInArrow(tidied(surround), "bucket int, shard int, starts binary, owners binary, sizes binary, body binary")

    def compare(t: pa.Table) -> pa.Table:
        get = zstandard.ZstdDecompressor().decompress
        number: dict[bytes, int] = {}
        which, owners, sizes, counts = [], [], [], []
        for body, owner, size in zip(t.column("body").to_pylist(), t.column("owners").to_pylist(), t.column("sizes").to_pylist(), strict=True):
            text, n = get(body), np.frombuffer(size, np.uint8)
            ends = np.cumsum(n, dtype=np.int64).tolist()
            at = 0
            for e in ends:
                which.append(number.setdefault(text[at:e], len(number)))
                at = e
            owners.append(np.frombuffer(get(owner), "<i8"))
            sizes.append(n)
            counts.append(len(n))
        which, owner, size = np.array(which), np.concatenate(owners), np.concatenate(sizes).astype(np.int64)
        contexts = list(number)
        least = np.full(len(contexts), _LATE)
        np.minimum.at(least, which, owner)
        low = smallest_owners(contexts, least, length, part_bytes)
        per = np.array([len(c) for c in contexts]) - length + 1
        begin = np.cumsum(per) - per
        windows = size - length + 1
        mask = np.zeros(len(which), np.uint64)
        for k in range(int(windows.max(initial=0))):
            has = np.flatnonzero(windows > k)
            hit = low[begin[which[has]] + k] < owner[has]
            mask[has[hit]] |= np.uint64(1 << k)
        out_bucket, out_start, out_mask, at = [], [], [], 0
        put = zstandard.ZstdCompressor(1).compress
        for bucket, starts, n in zip(t.column("bucket").to_pylist(), t.column("starts").to_pylist(), counts, strict=True):
            m = mask[at : at + n]
            hit = m != 0
            at += n
            if hit.any():
                out_bucket.append(bucket)
                out_start.append(put(np.frombuffer(get(starts), "<u4")[hit].tobytes()))
                out_mask.append(put(m[hit].tobytes()))
        release()
        return pa.table({"bucket": pa.array(out_bucket, pa.int32()), "starts": pa.array(out_start, pa.binary()), "masks": pa.array(out_mask, pa.binary())})

    masks = around.groupBy("shard").applyInArrow(compare, "bucket int, starts binary, masks binary")
    masks = masks.groupBy("bucket").agg(F.collect_list(F.struct("starts", "masks")).alias("masks"))

    keep_text = column in fields.names

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = zstandard.ZstdDecompressor().decompress
        for row in _rows(batches):
            data, offsets, ids = _unpack(row)
            edge = np.zeros(len(data) + 1, np.int32)
            got = row["masks"] or ()
            if got:
                starts = np.concatenate([np.frombuffer(get(m["starts"]), "<u4") for m in got]).astype(np.int64)
                bits = np.concatenate([np.frombuffer(get(m["masks"]), np.uint64) for m in got])
                for k in range(length - GRAM + 1):
                    s = starts[(bits >> np.uint64(k)) & np.uint64(1) == 1] + k
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + length, -1)
            gone = np.cumsum(edge, out=edge)[:-1] > 0
            del edge
            n = np.diff(offsets)
            removed, spans, digest, kept = [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                g = gone[a:b]
                left = data[a:b][~g].tobytes() if g.any() else data[a:b].tobytes()
                removed.append(b - a - len(left))
                spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if len(g) else 0)
                digest.append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    kept.append(left.decode("utf-8", "ignore"))  # a cut inside a character drops its remains
            rest = pa.ipc.open_stream(get(row["rest"])).read_all().combine_chunks()
            columns = {f"c{i}": pa.array(kept, pa.string()) if f.name == column else rest.column(f"c{i}") for i, f in enumerate(fields)}
            if with_digests:
                columns |= {"n_bytes": pa.array(n), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            yield from pa.table(columns).to_batches(max_chunksize=2000)

    inner = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    outer = [f.name for f in fields]
    for name, kind in DIGESTS.items() if with_digests else ():
        inner, outer = inner.add(name, kind), [*outer, name]
    return stash(texts.join(masks, "bucket", "left").mapInArrow(tidied(finish), inner)).toDF(*outer)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op7_suffix_array_dedup": op7_suffix_array_dedup}
ORACLES: dict[str, str] = {}
