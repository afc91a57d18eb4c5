"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints are computed where the documents stand; only distinct fingerprints are searched, so copies never
make pairs.  Two fingerprints with at most three differing bits must meet: the 64 bits are split into three blocks, and
erasing the block that holds one of the differing bits leaves at most two, which a ball of radius one (half the
radius) around each side bridges.  Every fingerprint therefore emits, per erased block, itself and all its
one-bit variants; the shuffle is on the variants.  Within a variant's group colliding fingerprints are
verified on all 64 bits and reported as the stars that connect them, never as all pairs.

A variant with more than ``dense_from`` fingerprints goes to an exact second round: full balls of radius one and two
without erasure, in which every member of a bucket is provably linked to any member within radius one, so the
bucket (at most 2,081 fingerprints) is reported as one star.  Nothing is capped and nothing is collected.

Null and empty texts have fingerprint zero, linked like any other.  Repeated rows share a fingerprint, hence a
component; a component's id is its smallest doc_id (null if all are null).  An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.llm.common import bounded_batches, cut, fresh, join_spread, quoted, stash, table, text_or_empty, tidied
from blockloom.llm.components import HOT_EDGES, connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Bits of the three erased blocks.
BLOCKS = ((0, 21), (21, 42), (42, 64))
DENSE_FROM = 2000


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of all word shingles of the text with A-Z lower-cased; fewer words than the size make one shingle."""
    words = text.lower().split()  # bytes: only A-Z, and only blanks 0x20 and 0x09-0x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1]).tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit the majority of the hashes: 1 where over half of them have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)].astype("<u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", column: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp long) of every row."""
    bounded_batches(docs.sparkSession)
    src = docs.select(id_column, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(shingle_hashes((x or "").encode("utf-8", "surrogatepass"), size)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], names=[id_column, "fp"])

    return src.mapInArrow(tidied(run), f"{quoted(id_column)} {src.schema[0].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variant_masks() -> list[tuple[int, int]]:
    """(kept bits, flipped bits) of every variant; an erased block holds its own number instead."""
    made = []
    for number, (a, b) in enumerate(BLOCKS, 1):
        kept = ((1 << 64) - 1) & ~(((1 << b) - 1) ^ ((1 << a) - 1))
        for flip in [0] + [1 << i for i in range(64) if not a <= i < b]:
            made.append((_signed(kept), _signed(flip | number << a)))
    return made


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; unsigned, for numpy counts the bits of a signed number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _stars(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges from each connected group of these fingerprints' smallest member to the others."""
    m = len(fps)
    label = np.arange(m)
    near = np.zeros((m, m), bool)
    for i in range(0, m, 256):
        near[i : i + 256] = distance(fps[i : i + 256, None], fps[None, :]) <= radius
    while True:
        low = np.where(near, label[None, :], m).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    other = np.flatnonzero(label != np.arange(m))
    return list(zip(fps[other].tolist(), fps[label[other]].tolist(), strict=True))


def _collide(radius: int, dense_from: int, rows: int = 1 << 19):
    """Verify the groups of a partition that is sorted by key, a bounded number of rows at a time."""

    def runs(keys: np.ndarray, fps: np.ndarray) -> list[np.ndarray]:
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([start, [len(keys)]]))
        pairs = start[size == 2]
        a, b = fps[pairs], fps[pairs + 1]
        linked = distance(a, b) <= radius
        out = [np.stack([a[linked], b[linked], np.zeros(linked.sum(), np.int64)], axis=1)]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            members = np.unique(fps[s : s + n])
            if len(members) > dense_from:
                out.append(np.stack([members, members, np.ones(len(members), np.int64)], axis=1))
            elif stars := _stars(members, radius):
                out.append(np.array([(u, v, 0) for u, v in stars], np.int64))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, wait = 0, rows

        def flush(last: bool):
            nonlocal held, n, wait
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(keys) if last else int(np.searchsorted(keys, keys[-1]))  # the last run may go on
            held, n = [(keys[end:], fps[end:])], len(keys) - end
            wait = n + rows
            if end:
                edges = np.unique(np.concatenate(runs(keys[:end], fps[:end])), axis=0)
                if len(edges):
                    yield pa.RecordBatch.from_arrays([pa.array(edges[:, i]) for i in range(3)], names=["u", "v", "dense"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                n += batch.num_rows
            if n >= wait:
                yield from flush(False)
        if n:
            yield from flush(True)

    return run


def _dense_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links among fingerprints by full balls: in a bucket, whoever is within one bit of the centre is within three of all."""
    flips = [(0, 0)] + [(_signed(1 << i), 1) for i in range(64)] + [(_signed((1 << i) | (1 << j)), 2) for i in range(64) for j in range(i)]
    spark = fps.sparkSession
    balls = F.broadcast(spark.createDataFrame(flips, "flip long, d int"))  # 2,081 rows, whatever the data
    odd = F.bit_count("u") % 2
    # Odd distances join unlike parities: the even side's radius two meets the odd side's radius one.  Even ones meet at one.
    reach = (F.col("d") < 2) | (odd == 0) if radius == 3 else F.col("d") < 2
    emitted = fps.join(balls, reach).select(F.col("u").bitwiseXOR(F.col("flip")).alias("key"), "u", "d")
    w = Window.partitionBy("key")
    # At radius one only the centre itself is near all; at two all of a ball of one are near each other.
    return emitted.withColumn("v", F.min(F.when(F.col("d") < (1 if radius == 1 else 2), F.col("u"))).over(w)).where("v is not null and v <> u").select("u", "v").distinct()


def links(fps: DataFrame, radius: int = RADIUS, dense_from: int = DENSE_FROM) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints (column fp) within the radius of each other."""
    if not 0 <= radius <= 3:
        raise ValueError("ball hashing with one erased block covers a radius of at most three")
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x")) for k, x in variant_masks()])
    keys = F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m["k"]).bitwiseXOR(m["x"])))
    emitted = fps.select(keys.alias("key"), "fp")
    dealt = emitted.repartition("key").sortWithinPartitions("key")
    found = cut(dealt.mapInArrow(tidied(_collide(radius, dense_from)), "u long, v long, dense long").distinct())
    near = found.where("dense = 0").select("u", "v")
    dense = found.where("dense = 1").select("u").distinct()
    if radius and dense.take(1):  # distinct fingerprints have no links at radius zero
        near = near.unionByName(_dense_links(dense, radius))
    return near


def components(docs: DataFrame, id_column: str = "doc_id", column: str = "text", size: int = SHINGLE, radius: int = RADIUS, dense_from: int = DENSE_FROM) -> DataFrame:
    """(id, fp, component_id): rows whose fingerprints link, directly or through others, share the smallest id."""
    marked = stash(fingerprints(docs, id_column, column, size))
    groups = cut(marked.groupBy("fp").agg(F.min(id_column).alias("first"), F.count("*").alias("n")))
    roots = connected_components(links(groups.select("fp"), radius, dense_from))
    linked = roots.join(groups, roots.node == groups.fp).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(least, "root").select("fp", "component_id")
    named = groups.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))
    return join_spread(marked, cut(named), ["fp"], "n", marked.count()).select(id_column, "fp", "component_id")


# --- near copies by similarity ----------------------------------------------------------------------------

#: MinHash bands: texts that agree in all rows of a band are candidates.  Of pairs at similarity s, (1 - s**6)**32 share none:
#: one in 17,000 at 0.8, one in 4 million at 0.85, wherever the texts differ.
NEAR_BANDS, NEAR_ROWS = 32, 6
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: Groups of up to so many nodes are compared as rows of pairs, larger ones in blocks of so many nodes or bytes of shingles.
PAIRED, BLOCK_NODES, BLOCK_BYTES = 16, 256, 8 << 20
#: Rows of two longs that may be broadcast (some 60 bytes each in a hash table, so 60 MB); beyond it the joins shuffle.
BROADCAST_ROWS = 1_000_000


def _multipliers() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, (NEAR_BANDS * NEAR_ROWS, 1), np.uint64) | np.uint64(1)


def near_bands(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    """NEAR_BANDS keys, each of the NEAR_ROWS smallest of the shingles' hashes, multiplied; all texts without words agree."""
    low = np.full(len(by), 2**64 - 1, np.uint64)
    for at in range(0, len(h), 512):
        low = np.minimum(low, (h[None, at : at + 512] * by).min(axis=1))
    key = np.arange(1, NEAR_BANDS + 1, dtype=np.uint64)
    for row in low.reshape(NEAR_BANDS, NEAR_ROWS).T:
        key = (key ^ row) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    return np.unique(shingle_hashes(text, size))


def text_node(column: str):
    """A text's node: the 64-bit hash of the whole text, null as empty."""
    return F.xxhash64(text_or_empty(column))


def _sketches(docs: DataFrame, id_column: str, column: str, size: int) -> DataFrame:
    """(id, node, fp: the fingerprint of this operator, size: how many distinct shingles, bands)."""
    src = docs.select(id_column, column, text_node(column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _multipliers()
        for batch in batches:
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            fps = np.array([fingerprint(shingle_hashes(x)) for x in raw], np.uint64).view(np.int64)
            sets = [shingle_set(x, size) for x in raw]
            bands = pa.array([near_bands(h, by) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps), pa.array([len(h) for h in sets], pa.int64()), bands], names=["id", "node", "fp", "size", "bands"])

    named = src.mapInArrow(tidied(run), f"id {src.schema[0].dataType.simpleString()}, node long, fp long, size long, bands array<long>")
    return named.withColumnRenamed("id", id_column)


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_links(sets: list[np.ndarray], block: np.ndarray, root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (positions) that connect whatever is similar across roots: all pairs of two blocks, or of the only one."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    width = 1 << int(np.clip(4 * size.max(), 1024, 1 << 16) - 1).bit_length()
    # Parities of shingles per slot: where they differ, so do the sets, hence at most as many slots as shingles differ.
    odd = np.zeros((m, width // 64), np.uint64)
    for i, x in enumerate(sets):
        odd[i] = np.packbits(np.bincount((x & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1).view(np.uint64)
    label = np.unique(root, return_inverse=True)[1]
    both_blocks = block.min() != block.max()
    out = []
    for i in range(m):
        other = np.flatnonzero((label[i + 1 :] != label[i]) & ((block[i + 1 :] != block[i]) | (not both_blocks))) + i + 1
        other = other[np.minimum(size[other], size[i]) >= np.maximum(size[other], size[i]) * similarity]
        if not len(other):
            continue
        apart = np.bitwise_count(odd[other] ^ odd[i]).sum(axis=1, dtype=np.int64)
        near = apart <= (size[other] + size[i]) * (1 - similarity) / (1 + similarity) + 1e-6
        for j in other[near][np.argsort(apart[near], kind="stable")].tolist():
            if label[j] != label[i]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (size[i] + size[j] - both):
                    out.append((i, j))
                    label[label == label[j]] = label[i]
    return out


def _link_blocks(similarity: float):
    """Links of each job of a partition that is sorted by job; (key, lo, hi, block, node, root, shingles) in."""

    def made(job: list[tuple]) -> pa.RecordBatch:
        node = [x[1] for x in job]
        found = _block_links([np.frombuffer(x[3], np.uint64) for x in job], np.array([x[0] for x in job]), np.array([x[2] for x in job], np.int64), similarity)
        ends = [[max(node[i], node[j]) for i, j in found], [min(node[i], node[j]) for i, j in found]]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, job = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != at:
                    if job:
                        yield made(job)
                    at, job = row[:3], []
                job.append(row[3:])
        if job:
            yield made(job)

    return run


def _apart(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges (u, v) whose ends do not share a root; nodes without one are their own.

    Roots reach the edges by sorting both together by node: an end of many edges needs no row of a join for each.
    """
    out = edges
    for end in ("u", "v"):
        named = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        both = out.unionByName(named, allowMissingColumns=True)
        known = F.max("_root").over(Window.partitionBy(end))
        out = both.withColumn(f"{end}_root", F.coalesce(known, F.col(end))).where(F.col("u").isNotNull() & F.col("v").isNotNull()).drop("_root")
    return out.where("u_root <> v_root").select("u", "v")


def _fingerprint_groups(nodes: DataFrame) -> DataFrame:
    """(node, size, key): the nodes by the component of their fingerprint, found as in ``components``."""
    fps = cut(nodes.groupBy("fp").agg(F.count("*").alias("n")))
    roots = connected_components(links(fps.select("fp")))
    named = cut(fps.join(roots, roots.node == fps.fp, "left").select("fp", "n", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key")))
    return join_spread(nodes.select("node", "size", "fp"), named, ["fp"], "n", nodes.count()).select("node", "size", "key")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", column: str = "text", size: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, node, component_id): texts with at least this Jaccard similarity of their word shingles share a component.

    A node is a distinct text, known by a hash of 64 bits (among n texts some n**2 / 2**65 pairs share one by chance).  Candidates: nodes whose fingerprints link, directly or through others
    (fingerprints, ball hashing and components are those of ``components``), and, since three bits bridge few of the pairs near the limit,
    also nodes that share a MinHash band.  Below, both are bands.  Each node is first compared with the smallest node
    of every band that it is in.  Where this leaves a band's nodes in several components, all its pairs across components are
    compared: small groups as pairs, larger ones in blocks, every block with every other, in tasks of their own.  No candidate
    goes unverified unless its ends are connected already.
    """
    bounded_batches(docs.sparkSession)
    marked = stash(_sketches(docs, id_column, column, size))
    nodes = stash(marked.groupBy("node").agg(F.min(id_column).alias("first"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("bands").alias("bands"), F.count("*").alias("n")))
    w = Window.partitionBy("key")
    # In a band's group: how many it has, and the smallest node.
    met = nodes.select("node", "size", F.explode("bands").alias("key")).unionByName(_fingerprint_groups(nodes)).withColumn("n", F.count("*").over(w)).withColumn("low", F.min(F.struct("node", "size")).over(w))
    met = cut(met.where("n > 1").select("key", "node", "size", "n", F.col("low.node").alias("centre"), F.col("low.size").alias("centre_size")))
    fits = lambda a, b: F.least(a, b) >= F.greatest(a, b) * similarity  # noqa: E731  no smaller set can be so similar to a larger one
    pairs = cut(met.where("node <> centre").where(fits("size", "centre_size")).groupBy("node", "centre").agg(F.count("*").alias("n")))
    # The ends of all pairs that may be compared: those of larger groups may be compared with each other, too.
    ends = pairs.select("node").union(pairs.select("centre")).union(met.where("n > 2").select("node"))
    wanted = cut(ends.distinct().join(nodes, "node").select("node", "first"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set((x or "").encode("utf-8", "surrogatepass"), size).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "shingles"])

    # Of a node's copies only those with the smallest id are described.
    named = docs.select(F.col(id_column).alias("first"), F.col(column).alias("text"), text_node(column).alias("node"))
    met_once = named.alias("d").join(wanted.alias("w"), (F.col("d.node") == F.col("w.node")) & F.col("d.first").eqNullSafe(F.col("w.first")))
    described = stash(met_once.select("d.node", "d.text").mapInArrow(tidied(sets), "node long, shingles binary").dropDuplicates(["node"]))

    def verified(edges: DataFrame) -> DataFrame:
        both = edges.join(described.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u").join(described.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
        return cut(both.select("u", "v", "su", "sv").mapInArrow(tidied(_similar(similarity)), "u long, v long"))

    # Shingle sets are heavy, so each node first meets the centre that it shares most bands with, and only
    # candidates that these links leave in different components are verified after that.
    ordered = lambda rows: rows.select(F.greatest("node", "centre").alias("u"), F.least("node", "centre").alias("v")).distinct()
    best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "centre"))).where("rank = 1")
    edges = verified(ordered(best))
    roots = connected_components(edges)
    rest = cut(_apart(ordered(pairs), roots))
    if rest.take(1):
        edges = cut(edges.unionByName(verified(rest)))
        roots = connected_components(edges)
    # What the stars leave: bands with several components.  Their smallest node has met all others by now.
    open_ = met.where("n > 2 and node <> centre").select("key", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = open_.withColumn("mixed", F.min("root").over(w) < F.max("root").over(w)).where("mixed")
    open_ = cut(open_.withColumn("n", F.count("*").over(w)).withColumn("bytes", F.sum("size").over(w) * 8).select("key", "node", "root", "n", "bytes", "size"))
    if open_.take(1):
        few = open_.where(F.col("n") <= PAIRED)
        left, right = (few.select("key", *[F.col(c).alias(c + end) for c in ("node", "root", "size")]) for end in "uv")
        met_ = left.join(right, "key").where("nodeu > nodev and rootu <> rootv").where(fits("sizeu", "sizev"))
        more = verified(met_.select(F.col("nodeu").alias("u"), F.col("nodev").alias("v")).distinct())
        many = open_.where(F.col("n") > PAIRED).withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("bytes") / BLOCK_BYTES)))
        many = many.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        jobs = many.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "root").join(described, "node").select("key", "lo", "hi", "block", "node", "root", "shingles")
        dealt = jobs.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        more = cut(more.unionByName(dealt.mapInArrow(tidied(_link_blocks(similarity)), "u long, v long")).distinct())
        if more.take(1):
            roots = connected_components(edges.unionByName(more))
    linked = roots.join(nodes.select("node", "first"), "node")
    # The document that stands for a component: the one with the smallest id (rows without id come last), then node.
    order = F.struct(F.col("first").isNull().alias("late"), F.col("first"), F.col("node"))
    least = linked.groupBy("root").agg(F.min(order).alias("least"), F.count("*").alias("n"))
    linked = join_spread(linked, cut(least), ["root"], "n", roots.count(), HOT_EDGES).select("node", F.col("least.first").alias("component_id"), F.col("least.node").alias("kept"))
    named = nodes.join(linked.withColumn("linked", F.lit(True)), "node", "left")
    chosen = lambda a, b: F.when(F.col("linked"), F.col(a)).otherwise(F.col(b))
    named = cut(named.select("node", "n", chosen("component_id", "first").alias("component_id"), chosen("kept", "node").alias("kept")))
    return join_spread(marked.select(id_column, "node"), named, ["node"], "n", marked.count())


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", column: str = "text", size: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document, the one with the smallest id, of each group of near duplicates.

    Documents are told apart by id and text, so an id that several texts share loses only the texts that go.  Rows without
    id come after all others and are told apart by text alone.  Rows that repeat both id and text count as one document.
    """
    found = stash(near_duplicates(docs, id_column, column, size, similarity))
    stays = F.col(id_column).eqNullSafe(F.col("component_id")) & (F.col("node") == F.col("kept"))
    its_id, its_node = fresh(docs, "its_id"), fresh(docs, "its_node")
    named = lambda rows: rows.select(F.col(id_column).alias(its_id), F.col("node").alias(its_node))
    same = (text_node(column) == F.col(its_node)) & F.col(id_column).eqNullSafe(F.col(its_id))
    losers = cut(named(found.where(~stays)).distinct())
    losers = F.broadcast(losers) if losers.count() <= BROADCAST_ROWS else losers
    kept = docs.join(losers, same, "left_anti")
    repeated = cut(named(found.where(stays).groupBy(id_column, "node").count().where("count > 1")))
    if not repeated.take(1):
        return kept
    # Only documents that repeat need a shuffle to keep one row of each.
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    again = kept.join(repeated, same, "left_semi").withColumn(its_node, text_node(column)).dropDuplicates([id_column, its_node]).drop(its_node)
    return kept.join(repeated, same, "left_anti").unionByName(again)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
