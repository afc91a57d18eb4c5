"""SentencePiece encoding and decoding, with sampled segmentations by Gumbel top-k without replacement.

The lattice of a text: nodes are byte positions, arcs are vocabulary pieces (byte pieces for characters without a piece).
No piece goes over a space from the left or over a line break, so the lattice is a chain of chunks, and equal chunks of a
batch share one lattice.  A piece of rank r (the order of a BPE vocabulary) weighs -log(2 + r) times ``sharpness``; a
segmentation's probability is the product of its pieces' weights, normalised over the whole lattice.

Sampling is a perturbed A-star search.  A region of segmentations is a prefix of decisions, a set of excluded arcs at the
next one, and freedom after it; backward sums over the lattice give its mass exactly.  The best segmentation of a
region carries the region's Gumbel value; taking it out leaves one region per decision, each with an independent Gumbel value
of its own mass, truncated at the value taken.  Popping regions from the best on emits distinct
segmentations: exactly a sample without replacement.  The inclusion score of a segmentation y is the log of
P(Gumbel(log p(y)) > kappa), where kappa is the next value after the last one emitted.

All randomness is hashed from the row key, the sample's number and the place in the text, so results do not depend on
batches, partitions or retries.  Null texts count as empty; an empty text has one empty segmentation.  Very long texts are
sampled whole; a long run without blanks is one chunk and costs a few microseconds a byte.  Texts with fewer than k
segmentations give them all, with inclusion score 0.  Repeated rows give repeated results; a null key counts as
0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import bounded_batches, quoted, table, tidied

MODEL = "piece_bpe_32k.model"
K = 3
SHARPNESS = 1.0
SLICE_CHARS = 6 << 20
#: A longer chunk is walked byte by byte in plain Python, since few others go on beside it; a chunk's length alone decides.
LONG_CHUNK = 512
_CHUNK = re.compile(rb"\n| *[^ \n]+| +")
_SPACE = "▁"


class Vocabulary:
    """Pieces as a byte trie in an open-addressing table, with their weights."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.byte_ids = np.full(256, -1, np.int32)
        self.text: dict[int, bytes] = {}
        rank = np.zeros(n)
        for i in range(n):
            if p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                continue
            if p.is_byte(i):
                value = int(p.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.text[i] = i, bytes([value])
                rank[i] = n
            else:
                self.text[i] = p.id_to_piece(i).replace(_SPACE, " ").encode()
                rank[i] = i
        self.bytes_of = np.full(n, b"", object)
        self.bytes_of[list(self.text)] = list(self.text.values())
        self.weight = -sharpness * np.log(2.0 + rank)
        edges: dict[int, int] = {}
        final = [-1]
        self.longest = 1
        for i, piece in self.text.items():
            if self.byte_ids[piece[0]] == i:
                continue
            if b"\n" in piece or b" " in piece.lstrip(b" "):
                raise ValueError("a piece goes over the end of a chunk")
            state = 0
            for c in piece:
                key = state * 256 + c
                if key not in edges:
                    edges[key] = len(final)
                    final.append(-1)
                state = edges[key]
            final[state] = i
            self.longest = max(self.longest, len(piece))
        self.final = np.array(final, np.int32)
        self.bits = max(16, (4 * len(edges)).bit_length())
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        todo, to = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32)
        shift = np.zeros(len(todo), np.int64)
        while len(todo):  # linear probing, all keys at once
            at = (self._slot(todo) + shift) & ((1 << self.bits) - 1)
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.next[at[won]] = todo[won], to[won]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, to, shift = todo[rest], to[rest], shift[rest] + 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next state, or -1."""
        key = state.astype(np.int64) * 256 + byte
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.next[at], -1)
        open_ = np.flatnonzero((got != key) & (got != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[open_]]
            hit = got == key[open_]
            out[open_[hit]] = self.next[at[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out

    # Plain encoding and decoding are the library's.
    def encode(self, text: str) -> list[int]:
        return self.processor.encode(text)

    def spelled(self, ids) -> bytes:
        """The bytes that piece ids stand for, without the blank that encoding puts before a text."""
        return b"".join(self.bytes_of[np.asarray(ids, np.int64)].tolist()).removeprefix(b" ")

    def decode(self, ids: list[int]) -> str:
        return self.spelled(ids).decode("utf-8", "replace")


class Lattice:
    """The lattices of distinct chunks, end to end: arcs by start node with backward sums and cumulative probabilities."""

    def __init__(self, v: Vocabulary, chunks: list[bytes]):
        data = np.frombuffer(b"".join(chunks), np.uint8)
        n = len(data)
        lengths = np.array([len(c) for c in chunks], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.ends = self.starts + lengths
        limit = np.repeat(self.ends, lengths).astype(np.int32)
        begin, stop, piece = [], [], []
        live, state = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
        char = (data & 0xC0) != 0x80
        live, state = live[char], state[char]
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4))).astype(np.int8)
        whole = np.zeros(n, bool)  # characters that are a piece
        for depth in range(v.longest):
            ok = live + depth < limit[live]
            live, state = live[ok], state[ok]
            state = v.step(state, data[live + depth])
            ok = state >= 0
            live, state = live[ok], state[ok]
            if not len(live):
                break
            got = v.final[state]
            done = got >= 0
            begin.append(live[done])
            stop.append(live[done] + depth + 1)
            piece.append(got[done])
            whole[live[done & (width[live] == depth + 1)]] = True
        bare = np.zeros(n, bool)
        bare[np.flatnonzero(char & ~whole)] = True
        bare = bare[np.maximum.accumulate(np.where(char, np.arange(n), 0))]  # all bytes of such characters
        at = np.flatnonzero(bare)
        begin.append(at)
        stop.append(at + 1)
        piece.append(v.byte_ids[data[at]])
        # Arcs by their start node, counted into place (each depth has at most one arc from a node).
        self.count = np.zeros(n + 1, np.int32)
        for x in begin:
            self.count[x] += 1
        self.first = np.cumsum(self.count, dtype=np.int32) - self.count
        filled = self.first.copy()
        total = int(self.count.sum())
        self.begin, self.stop, self.piece = (np.empty(total, np.int32) for _ in range(3))
        for x, y, z in zip(begin, stop, piece, strict=True):
            at = filled[x]
            self.begin[at], self.stop[at], self.piece[at] = x, y, z
            filled[x] += 1
        del begin, stop, piece, filled, live, state, whole, bare, char, width
        # Backward sums, from each chunk's end on, all chunks at once.
        end = limit[self.begin]
        last = self.stop == end
        togo = end - self.begin
        most = int(togo.max(initial=0))
        order = np.argsort(togo.astype(np.uint16) if most < 1 << 16 else togo, kind="stable")
        beta = np.full(n + 1, -np.inf)
        value = v.weight[self.piece]
        sizes = np.repeat(lengths, lengths)[self.begin]
        order = order[sizes[order] <= LONG_CHUNK]
        bounds = np.searchsorted(togo[order], np.arange(1, min(most, LONG_CHUNK) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            arc = order[a:b]
            x = value[arc] + np.where(last[arc], 0.0, beta[self.stop[arc]])
            s = self.begin[arc]
            heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            top = np.maximum.reduceat(x, heads)
            safe = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                beta[s[heads]] = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, self.count[s[heads]])), heads))
        for chunk in np.flatnonzero(lengths > LONG_CHUNK).tolist():
            self._sum_back(int(self.starts[chunk]), int(self.ends[chunk]), value, beta)
        del order, togo, end, limit, bounds, sizes
        self.logp = value + np.where(last, 0.0, beta[self.stop]) - beta[self.begin]
        del value, last, beta
        self.logp[~np.isfinite(self.logp)] = -np.inf
        self.p = np.exp(self.logp)
        with np.errstate(divide="ignore"):
            self.other = np.log(np.maximum(0.0, 1.0 - self.p))  # of not taking the arc
        self.other[self.p > 1 - 1e-12] = -np.inf
        heads = np.flatnonzero(np.concatenate([[True], self.begin[1:] != self.begin[:-1]])) if total else np.zeros(0, np.int64)
        size = self.count[self.begin[heads]]
        run = np.cumsum(self.p)
        self.within = run - np.repeat(run[heads] - self.p[heads], size)
        self.within /= np.repeat(np.maximum(self.within[heads + size - 1], 1e-300), size)
        self.within[heads + size - 1] = 1.0

    def _sum_back(self, start: int, end: int, value: np.ndarray, beta: np.ndarray) -> None:
        """Backward sums of one long chunk, from its end on."""
        a, b = int(self.first[start]), int(self.first[end - 1] + self.count[end - 1])
        stop, weight = (self.stop[a:b] - start).tolist(), value[a:b].tolist()
        first, count_ = (self.first[start:end] - a).tolist(), self.count[start:end].tolist()
        sums = [-math.inf] * (end - start) + [0.0]
        for i in range(end - start - 1, -1, -1):
            k = first[i]
            x = [weight[j] + sums[stop[j]] for j in range(k, k + count_[i])]
            top = max(x, default=-math.inf)
            if top > -math.inf:
                sums[i] = top + math.log(sum(math.exp(y - top) for y in x))
        beta[start:end] = sums[:-1]

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An arc from each node, by its probability."""
        at = self.first[node]
        behind = np.flatnonzero(self.within[at] <= u)  # nodes have few arcs: walk along them
        while len(behind):
            at[behind] += 1
            behind = behind[self.within[at[behind]] <= u[behind]]
        return at


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: From one place to the next.
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _salted(key: np.ndarray, stream: int) -> np.ndarray:
    """What the numbers of a key and a stream start from."""
    return _mix(key + np.uint64(stream * 0xD1342543DE82EF95 & (2**64 - 1)))


def _unit(x: np.ndarray) -> np.ndarray:
    return ((_mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def uniform(key: np.ndarray, stream: int, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row key, the stream and the place alone."""
    return _unit(_salted(key, stream) + place.astype(np.uint64) * _STEP)


def _uniform_one(key: int, stream: int, place: int) -> float:
    """The same for one place, on Python's integers."""
    mask = 2**64 - 1

    def mix(x: int) -> int:
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    x = (mix((key + stream * 0xD1342543DE82EF95) & mask) + place * 0x9E3779B97F4A7C15) & mask
    return ((mix(x) >> 11) + 0.5) * 2.0**-53


def row_key(value) -> int:
    return xxhash.xxh64_intdigest(str(value).encode("utf-8", "surrogatepass")) if value is not None else 0


def _paths(lat: Lattice, node: np.ndarray, end: np.ndarray, key: np.ndarray, many: np.ndarray, place: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray]:
    """Complete paths from nodes to their chunks' ends, ``many`` nodes of each key: (number of arcs of each, all arcs in order)."""
    steps, arcs = [], []
    long = end - node > LONG_CHUNK
    chunks = np.flatnonzero(long)
    keys = key[np.searchsorted(np.cumsum(many), chunks, side="right")]
    walked = [(i, _walk(lat, int(node[i]), int(end[i]), int(k), int(place[i]), stream)) for i, k in zip(chunks.tolist(), keys.tolist(), strict=True)]
    who = np.flatnonzero(~long)
    seed = np.repeat(_salted(key, stream), many) + place.astype(np.uint64) * _STEP
    at, seed, end = node[who], seed[who], end[who]
    while len(who):
        arc = lat.draw(at, _unit(seed))
        steps.append(who)
        arcs.append(arc)
        at = lat.stop[arc]
        go = np.flatnonzero(at < end)
        who, at, seed, end = who[go], at[go], seed[go] + _STEP, end[go]
    count = np.zeros(len(node), np.int64)
    for s in steps:
        count[s] += 1
    for i, path in walked:
        count[i] = len(path)
    offset = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for d, (s, a) in enumerate(zip(steps, arcs, strict=True)):
        out[offset[s] + d] = a
    for i, path in walked:
        out[offset[i] : offset[i] + len(path)] = path
    return count, out


def _walk(lat: Lattice, node: int, end: int, key: int, place: int, stream: int) -> list[int]:
    """The path of one long chunk: the same draws, by plain Python on the random numbers of all its steps."""
    low = int(lat.first[node])
    high = int(lat.first[end - 1] + lat.count[end - 1])
    first, stop, within = (lat.first[node:end] - low).tolist(), (lat.stop[low:high] - node).tolist(), lat.within[low:high].tolist()
    at, step, path, size = 0, 0, [], end - node
    draws: list[float] = []
    while at < size:
        if step == len(draws):
            more = np.arange(place + step, place + step + 4096)
            draws += uniform(np.full(len(more), key, np.uint64), stream, more).tolist()
        arc = first[at]
        while within[arc] <= draws[step]:
            arc += 1
        path.append(low + arc)
        at, step = stop[arc], step + 1
    return path


def sample(v: Vocabulary, texts: list[str], keys: list[int], k: int = K) -> list[list[tuple[np.ndarray, float, float]]]:
    """Per text up to k distinct segmentations: (piece ids, log probability, log inclusion), from the best perturbed value on."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    docs = []
    for text in texts:
        raw = (" " + text.replace(_SPACE, " ")).encode("utf-8", "replace") if text else b""
        found_chunks = _CHUNK.findall(raw)
        docs.append(np.fromiter(map(number.__getitem__, found_chunks), np.int64, len(found_chunks)))
    if not number:
        return [[(np.zeros(0, np.int64), 0.0, 0.0)] for _ in texts]
    lat = Lattice(v, list(number))
    key = np.array(keys, np.uint64)
    # Places in a text, for the random numbers: the byte position of the chunk, plus the step in it.
    where = [np.cumsum(lat.ends[d] - lat.starts[d]) - (lat.ends[d] - lat.starts[d]) for d in docs]
    found: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in texts]
    value: list[list[float]] = [[] for _ in texts]
    heaps: list[list[tuple]] = [[] for _ in texts]
    gumbel = -np.log(-np.log(uniform(key, 1, np.zeros(len(key), np.int64))))
    # What to sample this round: (text, prefix arcs, prefix log p, chosen arc or None, excluded, value, chunk).
    todo = [(i, np.zeros(0, np.int64), 0.0, None, (), float(gumbel[i]), 0) for i in range(len(texts))]
    for round_ in range(k):
        sizes, nodes, ends, places = [], [], [], []
        for i, prefix, _, arc, _, _, chunk in todo:
            d = docs[i]
            first = [] if arc is None or lat.stop[arc] >= lat.ends[d[chunk]] else [chunk]
            rest = d[chunk + (arc is not None) :]
            n = lat.starts[rest]
            e, w = lat.ends[rest], where[i][chunk + (arc is not None) :]
            if first:
                at = lat.stop[arc]
                n, e = np.concatenate([[at], n]), np.concatenate([[lat.ends[d[chunk]]], e])
                w = np.concatenate([[where[i][chunk] + at - lat.starts[d[chunk]]], w])
            sizes.append(len(n))
            nodes.append(n)
            ends.append(e)
            places.append(w)
        text_of = np.array([t[0] for t in todo], np.int64)
        many = np.array(sizes, np.int64)
        counts, arcs = _paths(lat, np.concatenate(nodes), np.concatenate(ends), key[text_of], many, np.concatenate(places), 16 + round_)
        chunk_bound = np.concatenate([[0], np.cumsum(many)])
        arc_bound = np.concatenate([[0], np.cumsum(counts)])[chunk_bound]
        # New regions: one per decision from the chosen arc (or the start) on.
        new, base, taken, place = [], [], [], []
        for j, (i, prefix, prefix_lp, arc, excluded, g, _) in enumerate(todo):
            mine = arcs[arc_bound[j] : arc_bound[j + 1]]
            mine = mine if arc is None else np.concatenate([[arc], mine])
            new.append(mine)
            base.append(prefix_lp)
            taken.append(float(np.exp(lat.logp[list(excluded)]).sum()) if excluded else 0.0)
            place.append(len(prefix))
        size = np.array([len(x) for x in new], np.int64)
        every = np.concatenate(new)
        lp = lat.logp[every]
        bound = np.cumsum(size) - size
        run = np.cumsum(lp) - lp
        before = run - np.repeat(run[np.minimum(bound, max(0, len(run) - 1))], size) + np.repeat(np.array(base), size) if len(run) else run
        head = bound[size > 0]
        with np.errstate(divide="ignore"):
            free = lat.other[every]
            gone = np.minimum(1.0, lat.p[every[head]] + np.array(taken)[size > 0])
            free[head] = np.where(gone > 1 - 1e-12, -np.inf, np.log(1.0 - gone))
            inner = np.arange(len(every)) - np.repeat(bound - np.array(place), size)
            # Gumbel values before truncation; truncation at the value taken keeps their order within a text.
            cut = before + free - np.log(-np.log(_unit(np.repeat(_salted(key[text_of], 1024 + round_), size) + inner.astype(np.uint64) * _STEP)))
        del free, inner
        left = k - round_  # no more of a text's regions can ever be wanted
        nxt = []
        for j, (i, prefix, prefix_lp, arc, excluded, g_value, _) in enumerate(todo):
            a, b = int(bound[j]), int(bound[j] + size[j])
            path = np.concatenate([prefix, new[j]]) if len(prefix) else new[j]
            total = float(before[b - 1] + lp[b - 1]) if b > a else prefix_lp
            found[i].append((lat.piece[path], total, 0.0))
            value[i].append(g_value)
            mine = cut[a:b]
            best = np.argpartition(-mine, left)[:left] if len(mine) > left else np.arange(len(mine))
            for t in best.tolist():
                if np.isfinite(mine[t]):
                    low = float(-np.logaddexp(-g_value, -mine[t]))
                    ex = (int(new[j][t]), *(excluded if t == 0 else ()))
                    heapq.heappush(heaps[i], (-low, round_, len(prefix) + t, path, float(before[a + t]), ex))
            if round_ < k - 1 and heaps[i]:
                value_, _, at, parent, pre, ex = heapq.heappop(heaps[i])
                node = int(lat.begin[parent[at]])
                low = int(lat.first[node])
                options = [x for x in range(low, low + int(lat.count[node])) if x not in ex]
                weights = lat.p[options].tolist()
                left_over, pick = _uniform_one(int(key[i]), 4096 + round_, at) * sum(weights), options[-1]
                for option, weight in zip(options, weights, strict=True):
                    left_over -= weight
                    if left_over < 0:
                        pick = option
                        break
                done = int((lat.stop[parent[:at]] - lat.begin[parent[:at]]).sum())
                chunk = int(np.searchsorted(where[i], done, side="right")) - 1
                nxt.append((i, parent[:at], pre, pick, ex, -value_, chunk))
        todo = nxt
        if not todo:
            break
    for i, rows in enumerate(found):
        kappa = -heaps[i][0][0] if heaps[i] and len(rows) == k else -np.inf
        found[i] = [(ids, lp, float(_log_inclusion(lp, kappa))) for ids, lp, _ in rows]
    return found


def _log_inclusion(logp: float, kappa: float) -> float:
    """log P(Gumbel(logp) > kappa)."""
    if kappa == -np.inf:
        return 0.0
    d = logp - kappa
    return float(np.log(-np.expm1(-np.exp(min(d, 700.0))))) if d > -700 else d


_KEPT: dict[tuple, Vocabulary] = {}


def vocabulary(path: str, sharpness: float) -> Vocabulary:
    if (path, sharpness) not in _KEPT:
        _KEPT[path, sharpness] = Vocabulary(path, sharpness)
    return _KEPT[path, sharpness]


def sampled(docs: DataFrame, k: int = K, model: str | None = None, sharpness: float = SHARPNESS, id_column: str = "doc_id", column: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, sample, n_pieces, ids_crc32, text_crc32, restored, log_prob, log_inclusion and, with keep_ids, ids) of up to k segmentations per row.

    Every sample is decoded again: ``text_crc32`` is of the UTF-8 of what comes back, and ``restored`` says whether that is the text
    (with blanks for U+2581, which the library takes for one).
    """
    bounded_batches(docs.sparkSession)
    path = model or public_tokenizers.path(MODEL)
    src = docs.select(id_column, column)
    ddl = f"{quoted(id_column)} {src.schema[0].dataType.simpleString()}, sample int, n_pieces long, ids_crc32 long, text_crc32 long, restored boolean, log_prob double, log_inclusion double" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from blockloom.llm import tokens

        v = vocabulary(path, sharpness)
        for batch in batches:
            items = [x or "" for x in batch.column(1).to_pylist()]
            keys = [row_key(x) for x in batch.column(0).to_pylist()]
            for a, b in tokens.slices(items, SLICE_CHARS):
                rows, out, kept = [], [], []
                for i, got in enumerate(sample(v, items[a:b], keys[a:b], k), a):
                    whole = items[i].replace(_SPACE, " ").encode("utf-8", "replace")
                    for r, (ids, lp, inclusion) in enumerate(got, 1):
                        rows.append(i)
                        back = v.spelled(ids)
                        out.append((r, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back), back == whole, lp, inclusion))
                        if keep_ids:
                            kept.append(ids.astype(np.int32))
                columns = list(zip(*out, strict=True))
                arrays = [batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []), names=[id_column, "sample", "n_pieces", "ids_crc32", "text_crc32", "restored", "log_prob", "log_inclusion"] + ["ids"] * keep_ids)

    return src.mapInArrow(tidied(run), ddl)


def encoded(docs: DataFrame, model: str | None = None, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, ids) by the library's own (best) encoding."""
    bounded_batches(docs.sparkSession)
    path = model or public_tokenizers.path(MODEL)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path, SHARPNESS)
        for batch in batches:
            yield pa.array(v.processor.encode([x or "" for x in batch.to_pylist()], num_threads=1), pa.list_(pa.int32()))

    return docs.select(id_column, run(F.col(column)).alias("ids"))


def decoded(pieces: DataFrame, model: str | None = None, id_column: str = "doc_id", column: str = "ids") -> DataFrame:
    """(id, text) of piece ids; null ids are an empty text."""
    path = model or public_tokenizers.path(MODEL)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path, SHARPNESS)
        for batch in batches:
            yield pa.array([v.decode(x or []) for x in batch.to_pylist()], pa.string())

    return pieces.select(id_column, run(F.col(column)).alias("text"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sampled(table(spark, sf_dir, "documents"), keep_ids=False)
    return got.select("doc_id", "sample", "n_pieces", "ids_crc32", "text_crc32", "restored", F.round("log_prob", 6).alias("log_prob"), F.round("log_inclusion", 6).alias("log_inclusion"))


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
ORACLES: dict[str, str] = {}
