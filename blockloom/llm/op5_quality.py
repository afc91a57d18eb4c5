"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  In each chunk learned filters run over
embedded bytes; their maxima go through a small hidden layer (a repetitive chunk shows by the filters that
stay silent).  A document's hidden units are combined over its chunks by maximum and by mean, and one
logistic layer turns that into a probability, calibrated so that the best single cut lies at ``AT``.

Fitting uses a bounded sample (``sample_rows``) of labelled rows; scoring is one narrow map over chunk batches of
bounded size, whatever a text's length.  Null and empty texts are one empty chunk.  Repeated rows score alike; an
empty table gives an empty result.  ``score`` keeps all columns but one that is named like its output (``out``), which it
replaces.  Without labels of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import best_cut, bounded_batches, drop_kept, labelled_sample, release, table, utf8

CHUNK, OVERLAP = 512, 64
WIDTH, STRIDE = 8, 4
DIMENSIONS, FILTERS, HIDDEN = 4, 32, 16
SAMPLE_ROWS = 6000
EPOCHS = 10
#: In training a document shows at most so many of its chunks at a time, drawn anew each time.
TRAIN_CHUNKS = 8
BATCH_CHUNKS = 1024
AT = 0.3


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks that cover n bytes, at least one."""
    return np.arange(max(1, -(-(n - OVERLAP) // (CHUNK - OVERLAP)))) * (CHUNK - OVERLAP)


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) bytes from the given starts, zero beyond each one's end."""
    at = starts[:, None] + np.arange(CHUNK)
    got = data[np.minimum(at, max(0, len(data) - 1))] if len(data) else np.zeros(at.shape, np.uint8)
    return np.where(at < ends[:, None], got, 0).astype(np.uint8)


class ByteCnn:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        n = lambda s, *shape: r.normal(0, s, shape).astype(np.float32)
        k = WIDTH * DIMENSIONS
        self.p = {"e": n(0.5, 256, DIMENSIONS), "w": n((2 / k) ** 0.5, k, FILTERS), "b": np.zeros(FILTERS, np.float32), "h": n((2 / FILTERS) ** 0.5, FILTERS, HIDDEN), "d": np.zeros(HIDDEN, np.float32), "v": n(0.3, 2 * HIDDEN), "c": np.zeros(1, np.float32)}

    @staticmethod
    def patches(x: np.ndarray) -> np.ndarray:
        """All windows of embedded chunks (n, CHUNK, D) as rows (n, positions, WIDTH * D), without a copy."""
        n, length, d = x.shape
        s0, s1, s2 = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, (length - WIDTH) // STRIDE + 1, WIDTH * d), (s0, s1 * STRIDE, s2))

    def hidden(self, chunks: np.ndarray, keep: dict | None = None) -> np.ndarray:
        x = self.p["e"][chunks]
        rows = self.patches(x)
        n, m, k = rows.shape
        a = (rows.reshape(n * m, k) @ self.p["w"]).reshape(n, m, FILTERS)
        if keep is not None:
            at = a.argmax(axis=1)
            top = np.take_along_axis(a, at[:, None, :], axis=1)[:, 0]
        else:
            at, top = None, a.max(axis=1)
        pooled = np.maximum(top + self.p["b"], 0)
        u = np.maximum(pooled @ self.p["h"] + self.p["d"], 0)
        if keep is not None:
            keep.update(rows=rows, at=at, pooled=pooled, u=u)
        return u

    def combine(self, top: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return np.concatenate([top, mean], axis=1) @ self.p["v"] + self.p["c"][0]

    def step(self, chunks: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray, state: dict, rate: float) -> None:
        """One Adam step; chunks of document i are from starts[i] on."""
        keep: dict = {}
        u = self.hidden(chunks, keep)
        counts = np.diff(np.concatenate([starts, [len(chunks)]]))
        doc = np.repeat(np.arange(len(y)), counts)
        top = np.maximum.reduceat(u, starts, axis=0)
        mean = np.add.reduceat(u, starts, axis=0) / counts[:, None]
        z = self.combine(top, mean)
        g = ((1 / (1 + np.exp(-z)) - y) * weight / weight.sum()).astype(np.float32)
        grad = {"v": np.concatenate([top, mean], axis=1).T @ g + 1e-4 * self.p["v"], "c": np.array([g.sum()], np.float32)}
        is_top = u == top[doc]
        share = is_top / np.maximum(1, np.add.reduceat(is_top, starts, axis=0))[doc]
        du = share * (g[:, None] * self.p["v"][:HIDDEN])[doc] + (g[:, None] * self.p["v"][HIDDEN:] / counts[:, None])[doc]
        du = (du * (u > 0)).astype(np.float32)
        grad["h"], grad["d"] = keep["pooled"].T @ du + 1e-4 * self.p["h"], du.sum(axis=0)
        dp = (du @ self.p["h"].T) * (keep["pooled"] > 0)
        grad["b"] = dp.sum(axis=0)
        n = np.arange(len(chunks))[:, None]
        rows = keep["rows"][n, keep["at"]]  # (chunks, filters, k)
        grad["w"] = np.einsum("nfk,nf->kf", rows, dp) + 1e-5 * self.p["w"]
        dx = (dp[:, :, None] * self.p["w"].T[None]).reshape(len(chunks), FILTERS, WIDTH, DIMENSIONS)
        which = chunks[n[:, :, None], keep["at"][:, :, None] * STRIDE + np.arange(WIDTH)]
        grad["e"] = np.zeros_like(self.p["e"])
        np.add.at(grad["e"], which.ravel(), dx.reshape(-1, DIMENSIONS))
        state["t"] = t = state.get("t", 0) + 1
        for name, d in grad.items():
            m, v = state.setdefault(name, (np.zeros_like(d), np.zeros_like(d)))
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            self.p[name] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)


class Model:
    def __init__(self, net: ByteCnn, scale: float = 1.0, shift: float = 0.0):
        self.net, self.scale, self.shift = net, scale, shift

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of the texts data[offsets[i]:offsets[i+1]], at most BATCH_CHUNKS chunks at a time."""
        n = len(offsets) - 1
        top = np.full((n, HIDDEN), -np.inf, np.float32)
        total, count = np.zeros((n, HIDDEN)), np.zeros(n, np.int64)
        lengths = np.diff(offsets)
        per = np.maximum(1, -(-(lengths - OVERLAP) // (CHUNK - OVERLAP)))
        doc = np.repeat(np.arange(n), per)
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        for a in range(0, len(doc), BATCH_CHUNKS):
            d = doc[a : a + BATCH_CHUNKS]
            u = self.net.hidden(cut(data, offsets[d] + inner[a : a + BATCH_CHUNKS] * (CHUNK - OVERLAP), offsets[d + 1]))
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            who = d[first]
            top[who] = np.maximum(top[who], np.maximum.reduceat(u, first, axis=0))
            total[who] += np.add.reduceat(u, first, axis=0)
        return self.net.combine(top, (total / per[:, None]).astype(np.float32))

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (z.astype(np.float64) - self.shift) + np.log(AT / (1 - AT)), -30, 30)))


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def fit(sample: pa.Table, column: str = "text", seed: int = 0) -> Model | None:
    """Train on four fifths of the sample, choose the state and calibrate on the rest."""
    y = sample.column("label").to_numpy().astype(np.float32)
    if len(y) < 4 or y.min() == y.max():
        return None
    data, offsets = utf8(pa.concat_arrays(sample.column(column).chunks))
    r = np.random.default_rng(seed)
    order = r.permutation(len(y))
    back = order[: max(1, len(y) // 5)]
    learn = order[len(back) :]
    if y[learn].min() == y[learn].max():
        back, learn = order, order
    parts = [data[offsets[i] : offsets[i + 1]] for i in back]
    held, held_at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    share = y[learn].mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) ** 0.5
    net, state = ByteCnn(seed), {}
    best = (np.inf, {n: v.copy() for n, v in net.p.items()})
    steps = max(400, EPOCHS * len(learn) // 32)
    every = max(100, steps // 10)
    for k in range(steps):
        pick = r.choice(learn, min(32, len(learn)), replace=False)
        at, ends, firsts = [], [], []
        for i in pick:
            s = chunk_starts(int(offsets[i + 1] - offsets[i]))
            if len(s) > TRAIN_CHUNKS:
                s = s[r.choice(len(s), TRAIN_CHUNKS, replace=False)]
            firsts.append(sum(map(len, at)))
            at.append(offsets[i] + s)
            ends.append(np.full(len(s), offsets[i + 1]))
        net.step(cut(data, np.concatenate(at), np.concatenate(ends)), np.array(firsts), y[pick], weight[pick], state, 0.01 * (1 - 0.9 * k / steps))
        if k % every == every - 1:
            z = Model(net).logits(held, held_at).astype(np.float64)
            loss = float(np.mean(weight[back] * (np.logaddexp(0, z) - y[back] * z)))
            if loss < best[0]:
                best = (loss, {n: v.copy() for n, v in net.p.items()})
    net.p = best[1]
    z = Model(net).logits(held, held_at)
    return Model(net, 2.0 / (float(np.std(z)) or 1.0), best_cut(z, y[back]))


def train(docs: DataFrame, labels: DataFrame, learn_if, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    try:
        return fit(labelled_sample(docs, labels, label, learn_if, sample_rows))
    finally:
        release()


def score(docs: DataFrame, model: Model | None, column: str = "text", out: str = "score") -> DataFrame:
    """docs with ``out``: the probability that a text is of good quality."""
    spark = docs.sparkSession
    bounded_batches(spark)
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_kept()
        m = sent.value
        for batch in batches:
            yield pa.array(m.probability(m.logits(*flat(batch.to_pylist()))))
        release()

    return docs.withColumn(out, run(F.col(column)))


def learns(key):
    return key % 5 != 0


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    found = score(docs, train(docs, labels, learns))
    held = F.coalesce(~learns(F.crc32(F.col("doc_id").cast("string").cast("binary"))), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= AT).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
