"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are hashed into buckets.  A word seen in too few training documents shares the embedding of its first letters,
and has the zero embedding where these are rare too, so rare words neither overfit nor fire.  Filters of widths 1, 2 and 3 run over the whole text, their maxima over time go through one
logistic layer.  Scores are calibrated so that the best single cut lies at ``AT``; besides, each language
gets a cut of its own where enough labelled rows of it were held back (languages choose the cut, never the score).

Fitting uses a bounded sample (``sample_rows``) of labelled rows.  Scoring is one narrow map with
bounded memory, whatever a text's length: long texts are scored in overlapping windows whose maxima combine exactly.
Null and empty texts have no words and get the score of silence.  Repeated rows score alike; an empty table gives an
empty result.  ``score`` keeps all columns but those that are named like its outputs (``out``), which it replaces.  Without labels of both classes every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import best_cut, bounded_batches, drop_kept, labelled_sample, release, table

WIDTHS = (1, 2, 3)
FILTERS = 16
DIMENSIONS = 16
BUCKETS = 1 << 18
#: A rare word is known by its first letters, so many of them.
BEGINNINGS = (6, 5, 4)
MIN_DOCUMENTS = 4
#: A bucket needs so many training documents, and this share of them.
MIN_SHARE = 0.004
SAMPLE_ROWS = 9000
EPOCHS = 12
#: 1 weighs both classes alike in training, 0 every row.
BALANCE = 1.0
AT = 0.7
#: Of the embeddings, relative to the other parameters' rate: step size, and shrinkage of every entry per step.
RATE_E, SHRINK = 100.0, 0.1
#: Steps between looks at the rows held back; the best state on them is kept.
LOOK_EVERY = 50
_WORD = re.compile(r"\w+")
#: Words scored at once; windows overlap by the widest filter.
_WINDOW = 1 << 17


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def keys(word: str) -> list[int]:
    """The buckets that may stand for a word, the most specific first: itself, then its beginnings."""
    return [bucket(word), *(bucket(f"{word[:n]}-") for n in BEGINNINGS if len(word) > n)]


class Buckets(dict):
    """Word -> row of the embedding table: the word's own, or else that of its longest known beginning, or else 0."""

    def __init__(self, rows: dict[int, int], most: int = 400_000):
        super().__init__()
        self.rows, self.most = rows, most

    def __missing__(self, word: str) -> int:
        row = next((self.rows[k] for k in keys(word) if k in self.rows), 0)
        if len(self) < self.most:
            self[word] = row
        return row


class TextCnn:
    """The network: embeddings, filters of several widths, max over time, logistic output."""

    def __init__(self, rows: int, seed: int = 0, dimensions: int = DIMENSIONS, filters: int = FILTERS, widths=WIDTHS):
        r = np.random.default_rng(seed)
        self.widths, self.filters = tuple(widths), filters
        self.p = {"e": r.normal(0, 0.1, (rows, dimensions)).astype(np.float32), "v": r.normal(0, 0.3, len(widths) * filters).astype(np.float32), "c": np.zeros(1, np.float32)}
        self.p["e"][0] = 0
        for w in widths:
            self.p[f"w{w}"] = r.normal(0, (2 / (w * dimensions)) ** 0.5, (w, dimensions, filters)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(filters, np.float32)

    def projected(self) -> dict[int, np.ndarray]:
        """Every embedding through every filter, so that scoring a text is looking up and adding."""
        return {w: np.einsum("rd,wdf->wrf", self.p["e"], self.p[f"w{w}"]).astype(np.float32) for w in self.widths}

    def pooled(self, tables: dict[int, np.ndarray], ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Maxima over time per document of a padded concatenation, before the bias.

        Only windows that start in a document count: those that start in its padding may reach into the next one.
        """
        bounds = np.stack([starts, starts + lengths], axis=1).ravel()
        out = []
        for w in self.widths:
            n = len(ids) - w + 1
            a = tables[w][0].take(ids[:n], axis=0)
            for o in range(1, w):
                a += tables[w][o].take(ids[o : o + n], axis=0)
            out.append(np.maximum.reduceat(a, bounds, axis=0)[::2])
        return np.concatenate(out, axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        bias = np.concatenate([self.p[f"b{w}"] for w in self.widths])
        return np.maximum(pooled + bias, 0) @ self.p["v"] + self.p["c"][0]

    def step(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray, state: dict, rate: float) -> None:
        """One Adam step on a batch of documents (each followed by padding)."""
        e = self.p["e"]
        x = e[ids]
        n_docs, where, raw = len(y), {}, []
        for w in self.widths:
            n = len(ids) - w + 1
            a = sum(x[o : o + n] @ self.p[f"w{w}"][o] for o in range(w))
            at = np.empty((n_docs, self.filters), np.int64)
            for d, (s, m) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
                at[d] = s + a[s : s + m].argmax(axis=0)
            where[w] = at
            raw.append(np.take_along_axis(a, at, axis=0))
        raw = np.concatenate(raw, axis=1) + np.concatenate([self.p[f"b{w}"] for w in self.widths])
        h = np.maximum(raw, 0)
        z = h @ self.p["v"] + self.p["c"][0]
        g = ((1 / (1 + np.exp(-z)) - y) * weight / weight.sum()).astype(np.float32)
        grad = {"v": h.T @ g + 1e-4 * self.p["v"], "c": np.array([g.sum()], np.float32), "e": np.zeros_like(e)}
        dh = (g[:, None] * self.p["v"]) * (raw > 0)
        for k, w in enumerate(self.widths):
            part = dh[:, k * self.filters : (k + 1) * self.filters]
            grad[f"b{w}"] = part.sum(axis=0)
            dw = np.zeros_like(self.p[f"w{w}"])
            for o in range(w):
                rows = ids[where[w] + o]
                dw[o] = np.einsum("bfd,bf->df", e[rows], part)
                np.add.at(grad["e"], rows.ravel(), (part[:, :, None] * self.p[f"w{w}"][o].T[None]).reshape(-1, e.shape[1]))
            grad[f"w{w}"] = dw + 1e-4 * self.p[f"w{w}"]
        # Embeddings move by plain steps and shrink towards zero: a word keeps a vector only if many documents agree on it.
        de = grad.pop("e")
        e -= RATE_E * rate * de
        np.copyto(e, np.sign(e) * np.maximum(np.abs(e) - SHRINK * rate, 0))
        e[0] = 0
        state["t"] = t = state.get("t", 0) + 1
        for name, d in grad.items():
            m, v = state.setdefault(name, (np.zeros_like(d), np.zeros_like(d)))
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            self.p[name] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)


def concatenated(documents: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids with padding after each document, starts, lengths)."""
    lengths = np.array([max(1, len(d)) for d in documents], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + pad)[:-1]])
    ids = np.zeros(int((lengths + pad).sum()) + pad, np.int32)
    for s, d in zip(starts.tolist(), documents, strict=True):
        ids[s : s + len(d)] = d
    return ids, starts, lengths


class Model:
    """Vocabulary rows, network, calibration and cuts: what is sent to the workers (about 2 MB)."""

    def __init__(self, rows: dict[int, int], net: TextCnn, scale: float, shift: float, cuts: dict[str, float]):
        self.rows, self.net, self.scale, self.shift, self.cuts = rows, net, scale, shift, cuts

    def scorer(self):
        table_, tables = Buckets(self.rows), self.net.projected()
        pad = max(self.net.widths) - 1

        def score(texts: list[str]) -> np.ndarray:
            pooled = np.empty((len(texts), len(self.net.widths) * self.net.filters), np.float32)
            group: list[np.ndarray] = []
            members: list[int] = []

            def flush() -> None:
                if group:
                    best = self.net.pooled(tables, *concatenated(group, pad))
                    np.maximum.at(pooled, np.array(members), best)
                    group.clear()
                    members.clear()

            pooled.fill(-np.inf)
            held = 0
            for i, text in enumerate(texts):
                got = words(text)
                ids = np.fromiter(map(table_.__getitem__, got), np.int32, len(got))
                for a in range(0, max(1, len(ids)), _WINDOW):
                    part = ids[a : a + _WINDOW + pad]
                    group.append(part)
                    members.append(i)
                    held += len(part)
                    if held >= _WINDOW:
                        flush()
                        held = 0
            flush()
            return self.probability(self.net.logits(pooled))

        return score

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (z.astype(np.float64) - self.shift) + np.log(AT / (1 - AT)), -30, 30)))


def fit(sample: pa.Table, column: str = "text", language: str = "lang", seed: int = 0, epochs: int | None = None) -> Model | None:
    """Train on four fifths of the sample, calibrate on the rest."""
    y = sample.column("label").to_numpy().astype(np.float32)
    if len(y) < 4 or y.min() == y.max():
        return None
    # Documents pass one at a time: all words at once as Python objects would be the driver's largest memory.
    least = max(MIN_DOCUMENTS, len(y) * MIN_SHARE)
    levels = 1 + len(BEGINNINGS)
    mine = []
    for x in sample.column(column):
        k = [keys(w) for w in set(words(x.as_py()))]
        mine.append(np.array([v[:1] + [-1] * (levels - len(v)) + v[1:] for v in k], np.int32).reshape(-1, levels))
    known = np.zeros(BUCKETS + 1, bool)  # the last place stands for no such beginning
    rows: dict[int, int] = {}
    for level in range(levels):  # a beginning counts only where nothing more specific is known
        seen = np.zeros(BUCKETS, np.int32)
        for k in mine:
            free = k[~known[k[:, :level]].any(axis=1), level] if level else k[:, 0]
            seen[np.unique(free[free >= 0])] += 1
        frequent = np.flatnonzero(seen >= least)
        for b in frequent.tolist():
            rows.setdefault(b, len(rows) + 1)
        known[frequent] = True
    del mine
    table_ = Buckets(rows)
    docs = [np.fromiter(map(table_.__getitem__, words(x.as_py())), np.int32) for x in sample.column(column)]
    r = np.random.default_rng(seed)
    order = r.permutation(len(y))
    back = order[: max(1, len(y) // 5)]
    learn = order[len(back) :]
    if y[learn].min() == y[learn].max():
        back, learn = order, order
    net, state, pad = TextCnn(len(rows) + 1, seed), {}, max(WIDTHS) - 1
    balance = np.where(y == 1, 0.5 / max(1e-9, y[learn].mean()), 0.5 / max(1e-9, 1 - y[learn].mean())) ** BALANCE
    steps = max(600, (epochs or EPOCHS) * len(learn) // 32)
    best = (np.inf, {n: v.copy() for n, v in net.p.items()})

    def held() -> np.ndarray:
        tables = net.projected()
        return np.concatenate([net.logits(net.pooled(tables, *concatenated([docs[i] for i in back[a : a + 64]], pad))) for a in range(0, len(back), 64)])

    for k in range(steps):
        pick = r.choice(learn, min(32, len(learn)), replace=False)
        part = []
        for i in pick:
            d = docs[i]
            if len(d) > 2048:
                a = int(r.integers(0, len(d) - 2048))
                d = d[a : a + 2048]
            part.append(np.where(r.random(len(d)) < 0.1, 0, d).astype(np.int32))
        ids, starts, lengths = concatenated(part, pad)
        net.step(ids, starts, lengths, y[pick], balance[pick].astype(np.float32), state, 0.01 * (1 - 0.9 * k / steps))
        if k % LOOK_EVERY == LOOK_EVERY - 1:
            z = held().astype(np.float64)
            loss = float(np.mean(balance[back] * (np.logaddexp(0, z) - y[back] * z)))
            if loss < best[0]:
                best = (loss, {n: v.copy() for n, v in net.p.items()})
    net.p = best[1]
    z = held()
    shift = best_cut(z, y[back])
    spread = float(np.std(z)) or 1.0
    model = Model(rows, net, 2.0 / spread, shift, {})
    model.cuts[""] = AT
    langs = sample.column(language).to_pylist() if language in sample.column_names else [None] * len(y)
    p = model.probability(z)
    for name in sorted({x for x in langs if x}):
        mine = np.array([langs[i] == name for i in back])
        if mine.sum() >= 60 and 10 <= y[back][mine].sum():
            model.cuts[name] = float(min(0.95, max(0.3, best_cut(p[mine], y[back][mine]))))
    return model


def train(docs: DataFrame, labels: DataFrame, learn_if, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    also = ("lang",) if "lang" in docs.columns else ()
    try:
        return fit(labelled_sample(docs, labels, label, learn_if, sample_rows, also=also))
    finally:
        release()


def score(docs: DataFrame, model: Model | None, column: str = "text", out: tuple[str, str] = ("score", "cut")) -> DataFrame:
    """docs with the score and the cut of the row's language, named as ``out`` says."""
    spark = docs.sparkSession
    bounded_batches(spark)
    if model is None:
        return docs.withColumns({out[0]: F.lit(0.0), out[1]: F.lit(AT)})
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_kept()
        f = sent.value.scorer()
        for batch in batches:
            yield pa.array(f([x or "" for x in batch.to_pylist()]).astype(np.float64))
        release()

    cut = F.lit(model.cuts[""])
    for name, at in model.cuts.items():
        if name and "lang" in docs.columns:
            cut = F.when(F.col("lang") == name, F.lit(at)).otherwise(cut)
    return docs.withColumns({out[0]: run(F.col(column)), out[1]: cut})


def learns(key):
    return key % 3 != 1


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels")
    found = score(docs, train(docs, labels, learns))
    held = F.coalesce(~learns(F.crc32(F.col("doc_id").cast("string").cast("binary"))), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= AT).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
