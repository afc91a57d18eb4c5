"""The corpus operators against brute force, exact round trips and held-out accuracy, with the awkward cases of each."""

import hashlib
import os
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import public_tokenizers  # noqa: E402

from blockloom.llm import common, components, op1_simhash, op2_packing, op3_token_counts, op4_toxicity, op5_quality, op6_topk, op7_suffix_dedup, op8_tiff, op9_url_filter, op10_sentencepiece, registry, tokens  # noqa: E402

WORDS = "the of and to in a is that for it was on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its now find long down day did get come made may part".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, blanks, ties, junk, other scripts and a long text."""
    rng = np.random.default_rng(3)
    base = [prose(rng, int(n)) for n in rng.integers(3, 300, 60)]
    passage = prose(rng, 25)
    near = base[5].split()
    near[3] = "zebra"
    out = [*base, base[7], base[7], " ".join(near), None, "", " ", "\n\t", "x", "Ünïcode ß 日本語 👩‍👩‍👧 " * 5, "<|endoftext|> and <|startoftext|>", "a" * 3000, "ab " * 2000, prose(rng, 6000)]
    out += [f"{prose(rng, 12)} {passage} {prose(rng, 9)}" for _ in range(6)]
    return [(i, t, ["en", "de", None][i % 3], "s" if i % 3 else "hot", i) for i, t in enumerate(out)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


CLASHES = "score cut fp node u v part piece length bucket order path host words n_tokens n_bytes n_removed n_spans kept_sha256 c0 _bucket _order _text its_id its_node rest first kept root n component_id label sequence_id offset start page error".split()


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Repeated rows, null ids, and columns whose names clash with the operators' own and their outputs'."""
    df = spark.createDataFrame([*rows[:20], rows[3], (None, rows[4][1], None, None, None), (None, None, None, None, None)], SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


# --- 1 ---


def fingerprint(text, size=3):
    words = [w.lower() for w in (text or "").encode().split()]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(items, linked):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(items))]


@pytest.mark.parametrize("dense_from", [2000, 1])
def test_simhash(docs, rows, dense_from):
    got = {r["doc_id"]: r for r in op1_simhash.components(docs, dense_from=dense_from).collect()}
    fps = [fingerprint(t) for _, t, *_ in rows]
    want = classes(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert [got[i]["fp"] % 2**64 for i in range(len(rows))] == fps
    assert [got[i]["component_id"] for i in range(len(rows))] == want


@pytest.mark.parametrize("dense_from", [2000, 5])
def test_fingerprint_links(spark, dense_from):
    """Distances 0 to 5 from many centres, and a ball that is denser than the bound."""
    rng = np.random.default_rng(1)
    fps = {0, 2**63}
    for _ in range(40):
        c = int(rng.integers(0, 2**63)) * 2 + 1
        for k in range(6):
            x = c
            for b in rng.choice(64, k, replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps |= {(1 << i) | (1 << j) for i in range(12) for j in range(i)}
    fps = sorted(fps)
    df = spark.createDataFrame([(op1_simhash._signed(x),) for x in fps], "fp long")
    roots = {r["node"] % 2**64: r["root"] for r in components.connected_components(op1_simhash.links(df, dense_from=dense_from)).collect()}
    want = classes(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    got = [roots.get(x, op1_simhash._signed(x)) for x in fps]
    assert len({*zip(got, want, strict=True)}) == len(set(got)) == len(set(want))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1100)] + [(5, 5), (1000, 7)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(1000, 1100))
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 8, 30):
            w = list(base)
            for p in rng.choice(150, changes, replace=False):
                w[p] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    texts += [texts[0], None, "", "", "hi", "hi"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    want = classes(list(range(len(texts))), lambda i, j: (texts[i] or "") == (texts[j] or "") or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in op1_simhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sorted(r["doc_id"] for r in op1_simhash.drop_near_duplicates(df).collect()) == sorted(set(want))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_dense_groups_at_every_radius(spark, radius):
    rng = np.random.default_rng(13)
    centre = int(rng.integers(0, 2**62))
    fps = sorted({centre ^ sum(1 << int(b) for b in rng.choice(62, n, replace=False)) for n in (0, 1, 2, 3, 4, 5) for _ in range(8)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = op1_simhash.links(df, radius, dense_from=2)
    root = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    want = classes(fps, lambda a, b: (a ^ b).bit_count() <= radius)
    assert [root.get(x, x) for x in fps] == [fps[i] for i in want]


def edited(rng, kind, n=300, part=None):
    """A text and a block-edited copy: words appended, cut off or replaced in one place."""
    w = [f"w{x}" for x in rng.integers(0, 50_000, n)]
    k = int(n * part)
    new = [f"n{x}" for x in rng.integers(0, 10**7, k)]
    at = int(rng.integers(0, n - k))
    return w, {"appended": w + new, "truncated": w[: n - k], "replaced": w[:at] + new + w[at + k :]}[kind]


@pytest.mark.parametrize(("kind", "part"), [("appended", 0.22), ("truncated", 0.17), ("replaced", 0.09)])
def test_block_edits_are_near_duplicates(spark, kind, part):
    """Copies edited in one block, just above the threshold."""
    rng = np.random.default_rng(21)
    pairs = [edited(rng, kind, part=part) for _ in range(150)]
    sets = [[{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in p] for p in pairs]
    assert all(0.8 <= len(a & b) / len(a | b) < 0.86 for a, b in sets)
    df = spark.createDataFrame([(2 * i + j, " ".join(w)) for i, p in enumerate(pairs) for j, w in enumerate(p)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in op1_simhash.near_duplicates(df).collect()}
    assert got == {i: i - i % 2 for i in range(300)}


@pytest.mark.parametrize("blocks", [(16, 256), (16, 20), (0, 20)])
def test_links_between_nodes_that_no_centre_is_near(spark, monkeypatch, blocks):
    """Documents of one template just below the threshold, each with a copy: copies must meet although all share bands."""
    monkeypatch.setattr(op1_simhash, "PAIRED", blocks[0])
    monkeypatch.setattr(op1_simhash, "BLOCK_NODES", blocks[1])
    rng = np.random.default_rng(4)
    template, texts = [f"w{x}" for x in rng.integers(0, 50_000, 300)], []
    for i in range(200):
        at = 24 + int(rng.integers(0, 240))
        own = template[:at] + [f"d{i}x{k}" for k in range(30)] + template[at + 30 :]
        twin = list(own)
        for p in rng.choice(300, 6, replace=False):
            twin[p] = f"s{i}y{p}"
        texts += [own, twin]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    want = classes(list(range(len(texts))), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert len(set(want)) > 100
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in op1_simhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == want


def jaccard_classes(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    return classes(list(range(len(texts))), lambda i, j: (texts[i] or "") == (texts[j] or "") or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0)


def test_repeated_ids_lose_only_the_texts_that_go(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, b), (None, "x y z"), (None, "x y z"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, op1_simhash.drop_near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, c), (None, "x y z"), (4, None)], key=str)


def test_short_words_are_compared(spark):
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(30):
        short = " ".join("".join(rng.choice(list("abcdef"), 2)) for _ in range(60))
        texts += [short, f"{short} tail", f"{short} else"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in op1_simhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == jaccard_classes(texts)
    assert set(got.values()) == set(range(0, 90, 3))


# --- 2, 3 ---


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@pytest.mark.parametrize("group_rows", [20_000, 25])
def test_packing(docs, rows, library, group_rows):
    got = op2_packing.pack_documents(docs, keep_ids=True, group_rows=group_rows).collect()
    want = {i: library["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids + [0] for i, t, *_ in rows}
    seen = {i: 0 for i in want}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == seen[r["doc_id"]] and r["ids"] == want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["length"] == 2048 or len(want[r["doc_id"]]) <= 2048 or r["piece"] == 0
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(x) for i, x in want.items()}
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    if group_rows > 1000:
        assert len(bins) <= -(-sum(map(len, want.values())) // 2048) + 2


def test_sum_of_squares():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 101, 3000), np.full(50, 51), np.array([100, 100, 1]), np.array([], np.int64)):
        bins, offsets = op2_packing.pack_lengths(lengths, 100)
        fill = np.bincount(bins, lengths, minlength=1)
        assert (fill <= 100).all()
        for b in np.unique(bins):
            o = np.sort(offsets[bins == b])
            assert o[0] == 0
    assert op2_packing.cut_lengths(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]
    assert op2_packing.cut_lengths(4096, 2048) == [(0, 2048), (2048, 2048)]


def naive_sum_of_squares(lengths, capacity):
    """Every level and its whole sum of squares; the fullest of the best."""
    bins, fill = [], []
    for s in lengths:
        options = {}
        for b, h in enumerate(fill):
            if h < capacity and h + s <= capacity and h not in options:
                after = [x + s if i == b else x for i, x in enumerate(fill)]
                open_ = [x for x in after if x < capacity]
                options[h] = (sum(open_.count(x) ** 2 for x in set(open_)), -h)
        if options:
            h = min(options, key=options.get)
            b = max(i for i, x in enumerate(fill) if x == h)
            fill[b] += s
        else:
            b = len(fill)
            fill.append(s)
        bins.append(h + s if options else s)
    return sorted(fill), bins


def test_sum_of_squares_is_naive_ones():
    rng = np.random.default_rng(8)
    for capacity in (10, 37):
        for _ in range(10):
            lengths = rng.integers(1, capacity + 1, 60)
            bins, offsets = op2_packing.sum_of_squares(lengths, capacity)
            fill, levels = naive_sum_of_squares(lengths.tolist(), capacity)
            assert sorted(np.bincount(bins, lengths).astype(int).tolist()) == fill
            assert (offsets + lengths).tolist() == levels


def test_frequent_lengths_table():
    rng = np.random.default_rng(3)
    words = list({"".join(rng.choice(list("abcdefgh"), int(n))) for n in rng.integers(1, 9, 3000)}) + ["überlänge", "x" * 16, "y" * 17]
    table = tokens.FrequentLengths(words[::2], [1 + len(w) % 9 for w in words[::2]])
    found = {}
    rest = table.look_up(words, found)
    assert found == {w: 1 + len(w) % 9 for w in words[::2] if len(w.encode()) <= 16}
    assert sorted(rest + list(found)) == sorted(words)
    assert tokens.FrequentLengths([], []).look_up(["a"], {}) == ["a"]


def test_token_counts(docs, rows, library):
    got = {r["doc_id"]: r["n_tokens"] for r in op3_token_counts.count_tokens(docs, table_size=50).collect()}
    assert got == {i: len(library["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows}


# --- 4, 5 ---


def test_classifiers_learn(spark):
    rng = np.random.default_rng(2)
    data = []
    for i in range(900):
        bad, junk = i % 3 == 0, i % 4 == 0
        w = list(rng.choice(WORDS, 80))
        if bad:
            w[int(rng.integers(80))] = ["grubby", "vile", "rotten"][i % 7 % 3]
        t = " ".join(w)
        data.append((i, "$$ ".join(w) if junk else t, ["en", "de"][i % 2], int(not junk), int(bad)))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, quality int, toxic int")
    docs, labels = df.select("doc_id", "text", "lang"), df.select("doc_id", "quality", "toxic")
    model = op4_toxicity.train(docs, labels, op4_toxicity.learns)
    got = {r["doc_id"]: r["score"] >= 0.7 for r in op4_toxicity.score(docs, model).collect()}
    held = [x for x in data if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert np.mean([got[x[0]] == bool(x[4]) for x in held]) > 0.9
    net = op5_quality.train(docs, labels, op5_quality.learns)
    got = {r["doc_id"]: r["score"] >= 0.3 for r in op5_quality.score(docs, net).collect()}
    held = [x for x in data if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert np.mean([got[x[0]] == bool(x[3]) for x in held]) > 0.95
    # Scores do not depend on batches, and long texts are scored whole.
    f = model.scorer()
    long = " ".join(["the"] * 300_000 + ["vile"])
    assert f([long])[0] > f([" ".join(["the"] * 300_000)])[0]
    assert np.allclose(f(["a b", "vile c", ""]), [f([x])[0] for x in ("a b", "vile c", "")])
    data_, offsets = op5_quality.flat(["x " * 5000, "", "y"])
    whole = net.logits(data_, offsets)
    for i, t in enumerate(["x " * 5000, "", "y"]):
        assert np.allclose(net.logits(*op5_quality.flat([t])), whole[i], atol=1e-4)
    junk_at_the_end = op5_quality.flat(["the of and to in a " * 3000 + "$$ %% " * 200])
    assert net.logits(*junk_at_the_end)[0] < net.logits(*op5_quality.flat(["the of and to in a " * 3000]))[0]


def test_toxicity_is_the_naive_convolution():
    """Filters slid by hand over the words' embeddings, their maxima through the logistic layer."""
    rng = np.random.default_rng(5)
    texts = [prose(rng, 30) + (" vile thing" if i % 3 == 0 else "") for i in range(200)]
    model = op4_toxicity.fit(pa.table({"text": texts, "label": pa.array([int(i % 3 == 0) for i in range(200)], pa.int32())}))
    net = model.net

    def naive(text):
        ids = [next((model.rows[k] for k in op4_toxicity.keys(w) if k in model.rows), 0) for w in op4_toxicity.words(text)] or [0]
        x = np.array([net.p["e"][i] for i in ids] + [net.p["e"][0]] * (max(net.widths) - 1), np.float64)
        h = []
        for w in net.widths:
            for f in range(net.filters):
                h.append(max(sum(float(x[t + o] @ net.p[f"w{w}"][o][:, f]) for o in range(w)) for t in range(len(ids))) + float(net.p[f"b{w}"][f]))
        z = sum(max(0.0, a) * float(v) for a, v in zip(h, net.p["v"], strict=True)) + float(net.p["c"][0])
        return 1 / (1 + np.exp(-np.clip(model.scale * (z - model.shift) + np.log(0.7 / 0.3), -30, 30)))

    some = [*texts[:5], "", "vile", "the vilest vile", "?!"]
    assert np.allclose(model.scorer()(some), [naive(t) for t in some], atol=1e-4)


def test_quality_is_the_naive_convolution():
    rng = np.random.default_rng(5)
    texts = [prose(rng, 30) if i % 2 else "$$ %% " * int(rng.integers(3, 40)) for i in range(80)]
    model = op5_quality.fit(pa.table({"text": texts, "label": pa.array([i % 2 for i in range(80)], pa.int32())}))
    p = model.net.p

    def naive(text):
        data = text.encode()
        step = op5_quality.CHUNK - op5_quality.OVERLAP
        chunks = [data[a : a + op5_quality.CHUNK].ljust(op5_quality.CHUNK, b"\0") for a in range(0, max(1, len(data) - op5_quality.OVERLAP), step)]
        units = []
        for c in chunks:
            x = p["e"][list(c)]
            pooled = [max(float(x[t : t + op5_quality.WIDTH].ravel() @ p["w"][:, f]) for t in range(0, op5_quality.CHUNK - op5_quality.WIDTH + 1, op5_quality.STRIDE)) + float(p["b"][f]) for f in range(op5_quality.FILTERS)]
            units.append(np.maximum(np.maximum(pooled, 0) @ p["h"] + p["d"], 0))
        z = float(np.concatenate([np.max(units, axis=0), np.mean(units, axis=0)]) @ p["v"] + p["c"][0])
        return 1 / (1 + np.exp(-np.clip(model.scale * (z - model.shift) + np.log(0.3 / 0.7), -30, 30)))

    some = [texts[0], texts[1], "", "x", prose(rng, 400), "é" * 300]
    assert np.allclose(model.probability(model.logits(*op5_quality.flat(some))), [naive(t) for t in some], atol=1e-3)


def test_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op4_toxicity.train(docs, none, op4_toxicity.learns) is None
    assert {r["score"] for r in op4_toxicity.score(docs, None).collect()} == {0.0}
    assert {r["score"] for r in op5_quality.score(docs, op5_quality.train(docs, none, op5_quality.learns)).collect()} == {0.0}


# --- 6 ---


@pytest.mark.parametrize("shard_rows", [4096, 7])
def test_top_k(spark, shard_rows):
    rng = np.random.default_rng(4)
    v = {i: list(map(float, rng.normal(size=4))) for i in range(120)}
    v[3] = v[4] = v[5] = [0.5, 0.5, 0.5, 0.5]
    bad = [(200, None), (250, []), (300, [1.0, None, 1.0, 1.0]), (350, [float("nan")] * 4), (400, [float("inf")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame([*v.items(), *bad, (500, [1.0, 2.0])], "vec_id long, embedding array<double>")
    q = op6_topk.quantise(df)
    got = sorted(map(tuple, op6_topk.top_k(q.where("id % 50 = 0"), q, shard_rows=shard_rows, block_rows=2).collect()))
    ints = {i: [int(np.floor(256 * x)) for x in e] for i, e in v.items()}
    want = []
    for i in (0, 50, 100):
        s = sorted((-sum(a * b for a, b in zip(ints[i], ints[j], strict=True)), j) for j in ints if j != i)
        want += [(i, r, j, -x) for r, (x, j) in enumerate(s[:5], 1)]
    assert got == want
    assert op6_topk.top_k(q.limit(0), q).count() == 0


def test_exact_products():
    q, m = np.array([[2.0**60, 1.0]]), np.array([[2.0**60, 3.0], [1.0, 2.0]])
    assert op6_topk._product(q, m).tolist() == [[2**63 - 1, 2**60 + 2]]


# --- 7 ---


def repeats(rows, length=50):
    out, seen = {}, {}
    for i, t, *_ in rows:
        x = (t or "").encode()
        for k in range(len(x) - length + 1):
            seen.setdefault(x[k : k + length], i)
    for i, t, *_ in rows:
        x = (t or "").encode()
        g = np.zeros(len(x), bool)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] < i:
                g[k : k + length] = True
        out[i] = (len(x), int(g.sum()), int((np.diff(np.concatenate([[False], g])) & g).sum()), hashlib.sha256(np.frombuffer(x, np.uint8)[~g].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup(docs, rows, small):
    how = {"part_bytes": 300, "bucket_bytes": 5000, "shard_bytes": 20_000} if small else {}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op7_suffix_dedup.remove_repeats(docs, **how).collect()}
    assert got == repeats(rows)
    assert sum(x[1] for x in got.values()) > 1000


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for n, letters in ((1, 2), (2, 1), (60, 1), (500, 2), (2000, 4), (1500, 250)):
        d = rng.integers(0, letters, n).astype(np.uint8)
        b = d.tobytes()
        sa = op7_suffix_dedup.suffix_array(d, 50)
        assert sorted(sa.tolist()) == list(range(n))
        lcp = op7_suffix_dedup.common_prefixes(d, sa, 50, lanes=5)
        for i in range(1, n):
            x, y = b[sa[i - 1] : sa[i - 1] + 50], b[sa[i] : sa[i] + 50]
            k = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert lcp[i] == k


def test_merge_of_parts():
    rng = np.random.default_rng(5)
    contexts = list({bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(8, 20, 200)})
    owners = rng.integers(0, 1000, len(contexts))
    first = {}
    for c, o in zip(contexts, owners.tolist(), strict=True):
        for k in range(len(c) - 7):
            first[c[k : k + 8]] = min(o, first.get(c[k : k + 8], o))
    want = [first[c[k : k + 8]] for c in contexts for k in range(len(c) - 7)]
    for size in (10, 100, 10**6):
        assert op7_suffix_dedup.smallest_owners(contexts, owners, 8, size).tolist() == want


def test_strings_of_large_parts_take_no_index():
    """Of several parts of a shard every distinct window is kept: 50 bytes each, without a number for each of these."""
    import tracemalloc

    data = np.random.default_rng(2).integers(0, 250, 200_000).astype(np.uint8)
    valid = np.arange(len(data)) + 50 <= len(data)
    tracemalloc.start()
    try:
        _, strings, _ = op7_suffix_dedup.window_classes(data, valid, np.zeros(len(data), np.int64), 50)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    b = data.tobytes()
    assert [x.ljust(50, b"\0") for x in strings.tolist()] == sorted(b[i : i + 50] for i in range(len(b) - 49))
    assert most < 200 * len(data)


# --- 8 ---


@pytest.mark.parametrize("compression", [op8_tiff.NONE, op8_tiff.LZW, op8_tiff.DEFLATE, op8_tiff.OLD_DEFLATE, op8_tiff.PACKBITS])
@pytest.mark.parametrize("tile", [None, (16, 16), (64, 32)])
def test_tiff_roundtrip(compression, tile):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 4, (5, 7)), rng.integers(0, 256, (100, 130, 3)), np.zeros((70, 90)), np.ones((1, 1))]
    pages = [p.astype(np.uint8) for p in pages]
    for order in "<>":
        for predictor in (1, 2):
            raw = op8_tiff.encode(pages, compression, predictor, tile, 10, order)
            assert [p.data for p in op8_tiff.decode(raw)] == [p.tobytes() for p in pages]


def test_known_lzw_and_packbits():
    # The example of the format's specification: 7 7 7 8 8 7 7 6 6 as codes 256 7 258 8 8 258 6 6 257.
    codes = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    packed = bytes(int(codes.ljust(-(-len(codes) // 8) * 8, "0")[i : i + 8], 2) for i in range(0, len(codes), 8))
    assert op8_tiff.lzw_decode(packed, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and op8_tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == packed
    raw = bytes.fromhex("FEAA028000 2AFDAA03800 02A22F7AA".replace(" ", ""))
    assert op8_tiff.packbits_decode(raw, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA8000 2A22AAAAAAAAAAAAAAAAAAAA".replace(" ", ""))


def test_tiff_pages(spark, docs, rows):
    good = op8_tiff.encode([np.zeros((3, 4), np.uint8), np.ones((2, 2, 3), np.uint8)])
    ring = bytearray(good)
    media = [(1, good), (2, None), (3, b"II*\0"), (4, good[:-20]), (5, b""), (6, b"MM\0*\0\0\0\xff")]
    ring[-4:] = ring[4:8]
    media.append((7, bytes(ring)))
    hostile = [bytearray(op8_tiff.encode([np.zeros((3, 4), np.uint8)])) for _ in range(3)]
    at = int.from_bytes(hostile[0][4:8], "little") + 2
    hostile[0][at + 4 : at + 8] = bytes(4)  # a field without values
    hostile[1][at + 2 : at + 4], hostile[1][at + 8 : at + 12] = (9).to_bytes(2, "little"), (-5).to_bytes(4, "little", signed=True)  # a negative width
    hostile[2][at + 8 : at + 12] = (2**31).to_bytes(4, "little")
    media += [(8 + i, bytes(x)) for i, x in enumerate(hostile)]
    got = op8_tiff.tiff_pages(spark.createDataFrame(media, "id long, media binary")).collect()
    assert [(r["page"], r["width"], r["height"], r["samples"]) for r in got if r["id"] == 1] == [(0, 4, 3, 1), (1, 2, 2, 3)]
    assert {r["id"] for r in got if r["error"]} == set(range(2, 11))
    for r in op8_tiff.digests(docs).collect():
        data = (rows[r["doc_id"]][1] or "").encode()
        full = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))


# --- 9 ---


def test_urls(spark):
    urls = [None, "", "no scheme", "http://Example.ORG/es/1?x=/en/1", "https://a.example.org/en/12", "ftp://example.org", "x://example.org?q", "http://myexample.org/es/", "http://b.com/fr/1#f", "http://b.com/de/", "http://com/de/x", "http://c.net/a/b/c/d/e"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in op9_url_filter.judge(df).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("example.org", "/es/1", "example.org/es/"), ("a.example.org", "/en/12", "example.org/en/1"), ("example.org", "", None), ("example.org", "", None),
        ("myexample.org", "/es/", "org/"), ("b.com", "/fr/1", "com/fr/"), ("b.com", "/de/", "com/de/"), ("com", "/de/x", "com/de/"), ("c.net", "/a/b/c/d/e", None),
    ]
    assert {got[i]["verdict"] for i in (3, 4, 9, 10)} == {"block"} and {got[i]["verdict"] for i in (7, 8)} == {"allow"}


def test_templates_generalise_and_reject(spark):
    urls = [f"http://h.com/de/x{i}/a" for i in range(40)] + [f"http://h.com/en/{i}" for i in range(40)] + [f"http://h.com/de2/x{i}/a" for i in range(2)]
    rules = (("block", "h.com/de/x1"), ("block", "h.com/de/x2"), ("block", "h.com/de/x3"), ("allow", "h.com/en/1"))
    got = {r["path"]: r for r in op9_url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got["/de/x5/a"]["template"] == "h.com/de/*/a" and got["/en/7"]["template"] == "h.com/en/*"
    assert got["/de/x5/a"]["verdict"] == "block" and got["/en/7"]["verdict"] == "allow"


def test_templates_of_any_depth(spark):
    """Branches that differ from the sixth segment on only, alike siblings that become one branch, and a path without end."""
    deep = "http://h.com/a/b/c/d/e"
    urls = [f"{deep}/{s}/x{i}" for s in ("bad1", "bad2", "good") for i in range(30)] + ["http://h.com" + "/z" * 300, "http://h.com" + "/z" * 299]
    rules = (("block", "h.com/a/b/c/d/e/bad1/x1"), ("block", "h.com/a/b/c/d/e/bad2/x1"), ("allow", "h.com/a/b/c/d/e/good/x1"))
    got = {r["path"]: r for r in op9_url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert len(got) == len(urls)
    assert {got[f"/a/b/c/d/e/{s}/x{i}"]["verdict"] for s in ("bad1", "bad2") for i in (5, 25)} == {"block"}
    assert got["/a/b/c/d/e/good/x5"]["verdict"] == "allow"
    assert got["/a/b/c/d/e/bad1/x5"]["template"] == got["/a/b/c/d/e/bad2/x9"]["template"] == "h.com/a/b/c/d/e/bad1|bad2/*"


def test_urls_stay_native(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.com/fr/1")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    plan = op9_url_filter.op9_url_filter(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# --- 10 ---


@pytest.fixture(scope="module")
def vocabulary():
    return op10_sentencepiece.Vocabulary(public_tokenizers.path(op10_sentencepiece.MODEL))


def segmentations(v, data, at=0):
    known = {x: i for i, x in v.text.items() if v.byte_ids[x[0]] != i}
    if at == len(data):
        yield ()
    for end in range(at + 1, len(data) + 1):
        if data[at:end] in known:
            for rest in segmentations(v, data, end):
                yield (known[data[at:end]], *rest)


def test_sampling_is_exact(vocabulary):
    every = list(segmentations(vocabulary, b" the"))
    w = np.array([sum(vocabulary.weight[i] for i in s) for s in every])
    p = np.exp(w - w.max())
    p /= p.sum()
    n = 4000
    got = op10_sentencepiece.sample(vocabulary, ["the"] * n, [op10_sentencepiece.row_key(i) for i in range(n)], 2)
    place = {s: i for i, s in enumerate(every)}
    first = np.bincount([place[tuple(r[0][0].tolist())] for r in got], minlength=len(every))
    assert (np.abs(first - n * p) <= 5 * np.sqrt(n * p * (1 - p) + 1)).all()
    second = np.bincount([place[tuple(r[1][0].tolist())] for r in got], minlength=len(every))
    q = np.array([sum(p[i] * p[j] / (1 - p[i]) for i in range(len(p)) if i != j) for j in range(len(p))])
    assert (np.abs(second - n * q) <= 5 * np.sqrt(n * q + 1)).all()
    assert all(abs(r[0][1] - np.log(p[place[tuple(r[0][0].tolist())]])) < 1e-9 for r in got[:50])
    assert abs(np.mean([sum(np.exp(lp - inc) for _, lp, inc in r) for r in got]) - 1) < 0.01  # inclusion scores weigh samples without bias


def test_long_runs_are_sampled_like_others(vocabulary, monkeypatch):
    texts = ["ab" * 400, "the of and " * 5 + "zyx" * 300, "日本語" * 300]
    keys = [op10_sentencepiece.row_key(i) for i in range(3)]
    walked = op10_sentencepiece.sample(vocabulary, texts, keys, 3)
    monkeypatch.setattr(op10_sentencepiece, "LONG_CHUNK", 1 << 30)
    for a, b in zip(walked, op10_sentencepiece.sample(vocabulary, texts, keys, 3), strict=True):
        assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b]
        assert np.allclose([x[1:] for x in a], [x[1:] for x in b], rtol=1e-9)


def test_few_segmentations(vocabulary):
    n = len(list(segmentations(vocabulary, b" of")))
    (got,) = op10_sentencepiece.sample(vocabulary, ["of"], [1], n + 5)
    assert len({tuple(x[0].tolist()) for x in got}) == len(got) == n and all(x[2] == 0 for x in got)
    assert abs(sum(np.exp(x[1]) for x in got) - 1) < 1e-9


def test_sampled_rows(docs, rows, vocabulary):
    got = op10_sentencepiece.sampled(docs, 3).collect()
    again = {(r["doc_id"], r["sample"]): r["ids_crc32"] for r in op10_sentencepiece.sampled(docs.repartition(1), 3).collect()}
    per = {}
    for r in got:
        assert vocabulary.decode(r["ids"]) == (rows[r["doc_id"]][1] or "")
        assert again[r["doc_id"], r["sample"]] == r["ids_crc32"]
        assert r["restored"] and r["text_crc32"] == zlib.crc32((rows[r["doc_id"]][1] or "").encode())
        per.setdefault(r["doc_id"], []).append(tuple(r["ids"]))
    assert set(per) == {i for i, *_ in rows} and all(len(set(x)) == len(x) for x in per.values())


def test_samples_of_texts_that_the_library_rewrites(spark):
    """U+2581 comes back as a blank, which the query says by its CRC and still counts as restored."""
    docs = spark.createDataFrame([(1, "a\u2581b"), (2, " lead and  two "), (3, "\n\u2581"), (4, "\U0001f600 x\u0000y")], "doc_id long, text string")
    want = {1: "a b", 2: " lead and  two ", 3: "\n ", 4: "\U0001f600 x\u0000y"}
    got = op10_sentencepiece.sampled(docs, 2).collect()
    assert {r["doc_id"] for r in got} == set(want)
    assert all(r["restored"] and r["text_crc32"] == zlib.crc32(want[r["doc_id"]].encode()) for r in got)


def test_encode_and_decode(docs, rows):
    ids = op10_sentencepiece.encoded(docs)
    back = {r["doc_id"]: r["text"] for r in op10_sentencepiece.decoded(ids).collect()}
    assert back == {i: t or "" for i, t, *_ in rows}


# --- awkward tables ---


OPERATORS = {
    "simhash": op1_simhash.components,
    "near": op1_simhash.drop_near_duplicates,
    "packing": op2_packing.pack_documents,
    "tokens": op3_token_counts.count_tokens,
    "toxicity": lambda d: op4_toxicity.score(d, op4_toxicity.fit(SAMPLE)),
    "quality": lambda d: op5_quality.score(d, op5_quality.fit(SAMPLE)),
    "topk": lambda d: op6_topk.top_k(*[op6_topk.quantise(d.withColumn("embedding", F.array(F.length("text").cast("double"))).where("doc_id is not null and text is not null"), "doc_id")] * 2, k=1),
    "repeats": op7_suffix_dedup.remove_repeats,
    "repeats alone": lambda d: op7_suffix_dedup.remove_repeats(d, with_digests=False),
    "tiff": op8_tiff.digests,
    "pages": lambda d: op8_tiff.tiff_pages(d, "text", "doc_id"),
    "urls": lambda d: op9_url_filter.judge(d, id_column="doc_id", url="text"),
    "sampled": op10_sentencepiece.sampled,
    "encoded": op10_sentencepiece.encoded,
}
KEEPING = {"near", "tokens", "toxicity", "quality", "repeats", "repeats alone"}
SAMPLE = pa.table({"text": ["good words here"] * 20 + ["bad $$ junk"] * 20, "label": pa.array([1] * 20 + [0] * 20, pa.int32())})


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd, name):
    got = OPERATORS[name](odd)
    n = got.count()
    assert n >= {"near": 19, "topk": 19}.get(name, odd.count())
    if name in KEEPING:
        assert set(odd.columns) <= set(got.columns)
        made = {"tokens": {"n_tokens"}, "toxicity": {"score", "cut"}, "quality": {"score"}, "repeats": set(op7_suffix_dedup.DIGESTS)}.get(name, set())
        assert {tuple(r) for r in got.select(*[c for c in CLASHES if c not in made]).distinct().collect()} == {("clash",) * (len(CLASHES) - len(made))}
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_names_that_need_quotes(spark):
    df = spark.createDataFrame([(1, "some words to count"), (2, "http://a.org/x")], "`doc id` long, `the text` string")
    how = {"id_column": "doc id", "column": "the text"}
    for f in (op1_simhash.components, op1_simhash.drop_near_duplicates, op2_packing.pack_documents, op8_tiff.digests, op10_sentencepiece.sampled, op10_sentencepiece.encoded):
        assert f(df, **how).select("doc id").distinct().count() == 2
    assert op7_suffix_dedup.remove_repeats(df, **how).columns[:2] == ["doc id", "the text"]
    assert {r["host"] for r in op9_url_filter.judge(df, id_column="doc id", url="the text").collect()} == {"", "a.org"}


def test_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.range(300).select(F.lit(5).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(5, 1)], "doc_id int, toxic int")
    assert common.labelled_sample(docs, labels, "toxic", lambda key: F.lit(True), 7).num_rows == 7


def test_hot_keys_join_like_others(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), "id")
    named = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = {r["id"]: r["low"] for r in common.join_spread(rows, named, ["k"], "n", 3000).collect()}
    assert got == {i: (0 if i < 1500 else i) for i in range(3000)}


def test_workers_drop_what_other_operators_kept():
    """Workers live on: the token cache of one stage must not take memory in the others."""
    run = lambda **how: list(common.tidied(lambda batches: batches, **how)(iter([1])))
    cache = tokens.worker_cache(tokens.PreTokenCache, public_tokenizers.path(op2_packing.MODEL), "byte_bpe")
    assert run(keeps=True) == [1] and cache in common.KEPT.values()
    assert run() == [1] and not common.KEPT


def test_tighter_bounds_of_batches_stay(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for now, want in (("1000", "1000"), ("64MB", str(common.BATCH_BYTES)), (str(1 << 30), str(common.BATCH_BYTES))):
            spark.conf.set(name, now)
            common.bounded_batches(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_shared_folder_is_used(spark):
    assert common.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_near_duplicates_by_fingerprint(spark, monkeypatch):
    """Near copies whose fingerprints link are found without any band, and an exact check follows."""
    import random

    import numpy as np

    pick = random.Random(4)
    word = lambda: f"w{pick.randrange(10**6)}"
    texts = []
    while len(texts) < 24:
        words = [word() for _ in range(400)]
        other = " ".join([*words[:200], word(), *words[201:]])
        first, second = (op1_simhash.fingerprint(op1_simhash.shingle_hashes(x.encode())) for x in (" ".join(words), other))
        if 0 < (first ^ second).bit_count() <= 3:
            texts += [" ".join(words), other]
    # The same fingerprint by one line that comes again and again, but other words behind it.
    line = "one line of just seven plain words " * 200
    texts += [line + " ".join(word() for _ in range(40)) for _ in range(2)]
    assert len({op1_simhash.fingerprint(op1_simhash.shingle_hashes(x.encode())) for x in texts[-2:]}) == 1
    monkeypatch.setattr(op1_simhash, "near_bands", lambda h, by: np.arange(32, dtype=np.int64) + h.sum().astype(np.int64))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in op1_simhash.drop_near_duplicates(docs).collect()}
    assert kept == {*range(0, 24, 2), 24, 25}
