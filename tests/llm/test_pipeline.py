"""The pipeline's stages on the smallest tables, each against a brute-force version of what it must do."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from blockloom.llm import op2_packing, op4_toxicity, op5_quality
from blockloom.llm.common import stash, table

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no driver tables here")
EXTRA = "score cut n_bytes n_removed n_spans kept_sha256 _bucket its_id rest bucket order".split()


def by_hand(name, spark, docs, rows):
    """doc_id -> text of what a stage must leave, one document at a time and all pairs compared."""
    if name == "toxicity":
        model = op4_toxicity.train(docs, table(spark, D, "labels"), op4_toxicity.learns)
        score = model.scorer() if model else lambda x: [0.0]
        cut = model.cuts if model else {"": op4_toxicity.AT}
        return {r["doc_id"]: r["text"] for r in rows if score([r["text"] or ""])[0] < cut.get(r["lang"], cut[""])}
    if name == "quality":
        model = op5_quality.train(docs, table(spark, D, "labels"), op5_quality.learns)
        return {r["doc_id"]: r["text"] for r in rows if model is None or model.probability(model.logits(*op5_quality.flat([r["text"]])))[0] >= op5_quality.AT}
    if name == "near_dedup":
        rows = sorted(rows, key=lambda r: r["doc_id"])
        words = [(r["text"] or "").encode().lower().split() for r in rows]
        sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
        root = list(range(len(rows)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if (not sets[i] and not sets[j]) or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        return {rows[i]["doc_id"]: rows[i]["text"] for i in range(len(rows)) if find(i) == i}
    seen, left = set(), {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        data = (r["text"] or "").encode()
        gone = bytearray(len(data))
        mine = {data[k : k + 50] for k in range(len(data) - 49)}
        for k in range(len(data) - 49):
            if data[k : k + 50] in seen:
                gone[k : k + 50] = b"x" * 50
        seen |= mine
        left[r["doc_id"]] = bytes(c for c, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")
    return left


def test_stages(spark):
    docs = table(spark, D, "documents").withColumns({c: F.lit("mine") for c in EXTRA})
    columns = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "substring_dedup", "packing"]
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.collect()
        want = by_hand(name, spark, docs, before)
        docs = stash(stage(spark, docs, D))
        assert docs.columns == columns
        now = docs.collect()
        assert {r["doc_id"]: r["text"] for r in now} == want and len(now) == len(want)
        assert all(r[c] == "mine" for r in now for c in EXTRA)
        if name in ("toxicity", "quality", "near_dedup"):
            assert len(now) >= 0.6 * len(before)
        if name == "substring_dedup":
            assert all(r["n_chars"] == len(r["text"]) for r in now)
    from tokenizers import Tokenizer

    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path(op2_packing.MODEL))
    places = {}
    for r in pipeline.packing(spark, docs, D).collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["doc_id"]))
    tokens = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in now}
    total = {}
    for parts in places.values():
        at = 0
        for offset, n, i in sorted(parts):
            assert offset == at
            at, total[i] = at + n, total.get(i, 0) + n
        assert at <= 2048
    assert total == tokens


def test_empty(spark):
    docs = table(spark, D, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, D).count() == 0


def test_odd_rows(spark):
    """Nulls in every column, blanks, a very long text, repeated ids with the same and with other texts."""
    schema = table(spark, D, "documents").schema
    rows = [(None,) * 5, (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "some words that are here " * 20_000, "en", "s", 5), (4, " \n ", "de", "s", 3), (4, "other words", "de", "s", 3)]
    docs = spark.createDataFrame([tuple(r[["doc_id", "text", "lang", "source", "n_chars"].index(f.name)] for f in schema) for r in rows], schema)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, D))
        assert docs.columns == schema.names, name
    assert pipeline.packing(spark, docs, D).count() >= docs.count()


def test_stages_bound_batches(spark):
    """Each stage by itself bounds its batches to what the pipeline allows, whatever the session had before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, docs = spark.conf.get(name), table(spark, D, "documents").limit(30)
    try:
        for _, stage in pipeline.STAGES:
            spark.conf.set(name, str(64 << 20))
            stage(spark, docs, D)
            assert int(spark.conf.get(name)) <= 2 << 20
    finally:
        spark.conf.set(name, before)
