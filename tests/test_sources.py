import json
import struct

import pytest
from pyspark.sql import functions as F

from blockloom.cli import run
from blockloom.operators import blocks as B
from blockloom.operators import classify as C
from blockloom.sources import archive as A
from blockloom.sources import gguf, ranged, safetensors
from blockloom.streaming import arrivals


def files(spark, rows):
    return spark.createDataFrame([(i, p, len(c), c) for i, (p, c) in enumerate(rows)], "file_id long, path string, size long, content binary")


ROWS = [("a/x.bin", b"B" * 5000), ("a/y.bin", b"B" * 5000), ("config.json", b"{}"), ("empty", b""), ("ünï.txt", "grüße".encode() * 300)]


def test_archive(spark, tmp_path):
    A.pack(files(spark, ROWS), f"{tmp_path}/a", 1024)
    a = A.Archive(spark, f"{tmp_path}/a")
    assert a.manifest()["deduplication"]["duplicate_blocks"] == 8
    assert a.blocks.where("dedup_ref >= 0 and payload is not null").count() == 0
    assert a.list_files() == sorted(p for p, _ in ROWS)
    for p, c in ROWS:
        assert a.read_file(p) == c
        for o, n in ((0, 10), (1000, 2048), (4990, 100), (9999, 5), (3, 0)):
            assert a.read_file_range(p, o, n) == c[o : o + n]
    with pytest.raises(ValueError):
        a.read_file_range("empty", -1, 2)
    with pytest.raises(KeyError):
        a.read_file("none")
    assert a.verify()["integrity"] == "OK" and a.verify(full=False)["integrity"] == "OK"
    assert a.unpack(f"{tmp_path}/out", ["a/*", "*.json"]) == 3
    assert (tmp_path / "out/a/y.bin").read_bytes() == b"B" * 5000
    # A second version against it.
    new = [("a/x.bin", b"B" * 4096 + b"C" * 100), ("a/z.bin", b"B" * 5000), ("new", b"n" * 10)]
    A.pack(files(spark, new), f"{tmp_path}/b", 1024, base=f"{tmp_path}/a")
    b = A.Archive(spark, f"{tmp_path}/b", f"{tmp_path}/a")
    assert b.blocks.where("payload is not null").count() == 2
    assert {r["path"]: (bytes(r["data"]), r["ok"]) for r in b.read_files().collect()} == {p: (c, True) for p, c in new}
    # One file, read back through the data source.
    size = A.write_single(a, f"{tmp_path}/one.blk")
    assert size < 8000  # of which the manifest is most
    A.register(spark)
    df = spark.read.format("blockarchive").load(f"{tmp_path}/one.blk")
    whole = B.reconstruct(df.withColumn("file_id", F.lit(0)))
    assert {r["path"]: bytes(r["data"]) for r in whole.collect()} == {p: c for p, c in ROWS if c}
    assert df.where(F.col("path") == "a/y.bin").count() == 5 and df.count() == 14
    assert spark.read.format("blockarchive").option("only", '["a/y.bin"]').load(f"{tmp_path}/one.blk").count() == 5


def test_single_file_index(spark, tmp_path, monkeypatch):
    """More blocks than a manifest may name: the index is read in sections, its head stays small, and damage is found."""
    rows = [(f"d/{i:02}", bytes([i]) * (40 * i)) for i in range(30)] + [("e", b"B" * 5000), ("f", b"B" * 5000)]
    A.pack(files(spark, rows), f"{tmp_path}/a", 16, codec="raw")
    monkeypatch.setattr(A, "MOST_MANIFEST", 20_000)  # all blocks listed in one manifest take some 700 kB
    path = f"{tmp_path}/one.blk"
    A.write_single(A.Archive(spark, f"{tmp_path}/a"), path)
    manifest, start = A.read_single_manifest(path)
    assert "files" not in manifest and manifest["total_files"] == 32 and start < 2000
    monkeypatch.undo()
    sections = A.read_single_directory(path, start)
    listed = [f for s in sections for f in A.read_single_section(path, s)]
    assert {f["path"]: f["size"] for f in listed} == {p: len(c) for p, c in rows}
    A.register(spark)
    df = spark.read.format("blockarchive").option("partition_bytes", "100").load(path)
    whole = B.reconstruct(df.withColumn("file_id", F.lit(0)))
    assert {r["path"]: bytes(r["data"]) for r in whole.collect()} == {p: c for p, c in rows if c}
    assert df.count() == sum(-(-len(c) // 16) for _, c in rows)
    assert spark.read.format("blockarchive").option("only", '["e", "d/03"]').load(path).count() == 313 + 8
    raw = (tmp_path / "one.blk").read_bytes()
    for bad in (raw[:-1], raw[:start], raw[:-16] + struct.pack(">Q", 1 << 40) + A.END, raw[:-17] + b"x" + raw[-16:]):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(A.ArchiveError):
            A.read_single_directory(f"{tmp_path}/bad", start)
    at = sections[0]["offset"] + 20
    (tmp_path / "bad").write_bytes(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
    with pytest.raises(A.ArchiveError):
        A.read_single_section(f"{tmp_path}/bad", sections[0])


def test_single_file_sections():
    """Sections end after so many rows; a file of more blocks goes on in the next."""
    import zlib

    import pyarrow as pa

    rows = [{"path": "a", "block": {"index": i, "compressed_size": 1}} for i in range(A.SECTION_ROWS + 5)] + [{"path": "b", "block": None}]
    made = [r for b in A._sections(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
    assert [(r["first"], r["last"], r["payloads"]) for r in made] == [("a", "a", A.SECTION_ROWS), ("a", "b", 5)]
    named = [(f["path"], b["index"]) for r in made for f in json.loads(zlib.decompress(r["data"]))["files"] for b in f["blocks"]]
    assert named == [("a", i) for i in range(A.SECTION_ROWS + 5)]


def test_single_file_of_older_versions(spark, tmp_path):
    """A manifest that lists all blocks itself is still read, duplicates by the payload of their first block."""
    import hashlib

    block = {"index": 0, "id": 0, "original_size": 5, "content_sha256": "s", "codec": "raw", "metadata": "{}", "compressed_size": 5, "hash": hashlib.sha256(b"hello").hexdigest(), "offset": 0, "dedup_ref": -1}
    again = block | {"id": 1, "codec": None, "metadata": None, "compressed_size": None, "hash": None, "offset": None, "dedup_ref": 0}
    body = json.dumps({"version": 7, "files": [{"path": "a", "blocks": [block]}, {"path": "b", "blocks": [again]}, {"path": "c", "blocks": []}]}).encode()
    (tmp_path / "old.blk").write_bytes(A.MAGIC + struct.pack(">Q", len(body)) + body + b"hello")
    A.register(spark)
    got = spark.read.format("blockarchive").load(f"{tmp_path}/old.blk").collect()
    assert sorted((r["path"], bytes(r["data"])) for r in got) == [("a", b"hello"), ("b", b"hello")]


def test_hostile_archives(spark, tmp_path):
    for bad in ([("../x", b"a")], [("/x", b"a")], [("a//b", b"a")], [("C:x", b"a")], [("a", b"1"), ("a", b"2")], [("a\x01", b"a")], [(" ", b"a")]):
        with pytest.raises(A.ArchiveError):
            A.pack(files(spark, bad), f"{tmp_path}/bad")
    for i, raw in enumerate((b"", b"x" * 40, A.MAGIC + struct.pack(">Q", 1 << 40), A.MAGIC + struct.pack(">Q", 50) + b"{}", A.MAGIC + struct.pack(">Q", 2) + b"{]")):
        (tmp_path / f"h{i}").write_bytes(raw)
        with pytest.raises(A.ArchiveError):
            A.read_single_manifest(f"{tmp_path}/h{i}")


def test_verify_finds_damage(spark, tmp_path):
    A.pack(files(spark, ROWS), f"{tmp_path}/a", 1024)
    for how, error in ((F.concat("payload", F.lit(b"x")), "payload checksum differs"),):
        a = A.Archive(spark, f"{tmp_path}/a")
        a.blocks = a.blocks.withColumn("payload", F.when(F.col("path") == "config.json", how).otherwise(F.col("payload")))
        got = a.verify(full=False)
        assert got["integrity"] == "FAILED" and error in got["errors"]
    a = A.Archive(spark, f"{tmp_path}/a")
    a.blocks = a.blocks.withColumn("dedup_ref", F.when(F.col("dedup_ref") >= 0, F.lit(10**9)).otherwise(F.col("dedup_ref")))
    assert "dedup reference missing" in a.verify(full=False)["errors"]
    a = A.Archive(spark, f"{tmp_path}/a")
    a.blocks = a.blocks.withColumn("codec", F.when(F.col("path") == "config.json", F.lit("evil")).otherwise(F.col("codec")))
    assert "unknown codec" in a.verify()["errors"]


def test_safetensors(spark, tmp_path):
    good = safetensors.build([("w", "F32", [2, 2], b"\0" * 16), ("b.lora_A.weight", "F16", [4], b"\1" * 8)], {"format": "pt"})
    bad = [("short", b"abc"), ("huge", struct.pack("<Q", 10**9) + b"{"), ("beyond", struct.pack("<Q", 500) + b"{}"), ("list", struct.pack("<Q", 2) + b"[]"), ("json", struct.pack("<Q", 3) + b"{,}"), ("zeros", b"\0" * 1000)]
    f = files(spark, [("good", good), *bad])
    h = {r["path"]: r for r in safetensors.headers(f).collect()}
    assert h["good"]["error"] is None and h["good"]["header_size"] == 8 + int.from_bytes(good[:8], "little")
    assert all(h[p]["error"] for p, _ in bad)
    t = {r["name"]: r for r in safetensors.tensors(f).collect()}
    assert set(t) == {"w", "b.lora_A.weight"} and t["w"]["n_params"] == 4 and t["b.lora_A.weight"]["byte_offset"] == 16
    s = safetensors.summary(f).first()
    assert (s["tensor_count"], s["total_bytes"], s["dtypes"], s["largest"]) == (2, 24, ["F16", "F32"], "w")
    A.pack(files(spark, [("m.safetensors", good)]), f"{tmp_path}/a", 16)
    assert A.Archive(spark, f"{tmp_path}/a").read_tensor("m.safetensors", "b.lora_A.weight") == b"\1" * 8


def test_gguf(spark):
    rows = [("token_embd.weight", [4, 4], 0, 0), ("output.weight", [4, 4], 14, 64), ("odd", [4], 999, 0)]
    for order, name in (("<", "little"), (">", "big")):
        got = gguf.parse(gguf.build(rows, 3, 3, order))
        assert got["endianness"] == name and got["tensor_count"] == 3 and not got["warnings"]
        assert [t["ggml_type"] for t in got["tensors"]] == ["F32", "Q6_K", "999"]
        assert [t["estimated_size"] for t in got["tensors"]] == [64, 210, None]
    assert gguf.parse(gguf.build(rows, version=1))["tensors"] == []
    assert gguf.parse(gguf.build(rows, claim=5))["warnings"] == ["cut off"]
    for magic in gguf.FIXTURE_MAGICS:
        raw = gguf.build(rows, 0, 2, gguf.FIXTURE_MAGICS[magic], magic)
        assert len(gguf.parse(raw, fixtures=True)["tensors"]) == 3
        with pytest.raises(gguf.GgufError):
            gguf.parse(raw)
    for bad in (b"", b"GGUF", b"XXXX" + b"\0" * 40, b"GGUF" + struct.pack("<I", 9) + b"\0" * 40):
        with pytest.raises(gguf.GgufError):
            gguf.parse(bad)
    df = {r["path"]: r for r in gguf.read(files(spark, [("ok", gguf.build(rows, 2)), ("no", b"zip")])).collect()}
    assert len(df["ok"]["tensors"]) == 3 and df["no"]["error"]


def test_globs_and_formats(spark):
    df = spark.createDataFrame([("a/b/model.safetensors",), ("c.TXT",), ("x.bin",)], "path string")
    pick = lambda p: {r["path"] for r in df.where(C.matches(F.col("path"), p)).collect()}
    assert pick("*.safetensors") == {"a/b/model.safetensors"} and pick("a/*") == {"a/b/model.safetensors"} and pick("?.bin") == {"x.bin"} and pick("[!x].*") == {"c.TXT"}
    for p in ("/a", "../a", "a/../b"):
        with pytest.raises(ValueError):
            C.check_pattern(p)
    head = spark.createDataFrame([("x.bin", b"\x80\x02aa"), ("y.bin", b"zz")], "path string, content binary")
    assert {r["path"]: r["f"] for r in head.select("path", C.file_format(F.col("path"), F.col("content")).alias("f")).collect()} == {"x.bin": "pytorch_bin", "y.bin": "unknown"}


def test_running_total_with_empty_and_ties(spark):
    rows = spark.createDataFrame([(i % 3, i, 1) for i in range(50)], "a int, b int, n int")
    got = [r["s"] for r in B.running_total(rows, ["a", "b"], "n", "s").orderBy("a", "b").collect()]
    assert got == list(range(50))
    assert B.running_total(rows.limit(0), ["a", "b"], "n", "s").count() == 0


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "config.json").write_text("{}")
    (src / "sub/data.bin").write_bytes(b"z" * 3000)
    (src / "model.safetensors").write_bytes(safetensors.build([("w", "F32", [2], b"\0" * 8)]))
    assert run(["pack", str(src), f"{tmp_path}/a", "-b", "1024"], spark) == 0
    assert run(["verify", f"{tmp_path}/a"], spark) == 0
    assert run(["unpack", f"{tmp_path}/a", f"{tmp_path}/out"], spark) == 0
    assert (tmp_path / "out/sub/data.bin").read_bytes() == b"z" * 3000
    capsys.readouterr()
    assert run(["list", f"{tmp_path}/a"], spark) == 0
    assert json.loads(capsys.readouterr().out) == ["config.json", "model.safetensors", "sub/data.bin"]
    assert run(["inspect", str(src), "--tensors"], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["files"]["config.json"] == "config" and got["safetensors"][0]["tensor_count"] == 1
    assert run(["pack-lora", str(src), f"{tmp_path}/l"], spark) == 1
    assert run(["pack-checkpoint", str(src), f"{tmp_path}/c"], spark) == 0
    assert run(["bench", str(src)], spark) == 0


def test_stream_of_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1").write_bytes(b"q" * 2000)
    out = (f"{tmp_path}/out", f"{tmp_path}/state")
    stream = lambda: arrivals.new_contents(arrivals.file_stream(spark, str(src)), 500).select("content_sha256", "block_size")
    arrivals.run_available(stream(), *out)
    (src / "2").write_bytes(b"q" * 500 + b"r" * 500)
    arrivals.run_available(stream(), *out)
    assert spark.read.parquet(out[0]).count() == 2


def test_late_arrivals_and_bounded_state(spark, tmp_path):
    """Two batches: what comes behind the watermark is left out, and a fingerprint is forgotten once the watermark passed it."""
    src = tmp_path / "events"
    put = lambda i, rows: spark.createDataFrame(rows, "at string, event_type string, content binary").withColumn("ts", F.to_timestamp_ntz("at")).coalesce(1).write.mode("append").parquet(str(src))
    schema = "at string, event_type string, content binary, ts timestamp_ntz"
    read = lambda: spark.readStream.schema(schema).parquet(str(src))
    window = lambda: arrivals.windowed_arrivals(read())
    files = lambda: read().withColumn("size", F.octet_length("content").cast("long")).withColumn("path", F.col("at"))
    fresh = lambda: arrivals.new_contents(files(), 4, "ts", "1 hour").select("path", "content_sha256")
    put(0, [("2024-01-01 10:05:00", "a", b"same"), ("2024-01-01 10:50:00", "a", b"same"), ("2024-01-01 12:30:00", "a", b"else")])
    arrivals.run_available(window(), f"{tmp_path}/w", f"{tmp_path}/ws")
    arrivals.run_available(fresh(), f"{tmp_path}/f", f"{tmp_path}/fs")
    put(1, [("2024-01-01 10:10:00", "a", b"late"), ("2024-01-01 12:40:00", "a", b"same"), ("2024-01-01 15:00:00", "a", b"else")])
    arrivals.run_available(window(), f"{tmp_path}/w", f"{tmp_path}/ws")
    arrivals.run_available(fresh(), f"{tmp_path}/f", f"{tmp_path}/fs")
    got = {(str(r["window_start"]), r["n"]) for r in spark.read.parquet(f"{tmp_path}/w").collect()}
    assert got == {("2024-01-01 10:00:00", 2), ("2024-01-01 12:00:00", 2)}
    assert spark.read.parquet(f"{tmp_path}/f").count() == 3  # same, else, and same again after its hour; late ones and the near repeat go


def test_plain_blocks_to_files(spark, tmp_path):
    rows = files(spark, ROWS)
    assert ranged.write_blocks(B.split_blocks(rows, 700), f"{tmp_path}/out") == 4
    for p, c in ROWS:
        assert not c or (tmp_path / "out" / p).read_bytes() == c
    assert not list((tmp_path / "out").rglob("*.part"))
    with pytest.raises(ValueError):
        ranged.write_blocks(B.split_blocks(files(spark, [("../x", b"a")])), f"{tmp_path}/out")


def test_bfloat16_tensors_are_widened(spark, tmp_path):
    raw = safetensors.build([("t", "BF16", [2, 2], struct.pack("<4H", 0x3F80, 0xBF80, 0x4000, 0x0000))], {})
    A.pack(files(spark, [("m.safetensors", raw)]), f"{tmp_path}/a", 64)
    got = A.Archive(spark, f"{tmp_path}/a").load_tensor("m.safetensors", "t")
    assert got.dtype == "float32" and got.tolist() == [[1.0, -1.0], [2.0, 0.0]]


def test_similarities(spark):
    a = spark.createDataFrame([("x", 10), ("y", 10), ("z", 0), ("only", 1)], "path string, size long")
    b = spark.createDataFrame([("x", 8), ("y", 4), ("z", 0)], "path string, size long")
    assert {tuple(r) for r in B.size_similarity(a, b).collect()} == {("x", 0.8), ("y", 0.0), ("z", 1.0)}
    left = B.fingerprints(B.split_blocks(files(spark, [("p", b"aaaabbbbcc")]), 4))
    right = B.fingerprints(B.split_blocks(files(spark, [("p", b"aaaaxxxxccc")]), 4))
    assert [r["similarity"] for r in B.block_similarity(left, right, ["path", "block_index"]).orderBy("block_index").collect()] == [1.0, 0.0, 0.0]
