"""Files by range, whatever their size, and what archives say of damage."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from blockloom.cli import run
from blockloom.functions.progress import Steps
from blockloom.sources import archive as A
from blockloom.sources import gguf, ranged, safetensors


def files(spark, rows):
    return spark.createDataFrame([(i, p, len(c), c) for i, (p, c) in enumerate(rows)], "file_id long, path string, size long, content binary")


def test_a_file_larger_than_any_row(spark, tmp_path):
    """A sparse file of over 2 GiB with a few bytes at its ends goes in and out, and is read by range."""
    size = (1 << 31) + (1 << 26) + 5
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in/big.bin", "wb") as o:
        o.write(b"begin")
        o.seek(size - 3)
        o.write(b"end")
    (tmp_path / "in/empty").write_bytes(b"")
    m = A.pack_folder(spark, str(tmp_path / "in"), f"{tmp_path}/a", 1 << 23, codec="zstd")
    assert m["total_original_size"] == size and m["total_compressed_size"] < 1 << 20 and m["deduplication"]["duplicate_blocks"] > 200
    a = A.Archive(spark, f"{tmp_path}/a")
    assert a.read_file_range("big.bin", size - 5, 50) == b"\0\0end" and a.read_file_range("big.bin", 0, 6) == b"begin\0"
    assert ranged.read_range(str(tmp_path / "in"), "big.bin", size - 4, 9) == b"\0end"
    assert a.unpack(f"{tmp_path}/out") == 2
    with open(tmp_path / "out/big.bin", "rb") as x:
        assert x.seek(0, 2) == size and x.seek(size - 3) and x.read() == b"end"
    assert (tmp_path / "out/empty").read_bytes() == b""


def test_listing_blocks_and_heads(spark, tmp_path):
    good = safetensors.build([("w", "F32", [500_000], b"\0" * 2_000_000)])
    rows = {"m/a.safetensors": good, "m/b.gguf": gguf.build([(f"t{i}", [4, 4], 0, 0) for i in range(40_000)]), "c.json": b"{}", "bad.safetensors": b"abc", "no.gguf": b"zip" * 9}
    for p, c in rows.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(c)
    top = str(tmp_path)
    assert {r["path"]: r["size"] for r in ranged.file_list(spark, top).collect()} == {p: len(c) for p, c in rows.items()}
    h = ranged.heads(spark, top)
    assert {r["path"]: len(r["content"]) < 1000 for r in h.collect()}["m/a.safetensors"]
    assert [(r["path"], r["name"], r["byte_size"]) for r in safetensors.tensors(h.where(F.col("path").endswith(".safetensors"))).collect()] == [("m/a.safetensors", "w", 2_000_000)]
    g = {r["path"]: r for r in gguf.read(h.where(F.col("path").endswith(".gguf"))).collect()}
    assert len(g["m/b.gguf"]["tensors"]) == 40_000 and not g["m/b.gguf"]["warnings"] and g["no.gguf"]["error"]
    b = ranged.file_blocks(spark, top, 20_000, 60_000)
    assert b.rdd.getNumPartitions() > 40
    for p, c in rows.items():
        got = sorted((r["block_index"], bytes(r["data"])) for r in b.where(F.col("path") == p).collect())
        assert b"".join(x for _, x in got) == c
        assert {r["path"] for r in ranged.file_blocks(spark, top, 20_000, paths=[p]).collect()} == {p}
    assert {r["path"]: (r["bytes"], r["sha256"]) for r in ranged.file_digests(spark, top).collect()} == {p: (len(c), hashlib.sha256(c).hexdigest()) for p, c in rows.items()}
    with pytest.raises(FileNotFoundError):
        ranged.listing(f"{top}/none")
    assert ranged.listing(f"{top}/c.json") == [("c.json", 2)]


def test_blocks_are_encoded_after_the_last_exchange(spark):
    rows = [(f"f{i}", bytes([i]) * 3000) for i in range(5)]
    blocks = A.encoded_blocks(files(spark, rows), 1024, "zlib")
    assert blocks.count() == 15
    above, below = blocks._jdf.queryExecution().executedPlan().toString().split("ArrowEvalPython", 1)
    assert "Exchange" not in above and "BroadcastHashJoin" in below and "hashpartitioning" not in below


def test_verify_tells_of_swaps_bases_and_totals(spark, tmp_path):
    rows = [("x", b"A" * 1024 + b"B" * 1024 + b"c"), ("y", b"same"), ("z", b"")]
    A.pack(files(spark, rows), f"{tmp_path}/a", 1024)
    a = A.Archive(spark, f"{tmp_path}/a")
    assert a.verify()["integrity"] == "OK"
    a.blocks = a.blocks.withColumn("block_index", F.when((F.col("path") == "x") & (F.col("block_index") < 2), 1 - F.col("block_index")).otherwise(F.col("block_index")))
    assert a.verify()["errors"] == {"file checksum differs": {"count": 1, "example": "x"}}
    a = A.Archive(spark, f"{tmp_path}/a")
    a.blocks = a.blocks.where("path <> 'y'")
    assert {"manifest totals differ", "block sizes do not add up"} <= set(a.verify(full=False)["errors"])
    A.pack(files(spark, [("y2", b"same"), ("new", b"n" * 2000)]), f"{tmp_path}/b", 1024, base=f"{tmp_path}/a")
    assert "base archive missing" in A.Archive(spark, f"{tmp_path}/b").verify(full=False)["errors"]
    assert A.Archive(spark, f"{tmp_path}/b", f"{tmp_path}/a").verify()["integrity"] == "OK"
    A.pack(files(spark, [("q", b"other")]), f"{tmp_path}/c", 1024)
    assert "another base archive" in A.Archive(spark, f"{tmp_path}/b", f"{tmp_path}/c").verify(full=False)["errors"]


def test_reader(spark, tmp_path):
    A.pack(files(spark, [("x", b"A" * 1500), ("y", b"A" * 1024)]), f"{tmp_path}/a", 1024)
    with A.Archive(spark, f"{tmp_path}/a") as a:
        assert [r["block_size"] for r in a.blocks_of("x").collect()] == [1024, 476]
        ids = [r["global_id"] for r in a.blocks_of("x").collect()] + [r["global_id"] for r in a.blocks_of("y").collect()]
        assert [a.read_block(i) for i in ids] == [b"A" * 1024, b"A" * 476, b"A" * 1024]
        assert a.get_block(ids[1])["path"] == "x" and "payload" not in a.get_block(ids[1])
        for f in (lambda: a.get_block(99), lambda: a.read_block(99), lambda: a.read_file_range("none", 0, 1), lambda: a.read_file("none")):
            with pytest.raises(KeyError):
                f()
        assert a.read_file_range("x", 1500, 10) == b""


def test_manifests_of_all_versions():
    for v in range(1, A.VERSION + 1):
        m = A.upgraded({"version": v, "total_files": 3, "deduplication": {"enabled": True}, "own": 1})
        assert (m["version"], m["total_files"], m["own"]) == (v, 3, 1) and set(A.DEFAULTS) <= set(m)
        assert m["deduplication"] == {"enabled": True, "duplicate_blocks": 0, "saved_bytes": 0} and m["delta"]["base_sha256"] is None
        assert A.upgraded(json.loads(json.dumps(m))) == m
    assert A.upgraded({})["version"] == 1
    for bad in (0, A.VERSION + 1, "7", None):
        with pytest.raises(A.ArchiveError):
            A.upgraded({"version": bad})


def test_only_quantised_files_lose_their_planes(spark, tmp_path):
    rows = [("q.gguf", gguf.build([("t", [32, 32], 2, 0)]) + b"\0\1" * 3000), ("f.gguf", gguf.build([("t", [32, 32], 0, 0)]) + b"\0\1" * 3000), ("t.bin", b"\0\1\2\3" * 900)]
    A.pack(files(spark, rows), f"{tmp_path}/a", 4096, codec="byteplane", gguf_aware=True, dedup=False)
    got = {(r["path"], r["codec"]) for r in A.Archive(spark, f"{tmp_path}/a").blocks.select("path", "codec").collect()}
    assert got == {("q.gguf", "zstd"), ("f.gguf", "byteplane"), ("t.bin", "byteplane")}


def test_steps():
    said = []
    s = Steps(40, said.append)
    for i in range(41):
        s.reach(i)
    assert len(said) == 10 and said[0] == "4 of 40 (10%)" and said[-1] == "40 of 40 (100%)"
    Steps(0, said.append).reach(5)
    few = []
    s = Steps(3, few.append)
    for i in (1, 1, 2, 3, 3):
        s.reach(i)
    assert len(few) == 3


def test_commands(spark, tmp_path, capsys):
    src = tmp_path / "src"
    src.mkdir()
    (src / "adapter_config.json").write_text(json.dumps({"r": 8, "peft_type": "LORA", "base_model_name_or_path": "b"}))
    (src / "adapter_model.safetensors").write_bytes(safetensors.build([("q.lora_A.weight", "F32", [8, 4], b"\1\2\3\4" * 32)]))
    (src / "w.gguf").write_bytes(gguf.build([("t", [32], 2, 0)]))
    assert run(["inspect", str(src), "--tensors", "--lora", "--checkpoint", "--gguf", "--dedup", "--compression"], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["lora"][0]["rank"] == 8 and got["gguf"][0]["quantization"] == [{"type": "Q4_0", "n": 1}] and got["dedup"]["total_blocks"] == 3 and got["compression"]["auto"]["not_restored"] == 0
    assert run(["pack-lora", str(src), f"{tmp_path}/a", "-j", "2", "--progress", "-b", "64"], spark) == 0
    assert json.loads(capsys.readouterr().out)["artifact_type"] == "lora_adapter"
    assert run(["inspect", f"{tmp_path}/a", "--tensors", "--compression", "--delta", "--runtime-hints"], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["has_tensor_data"] and got["tensors"] == ["q.lora_A.weight"] and got["delta"]["enabled"] is False
    assert run(["verify", f"{tmp_path}/a"], spark) == 0 and "Integrity: OK" in capsys.readouterr().out
    assert run(["verify", f"{tmp_path}/a", "--json", "--quick"], spark) == 0 and json.loads(capsys.readouterr().out)["total_files"] == 3
    assert run(["unpack", f"{tmp_path}/a", f"{tmp_path}/out", "--files", "*.gguf"], spark) == 0
    assert (tmp_path / "out/w.gguf").read_bytes() == (src / "w.gguf").read_bytes() and not (tmp_path / "out/adapter_config.json").exists()
    capsys.readouterr()
    assert run(["bench", "--synthetic", "300000", "-b", "65536", "--compare-jobs", "1,2", "--partial-access", "--out", f"{tmp_path}/bench.json"], spark) == 0
    got = json.loads((tmp_path / "bench.json").read_text())
    assert got["codecs"]["auto"]["ratio"] < 0.6 and set(got["jobs"]) == {"1", "2"} and got["partial_access"]["range_s"] > 0 and got["environment"]["spark"]
    capsys.readouterr()
    assert run(["bench", str(src), "--compare-codecs"], spark) == 0 and capsys.readouterr().out.startswith("codec")
