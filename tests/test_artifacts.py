import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom import codecs
from blockloom.operators import artifacts
from blockloom.session import resolve_jobs
from blockloom.sources import archive as A
from blockloom.sources import gguf, safetensors


def files(spark, rows):
    return spark.createDataFrame([(i, p, len(c), c) for i, (p, c) in enumerate(rows)], "file_id long, path string, size long, content binary")


LORA = safetensors.build([("q_proj.lora_A.weight", "F16", [16, 32], b"\1" * 1024), ("q_proj.lora_B.weight", "F16", [32, 16], b"\2" * 1024)])
MODEL = safetensors.build([("w", "F32", [300], np.arange(300, dtype="<f4").tobytes()), ("b", "I64", [2], b"\0" * 16)])


def test_lora_adapters(spark):
    config = json.dumps({"peft_type": "LORA", "r": 8, "target_modules": ["q_proj", "v_proj"], "base_model_name_or_path": "base"}).encode()
    f = files(spark, [("a/adapter_model.safetensors", LORA), ("a/adapter_config.json", config), ("b/x.safetensors", LORA), ("c/adapter_config.json", b"{bad"), ("d/m.safetensors", MODEL), ("d/README.md", b"")])
    got = {r["dir"]: r for r in artifacts.lora_adapters(f).collect()}
    assert (got["a"]["rank"], got["a"]["target_modules"], got["a"]["base_model"], got["a"]["peft_type"]) == (8, "q_proj,v_proj", "base", "LORA")
    assert (got["b"]["is_lora"], got["b"]["rank"], got["b"]["target_modules"]) == (True, 16, "q_proj")
    assert got["c"]["is_lora"] and got["c"]["warning"] and got["c"]["rank"] is None
    assert not got["d"]["is_lora"] and got["d"]["has_readme"]


def test_checkpoints(spark):
    state = json.dumps({"global_step": 77, "epoch": 1.5, "best_metric": 0.25}).encode()
    f = files(spark, [("checkpoint-500/trainer_state.json", state), ("x/global_step.json", b'{"global_step": 9}'), ("x/trainer_state.json", state), ("y/trainer_state.json", state), ("y/optimizer.pt", b"\x80\x02"), ("z/data.csv", b"1")])
    got = {r["dir"]: r for r in artifacts.checkpoints(f).collect()}
    assert {d: got[d]["step"] for d in got} == {"checkpoint-500": 500, "x": 9, "y": 77, "z": None}
    assert got["y"]["pickles"] == 1 and got["y"]["epoch"] == 1.5 and not got["z"]["is_checkpoint"]


def test_artifact_types(spark):
    kind = lambda *rows: artifacts.artifact(files(spark, rows))
    assert kind(("adapter_model.safetensors", LORA))["artifact_type"] == "lora_adapter"
    assert kind(("config.json", b"{}"))["artifact_type"] == "training_checkpoint"
    g = kind(("m.gguf", gguf.build([("t", [32], 2, 0), ("u", [4], 0, 18)])))
    assert g["artifact_type"] == "gguf_model" and g["artifact_metadata"]["quantization"] == {"Q4_0": 1, "F32": 1}
    assert kind(("w.safetensors", MODEL))["artifact_metadata"] == {"tensor_count": 2, "dtypes": ["F32", "I64"]}
    assert kind(("model-00001-of-00002.safetensors", b"\0" * 100))["artifact_metadata"] == {"is_sharded": True, "shard_count": 1}
    assert kind(("x.txt", b"1"))["artifact_type"] == "unknown"


def test_tensor_aware_archive(spark, tmp_path):
    f = files(spark, [("m.safetensors", MODEL), ("q.gguf", gguf.build([("t", [32], 2, 0)]) + b"\7" * 500)])
    m = A.pack(f, f"{tmp_path}/a", 256, tensor_aware=True, artifact_type="detect")
    assert m["artifact_type"] == "gguf_model" and m["runtime_hints"]["tensor_access"] == "limited"
    a = A.Archive(spark, f"{tmp_path}/a")
    assert a.list_tensors() == ["w"] or a.list_tensors() == ["b", "w"]
    info = a.get_tensor_info("w")
    assert info["tensor_dtype"] == "F32" and info["tensor_shape"] == [300]
    assert {r["codec"] for r in a.blocks.where(F.col("tensor_name") == "w").select("codec").collect()} & {"floatplane", "byteplane"}  # only known floats try these
    assert np.array_equal(a.load_tensor("m.safetensors", "w"), np.arange(300, dtype="<f4"))
    assert open(a.extract_tensor("m.safetensors", "b", f"{tmp_path}/t"), "rb").read() == b"\0" * 16
    assert a.verify()["integrity"] == "OK" and "Integrity: OK" in A.report(a.verify())
    A.pack(f, f"{tmp_path}/g", 256, codec="byteplane", gguf_aware=True)
    assert {r["codec"] for r in A.Archive(spark, f"{tmp_path}/g").blocks.where("path = 'q.gguf' and codec is not null").select("codec").distinct().collect()} == {"zstd"}


def test_plain_functions(spark):
    for data in (b"", b"a", b"A" * 1000):
        made = codecs.compress_block(data)
        assert codecs.decompress_block(made.payload, made.codec, len(data)) == data
    with pytest.raises(ValueError):
        codecs.decompress_block(b"", "floatplane", 0)
    assert resolve_jobs("auto", spark) >= 1 and resolve_jobs("x", spark) == 1 and resolve_jobs(0, spark) == 1 and resolve_jobs("3", spark) == 3
