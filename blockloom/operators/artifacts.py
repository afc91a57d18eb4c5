"""What a directory of files is: LoRA adapter, training checkpoint, GGUF or safetensors model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators import classify as C
from blockloom.sources import gguf, safetensors

_ADAPTER = "base_model_name_or_path string, peft_type string, r int, target_modules string"


def _placed(files: DataFrame) -> DataFrame:
    return files.withColumn("dir", F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1)).withColumn("name", C.base_name(F.col("path")))


def _json(schema: str):
    return F.from_json(F.try_validate_utf8(F.col("content").cast("string")), schema)


def lora_adapters(files: DataFrame) -> DataFrame:
    """Per directory of (path, content): adapter model and config, base model, PEFT type, rank and target modules.

    The model is adapter_model.safetensors, else a safetensors file named like an adapter, else one with LoRA tensors; rank
    and modules come from the config, else from the tensors.  What is not stated is null.
    """
    f = _placed(files)
    t = safetensors.tensors(files.where(F.lower("path").endswith(".safetensors"))).withColumn("file_id", F.col("path"))
    by_tensor = C.lora_summary(t.withColumn("ordinal", F.col("byte_offset"))).select(F.col("file_id").alias("path"), "is_lora", F.col("modules").alias("t_modules"), F.col("rank").alias("t_rank"))
    g = f.join(by_tensor, "path", "left")
    low = F.lower("name")
    st = low.endswith(".safetensors")
    priority = F.when(F.col("name") == "adapter_model.safetensors", 0).when(st & low.contains("adapter"), 1).when(st & F.coalesce("is_lora", F.lit(False)), 2)
    config = F.when(F.col("name") == "adapter_config.json", _json(_ADAPTER))
    choice = F.struct(priority.alias("p"), F.col("path").alias("path"))
    per = g.groupBy("dir").agg(
        F.min(F.when(priority.isNotNull(), choice)).alias("model"), F.bool_or(F.col("name") == "adapter_config.json").alias("has_config"), F.bool_or(F.col("name") == "README.md").alias("has_readme"),
        F.max(config).alias("c"), F.min_by("t_rank", F.when(priority.isNotNull(), choice)).alias("t_rank"), F.min_by("t_modules", F.when(priority.isNotNull(), choice)).alias("t_modules"),
    )
    modules = F.coalesce(F.regexp_replace(F.nullif("c.target_modules", F.lit("")), '[\\[\\]" ]', ""), F.nullif("t_modules", F.lit("")))
    return per.select(
        "dir", (F.col("model").isNotNull() | F.col("has_config")).alias("is_lora"), F.col("model.path").alias("adapter_model"), "has_config", "has_readme",
        F.col("c.base_model_name_or_path").alias("base_model"), F.col("c.peft_type").alias("peft_type"), F.coalesce("c.r", F.col("t_rank").cast("int")).alias("rank"), modules.alias("target_modules"),
        F.when(F.col("model").isNull() & F.col("has_config"), "a config but no adapter model").alias("warning"),
    )


def checkpoints(files: DataFrame) -> DataFrame:
    """Per directory: known files, pickles, and the step by the directory's name, else global_step.json, else trainer_state.json."""
    f = _placed(files)
    known = C.checkpoint_report(f.select("path"), F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1))
    state = F.struct(_json("global_step long").getField("global_step").alias("step"))
    named = lambda n: F.max(F.when(F.col("name") == n, state.getField("step")))
    inside = f.where(F.col("name").isin("global_step.json", "trainer_state.json")).groupBy("dir").agg(named("global_step.json").alias("g"), named("trainer_state.json").alias("t"), F.max(F.when(F.col("name") == "trainer_state.json", _json("epoch double, best_metric double"))).alias("state"))
    joined = known.join(inside, "dir", "left")
    return joined.select("dir", "is_checkpoint", "known", "pickles", "has_trainer_state", F.coalesce("step", "g", "t").alias("step"), F.col("state.epoch").alias("epoch"), F.col("state.best_metric").alias("best_metric"))


def artifact(files: DataFrame) -> dict:
    """The type of the whole set of files with its metadata (without what is not known), as manifests carry it."""
    fmt = C.file_format(F.col("path"), F.col("content"))
    flags = files.select(fmt.alias("f")).agg(F.bool_or(F.col("f") == "gguf").alias("g"), F.bool_or(F.col("f").isin("safetensors", "shard", "lora")).alias("s")).first()
    lora = lora_adapters(files).where("is_lora").orderBy("dir").first()
    step = checkpoints(files).where("is_checkpoint").orderBy("dir").first()
    known = lambda row: {k: v for k, v in row.asDict().items() if v not in (None, "", [])}
    if lora:
        return {"artifact_type": "lora_adapter", "artifact_metadata": known(lora)}
    if step:
        return {"artifact_type": "training_checkpoint", "artifact_metadata": known(step)}
    if flags["g"]:
        heads = gguf.read(files.where(F.lower("path").endswith(".gguf"))).orderBy("path").first()
        types: dict[str, int] = {}
        for t in heads["tensors"] or []:
            types[t["ggml_type"]] = types.get(t["ggml_type"], 0) + 1
        return {"artifact_type": "gguf_model", "artifact_metadata": {"version": heads["version"], "endianness": heads["endianness"], "quantization": types, "tensors": [t["name"] for t in (heads["tensors"] or [])[:100]], "warnings": heads["warnings"] or []}}
    if flags["s"]:
        shards = files.where(C.base_name(F.col("path")).rlike(C.SHARD)).count()
        if shards:
            return {"artifact_type": "huggingface_model", "artifact_metadata": {"is_sharded": True, "shard_count": shards}}
        s = safetensors.summary(files.where(F.lower("path").endswith(".safetensors"))).orderBy("path").first()
        return {"artifact_type": "huggingface_model", "artifact_metadata": {"tensor_count": s["tensor_count"], "dtypes": s["dtypes"]} if s else {}}
    return {"artifact_type": "unknown", "artifact_metadata": {}}


def quantised_files(files: DataFrame) -> DataFrame:
    """(path) of GGUF files with any quantised tensor."""
    from blockloom.operators.ggml import NOT_QUANTISED

    return gguf.read(files.where(F.lower("path").endswith(".gguf"))).where(F.exists("tensors", lambda t: ~t["ggml_type"].isin(*NOT_QUANTISED))).select("path")
