"""Predicates and classifiers over paths, names and headers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names by which training checkpoints are known, and what each one is.
CHECKPOINT_FILES = {
    "trainer_state.json": "trainer_state",
    "training_args.bin": "training_args",
    "optimizer.pt": "optimizer",
    "optimizer_state.pt": "optimizer",
    "scheduler.pt": "scheduler",
    "scaler.pt": "scaler",
    "rng_state.pth": "rng_state",
    "rng_state_0.pth": "rng_state",
    "pytorch_model.bin": "pytorch_model",
    "model.safetensors": "safetensors_model",
    "config.json": "config",
    "generation_config.json": "generation_config",
    "tokenizer_config.json": "tokenizer_config",
    "special_tokens_map.json": "special_tokens_map",
    "tokenizer.json": "tokenizer",
    "vocab.json": "vocab",
    "merges.txt": "merges",
    "tokenizer.model": "sentencepiece_tokenizer",
    "global_step.json": "global_step",
    "state.json": "state",
    "README.md": "readme",
}
# Checkpoint files that are pickles and never loaded.
PICKLE_FILES = ("training_args.bin", "optimizer.pt", "optimizer_state.pt", "scheduler.pt", "scaler.pt", "rng_state.pth", "rng_state_0.pth", "pytorch_model.bin")

SHARD = r"(?i)^model-(\d+)-of-(\d+)\.safetensors"
LORA = r"(?i)lora_[ab]"


def base_name(path):
    return F.element_at(F.split(path, "/"), -1)


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression over the whole string; ``*`` crosses slashes."""
    out = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (j := pattern.find("]", i + 1)) > 0:
            body = pattern[i:j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = j + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def check_pattern(pattern: str) -> str:
    """Patterns may not be absolute or climb."""
    if pattern.startswith("/") or ".." in pattern.split("/"):
        raise ValueError(f"unsafe pattern: {pattern!r}")
    return pattern


def matches(path, pattern: str):
    r = glob_regex(check_pattern(pattern))
    return path.rlike(r) | base_name(path).rlike(r)


def first_match(path, patterns: list[str]):
    """The first of the patterns that fits, or null; each file is selected once."""
    found = F.lit(None).cast("string")
    for p in reversed(patterns):
        found = F.when(matches(path, p), F.lit(p)).otherwise(found)
    return found


def is_safe_path(path):
    """No control characters, not blank, relative, no drive, no empty or climbing component."""
    bad = path.rlike(r"[\x00-\x1F]") | (F.trim(path) == "") | path.startswith("/") | (F.substring(path, 2, 1) == ":") | path.contains("//") | path.rlike(r"(^|/)\.\.(/|$)")
    return F.coalesce(~bad, F.lit(False))


def safe_file_name(name):
    return F.translate(name, "/\\:", "___")


def shard_parts(name):
    """(is_shard, index, total) of a shard's file name."""
    return F.struct(name.rlike(SHARD).alias("is_shard"), F.try_to_number(F.regexp_extract(name, SHARD, 1), F.lit("99999")).cast("int").alias("shard"), F.try_to_number(F.regexp_extract(name, SHARD, 2), F.lit("99999")).cast("int").alias("shards"))


def file_format(path, head=None):
    """The format of a file by its path and, for pickles, the first bytes; rules in order, first one wins."""
    p, name = F.lower(path), F.lower(base_name(path))
    pickle = F.hex(F.substring(head, 1, 2)).isin("8002", "8003", "8004") if head is not None else F.lit(False)
    return (
        F.when(p.endswith(".safetensors") & (name.contains("lora") | name.contains("adapter")), "lora")
        .when(p.endswith(".safetensors") & name.rlike(SHARD), "shard")
        .when(p.endswith(".safetensors"), "safetensors")
        .when(p.endswith(".gguf"), "gguf")
        .when(p.endswith(".bin") & (name.contains("pytorch_model") | pickle), "pytorch_bin")
        .when(p.endswith(".pt") | p.endswith(".pth"), "pt")
        .when(p.endswith(".ckpt"), "ckpt")
        .when(name.isin("tokenizer.json", "tokenizer.model", "tokenizer_config.json", "vocab.json", "vocab.txt", "merges.txt"), "tokenizer")
        .when(name.endswith(".index.json"), "index")
        .when(name.endswith("config.json"), "config")
        .otherwise("unknown")
    )


def known_files(spark) -> DataFrame:
    """The checkpoint names as a dimension table (21 rows)."""
    return spark.createDataFrame([(n, k, n in PICKLE_FILES) for n, k in CHECKPOINT_FILES.items()], "name string, kind string, is_pickle boolean")


def checkpoint_report(files: DataFrame, directory) -> DataFrame:
    """Per directory: known files, pickles, and the step: of the directory's name, else of its JSON side files."""
    spark = files.sparkSession
    f = files.withColumn("dir", directory).withColumn("name", base_name(F.col("path")))
    hit = f.join(F.broadcast(known_files(spark)), "name", "left")
    named = F.expr("try_cast(regexp_extract(dir, 'checkpoint-([0-9]+)$', 1) as long)")
    return hit.groupBy("dir").agg(
        F.count("kind").alias("known"), F.count_if("is_pickle").alias("pickles"), F.coalesce(F.bool_or(F.col("kind") == "trainer_state"), F.lit(False)).alias("has_trainer_state"), F.max(named).alias("step"),
    ).withColumn("is_checkpoint", F.col("known") > 0)


def artifact_type(is_lora, is_checkpoint, has_gguf, has_safetensors):
    return F.when(is_lora, "lora_adapter").when(is_checkpoint, "training_checkpoint").when(has_gguf, "gguf_model").when(has_safetensors, "huggingface_model").otherwise("unknown")


def lora_summary(tensors: DataFrame) -> DataFrame:
    """Per file: whether any tensor is a LoRA one, target modules, and the rank of the first LoRA tensor."""
    is_lora = F.col("name").rlike(LORA)
    module = F.when(is_lora, F.regexp_extract("name", r"^(.*)\.lora_", 1))
    rank = F.when(F.lower("name").contains("lora_a"), F.element_at("shape", 1)).otherwise(F.element_at("shape", -1))
    found = tensors.groupBy("file_id").agg(F.bool_or(is_lora).alias("is_lora"), F.array_join(F.array_sort(F.collect_set(F.nullif(module, F.lit("")))), ",").alias("modules"), F.min_by(F.when(is_lora, rank), F.when(is_lora, F.col("ordinal"))).alias("rank"))
    return found
