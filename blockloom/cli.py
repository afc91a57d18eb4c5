"""Command line: pack, unpack, verify, inspect, list, bench."""

from __future__ import annotations

import argparse
import contextlib
import json
import os
import platform
import random
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom import codecs
from blockloom.functions.block_codecs import with_decoding, with_encoding
from blockloom.functions.progress import Progress
from blockloom.operators import artifacts
from blockloom.operators import blocks as B
from blockloom.operators import classify as C
from blockloom.session import local_session, resolve_jobs
from blockloom.sources import archive as A
from blockloom.sources import gguf, ranged, safetensors

SECTIONS = ("tensors", "compression", "lora", "checkpoint", "gguf", "dedup", "delta", "runtime-hints")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="blockloom", description=__doc__)
    p.add_argument("--cores", default="*")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, said: str, *places: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=said)
        for place in places:
            c.add_argument(place)
        c.add_argument("--json", action="store_true", help="the outcome as JSON (the default of all but verify)")
        c.add_argument("--progress", action="store_true", help="tell of every tenth of a stage")
        return c

    for name, said in (("pack", "a file or folder into an archive"), ("pack-lora", "a LoRA adapter"), ("pack-checkpoint", "a training checkpoint")):
        c = command(name, said, "source", "archive")
        c.add_argument("-b", "--block-size", type=int, default=B.DEFAULT_BLOCK)
        c.add_argument("-l", "--level", type=int)
        c.add_argument("-j", "--jobs", default="auto", help="tasks that encode at a time, or auto")
        c.add_argument("--codec", default="auto", choices=["auto", *codecs.registered()])
        c.add_argument("--no-dedup", action="store_true")
        c.add_argument("--delta-base")
        c.add_argument("--tensor-aware", action="store_true")
        c.add_argument("--gguf-aware", action="store_true")
    c = command("unpack", "the files of an archive, or some", "archive", "out")
    c.add_argument("--only", "--files", action="append", help="a pattern of paths; may be given several times")
    c.add_argument("--tensor", help="file:name of one tensor to extract")
    c.add_argument("--base")
    c = command("verify", "hashes, references and totals of an archive", "archive")
    c.add_argument("--quick", action="store_true", help="without decoding")
    c.add_argument("--base")
    c = command("inspect", "the formats of a folder's files, or an archive's manifest and measured totals", "path")
    for section in SECTIONS:
        c.add_argument(f"--{section}", action="store_true")
    c = command("list", "the files or tensors of an archive", "archive")
    c.add_argument("--tensors", action="store_true")
    c = command("bench", "size and throughput per codec over a folder")
    c.add_argument("source", nargs="?")
    c.add_argument("-b", "--block-size", type=int, default=B.DEFAULT_BLOCK)
    c.add_argument("--synthetic", type=int, metavar="BYTES", help="made-up data instead of a folder")
    c.add_argument("--compare-codecs", action="store_true", help="every codec by itself (else auto alone)")
    c.add_argument("--compare-jobs", help="numbers of tasks, such as 1,2,4")
    c.add_argument("--partial-access", action="store_true", help="time of a file, a range and a whole read of a packed archive")
    c.add_argument("--out", help="write the outcome to this JSON file, too")
    return p


def _is_archive(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(f"{path}/manifest").limit(1).collect()
        return True
    except Exception:  # noqa: BLE001  no such table, in whatever words the storage says it
        return False


def inspected_folder(spark: SparkSession, path: str, sections: set[str]) -> dict:
    """What a folder holds, from its listing and its files' headers."""
    files = ranged.heads(spark, path)
    fmt = files.select("path", "size", C.file_format(F.col("path"), F.col("content")).alias("format")).orderBy("path").collect()
    out: dict = {"files": {r["path"]: r["format"] for r in fmt}, "total_files": len(fmt), "total_bytes": sum(r["size"] for r in fmt)}
    out["largest"] = max(fmt, key=lambda r: r["size"])["path"] if fmt else None
    out["smallest"] = min(fmt, key=lambda r: r["size"])["path"] if fmt else None
    out |= artifacts.artifact(files) if fmt else {}
    if "tensors" in sections:
        out["safetensors"] = [r.asDict() for r in safetensors.summary(files.where(F.lower("path").endswith(".safetensors"))).collect()]
    if sections & {"tensors", "gguf"}:
        heads = gguf.read(files.where(F.lower("path").endswith(".gguf")))
        out["gguf"] = [r.asDict(True) for r in heads.select("path", "version", "endianness", "warnings", "error", F.size("tensors").alias("tensors"), F.expr("transform(array_distinct(tensors.ggml_type), t -> named_struct('type', t, 'n', size(filter(tensors.ggml_type, x -> x = t))))").alias("quantization")).collect()]
    if "lora" in sections:
        out["lora"] = [r.asDict() for r in artifacts.lora_adapters(files).where("is_lora").collect()]
    if "checkpoint" in sections:
        out["checkpoint"] = [r.asDict() for r in artifacts.checkpoints(files).where("is_checkpoint").collect()]
    if "compression" in sections:
        out["compression"] = measured(ranged.file_blocks(spark, path), ["auto"])
    if "dedup" in sections:
        prints = ranged.file_blocks(spark, path).select(F.sha2("data", 256).alias("content_sha256"), "block_size")
        out["dedup"] = B.dedup_stats(prints, []).first().asDict()
    return out


def inspected_archive(spark: SparkSession, path: str, sections: set[str]) -> dict:
    a = A.Archive(spark, path)
    m = a.manifest()
    if not sections:
        return m
    seen = a.inspect()
    out = {"totals": seen["totals"], "ratio": seen["ratio"], "artifact_type": m["artifact_type"]}
    if "tensors" in sections:
        out |= {"has_tensor_data": seen["has_tensor_data"], "dtypes": seen["dtypes"], "tensors": a.list_tensors()}
    if "compression" in sections:
        out["codecs"] = seen["codecs"]
    if "dedup" in sections:
        out["dedup"] = m["deduplication"] | {"measured_saved_bytes": seen["dedup_saved_bytes"]}
    if "delta" in sections:
        out["delta"] = m["delta"] | {"measured_saved_bytes": seen["delta_saved_bytes"]}
    if "runtime-hints" in sections:
        out["runtime_hints"] = m["runtime_hints"]
    if sections & {"lora", "checkpoint", "gguf"}:
        out["artifact_metadata"] = m["artifact_metadata"]
    return out


def measured(blocks: DataFrame, names: list[str], tasks: int | None = None) -> dict:
    """Ratio, seconds and MB/s of each codec over the blocks, and how many blocks it does not restore."""
    if tasks:
        blocks = blocks.repartition(tasks)
    blocks = blocks.withColumn("sha", F.sha2("data", 256))
    size = blocks.agg(F.sum("block_size")).first()[0] or 0
    out = {}
    for name in names:
        a = time.time()
        made = with_encoding(blocks, name)
        n = made.agg(F.sum("compressed_size")).first()[0] or 0
        b = time.time()
        bad = with_decoding(made).where(~F.coalesce(F.sha2("data", 256) == F.col("sha"), F.lit(False))).count()
        c = time.time()
        decode = max(1e-9, (c - b) - (b - a))  # the second run encodes again
        out[name] = {"bytes": size, "compressed": n, "ratio": round(n / size, 6) if size else 1.0, "encode_s": round(b - a, 3), "both_s": round(c - b, 3), "encode_mb_s": round(size / 2**20 / (b - a), 2), "decode_mb_s": round(size / 2**20 / decode, 2), "not_restored": bad}
    return out


def environment(spark: SparkSession) -> dict:
    return {"python": platform.python_version(), "spark": spark.version, "machine": platform.machine(), "system": platform.system(), "parallelism": spark.sparkContext.defaultParallelism, "codecs": codecs.registered()}


def partial_access(spark: SparkSession, source: str, block_size: int) -> dict:
    """Seconds to read everything, the largest file and 4 KiB of it out of a packed archive."""
    with tempfile.TemporaryDirectory() as here:
        A.pack_folder(spark, source, f"{here}/archive", block_size)
        with A.Archive(spark, f"{here}/archive") as a:
            name = a.files.orderBy(F.desc("size"), "path").first()["path"]
            out = {"file": name}
            for what, run in (("whole_s", lambda: A.file_hashes(a.resolved()).count()), ("file_s", lambda: A.file_hashes(a.resolved(a.blocks.where(F.col("path") == name))).count()), ("range_s", lambda: a.read_file_range(name, 0, 4096))):
                t = time.time()
                run()
                out[what] = round(time.time() - t, 3)
    return out


def benched(spark: SparkSession, args) -> dict:
    with contextlib.ExitStack() as stack:
        source = args.source
        if args.synthetic is not None:
            source = stack.enter_context(tempfile.TemporaryDirectory())
            r = random.Random(0)
            with open(f"{source}/synthetic.bin", "wb") as o:
                for at in range(0, args.synthetic, 1 << 20):
                    n = min(1 << 20, args.synthetic - at)
                    o.write((r.randbytes(n // 2) + b"\0" * n)[:n])
        if not source:
            raise SystemExit("a folder or --synthetic is needed")
        blocks = ranged.file_blocks(spark, source, args.block_size)
        out: dict = {"environment": environment(spark), "codecs": measured(blocks, codecs.registered() if args.compare_codecs else ["auto"])}
        if args.compare_jobs:
            out["jobs"] = {j: measured(blocks, ["auto"], resolve_jobs(j, spark))["auto"] for j in args.compare_jobs.split(",")}
        if args.partial_access:
            out["partial_access"] = partial_access(spark, source, args.block_size)
    if args.out:
        with open(args.out, "w") as o:
            json.dump(out, o, indent=2)
    return out


def table_of(found: dict) -> str:
    """The codecs of a bench as a table."""
    rows = [("codec", "ratio", "encode MB/s", "decode MB/s")] + [(n, f"{x['ratio']:.4f}", f"{x['encode_mb_s']:.2f}", f"{x['decode_mb_s']:.2f}") for n, x in found["codecs"].items()]
    widths = [max(len(r[i]) for r in rows) for i in range(4)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or local_session(args.cores)
    with Progress(spark) if args.progress else contextlib.nullcontext():
        out, code = carried_out(args, spark)
    if args.command == "verify" and not args.json:
        print(A.report(out))
    elif args.command == "bench" and not args.json and not args.out:
        print(table_of(out))
    elif code != 2:
        print(json.dumps(out, indent=2, default=str))
    return min(code, 1)


def carried_out(args, spark: SparkSession) -> tuple[object, int]:
    """(outcome, exit code; 2 where there is nothing to print)."""
    if args.command.startswith("pack"):
        if args.command != "pack":
            files = ranged.heads(spark, args.source)
            if args.command == "pack-lora" and not artifacts.lora_adapters(files).where("is_lora").take(1):
                print("not a LoRA adapter", file=sys.stderr)
                return None, 2
            if args.command == "pack-checkpoint" and not artifacts.checkpoints(files).where("is_checkpoint").take(1):
                print("not a training checkpoint", file=sys.stderr)
                return None, 2
        how = {"dedup": not args.no_dedup, "base": args.delta_base, "artifact_type": "detect", "tensor_aware": args.tensor_aware or args.command == "pack-lora", "gguf_aware": args.gguf_aware}
        return A.pack_folder(spark, args.source, args.archive, args.block_size, codec=args.codec, level=args.level, jobs=resolve_jobs(args.jobs, spark), **how), 0
    if args.command == "unpack":
        a = A.Archive(spark, args.archive, args.base)
        if args.tensor and not args.only:
            return {"tensor": a.extract_tensor(*args.tensor.split(":", 1), args.out)}, 0
        return {"files": a.unpack(args.out, args.only)}, 0
    if args.command == "verify":
        found = A.Archive(spark, args.archive, args.base).verify(full=not args.quick)
        return found, int(found["integrity"] != "OK")
    if args.command == "list":
        a = A.Archive(spark, args.archive)
        return a.list_tensors() if args.tensors else a.list_files(), 0
    if args.command == "inspect":
        sections = {s for s in SECTIONS if getattr(args, s.replace("-", "_"))}
        return (inspected_archive if _is_archive(spark, args.path) else inspected_folder)(spark, os.path.expanduser(args.path), sections), 0
    return benched(spark, args), 0


if __name__ == "__main__":
    sys.exit(run())
