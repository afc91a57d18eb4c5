"""Session helpers: building a local session, and making the package importable on executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cores: str | int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster, use the cluster's own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors once per application (they share no folder with the driver)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    kept = tempfile.mkdtemp(prefix="blockloom-src-")  # the driver serves it to executors that start later
    atexit.register(shutil.rmtree, kept, True)
    path = os.path.join(kept, "blockloom_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("blockloom", os.path.relpath(full, top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


#: Bytes of one Arrow batch sent to a Python worker: rows alone do not bound memory where blocks are large.
BATCH_BYTES = 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches in this session, unless they are bounded more tightly."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session names none (local tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="blockloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def resolve_jobs(jobs: int | str, spark: SparkSession) -> int:
    """A number of tasks: ``auto`` is the cluster's parallelism, nonsense is 1, and at least 1."""
    if jobs == "auto":
        return max(1, spark.sparkContext.defaultParallelism)
    try:
        return max(1, int(jobs))
    except ValueError:
        return 1
