"""Shared helpers: where intermediate tables go, and how row functions reach the executors."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a session whose executors are in this
    process (as in tests) gets a new local folder; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when the session's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs depend on files only, not on lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of finished jobs: Spark deletes them once the driver's garbage collection finds that no
    plan refers to them, which on an idle driver may take half an hour."""
    for _ in range(2):  # what the first collection finds holds on to more until the next
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f``, after which its worker gives unused memory back: workers idle between tasks, and there may be more of them
    than tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def prepare(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the Python workers of a session that was started elsewhere: by its folder where the
    workers are on this machine, and as an archive that Spark sends to executors on others."""
    context = spark.sparkContext
    if context.master.split("[")[0] not in ("local", "local-cluster") and not any("nestquery-" in p for p in context._python_includes):
        folder = Path(tempfile.mkdtemp())
        archive = folder / f"nestquery-{uuid.uuid4().hex[:8]}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(Path(REPO, "nestquery").rglob("*.py")):
                z.write(p, p.relative_to(REPO))
        context.addPyFile(str(archive))
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "").split(os.pathsep)
    if REPO not in have:
        environment["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, have)])
    # rows hold whole documents: batches are bounded by bytes too
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
