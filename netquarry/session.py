"""What a session must give: access of Python workers to this package, and written tables that cut lineage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]
_open = threading.local()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, unless PYTHONPATH, the working folder or the installation gives it to them."""
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if os.path.realpath(ROOT) in [*known, os.path.realpath(os.getcwd())] or "site-packages" in str(ROOT) or getattr(context, "_netquarry_shipped", False):
        return
    # Only the driver reads this file: Spark serves it to the executors.
    target = Path(tempfile.mkdtemp(prefix="netquarry-ship-")) / "netquarry.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in (ROOT / "netquarry").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(target))
    context._netquarry_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Unset, a local session gets one of its own and a cluster an error."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="netquarry-checkpoints-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    The table goes when the driver ends, or when the `settled` around it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, there = _file_system(spark, path)
    fs.deleteOnExit(there)
    for paths in getattr(_open, "stack", [])[-1:]:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one task of a large shuffle sorts or hashes.
ROWS_A_TASK = 1_000_000


def parts_for(rows: int, spark: SparkSession) -> int:
    """Partitions of a shuffle of so many rows: the session's number, or more, so that the memory of one task does not grow with the tables."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of build; the tables that were stored on the way are removed."""
    stack = _open.stack = getattr(_open, "stack", [])
    stack.append([])
    try:
        built = build()
        inner, stack[-1] = stack[-1], []
        out = stored(built, name)
        (kept,) = stack[-1]
        stack[-1] = inner
    finally:
        written = stack.pop()
    for path in written:
        fs, there = _file_system(spark, path)
        fs.delete(there, True)
    for paths in stack[-1:]:
        paths.append(kept)
    return out


@lru_cache(maxsize=1)
def _blas():
    """What sets and gets the number of threads of numpy's OpenBLAS, where it is that."""
    for library in (Path(np.__file__).parents[1] / "numpy.libs").glob("*openblas*"):
        loaded = ctypes.CDLL(str(library))
        for name in ("scipy_openblas_{}_num_threads64_", "openblas_{}_num_threads64_", "openblas_{}_num_threads"):
            if hasattr(loaded, name.format("set")):
                return getattr(loaded, name.format("set")), getattr(loaded, name.format("get"))
    return (lambda n: None), (lambda: 1)


def one_blas_thread() -> None:
    """In a Python worker: numpy's matrix products keep to the task's own core. Workers of one executor that each start a thread
    a core wait for one another most of the time."""
    _blas()[0](1)
