"""What the operators share: the folder all machines see, and packed arrays."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]
#: Python workers give freed arrays back to the system instead of keeping them for later.
_WORKER_ENV = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def _is_local(spark: SparkSession) -> bool:
    """Driver and workers share one machine and its folders."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def attach(spark: SparkSession) -> None:
    """Let Python workers import this package: by the driver's path on one machine, else shipped to every executor."""
    context = spark.sparkContext
    env = context.environment
    for key, value in _WORKER_ENV.items():
        env.setdefault(key, value)
    if _is_local(spark):
        root = str(_PACKAGE.parent)
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    elif not getattr(context, "_quarry_shipped", False):
        target = Path(tempfile.mkdtemp(prefix="quarry-")) / f"{_PACKAGE.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(_PACKAGE.rglob("*.py")):
                out.write(path, path.relative_to(_PACKAGE.parent))
        context.addPyFile(str(target))  # Spark sends the driver's file to all executors, also to those that join later
        context._quarry_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local one only where that is unset and all runs on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file:///tmp/checkpoints/{os.getpid()}"
    return f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: its lineage ends there.

    Where an upper bound of its (narrow) rows is known, it is written by one task per 100,000 rows at most.
    """
    path = f"{folder}/{name}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // 100_000)))
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing will read again."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def buckets_for(df: DataFrame, column: str, bytes_each: int = 16 << 20) -> tuple[int, int]:
    """How many hash ranges keep about ``bytes_each`` of text in each, for a table of any size, and its bytes."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, -(-int(total) // bytes_each)), int(total)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one compressed block; bytes of equal weight lie together."""
    n = len(arrays[0])
    parts = [np.array([n, *[a.dtype.itemsize for a in arrays]], dtype=np.int64).tobytes()]
    parts += [np.ascontiguousarray(a).view(np.uint8).reshape(n, a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(block: bytes, *kinds: type) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), dtype=np.uint8)
    n = int(data[:8].view(np.int64)[0])
    at, out = 8 * (1 + len(kinds)), []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += n * size
    return out


def ordered(values: np.ndarray) -> np.ndarray:
    """Gaps of a sorted array, which compress well; ``np.cumsum`` restores it."""
    return np.diff(values, prepend=values.dtype.type(0))


assert sys.byteorder == "little"
