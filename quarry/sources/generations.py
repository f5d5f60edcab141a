"""Published generations of a set of tables: content-addressed units, and a pointer that only one writer can create.

Below a root, ``units/<digest>`` holds a table once, whoever publishes it; ``refs/<ref>/<generation>.json`` names the
units of a generation.  A writer stages units that are not there yet, then creates the pointer of the generation after
the one it read.  The pointer appears whole or not at all and never replaces another, so of two writers that read the
same generation one wins; the other gets ``Conflict``, and ``update`` repeats its change on what has won.  Readers see a
whole generation at any time.  A writer that is lost leaves a staged folder that nothing names.

A unit's digest is that of its rows as a multiset with their column names and types: their number and two 64-bit sums of
row hashes.  Unchanged units keep their digest, so they are neither written nor read again.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has published the generation that was to be written."""


def _files(spark: SparkSession, path: str):
    """(file system, path) of the cluster's storage."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def digest_of(df: DataFrame) -> str:
    """A digest of a table's rows in any order."""
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    whole = lambda c: F.sum(c.cast("decimal(38,0)")).cast("string")
    n, a, b = df.select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b")).agg(F.count("*"), whole(F.col("a")), whole(F.col("b"))).first()
    return hashlib.sha256(json.dumps([df.schema.simpleString(), n, a, b]).encode()).hexdigest()


def stage(spark: SparkSession, root: str, df: DataFrame) -> tuple[str, bool]:
    """(digest, whether it was there before) of a unit that is now below ``root``."""
    digest = digest_of(df)
    files, target = _files(spark, f"{root}/units/{digest}")
    if files.exists(target):
        return digest, True
    staged = f"{root}/staged/{uuid.uuid4().hex}"
    df.write.parquet(staged)
    _, source = _files(spark, staged)
    files.mkdirs(target.getParent())
    if not files.exists(target):
        files.rename(source, target)
    if files.exists(source):  # another writer was first with the same rows
        files.delete(source, True)
    return digest, False


def _created(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole unless it exists; False if it does."""
    files, target = _files(spark, path)
    part = f"{path}.{uuid.uuid4().hex}"
    _, source = _files(spark, part)
    files.mkdirs(target.getParent())
    out = files.create(source, False)
    out.write(bytearray(text.encode()))
    out.close()
    if files.getUri().getScheme() == "file":
        # A local rename replaces; a hard link does not.
        name = lambda p: unquote(urlparse(re.sub(r"^file:/+", "file:///", p)).path) if p.startswith("file:") else p
        try:
            os.link(name(part), name(path))
            return True
        except FileExistsError:
            return False
        finally:
            files.delete(source, False)
    won = not files.exists(target) and files.rename(source, target)
    if not won:
        files.delete(source, False)
    return won


def _ref(root: str, ref: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", ref):
        raise ValueError(f"no name of a ref: {ref!r}")
    return f"{root}/refs/{ref}"


def newest(spark: SparkSession, root: str, ref: str) -> int:
    """The generation a ref is at; 0 if it was never published."""
    files, folder = _files(spark, _ref(root, ref))
    if not files.exists(folder):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return max([0, *[int(n[:-5]) for n in names if re.fullmatch(r"[0-9]+\.json", n)]])


def units_of(spark: SparkSession, root: str, ref: str, generation: int | None = None) -> dict[str, str]:
    """Names and digests of a generation's units; of the newest by default."""
    generation = newest(spark, root, ref) if generation is None else generation
    if not generation:
        return {}
    return json.loads(spark.read.text(f"{_ref(root, ref)}/{generation}.json", wholetext=True).first()[0])


def load(spark: SparkSession, root: str, ref: str, generation: int | None = None) -> dict[str, DataFrame]:
    """The tables of a generation."""
    return {name: spark.read.parquet(f"{root}/units/{digest}") for name, digest in units_of(spark, root, ref, generation).items()}


def publish(spark: SparkSession, root: str, ref: str, tables: dict[str, DataFrame], expected: int) -> dict[str, bool]:
    """Publish tables as the generation after ``expected``; by name, whether a unit was there before."""
    made = {name: stage(spark, root, df) for name, df in tables.items()}
    pointer = json.dumps({name: digest for name, (digest, _) in made.items()}, sort_keys=True)
    if newest(spark, root, ref) != expected or not _created(spark, f"{_ref(root, ref)}/{expected + 1}.json", pointer):
        raise Conflict(f"{ref} is not at generation {expected}")
    return {name: held for name, (_, held) in made.items()}


def update(spark: SparkSession, root: str, ref: str, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], tries: int = 5) -> int:
    """Publish what ``change`` makes of the newest generation, again on a newer one if another writer was first; the generation."""
    for _ in range(tries):
        at = newest(spark, root, ref)
        try:
            publish(spark, root, ref, change(load(spark, root, ref, at)), at)
            return at + 1
        except Conflict:
            continue
    raise Conflict(f"{ref} was published by others {tries} times")
