"""This package in the Python workers: by the driver's path on one machine, else sent to every executor."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def attach(spark: SparkSession) -> None:
    """Call before a plan whose Python functions live in this package."""
    context = spark.sparkContext
    if re.fullmatch(r"local(\[.*\])?", context.master):
        root, held = str(_PACKAGE.parent), context.environment.get("PYTHONPATH", "")
        if root not in held.split(os.pathsep):
            context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)
    elif not getattr(context, "_quarry_shipped", False):
        target = Path(tempfile.mkdtemp(prefix="quarry-")) / f"{_PACKAGE.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(_PACKAGE.rglob("*.py")):
                out.write(path, path.relative_to(_PACKAGE.parent))
        context.addPyFile(str(target))
        context._quarry_shipped = True
