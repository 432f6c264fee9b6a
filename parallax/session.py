"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
HOME = str(PACKAGE.parent)
_shipped: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package.

    In local mode they find it where the driver did. On a cluster it is sent to the executors, once an application, as they
    may not have the driver's folders.
    """
    context = spark.sparkContext
    env = context.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([HOME, *paths])
    if not context.master.startswith("local") and context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        archive = os.path.join(tempfile.mkdtemp(prefix="parallax-"), "parallax.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(PACKAGE.rglob("*.py")):
                out.write(path, path.relative_to(PACKAGE.parent))
        context.addPyFile(archive)
    return spark
