"""The package's own code for Python workers on machines that have no copy of it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Gives the package to every executor of the session's application, once. Spark serves the archive; no shared folder is needed."""
    context = spark.sparkContext
    if getattr(context, "_groundq_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # within an archive there is nothing to pack: the executors have that archive
        archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="groundq-")), "groundq.zip")  # a path that the JVM reads alike
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(root):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(archive)
    context._groundq_shipped = True
