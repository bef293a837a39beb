"""Making packages importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession, *folders: str) -> None:
    """Send package folders (this package by default) to all workers, once per application.

    Arrow functions are found by import there, so the package must be installed on the executors,
    passed with ``--py-files``, or sent like this.
    """
    context = spark.sparkContext
    for folder in folders or (os.path.dirname(os.path.abspath(__file__)),):
        if (context.applicationId, folder) in _shipped:
            continue
        name = os.path.basename(folder)
        archive = os.path.join(tempfile.mkdtemp(prefix="spanloom-ship-"), f"{name}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for base, _, files in os.walk(folder):
                for file in sorted(files):
                    if file.endswith(".py"):
                        path = os.path.join(base, file)
                        out.write(path, os.path.join(name, os.path.relpath(path, folder)))
        context.addPyFile(archive)
        _shipped.add((context.applicationId, folder))
