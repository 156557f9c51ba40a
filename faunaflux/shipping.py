"""Sends the package to Python workers, which have it only if it is installed on their machines or in the folder they start in."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()  # applications that have the code


def archive(root: str, path: str) -> str:
    """The sources of the package under root as a zip file that Python can import from."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(os.path.join(root, "faunaflux"))):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    return path


def ship(spark: SparkSession, root: str) -> None:
    """Once for each application: addPyFile copies the file to all executors. Workers of a local session need it, too: what the driver adds to its own path does not reach them."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    sc.addPyFile(archive(root, os.path.join(tempfile.mkdtemp(prefix="faunaflux-code-"), "faunaflux.zip")))
