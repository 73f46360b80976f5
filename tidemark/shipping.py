"""Makes this package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers once per application.

    Functions that run on executors are pickled by module name, so the workers must be able to
    import ``tidemark`` wherever the driver was started from.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(package)
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tidemark-")), "tidemark_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
