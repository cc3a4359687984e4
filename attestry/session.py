"""What a session needs once: the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once a context, as Spark hands out Python files."""
    context = spark.sparkContext
    if getattr(context, "attestry_shipped", False) or not os.path.isdir(_PACKAGE):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="attestry-"), "attestry.zip")  # the driver serves it from there
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(top, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(_PACKAGE)))
    context.addPyFile(path)
    context.attestry_shipped = True
