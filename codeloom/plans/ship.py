"""The package on executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors' Python workers, once in an application."""
    context = spark.sparkContext
    if getattr(context, "_codeloom_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as made:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    made.write(full := os.path.join(folder, name), os.path.relpath(full, os.path.dirname(top)))
    path = os.path.join(tempfile.mkdtemp(), "codeloom.zip")
    with open(path, "wb") as file:
        file.write(held.getvalue())
    context.addPyFile(path)
    context._codeloom_shipped = True
