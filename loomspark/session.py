"""What a session needs before Python functions of this package run on executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> SparkSession:
    """Send this package to the executors, whatever their Python path is; once a session."""
    spark = spark or SparkSession.active()
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="loomspark-"), "loomspark")
        context.addPyFile(shutil.make_archive(base, "zip", root, "loomspark"))
        _SHIPPED.add(context.applicationId)
    return spark
