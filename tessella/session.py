"""Session helpers: the package on the executors, defaults for local runs."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that Arrow functions find it there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    at = os.path.join(tempfile.mkdtemp(prefix="tessella-code-"), "tessella_code.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(_ROOT):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(_ROOT)))
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)


def local_session(cores: int | str = "*", name: str = "tessella") -> SparkSession:
    """A session for tests and the bench; on a cluster the submitted configuration is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSELLA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
