"""Session helpers for the registered queries."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

from layerstack.plans.training import checkpoint_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="layerstack-"), "layerstack.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "layerstack")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, ROOT))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a temporary one only on a local master."""
    folder = checkpoint_folder(spark)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.gettempdir()
    return f"{folder.rstrip('/')}/layerstack-{name}-{uuid.uuid4().hex}"
