"""Makes this package importable where executors run Python."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package through Spark's file server, once per application.

    Not needed, and not done, where Python workers find it by PYTHONPATH or start in
    the folder that holds it.
    """
    home = Path(__file__).resolve().parents[2]
    found = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.path.realpath(os.getcwd())}
    app = spark.sparkContext.applicationId
    if str(home) in found or app in _SENT:
        return
    with tempfile.TemporaryDirectory() as d:
        path = shutil.make_archive(f"{d}/sluice", "zip", home, "sluice")
        kept = Path(tempfile.mkdtemp()) / "sluice.zip"
        shutil.move(path, kept)
    spark.sparkContext.addPyFile(str(kept))
    _SENT.add(app)
