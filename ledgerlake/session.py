"""Session construction. Cluster deployments normally bring their own session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app_name: str = "ledgerlake", master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution on, UTC, web interface off; ``settings`` override (dots as ``__``).

    No shuffle partition count is fixed for a cluster: adaptive execution coalesces and splits
    partitions from measured sizes. A local master gets a small initial number instead of 200.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.sql.shuffle.partitions", "8")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so it need not be installed there."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ledgerlake-")).resolve() / "ledgerlake.zip"
    with zipfile.ZipFile(archive, "w") as zipped:
        for file in sorted(root.rglob("*.py")):
            zipped.write(file, str(file.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)
