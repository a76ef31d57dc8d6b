"""Session construction shared by tests, the bench and the entry point."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_spark(app: str = "lotlens", cores: str | int = "*", shuffle: int = 8) -> SparkSession:
    """A local session; on a cluster the active session is returned unchanged."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOTLENS_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers that would not find it on their path; once per session."""
    root = Path(__file__).resolve().parent.parent
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if any(p and Path(p).resolve() == root for p in paths) or "lotlens.zip" in " ".join(context._python_includes):
        return
    target = os.path.join(tempfile.mkdtemp(), "lotlens.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "lotlens").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(target)
