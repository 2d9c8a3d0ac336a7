"""Sessions: local ones for tests and bench, and the package's code for executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    settings = {
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once an application: they need not share the driver's folders."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, os.path.join(root.name, path.relative_to(root)))
    spark.sparkContext.addPyFile(str(archive))
