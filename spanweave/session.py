"""What a Spark session needs once: this package on its executors, and Arrow batches that suit whole texts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch where the session has Spark's default: some MB of texts, not tens.
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's modules to the executors' Python workers, once per application; returns spark."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="spanweave-")) / "spanweave.zip"
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)
        if spark.conf.get(_ROWS) == "10000":
            spark.conf.set(_ROWS, "2000")
    return spark
