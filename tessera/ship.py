"""Makes this package importable in Python workers on other machines."""

from __future__ import annotations

import io
import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
PLAN, BATCH, BYTES = 1 << 16, 1 << 21, "spark.sql.execution.arrow.maxBytesPerBatch"
_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors once per application, and keeps Arrow batches (a row may be a long text) and the plan texts that the driver stores small."""
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if spark.conf.get(BYTES) in ("64MB", "67108864", "67108864b"):
        spark.conf.set(BYTES, str(BATCH))
    context = spark.sparkContext
    if context.applicationId not in _sent:
        _sent.add(context.applicationId)
        if str(ROOT) not in sys.path:
            sys.path.insert(0, str(ROOT))
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for p in sorted((ROOT / "tessera").rglob("*.py")):
                z.write(p, p.relative_to(ROOT))
        path = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera.zip")
        Path(path).write_bytes(packed.getvalue())
        context.addPyFile(path)
    return spark
