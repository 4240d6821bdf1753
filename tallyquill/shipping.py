"""Makes this package importable by the Python workers of any cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: A setting of this engine: bytes of an Arrow batch for a Python worker, where the session doesn't set Spark's own.
#: Texts differ in length by orders of magnitude, and what a worker makes of a batch is several times as large.
OWN_BYTES, BATCH_BYTES, MOST_BYTES = "tallyquill.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship(spark: SparkSession) -> None:
    """Adds this package's modules to the application's Python files, once a context.

    The first call also bounds the batches sent to Python workers: to ``tallyquill.arrow.maxBytesPerBatch``
    (8 MB), unless the session has a value of its own for Spark's setting, whichever it is. The driver
    serves the archive to the executors; no executor reads the driver's disk.
    """
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, spark.conf.get(OWN_BYTES, str(MOST_BYTES)))
    sc = spark.sparkContext
    if getattr(sc, "_tallyquill_shipped", False):
        return
    here = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tallyquill-")) / "tallyquill.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted(here.rglob("*.py")):
            out.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(archive))
    sc._tallyquill_shipped = True
