"""Make the package importable in Python workers that do not have it."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
# Texts reach workers in batches of this size instead of the default one, which with several workers is much memory.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def ship(spark: SparkSession) -> None:
    """Prepare a session for the operators with Python in their tasks.

    Batch sizes that the user did not set are lowered. Once per application a worker is asked for the package, which
    is sent as a zip file if it is missing there.
    """
    if spark.conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from importlib.util import find_spec

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([find_spec("caseflow") is not None])], ["ok"])

    if not spark.range(0, 1, 1, 1).mapInArrow(probe, "ok boolean").first()["ok"]:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="caseflow-zip-")  # read by the driver only, which serves it to the executors
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/caseflow", "zip", package.parent, package.name))
    _SHIPPED.add(app)
