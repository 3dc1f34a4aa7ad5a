"""Making the package importable in Python workers."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch that goes to a Python worker: whole texts, so a batch of Spark's 10,000 rows can be large.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def ship(spark: SparkSession) -> None:
    """Send the package to all executors, once for each application (as ``--py-files`` would).

    Arrow batches are held to BATCH in this session, for the memory of executors and their Python workers.
    """
    context = spark.sparkContext
    spark.conf.set(*BATCH)
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="chalkline-ship-"), "chalkline.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
