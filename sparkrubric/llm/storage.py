"""Tables in the shared folder, and what Python workers need, for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sparkrubric.sources.lineage import materialize as written
from sparkrubric.sources.lineage import shared_folder

__all__ = ["discard", "ready_for_python", "shared_folder", "written"]


_SHIPPED: set[str] = set()


def ready_for_python(spark: SparkSession, rows: int = 512) -> None:
    """Give the Python workers this package, and at most ``rows`` rows in an Arrow batch: a batch holds whole texts, so
    its bytes follow their lengths."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, str(file.relative_to(package.parent)))
        context.addPyFile(str(archive))  # Spark sends it to every executor
        _SHIPPED.add(context.applicationId)


def discard(df: DataFrame) -> None:
    """Delete the table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    folder = shared_folder(spark).rpartition(":")[2]
    for made in {file.rpartition("/")[0] for file in df.inputFiles()}:
        if made.rpartition("/")[0].endswith(folder):  # only what lies in the shared folder itself
            path = spark._jvm.org.apache.hadoop.fs.Path(made)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
