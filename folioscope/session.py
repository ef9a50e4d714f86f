"""What a query needs of its session besides Spark itself."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package, also where they start in another folder than the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    folder = tempfile.mkdtemp()
    sc.addPyFile(shutil.make_archive(f"{folder}/folioscope", "zip", ROOT, "folioscope"))
    _shipped.add(sc.applicationId)


def work_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir; where that is unset, in the warehouse, which is refused on a
    cluster if it is a folder of the driver's machine. The file system removes it when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    alone = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    if not alone and not spark.conf.get("spark.checkpoint.dir", None) and base.startswith(("file:", "/")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    path = f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows written to a shared folder and read again: what follows starts from there."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
