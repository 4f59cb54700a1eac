"""Session helpers: the package on the executors, and tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Put this package on the executors' Python path, once for each Spark context.

    The same as submitting with ``--py-files``; it lets Python tasks import
    ``sparkloom`` wherever the driver was started.
    """
    sc = spark.sparkContext
    if getattr(sc, "_sparkloom_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="sparkloom-"))
    with zipfile.ZipFile(folder / "sparkloom.zip", "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(folder / "sparkloom.zip"))
    sc._sparkloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none, and Spark runs in one process, a new
    temporary folder stands in for it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark.sparkContext, "_sparkloom_dir", None)
    if made is None or not os.path.isdir(made):
        made = tempfile.mkdtemp(prefix="sparkloom-shared-")
        spark.sparkContext._sparkloom_dir = made
    return f"file://{made}"


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back; its last columns ``by`` are folders.

    Cuts the lineage: what reads the result survives the loss of any executor
    without computing ``df`` again, and reads it as often as it likes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete every table that ``written`` made in this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sparkloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
