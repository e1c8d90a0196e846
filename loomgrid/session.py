"""Session helpers for callers that run the queries outside the package's folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_loomgrid_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="loomgrid-source-"), "loomgrid_source.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "loomgrid")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, ROOT))
    context.addPyFile(path)
    context._loomgrid_shipped = True


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session, which is one process, may do without the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: the executors share no folder for intermediate tables")
        folder = getattr(spark.sparkContext, "_loomgrid_folder", None) or "file://" + tempfile.mkdtemp(prefix="loomgrid-")
        spark.sparkContext._loomgrid_folder = folder
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "loop") -> DataFrame:
    """``df`` written to the shared folder and read back, so that plans stay short and survive lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
