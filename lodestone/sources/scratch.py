"""Folders for tables that live as long as the application."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, deleted when the application ends.

    Driver and executors share that folder.  Only local mode does without the
    setting, by a folder under the SQL warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share.")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/.scratch"
    folder = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch folder and read back, which cuts its lineage."""
    folder = scratch_folder(df.sparkSession, "written")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
