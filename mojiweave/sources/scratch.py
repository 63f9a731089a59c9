"""Tables that are written once and read several times, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share, from spark.checkpoint.dir; a local session without it gets a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="mojiweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared = f"file://{own}"
    return f"{shared.rstrip('/')}/mw-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a written table: what reads it does not compute it again, and no executor holds the only copy."""
    path = f"{new_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
