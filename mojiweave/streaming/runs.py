"""Streams of files: keystrokes that arrive in files, frames that are written as files, and a checkpoint to go on from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mojiweave.sources.scratch import new_folder
from mojiweave.streaming.sessions import decode_stream

__all__ = ["catch_up", "deliver", "new_folder"]

KEYS = "session_id string, seq long, op string, text string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def deliver(keys: DataFrame, folder: str) -> None:
    """Adds keystrokes to the files that a stream over folder reads."""
    keys.select("session_id", "seq", "op", "text").write.mode("append").parquet(f"{folder}/keys")


def catch_up(spark: SparkSession, folder: str, kind=None, **options) -> DataFrame:
    """Reads all files that have arrived since the last run, from its checkpoint, and stops; all frames written so far."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        frames = decode_stream(spark.readStream.schema(KEYS).parquet(f"{folder}/keys"), kind, **options)
        running = frames.writeStream.format("parquet").option("path", f"{folder}/frames").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    return spark.read.schema(frames.schema).parquet(f"{folder}/frames")
