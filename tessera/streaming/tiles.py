"""Tile files as they arrive (an extension: batch runs need none of it).

Workers drop one file per tile; the stream keeps the first copy of each cell and
can count positives per tile as it goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def tile_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1000, late: str = "1 day") -> DataFrame:
    """Rows of tile files in arrival order, retried tiles once. A retry is looked
    for among files written up to ``late`` before the newest, which bounds the state."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    dated = rows.select("*", F.col("_metadata.file_modification_time").alias("_written")).withWatermark("_written", late)
    return dated.dropDuplicatesWithinWatermark(["tile_index", "cell_id"]).drop("_written")


def tile_counts(rows: DataFrame, flag: str) -> DataFrame:
    """Cells and positives per tile so far."""
    return rows.groupBy("tile_index").agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("int")).alias("n_pos"))


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts per event-time window with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def append_to(rows: DataFrame, path: str, checkpoint: str):
    """Append to one partitioned dataset, exactly once; ends when what is there is read."""
    return rows.writeStream.format("parquet").partitionBy("tile_index").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
