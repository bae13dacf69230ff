"""Live streams: ingesting pushes as they arrive and following sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.runtime import cut
from logloom.schema import LINE, PUSH
from logloom.sources import store
from logloom.sources.push import lines_of


def push_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Pushes from JSON files as they land in a folder, with the time and name of their file;
    ``files`` per batch hold a burst back."""
    x = spark.readStream.schema(PUSH).option("maxFilesPerTrigger", files).json(path)
    return x.select("*", F.col("_metadata.file_modification_time").alias("landed_at"), F.col("_metadata.file_path").alias("file"))


def ingest_stream(pushes: DataFrame, path: str, checkpoint: str, index: bool = True) -> StreamingQuery:
    """Append the lines of a stream of pushes to the store, each batch once.

    Lines are numbered by source in order of their file's time and name and of their place, going
    on from the batches before; a batch that is run again replaces what it wrote, numbers included.
    """

    def append(batch: DataFrame, number: int) -> None:
        lines = cut(lines_of(batch.withColumn("_row", F.monotonically_increasing_id())))
        store.ingest(lines, path, ["landed_at", "file", "_row", "place"], index, str(number))

    return pushes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail(spark: SparkSession, path: str, sources: Sequence[str] = (), files: int = 100) -> DataFrame:
    """A stream of every further line of the given sources, or of all ("*" too), later ones included.

    Only the source filters; query, time range and limit have no say in a tail.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(LINE).option("maxFilesPerTrigger", files)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        # a stream reads folders: of one file, its folder by the file's name
        reader, path = reader.option("pathGlobFilter", hadoop.getName()), hadoop.getParent().toString()
    x = reader.parquet(path)
    x = x.where(F.col("source").isin(list(sources))) if sources and "*" not in sources else x
    return x.select(F.col("source").alias("app"), "ts", "structured", F.col("raw_data").alias("inner"))
