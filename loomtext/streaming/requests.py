"""Requests as they arrive: files of JSON lines in, responses out.

The steps are those of the batch job: pass the stream to ``serve_requests``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomtext.session import checkpoint_root
from loomtext.sources.schemas import REQUEST


def read_request_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New request files in a folder; the batch size is bounded by the file count."""
    return (
        spark.readStream.schema(REQUEST).option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def start_stream(
    df: DataFrame, path: str, name: str, checkpoint: str | None = None, once: bool = False
) -> StreamingQuery:
    """Append a stream to a Parquet folder, each row once.

    Progress is kept under the session's shared checkpoint folder unless given.
    ``once`` answers what is there and ends.
    """
    location = checkpoint or f"{checkpoint_root(df.sparkSession)}/{name}"
    writer = df.writeStream.format("parquet").outputMode("append").queryName(name).option("path", path)
    writer = writer.option("checkpointLocation", location)
    if not once:
        return writer.start()
    # State with a time to live asks for one empty batch after another; a query
    # that is to end when all is answered does without.  It keeps the setting of its start.
    conf, empty_batches = df.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(empty_batches)
    conf.set(empty_batches, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(empty_batches, before)
