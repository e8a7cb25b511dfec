"""Incremental ingest: files that arrived since the last run, contents that were never seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HASH = "content_hash"


def arrivals(spark: SparkSession, path: str, schema: StructType, form: str = "parquet", files: int = 1000) -> DataFrame:
    """A stream of the rows of new files below a path, at most ``files`` files a batch (a batch size, not a limit)."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").load(path)


def unseen(stream: DataFrame, content: str) -> DataFrame:
    """The rows whose content (null counts as empty) has not come before, one for each; the state holds every hash that was seen."""
    return stream.withColumn(HASH, F.sha2(F.coalesce(F.col(content), F.lit("").cast(stream.schema[content].dataType)).cast("binary"), 256)).dropDuplicates([HASH])


def ingest(rows: DataFrame, out: str, state: str) -> None:
    """Appends what a stream has now to a Parquet table and ends.

    ``state`` keeps the files that were read and the state of the stream: a run that breaks off is
    taken up where it was, and a batch that is written again replaces itself, so nothing comes twice.
    """
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
