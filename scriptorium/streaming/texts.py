"""The text operators on streams: they keep no state, so a stream's rows are treated as a table's are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import cleaner, entities, resolver


def read_stream(spark: SparkSession, path: str, schema, files_each: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def cleaned(stream: DataFrame, text: str = "text") -> DataFrame:
    """The stream with its text cleaned and resolved, and the e-mail addresses of the raw text."""
    return stream.withColumn("clean_text", resolver.resolve(cleaner.clean(F.col(text)))).withColumn("emails", entities.entity(F.col(text), "email"))


def write(stream: DataFrame, path: str, checkpoint: str):
    """Starts writing what there is, then stops: a restart goes on where the checkpoint says."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
