"""Topic scans and sinks: Kafka where its connector is present, files otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflow.functions.json_text import encode_json
from cardflow.schemas import TOPIC_SCHEMA, Field

_COLUMNS = TOPIC_SCHEMA.fieldNames()


def _from_kafka(df: DataFrame) -> DataFrame:
    text = {c: F.col(c).cast("string") for c in ("key", "value")}
    return df.withColumns(text).select(*_COLUMNS)


def read_topic(
    spark: SparkSession,
    topic: str,
    *,
    path: str | None = None,
    file_format: str = "parquet",
    kafka: dict[str, str] | None = None,
    streaming: bool = False,
    **options: str,
) -> DataFrame:
    """Keyed text records of one topic, from the earliest one on.

    ``kafka`` holds the connector's options; ``path`` is a folder of topic files.
    Bound the size of a micro-batch with ``maxOffsetsPerTrigger`` or
    ``maxFilesPerTrigger`` in ``options``.
    """
    reader = spark.readStream if streaming else spark.read
    if kafka is not None:
        opts = {"startingOffsets": "earliest", **kafka, "subscribe": topic, **options}
        return _from_kafka(reader.format("kafka").options(**opts).load())
    if path is None:
        raise ValueError("give a path or Kafka options")
    return reader.schema(TOPIC_SCHEMA).format(file_format).options(**options).load(path)


def publish(df: DataFrame, key: Column, fields: tuple[Field, ...]) -> DataFrame:
    """Records ready for a topic: the caller's key and the JSON text."""
    return df.select(key.alias("key"), encode_json(fields).alias("value"))


def write_topic(
    df: DataFrame,
    topic: str,
    *,
    path: str | None = None,
    file_format: str = "parquet",
    kafka: dict[str, str] | None = None,
    mode: str = "append",
) -> None:
    """Append ``key`` and ``value`` to a topic."""
    if kafka is not None:
        df.select("key", "value").write.format("kafka").options(**kafka, topic=topic).save()
        return
    if path is None:
        raise ValueError("give a path or Kafka options")
    df.write.mode(mode).format(file_format).save(path)
