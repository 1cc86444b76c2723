"""Record sink (S9): string records to a topic, or to any other format of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_records(df: DataFrame, value: str = "value") -> DataFrame:
    """``(key, value)`` with a null key."""
    return df.select(F.lit(None).cast("string").alias("key"), F.col(value).cast("string").alias("value"))


def write_records(
    df: DataFrame, value: str = "value", format: str = "kafka", **options: str
) -> None:
    """Send records. For a broker pass ``topic`` and ``kafka.bootstrap.servers``.

    The connector comes with the cluster's session; any other format writes the same rows.
    """
    as_records(df, value).write.format(format).options(**options).mode("append").save()


def stream_records(
    df: DataFrame, checkpoint: str, value: str = "value", format: str = "kafka", **options: str
):
    """The same as a streaming sink, with its progress kept under ``checkpoint``."""
    writer = as_records(df, value).writeStream.format(format).options(**options)
    return writer.option("checkpointLocation", checkpoint)
