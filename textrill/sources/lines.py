"""Text lines in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.functions.text import java_split


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """S1, S7. One row per line, ``(value)``."""
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """S2. Lines of files that appear in a directory."""
    return spark.readStream.text(path)


def stream_named_lines(spark: SparkSession, path: str) -> DataFrame:
    """S2. Lines with the file they stand in, ``(value, file)``."""
    return stream_lines(spark, path).select("value", F.col("_metadata.file_path").alias("file"))


def with_ids(named: DataFrame) -> DataFrame:
    """``(id, value)`` of a batch of lines ``(value, file)``, a row per line.

    The id is a digest of the file, the line and its number among the equal lines of the file. Equal lines
    are counted first, so a replay gives the same ids whatever the order, and a line that is
    repeated often is one row of the shuffle.
    """
    counted = named.groupBy("file", "value").agg(F.count("*").alias("_n"))
    each = counted.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return each.select(F.sha2(F.to_json(F.struct("file", "_k", "value")), 256).alias("id"), "value")


def stream_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S2. Rows of parquet files that appear in a directory."""
    return spark.readStream.schema(schema).parquet(path)


def write_labelled(df: DataFrame, path: str) -> None:
    """Write ``(text, y)`` as ``text<TAB>label`` lines."""
    df.select(F.concat_ws("\t", "text", "y")).write.text(path)


def parse_labelled(
    lines: DataFrame,
    text_field: int = 0,
    label_field: int = 1,
    id_field: int | None = None,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """S3, S4. ``([id,] text, y)`` of tab-separated lines, and the lines that are too short.

    Trailing empty fields do not count, so a line without a label is a reject. ``keep`` names columns of
    ``lines`` that the rows hand on.
    """
    fields = lines.select(*keep, "value", java_split(F.col("value"), "\t").alias("_f"))
    needed = max(text_field, label_field, id_field or 0) + 1
    complete = F.size("_f") >= needed
    names = {"text": text_field, "y": label_field}
    if id_field is not None:
        names = {"id": id_field, **names}
    rows = fields.where(complete).select(
        *keep,
        *(F.get("_f", F.lit(position)).alias(name) for name, position in names.items())
    )
    return rows, fields.where(~complete).select("value")


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """S6. ``(word)``, one per line. A missing file is an empty list, as without one."""
    try:
        return spark.read.text(path).withColumnRenamed("value", "word")
    except AnalysisException:
        return spark.sql("SELECT CAST(NULL AS STRING) AS word WHERE false")


def read_corpus(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """S7. An external corpus as ``(tokens)``, one text per line."""
    return read_lines(spark, path).select(java_split(F.col("value"), separator).alias("tokens"))
