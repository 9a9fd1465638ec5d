"""Writers of conversation files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.operators.convert import to_record


def json_lines(df: DataFrame, path: str, order: str = "row_idx", one_file: bool = False) -> None:
    """{"messages": [...]} lines in the order of a column.  Files are ranges of the order, so their names sort as their rows; one_file gathers
    everything in one task and is for small sets only."""
    rows = df.select(order, to_record(F.col("messages")).alias("value"))
    rows = rows.coalesce(1).sortWithinPartitions(order) if one_file else rows.repartitionByRange(order).sortWithinPartitions(order)
    rows.select("value").write.mode("overwrite").text(path)


def split_directory(df: DataFrame, path: str) -> None:
    """One directory per split, rows in order within files."""
    rows = df.select("split", "row_idx", to_record(F.col("messages")).alias("value"))
    rows.repartitionByRange("split", "row_idx").sortWithinPartitions("split", "row_idx").select("split", "value").write.mode("overwrite").partitionBy("split").text(path)


def checkpoint(df: DataFrame, path: str) -> None:
    """The whole set again; in a stream call it from foreachBatch."""
    df.write.mode("overwrite").json(path)


def metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
