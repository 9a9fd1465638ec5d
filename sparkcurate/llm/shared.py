"""What the operators of this subpackage share: the conversation texts, and tables written to the shared folder, so that a lost executor
costs a re-read and not the whole job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.functions.textfn import chat_to_messages, norm_label
from sparkcurate.sources.shared import written

__all__ = ["conversations", "spoken", "spread", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: files of few row groups come in fewer tasks than there are cores, and the operators here spend their time on
    rows, not on reading.  Tables of more files than cores stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spoken(messages: Column) -> Column:
    """The contents of all messages that are not of the system role, one text; '' for a null array."""
    kept = F.filter(messages, lambda m: F.coalesce(norm_label(m["role"]), F.lit("")) != "system")
    return F.coalesce(F.array_join(F.transform(kept, lambda m: F.coalesce(m["content"], F.lit(""))), "\n"), F.lit(""))


def conversations(spark: SparkSession, sf_dir: str, parts: list[tuple[str, str, str]]) -> DataFrame:
    """(src, id, split, source, text) of several tables.

    parts: (table, key column, 'messages' or 'text').  Chat texts are parsed into messages first.  Splits are
    compared without regard to case and outer blanks.
    """
    out = []
    for name, key, kind in parts:
        df = table(spark, sf_dir, name)
        messages = F.col("messages") if kind == "messages" else chat_to_messages(F.col("text"))
        out.append(df.select(F.lit(name).alias("src"), F.col(key).alias("id"), norm_label(F.col("split")).alias("split"), "source", spoken(messages).alias("text")))
    return spread(reduce(DataFrame.unionByName, out))
