"""Readers of conversation files that keep the order of rows.

row_idx is the place of a record in its file, counted over lines that are not blank.  Files are cut into tasks as usual, so they may be of any
size: lines are numbered within their block of the file, and the numbers of lines of the blocks before are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = "messages array<struct<role:string,content:string>>"
EITHER = f"{MESSAGES}, text string, source string"
SPLITS = ("train", "valid", "test")


def json_lines(spark: SparkSession, path: str, schema: str = MESSAGES, mode: str = "FAILFAST") -> DataFrame:
    """Records of JSON lines; blank lines are skipped; a malformed line is an error, or with PERMISSIVE a row with _corrupt_record,
    or with DROPMALFORMED left out.  Keys outside the schema are dropped."""
    columns = T._parse_datatype_string(schema) if mode != "PERMISSIVE" else T._parse_datatype_string(schema + ", _corrupt_record string")
    return spark.read.schema(columns).option("mode", mode).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def in_order(reader: DataFrameReader, path: str) -> DataFrame:
    """(file, block, line_no, before, value): every line that is not blank with its 1-based place in the file, the block of the file it is read in,
    and how many lines that are not blank the blocks before have.

    A block is read by one task, which numbers its lines one after the other; the counts of blocks are one row each.
    """
    full = F.length(F.trim("value")) > 0
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("id"))
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.count_if(full).alias("full"), F.min("id").alias("first"))
    own = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", "first", F.coalesce(F.sum("lines").over(own), F.lit(0)).alias("lines"), F.coalesce(F.sum("full").over(own), F.lit(0)).alias("before"))
    return lines.join(starts, ["file", "block"]).filter(full).select("file", "block", (F.col("lines") + F.col("id") - F.col("first") + 1).alias("line_no"), "before", "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): every line that is not blank with its 1-based place in the file."""
    return in_order(spark.read, path).select("file", "line_no", "value")


def ordered_records(spark: SparkSession, path: str, schema: str = MESSAGES) -> DataFrame:
    """Records with row_idx from 0 in the order of the file's lines; malformed lines give null columns."""
    nth = F.row_number().over(Window.partitionBy("file", "block").orderBy("line_no"))
    rows = in_order(spark.read, path).withColumn("row_idx", F.col("before") + nth - 1)
    return rows.select("file", "line_no", "row_idx", F.from_json("value", schema).alias("r")).select("file", "line_no", "row_idx", "r.*")


def split_directory(spark: SparkSession, path: str, schema: str = MESSAGES) -> DataFrame:
    """(split, row_idx, ...) of train.jsonl, valid.jsonl and test.jsonl; a missing file is an empty split."""
    empty = spark.createDataFrame([], T._parse_datatype_string(f"file string, line_no bigint, row_idx bigint, {schema}"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = empty.withColumn("split", F.lit(None).cast("string"))
    for s in SPLITS:
        p = hadoop(f"{path}/{s}.jsonl")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            out = out.unionByName(ordered_records(spark, f"{path}/{s}.jsonl", schema).withColumn("split", F.lit(s)))
    return out.drop("file", "line_no")


def tree(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(file, line_no, value) of all files below a directory whose name matches."""
    return in_order(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern), path).select("file", "line_no", "value")


#: Directories whose sources are left out.
SKIPPED = ("test", "tests", "venv", ".venv", "build", "dist", "__pycache__", "node_modules", ".git")


def sources(spark: SparkSession, path: str, low: int = 200, high: int = 50_000, lines: tuple[int, int] = (10, 1_000)) -> DataFrame:
    """(path, content) of Python sources within bounds of size and lines, outside test and build directories; undecodable files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(path)
    skip = "/(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = files.filter((F.col("length") >= low) & (F.col("length") <= high) & ~F.col("path").rlike(skip)).select("path", text.alias("content")).filter("content is not null")
    return rows.filter(F.size(F.split("content", "\n")).between(*lines))


def config(spark: SparkSession, path: str) -> DataFrame:
    """One row of a JSON configuration file."""
    return spark.read.option("multiLine", True).json(path)


def from_turns(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, messages) of single messages; for conversations, whose length is bounded by their nature."""
    m = F.transform(F.array_sort(F.collect_list(F.struct(order, "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return df.groupBy(key).agg(m.alias("messages"))


def frames(spark: SparkSession, path: str) -> DataFrame:
    """A stream of newline-delimited frames: value and kind, malformed ones marked and not dropped."""
    from sparkcurate.functions.parsers import frame_kind

    return spark.readStream.text(path).withColumn("kind", frame_kind(F.col("value")))
