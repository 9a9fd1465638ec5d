"""Queries that write files to the shared folder and read them back, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.functions import toolcalls
from sparkcurate.functions.textfn import text0
from sparkcurate.operators import checks, split
from sparkcurate.plans.curation import N, WHITE
from sparkcurate.plans.registry import query, table
from sparkcurate.plans.sessions import UPDATES, sets, updates
from sparkcurate.sources import ingest, sinks
from sparkcurate.sources.shared import fresh
from sparkcurate.streaming import fold

CHARS = "coalesce(list_sum([length(coalesce(m.content, '')) for m in messages]), 0)::bigint"
ONE = "(select distinct on (row_id) * from training_rows)"


def one_each(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "training_rows").groupBy("row_id").agg(F.first("messages").alias("messages"), F.first("split").alias("split"))
    return rows.withColumn("split", F.lower(F.btrim("split", F.lit(" \t\n\r\x0b\x0c"))))


def chars(m) -> DataFrame:
    return F.coalesce(F.aggregate(m, F.lit(0).cast("bigint"), lambda s, x: s + F.length(text0(x["content"]))), F.lit(0))


@query("s01_s04_s05_k01_json_lines", f"select count(*) as records, sum({N})::bigint as messages, sum({CHARS})::bigint as chars from {ONE}")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Written in order as JSON lines, read back strictly."""
    path = fresh(spark, "lines")
    sinks.json_lines(one_each(spark, d).withColumnRenamed("row_id", "row_idx"), path)
    m = F.col("messages")
    return ingest.json_lines(spark, path).agg(F.count("*").alias("records"), F.sum(F.coalesce(F.size(m), F.lit(0))).alias("messages"), F.sum(chars(m)).alias("chars"))


@query("s02_k02_split_directories", f"select lower(trim(split, ' ')) as split, count(*) as records, sum({CHARS})::bigint as chars from {ONE} group by 1")
def split_directories(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "splits")
    sinks.split_directory(one_each(spark, d).withColumnRenamed("row_id", "row_idx"), path)
    rows = spark.read.schema("messages array<struct<role:string,content:string>>, split string").option("mode", "FAILFAST").json(path)
    return rows.groupBy("split").agg(F.count("*").alias("records"), F.sum(chars(F.col("messages"))).alias("chars"))


@query("s03_recursive_tolerant_scan", f"select count(*) + 2 as lines, 1 as malformed, count(*) filter (where {N} < 2) + 1 as short from {ONE}")
def recursive_scan(spark: SparkSession, d: str) -> DataFrame:
    """A tree of files with one malformed and one empty record among them; blank lines are no lines."""
    path = fresh(spark, "tree")
    sinks.json_lines(one_each(spark, d).withColumnRenamed("row_id", "row_idx"), f"{path}/a/b")
    spark.createDataFrame([("{broken",), ("   ",), ('{"messages": []}',)], "value string").coalesce(1).write.text(f"{path}/c")
    rows = ingest.tree(spark, path, "*.txt").withColumn("r", F.from_json("value", ingest.MESSAGES)).withColumn("keys", F.json_object_keys("value"))
    bad = F.col("keys").isNull()
    return rows.agg(F.count("*").alias("lines"), F.count_if(bad).cast("int").alias("malformed"), F.count_if(~bad & (F.coalesce(F.size("r.messages"), F.lit(0)) < 2)).alias("short"))


@query("k03_k04_checkpoints", "select category, count(*) as n from eval_prompts group by 1")
def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    path = fresh(spark, "checkpoint")
    prompts = table(spark, d, "eval_prompts")
    sinks.checkpoint(prompts.limit(0), path)
    sinks.checkpoint(prompts, path)
    back = spark.read.schema("prompt_id string, category string").json(path)
    metrics = fresh(spark, "metrics")
    sinks.metrics(back.groupBy("category").agg(F.count("*").alias("n")), metrics)
    return spark.read.schema("category string, n bigint").json(metrics)


@query(
    "s08_two_pass_scan",
    "(select text_id, 'tool' as kind from chat_text where contains(coalesce(text, ''), '<tool_call>') order by text_id limit 350) union all (select text_id, 'direct' from chat_text where not contains(coalesce(text, ''), '<tool_call>') order by text_id limit 100)",
)
def two_pass_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chat_text").select("text_id", F.when(text0(F.col("text")).contains("<tool_call>"), "tool").otherwise("direct").alias("kind"))
    return split.top(rows.filter("kind = 'tool'"), 350, F.col("text_id")).unionByName(split.top(rows.filter("kind = 'direct'"), 100, F.col("text_id")))


@query("s11_source_tree", "select doc_id from documents where path like '%.py' and not regexp_matches('/' || path, '/(test|tests|venv|build|dist)/') and length(text) between 200 and 50000 and len(string_split(text, chr(10))) between 10 and 1000")
def source_tree(spark: SparkSession, d: str) -> DataFrame:
    """The bounds of the source scan on a table of files; sources.ingest.sources reads real trees."""
    path, text = F.col("path"), F.col("text")
    keep = path.like("%.py") & ~F.concat(F.lit("/"), path).rlike("/(test|tests|venv|build|dist)/") & F.length(text).between(200, 50_000) & F.size(F.split(text, "\n")).between(10, 1_000)
    return table(spark, d, "documents").filter(keep).select("doc_id")


@query("l10_first_issues", f"select row_id, least({N}, 3)::int as shown from training_rows")
def first_issues(spark: SparkSession, d: str) -> DataFrame:
    """Lists are cut to their first three entries."""
    m = F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>"))
    return table(spark, d, "training_rows").select("row_id", F.size(F.slice(F.concat(F.transform(m, lambda x: x["role"])), 1, 3)).alias("shown"))


@query(
    "x30_e13_answer_rules",
    """with c as (select session_id, seq, coalesce(content, '') as c from chat_messages where role = 'assistant')
    select case when not contains(c, '<tool_call>') and not contains(c, '<function=') then 'no_call' when not contains(c, '<function=') and not regexp_matches(c, '<tool_call>\\s*\\{\\s*"name":\\s*"[^"]+"') then 'no_name' when not contains(c, '</tool_call>') then 'open' else 'ok' end as verdict, count(*) as n from c group by 1""",
)
def answer_rules(spark: SparkSession, d: str) -> DataFrame:
    """Ordered rules: a call at all, a name that can be read, a closed tag."""
    c = text0(F.col("content"))
    verdict = F.when(~c.contains("<tool_call>") & ~c.contains("<function="), "no_call").when(F.size(toolcalls.call_names(F.col("content"))) == 0, "no_name").when(~c.contains("</tool_call>"), "open").otherwise("ok")
    return table(spark, d, "chat_messages").filter("role = 'assistant'").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def streamed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a stream of its files, and a path for its checkpoint."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path), fresh(spark, "offsets")


@query("r10_micro_batches", "select role, count(*) as n from chat_messages group by 1")
def micro_batches(spark: SparkSession, d: str) -> DataFrame:
    """Every micro-batch appends its counts; the sum over batches is that of the table."""
    stream, offsets = streamed(table(spark, d, "chat_messages").select("role", "seq"), "messages")
    out = fresh(spark, "counts")

    def batch(df: DataFrame, _: int) -> None:
        df.groupBy("role").agg(F.count("*").alias("n")).write.mode("append").parquet(out)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("role string, n bigint").parquet(out).groupBy("role").agg(F.sum("n").alias("n"))


@query(
    "r01_streamed_session_fold",
    f"{UPDATES} select session_id, tool_call_id, {sets('title')} as title, {sets('status')} as status from u where update_type in ('tool_call', 'tool_call_update') group by 1, 2",
)
def streamed_session_fold(spark: SparkSession, d: str) -> DataFrame:
    return folded_stream(spark, updates(spark, d))


def folded_stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The fold as a stateful stream; the last state of every call is that of the batch.  Updates arrive in order of seq, in one file a range."""
    stream, offsets = streamed(rows.repartitionByRange(4, "seq").sortWithinPartitions("seq"), "updates")
    out = fresh(spark, "states")

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    fold.stream_tool_calls(stream).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    states = spark.read.schema("session_id string, tool_call_id string, title string, status string, batch int").parquet(out)
    last = states.groupBy("session_id", "tool_call_id").agg(F.max_by(F.struct("title", "status"), "batch").alias("s"))
    return last.select("session_id", "tool_call_id", "s.title", "s.status")


@query("r06_windowed_stream", "select epoch_us(time_bucket(interval 1 hour, ts)) as hour, count(*) as n from events group by 1")
def windowed_stream(spark: SparkSession, d: str) -> DataFrame:
    """Event-time windows with a watermark, in complete mode."""
    stream, offsets = streamed(table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts")), "events")
    out = fresh(spark, "hours")
    hours = stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))

    def batch(df: DataFrame, _: int) -> None:
        df.select(F.unix_micros("w.start").alias("hour"), "n").write.mode("overwrite").parquet(out)

    hours.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("hour bigint, n bigint").parquet(out)


@query("e11_rule_counts", f"""select code, count(*) as n from (select case when {N} < 2 then 'too_few' end as code from training_rows union all select case when {N} > 0 and coalesce(messages[-1].role, '') <> 'assistant' then 'last_role' end from training_rows
    union all select case when not coalesce(m.role in ('system', 'user', 'assistant', 'tool'), false) then 'role' end from (select unnest(messages) as m from training_rows)
    union all select case when length(trim(coalesce(m.content, ''), {WHITE})) = 0 then 'empty' end from (select unnest(messages) as m from training_rows)) where code is not null group by 1""")
def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "training_rows").select(F.explode(checks.validation_errors(F.col("messages"))).alias("code"))
    return codes.groupBy(F.substring_index("code", ":", 1).alias("code")).agg(F.count("*").alias("n"))
