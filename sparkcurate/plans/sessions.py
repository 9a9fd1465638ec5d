"""Queries that fold session updates and events; updates are made of the chat messages, one for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.functions import parsers
from sparkcurate.plans.registry import query, table
from sparkcurate.streaming import fold

UPDATES = """with m as (select distinct on (session_id, seq) session_id, seq, lower(trim(role, ' ')) as role, coalesce(content, '') as c from chat_messages order by session_id, seq),
 u as (select session_id, seq, case when role = 'system' then 'plan' when role = 'assistant' and contains(c, '<tool_call>') then 'tool_call' when role = 'assistant' then 'agent_chunk' when role = 'user' and (starts_with(c, 'Tool result:') or starts_with(c, '<tool_response>')) then 'tool_call_update' when role = 'user' then 'user_chunk' end as update_type,
   'call' || (case when role = 'assistant' then seq else seq - 1 end % 4) as tool_call_id, case when role = 'assistant' then nullif(regexp_extract(c, '<function=([^>\\s]+)>', 1), '') end as title, case when role = 'assistant' then 'pending' else 'completed' end as status,
   case when role = 'assistant' then c end as raw_input, case when role = 'user' then c end as raw_output, c as text from m)"""


def updates(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chat_messages").groupBy("session_id", "seq").agg(F.lower(F.trim(F.first("role"))).alias("role"), F.coalesce(F.first("content"), F.lit("")).alias("c"))
    c, role = F.col("c"), F.col("role")
    kind = (
        F.when(role == "system", "plan")
        .when((role == "assistant") & c.contains("<tool_call>"), fold.START)
        .when(role == "assistant", "agent_chunk")
        .when((role == "user") & (c.startswith("Tool result:") | c.startswith("<tool_response>")), fold.PROGRESS)
        .when(role == "user", "user_chunk")
    )
    said = role == "assistant"
    return m.select(
        "session_id",
        "seq",
        kind.alias("update_type"),
        F.concat(F.lit("call"), (F.when(said, F.col("seq")).otherwise(F.col("seq") - 1) % 4).cast("string")).alias("tool_call_id"),
        F.when(said, F.nullif(F.regexp_extract(c, r"<function=([^>\s]+)>", 1), F.lit(""))).alias("title"),
        F.lit(None).cast("string").alias("kind"),
        F.when(said, "pending").otherwise("completed").alias("status"),
        F.when(said, c).alias("raw_input"),
        F.when(role == "user", c).alias("raw_output"),
        c.alias("text"),
    )


def sets(c: str) -> str:
    return f"arg_max_null({c}, seq) filter (where update_type = 'tool_call' or {c} is not null)"


@query(
    "r01_r02_session_fold",
    f"{UPDATES} select session_id, tool_call_id, {sets('title')} as title, {sets('status')} as status, md5({sets('raw_input')}) as raw_input, md5({sets('raw_output')}) as raw_output from u where update_type in ('tool_call', 'tool_call_update') group by 1, 2",
)
def session_fold(spark: SparkSession, d: str) -> DataFrame:
    return fold.tool_calls(updates(spark, d)).select("session_id", "tool_call_id", "title", "status", F.md5("raw_input").alias("raw_input"), F.md5("raw_output").alias("raw_output"))


@query("r01_last_values", f"{UPDATES} select session_id, update_type, arg_max(text, seq) as text from u where update_type in ('plan', 'mode', 'commands') group by 1, 2")
def last_values(spark: SparkSession, d: str) -> DataFrame:
    return fold.last_values(updates(spark, d))


@query("r03_chunk_log", f"{UPDATES} select session_id, update_type, count(*) as chunks, sum(length(text))::bigint as chars, min(seq) as first_seq, max(seq) as last_seq from u where update_type in ('user_chunk', 'agent_chunk', 'thought_chunk') group by 1, 2")
def chunk_log(spark: SparkSession, d: str) -> DataFrame:
    return fold.chunk_log(updates(spark, d))


@query(
    "r04_tool_timings",
    """with e as (select *, last_value(case when event_type = 'view' then epoch_us(ts) / 1e6 end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as s from events)
    select event_id, round(coalesce(epoch_us(ts) / 1e6 - s, 0), 3) as seconds from e where event_type = 'click'""",
)
def tool_timings(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = fold.timings(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_type") == "click", at)
    return rows.select("event_id", F.round("seconds", 3).alias("seconds"))


@query(
    "r05_r06_idle_sessions",
    """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as sid from g)
    select user_id, epoch_us(min(ts)) as began, epoch_us(max(ts)) as last_at, count(*) as events from s group by user_id, sid""",
)
def idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = fold.idle_sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id")
    return rows.select("user_id", F.unix_micros("began").alias("began"), F.unix_micros("last_at").alias("last_at"), "events")


@query("r07_routed", f"{UPDATES} select case when update_type in ('tool_call', 'tool_call_update') then 'tools' when update_type = 'plan' then 'values' else 'chunks' end as route, count(*) as n from u where update_type is not null group by 1")
def routed(spark: SparkSession, d: str) -> DataFrame:
    parts = [df.select(F.lit(name).alias("route")) for name, df in fold.routed(updates(spark, d)).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("route").agg(F.count("*").alias("n"))


@query("s16_s17_frames", "select case event_id % 4 when 0 then 'request' when 1 then 'notification' when 2 then 'response' else 'malformed' end as kind, count(*) as n from events group by 1")
def frames(spark: SparkSession, d: str) -> DataFrame:
    return frame_rows(spark, d).groupBy(parsers.frame_kind(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


def frame_rows(spark: SparkSession, d: str) -> DataFrame:
    k, i = F.col("event_id") % 4, F.floor(F.col("event_id") / 4).cast("string")
    value = F.when(k == 0, F.concat(F.lit('{"id":'), i, F.lit(',"method":"m"}'))).when(k == 1, F.lit('{"method":"n"}')).when(k == 2, F.concat(F.lit('{"id":'), i, F.lit(',"result":"r'), i, F.lit('"}'))).otherwise(F.lit("{oops"))
    return table(spark, d, "events").select("event_id", value.alias("value"))


@query("j11_correlated", "select event_id // 4 as id, 'm' as method, case when event_id + 2 in (select event_id from events) then 'r' || (event_id // 4) end as result from events where event_id % 4 = 0")
def correlated(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    rows = frame_rows(spark, d).select(parsers.frame_kind(v).alias("kind"), F.get_json_object(v, "$.id").cast("bigint").alias("id"), F.get_json_object(v, "$.method").alias("method"), F.get_json_object(v, "$.result").alias("result"))
    return fold.correlated(rows)
