"""Queries that audit datasets: statistics, checks, coverage, balance, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.functions.textfn import count_of, strip, text0
from sparkcurate.operators import checks, filters, setops
from sparkcurate.plans.curation import NORM, N, some
from sparkcurate.plans.registry import query, table

ANSWER = "coalesce([coalesce(m.content, '') for m in messages if m.role = 'assistant'][1], '')"
TOOL = """case when not contains(a, '<tool_call>') then 'direct_answer' when contains(a, 'goto_definition') then 'goto_definition' when contains(a, 'find_references') then 'find_references'
  when contains(a, 'hover') then 'hover' when contains(a, 'document_symbols') then 'document_symbols' when contains(a, 'workspace_symbols') then 'workspace_symbols' when contains(a, 'typecheck') then 'typecheck'
  when contains(a, 'ruff_check') then 'ruff_check' when contains(a, 'pytest_run') then 'pytest_run' when contains(a, 'git_status') then 'git_status' when contains(a, 'git_diff') then 'git_diff'
  when contains(a, 'git_log') then 'git_log' when contains(a, 'read_file') then 'read_file' when contains(a, 'write_file') then 'write_file' when contains(a, 'run_command') then 'run_command' else 'other' end"""
#: Calls of the tables' own functions by the names the classes and audits look for, so that every class occurs.
NAMED = {"scan_files": "find_references", "open_file": "read_file", "save_file": "write_file", "locate_symbol": "goto_definition", "probe_types": "typecheck", "run_checks": "ruff_check", "diff_tree": "git_diff", "show_history": "git_log", "exec_snippet": "run_command"}


def renamed_sql(c: str) -> str:
    for old, new in NAMED.items():
        c = f"replace({c}, '{old}', '{new}')"
    return c


def renamed(c: Column) -> Column:
    for old, new in NAMED.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def renamed_rows(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), renamed(m["content"]).alias("content"))))


RENAMED = f"(select * replace ([{{'role': m.role, 'content': {renamed_sql('m.content')}}} for m in messages] as messages) from training_rows)"


def rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_rows")


@query(
    "a01_a02_dataset_stats",
    f"""select dataset, count(*) filter (where s = 'train') as train, count(*) filter (where s = 'valid') as valid, count(*) filter (where s = 'test') as test, coalesce(avg({N}), 0.0)::double as avg_messages,
    count(*) filter (where s = 'train') * 100.0::double / greatest(count(*), 1) as train_pct from (select *, {NORM} as s from training_rows) group by dataset""",
)
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower(F.btrim("split", F.lit(" \t\n\r\x0b\x0c")))
    part = lambda x: F.count_if(s == x)
    return rows(spark, d).groupBy("dataset").agg(
        part("train").alias("train"), part("valid").alias("valid"), part("test").alias("test"), F.coalesce(F.avg(F.coalesce(F.size("messages"), F.lit(0))), F.lit(0.0)).alias("avg_messages"), (part("train") * F.lit(100.0) / F.greatest(F.count("*"), F.lit(1))).alias("train_pct")
    )


TAGS = "contains($c, '<tool_call>') or contains($c, '```json') or contains($c, '<function=')"
EMPTY = "regexp_matches($c, '<tool_response>\\s*</tool_response>')"


def count_sql(c: str, x: str) -> str:
    return f"((length({c}) - length(replace({c}, '{x}', ''))) // {len(x)})"


UNBALANCED = some(f"{count_sql('$c', '<tool_call>')} <> {count_sql('$c', '</tool_call>')}")


@query(
    "a08_a09_a16_a17_e14_dataset_checks",
    f"""with o as (select count(*) as n, count(*) filter (where {some(TAGS)}) as tool, count(*) filter (where {some(TAGS)} and {some(EMPTY)}) as empty, count(*) filter (where coalesce(messages[1].role = 'system', false)) as sys,
      count(*) filter (where {N} > 0 and coalesce(messages[-1].role, '') <> 'assistant') as last, count(*) filter (where {UNBALANCED}) as tags from training_rows)
    select 'distribution' as check_name, n > 0 and tool::double / greatest(n, 1) between 0.1 and 0.8 as passed, tool || ' of ' || n || ' with tools' as message from o
    union all select 'content', empty::double / greatest(tool, 1) <= 0.1, empty || ' empty results' from o
    union all select 'system_prompts', sys::double / greatest(n, 1) >= 0.9, sys || ' with system message' from o
    union all select 'last_role', last = 0, last || ' do not end with the assistant' from o
    union all select 'tags', tags = 0, tags || ' with unbalanced tags' from o""",
)
def dataset_checks(spark: SparkSession, d: str) -> DataFrame:
    return checks.dataset_checks(rows(spark, d))


@query(
    "k07_e13_check_summary",
    f"""with o as (select count(*) as n, count(*) filter (where {some(TAGS)}) as tool, count(*) filter (where {some(TAGS)} and {some(EMPTY)}) as empty, count(*) filter (where coalesce(messages[1].role = 'system', false)) as sys,
      count(*) filter (where {N} > 0 and coalesce(messages[-1].role, '') <> 'assistant') as last, count(*) filter (where {UNBALANCED}) as tags from training_rows),
    c as (select 'distribution' as name, n > 0 and tool::double / greatest(n, 1) between 0.1 and 0.8 as ok, tool || ' of ' || n || ' with tools' as m from o
    union all select 'content', empty::double / greatest(tool, 1) <= 0.1, empty || ' empty results' from o
    union all select 'system_prompts', sys::double / greatest(n, 1) >= 0.9, sys || ' with system message' from o
    union all select 'last_role', last = 0, last || ' do not end with the assistant' from o
    union all select 'tags', tags = 0, tags || ' with unbalanced tags' from o)
    select string_agg(case when ok then 'PASS ' else 'FAIL ' end || name || ': ' || m, chr(10) order by ok, name) as text from c""",
)
def check_summary(spark: SparkSession, d: str) -> DataFrame:
    return checks.summary(checks.dataset_checks(rows(spark, d)))


PATTERNS = ("<tool_call>", "```python", "Tool result:", "no such pattern")


@query(
    "a10_pattern_coverage",
    "with p as (select unnest(['<tool_call>', '```python', 'Tool result:', 'no such pattern']) as pattern), c as (select unnest(messages).content as c from training_rows), r as (select pattern, count(c) filter (where contains(c, pattern)) as messages from p left join c on true group by pattern) select pattern, messages, case when messages = 0 then 'fail' when messages < 3 then 'warn' else 'pass' end as verdict from r",
)
def pattern_coverage(spark: SparkSession, d: str) -> DataFrame:
    return checks.pattern_coverage(rows(spark, d), PATTERNS)


@query("a11_system_prompts", "select count(*) as prompts, coalesce(max(n), 0) as most_common from (select coalesce(messages[1].content, '') as c, count(*) as n from training_rows where messages[1].role = 'system' group by 1)")
def system_prompts(spark: SparkSession, d: str) -> DataFrame:
    return checks.system_prompts(rows(spark, d))


@query("a12_key_consistency", "select count(*) as lines, count(*) filter (where not json_valid(text)) as malformed, count(*) filter (where json_valid(text) and not list_contains(json_keys(case when json_valid(text) then text else '{}' end), 'prompt')) as without_key from documents where length(trim(text, ' ')) > 0 and starts_with(text, '{')")
def key_consistency(spark: SparkSession, d: str) -> DataFrame:
    return checks.key_consistency(table(spark, d, "documents").filter("startswith(text, '{')").select(F.col("text").alias("value")), "prompt")


@query(
    "a13_a19_format_counts",
    f"""with c as (select {ANSWER} as a from training_rows), f as (select contains(a, '<function=') as x, regexp_matches(a, '<tool_call>\\s*\\{{') as j from c)
    select case when x and j then 'mixed' when x then 'a' when j then 'b' else 'direct' end as fmt, count(*) as n from f group by 1""",
)
def format_counts(spark: SparkSession, d: str) -> DataFrame:
    return checks.format_counts(rows(spark, d))


@query("a14_x21_balance", f"with c as (select {ANSWER} as a from {RENAMED}), t as (select {TOOL} as tool, count(*) as n from c where a <> '' group by 1) select tool, n, n / sum(n) over () as share, n / sum(n) over () < 0.05 as rare from t")
def balance(spark: SparkSession, d: str) -> DataFrame:
    return checks.balance(renamed_rows(spark, d))


@query(
    "a15_w09_shuffle_quality",
    f"""with o as (select *, row_number() over (order by row_id) as nth, count(*) over () as total from (select distinct on (row_id) * from {RENAMED}) where {ANSWER} <> ''), c as (select {ANSWER} as a, nth, total from o), t as (select {TOOL} as tool, nth, total from c)
    select tool, count(*) as n, count(*) filter (where nth <= floor(total / 2)) * 100.0::double / count(*) as first_half_pct, count(*) filter (where nth <= floor(total / 2)) * 100.0::double / count(*) not between 10 and 90 as clustered from t group by tool""",
)
def shuffle_quality(spark: SparkSession, d: str) -> DataFrame:
    one = renamed_rows(spark, d).filter(checks.first_answer(F.col("messages")) != "").groupBy("row_id").agg(F.first("messages").alias("messages"))
    return checks.shuffle_quality(setops.numbered(one, F.floor(F.col("row_id") / 4096), [F.col("row_id")]))


@query(
    "a18_a36_source_breakdown",
    f"with c as (select dataset, {N} as n, case when {N} < 3 then '' else coalesce(messages[3].content, '') end as a from {RENAMED}) select dataset, case when n < 3 then 'unknown' else {TOOL} end as tool, count(*) as n from c group by 1, 2",
)
def source_breakdown(spark: SparkSession, d: str) -> DataFrame:
    third = F.when(F.coalesce(F.size("messages"), F.lit(0)) >= 3, checks.tool_class(F.get("messages", F.lit(2))["content"])).otherwise("unknown")
    return renamed_rows(spark, d).groupBy("dataset", third.alias("tool")).agg(F.count("*").alias("n"))


CALLED = """contains($c, 'ruff_check(')::int + contains($c, 'typecheck(')::int + contains($c, 'pytest_run(')::int + contains($c, 'goto_definition(')::int + contains($c, 'find_references(')::int + contains($c, 'hover(')::int
  + contains($c, 'document_symbols(')::int + contains($c, 'workspace_symbols(')::int + contains($c, 'git_status(')::int + contains($c, 'git_diff(')::int + contains($c, 'git_log(')::int + contains($c, 'read_file(')::int"""
#: Every fourth conversation calls two functions in each of its calls.
CALLING = "(select * replace ([{'role': m.role, 'content': case when row_id % 4 = 0 then replace(m.content, '<tool_call>', '<tool_call>ruff_check(git_log(1))') else m.content end} for m in messages] as messages) from training_rows)"


@query(
    "a38_corpus_audit",
    f"""select count(*) as records, count(*) filter (where {N} = 3) as single_turn, count(*) filter (where {N} > 3) as multi_turn, count(*) filter (where several) as several_calls, count(*) filter (where coalesce(messages[1].role = 'system', false)) as system_first,
    sum(coalesce(len([1 for m in messages if m.role = 'assistant' and contains(m.content, '<tool_call>') and not starts_with(m.content, '<tool_call>')]), 0))::bigint as preambles
    from (select *, {some(f"contains($c, '<tool_call>') and ({CALLED}) >= 2", 'assistant')} as several from {CALLING})""",
)
def corpus_audit(spark: SparkSession, d: str) -> DataFrame:
    call = F.when(F.col("row_id") % 4 == 0, "<tool_call>ruff_check(git_log(1))").otherwise("<tool_call>")
    return checks.corpus_audit(rows(spark, d).withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.replace(m["content"], F.lit("<tool_call>"), call).alias("content")))))


@query("a28_a29_uniqueness", "select source, count(*) as total, count(distinct text) as distinct_texts, count(distinct lang) as languages, count(distinct lang) >= 3 as diverse from documents where text is not null group by source")
def uniqueness(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").filter("text is not null")
    return df.groupBy("source").agg(F.count("*").alias("total"), F.count_distinct(F.md5("text")).alias("distinct_texts"), F.count_distinct("lang").alias("languages"), (F.count_distinct("lang") >= 3).alias("diverse"))


@query("a33_sample_summary", "select lang, count(*) as n, round(avg(length(text)), 6) as mean_chars, min(length(text)) as low, max(length(text)) as high from documents where text is not null group by lang")
def sample_summary(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return table(spark, d, "documents").filter("text is not null").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_chars"), F.min(n).cast("bigint").alias("low"), F.max(n).cast("bigint").alias("high"))


@query("a37_generation_stats", "select metadata['category'] as category, count(*) as n, count(*) filter (where coalesce(len(tool_calls), 0) > 0) as with_tools, avg((length(coalesce(answer, '')) > 0)::int) as success_rate from training_examples_poc group by 1")
def generation_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_examples_poc").groupBy(F.col("metadata")["category"].alias("category")).agg(F.count("*").alias("n"), F.count_if(~filters.has_no_calls(F.col("tool_calls"))).alias("with_tools"), F.avg((F.length(text0(F.col("answer"))) > 0).cast("int")).alias("success_rate"))


@query(
    "k06_metadata",
    "select dataset, version, count(*) as total, count(distinct source) as sources, min(row_idx) as first_row, max(row_idx) as last_row from training_rows group by 1, 2",
)
def metadata(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).groupBy("dataset", "version").agg(F.count("*").alias("total"), F.count_distinct("source").alias("sources"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"))


WHITESPACE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(133)||chr(160)||chr(8195)||chr(8232)||chr(8233)||chr(12288)"


@query(
    "e11_validation_errors",
    f"""with e as (select row_id, case when {N} < 2 then 'too_few' end as code from training_rows union all select row_id, case when {N} > 0 and coalesce(messages[-1].role, '') <> 'assistant' then 'last_role' end from training_rows
    union all select row_id, case when coalesce(m.role in ('system', 'user', 'assistant', 'tool'), false) then null else 'role:' || (i - 1) end from (select row_id, unnest(messages) as m, generate_subscripts(messages, 1) as i from training_rows)
    union all select row_id, case when length(trim(coalesce(m.content, ''), {WHITESPACE})) = 0 then 'empty:' || (i - 1) end from (select row_id, unnest(messages) as m, generate_subscripts(messages, 1) as i from training_rows))
    select row_id, code from e where code is not null""",
)
def validation_errors(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select("row_id", F.explode(checks.validation_errors(F.col("messages"))).alias("code"))


@query(
    "e15_regression_checks",
    f"""select count(*) filter (where {some("regexp_matches($c, '\\w+=\"[^\"'']*\"')")}) as quoted, count(*) filter (where {some("contains($c, 'author=None')")}) as none_authors,
    count(*) filter (where {some("contains($c, '```json') and contains($c, '\"name\"')", 'assistant')}) as json_format, count(*) filter (where {some("contains($c, '<tool_call>')", 'assistant')} and not {some("contains($c, 'Tool result:') or contains($c, '<tool_response>')", 'user')}) as orphans from training_rows""",
)
def regression_checks(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    user = F.coalesce(F.exists(m, lambda x: F.coalesce(x["role"] == "user", F.lit(False)) & (text0(x["content"]).contains("Tool result:") | text0(x["content"]).contains("<tool_response>"))), F.lit(False))
    return rows(spark, d).agg(
        F.count_if(filters.any_message(m, lambda c: c.rlike(r"\w+=\"[^\"']*\""))).alias("quoted"),
        F.count_if(filters.any_message(m, lambda c: c.contains("author=None"))).alias("none_authors"),
        F.count_if(filters.has_json_call(m)).alias("json_format"),
        F.count_if(filters.by_assistant(m, lambda c: c.contains("<tool_call>")) & ~user).alias("orphans"),
    )


@query(
    "e12_w08_loss_check",
    "with l as (select l_orderkey as run, l_linenumber as line_no, 3.0::double - l_linenumber * 0.25::double + l_discount as train_loss from lineitem), o as (select run, count(*) as points, arg_min(train_loss, (line_no, train_loss)) as first_loss, arg_max(train_loss, (line_no, train_loss)) as last_loss from l group by run) select case when (first_loss - last_loss) / first_loss < 0.1::double then 'no decrease' when last_loss > 2.0 then 'high' else 'pass' end as verdict, count(*) as runs from o group by 1",
)
def loss_check(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("line_no"), (F.lit(3.0) - F.col("l_linenumber") * 0.25 + F.col("l_discount")).alias("train_loss"))
    one = logs.groupBy("run").agg(F.count("train_loss").alias("points"), F.min_by("train_loss", F.struct("line_no", "train_loss")).alias("first_loss"), F.max_by("train_loss", F.struct("line_no", "train_loss")).alias("last_loss"))
    drop = (F.col("first_loss") - F.col("last_loss")) / F.col("first_loss")
    return one.groupBy(F.when(drop < 0.1, "no decrease").when(F.col("last_loss") > 2.0, "high").otherwise("pass").alias("verdict")).agg(F.count("*").alias("runs"))


@query("strip_and_count", f"select doc_id, length(trim(text, {WHITESPACE})) as chars, {count_sql('text', 'the')} as n_the from documents where text is not null")
def strip_and_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.length(strip(F.col("text"))).cast("bigint").alias("chars"), count_of(F.col("text"), "the").alias("n_the"))
