"""Queries that parse tool calls, tool output and sources.

Outputs of tools that no table holds are written as text from table columns first and parsed back; the SQL computes the same from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.functions import codeintel, parsers, toolcalls
from sparkcurate.functions.textfn import text0
from sparkcurate.operators import filters
from sparkcurate.plans.registry import query, table

CALLS = """select session_id, seq, content, case when regexp_matches(content, '<tool_call>\\s*\\{') then regexp_extract(content, '"name": "([^"]+)"', 1) when contains(content, '<function=') then regexp_extract(content, '<function=([^>\\s]+)>', 1)
  else regexp_extract(content, '"name": "([^"]+)"', 1) end as name from chat_messages where role = 'assistant'"""


@query(
    "x01_tool_calls",
    """with w as (select session_id, seq, case seq % 3 when 0 then content when 1 then content || chr(10) || coalesce(content, '') else content || '<tool_call>{"name": "second", "arguments": {}}</tool_call><tool_call>broken</tool_call><function=third><parameter=a>1</parameter></function>' end as c
      from chat_messages where role = 'assistant' and content is not null),
    a as (select *, regexp_extract_all(c, '<tool_call>([\\s\\S]*?)</tool_call>', 1) as tagged, regexp_replace(c, '<tool_call>[\\s\\S]*?</tool_call>', '', 'g') as rest from w),
    b as (select *, list_filter(regexp_extract_all(rest, '<function=[^>\\s]+>[\\s\\S]*?(?:</function>\\s*(?:</tool_call>)?|</tool_call>)'), lambda x: regexp_matches(x, '<parameter=[^>\\s]+>[\\s\\S]*?</parameter>')) as blocks from a),
    k as (select session_id, seq, unnest(list_concat([case when starts_with(trim(x, chr(10)||chr(13)||chr(9)||' '), '{') and json_valid(x) then x->>'$.name' else regexp_extract(x, '<function=([^>\\s]+)>[\\s\\S]*', 1) end for x in tagged],
      list_concat([regexp_extract(x, '<function=([^>\\s]+)>', 1) for x in blocks], [case when json_valid(x) then x->>'$.name' end for x in regexp_extract_all(rest, '```json\\s*\\n([\\s\\S]*?)```', 1)]))) as name from b)
    select session_id, seq, name from k where name <> ''""",
)
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """The calls of every answer; a third of the answers stand there twice, and to a third a second call, an unreadable one and a block without
    an opening tag are added, as the tables have few answers with several calls."""
    rows = table(spark, d, "chat_messages").filter("role = 'assistant' and content is not null")
    c = F.col("content")
    added = F.lit('<tool_call>{"name": "second", "arguments": {}}</tool_call><tool_call>broken</tool_call><function=third><parameter=a>1</parameter></function>')
    several = F.when(F.col("seq") % 3 == 0, c).when(F.col("seq") % 3 == 1, F.concat(c, F.lit("\n"), c)).otherwise(F.concat(c, added))
    rows = rows.select("session_id", "seq", several.alias("c"))
    rows = rows.filter("contains(c, '<tool_call>') or contains(c, '<function=') or contains(c, '```json')")
    return rows.select("session_id", "seq", F.explode(toolcalls.tool_calls(F.col("c"))["calls"]).alias("c")).select("session_id", "seq", "c.name")


@query("x13_a19_call_names", "select name, count(*) as n from (select unnest(list_concat(regexp_extract_all(coalesce(content, ''), '<tool_call>\\s*\\{\\s*\"name\":\\s*\"([^\"]+)\"', 1), regexp_extract_all(coalesce(content, ''), '<function=([^>\\s]+)>', 1))) as name from chat_messages where role = 'assistant') group by 1")
def call_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat_messages").filter("role = 'assistant'").select(F.explode(toolcalls.call_names(F.col("content"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("x13_x14_x23_blocks", "select session_id, seq, len(regexp_extract_all(coalesce(content, ''), '<tool_call>([\\s\\S]*?)</tool_call>', 1)) as blocks from chat_messages where role = 'assistant'")
def blocks(spark: SparkSession, d: str) -> DataFrame:
    b = parsers.call_blocks(F.regexp_replace(text0(F.col("content")), "execute_code", "x"))
    return table(spark, d, "chat_messages").filter("role = 'assistant'").select("session_id", "seq", F.size(b).cast("bigint").alias("blocks"))


@query(
    "x04_test_runs",
    """with l as (select doc_id, text, string_split(text, chr(10)) as l from documents where regexp_matches(text, '^\\S+::'))
    select doc_id, len([1 for x in l if regexp_matches(x, '^\\S+::\\S+ PASSED\\b')])::int as passed, len([1 for x in l if regexp_matches(x, '^\\S+::\\S+ FAILED\\b')])::int as failed, nullif(regexp_extract(text, '(?m)^=+ .* in ([0-9.]+)s =+$', 1), '')::double as seconds from l""",
)
def test_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter(F.col("text").rlike(r"\A\S+::")).withColumn("x", parsers.test_run(F.col("text")))
    return rows.select("doc_id", "x.passed", "x.failed", "x.seconds")


# -- outputs written from columns -----------------------------------------------------------------------------------------------------------


def lines_of_orders(spark: SparkSession, d: str, line) -> DataFrame:
    """(key, output): the lines of each order, in order of line number."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(F.col("l_orderkey").alias("key")).agg(text.alias("output"))


def no():
    return F.col("l_linenumber").cast("string")


@query("x03_lint", "select l_orderkey as key, count(*)::int as items, (count(*) filter (where l_linenumber % 2 = 0))::int as fixable, max(l_linenumber)::int as last_line from lineitem group by 1")
def lint(spark: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.col("l_linenumber") % 2 == 0, "[*] ").otherwise("")
    out = lines_of_orders(spark, d, F.concat(F.lit("src/a.py:"), no(), F.lit(":3: E50"), no(), F.lit(" "), mark, F.lit("line too long: 1")))
    x = parsers.lint(F.concat("output", F.lit("\nFound 3 errors.")))
    return out.withColumn("x", x).select("key", F.size("x.items").alias("items"), "x.fixable", F.array_max(F.transform("x.items", lambda i: i["line"])).alias("last_line"))


@query("x02_type_check", "select l_orderkey as key, (count(*) filter (where l_linenumber % 3 <> 0))::int as errors, (count(*) filter (where l_linenumber % 3 = 0))::int as warnings, count(*) filter (where l_linenumber % 3 <> 0) = 0 as success from lineitem group by 1")
def type_check(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("l_linenumber") % 3 == 0, ',"severity":"warning"').otherwise("")
    out = lines_of_orders(spark, d, F.concat(F.lit('{"file":"a.py","line":'), no(), severity, F.lit(',"message":"bad"},')))
    x = parsers.type_check(F.concat(F.lit("["), F.regexp_replace("output", r",\s*\z", ""), F.lit("]")))
    return out.withColumn("x", x).select("key", "x.errors", "x.warnings", "x.success")


@query("x10_vcs_status", "select l_orderkey as key, case l_linenumber % 4 when 0 then 'added' when 1 then 'modified' when 2 then 'renamed' else 'untracked' end as state, l_linenumber % 4 in (0, 2) as staged, count(*) as n from lineitem group by 1, 2, 3")
def vcs_status(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("l_linenumber") % 4
    code = F.when(kind == 0, "A  a.py").when(kind == 1, " M b.py").when(kind == 2, "R  c.py -> d.py").otherwise("?? e.py")
    return lines_of_orders(spark, d, code).select("key", F.explode(parsers.vcs_status(F.col("output"))).alias("x")).groupBy("key", "x.state", "x.staged").agg(F.count("*").alias("n"))


@query("x11_a32_w06_vcs_diff", "select l_orderkey as key, 'f' || l_linenumber || '.py' as file, 1 as hunks, l_linenumber::int as added, (l_quantity::int % 5)::int as deleted from lineitem")
def vcs_diff(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(
        F.lit("--- a/f\n+++ b/f"), no(), F.lit(".py\n@@ -1 +1 @@\n"), F.repeat(F.lit("+new\n"), F.col("l_linenumber")), F.repeat(F.lit("-old\n"), F.col("l_quantity").cast("int") % 5), F.lit(" same")
    )
    return lines_of_orders(spark, d, body).select("key", F.explode(parsers.vcs_diff(F.col("output"))).alias("x")).select("key", "x.*")


@query("x12_vcs_log", "select l_orderkey as key, 'h' || l_linenumber as hash, 'a' || (l_linenumber % 3) as author, 'fix | ' || l_shipmode as message from (select *, case l_linenumber % 2 when 0 then 'air' else 'sea' end as l_shipmode from lineitem)")
def vcs_log(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("l_linenumber") % 2 == 0, "air").otherwise("sea")
    line = F.concat(F.lit("h"), no(), F.lit("|a"), (F.col("l_linenumber") % 3).cast("string"), F.lit("|2026-01-01|fix | "), mode, F.lit("\nshort|line"))
    return lines_of_orders(spark, d, line).select("key", F.explode(parsers.vcs_log(F.col("output"))).alias("x")).select("key", "x.hash", "x.author", "x.message")


@query("x05_x06_p23_locations", "select l_orderkey as key, count(*)::int as places, min(l_linenumber)::int + 1 as first_line, true as success from lineitem group by 1")
def locations(spark: SparkSession, d: str) -> DataFrame:
    item = F.concat(F.lit('{"uri":"file:///src/a.py","range":{"start":{"line":'), no(), F.lit(',"character":0}}},'))
    out = lines_of_orders(spark, d, item).withColumn("json", F.concat(F.lit("["), F.regexp_replace("output", r",\s*\z", ""), F.lit("]")))
    x = out.withColumn("x", parsers.references(F.col("json"))).withColumn("y", parsers.definitions(F.col("json")))
    return x.filter("x = y and x.places[0].file = '/src/a.py'").select("key", F.size("x.places").alias("places"), F.array_min(F.transform("x.places", lambda p: p["line"])).alias("first_line"), "x.success")


@query("x07_hover", "select o_orderkey as key, case o_orderkey % 3 when 0 then 'python' end as language, case o_orderkey % 3 when 0 then o_orderstatus when 1 then o_orderstatus else o_orderstatus || chr(10) || chr(10) || 'b' end as content from orders")
def hover(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("o_orderkey") % 3, F.col("o_orderstatus")
    json = F.when(k == 0, F.concat(F.lit('{"contents":{"language":"python","value":"'), s, F.lit('"}}'))).when(k == 1, F.concat(F.lit('{"contents":"'), s, F.lit('"}'))).otherwise(F.concat(F.lit('{"contents":["'), s, F.lit('",{"value":"b"}]}')))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), parsers.hover(json).alias("x")).select("key", "x.language", "x.content")


@query("x08_a31_document_symbols", "select p_partkey as key, 'C/m' as path, 1 as depth, (p_size + 1)::int as line from part union all select p_partkey, 'C', 0, 1 from part")
def document_symbols(spark: SparkSession, d: str) -> DataFrame:
    json = F.concat(F.lit('[{"name":"C","kind":5,"range":{"start":{"line":0},"end":{"line":99}},"children":[{"name":"m","kind":6,"range":{"start":{"line":'), F.col("p_size").cast("string"), F.lit('},"end":{"line":99}}}]}]'))
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.explode(codeintel.document_symbols(json)).alias("x")).select("key", "x.path", "x.depth", "x.line")


@query("x09_workspace_symbols", "select p_partkey as key, p_name as name, case when p_partkey % 2 = 0 then 'pkg' end as container, (p_size + 1)::int as line from part")
def workspace_symbols(spark: SparkSession, d: str) -> DataFrame:
    box = F.when(F.col("p_partkey") % 2 == 0, ',"containerName":"pkg"').otherwise("")
    json = F.concat(F.lit('[{"name":'), F.to_json(F.array("p_name")).substr(F.lit(2), F.length(F.to_json(F.array("p_name"))) - 2), F.lit(',"kind":12'), box, F.lit(',"location":{"uri":"file:///a.py","range":{"start":{"line":'), F.col("p_size").cast("string"), F.lit(',"character":0}}}}]'))
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.explode(parsers.workspace_symbols(json)).alias("x")).select("key", "x.name", "x.container", "x.line")


@query("s12_g09_train_log", "select l_orderkey as key, (l_linenumber * 10)::int as iteration, round(3.0 - l_discount, 4) as train_loss, case when l_linenumber % 2 = 0 then round(3.0 - l_tax, 4) end as val_loss from lineitem")
def train_log(spark: SparkSession, d: str) -> DataFrame:
    number = lambda c: F.format_string("%.4f", F.lit(3.0) - F.col(c))
    val = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(", Val loss "), number("l_tax"))).otherwise("")
    line = F.concat(F.lit("Iter "), (F.col("l_linenumber") * 10).cast("string"), F.lit(": Train loss "), number("l_discount"), val, F.lit("\nIter x: Train loss nothing\nnoise"))
    return lines_of_orders(spark, d, line).select("key", F.explode(parsers.train_log(F.col("output"))).alias("x")).select("key", "x.*")


@query("s13_val_losses", "select l_orderkey as key, (l_linenumber * 10)::int as iteration, round(3.0 - l_tax, 4) as val_loss from lineitem")
def val_losses(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("Iter "), (F.col("l_linenumber") * 10).cast("string"), F.lit(": Val loss "), F.format_string("%.4f", F.lit(3.0) - F.col("l_tax")), F.lit(", took 1s"))
    return lines_of_orders(spark, d, line).select("key", F.explode(parsers.val_losses(F.col("output"))).alias("x")).select("key", "x.*")


@query("s15_line_range", "select doc_id, md5(list_aggregate(string_split(text, chr(10))[2:4], 'string_agg', chr(10)) || case when len(string_split(text, chr(10))) > 4 then chr(10) else '' end) as part from documents where len(string_split(text, chr(10))) >= 2")
def line_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("size(split(text, '\n')) >= 2").select("doc_id", F.md5(parsers.line_range(F.col("text"), F.lit(2), F.lit(3))).alias("part"))


@query("s14_config_keys", "select event_id, list_contains(json_keys(props), 'k') as has_k, list_contains(json_keys(props), 'r') as has_r from events")
def config_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return table(spark, d, "events").select("event_id", F.array_contains(keys, "k").alias("has_k"), F.array_contains(keys, "r").alias("has_r"))


@query("x18_source_names", "select doc_id, len(regexp_extract_all(text, '(?m)^\\s*(?:async\\s+)?def\\s+(\\w+)', 1)) as functions, len(regexp_extract_all(text, '(?m)^class\\s+(\\w+)', 1)) as classes from documents where text is not null")
def source_names(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(parsers.source_names(t, "def")).cast("bigint").alias("functions"), F.size(parsers.source_names(t, "class")).cast("bigint").alias("classes"))


@query(
    "x20_category",
    """select doc_id, case when regexp_matches(t, 'flask|django|fastapi|starlette|tornado|bottle') then 'web' when regexp_matches(t, 'pandas|numpy|scipy|sklearn|tensorflow|pytorch') then 'data'
      when regexp_matches(t, 'pytest|unittest|mock|fixture|parametrize') then 'testing' when regexp_matches(t, 'argparse|click|typer|fire|docopt') then 'cli' when regexp_matches(t, 'asyncio|aiohttp|trio|anyio') then 'async'
      when regexp_matches(t, 'Protocol|TypeVar|Generic|Callable|Union') then 'typing' when regexp_matches(t, 'setuptools|poetry|flit|build|wheel') then 'tools' end as category from (select doc_id, lower(coalesce(text, '')) as t from documents)""",
)
def category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", filters.diversity_category(F.col("text")).alias("category"))


@query("x15_x16_x17_ast_facts")
def ast_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the Python sources among the documents; they have no SQL, the tests compare them with fixtures."""
    rows = sources(spark, d)
    x = rows.withColumn("x", codeintel.ast_facts(F.col("text"))).withColumn("valid", codeintel.is_valid_python(F.col("text")))
    return x.select("doc_id", "valid", F.size("x.functions").alias("functions"), F.size("x.calls").alias("calls"), "x.hints", F.size(codeintel.field_accesses(F.col("text"))).alias("accesses"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("path like '%.py' and text is not null").select("doc_id", "text")


PROSE = "['would use', 'should use', 'I''ll use', 'we could', 'to call', 'needs to', 'want to', 'going to', 'can use', 'let me', 'i would', 'i should', 'i need']"


@query(
    "x22_keyword_occurrence",
    f"""with s as (select doc_id, text, lower(text) as low, trim(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'append'))[1], chr(32)||chr(9)||chr(13)) as line from documents where path like '%.py' and text is not null),
    b as (select *, string_split(line, 'append')[1] as before from s)
    select doc_id, case when line is null then 'none' when starts_with(line, '#') then 'comment' when (length(before) - length(replace(before, chr(34), ''))) % 2 = 1 or (length(before) - length(replace(before, chr(39), ''))) % 2 = 1 then 'string'
      when len(list_filter({PROSE}, lambda p: strpos(low, p) > 0 and abs(strpos(low, p) - strpos(low, 'append')) < 100)) > 0 then 'prose' when regexp_matches(line, '\\bappend\\s*\\(') then 'real_call' else 'code_context' end as place from b""",
)
def keyword_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return sources(spark, d).select("doc_id", codeintel.keyword_occurrence(F.lit("append"), F.col("text")).alias("place"))


@query("x24_x25_x26_search_and_rewrite")
def search_and_rewrite(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return sources(spark, d).select("doc_id", F.size(codeintel.find_pattern("call:append")(t)).alias("found"), codeintel.rename("self", "this")(t)["times"].alias("renamed"), codeintel.add_import("import json")(t).contains("import json").alias("imported"))


@query("v01_v09_x27_domain_issues")
def domain_issues(spark: SparkSession, d: str) -> DataFrame:
    return sources(spark, d).select("doc_id", F.explode(codeintel.domain_issues(F.col("text"))).alias("x")).select("doc_id", "x.validator", "x.rule", "x.severity", "x.line", "x.message")


@query("x29_schema_fields", "select * from (values ('messages', 'array<struct<role:string,content:string>>'), ('split', 'string'), ('source', 'string'), ('example_id', 'bigint'), ('row_idx', 'bigint'), ('loaded_at', 'timestamp')) as t(field, kind)")
def schema_fields(spark: SparkSession, d: str) -> DataFrame:
    fields = [(f.name, f.dataType.simpleString().replace("timestamp_ntz", "timestamp")) for f in table(spark, d, "tool_calling").schema]
    return spark.createDataFrame(fields, "field string, kind string")
