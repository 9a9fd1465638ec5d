"""Queries over conversation datasets: filters, conversions, duplicates, leaks, splits, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcurate.functions.textfn import canonical, chat_to_messages, count_of, hash_bucket, messages_to_chat, text0
from sparkcurate.operators import checks, convert, filters, setops, split
from sparkcurate.plans.registry import query, table

WHITE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
FOREIGN = "[一-鿿぀-ゟ゠-ヿЀ-ӿ؀-ۿ]"
LEGACY = "(?m)\\bprint\\s+[^(]|\\.has_key\\(|\\bxrange\\b|<>\\s|^class\\s+\\w+:|\\bexecfile\\b|\\bunicode\\b|from\\s+__future__"


def some(test: str, role: str | None = None) -> str:
    """SQL: some message's content c passes; false for null arrays."""
    own = f" and m.role = '{role}'" if role else ""
    return f"coalesce(len([1 for m in messages if ({test.replace('$c', chr(99) + 'oalesce(m.content, ' + chr(39) * 2 + ')')}){own}]) > 0, false)"


NORM = f"lower(trim(split, {BLANKS}))"
KEEP_LANGUAGE = f"not {some(f'''regexp_matches($c, '{FOREIGN}')''')}"
KEEP_PYTHON = f"not {some(f'''regexp_matches($c, '{LEGACY}')''')}"
N = "coalesce(len(messages), 0)"
KEEP_QUALITY = f"({N} >= 2 and not {some(f'length(trim($c, {WHITE})) < 10')} and ({N} = 0 or coalesce(messages[-1].role = 'assistant', false)))"


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tool_calling")


@query("f01_f02_f03_filter_flags", f"select example_id, {KEEP_LANGUAGE} as keep_language, {KEEP_PYTHON} as keep_python, {KEEP_QUALITY} as keep_quality from tool_calling")
def filter_flags(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    return conversations(spark, d).select("example_id", filters.is_language(m).alias("keep_language"), filters.is_modern_python(m).alias("keep_python"), filters.is_quality(m).alias("keep_quality"))


#: Lines with each outdated spelling, and near misses.
SPELLINGS = (
    "print x", "d.has_key(k)", "for i in xrange(3):", "if a <> b:", "class Old:", "execfile(path)", "unicode(s)", "from __future__ import annotations",
    "print(x)", "d.has_key", "my_xrange_2 = 1", "a<>b", " class Old:", "exec(path)", "unicode_text = 1", "import __future__",
)


@query(
    "f02_legacy_spellings",
    f"""with t as (select doc_id, coalesce(text, '') || chr(10) || [{', '.join("'" + x + "'" for x in SPELLINGS)}][doc_id % 16 + 1] as t from documents)
    select doc_id % 16 as spelling, not regexp_matches(t, '{LEGACY}') as keep, count(*) as n from t group by 1, 2""",
)
def legacy_spellings(spark: SparkSession, d: str) -> DataFrame:
    """The rule on documents to which one line with or without an outdated spelling is added."""
    line = F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("doc_id") % 16 + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.array(F.struct(F.lit("user").alias("role"), F.concat(text0(F.col("text")), F.lit("\n"), line).alias("content"))).alias("messages"))
    return rows.groupBy((F.col("doc_id") % 16).alias("spelling"), filters.is_modern_python(F.col("messages")).alias("keep")).agg(F.count("*").alias("n"))


@query(
    "filter_attribution",
    f"""select split, rule, count(*) as n from (select {NORM} as split, case when not {KEEP_LANGUAGE} then 'language' when not {KEEP_PYTHON} then 'python' when not {KEEP_QUALITY} then 'quality' else 'kept' end as rule
    from tool_calling) group by split, rule""",
)
def filter_attribution(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline of the command line tool in one scan: which rule removes a record first, by split."""
    m = F.col("messages")
    rows = filters.apply_filters(conversations(spark, d), {"language": filters.is_language(m), "python": filters.is_modern_python(m), "quality": filters.is_quality(m)})
    return rows.groupBy(F.lower(F.btrim("split", F.lit(" \t\n\r\x0b\x0c"))).alias("split"), F.coalesce("failed_rule", F.lit("kept")).alias("rule")).agg(F.count("*").alias("n"))


@query(
    "a03_retention",
    f"""with k as (select {KEEP_LANGUAGE} as a, {KEEP_PYTHON} as b, {KEEP_QUALITY} as c from tool_calling)
    select count(*) as n, count(*) filter (where a) as after_language, count(*) filter (where a and b) as after_python, count(*) filter (where a and b and c) as after_quality,
    count(*) filter (where a and b and c) * 100.0 / greatest(count(*), 1) as retention_pct from k""",
)
def retention(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    a, b, c = filters.is_language(m), filters.is_modern_python(m), filters.is_quality(m)
    one = conversations(spark, d).agg(F.count("*").alias("n"), F.count_if(a).alias("after_language"), F.count_if(a & b).alias("after_python"), F.count_if(a & b & c).alias("after_quality"))
    return one.withColumn("retention_pct", F.col("after_quality") * 100.0 / F.greatest("n", F.lit(1)))


def occurs(c: str, x: str) -> str:
    return f"((length({c}) - length(replace({c}, '{x}', ''))) / {len(x)})::bigint"


LINES = "string_split(t, chr(10))"
QUALITY = f"""(case when contains(t, '\"\"\"') or contains(t, '''''''') then 0.2::double else 0 end + case when contains(t, '->') or contains(t, ': ') then 0.2::double else 0 end
  + case when contains(t, 'class ') then 0.2::double else 0 end + case when contains(t, 'def ') then 0.2::double else 0 end
  + case when {occurs('lower(t)', 'todo')} + {occurs('lower(t)', 'fixme')} = 0 then 0.1::double when {occurs('lower(t)', 'todo')} + {occurs('lower(t)', 'fixme')} <= 2 then 0.05::double else 0 end
  + case when len([1 for x in {LINES} if starts_with(trim(x, {BLANKS}), '#')]) / greatest(len({LINES}), 1) between 0.05 and 0.30 then 0.1::double else 0 end)"""


@query(
    "f04_f05_x19_code_filter",
    f"""with q as (select doc_id, coalesce(text, '') as t from documents) select doc_id, length(trim(t, {WHITE})) >= 100 and len([1 for x in {LINES} if length(trim(x, {BLANKS})) > 0 and not starts_with(trim(x, {BLANKS}), '#')]) >= 5 as code_sample,
    round({QUALITY}, 6) as quality, length(t) between 100 and 50000 and len({LINES}) between 10 and 2000 and (contains(t, 'def ') or contains(t, 'class ') or contains(t, 'import ') or contains(t, 'from ')) and {QUALITY} >= 0.3 as code_file from q""",
)
def code_filter(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", filters.is_code_sample(t).alias("code_sample"), F.round(filters.code_quality(t), 6).alias("quality"), filters.is_code_file(t).alias("code_file"))


def roles(role: str) -> str:
    return f"coalesce(len([1 for m in messages if m.role = '{role}']), 0)"


CHARS = "coalesce(list_sum([length(coalesce(m.content, '')) for m in messages]), 0)"
PATTERN = "coalesce(len([1 for i in range(1, len(messages) - 1) if messages[i].role = 'assistant' and contains(messages[i].content, '<tool_call>') and messages[i + 1].role in ('user', 'tool') and messages[i + 2].role = 'assistant']) > 0, false)"


@query(
    "f06_f07_w07_transcript_filter",
    f"""select example_id, {PATTERN} as tool_pattern, {CHARS} <= 8192 and {roles('system')} > 0 and {roles('user')} > 0 and {roles('assistant')} > 0 and case when {some("contains($c, '<tool_call>')")} then {PATTERN}
    else {roles('user')} <= 3 and {roles('user')} = {roles('assistant')} and {CHARS} < 3000 end as keep from tool_calling""",
)
def transcript_filter(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    return conversations(spark, d).select("example_id", filters.has_tool_pattern(m).alias("tool_pattern"), filters.is_transcript(m).alias("keep"))


DETECT = {
    "tags": "contains($c, '<tool_call>') or contains($c, '```json') or contains($c, '<function=')",
    "phrases": "contains($c, 'I''ll use the') or (contains($c, '```json') and contains($c, '\"name\":')) or contains($c, 'Tool result:')",
    "call": "contains($c, '<tool_call>')",
    "fence": "contains($c, '```json')",
    "result": "contains($c, 'Tool result:') or contains($c, '<tool_response>')",
}


@query(
    "f12_f08_f10_tool_detectors",
    f"""select row_id, {', '.join(f'{some(t)} as {k}' for k, t in DETECT.items())}, {some("contains($c, '```json') and contains($c, '\"name\"')", 'assistant')} as json_call,
    not {some("contains($c, '<tool_call>')")} or {some("contains(lower($c), 'tests/') or contains(lower($c), 'adapter')")} as relevant from training_rows""",
)
def tool_detectors(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    flags = [filters.any_message(m, t).alias(k) for k, t in filters.TOOL_DETECTORS.items()]
    return table(spark, d, "training_rows").select("row_id", *flags, filters.has_json_call(m).alias("json_call"), filters.is_relevant(m, ("tests/", "adapter")).alias("relevant"))


@query("f09_is_history", f"select row_id, {some('''contains(lower($c), 'show_history')''')} as history from training_rows")
def is_history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_rows").select("row_id", filters.mentions(F.col("messages"), "show_history").alias("history"))


@query(
    "f11_tool_response",
    "select session_id, seq, starts_with(t, '<tool_response>') or starts_with(t, 'tool result:') or starts_with(t, '<tool_result>') as response from (select session_id, seq, lower(trim(coalesce(content, ''), ' ')) as t from chat_messages)",
)
def tool_response(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat_messages").select("session_id", "seq", filters.is_tool_response(F.col("content")).alias("response"))


@query("f13_by_category", "select prompt_id, category from eval_prompts where category = 'tool_choice' or list_contains(expected_tool_calls, 'scan_files')")
def by_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_prompts").filter((F.col("category") == "tool_choice") | F.array_contains("expected_tool_calls", "scan_files")).select("prompt_id", "category")


@query("f14_malformed", f"select row_id, {N} < 2 as malformed from training_rows")
def malformed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_rows").select("row_id", filters.is_malformed(F.col("messages")).alias("malformed"))


@query("f15_no_calls", "select example_id from training_examples_poc where coalesce(len(tool_calls), 0) = 0")
def no_calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_examples_poc").filter(filters.has_no_calls(F.col("tool_calls"))).select("example_id")


@query(
    "f16_called_and_accessed",
    """select doc_id, contains(t, 'append(') as calls_append, contains(t, 'append(') and contains(t, 'gather(') as calls_all, not contains(t, '(') as no_call, contains(t, '.select') or contains(t, '.copy') as field
    from (select doc_id, coalesce(text, '') as t from documents)""",
)
def called(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    names = lambda *x: F.array(*map(F.lit, x))
    return table(spark, d, "documents").select(
        "doc_id",
        filters.called_all(t, names("append")).alias("calls_append"),
        filters.called_all(t, names("append", "gather")).alias("calls_all"),
        (~text0(t).contains("(")).alias("no_call"),
        filters.accesses_field(t, names("select", "copy")).alias("field"),
    )


# -- conversions ------------------------------------------------------------------------------------------------------------------------


@query(
    "p02_p03_chat_round_trip",
    f"""with parts as (select text_id, [p for p in string_split(coalesce(text, ''), '<|im_start|>') if contains(p, chr(10)) and length(trim(p, {BLANKS})) > 0] as p from chat_text),
    m as (select text_id, [struct_pack(role := trim(string_split(x, chr(10))[1], {BLANKS}), content := trim(replace(substr(x, strpos(x, chr(10)) + 1), '<|im_end|>', ''), {BLANKS})) for x in p] as m from parts)
    select text_id, len(m)::int as messages, md5(list_aggregate([('<|im_start|>' || x.role || chr(10) || x.content || '<|im_end|>') for x in m], 'string_agg', chr(10))) as chat from m where len(m) > 0""",
)
def round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chat_text").select("text_id", chat_to_messages(F.col("text")).alias("m")).filter("size(m) > 0")
    return rows.select("text_id", F.size("m").alias("messages"), F.md5(messages_to_chat(F.col("m"))).alias("chat"))


@query(
    "p03_variants",
    """select row_id, md5(coalesce(list_aggregate([('<|im_start|>' || m.role || chr(10) || coalesce(m.content, '') || '<|im_end|>') for m in messages if m.role in ('user', 'assistant')], 'string_agg', chr(10)), '')) as dialogue,
    md5(coalesce(list_aggregate([('<|im_start|>' || m.role || chr(10) || coalesce(m.content, '') || '<|im_end|>') for m in messages if m.role in ('system', 'user', 'assistant')], 'string_agg', chr(10)), '')) as whole from training_rows where messages is not null""",
)
def chat_variants(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    return table(spark, d, "training_rows").filter("messages is not null").select("row_id", F.md5(messages_to_chat(m, ("user", "assistant"))).alias("dialogue"), F.md5(messages_to_chat(m, ("system", "user", "assistant"))).alias("whole"))


@query("p01_p04_records", "select row_id, len(messages)::int as messages, coalesce(list_sum([length(coalesce(m.role, '') || coalesce(m.content, '')) for m in messages]), 0)::bigint as chars from training_rows")
def records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "training_rows").withColumn("line", convert.to_record(F.col("messages"))).withColumn("text", F.lit(None).cast("string"))
    back = F.from_json("line", "messages array<struct<role:string,content:string>>")["messages"]
    m = convert.either_form(F.col("text"), back)
    return rows.select("row_id", F.size(m).alias("messages"), F.aggregate(m, F.lit(0).cast("bigint"), lambda s, x: s + F.length(F.concat(text0(x["role"]), text0(x["content"])))).alias("chars"))


@query("p12_with_system", "select row_id, (len(messages) + case when coalesce(messages[1].role = 'system', false) then 0 else 1 end)::int as messages, case when coalesce(messages[1].role = 'system', false) then messages[1].content else 'Be brief.' end as prompt from training_rows")
def system_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "training_rows").select("row_id", convert.with_system(F.col("messages"), "Be brief.").alias("m"))
    return rows.select("row_id", F.size("m").alias("messages"), F.get("m", F.lit(0))["content"].alias("prompt"))


@query(
    "p13_without_preamble",
    """select session_id, seq, md5(trim(substr(content, strpos(content, '<tool_call>')), ' ')) as content from chat_messages where role = 'assistant' and contains(content, '<tool_call>') and not starts_with(content, '<tool_call>')""",
)
def preambles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chat_messages").filter("role = 'assistant' and contains(content, '<tool_call>') and not startswith(content, '<tool_call>')")
    m = convert.without_preamble(F.array(F.struct("role", "content")))
    return rows.select("session_id", "seq", F.md5(F.get(m, F.lit(0))["content"]).alias("content"))


RESULT = "case when starts_with(content, 'Tool result: ') then '<tool_response>' || chr(10) || substr(content, 14) || chr(10) || '</tool_response>' else content end"


@query("p05_results_to_tags", f"select session_id, seq, md5({RESULT}) as content from chat_messages where role = 'user'")
def results_to_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat_messages").filter("role = 'user'").select("session_id", "seq", F.md5(convert.result_to_tags(F.col("content"))).alias("content"))


@query(
    "p05_fences_to_tags",
    """with j as (select session_id, seq, content, regexp_extract(content, '```json\\s*([\\s\\S]*?)\\s*```', 1) as j from chat_messages where role = 'assistant' and contains(content, '```json')),
    k as (select *, case when json_valid(j) then j->>'$.name' end as name, case when json_valid(j) then json_keys(j, '$.arguments') end as keys from j)
    select session_id, seq, name, case when coalesce(len(keys), 0) > 0 and length(name) > 0 then len(keys) end as parameters from k""",
)
def fences_to_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chat_messages").filter("role = 'assistant' and contains(content, '```json')").select("session_id", "seq", convert.fence_to_tags(F.col("content")).alias("x"))
    name = F.nullif(F.regexp_extract("x", r"<tool_call><function=([^>\s]+)>", 1), F.lit(""))
    return rows.select("session_id", "seq", name.alias("name"), F.when(name.isNotNull(), count_of(F.col("x"), "<parameter=")).alias("parameters"))


@query(
    "p08_tags_to_json",
    """with t as (select session_id, seq, regexp_extract(content, '<function=([^>\\s]+)>', 1) as name, regexp_extract(content, '<function=[^>\\s]+>([\\s\\S]*?)</function>', 1) as body from chat_messages where role = 'assistant' and regexp_matches(content, '<function=[^>\\s]+>[\\s\\S]*?</function>'))
    select session_id, seq, name, len(regexp_extract_all(body, '<parameter=([^>]+)>\\s*([\\s\\S]*?)\\s*</parameter>', 1)) as parameters from t""",
)
def tags_to_json(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chat_messages").filter("role = 'assistant'").filter(F.col("content").rlike(convert.XML_CALL))
    call = F.from_json(F.regexp_extract(convert.tags_to_json(F.col("content")), r"(?s)<tool_call>\n(.*?)\n</tool_call>", 1), "struct<name:string,arguments:map<string,string>>")
    return rows.select("session_id", "seq", call["name"].alias("name"), F.size(call["arguments"]).cast("bigint").alias("parameters"))


@query(
    "p07_p06_wrap_calls",
    """with b as (select session_id, seq, content, trim(regexp_extract(content, '<tool_call>([\\s\\S]*?)</tool_call>', 1), ' ') as body from chat_messages where role = 'assistant')
    select session_id, seq, length(body) > 0 and not starts_with(body, '<function=') and not starts_with(body, '{') as wrapped from b where content is not null""",
)
def wrap_calls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chat_messages").filter("role = 'assistant' and content is not null")
    return rows.select("session_id", "seq", (convert.wrap_bare_call(F.col("content")) != F.col("content")).alias("wrapped"))


@query(
    "p09_p26_traces",
    """select example_id, case when coalesce(len([1 for c in tool_calls if c.result is null]), 0) = 0 then (2 + 2 * coalesce(len(tool_calls), 0))::int end as messages,
    case when coalesce(len([1 for c in tool_calls if c.result is null]), 0) = 0 then coalesce(list_sum([length(c.result) for c in tool_calls]), 0)::bigint end as result_chars from training_examples_poc""",
)
def traces(spark: SparkSession, d: str) -> DataFrame:
    m = convert.trace_to_messages(F.col("query"), F.col("tool_calls"), F.col("answer"))
    results = F.filter(m, lambda x: x["content"].startswith("<tool_response>\n") & x["content"].endswith("\n</tool_response>") & (x["role"] == "user"))
    chars = F.aggregate(results, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x["content"]) - 33)
    return table(spark, d, "training_examples_poc").select("example_id", F.when(m.isNotNull(), F.size(m)).alias("messages"), F.when(m.isNotNull(), chars).alias("result_chars"))


@query(
    "p10_p11_transcripts",
    """select example_id, 4 as blocks, 'SYSTEM' || '|' || query as first from training_examples_poc where query is not null and answer is not null and not contains(query, chr(10)) and not contains(answer, chr(10))""",
)
def transcripts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "training_examples_poc").filter("query is not null and answer is not null and not contains(query, '\n') and not contains(answer, '\n')")
    text = F.concat_ws("\n\n", F.lit("SYSTEM: SYSTEM"), F.concat(F.lit("USER: "), F.col("query")), F.lit("NOTE: dropped"), F.concat(F.lit("ASSISTANT: "), F.col("answer")), F.lit("FUNCTION RESPONSE: {}"))
    m = convert.transcript_to_messages(text)
    return rows.select("example_id", F.size(m).alias("blocks"), F.concat(F.get(m, F.lit(0))["content"], F.lit("|"), F.get(m, F.lit(1))["content"]).alias("first"))


@query("p14_single_quotes", """select doc_id, md5(regexp_replace(text, '(\\w+)="([^"'']*)"', '\\1=''\\2''', 'g')) as text from documents where text is not null""")
def quotes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(convert.single_quotes(F.col("text"))).alias("text"))


HISTORY = " ".join(f"when contains(lower(coalesce(query, '')), '{w}') then '{k}'" for w, k in convert.HISTORY_WORDS)
DIGITS = "list_sum([strpos('0123456789abcdef', x) - 1 for x in string_split(md5(query), '')])"


@query("p16_p18_history_words", f"select example_id, case {HISTORY} else 'fix' end as word, ({DIGITS} % 5)::bigint as seed from training_examples_poc")
def history_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_examples_poc").select("example_id", convert.history_word(F.col("query")).alias("word"), convert.md5_mod5(F.col("query")).alias("seed"))


@query(
    "p15_p17_fill_authors",
    f"select example_id, 'Commit(author=''' || ['ana','bo','cy','di','ed'][({DIGITS} % 5)::int + 1] || ''') Commit(author=''' || ['ana','bo','cy','di','ed'][(({DIGITS} + 1) % 5)::int + 1] || ''')' as content from training_examples_poc where query is not null",
)
def authors(spark: SparkSession, d: str) -> DataFrame:
    content = F.lit("Commit(author=None) Commit(author=None)")
    return table(spark, d, "training_examples_poc").filter("query is not null").select("example_id", convert.fill_authors(content, ("ana", "bo", "cy", "di", "ed"), convert.md5_mod5(F.col("query"))).alias("content"))


@query("p19_call_records", "select example_id, 5 as messages, (length(query) + length(answer) + length(tool_calls[1].result))::int as chars from training_examples_poc where len(tool_calls) > 0 and tool_calls[1].result is not null")
def call_records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "training_examples_poc").withColumn("c", F.get("tool_calls", F.lit(0))).filter("c.result is not null")
    m = convert.call_record("s", F.col("query"), F.coalesce("c.name", "c.tool"), F.col("c.args"), F.col("c.result"), F.col("answer"))
    chars = F.length(F.get(m, F.lit(1))["content"]) + F.length(F.get(m, F.lit(4))["content"]) + F.length(F.get(m, F.lit(3))["content"]) - 33
    return rows.select("example_id", F.size(m).alias("messages"), chars.alias("chars"))


@query("p21_p23_previews", "select doc_id, case when length(text) > 100 then substr(text, 1, 100) || '...' else text end as preview, path from documents")
def previews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", convert.preview(F.col("text"), 100).alias("preview"), convert.file_path(F.concat(F.lit("file://"), F.col("path"))).alias("path"))


@query(
    "p24_preambles_added",
    """select row_id, len(messages) = 3 and ('0x' || substr(md5('7:' || row_id::varchar), 1, 7))::bigint % 100 < 33 and len([1 for m in messages if m.role = 'assistant' and starts_with(m.content, '<tool_call>')]) > 0 as changed from training_rows where messages is not null""",
)
def preambles_added(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "training_rows").filter("messages is not null")
    m = convert.with_preambles(F.col("messages"), 7, F.col("row_id"))
    return rows.select("row_id", (canonical(m) != canonical(F.col("messages"))).alias("changed"))


@query(
    "p25_templates",
    """select category, replace(replace('Find {tool} in {place} for ' || category, '{place}', 'src'), '{tool}', x) as query from (select distinct category from eval_prompts where category is not null), unnest(['scan', 'list', 'open']) as t(x)""",
)
def templates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_prompts").filter("category is not null").select("category").distinct()
    t = convert.expand_template(F.concat(F.lit("Find {tool} in {place} for "), F.col("category")), {"tool": ("scan", "list", "open"), "place": ("src", "lib")})
    return rows.select("category", F.explode(t).alias("query"))


# -- duplicates, leaks, unions ------------------------------------------------------------------------------------------------------------

KEY = "list_aggregate([coalesce(m.role, chr(0)) || chr(1) || coalesce(m.content, chr(0)) for m in messages], 'string_agg', chr(2))"


@query("u03_g04_dedup_keep_first", f"select row_id, dataset, split from (select *, row_number() over (partition by {KEY}, messages is null order by row_id) as rn from (select distinct on (row_id) * from training_rows)) where rn = 1")
def dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "training_rows")
    return setops.keep_first(rows.select("row_id", "dataset", "split", "messages"), canonical(F.col("messages")), ["row_id"]).select("row_id", "dataset", "split")


@query("u04_a30_duplicates", "select sum(n)::bigint as rows, count(*) as distinct_rows, sum(n - 1)::bigint as duplicates from (select count(*) as n from tool_calling group by example_id, split, row_idx, source, messages)")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    key = F.to_json(F.struct("example_id", "split", "row_idx", "source", "messages"), {"ignoreNullFields": "false"})
    return setops.duplicate_counts(conversations(spark, d), key)


HELD = f"(select * from training_rows where {NORM} <> 'train')"
TRAIN = f"(select * from training_rows where {NORM} = 'train')"


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "training_rows").withColumn("s", F.lower(F.btrim("split", F.lit(" \t\n\r\x0b\x0c"))))
    return rows.filter("s <> 'train'"), rows.filter("s = 'train'")


@query("j04_u05_leakage_anti", f"select row_id, dataset from {HELD} h where messages is not null and {KEY} not in (select {KEY} from {TRAIN} where messages is not null and {KEY} is not null) or len(messages) = 0 and not exists (select 1 from {TRAIN} where len(messages) = 0)")
def leakage_anti(spark: SparkSession, d: str) -> DataFrame:
    held, train = sides(spark, d)
    key = canonical(F.col("messages"))
    return setops.without_leaks(held.filter("messages is not null"), train, key, key).select("row_id", "dataset")


@query("j05_leak_count", f"select count(*) as leaked from {HELD} where {KEY} in (select {KEY} from {TRAIN} where {KEY} is not null) or (len(messages) = 0 and exists (select 1 from {TRAIN} where len(messages) = 0))")
def leak_count(spark: SparkSession, d: str) -> DataFrame:
    held, train = sides(spark, d)
    key = canonical(F.col("messages"))
    return setops.leaks(held, train, key, key).agg(F.count("*").alias("leaked"))


@query("u01_u02_unions", "select source_ord, split, count(*) as n from (select 0 as source_ord, split from tool_calling union all select 1, split from training_rows union all select 2, split from chat_text) group by 1, 2")
def unions(spark: SparkSession, d: str) -> DataFrame:
    return setops.union_of([table(spark, d, t).select("split", "source") for t in ("tool_calling", "training_rows", "chat_text")]).groupBy("source_ord", "split").agg(F.count("*").alias("n"))


@query(
    "j03_first_match",
    f"""with r as (select source, arg_min(row_id, row_id) as first_row, arg_min(dataset, row_id) as dataset from training_rows where source is not null group by source)
    select t.example_id, r.first_row, r.dataset from tool_calling t left join r using (source)""",
)
def repair_lookup(spark: SparkSession, d: str) -> DataFrame:
    right = table(spark, d, "training_rows").filter("source is not null").select("source", F.col("row_id").alias("first_row"), "dataset")
    right = right.groupBy("source").agg(F.min_by("first_row", "first_row").alias("first_row"), F.min_by("dataset", "first_row").alias("dataset"))
    return conversations(spark, d).select("example_id", "source").join(right, "source", "left").select("example_id", "first_row", "dataset")


# -- splits, shuffles, samples ------------------------------------------------------------------------------------------------------------


def distinct_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source")


def split_sql(case: str) -> str:
    return f"with o as (select doc_id, row_number() over (order by md5('46:' || doc_id::varchar), doc_id) as nth, count(*) over () as total from documents) select doc_id, case {case} end as part from o"


@query("l06_l07_w10_split_cutpoints", split_sql("when nth <= floor(total * 0.8::double) then 'train' when nth <= floor(total * 0.9::double) then 'valid' else 'test'"))
def split_cutpoints(spark: SparkSession, d: str) -> DataFrame:
    return split.shuffled(distinct_documents(spark, d), "doc_id", 46).select("doc_id", split.part(F.col("nth"), F.col("total"), "cutpoints").alias("part"))


@query("l06_split_sizes", split_sql("when nth <= floor(total * 0.8::double) then 'train' when nth <= floor(total * 0.8::double) + floor(total * 0.1::double) then 'valid' else 'test'"))
def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    return split.shuffled(distinct_documents(spark, d), "doc_id", 46).select("doc_id", split.part(F.col("nth"), F.col("total"), "sizes").alias("part"))


@query("l06_split_two_unshuffled", "with o as (select doc_id, row_number() over (order by doc_id) as nth, count(*) over () as total from documents) select doc_id, case when nth <= floor(total * 0.9::double) then 'train' else 'valid' end as part from o")
def split_two(spark: SparkSession, d: str) -> DataFrame:
    rows = setops.numbered(distinct_documents(spark, d), F.floor(F.col("doc_id") / 4096), [F.col("doc_id")])
    return rows.select("doc_id", split.part(F.col("nth"), F.col("total"), "two", 0.9).alias("part"))


@query("l08_sample", "select doc_id from documents order by md5('47:' || doc_id::varchar), doc_id limit 100")
def sample(spark: SparkSession, d: str) -> DataFrame:
    return split.sampled(distinct_documents(spark, d), "doc_id", 47, 100).select("doc_id")


@query("l09_pick", "select doc_id, ['a', 'b', 'c'][(('0x' || substr(md5('9:' || doc_id::varchar), 1, 7))::bigint % 3 + 1)::int] as choice from documents")
def pick(spark: SparkSession, d: str) -> DataFrame:
    return distinct_documents(spark, d).select("doc_id", split.pick(("a", "b", "c"), F.col("doc_id"), 9).alias("choice"))


SCORE = """(case when contains(t, '.error_count') or contains(t, '.errors') or contains(t, '.success') or contains(t, '.locations') or contains(t, '.references') then 10 else 0 end
  + case when contains(t, 'if result') then 5 else 0 end + case when contains(t, 'for ') and (contains(t, ' in result') or contains(t, '.errors')) then 5 else 0 end
  + case when len(string_split(t, chr(10))) > 3 then 3 else 0 end + case when contains(t, '<tool_call>') then 2 else 0 end)"""


@query("l02_top_400", f"select example_id, {SCORE} as score from (select distinct on (example_id) example_id, coalesce(messages[2].content, '') as t from tool_calling) order by score desc, example_id limit 400")
def top_400(spark: SparkSession, d: str) -> DataFrame:
    """The 400 conversations whose second message scores highest."""
    second = F.get("messages", F.lit(1))["content"]
    rows = conversations(spark, d).groupBy("example_id").agg(F.first(filters.example_priority(second)).alias("score"))
    return split.top(rows, 400, F.desc("score"), F.col("example_id"))


@query("l02_scores", f"select doc_id, {SCORE} as score from (select doc_id, coalesce(text, '') as t from documents)")
def scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", filters.example_priority(F.col("text")).alias("score"))


@query(
    "l03_diverse_sample",
    """with s as (select coalesce(source, 'none') as source, doc_id, length(coalesce(text, '')) as q from documents), r as (select *, row_number() over (partition by source order by q desc, doc_id) as rank, count(*) over (partition by source) as size from s)
    select doc_id, source, rank::int as rank from r order by case when rank <= floor(200 / (select count(distinct source) from s)) then 0 else 1 end, size desc, source, rank limit 200""",
)
def diverse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.length(text0(F.col("text"))).alias("q"))
    return split.diverse(rows, 200, "source", F.desc("q"), F.col("doc_id")).select("doc_id", "source", "rank")


@query("l13_class_caps", "select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) as rn from documents where source is not null) where rn <= 30")
def class_caps(spark: SparkSession, d: str) -> DataFrame:
    return split.top_per_class(table(spark, d, "documents").filter("source is not null").select("source", "doc_id"), 30, "source", F.col("doc_id")).select("source", "doc_id")


@query("l12_histogram", "select source, n, (row_number() over (order by n desc, source))::int as place from (select coalesce(source, 'none') as source, count(*) as n from documents group by 1)")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"))
    # one row a source by now
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "source")))


@query("w02_w03_w04_positions", "select example_id, messages[1].role as first_role, messages[-1].role as last_role, [m.content for m in messages if m.role = 'assistant'][1] as first_answer, coalesce(len([1 for i in range(2, len(messages) + 1) if starts_with(messages[i].content, 'Tool result:') and messages[i - 1].role = 'assistant']), 0)::int as results_after_answers from tool_calling")
def positions(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    n = F.coalesce(F.size(m), F.lit(0))
    follows = F.when(n > 1, F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(m, i)["content"].startswith("Tool result:") & (F.get(m, i - 1)["role"] == "assistant")))).otherwise(0)
    return conversations(spark, d).select(
        "example_id", F.get(m, F.lit(0))["role"].alias("first_role"), F.when(n > 0, F.element_at(m, -1)["role"]).alias("last_role"), F.get(F.filter(m, lambda x: x["role"] == "assistant"), F.lit(0))["content"].alias("first_answer"), follows.alias("results_after_answers")
    )


@query("w01_numbered", "select row_id, row_number() over (order by row_id) as nth, count(*) over () as total from (select distinct row_id from training_rows)")
def numbered(spark: SparkSession, d: str) -> DataFrame:
    return setops.numbered(table(spark, d, "training_rows").select("row_id").distinct(), F.floor(F.col("row_id") / 4096), [F.col("row_id")])


@query("s09_s10_generated", "select i as row_id, ['print', 'read', 'write', 'sort', 'join'][i % 5 + 1] as template, case when i < 80 then 'train' when i < 90 then 'valid' else 'test' end as part from range(100) t(i)")
def generated(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.range(100).withColumnRenamed("id", "row_id")
    template = F.element_at(F.array(*map(F.lit, ("print", "read", "write", "sort", "join"))), (F.col("row_id") % 5 + 1).cast("int"))
    return rows.select("row_id", template.alias("template"), split.part(F.col("row_id") + 1, F.lit(100), "cutpoints").alias("part"))


def scan_then_filter(df: DataFrame, keep: Column, scanned: int, kept: int | None = None) -> DataFrame:
    """(doc_id): of the first ``scanned`` rows by doc_id those that pass, the first ``kept`` of them.  The bounds are the feature."""
    rows = df.orderBy("doc_id").limit(scanned).filter(keep).select("doc_id")
    return rows if kept is None else rows.orderBy("doc_id").limit(kept)


SAMPLED = f"length(trim(t, {WHITE})) >= 100 and len([1 for x in {LINES} if length(trim(x, {BLANKS})) > 0 and not starts_with(trim(x, {BLANKS}), '#')]) >= 5"


@query("s06_scan_then_filter", f"select doc_id from (select doc_id, coalesce(text, '') as t from documents order by doc_id limit 1000) where {SAMPLED}")
def bounded_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan_then_filter(table(spark, d, "documents").select("doc_id", "text"), filters.is_code_sample(F.col("text")), 1_000)


@query(
    "s07_scan_to_target",
    f"""select doc_id from (select doc_id, coalesce(text, '') as t from documents order by doc_id limit 15000) where length(t) between 100 and 50000 and len({LINES}) between 10 and 2000
    and (contains(t, 'def ') or contains(t, 'class ') or contains(t, 'import ') or contains(t, 'from ')) and {QUALITY} >= 0.3 order by doc_id limit 5000""",
)
def scan_to_target(spark: SparkSession, d: str) -> DataFrame:
    return scan_then_filter(table(spark, d, "documents").select("doc_id", "text"), filters.is_code_file(F.col("text")), 15_000, 5_000)


@query("s18_text_distribution", "select contains(coalesce(text, ''), '<tool_call>') as with_tool, count(*) as n from chat_text group by 1")
def text_distribution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat_text").groupBy(text0(F.col("text")).contains("<tool_call>").alias("with_tool")).agg(F.count("*").alias("n"))


@query("k07_check_errors", f"select row_id, {N} < 2 as too_few, coalesce(messages[-1].role, '') <> 'assistant' and {N} > 0 as last_role from training_rows")
def check_errors(spark: SparkSession, d: str) -> DataFrame:
    e = checks.validation_errors(F.col("messages"))
    return table(spark, d, "training_rows").select("row_id", F.array_contains(e, "too_few").alias("too_few"), F.array_contains(e, "last_role").alias("last_role"))


@query("hash_buckets", "select doc_id, ('0x' || substr(md5('1:' || doc_id::varchar), 1, 7))::bigint % 10 as bucket from documents")
def buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", hash_bucket(1, F.col("doc_id"), 10).alias("bucket"))
