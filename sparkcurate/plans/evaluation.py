"""Queries over evaluation results: scores, reports, comparisons, latencies, grids.

Results are made of the given tables: every trace answers the prompt of the same number, modulo the number of prompts, so each prompt has as many
results as there are traces to a prompt; the name of a result is that of prompt and trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcurate.functions.textfn import text0
from sparkcurate.operators import scoring, split
from sparkcurate.plans.registry import query, table

RESULTS = """p as (select distinct on (prompt_id) prompt_id, category, expected_tool_calls, expected_keywords, right(prompt_id, 8)::bigint as prompt_no from eval_prompts order by prompt_id),
  t as (select distinct on (example_id) example_id as no, query, answer, tool_calls from training_examples_poc order by example_id),
  r as (select p.*, t.no, t.answer as response, [coalesce(c.name, c.tool) for c in coalesce(t.tool_calls, [])] as called, no % 3 as run_no, 'run' || (no % 3) as run_id, no % 1000 / 100.0::double as seconds
        from p join t on (t.no - 1) % (select max(prompt_no) from p) + 1 = prompt_no)"""
E = "coalesce(expected_tool_calls, [])"
K = "coalesce(expected_keywords, [])"
TOOL = f"(case when len(list_distinct({E})) = 0 then case when len(called) > 0 then 0.5::double else 1.0::double end else len(list_intersect(list_distinct({E}), called))::double / len(list_distinct({E})) end)"
WORD = f"(case when len({K}) = 0 then 1.0::double else len([1 for k in {K} if contains(lower(coalesce(response, '')), lower(k))])::double / len({K}) end)"
SCORE = f"(case when len({E}) > 0 and len({K}) > 0 then ({TOOL} + {WORD}) / 2 when len({E}) > 0 then {TOOL} when len({K}) > 0 then {WORD} else 1.0::double end)"
SCORED = f"with {RESULTS}, s as (select *, {SCORE} as score, seconds < 8 as success from r)"


def results(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "eval_prompts").groupBy("prompt_id").agg(*(F.first(c).alias(c) for c in ("category", "expected_tool_calls", "expected_keywords")))
    p = p.withColumn("prompt_no", F.substring("prompt_id", -8, 8).cast("bigint"))
    t = table(spark, d, "training_examples_poc").groupBy(F.col("example_id").alias("no")).agg(F.first("answer").alias("response"), F.first("tool_calls").alias("calls"))
    most = table(spark, d, "eval_prompts").agg(F.max(F.substring("prompt_id", -8, 8).cast("bigint")).alias("most"))  # one row
    rows = t.crossJoin(F.broadcast(most)).withColumn("prompt_no", (F.col("no") - 1) % F.col("most") + 1).join(p, "prompt_no")
    called = F.transform(F.coalesce("calls", F.array()), lambda c: F.coalesce(c["name"], c["tool"]))
    return rows.select("prompt_id", "category", "expected_tool_calls", "expected_keywords", "no", "response", called.alias("called"), F.concat(F.lit("run"), (F.col("no") % 3).cast("string")).alias("run_id"), (F.col("no") % 1000 / F.lit(100.0)).alias("seconds"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    score = scoring.prompt_score(F.col("expected_tool_calls"), F.col("expected_keywords"), F.col("called"), F.col("response"))
    return results(spark, d).withColumn("score", score).withColumn("success", F.col("seconds") < 8)


@query("e01_e02_e03_u06_prompt_scores", f"with {RESULTS} select prompt_id, no, round({TOOL}, 9) as tools, round({WORD}, 9) as keywords, round({SCORE}, 9) as score, len(list_filter(list_distinct({E}), lambda x: not list_contains(called, x)))::int as missing from r")
def prompt_scores(spark: SparkSession, d: str) -> DataFrame:
    e, k, c = F.col("expected_tool_calls"), F.col("expected_keywords"), F.col("called")
    return results(spark, d).select(
        "prompt_id",
        "no",
        F.round(scoring.tool_score(e, c), 9).alias("tools"),
        F.round(scoring.keyword_score(k, F.col("response")), 9).alias("keywords"),
        F.round(scoring.prompt_score(e, k, c, F.col("response")), 9).alias("score"),
        F.size(F.array_except(scoring.empty_list(e), c)).alias("missing"),
    )


USED = "len(called) > 0"


@query(
    "e04_autonomy",
    f"with {RESULTS}, a as (select prompt_id, no, (({USED}) = (len({E}) > 0))::int::double as decision, {TOOL} as tool, {WORD} as accuracy, len({E}) > 0 as needs from r) select prompt_id, no, decision, round(case when needs then tool else decision end, 9) as correctness, round((decision + case when needs then tool else decision end + accuracy) / 3, 9) as overall from a",
)
def autonomy(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("expected_tool_calls")
    a = scoring.autonomy(F.size(scoring.empty_list(e)) > 0, e, F.col("called"), scoring.keyword_score(F.col("expected_keywords"), F.col("response")))
    return results(spark, d).withColumn("a", a).select("prompt_id", "no", "a.decision", F.round("a.correctness", 9).alias("correctness"), F.round("a.overall", 9).alias("overall"))


@query(
    "e05_ladder",
    f"with {RESULTS} select prompt_id, no, case when {TOOL} = 1 then 1.0::double when {TOOL} > 0 then 0.5::double when {USED} then 0.1::double else 0.0::double end as ladder, round(least(len(list_intersect(list_distinct({E}), called))::double / greatest(len({E}), 1) + case when {USED} then 0.1::double else 0 end, 1.0), 9) as multi from r",
)
def ladder(spark: SparkSession, d: str) -> DataFrame:
    e, c = F.col("expected_tool_calls"), F.col("called")
    t, used = scoring.tool_score(e, c), F.size("called") > 0
    return results(spark, d).select("prompt_id", "no", scoring.ladder(t == 1, t > 0, used).alias("ladder"), F.round(scoring.multi_score(F.size(F.array_intersect(scoring.empty_list(e), c)), F.size(scoring.empty_list(e)), used), 9).alias("multi"))


LAYERS = f"case when length(coalesce(response, '')) = 0 then 'answered' when not ({USED}) then 'tool' when {TOOL} < 1 then 'identity' when {WORD} < 0.5 then 'keywords' end"


@query("e06_e07_e17_layers", f"with {RESULTS} select prompt_id, no, {LAYERS} as failed, coalesce({LAYERS} <> 'answered', true) as soft, {LAYERS} is null as strict from r")
def layers(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    t = scoring.tool_score(F.col("expected_tool_calls"), F.col("called"))
    x = scoring.layers({"answered": F.length(text0(F.col("response"))) > 0, "tool": F.size("called") > 0, "identity": t >= 1, "keywords": scoring.keyword_score(F.col("expected_keywords"), F.col("response")) >= 0.5})
    return r.withColumn("x", x).select("prompt_id", "no", "x.failed", "x.soft", "x.strict")


@query(
    "e08_e16_concepts",
    f"with {RESULTS}, c as (select prompt_id, no, case when len({K}) = 0 then 0.0::double else {WORD} end as accuracy, {USED} as used from r) select prompt_id, no, round(accuracy, 9) as accuracy, used and accuracy > 0.5 as autonomous, used and accuracy >= 0.75 as success from c",
)
def concepts(spark: SparkSession, d: str) -> DataFrame:
    x = scoring.concept_score(F.col("expected_keywords"), F.col("response"), F.size("called") > 0)
    return results(spark, d).withColumn("x", x).select("prompt_id", "no", F.round("x.accuracy", 9).alias("accuracy"), "x.autonomous", "x.success")


@query(
    "j01_a05_a06_e09_category_left",
    f"{SCORED}, c as (select coalesce(category, 'unknown') as category, score from s where true), g as (select category, count(*) as n, count(*) filter (where score >= 0.5) as passed, avg(score) as a from c group by 1) select category, n, passed, round(a, 9) as avg_score, case when a >= 0.7 then 'good' when a >= 0.4 then 'fair' else 'poor' end as verdict from g",
)
def category_left(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.with_category(scored(spark, d).drop("category"), table(spark, d, "eval_prompts"))
    return scoring.category_report(rows).select("category", "n", "passed", F.round("avg_score", 9).alias("avg_score"), scoring.score_class(F.col("avg_score")).alias("verdict"))


@query(
    "j02_a07_category_inner",
    f"{SCORED}, g as (select category, count(*) as n, avg(score) as a from s join (select distinct prompt_id from eval_prompts where category is not null) using (prompt_id) where category is not null group by 1) select category, n, round(a, 9) as avg_score, a >= 0.7 as ok from g",
)
def category_inner(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.with_category(scored(spark, d).drop("category"), table(spark, d, "eval_prompts").filter("category is not null"), unmatched=False)
    return scoring.category_report(rows).select("category", "n", F.round("avg_score", 9).alias("avg_score"), (F.col("avg_score") >= 0.7).alias("ok"))


@query("a04_run_report", f"{SCORED} select run_id, count(*) as n, round(avg(score), 9) as overall_score, round(avg(success::int), 9) as success_rate from s group by 1")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    return scoring.run_report(scored(spark, d)).select("run_id", "n", F.round("overall_score", 9).alias("overall_score"), F.round("success_rate", 9).alias("success_rate"))


@query("w05_j13_delta", f"{SCORED}, g as (select run_id, avg(score) as a from s group by 1) select run_id, round(a, 9) as overall_score, round(a - lag(a) over (order by run_id), 9) as delta from g")
def delta(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.with_delta(scoring.run_report(scored(spark, d)), "run_id", "overall_score")
    return rows.select("run_id", F.round("overall_score", 9).alias("overall_score"), F.round("delta", 9).alias("delta"))


CELL = "round(coalesce(avg(score) filter (where run_id = '{0}'), 0.0), 9) as {0}"


@query("j07_k05_matrix", f"{SCORED} select category, {', '.join(CELL.format(f'run{k}') for k in range(3))} from s where category is not null group by 1")
def matrix(spark: SparkSession, d: str) -> DataFrame:
    runs = ["run0", "run1", "run2"]
    rows = scoring.matrix(scored(spark, d).filter("category is not null"), runs)
    return rows.select("category", *(F.round(r, 9).alias(r) for r in runs))


@query(
    "a20_rollup_passes",
    f"with {RESULTS}, l as (select coalesce(category, 'none') as category, coalesce({LAYERS} <> 'answered', true) as soft, {LAYERS} is null as strict from r) select coalesce(category, 'all') as category, count(*) as n, count(*) filter (where soft) as soft, count(*) filter (where strict) as strict from l group by rollup (category)",
)
def rollup_passes(spark: SparkSession, d: str) -> DataFrame:
    x = layers(spark, d).join(results(spark, d).select("no", F.coalesce("category", F.lit("none")).alias("category")), "no")
    return scoring.rollup_passes(x)


@query("j08_targets", f"with {RESULTS}, g as (select coalesce(category, 'none') as category, arg_min(1.0 - length(prompt_id) / 100.0::double, prompt_id) as first_target from r group by 1) select category, coalesce(case when category = 'none' then null else first_target end, 0.8) as target from g")
def targets(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).select(F.coalesce("category", F.lit("none")).alias("category"), "prompt_id")
    first = r.filter("category <> 'none'").groupBy("category").agg(F.min_by(1.0 - F.length("prompt_id") / F.lit(100.0), "prompt_id").alias("t"))
    return r.select("category").distinct().join(first, "category", "left").select("category", F.coalesce("t", F.lit(0.8)).alias("target"))


@query(
    "j09_registry_lookup",
    "with f as (select * from (values ('scan_files', 'files'), ('list_refs', 'refs'), ('run_checks', 'checks')) as f(name, field)), c as (select unnest(tool_calls) as c from training_examples_poc) select coalesce(c.name, c.tool) as name, field, count(*) as n from c left join f on f.name = coalesce(c.name, c.tool) group by 1, 2",
)
def registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    fields = spark.createDataFrame([("scan_files", "files"), ("list_refs", "refs"), ("run_checks", "checks")], "name string, field string")
    calls = table(spark, d, "training_examples_poc").select(F.explode("tool_calls").alias("c")).select(F.coalesce("c.name", "c.tool").alias("name"))
    return calls.groupBy("name").agg(F.count("*").alias("n")).join(fields, "name", "left").select("name", "field", "n")


@query("j12_unknown_fields", "select distinct name from (select coalesce(c.name, c.tool) as name from (select unnest(tool_calls) as c from training_examples_poc)) where name not in ('scan_files', 'list_refs') and name is not null")
def unknown_fields(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("scan_files",), ("list_refs",)], "name string")
    return table(spark, d, "training_examples_poc").select(F.explode("tool_calls").alias("c")).select(F.coalesce("c.name", "c.tool").alias("name")).filter("name is not null").distinct().join(known, "name", "left_anti")


@query(
    "j14_old_and_new",
    f"{SCORED}, o as (select no, score from s where run_id = 'run0'), n as (select no - 1 as no, score from s where run_id = 'run1') select o.no, round(o.score, 9) as old_score, case when n.score is null then 'n/a' when n.score > o.score then 'better' when n.score < o.score then 'worse' else 'same' end as verdict from o left join n using (no)",
)
def old_and_new(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    old = s.filter("run_id = 'run0'").select("no", F.col("score").alias("a"))
    new = s.filter("run_id = 'run1'").select((F.col("no") - 1).alias("no"), F.col("score").alias("b"))
    verdict = F.when(F.col("b").isNull(), "n/a").when(F.col("b") > F.col("a"), "better").when(F.col("b") < F.col("a"), "worse").otherwise("same")
    return old.join(new, "no", "left").select("no", F.round("a", 9).alias("old_score"), verdict.alias("verdict"))


# -- latencies, grids, checkpoints -----------------------------------------------------------------------------------------------------------


@query(
    "a24_g08_index_percentiles",
    """with v as (select event_type, list_sort(list(value)) as v from events where value >= 0 group by 1)
    select event_type, len(v) as n, v[len(v) // 2 + 1] as p50, v[least(len(v) - 1, floor(len(v) * 0.95::double)::bigint) + 1] as p95, v[1] as low, v[-1] as high from v""",
)
def index_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return scoring.latency(table(spark, d, "events").select("event_type", F.col("value").alias("seconds")), "event_type")


@query(
    "a23_steady_state",
    "with o as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as k from events) select user_id, max(value) filter (where k = 1) as warm_up, round(avg(value) filter (where k > 1), 6) as steady from o group by 1",
)
def steady_state(spark: SparkSession, d: str) -> DataFrame:
    # the first event of a user by an aggregate that combines before the shuffle; all others are the sum without it
    order = F.struct("ts", "event_id")
    rows = table(spark, d, "events").groupBy("user_id").agg(F.min_by("value", order).alias("warm_up"), F.sum("value").alias("s"), F.count("*").alias("n"))
    return rows.select("user_id", "warm_up", F.round(F.try_divide(F.col("s") - F.col("warm_up"), F.col("n") - 1), 6).alias("steady"))


@query("a21_a22_time_shares", "select user_id, count(*) as calls, round(sum(value), 6) as total, round(coalesce(sum(value) filter (where event_type = 'view'), 0), 6) as view_time, round(coalesce(sum(value) filter (where event_type = 'view'), 0) * 100 / nullif(sum(value), 0), 6) as view_pct from events group by 1")
def time_shares(spark: SparkSession, d: str) -> DataFrame:
    view = F.coalesce(F.sum(F.when(F.col("event_type") == "view", F.col("value"))), F.lit(0.0))
    total = F.sum("value")
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.round(total, 6).alias("total"), F.round(view, 6).alias("view_time"), F.round(view * 100 / F.nullif(total, F.lit(0.0)), 6).alias("view_pct"))


@query("a25_score_histogram", f"{SCORED} select floor(score * 10)::int as bin, count(*) as n, count(*) filter (where score >= 0.5 and not success) as false_pass, count(*) filter (where score < 0.5 and success) as false_fail from s group by 1")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    return scored(spark, d).groupBy(F.floor(s * 10).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count_if((s >= 0.5) & ~F.col("success")).alias("false_pass"), F.count_if((s < 0.5) & F.col("success")).alias("false_fail"))


@query("a26_determinism", f"{SCORED} select response, count(distinct score) = 1 as deterministic from s where response is not null group by response")
def determinism(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).filter("response is not null").groupBy("response").agg((F.count_distinct("score") == 1).alias("deterministic"))


@query("a27_zero_with_content", f"{SCORED} select case when length(coalesce(response, '')) = 0 then 'empty' when score = 0 and length(response) > 100 then 'zero_with_content' when right(trim(response, ' '), 1) not in ('.', '!', '?', '`') then 'open_end' else 'ok' end as kind, count(*) as n from s group by 1")
def zero_with_content(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("response")
    kind = F.when(F.length(text0(r)) == 0, "empty").when((F.col("score") == 0) & (F.length(r) > 100), "zero_with_content").when(~F.right(F.trim(r), F.lit(1)).isin(".", "!", "?", "`"), "open_end").otherwise("ok")
    return scored(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("a39_zero_shot", f"{SCORED} select coalesce(category, 'none') as category, count(*) as n, round(count(*) filter (where score >= 0.5)::double / count(*), 9) as pass_share, round(avg(seconds), 9) as mean_seconds, count(*) filter (where score >= 0.5) * 2 >= count(*) as ok from s group by 1")
def zero_shot(spark: SparkSession, d: str) -> DataFrame:
    p = F.count_if(F.col("score") >= 0.5)
    return scored(spark, d).groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(F.count("*").alias("n"), F.round(p / F.count("*"), 9).alias("pass_share"), F.round(F.avg("seconds"), 9).alias("mean_seconds"), (p * 2 >= F.count("*")).alias("ok"))


@query(
    "a34_a35_l11_comparison",
    """with g as (select event_type as config, avg(value) as seconds from events group by 1), b as (select seconds as base from g where config = 'view')
    select config, round(seconds, 9) as seconds, round(base / seconds, 9) as speedup, round((base - seconds) * 100 / base, 9) as improvement_pct, row_number() over (order by seconds, config)::int as rank from g, b""",
)
def comparison(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("config")).agg(F.avg("value").alias("seconds"))
    return scoring.comparison(g, "config", "view", "seconds").select("config", F.round("seconds", 9).alias("seconds"), F.round("speedup", 9).alias("speedup"), F.round("improvement_pct", 9).alias("improvement_pct"), "rank")


GRID = {"lr": (1e-5, 5e-5, 1e-4), "rank": (4, 8, 16), "iters": (100, 300, 500), "batch": (2, 4)}


@query(
    "j06_l01_grid",
    "with g as (select lr, rank, iters, batch, row_number() over () - 1 as ord from unnest([1e-5::double, 5e-5, 1e-4]) a(lr), unnest([4, 8, 16]) b(rank), unnest([100, 300, 500]) c(iters), unnest([2, 4]) e(batch)) select lr, rank::int as rank, iters::int as iters, batch::int as batch, round(rank * 10 + iters / 100.0::double + batch, 6) as score from g",
)
def grid(spark: SparkSession, d: str) -> DataFrame:
    g = scoring.grid(GRID, spark).withColumn("score", F.round(F.col("rank") * 10 + F.col("iters") / F.lit(100.0) + F.col("batch"), 6))
    return g.orderBy(F.desc("score"), "ord").select("lr", "rank", "iters", "batch", "score")


@query("l04_best_iteration", "select l_orderkey as run, arg_min(l_linenumber, (l_discount, l_linenumber)) as best from lineitem group by 1")
def best_iteration(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(split.arg_min("l_discount", "l_linenumber").alias("best"))


@query("l05_nearest_checkpoint", "select doc_id, case when doc_id // 100 = 0 then 100 else doc_id // 100 * 100 end as checkpoint from documents")
def nearest_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", split.nearest_checkpoint(F.col("doc_id"), 100).cast("bigint").alias("checkpoint"))


@query("e10_suites", "select category, count(distinct prompt_id) as prompts, count(distinct prompt_id) filter (where len(coalesce(expected_tool_calls, [])) > 0) as with_tools from eval_prompts group by 1")
def suites(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("prompt_id")
    return table(spark, d, "eval_prompts").groupBy("category").agg(F.count_distinct(p).alias("prompts"), F.count_distinct(F.when(F.size(scoring.empty_list(F.col("expected_tool_calls"))) > 0, p)).alias("with_tools"))


@query(
    "j10_same_file_kind",
    "with e as (select c_custkey as dep, c_nationkey as own from customer), k as (select n_nationkey, n_name from nation where n_nationkey % 2 = 0) select coalesce(n_name, 'unknown') as kind, count(*) as n from e left join k on own = n_nationkey group by 1",
)
def same_file_kind(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(kinds, "c_nationkey", "left").groupBy(F.coalesce("n_name", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))


@query("ranked_runs", f"{SCORED} select run_id, rank() over (order by round(avg(score), 6) desc, run_id)::int as place from s group by run_id")
def ranked_runs(spark: SparkSession, d: str) -> DataFrame:
    g = scored(spark, d).groupBy("run_id").agg(F.round(F.avg("score"), 6).alias("a"))
    return g.select("run_id", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("a"), "run_id")).alias("place"))
