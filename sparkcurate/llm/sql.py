"""SQL of the llm queries that SQL can express; meant for small tables (the pair queries join all records on their words)."""

from __future__ import annotations

BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
WORDS = r"'[\p{L}\p{N}]+'"


def label(c: str) -> str:
    return f"lower(trim({c}, {BLANKS}))"


def of_messages(table: str, key: str) -> str:
    said = f"[coalesce(m.content, '') for m in messages if coalesce({label('m.role')}, '') <> 'system']"
    return f"select distinct on ({key}) '{table}' as src, {key} as id, {label('split')} as split, source, coalesce(list_aggregate({said}, 'string_agg', chr(10)), '') as text from {table}"


def of_chat() -> str:
    parts = f"[p for p in string_split(coalesce(text, ''), '<|im_start|>') if contains(p, chr(10)) and length(trim(p, {BLANKS})) > 0 and {label('string_split(p, chr(10))[1]')} <> 'system']"
    said = f"[replace(substr(p, strpos(p, chr(10)) + 1), '<|im_end|>', '') for p in {parts}]"
    return f"select distinct on (text_id) 'chat_text' as src, text_id as id, {label('split')} as split, source, coalesce(list_aggregate({said}, 'string_agg', chr(10)), '') as text from chat_text"


def similar(records: list[str], of_pair: str = "") -> str:
    """Common tables up to ``alike (src, id_a, id_b)``; of_pair: a condition on the records a and b."""
    return f"""with r as ({' union all '.join(f'({x})' for x in records)}),
      w as (select src, id, unnest(regexp_extract_all(lower(text), {WORDS})) as w from r),
      c as (select src, id, w, count(*) as n from w group by all),
      s as (select src, id, sum(n) as total from c group by all having sum(n) >= 20),
      k as (select c.*, s.total, r.split from c join s using (src, id) join r using (src, id)),
      p as (select a.src, a.id as id_a, b.id as id_b, sum(least(a.n, b.n)) as shared, any_value(a.total + b.total) as total from k a join k b on a.src = b.src and a.w = b.w and a.id < b.id {of_pair} group by 1, 2, 3),
      alike as (select src, id_a, id_b from p where 2 * shared >= 0.8 * total)"""


ACROSS = "and (coalesce(a.split, '') = 'train') <> (coalesce(b.split, '') = 'train')"
OVERLAP = similar([of_messages("training_rows", "row_id"), of_chat()], ACROSS)

COMMON = f"nullif(regexp_replace(lower(trim(category, {BLANKS})), '[\\s_\\-]+', '_', 'g'), '')"
POOLS = f"""with t as (select 'training_examples_poc' as pool, example_id::varchar as key, max({COMMON.replace('category', "metadata['category']")}) as common from training_examples_poc where example_id is not null group by 2),
  e as (select 'eval_prompts' as pool, prompt_id as key, max({COMMON}) as common from eval_prompts where prompt_id is not null group by 2), r as (select * from t union all select * from e),
  size as (select pool, count(*) as pool_size from r group by 1), n as (select pool, common, count(*) as available from r group by 1, 2),
  q as (select plan_id::bigint as plan_id, x.pool, category, x.common, greatest(coalesce(min_rows, 0), coalesce(pool_size, 0) * sample_pct * target_pct // 10000)::bigint as needed, coalesce(available, 0)::bigint as available
    from (select *, {COMMON} as common from sample_targets) x left join size on size.pool = x.pool left join n on n.pool = x.pool and n.common = x.common)"""


#: Whole quotas of a plan: one multiple of the target shares within the bounds, found at the last turn of the sum below the size, and largest remainders.
QUOTAS = f"""{POOLS},
  bounds as (select plan_id::bigint as plan_id, x.pool, x.common, max(target_pct)::double as t, least(max(coalesce(min_rows, 0)), max(coalesce(available, 0)))::double as lo, max(coalesce(available, 0))::double as hi, max(coalesce(pool_size, 0) * sample_pct // 100) as total
    from (select *, {COMMON} as common from sample_targets) x left join size on size.pool = x.pool left join n on n.pool = x.pool and n.common = x.common group by 1, 2, 3),
  capped as (select plan_id, pool, common, t, lo, case when t > 0 then hi else lo end as hi, max(total) over (partition by plan_id, pool) as total from bounds),
  plans as (select *, greatest(sum(lo) over w, least(sum(hi) over w, total)) as total2 from capped window w as (partition by plan_id, pool)),
  turns as (select distinct plan_id, pool, unnest([0, lo / t, hi / t]) as x from plans where t > 0),
  sums as (select turns.plan_id, turns.pool, turns.x, sum(greatest(lo, least(hi, turns.x * t))) as s, any_value(total2) as total2, sum(case when t > 0 and turns.x * t < hi - 1e-9 and turns.x * t >= lo - 1e-9 then t else 0 end) as slope
    from turns join plans on plans.plan_id = turns.plan_id and plans.pool = turns.pool group by 1, 2, 3),
  best as (select plan_id, pool, arg_max(x + case when slope > 0 then (total2 - s) / slope else 0 end, x) as x from sums where s <= total2 + 1e-9 group by 1, 2),
  precise as (select plans.*, greatest(lo, least(hi, x * t)) as exact, floor(greatest(lo, least(hi, x * t)) + 1e-6) as base from plans join best on best.plan_id = plans.plan_id and best.pool = plans.pool),
  rounded as (select *, row_number() over (partition by plan_id, pool order by case when base < hi then 0 else 1 end, -round(exact - base, 6), common) as nth, total2 - sum(base) over (partition by plan_id, pool) as rest from precise),
  quotas as (select plan_id, pool, common, (base + case when nth <= rest and base < hi then 1 else 0 end)::bigint as quota from rounded)"""


def windows(table: str, key: str, text: str) -> str:
    return f"select distinct {key}, array_to_string(w[i:i + 11], ' ') as g from (select {key}, w, unnest(range(1, len(w) - 10)) as i from (select {key}, regexp_extract_all(lower(coalesce({text}, '')), {WORDS}) as w from {table}))"


LEAKS = f"with d as ({windows('documents', 'doc_id', 'text')}), h as ({windows('heldout_items', 'item_id', 'item_text')}), l as (select distinct doc_id, item_id from d join h using (g))"

SQL = {
    "p1_found": f"{similar([of_messages('tool_calling', 'example_id'), of_chat()])} select * from alike",
    "p1_classes": f"""with recursive alike_all as ({similar([of_messages('tool_calling', 'example_id'), of_chat()])} select src, id_a, id_b from alike),
      words as (select src, id, unnest(regexp_extract_all(lower(text), {WORDS})) as w from ({' union all '.join(f'({x})' for x in [of_messages('tool_calling', 'example_id'), of_chat()])})),
      bags as (select src, id, string_agg(w, ' ' order by w) as bag from words group by all having count(*) >= 20),
      links as (select src, id_a as a, id_b as b from alike_all union all select src, id_b, id_a from alike_all),
      reach as (select src, id, id as other from bags union select reach.src, reach.id, links.b from reach join links on links.src = reach.src and links.a = reach.other),
      classes as (select src, id, min(other) as class_id from reach group by all),
      linked as (select links.src, links.a as id, count(distinct y.bag) as n_links from links join bags x on x.src = links.src and x.id = links.a join bags y on y.src = links.src and y.id = links.b where x.bag <> y.bag group by all)
      select src, id, class_id, coalesce(n_links, 0) as n_links from classes left join linked using (src, id)""",
    "p3_found": f"{OVERLAP} select * from alike",
    "p3_report": f"""{OVERLAP}, o as (select x.src, x.id_a, x.id_b, h.id, h.split, h.source from alike x join r h on h.src = x.src and h.id in (x.id_a, x.id_b) and coalesce(h.split, '') <> 'train')
      select src, split, source, count(distinct id) as records, count(*) as pairs from o group by all""",
    "p4_found": f"{POOLS} select plan_id, category from q where available < needed",
    "p4_report": f"{QUOTAS} select plan_id, category, needed, available, coalesce(quota, 0)::bigint as taken, greatest(needed - available, 0) as short from q left join quotas using (plan_id, pool, common)",
    "p4_sample": f"""{QUOTAS}
      select plan_id, common as category, key from (select plan_id, r.common, key, quota, row_number() over (partition by plan_id, r.pool, r.common order by md5('4:' || key), key) as nth from r join quotas m on m.pool = r.pool and m.common = r.common) where nth <= quota""",
    "p7_prefixes": """select a.doc_id, min(length(b.text)) as longer_chars, bool_or(regexp_matches(substr(b.text, length(a.text), 2), '^[\\p{L}\\p{N}]{2}$') and length(trim(substr(b.text, length(a.text) + 1), ' ')) > 0) as goes_on
      from (select distinct doc_id, text from documents) a join (select distinct text from documents) b on length(b.text) > length(a.text) and starts_with(b.text, a.text) where length(trim(a.text, ' ')) > 0 group by 1""",
    "p6_found": f"{LEAKS} select doc_id, item_id from l",
    "p6_items": f"{LEAKS} select i.item_id, i.suite, i.split, count(l.doc_id) as documents from heldout_items i left join l using (item_id) group by 1, 2, 3",
}
