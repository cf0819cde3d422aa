"""Queries on texts, JSON fields and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import evaluation
from ..operators.candidates import io_mode_of
from ..operators.freeze import role_sequence
from . import fixtures as fx
from .registry import query

_CLEAN = r"""regexp_replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '^\s+|\s+$', '', 'g')"""
_CLEAN_HTML = _CLEAN.format(x="html")


@query("strip_html", f"select page_id, md5(c) as cleaned_md5, length(c) as cleaned_length from (select page_id, {_CLEAN_HTML} as c from pages)")
def strip_html(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "pages").select("page_id", t.strip_html(F.col("html")).alias("c"))
    return rows.select("page_id", F.md5("c").alias("cleaned_md5"), F.length("c").cast("long").alias("cleaned_length"))


@query("html_min_length", f"select page_id from pages where length({_CLEAN_HTML}) >= 80")
def html_min_length(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").filter(F.length(t.strip_html(F.col("html"))) >= 80).select("page_id")


@query("make_id", "select doc_id, source || '_' || substr(md5(text), 1, 10) as id from documents")
def make_id(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", t.make_id(F.col("source"), F.col("text")).alias("id"))


@query("sha_text", "select doc_id, sha256(text) as sha from documents")
def sha_text(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("ids_sha256", """select source, sha256('["' || array_to_string(list(doc_id::varchar order by doc_id), '","') || '"]') as sha from documents group by source""")
def ids_sha256(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return rows.select("source", t.ids_digest(F.transform("ids", lambda x: x.cast("string"))).alias("sha"))


_STEPS = r"len(regexp_extract_all(text, '第[一二三四五六七八九十\d]+步|\*\*Step\s*\d+|#{1,3}\s+.{2,}|\d+\.\s+\*\*'))"


@query("step_headers", f"with {fx.COMPLETIONS} select doc_id, {_STEPS} as steps from completions")
def step_headers(spark, sf_dir):
    return fx.completions(spark, sf_dir).select("doc_id", t.step_count(F.col("text")).cast("long").alias("steps"))


_BIGRAMS = r"list_distinct(list_transform(range(1, greatest(length({x}), 1)), lambda i: substr({x}, i, 2)))"


@query("bigram_set", r"select doc_id, len(" + _BIGRAMS.format(x="c") + r") as bigrams from (select doc_id, regexp_replace(text, '\s+', '', 'g') as c from documents)")
def bigram_set(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.size(t.bigrams(F.col("text"))).cast("long").alias("bigrams"))


@query("jaccard_turns", r"""with g as (select conv_id, turn, """ + _BIGRAMS.format(x="c") + r""" as b from (select conv_id, turn, regexp_replace(text, '\s+', '', 'g') as c from conversations))
  select x.conv_id, x.turn, round(case when len(x.b) = 0 or len(y.b) = 0 then 0.0::double else len(list_intersect(x.b, y.b))::double / len(list_distinct(list_concat(x.b, y.b))) end, 9) as likeness
  from g x join g y on x.conv_id = y.conv_id and y.turn = x.turn + 1""")
def jaccard_turns(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", t.bigrams(F.col("text")).alias("b"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("b").alias("c"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(t.overlap_ratio(F.col("b"), F.col("c")), 9).alias("likeness"))


_CLOSED = r"len(list_filter(string_split(text, chr(10)), lambda x: starts_with(regexp_replace(x, '^\s+', ''), '```'))) % 2 = 0"
_HAS = "contains(text, '```')"


@query("fence_state", f"with {fx.COMPLETIONS} select doc_id, {_CLOSED} as closed, {_HAS} and not ({_CLOSED}) as truncated, (length(text) - length(replace(text, '```', ''))) / 3 % 2 = 1 as odd from completions")
def fence_state(spark, sf_dir):
    x = F.col("text")
    return fx.completions(spark, sf_dir).select("doc_id", t.fences_closed(x).alias("closed"), t.is_truncated(x).alias("truncated"), t.unclosed_fence(x).alias("odd"))


_POINTS = rf"""(case when {_STEPS} >= 2 then 25 else 0 end) + (case when {_HAS} then 25 else 0 end) + (case when {_HAS} and ({_CLOSED}) then 20 else 0 end)
  + (case when regexp_matches(text, 'O\([^)]+\)|时间复杂度|空间复杂度|Time complexity') then 15 else 0 end) + (case when length(text) between 300 and 4000 then 15 else 0 end)"""


@query("quality_report", f"with {fx.COMPLETIONS} select doc_id, ({_POINTS})::bigint as points, ({_POINTS}) >= 60 as acceptable from completions")
def quality_report(spark, sf_dir):
    points = t.quality_points(F.col("text"))
    return fx.completions(spark, sf_dir).select("doc_id", points.cast("long").alias("points"), (points >= 60).alias("acceptable"))


@query("contract_parts", rf"""with {fx.COMPLETIONS} select doc_id,
  case when regexp_matches(text, '(?i)O\([^)]+\)|时间复杂度|空间复杂度|Time complexity') then 0.2::double else 0.0 end as complexity,
  case when length(text) between 150 and 3000 then 0.05::double else 0.0 end as length_part,
  round(least(len(regexp_extract_all(text, '{t.TEACHING_WORDS}')) / 5.0::double, 1.0) * 0.05, 6) as words from completions""")
def contract_parts(spark, sf_dir):
    x = F.col("text")
    return fx.completions(spark, sf_dir).select("doc_id", t.contract_complexity(x).alias("complexity"), t.contract_length(x).alias("length_part"), F.round(t.contract_words(x), 6).alias("words"))


@query("truncate_text", "select doc_id, case when length(text) <= 240 then text else substr(text, 1, 240) || '...' end as short from documents")
def truncate_text(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", t.shortened(F.col("text"), 240).alias("short"))


@query("number_lines", """select doc_id, md5(array_to_string(list_transform(range(1, len(l) + 1), lambda i: lpad(i::varchar, length(len(l)::varchar)::integer, ' ') || ' | ' || l[i]), chr(10))) as numbered_md5
  from (select doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) as l from documents)""")
def number_lines(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(t.number_lines(F.col("text"))).alias("numbered_md5"))


@query("leak_marker", f"with {fx.COMPLETIONS} select doc_id, contains(lower(text), 'reference_solution') or contains(text, '【参考解代码】') as leaks from completions")
def leak_marker(spark, sf_dir):
    return fx.completions(spark, sf_dir).select("doc_id", t.has_leak(F.col("text")).alias("leaks"))


@query("template_complete", f"with {fx.COMPLETIONS} select doc_id, contains(lower(text), '## plan') and contains(lower(text), 'o(n') as complete from completions")
def template_complete(spark, sf_dir):
    return fx.completions(spark, sf_dir).select("doc_id", t.template_complete(F.col("text"), ["## Plan", "O(n"]).alias("complete"))


_PLAIN = r"regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(9), '    '), '^\s+|\s+$', '', 'g'), '^```(?:python)?\n*', '')"


@query("evalplus_extract", rf"""with {fx.COMPLETIONS}, p as (select doc_id, {_PLAIN} as v from completions),
  c as (select doc_id, substr(v, 1, coalesce(least(nullif(instr(v, chr(10) || '```'), 0), nullif(instr(v, '<|im_end|>'), 0), nullif(instr(v, '<|endoftext|>'), 0), nullif(instr(v, '</s>'), 0)), length(v) + 1)::integer - 1) as v from p)
  select doc_id, md5(case when regexp_replace(v, '^\s+|\s+$', '', 'g') = '' then '' else regexp_replace(v, '\s+$', '') || chr(10) end) as code_md5 from c""")
def evalplus_extract(spark, sf_dir):
    return fx.completions(spark, sf_dir).select("doc_id", F.md5(t.first_solution(F.col("text"))).alias("code_md5"))


@query("parse_json_default", "select event_id, coalesce((try_cast(props as json)->>'k')::bigint, -1) as k from events")
def parse_json_default(spark, sf_dir):
    got = t.json_or(F.col("props"), "k bigint", F.lit(None))["k"]
    return fx.table(spark, sf_dir, "events").select("event_id", F.coalesce(got, F.lit(-1)).cast("long").alias("k"))


@query("json_compatible", "select event_id, json_valid(case when event_id % 5 = 0 then substr(props, 2) else props end) as valid from events")
def json_compatible(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, F.substring("props", 2, 1 << 30)).otherwise(F.col("props"))
    return fx.table(spark, sf_dir, "events").select("event_id", t.is_json(text).alias("valid"))


@query("io_mode", """select event_id, case when event_type = 'click' then 'call_based' when event_type = 'view' then 'standard_input'
  when user_id % 3 = 0 then 'call_based' else 'standard_input' end as io_mode from events""")
def io_mode(spark, sf_dir):
    mode = F.when(F.col("event_type") == "click", "call_based").when(F.col("event_type") == "view", "standard_input").otherwise("unknown")
    name = F.when(F.col("user_id") % 3 == 0, "f").otherwise("")
    return fx.table(spark, sf_dir, "events").select("event_id", io_mode_of(mode, name).alias("io_mode"))


@query("role_sequence", f"""with {fx.CONVERSATIONS} select conv_id, array_to_string(list_transform(messages, lambda m: m.role), ',') as roles,
  list_transform(messages, lambda m: m.role) = ['system', 'user', 'assistant'] as is_triple, messages[-1].role = 'assistant' as last_is_assistant from convs""")
def roles(spark, sf_dir):
    rows = fx.conversations(spark, sf_dir)
    found = role_sequence(F.col("messages"))
    return rows.select("conv_id", F.array_join(found, ",").alias("roles"), (found == F.array(*map(F.lit, ("system", "user", "assistant")))).alias("is_triple"), (F.try_element_at("messages", F.lit(-1))["role"] == "assistant").alias("last_is_assistant"))


@query("question_text", rf"""with {fx.CONVERSATIONS} select conv_id, regexp_replace(array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'user'), lambda m: m.text), chr(10) || chr(10)), '^\s+|\s+$', '', 'g') as question from convs""")
def question_text(spark, sf_dir):
    texts = F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["text"])
    return fx.conversations(spark, sf_dir).select("conv_id", t.strip(F.array_join(texts, "\n\n")).alias("question"))


@query("final_user_prompt", f"""with {fx.CONVERSATIONS}, p as (select conv_id, list_filter(messages, lambda m: m.role <> 'assistant') as m from convs)
  select conv_id, len(m) as n_messages, m[-1].role = 'user' as ends_on_user, md5(m[-1].text) as prompt_md5 from p""")
def final_user_prompt(spark, sf_dir):
    rows = fx.conversations(spark, sf_dir).select("conv_id", F.filter("messages", lambda m: m["role"] != "assistant").alias("m"))
    last = F.try_element_at("m", F.lit(-1))
    return rows.select("conv_id", F.size("m").cast("long").alias("n_messages"), (last["role"] == "user").alias("ends_on_user"), F.md5(last["text"]).alias("prompt_md5"))


_SYSTEM, _SUFFIX = "You are a careful teacher.", "\nAnswer with code."


@query("eval_messages", f"""with {fx.CONVERSATIONS}, b as (select conv_id, list_filter(messages, lambda m: m.role <> 'system') as m from convs),
  c as (select conv_id, case when m[-1].role = 'assistant' then m[:-2] else m end as m from b),
  d as (select conv_id, m, coalesce(list_max(list_transform(range(1, len(m) + 1), lambda i: case when m[i].role = 'user' then i else 0 end)), 0) as u from c)
  select conv_id, len(m) + 1 as n_messages, md5({fx.literal(_SYSTEM)} || array_to_string(list_transform(range(1, len(m) + 1), lambda i: '|' || m[i].role || ':' || m[i].text || case when i = u then {fx.literal(_SUFFIX)} else '' end), '')) as rendered_md5 from d""")
def eval_messages(spark, sf_dir):
    rows = fx.conversations(spark, sf_dir).select("conv_id", evaluation.eval_messages(F.col("messages"), _SYSTEM, _SUFFIX).alias("m"))
    body = F.array_join(F.transform(F.slice("m", 2, 1 << 30), lambda m: F.concat(F.lit("|"), m["role"], F.lit(":"), m["text"])), "")
    return rows.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.md5(F.concat(F.get("m", F.lit(0))["text"], body)).alias("rendered_md5"))


@query("chatml_assemble", "select doc_id, 'system,user,assistant' as roles, md5('Teach.' || text || substr(md5(text), 1, 8)) as body_md5, source as meta_source from documents")
def chatml_assemble(spark, sf_dir):
    message = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    messages = F.array(message("system", F.lit("Teach.")), message("user", F.col("text")), message("assistant", F.substring(F.md5("text"), 1, 8)))
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", messages.alias("messages"), F.struct("source", "lang").alias("metadata"))
    return rows.select("doc_id", F.array_join(role_sequence(F.col("messages")), ",").alias("roles"), F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "")).alias("body_md5"), F.col("metadata.source").alias("meta_source"))


@query("prompt_record", f"""with {fx.CONVERSATIONS} select conv_id, len(list_filter(messages, lambda m: m.role <> 'assistant')) as n_messages,
  '{{"io_mode":"' || case when conv_id % 2 = 0 then 'call_based' else 'standard_input' end || '","difficulty":"' || case when conv_id % 3 = 0 then 'easy' else 'hard' end || '"}}' as metadata from convs""")
def prompt_record(spark, sf_dir):
    rows = fx.conversations(spark, sf_dir)
    meta = F.to_json(F.struct(F.when(F.col("conv_id") % 2 == 0, "call_based").otherwise("standard_input").alias("io_mode"), F.lower(F.when(F.col("conv_id") % 3 == 0, "EASY").otherwise("HARD")).alias("difficulty")))
    return rows.select("conv_id", F.size(F.filter("messages", lambda m: m["role"] != "assistant")).cast("long").alias("n_messages"), meta.alias("metadata"))
