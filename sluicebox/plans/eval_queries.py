"""Queries on aggregates, evaluation tables, judges, token arrays and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, freeze, sampling, tokens, verify
from . import fixtures as fx
from .registry import query


@query("agg_distribution", "select 'lang' as field, coalesce(lang, 'None') as value, count(*) as n from documents group by 2 union all select 'source', coalesce(source, 'None'), count(*) from documents group by 2")
def distribution(spark, sf_dir):
    return freeze.distributions(fx.table(spark, sf_dir, "documents"), ["lang", "source"])


@query("agg_nearest_rank", "select lang, min(n_chars) as min, quantile_disc(n_chars, 0.5) as p50, quantile_disc(n_chars, 0.9) as p90, quantile_disc(n_chars, 0.95) as p95, quantile_disc(n_chars, 0.99) as p99, max(n_chars) as max, round(avg(n_chars), 6) as mean from documents group by lang")
def nearest_rank(spark, sf_dir):
    return freeze.nearest_rank(fx.table(spark, sf_dir, "documents"), "n_chars", ["lang"]).withColumn("mean", F.round("mean", 6))


@query("agg_percentile_cont", "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.95), 6) as p95 from events group by event_type")
def percentile_cont(spark, sf_dir):
    at = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return fx.table(spark, sf_dir, "events").groupBy("event_type").agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"))


@query("agg_rejected_summary", "select count(*) as records, count(distinct user_id) as unique_ids, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type = 'view') as views from events where event_type <> 'purchase'")
def rejected_summary(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events").filter("event_type <> 'purchase'")
    return rows.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("user_id").alias("unique_ids"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "view").alias("views"))


@query("agg_process_counters", "select count(*) as attempted, count(*) filter (quality = 1 and toxic = 0) as accepted, count(*) filter (quality = 0) as low_quality, count(*) filter (toxic = 1) as toxic, count(*) filter (quality is null) as pending from documents left join labels using (doc_id)")
def process_counters(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select("doc_id").join(fx.table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("accepted"), F.count_if(F.col("quality") == 0).alias("low_quality"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("pending")
    )


@query("agg_variant_summary", f"""with {fx.GENERATIONS} select variant, count(*) as samples, count(*) filter (strict_pass) as passed, round(avg(strict_pass::integer), 6) as pass_at_1, round(avg(pass_rate), 6) as mean_pass_rate,
  count(*) filter (hit_limit) as limit_hits, count(*) filter (unclosed) as unclosed_fences, round(quantile_cont(generated_tokens, 0.5), 6) as tokens_p50, round(quantile_cont(generated_tokens, 0.9), 6) as tokens_p90, max(generated_tokens) as tokens_max from generations group by variant""")
def variant_summary(spark, sf_dir):
    return evaluation.variant_summary(fx.generations(spark, sf_dir))


@query("agg_failure_histogram", f"""with {fx.GENERATIONS}, c as (select variant, case when problem_id % 9 = 0 then 'missing_code' when problem_id % 10 = 0 then 'unsupported' when problem_id % 8 = 0 then 'runtime_or_timeout' when pass_rate < 1.0 then 'wrong_answer' end as failure_type from generations)
  select variant, failure_type, count(*) as n from c where failure_type is not null group by variant, failure_type""")
def failure_histogram(spark, sf_dir):
    i = F.col("problem_id")
    kind = verify.classify_evaluated(i % 9 != 0, i % 10 == 0, F.when(i % 8 == 0, "boom"), F.col("pass_rate"))
    return evaluation.failure_histogram(fx.generations(spark, sf_dir).withColumn("failure_type", kind))


@query("set_rescued_lost", f"""with {fx.GENERATIONS}, f as (select problem_id, max(strict_pass::integer) filter (variant = 'base') as b, max(strict_pass::integer) filter (variant = 'tuned') as t from generations group by problem_id)
  select problem_id, case when b = 1 and t = 1 then 'both' when b = 1 then 'lost' when t = 1 then 'rescued' else 'neither' end as change from f""")
def rescued_lost(spark, sf_dir):
    return evaluation.compare_variants(fx.generations(spark, sf_dir), "base", "tuned")


@query("join_generation_verification", f"""with {fx.GENERATIONS} select variant, count(*) as complete, count(*) filter (strict_pass) as passed from generations where problem_id in (select doc_id from labels) group by variant""")
def generation_verification(spark, sf_dir):
    rows = fx.generations(spark, sf_dir)
    texts, verdicts = rows.select("problem_id", "variant", "generated_tokens"), rows.select("problem_id", "variant", "strict_pass")
    selected = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("problem_id"))
    return texts.join(verdicts, ["problem_id", "variant"]).join(selected, "problem_id").groupBy("variant").agg(F.count(F.lit(1)).alias("complete"), F.count_if("strict_pass").alias("passed"))


@query("agg_stats_reference", """with a as (select doc_id, lang, source, min(r) filter ((doc_id * 3 + r * 5) % 11 = 10) as selected_rank from documents, (values (0), (1), (2), (3)) t(r) group by all),
  b as (select *, coalesce(selected_rank + 1, 4) as attempted from a)
  select case when grouping(lang) = 0 then 'lang' when grouping(source) = 0 then 'source' else 'all' end as dimension, case when grouping(lang) = 0 then lang when grouping(source) = 0 then source else '' end as value,
    count(*) as total, count(*) filter (selected_rank = 0) as first_candidate, count(*) filter (selected_rank > 0) as fallback, count(*) filter (selected_rank is null) as failed, round(avg(attempted), 6) as mean_attempted
  from b group by grouping sets ((), (lang), (source))""")
def stats_reference(spark, sf_dir):
    from ..operators.dedup import first_passing
    from .data_queries import attempts

    chosen = first_passing(attempts(spark, sf_dir), "doc_id", "rank", "rate")
    return evaluation.reference_stats(chosen.join(fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id"), ["lang", "source"])


@query("agg_token_audit", "select t as threshold, count(*) filter (n_chars > t) as over, round(count(*) filter (n_chars > t) / count(*)::double, 6) as ratio from documents, (values (2048::bigint), (4096), (6144), (8192)) v(t) group by t")
def token_audit(spark, sf_dir):
    return evaluation.over_thresholds(fx.table(spark, sf_dir, "documents"), "n_chars", [2048, 4096, 6144, 8192])


_LABELS = """labelled as (select doc_id, source, prompt, full_ids, case when len(full_ids) > len(prompt) and full_ids[1:len(prompt)] = prompt then list_concat(list_transform(prompt, lambda x: -100), full_ids[len(prompt) + 1:]) end as labels from token_rows)"""


@query("label_mask", f"with {fx.TOKEN_ROWS}, {_LABELS} select doc_id, array_to_string(labels, ',') as labels from labelled")
def label_mask(spark, sf_dir):
    rows = fx.token_rows(spark, sf_dir)
    labels = tokens.label_mask(F.col("prompt"), F.col("full_ids"))
    return rows.select("doc_id", F.array_join(F.transform(labels, lambda x: x.cast("string")), ",").alias("labels"))


@query("agg_supervised_ratio", f"with {fx.TOKEN_ROWS}, {_LABELS} select sum(len(list_filter(labels, lambda x: x <> -100)))::bigint as supervised, sum(len(labels))::bigint as total, round(sum(len(list_filter(labels, lambda x: x <> -100))) / sum(len(labels))::double, 9) as ratio from labelled where labels is not null")
def supervised_ratio(spark, sf_dir):
    rows = fx.token_rows(spark, sf_dir).select(tokens.label_mask(F.col("prompt"), F.col("full_ids")).alias("l")).filter("l is not null")
    some, every = F.sum(tokens.supervised(F.col("l"))), F.sum(F.size("l"))
    return rows.agg(some.alias("supervised"), every.alias("total"), F.round(some / every, 9).alias("ratio"))


@query("pad_batch", f"""with {fx.TOKEN_ROWS}, w as (select *, (ceil(max(len(full_ids)) over (partition by source) / 8.0) * 8)::bigint as width from token_rows)
  select doc_id, width, array_to_string(list_concat(full_ids, list_transform(range(0, width - len(full_ids)), lambda i: 0)), ',') as padded, len(full_ids) as attended from w""")
def pad_batch(spark, sf_dir):
    rows = tokens.pad_batch(fx.token_rows(spark, sf_dir).select("doc_id", "source", "full_ids"), "full_ids", "source", 0)
    attended = F.aggregate("attention", F.lit(0), lambda a, x: a + x).cast("long")
    return rows.select("doc_id", F.size("padded").cast("long").alias("width"), F.array_join(F.transform("padded", lambda x: x.cast("string")), ",").alias("padded"), attended.alias("attended"))


@query("trim_eos", f"""with {fx.TOKEN_ROWS}, p as (select doc_id, list_concat(full_ids, [0, 0]) as ids from token_rows)
  select doc_id, array_to_string(case when list_position(ids, 5) > 0 then ids[1:list_position(ids, 5) - 1] else ids[1:coalesce(list_max(list_transform(range(1, len(ids) + 1), lambda i: case when ids[i] <> 0 then i else 0 end)), 0)] end, ',') as trimmed from p""")
def trim_eos(spark, sf_dir):
    ids = F.concat("full_ids", F.array(F.lit(0), F.lit(0)))
    rows = fx.token_rows(spark, sf_dir).select("doc_id", ids.alias("ids"))
    return rows.select("doc_id", F.array_join(F.transform(tokens.trim_at_end(F.col("ids"), 5, 0), lambda x: x.cast("string")), ",").alias("trimmed"))


@query("length_bucket", "select doc_id, (row_number() over (order by n_chars, doc_id) - 1) // 32 as bucket from documents")
def length_bucket(spark, sf_dir):
    return tokens.length_buckets(fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 32).select("doc_id", "bucket")


@query("longest_k", "select doc_id, n_chars from documents order by n_chars desc, doc_id desc limit 10")
def longest_k(spark, sf_dir):
    return tokens.longest(fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 10)


@query("trimmed_history", f"with {fx.CONVERSATIONS} select conv_id, array_to_string(list_transform(case when len(messages) > 4 then list_concat(messages[1:1], messages[-3:]) else messages end, lambda m: m.role), ',') as roles from convs")
def trimmed_history(spark, sf_dir):
    return fx.conversations(spark, sf_dir).select("conv_id", F.array_join(F.transform(tokens.trimmed_history(F.col("messages"), 4, 3), lambda m: m["role"]), ",").alias("roles"))


@query("agg_group_reward", "with g as (select user_id, coalesce(stddev_samp(case when user_id % 10 = 0 then 1.0::double else value end), 0.0) as s from events group by user_id) select user_id, round(s, 6) as std, s = 0 as zero_std from g")
def group_reward(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events").select("user_id", F.when(F.col("user_id") % 10 == 0, 1.0).otherwise(F.col("value")).alias("reward"))
    return evaluation.group_rewards(rows, "user_id", "reward").withColumn("std", F.round("std", 6))


@query("agg_generation_stats", f"with {fx.GENERATIONS} select variant, round(avg(generated_tokens), 6) as mean_tokens, round(avg(length(text)), 6) as mean_chars, count(*) filter (hit_limit) as limit_hits from generations group by variant")
def generation_stats(spark, sf_dir):
    rows = fx.generations(spark, sf_dir)
    return rows.groupBy("variant").agg(F.round(F.avg("generated_tokens"), 6).alias("mean_tokens"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.count_if("hit_limit").alias("limit_hits"))


@query("generation_limit_ids", f"with {fx.GENERATIONS} select variant, problem_id, row_number() over (partition by variant order by problem_id) - 1 as nth from generations where hit_limit")
def generation_limit_ids(spark, sf_dir):
    """The ids behind `limit_hits`, as rows in order: they may be any number."""
    rows = sampling.positions(fx.generations(spark, sf_dir).filter("hit_limit").select("variant", "problem_id"), ["variant", "problem_id"], "at")
    first = rows.groupBy("variant").agg(F.min("at").alias("first"))
    return rows.join(first, "variant").select("variant", "problem_id", (F.col("at") - F.col("first")).alias("nth"))


_SCORES = "(values " + ", ".join(f"({k}, {fx.literal(d)}, {w!r}::double)" for k, (d, w) in enumerate(fx.DIMENSIONS.items())) + ") dims(k, dimension, weight)"


@query("agg_judge_dims", f"""with {fx.JUDGMENTS}, l as (
    select judge, dimension, weight, "left" as model, ((id + j + k * 3) % 11)::double as score from judgments, {_SCORES}
    union all select judge, dimension, weight, "right", ((id + j + k * 3 + (p + 1)) % 11)::double from judgments, {_SCORES}),
  m as (select coalesce(judge, 'combined') as judge, model, dimension, weight, avg(score) as mean from l group by grouping sets ((judge, model, dimension, weight), (model, dimension, weight)))
  select judge, model, dimension, round(mean, 6) as mean from m union all select judge, model, 'weighted_total', round(sum(mean * weight), 6) from m group by judge, model""")
def judge_dims(spark, sf_dir):
    return evaluation.dimension_means(fx.judgments(spark, sf_dir), fx.DIMENSIONS)


@query("agg_pairwise", f"""with {fx.JUDGMENTS} select pair, count(*) as judgments, count(*) filter (winner_model = "left") as left_wins, count(*) filter (winner_model = "right") as right_wins, count(*) filter (winner_model = 'tie') as ties,
  round(count(*) filter (winner_model = "left") / count(*)::double, 6) as left_rate, round(count(*) filter (winner_model = "right") / count(*)::double, 6) as right_rate, round(count(*) filter (winner_model = 'tie') / count(*)::double, 6) as tie_rate from judgments group by pair""")
def pairwise(spark, sf_dir):
    return evaluation.pairwise(fx.judgments(spark, sf_dir))


@query("agg_disagreement", f"with {fx.JUDGMENTS}, e as (select id, pair, count(distinct winner_model) as w from judgments group by id, pair having count(*) > 1) select count(*) as comparisons, count(*) filter (w > 1) as disagreements, round(avg((w > 1)::integer), 6) as rate from e")
def disagreement(spark, sf_dir):
    return evaluation.disagreement(fx.judgments(spark, sf_dir))


@query("join_judge_pairs", f"with {fx.JUDGMENTS} select a.id, a.pair, a.winner_model as first_winner, b.winner_model as second_winner from judgments a join judgments b on a.id = b.id and a.pair = b.pair where a.j = 0 and b.j = 1 and a.winner_model <> b.winner_model")
def judge_pairs(spark, sf_dir):
    rows = fx.judgments(spark, sf_dir).select("id", "pair", "j", "winner_model")
    a, b = rows.filter("j = 0").select("id", "pair", F.col("winner_model").alias("first_winner")), rows.filter("j = 1").select("id", "pair", F.col("winner_model").alias("second_winner"))
    return a.join(b, ["id", "pair"]).filter("first_winner <> second_winner").select("id", "pair", "first_winner", "second_winner")


@query("blind_order", "select doc_id, lang, row_number() over (partition by lang order by sha256('9:' || lang || ':' || doc_id::varchar), doc_id) <= count(*) over (partition by lang) // 2 as swapped from documents")
def blind_order(spark, sf_dir):
    return evaluation.blind_order(fx.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 9)


@query("agg_counts_contract", "select count(*) as n_rows, count(distinct doc_id) as unique_ids, count(distinct source) as sources, (select count(*) from labels where doc_id not in (select doc_id from documents)) as foreign_labels from documents")
def counts_contract(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    foreign = fx.table(spark, sf_dir, "labels").select("doc_id").join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("foreign_labels"))
    # Two rows of one: joined on a constant.
    own = docs.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc_id").alias("unique_ids"), F.countDistinct("source").alias("sources"))
    return own.withColumn("one", F.lit(1)).join(foreign.withColumn("one", F.lit(1)), "one").drop("one")


@query("reward_combine", """with p as (select doc_id, (doc_id % 3) / 2.0::double as s, least((doc_id % 12) / 10.0::double, 1.0) as r, (doc_id % 21) / 20.0::double as c from documents),
  q as (select doc_id, least(s, 1.0) as s, r, least(c, 1.0) as c, 0.05::double * least(s, 1.0) + 0.7::double * r + 0.25::double * (case when r = 1.0 then 1.0::double else 0.0 end) as code, 0.25::double + 0.75::double * r as gate from p)
  select doc_id, round(0.6::double * code + 0.4::double * (c * gate), 6) as total, round(code, 6) as code_reward, round(c * gate, 6) as gated_contract, round(gate, 6) as contract_gate from q""")
def reward_combine(spark, sf_dir):
    i = F.col("doc_id")
    reward = verify.combined_reward((i % 3) / F.lit(2.0), (i % 12) / F.lit(10.0), (i % 21) / F.lit(20.0))
    return fx.table(spark, sf_dir, "documents").select("doc_id", reward.alias("r")).select("doc_id", "r.total", "r.code_reward", "r.gated_contract", "r.contract_gate")


@query("classify_verdicts", """select doc_id, case doc_id % 8 when 0 then 'passed' when 1 then 'timeout' when 2 then 'interface_mismatch' when 3 then 'unsupported' when 4 then 'wrong_answer' when 5 then 'runtime_error' when 6 then 'runtime_error' else 'interface_mismatch' end as reference_class,
  case doc_id % 8 when 1 then 'timeout' when 2 then 'interface_mismatch' when 3 then 'unsupported' when 5 then 'runtime_error' when 6 then 'docker_unavailable' when 7 then 'interface_mismatch' else 'wrong_answer' end as distilled_class,
  doc_id % 8 = 0 as accepted, doc_id % 8 = 6 or doc_id % 3 <> 1 as recoverable from documents""")
def classify_verdicts(spark, sf_dir):
    cases = [
        {"error": None, "failure": None, "unsupported": False, "mode": "standard_input", "rate": 1.0},
        {"error": "timeout after 5.0s", "failure": None, "unsupported": False, "mode": "standard_input", "rate": 0.0},
        {"error": "no top-level function or Solution.f found", "failure": None, "unsupported": True, "mode": "call_based", "rate": 0.0},
        {"error": "unknown shape", "failure": None, "unsupported": True, "mode": "standard_input", "rate": 0.0},
        {"error": None, "failure": "case #1: got '1', expected '2'", "unsupported": False, "mode": "standard_input", "rate": 0.5},
        {"error": None, "failure": "case #1: ValueError: bad", "unsupported": False, "mode": "standard_input", "rate": 0.5},
        {"error": "error during connect", "failure": None, "unsupported": False, "mode": "standard_input", "rate": 0.0},
        {"error": "Solution has no callable method 'f'", "failure": None, "unsupported": True, "mode": "call_based", "rate": 0.0},
    ]
    rows = fx.by_case(spark, sf_dir, cases)
    c = F.col
    return rows.select(
        "doc_id",
        verify.classify_reference(c("error"), c("failure"), c("unsupported"), c("mode"), c("rate")).alias("reference_class"),
        verify.classify_distilled(c("error"), c("failure"), c("unsupported")).alias("distilled_class"),
        verify.accepted(c("unsupported"), c("error"), F.lit(2), c("rate")).alias("accepted"),
        verify.recoverable(F.lit("wrong_answer"), c("error"), c("failure"), c("doc_id") % 3 != 0, F.when(c("doc_id") % 3 == 1, 2).otherwise(1)).alias("recoverable"),
    )


@query("select_eval", "select doc_id from labels where quality = 1 and doc_id not in (select doc_id from documents where lang = 'es') order by sha256('42:eval:' || doc_id::varchar), doc_id limit 50")
def select_eval(spark, sf_dir):
    known = fx.table(spark, sf_dir, "documents").filter("lang <> 'es'").select("doc_id")
    return sampling.take(fx.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").join(known, "doc_id", "left_semi"), 50, "doc_id", 42, "eval")


@query("discover_variants", f"with {fx.GENERATIONS} select distinct variant from generations")
def discover_variants(spark, sf_dir):
    return fx.generations(spark, sf_dir).select("variant").distinct()
