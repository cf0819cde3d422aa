"""Queries on joins, duplicates, samples, splits and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import strip_html
from ..operators import dedup, freeze, overlap, sampling
from ..operators.candidates import seed_categories
from ..sources import tables
from ..streaming import resume
from . import fixtures as fx
from .registry import query

L = "long"


@query("src_provenance", "select doc_id, row_number() over () - 1 as row_in_file, row_number() over () - 1 as global_index from documents")
def provenance(spark, sf_dir):
    """Place in the file and over all files; each table is one file, also where it is a folder of parts, read in its order."""
    rows = tables.with_provenance(fx.table(spark, sf_dir, "documents"), F.lit(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.col("row_in_file").cast(L).alias("row_in_file"), F.col("global_index").cast(L).alias("global_index"))


@query("src_column_pruned", "select doc_id, n_chars from documents where doc_id in (select doc_id from labels where toxic = 1)")
def column_pruned(spark, sf_dir):
    wanted = fx.table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(wanted, "doc_id", "left_semi")


@query("src_point_lookup", "select doc_id, source, n_chars from documents where doc_id = 7")
def point_lookup(spark, sf_dir):
    return tables.point_lookup(fx.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id", 7)


@query("src_code_contests", r"""select md5(d) as description_md5, page_id % 5 as difficulty, case when page_id % 4 = 0 then null else 'p' || page_id::varchar end as solution from
  (select page_id, regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '^\s+|\s+$', '', 'g') as d from pages)
  where page_id % 5 in (2, 3) and length(d) >= 80""")
def code_contests(spark, sf_dir):
    code = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    solutions = F.struct(F.array(F.lit(2), F.when(F.col("page_id") % 4 == 0, 1).otherwise(3)).alias("language"), F.array(F.lit("c"), code).alias("solution"))
    rows = fx.table(spark, sf_dir, "pages").select(F.col("html").alias("description"), (F.col("page_id") % 5).alias("difficulty"), solutions.alias("solutions"), F.lit(None).cast("string").alias("public_tests"))
    return tables.code_contests(rows).select(F.md5("description").alias("description_md5"), "difficulty", "solution")


@query("src_canonical", "select 'd' || doc_id::varchar as id, source from documents")
def canonical(spark, sf_dir):
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    rows = fx.table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, key).alias("id"), key.alias("problem_id"), "source")
    return tables.canonical(rows).select("id", "source")


@query("sink_id_file", """select lang as split, '{"schema_version":1,"seed":7,"parent":"documents","count":' || count(*)::varchar || ',"ids":["' || array_to_string(list(doc_id::varchar order by doc_id), '","') || '"]}' as value from documents group by lang""")
def id_file(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("split"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"))
    return tables.id_file(rows, 7, "documents")


# Duplicates.


@query("dedup_prefix200", "select doc_id from documents qualify row_number() over (partition by substr(text, 1, 200) order by doc_id) = 1")
def dedup_prefix(spark, sf_dir):
    return dedup.first_by_prefix(fx.table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 200).alias("text")), "text", "doc_id").select("doc_id")


@query("dedup_exact", "select min(doc_id) as doc_id, count(*) as copies from documents group by text")
def dedup_exact(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return rows.select("doc_id", "copies")


@query("dedup_id_first", "select user_id, min(event_id) as event_id, arg_min(event_type, event_id) as event_type from events group by user_id")
def dedup_id_first(spark, sf_dir):
    return dedup.first_per(fx.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), F.col("user_id"), "event_id")


@query("dedup_counts", "select sum(n - 1)::bigint as ignored_rows, count(*) filter (n > 1) as keys_with_duplicates from (select count(*) as n from events group by user_id)")
def dedup_counts(spark, sf_dir):
    return dedup.duplicate_counts(fx.table(spark, sf_dir, "events"), "user_id")


@query("latest_wins", "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id")
def latest_wins(spark, sf_dir):
    return dedup.latest(fx.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("conflict_report", "select user_id, count(*) as n_rows from events group by user_id having count(*) > 1")
def conflict_report(spark, sf_dir):
    return dedup.conflicts(fx.table(spark, sf_dir, "events"), "user_id")


@query("order_recovery_first", "select doc_id, row_number() over (order by coalesce(toxic, 0) = 0, doc_id) - 1 as ord from documents left join labels using (doc_id)")
def recovery_first(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select("doc_id").join(fx.table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return sampling.positions(rows, [(F.coalesce("toxic", F.lit(0)) == 0).alias("later"), F.col("doc_id")]).select("doc_id", "ord")


@query("streak_collapse", """with f as (select event_id, user_id, value > 10 as flag from events),
  i as (select *, sum(case when flag then 0 else 1 end) over (partition by user_id order by event_id) as island from f)
  select event_id, (case when flag then sum(flag::integer) over (partition by user_id, island order by event_id) else 0 end)::bigint as streak from i""")
def streaks(spark, sf_dir):
    return dedup.islands(fx.table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "event_id", F.col("value") > 10, ["user_id"]).select("event_id", "streak")


_ATTEMPTS = "attempts as (select doc_id, r::bigint as rank, ((doc_id * 3 + r * 5) % 11) / 10.0::double as rate from documents, (values (0), (1), (2), (3)) t(r))"


def attempts(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*(F.lit(r).cast(L) for r in range(4)))).alias("rank"))
    return rows.withColumn("rate", ((F.col("doc_id") * 3 + F.col("rank") * 5) % 11) / F.lit(10.0))


@query("first_passing", f"with {_ATTEMPTS} select doc_id, min(rank) filter (rate >= 1.0) as selected_rank, coalesce(min(rank) filter (rate >= 1.0) + 1, count(*)) as attempted from attempts group by doc_id")
def first_passing(spark, sf_dir):
    return dedup.first_passing(attempts(spark, sf_dir), "doc_id", "rank", "rate")


@query("best_failed", f"with {_ATTEMPTS} select doc_id, rank as best_rank, rate as best_rate from attempts qualify row_number() over (partition by doc_id order by rate desc, rank) = 1")
def best_failed(spark, sf_dir):
    return dedup.best_failed(attempts(spark, sf_dir), "doc_id", "rank", "rate")


# Joins.


@query("join_ref_cache", "select d.doc_id, l.quality is not null as cached, coalesce(l.quality = 1, false) as verified, case when l.quality = 1 then 'accepted' when l.quality = 0 then 'rejected' else 'pending' end as state from documents d left join labels l on d.doc_id = l.doc_id")
def ref_cache(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select("doc_id").join(fx.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    ok = F.coalesce(F.col("quality") == 1, F.lit(False))
    return rows.select("doc_id", F.col("quality").isNotNull().alias("cached"), ok.alias("verified"), F.when(ok, "accepted").when(F.col("quality") == 0, "rejected").otherwise("pending").alias("state"))


@query("join_selected_candidate", f"with {_ATTEMPTS}, s as (select doc_id, min(rank) filter (rate >= 1.0) as rank from attempts group by doc_id) select a.doc_id, a.rank, a.rate from attempts a join s using (doc_id, rank)")
def selected_candidate(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    chosen = dedup.first_passing(rows, "doc_id", "rank", "rate").filter("selected_rank is not null").select("doc_id", F.col("selected_rank").alias("rank"))
    return rows.join(chosen, ["doc_id", "rank"]).select("doc_id", "rank", "rate")


@query("join_source_bank", "select d.doc_id, d.source, l.toxic is not null as accepted from documents d left join (select * from labels where quality = 1) l on d.doc_id = l.doc_id where d.doc_id in (select doc_id from labels)")
def source_bank(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "labels")
    verified = fx.table(spark, sf_dir, "documents").select("doc_id", "source").join(labels.select("doc_id"), "doc_id", "left_semi")
    won = labels.filter("quality = 1").select("doc_id", F.lit(True).alias("accepted"))
    return verified.join(won, "doc_id", "left").select("doc_id", "source", F.coalesce("accepted", F.lit(False)).alias("accepted"))


@query("join_backfill", """select l.doc_id, coalesce(nullif(case when l.doc_id % 3 = 0 then '' when l.doc_id % 3 = 1 then null else 'own' end, ''), d.source) as source,
  l.doc_id % 3 < 2 as was_filled from labels l join documents d on l.doc_id = d.doc_id""")
def backfill(spark, sf_dir):
    own = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 2, "own")
    rows = fx.table(spark, sf_dir, "labels").select("doc_id", own.alias("own")).join(fx.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("s")), "doc_id")
    return rows.select("doc_id", freeze.filled(F.col("own"), F.col("s")).alias("source"), freeze.was_filled(F.col("own"), F.col("s")).alias("was_filled"))


@query("join_missing_source", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def missing_source(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id").join(fx.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("join_accept_reject_overlap", "select doc_id from labels where quality = 1 and doc_id in (select doc_id from labels where toxic = 1)")
def accept_reject(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "labels")
    return labels.filter("quality = 1").select("doc_id").join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("join_resume", "select event_id from events where user_id not in (select user_id from events where event_type = 'purchase' and value > 60)")
def join_resume(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    return resume.pending(events.select("event_id", "user_id"), events.filter("event_type = 'purchase' and value > 60"), "user_id").select("event_id")


@query("rejected_store", """with r as (select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events where event_type <> 'purchase' group by user_id)
  select * from r where user_id not in (select user_id from events where event_type = 'purchase' and value > 60)""")
def rejected_store(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return resume.unresolved(events.filter("event_type <> 'purchase'").drop("value"), events.filter("event_type = 'purchase' and value > 60"), "user_id", "event_id")


@query("join_split_materialize", "select row_number() over (order by sha256(doc_id::varchar)) - 1 as ord, doc_id, source from documents")
def split_materialize(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    ids = sampling.positions(docs.select("doc_id"), [F.sha2(F.col("doc_id").cast("string"), 256).alias("h")])
    return ids.join(docs.select("doc_id", "source"), "doc_id").select("ord", "doc_id", "source")


@query("join_overlap_contains", "select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)")
def overlap_contains(spark, sf_dir):
    return overlap.contained(fx.table(spark, sf_dir, "documents"), "doc_id", "text", fx.table(spark, sf_dir, "benchmark"), "item_id", "text")


#: Categories of seeds by tag.
ALIASES = {
    "arrays": "array", "array": "array", "strings": "string", "string": "string", "hashing": "hash", "hash table": "hash", "hash": "hash",
    "greedy algorithms": "greedy", "greedy": "greedy", "graphs": "graph", "graph": "graph", "dynamic programming": "dp", "dp": "dp",
    "depth-first search": "dfs_bfs", "breadth-first search": "dfs_bfs", "dfs": "dfs_bfs", "bfs": "dfs_bfs",
    "binary search": "binary_search", "two pointers": "two_pointers", "backtracking": "backtracking",
}


@query("seed_categories", """select doc_id, case doc_id % 4 when 0 then 'array,dp' when 1 then 'dfs_bfs' when 2 then '' else 'hash,string' end as categories from documents""")
def categories(spark, sf_dir):
    return _tagged(spark, sf_dir).select("doc_id", F.array_join("categories", ",").alias("categories"))


def _tagged(spark, sf_dir):
    tags = F.array(*(F.array(*map(F.lit, x)) for x in ((" Arrays", "array", "DP"), ("BFS", "Depth-First Search"), ("geometry",), ("Hash Table", "number theory", "strings"))))
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", F.get(tags, (F.col("doc_id") % 4).cast("int")).alias("tags"))
    return rows.select("doc_id", seed_categories(F.col("tags"), ALIASES).alias("categories"))


@query("join_seed_by_tag", """with t(k, category) as (values (0, 'array'), (0, 'dp'), (1, 'dfs_bfs'), (3, 'hash'), (3, 'string')), s as (select item_id as seed_id, case item_id % 3 when 0 then 'dp' when 1 then 'hash' else 'graph' end as category from benchmark)
  select doc_id, category, seed_id from documents join t on doc_id % 4 = k join s using (category)""")
def seed_by_tag(spark, sf_dir):
    seeds = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seed_id"), F.get(F.array(F.lit("dp"), F.lit("hash"), F.lit("graph")), (F.col("item_id") % 3).cast("int")).alias("category"))
    return _tagged(spark, sf_dir).select("doc_id", F.explode("categories").alias("category")).join(seeds, "category").select("doc_id", "category", "seed_id")


# Samples and splits.


@query("stable_order", "select doc_id, row_number() over (order by sha256('42:base:' || doc_id::varchar)) - 1 as ord from documents")
def stable_order(spark, sf_dir):
    return sampling.positions(fx.table(spark, sf_dir, "documents").select("doc_id"), [sampling.hash_order(42, "base", F.col("doc_id")).alias("h")])


def _strata_sql(source: str, take: str, salt: str, name: str) -> str:
    """CTEs that take a stratified sample (doc_id, h) called `name` of a CTE with doc_id, lang, source."""
    return f"""{name}_k as (select *, '(''' || lang || ''', ''' || source || ''')' as stratum from {source}),
  {name}_n as (select stratum, count(*) as n from {name}_k group by stratum),
  {name}_q as (select stratum, n * {take} / sum(n) over ()::double as share from {name}_n),
  {name}_b as (select stratum, share, floor(share) as base from {name}_q),
  {name}_r as (select stratum, (base + case when row_number() over (order by share - base desc, stratum) <= {take} - sum(base) over () then 1 else 0 end)::bigint as quota from {name}_b),
  {name} as (select doc_id, lang, source, sha256('42:{salt}:' || doc_id::varchar) as h from (select k.*, quota, row_number() over (partition by stratum order by sha256('42:{salt}:' || stratum || ':' || doc_id::varchar)) as r from {name}_k k join {name}_r using (stratum)) where r <= quota)"""


@query("stratified_quotas", f"with {_strata_sql('documents', '50', 'x', 's')} select stratum, quota from s_r")
def stratified_quotas(spark, sf_dir):
    return sampling.quotas(fx.table(spark, sf_dir, "documents"), ["lang", "source"], 50)


@query("stratified_take", f"with {_strata_sql('documents', '50', 'dev', 's')} select doc_id, h as order_hash from s")
def stratified_take(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return sampling.stratified_take(rows, "doc_id", ["lang", "source"], 50, 42, "dev").select("doc_id", "order_hash")


_DEV = "(select round_even(count(*) * 0.05, 0)::bigint from documents)"
_SPLITS = f"""docs as (select doc_id, lang, source from documents), {_strata_sql('docs', _DEV, 'sft_dev', 'dev')},
  train as (select * from docs where doc_id not in (select doc_id from dev)),
  {_strata_sql('train', f'least(900, (select count(*) from train))', 'grpo_train', 'gt')},
  devs as (select doc_id, lang, source from dev),
  {_strata_sql('devs', 'least(100, (select count(*) from dev))', 'grpo_validation', 'gv')},
  splits as (select 'sft_train' as split, doc_id as id, sha256('42:sft_train:' || doc_id::varchar) as order_hash from train
    union all select 'sft_dev', doc_id, h from dev union all select 'grpo_train', doc_id, h from gt union all select 'grpo_validation', doc_id, h from gv)"""


def _splits(spark, sf_dir):
    return sampling.build_splits(fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"], 42)


@query("build_splits", f"with {_SPLITS} select * from splits")
def build_splits(spark, sf_dir):
    return _splits(spark, sf_dir)


@query("set_split_disjoint", f"""with {_SPLITS} select
  (select count(*) from (select id from splits where split = 'sft_train' intersect select id from splits where split = 'sft_dev')) as train_dev,
  (select count(*) from (select id from splits where split = 'grpo_train' intersect select id from splits where split = 'sft_dev')) as grpo_dev,
  (select count(*) from (select doc_id from documents except select id from splits)) as uncovered,
  (select count(*) from (select id from splits where split = 'grpo_train' except select id from splits where split = 'sft_train')) as grpo_outside""")
def split_disjoint(spark, sf_dir):
    # One pass: which splits each id is in.
    ids = _splits(spark, sf_dir).groupBy("id").agg(F.collect_set("split").alias("s"))
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(True).alias("doc"))
    has = lambda x: F.coalesce(F.array_contains("s", x), F.lit(False))
    return ids.join(docs, "id", "full").agg(
        F.count_if(has("sft_train") & has("sft_dev")).alias("train_dev"), F.count_if(has("grpo_train") & has("sft_dev")).alias("grpo_dev"),
        F.count_if(F.col("s").isNull()).alias("uncovered"), F.count_if(has("grpo_train") & ~has("sft_train")).alias("grpo_outside"),
    )


@query("sample_by_difficulty", """with w as (values ('fr', 5, 0), ('en', 12, 1), ('de', 7, 2)), r as (select doc_id, lang, row_number() over (partition by lang order by sha256('42:' || lang || ':' || doc_id::varchar), doc_id) as n from documents)
  select doc_id, lang, col2::integer as bucket_order from r join w on lang = col0 where n <= col1""")
def by_difficulty(spark, sf_dir):
    return sampling.take_per_bucket(fx.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"fr": 5, "en": 12, "de": 7}, "doc_id", 42)


@query("sample_simple", "select doc_id from documents order by sha256('42:sample:' || doc_id::varchar), doc_id limit 25")
def sample_simple(spark, sf_dir):
    return sampling.take(fx.table(spark, sf_dir, "documents").select("doc_id"), 25, "doc_id", 42)


@query("curriculum", "with r as (select doc_id, row_number() over (order by doc_id) - 1 as n from documents) select doc_id, case when n < 60 then 0 when n < 90 then 1 else 2 end as stage_order from r where n < 100")
def curriculum(spark, sf_dir):
    """Stages of 60, 30 and 10 documents: counts stated beforehand, which the table must have."""
    rows = sampling.positions(fx.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], "n").filter("n < 100")
    staged = rows.withColumn("stage", F.when(F.col("n") < 60, "easy").when(F.col("n") < 90, "medium").otherwise("hard"))
    return sampling.curriculum(staged, "stage", {"easy": 60, "medium": 30, "hard": 10}).select("doc_id", "stage_order")


@query("heldout_tests", """select doc_id, i::bigint as case_index, row_number() over (partition by doc_id order by sha256('42:' || doc_id::varchar || ':' || i::varchar)) > ceil(0.7::double * (doc_id % 6 + 1)) as held_out
  from documents, generate_series(0, 5) g(i) where i <= doc_id % 6""")
def heldout_tests(spark, sf_dir):
    from pyspark.sql import Window

    cases = fx.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast(L), F.col("doc_id") % 6)).alias("case_index"))
    inside = Window.partitionBy("doc_id")
    order = sampling.hash_order(42, F.col("doc_id").cast("string"), F.col("case_index"))
    rank, n = F.row_number().over(inside.orderBy(order)), F.count(F.lit(1)).over(inside)
    return cases.select("doc_id", "case_index", (rank > F.ceil(F.lit(0.7) * n)).alias("held_out"))


@query("length_exclude", "select doc_id from documents where n_chars <= 8192")
def length_exclude(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.join(docs.filter("n_chars > 8192").select("doc_id"), "doc_id", "left_anti").select("doc_id")


# Sets.


@query("set_pairwise_disjoint", "select (select count(*) from (select user_id from events where event_type = 'click' intersect select user_id from events where event_type = 'view')) as a_b, (select count(*) from (select user_id from events where event_type = 'click' intersect select user_id from events where event_type = 'error')) as a_c, (select count(*) from (select user_id from events where event_type = 'view' intersect select user_id from events where event_type = 'error')) as b_c")
def pairwise_disjoint(spark, sf_dir):
    kinds = fx.table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    both = lambda a, b: F.count_if(F.array_contains("s", a) & F.array_contains("s", b))
    return kinds.agg(both("click", "view").alias("a_b"), both("click", "error").alias("a_c"), both("view", "error").alias("b_c"))


@query("set_overlap_audit", "select count(*) as test_rows, count(distinct user_id) as unique_ids, count(distinct user_id) filter (user_id in (select doc_id from documents)) as overlap from events where event_type = 'signup'")
def overlap_audit(spark, sf_dir):
    tests = fx.table(spark, sf_dir, "events").filter("event_type = 'signup'")
    known = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), F.lit(1).alias("known"))
    per = tests.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).join(known, "user_id", "left")
    return per.agg(F.sum("n").alias("test_rows"), F.count(F.lit(1)).alias("unique_ids"), F.count("known").alias("overlap"))


@query("set_complete", "select doc_id, 'missing' as status from documents where doc_id not in (select doc_id from labels) and doc_id % 2 = 0 union all select doc_id, 'extra' from labels where doc_id % 2 = 1")
def set_complete(spark, sf_dir):
    from ..operators.evaluation import incomplete

    return incomplete(fx.table(spark, sf_dir, "labels").select("doc_id"), fx.table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id"), "doc_id")


@query("set_union_done", "select distinct user_id from events where event_type in ('click', 'purchase')")
def union_done(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    return resume.done_ids(events.filter("event_type = 'click'"), events.filter("event_type = 'purchase'"), key="user_id")


@query("set_union_sources", """with u as (select 0 as o, page_id as k, html as text from pages union all select 1, doc_id, text from documents),
  f as (select * from u qualify row_number() over (partition by md5(text) order by o, k) = 1) select o, k from f order by o, k limit 600""")
def union_sources(spark, sf_dir):
    """Sources in order, duplicates out, then the quota: the feature is the cap of the union."""
    pages = fx.table(spark, sf_dir, "pages").select(F.lit(0).alias("o"), F.col("page_id").alias("k"), F.md5("html").alias("h"))
    docs = fx.table(spark, sf_dir, "documents").select(F.lit(1).alias("o"), F.col("doc_id").alias("k"), F.md5("text").alias("h"))
    rows = pages.unionByName(docs).groupBy("h").agg(F.min(F.struct("o", "k")).alias("x")).select("x.*")
    return rows.orderBy("o", "k").limit(600)


@query("fatal_collect", f"""with {fx.COMPLETIONS} select doc_id, case when doc_id % 17 = 0 then 'accepted_rejected_overlap' when doc_id % 13 = 0 then 'invalid_chatml_roles'
  when doc_id % 7 = 0 then 'missing_python_code_block' when doc_id % 19 = 0 then 'syntax_error' when (length(text) - length(replace(text, '```', ''))) / 3 % 2 = 1 then 'obvious_truncation'
  when contains(lower(text), 'reference_solution') then 'reference_leak_marker' when doc_id % 11 < 2 then 'missing_final_execution_evidence' when doc_id % 23 = 0 then 'missing_source_bank_record'
  when doc_id % 2 = 0 and doc_id % 5 <> 0 then 'call_based_fn_name_mismatch' end as reason from completions""")
def fatal_collect(spark, sf_dir):
    i = F.col("doc_id")
    roles = F.when(i % 13 == 0, F.array(F.lit("user"), F.lit("assistant"))).otherwise(F.array(F.lit("system"), F.lit("user"), F.lit("assistant")))
    reason = freeze.fatal_reason(
        i % 17 == 0, roles, F.when(i % 7 == 0, "").otherwise("x = 1"), i % 19 != 0, F.col("text"), F.col("text"), F.when(i % 11 == 0, 0.5).otherwise(1.0), i % 11 != 1, i % 23 != 0,
        F.when(i % 2 == 0, "call_based").otherwise("standard_input"), F.lit("solve"), F.when(i % 5 == 0, F.array(F.lit("solve"))).otherwise(F.array(F.lit("other"))),
    )
    return fx.completions(spark, sf_dir).select("doc_id", reason.alias("reason"))


@query("code_source_label", "select doc_id, case when doc_id % 3 = 0 then 'reference_locked' else 'pedagogical_rewrite' end as label_strategy, case when doc_id % 5 = 0 then 'given' when doc_id % 3 = 0 then 'verified_reference_with_comments' else 'teacher_generated_docker_verified' end as code_source from documents")
def code_source(spark, sf_dir):
    strategy = freeze.label_strategy(F.when(F.col("doc_id") % 3 == 0, "reference_locked").otherwise(""))
    return fx.table(spark, sf_dir, "documents").select("doc_id", strategy.alias("label_strategy"), freeze.code_source(F.when(F.col("doc_id") % 5 == 0, "given"), strategy).alias("code_source"))


@query("io_token_warning", rf"with {fx.COMPLETIONS} select count(*) filter (not regexp_matches(text, '\b(input|print)\s*\(|sys\.(stdin|stdout)|os\.(read|write)')) as warnings from completions")
def io_token_warning(spark, sf_dir):
    return fx.completions(spark, sf_dir).agg(F.count_if(~F.col("text").rlike(freeze.IO_TOKENS)).alias("warnings"))


@query("strip_html_total", r"select count(*) as pages, sum(length(regexp_replace(html, '<[^>]+>', '', 'g')))::bigint as text_chars from pages")
def strip_html_total(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "pages").select(F.length(F.regexp_replace("html", "<[^>]+>", "")).alias("n"), strip_html(F.col("html")).alias("x"))
    return rows.agg(F.count("x").alias("pages"), F.sum("n").alias("text_chars"))
