"""Retrieval quality and agreement between repeated answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import evaluation as E
from attestor.sources.tables import table

from . import corpus

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _cases(spark, d):
    """Each benchmark passage is a case that expects its own text in the evidence; evidence is its BM25 result."""
    q = corpus.questions(spark, d)
    expectations = q.select(F.col("query_id").alias("case_id"), F.lit(0).alias("expectation_id"), F.lit(None).cast("string").alias("document_id"), F.array("question").alias("fragments"))
    hits = corpus.lexical_hits(spark, d, 10).join(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id")
    evidence = hits.select(F.col("query_id").alias("case_id"), "rank", F.col("source").alias("document_id"), "text", "doc_id")
    return q.select(F.col("query_id").alias("case_id")), expectations, evidence, E.expectation_matches(expectations, evidence)


_CLEAN = r"replace(lower(trim(regexp_replace({}, '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'))), 'ß', 'ss')"
CASES_SQL = f"""{corpus.BM25_SQL}, e as (select query_id as case_id, rank, doc_id, {_CLEAN.format("d.text")} as t from bm25 join documents d using (doc_id) where rank <= 10),
    matches as materialized (select case_id, e.rank from e join benchmark b on b.item_id = e.case_id where contains(e.t, {_CLEAN.format("b.text")}))"""


@query("expectation_matches", f"with {CASES_SQL} select case_id, rank from matches")
def _(spark, d):
    return _cases(spark, d)[3].select("case_id", F.col("rank").cast("long").alias("rank"))


@query("recall_at_k", f"with {CASES_SQL} select item_id as case_id, case when exists (select 1 from matches m where m.case_id = item_id and m.rank <= 5) then 1.0::double else 0.0::double end as value from benchmark")
def _(spark, d):
    _, expectations, _, matches = _cases(spark, d)
    return E.recall_at_k(expectations, matches, 5)


@query("mrr", f"with {CASES_SQL} select item_id as case_id, round(coalesce(1.0 / (select min(rank) from matches m where m.case_id = item_id), 0)::double, 6) as value from benchmark")
def _(spark, d):
    cases, _, _, matches = _cases(spark, d)
    return E.reciprocal_rank(cases, matches).select("case_id", F.round("value", 6).alias("value"))


@query("citation_hit_rate", f"with {CASES_SQL} select item_id as case_id, round(coalesce((select count(*) from matches m where m.case_id = item_id and m.rank in (1, 2, 3)) / nullif((select count(*) from bm25 where query_id = item_id and rank <= 3), 0)::double, 0), 6) as value from benchmark")
def _(spark, d):
    cases, _, evidence, matches = _cases(spark, d)
    return E.citation_hit_rate(cases, evidence.where("rank <= 3").select("case_id", "rank"), matches).select("case_id", F.round("value", 6).alias("value"))


@query("mean_metric", f"with {CASES_SQL} select round(avg(1.0 / r), 6)::double as value, 'computed' as status, count(*) as n from (select case_id, min(rank) as r from matches group by 1)")
def _(spark, d):
    cases, _, _, matches = _cases(spark, d)
    found = E.reciprocal_rank(matches.select("case_id").distinct(), matches)
    return E.mean_metric(E.with_status(cases, found)).select(F.round("value", 6).alias("value"), "status", "n")


def _attempts(spark, d):
    """Assistant turns are repeated attempts at the case that their conversation is."""
    c = table(spark, d, "conversations").where("role = 'assistant'")
    return c.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("attempt"), F.col("text").alias("answer"), F.when(F.col("turn") % 4 == 1, "answer").otherwise("no_answer").alias("outcome"), F.when(F.col("turn") % 7 == 5, "failed").otherwise("succeeded").alias("status"))


_ATTEMPTS_SQL = "attempts as (select conv_id as case_id, turn as attempt, text as answer, case when turn % 4 = 1 then 'answer' else 'no_answer' end as outcome, case when turn % 7 = 5 then 'failed' else 'succeeded' end as status from conversations where role = 'assistant')"
_PAIRS_SQL = "with {}, s as (select {} as s from attempts a join attempts b on a.case_id = b.case_id and a.attempt < b.attempt union all select 1.0 from (select case_id from attempts group by 1 having count(*) = 1)) select round(avg(s), 6)::double as value, count(*) as n from s"


@query("stability_exact", _PAIRS_SQL.format(_ATTEMPTS_SQL, "case when a.outcome is not distinct from b.outcome then 1.0 else 0.0 end"))
def _(spark, d):
    return E.exact_agreement(_attempts(spark, d), "outcome").select(F.round("value", 6).alias("value"), "n")


_SET = r"list_distinct(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+'))"


@query("stability_jaccard", _PAIRS_SQL.format(_ATTEMPTS_SQL, f"case when len({_SET.format('a.answer')}) + len({_SET.format('b.answer')}) = 0 then 1.0 else len(list_intersect({_SET.format('a.answer')}, {_SET.format('b.answer')})) / len(list_distinct(list_concat({_SET.format('a.answer')}, {_SET.format('b.answer')})))::double end"))
def _(spark, d):
    a = _attempts(spark, d).withColumn("tokens", F.array_distinct(T.words(F.col("answer"))))
    return E.jaccard_agreement(a, "tokens").select(F.round("value", 6).alias("value"), "n")


@query("success_rate", f"with {_ATTEMPTS_SQL} select round(avg(case when status = 'succeeded' then 1.0 else 0.0 end), 6)::double as value, count(*) as n from attempts")
def _(spark, d):
    return E.success_rate(_attempts(spark, d)).select(F.round("value", 6).alias("value"), "n")


@query("stage_rates", "select event_type as stage, count(*) as n, round(avg(case when user_id % 3 = 0 then 1.0 else 0.0 end), 6)::double as repair_rate, round(avg(case when event_id % 10 = 0 then 1.0 else 0.0 end), 6)::double as fallback_rate from events group by 1")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.when(F.col("event_id") % 10 == 0, "fallback").otherwise("primary_valid").alias("outcome"), (F.col("user_id") % 3 == 0).alias("repaired"))
    return E.stage_rates(e).select("stage", "n", F.round("repair_rate", 6).alias("repair_rate"), F.round("fallback_rate", 6).alias("fallback_rate"))


@query("normal_answers", "select conv_id, turn, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\\s]+', ' ', 'g'))) as answer_hash from conversations where role = 'assistant'")
def _(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    return E.normal_answer(c, "text").select("conv_id", "turn", F.sha2("normal", 256).alias("answer_hash"))


@query("journey_summary", """with e as (select user_id as case_id, event_id as attempt, event_type as kind, lag(event_type) over (partition by user_id order by event_id) as before from events),
    k as (select case_id, kind, count(*) as c, min(attempt) as f from e group by all), m as (select case_id, kind from (select *, row_number() over (partition by case_id order by c desc, f) as r from k) where r = 1)
    select case_id, count(*) as n_attempts, count(*) - 1 as n_retries, count(*) filter (before is not null and before <> e.kind) as n_changes, any_value(m.kind) as main_kind from e join m using (case_id) group by case_id""")
def _(spark, d):
    return E.journey(table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("attempt"), F.col("event_type").alias("kind")))


@query("activity_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean_value from events group by all")
def _(spark, d):
    from attestor.streaming.ingest import activity

    return activity(table(spark, d, "events")).withColumn("mean_value", F.round("mean_value", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))
