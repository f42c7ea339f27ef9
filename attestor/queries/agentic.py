"""The whole way from questions to answers, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.plans import agent
from attestor.plans.pipelines import Limits

from . import corpus, evidence, planning, retrieval, scoped

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def answered(spark, d) -> agent.Answers:
    """Two needs of each question, by hybrid retrieval inside the questions' scopes, in two attempts at most; kept for the queries of this part."""
    way = agent.Agent(limits=Limits(top_k=5, attempts=2), strategies=("hybrid",))
    return corpus.kept(spark, d, "answers", lambda: agent.answer(planning.engine(spark, d), corpus.questions(spark, d), way, evidence._needs(spark, d), scoped.question_scopes(spark, d)))


_NEEDS = """halves as (select item_id, string_split(text, ' ') as w, cast(ceil(len(string_split(text, ' ')) / 2.0) as int) as h from benchmark),
    needs as materialized (select item_id * 10 + 1 as item_id, array_to_string(w[:h], ' ') as text, true as required from halves union all select item_id * 10 + 2, array_to_string(w[h + 1:], ' '), item_id % 2 = 0 from halves)"""


def _graded(round_: int) -> str:
    return f"""valid{round_} as materialized (select f.query_id, f.doc_id, f.rank as position, {scoped._VALID} as valid from found{round_} f join scopes using (query_id) join versions using (doc_id) {"where f.query_id in (select query_id from open2)" if round_ == 2 else ""}),
    graded{round_} as materialized (select v.query_id, v.doc_id, {round_} as round, position, case when len(n.terms) = 0 then 0 else len(list_intersect(n.terms, t.terms)) / len(n.terms)::double end as score
        from valid{round_} v join need_terms n using (query_id) join text_terms t using (doc_id) where valid)"""


AGENT_SQL = f"""{_NEEDS}, {corpus.BM25_SQL.replace("from benchmark", "from needs")}, {retrieval.DENSE_SQL.replace("from benchmark", "from needs")}, {corpus.VERSIONS_SQL},
    {scoped.SCOPES_SQL.replace("scopes as", "question_scopes as", 1)}, scopes as materialized (select n.item_id as query_id, q.* exclude (query_id) from needs n join question_scopes q on q.query_id = n.item_id // 10),
    {scoped.constrained_sql(5, 20, "1")}, {scoped.constrained_sql(10, 40, "2")},
    need_terms as materialized (select item_id as query_id, {evidence._TERMS.format("text")} as terms from needs),
    text_terms as materialized (select doc_id, {evidence._TERMS.format("text")} as terms from documents),
    {_graded(1)}, open2 as materialized (select item_id as query_id from needs where item_id not in (select query_id from graded1 where score >= 0.6)), {_graded(2)},
    links as materialized (select query_id, doc_id, min(round) as round, arg_min(position, round) as position, max(score) as score from (select * from graded1 union all select * from graded2) where score >= 0.35 group by all),
    places as materialized (select question, doc_id, row_number() over (partition by question order by first, cast(doc_id as varchar)) as rank
        from (select query_id // 10 as question, doc_id, min((round, query_id % 10, position)) as first from links group by all)),
    held as materialized (select query_id // 10 as question, query_id as need, l.doc_id, l.score, p.rank from links l join places p on p.question = l.query_id // 10 and p.doc_id = l.doc_id),
    need_grades as materialized (select item_id // 10 as question, item_id as need, required, coalesce(max(score), 0) as coverage, case when max(score) is null then 'missing' when max(score) >= 0.6 then 'supported' else 'partial' end as status
        from needs left join held on need = item_id group by all),
    reports as materialized (select question, coalesce(avg(coverage) filter (required), 1) as coverage, coalesce(n, 0) as n_relevant,
        case when coalesce(n, 0) = 0 then 'missing' when count(*) filter (required) > 0 and count(*) filter (required and status <> 'supported') = 0 then 'sufficient' else 'weak' end as status
        from need_grades left join (select question, count(*) as n from places group by 1) using (question) group by question, n),
    checks as materialized (select query_id, round, count(*) as n, count(*) filter (valid) as m from (select query_id, valid, 1 as round from valid1 union all select query_id, valid, 2 from valid2) group by all),
    usable as (select question, count(*) as n_evidence from places join documents using (doc_id) where trim(text, ' ') <> '' group by 1),
    outcomes as materialized (select r.question, r.status, r.coverage, coalesce(n_evidence, 0) as n_evidence,
        case when q.kind <> 0 and coalesce(m, 0) = 0 then 'blocked_constraint_no_match' when r.status = 'missing' then 'blocked_insufficient_evidence' when coalesce(n_evidence, 0) = 0 then 'blocked_no_evidence' when r.status = 'weak' then 'partial' else 'complete' end as outcome
        from reports r join question_scopes q on q.query_id = r.question left join (select query_id // 10 as question, max(m) as m from checks group by 1) c using (question) left join usable using (question)),
    tries as (select item_id // 10 as question, sum(case when item_id in (select query_id from open2) then 2 else 1 end) as n_attempts from needs group by 1),
    done as (select question, string_agg('need_' || (need % 10), ',' order by need) filter (status = 'supported') as supported from need_grades group by 1),
    best as (select question, need, arg_min(rank, (-score, rank)) as rank from held group by all),
    cited as (select question, string_agg(rank::varchar, ',' order by need) as cited from (select question, rank, min(need) as need from best group by all) join outcomes using (question) where outcome in ('complete', 'partial') group by 1)"""


@query("agentic_answer", f"""with {AGENT_SQL} select question as query_id, outcome, status, round(coverage, 6) as coverage, n_evidence, n_attempts::bigint as n_attempts, coalesce(supported, '') as supported, coalesce(cited, '') as cited
    from outcomes join tries using (question) left join done using (question) left join cited using (question)""")
def _(spark, d):
    told = answered(spark, d)
    cited = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "rank"))), lambda x: x["rank"].cast("string")), ",")
    cited = told.citations.groupBy("query_id").agg(cited.alias("cited"))
    rows = told.outcomes.join(cited, "query_id", "left")
    return rows.select("query_id", "outcome", "status", F.round("coverage", 6).alias("coverage"), "n_evidence", "n_attempts", F.array_join("supported", ",").alias("supported"), F.coalesce("cited", F.lit("")).alias("cited"))


@query("agentic_evidence", f"""with {AGENT_SQL} select question as query_id, doc_id, p.rank, round(max(score), 6) as relevance, string_agg('need_' || (need % 10), ',' order by need) as supports from places p join held h using (question, doc_id) group by question, doc_id, p.rank""")
def _(spark, d):
    told = answered(spark, d).evidence.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))
    needs = answered(spark, d).needs.select("query_id", "need_id", F.explode("ranks").alias("rank"))
    per = needs.groupBy("query_id", "rank").agg(F.array_join(F.array_sort(F.collect_list("need_id")), ",").alias("supports"))
    grades = answered(spark, d).grades.select("query_id", "rank", F.round("relevance", 6).alias("relevance"))
    return told.join(per, ["query_id", "rank"]).join(grades, ["query_id", "rank"])


@query("agentic_attempts", f"""with {AGENT_SQL}, r as (select query_id, 1 as round from scopes union all select query_id, 2 from open2),
    b as (select query_id, round, max(score) filter (score >= 0.35) as best from (select query_id, 1 as round, score from graded1 union all select query_id, 2, score from graded1 union all select query_id, 2, score from graded2) group by all)
    select query_id // 10 as query_id, 'need_' || (query_id % 10) as need_id, r.round, case round when 1 then 5 else 10 end as top_k, coalesce(n, 0) as n_candidates, coalesce(m, 0) as n_matched,
        case when best is null then 'missing' when best >= 0.6 then 'supported' else 'partial' end as support,
        case when best >= 0.6 then 'complete_supported' when round = 2 then 'complete_exhausted' else 'retry' end as action
    from r left join checks using (query_id, round) left join b using (query_id, round)""")
def _(spark, d):
    told = answered(spark, d)
    checks = told.validation.select("query_id", "need_id", "round", "n_candidates", "n_matched")
    return told.attempts.join(checks, ["query_id", "need_id", "round"]).select("query_id", "need_id", "round", "top_k", "n_candidates", "n_matched", "support", "action")


@query("resolution_report", f"""with {AGENT_SQL}, s as (select question, count(*) as n_needs, string_agg('need_' || (need % 10), ',' order by need) filter (status <> 'supported') as unresolved from need_grades group by 1)
    select question as query_id, n_needs, coalesce(supported, '') as supported, coalesce(unresolved, '') as unresolved, unresolved is null as complete, n_attempts::bigint as n_attempts from s join done using (question) join tries using (question)""")
def _(spark, d):
    told = answered(spark, d).outcomes
    return told.select("query_id", "n_needs", F.array_join("supported", ",").alias("supported"), F.array_join("unresolved", ",").alias("unresolved"), "complete", "n_attempts")
