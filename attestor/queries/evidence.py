"""Constraints, versions, selection, grading and arbitration of evidence."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from attestor.operators import fusion, grading, lexical, registry, selection, versions
from attestor.operators.versions import Constraints
from attestor.sources.tables import table

from . import corpus

QUERIES, ORACLE_SQL = {}, {}
RANK = "row_number() over (partition by query_id order by rank)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _told(df):
    return df.select("query_id", "doc_id", "document_id", "version_number", F.col("rank").cast("long").alias("rank"))


_COLUMNS = "query_id, doc_id, document_id, version_number"
_OWN = "partition by query_id, document_id"
_VERSION_RULES = {
    "latest": (f"dense_rank() over ({_OWN} order by version_number desc)", "p = 1"),
    "oldest": (f"dense_rank() over ({_OWN} order by version_number)", "p = 1"),
    "previous": (f"dense_rank() over ({_OWN} order by version_number desc)", "p = 2"),
    "latest_and_previous": (f"dense_rank() over ({_OWN} order by version_number desc)", "p <= 2"),
    "all_except_latest": (f"max(version_number) over ({_OWN})", "version_number < p"),
    "oldest_and_latest": (f"[min(version_number) over ({_OWN}), max(version_number) over ({_OWN})]", "version_number in (p[1], p[2])"),
    "specific": ("0", "version_number in (2, 4)"),
}


def _version_query(mode):
    told, keep = _VERSION_RULES[mode]

    @query(f"version_{mode}", f"with {corpus.evidence_sql()}, t as (select *, {told} as p from evidence) select {_COLUMNS}, {RANK} as rank from t where {keep}")
    def run(spark, d):
        return _told(versions.constrain(corpus.candidates(spark, d), Constraints(mode=mode, versions=(2, 4) if mode == "specific" else ())))


for _mode in _VERSION_RULES:
    _version_query(_mode)

_MAY = (datetime(2020, 3, 1), datetime(2020, 6, 1))


@query("date_range_filter", f"with {corpus.evidence_sql()} select {_COLUMNS}, {RANK} as rank from evidence where published_at >= timestamp '2020-03-01' and published_at < timestamp '2020-06-01'")
def _(spark, d):
    return _told(versions.constrain(corpus.candidates(spark, d), Constraints(published=_MAY)))


@query("date_any_recorded", f"""with {corpus.evidence_sql()} select {_COLUMNS}, {RANK} as rank from evidence
    where (published_at >= timestamp '2020-03-01' and published_at < timestamp '2020-06-01') or (uploaded_at >= timestamp '2020-03-01' and uploaded_at < timestamp '2020-06-01')""")
def _(spark, d):
    return _told(versions.constrain(corpus.candidates(spark, d), Constraints(any_recorded=_MAY)))


@query("date_then_latest", f"""with {corpus.evidence_sql()}, t as (select *, dense_rank() over ({_OWN} order by version_number desc) as p from evidence where published_at >= timestamp '2020-03-01' and published_at < timestamp '2020-06-01')
    select {_COLUMNS}, {RANK} as rank from t where p = 1""")
def _(spark, d):
    return _told(versions.constrain(corpus.candidates(spark, d), Constraints(mode="latest", published=_MAY)))


@query("name_filter", f"with {corpus.evidence_sql()} select {_COLUMNS}, {RANK} as rank from evidence where document_id || ' draft ' || version_number in ('src1 draft 3', 'src0 draft 12') or document_id || ' v' || version_number in ('src2 v5', 'src0 v7')")
def _(spark, d):
    return _told(versions.constrain(corpus.candidates(spark, d), Constraints(names=("'SRC1 Draft 3'", "src0_draft-12.md", "other/src2_v5.pdf", "src0_V7"))))


@query("payload_filter", "select doc_id, lang, source from documents where lang in ('de', 'fr') and source in ('src1', 'src2', 'src3')")
def _(spark, d):
    return table(spark, d, "documents").where(F.col("lang").isin("de", "fr") & F.col("source").isin("src1", "src2", "src3")).select("doc_id", "lang", "source")


@query("constraint_report", f"""with {corpus.evidence_sql()}, k as (select * from evidence where published_at >= timestamp '2020-03-01' and published_at < timestamp '2020-04-01' and version_number = 2)
    select item_id as query_id, (select count(*) from evidence e where e.query_id = item_id) as n_candidates, (select count(*) from k where k.query_id = item_id) as n_matched,
           case when (select count(*) from k where k.query_id = item_id) > 0 then 'matched' else 'no_match' end as status from benchmark""")
def _(spark, d):
    c = Constraints(mode="specific", versions=(2,), published=(datetime(2020, 3, 1), datetime(2020, 4, 1)))
    return versions.constraint_report(corpus.questions(spark, d), corpus.candidates(spark, d), c)


def _balance_sql(primary: str, turn: str) -> str:
    return f"""with {corpus.evidence_sql()}, s as (select *, {primary} as is_primary, row_number() over (partition by query_id, document_id order by rank) as seq from evidence),
        t as (select *, bool_or(is_primary) over (partition by query_id) as preferred from s), u as (select *, {turn} as turn from t),
        v as (select *, row_number() over (partition by query_id order by turn, rank) as selected_rank from u)
        select query_id, doc_id, document_id, rank, selected_rank from v where selected_rank <= 10"""


_FREE = "case when seq <= 6 then 1 else 4 end"
_PREFERRED = "case when not preferred then case when seq <= 6 then 1 else 4 end when is_primary and seq <= 6 then 1 when not is_primary and seq <= 4 then 2 when is_primary and seq <= 8 then 3 else 4 end"


def _balanced(spark, d, primary):
    e = corpus.candidates(spark, d).withColumn("is_primary", primary).withColumn("document_key", F.col("document_id"))
    return selection.balance(e, 10).select("query_id", "doc_id", "document_id", F.col("rank").cast("long").alias("rank"), F.col("selected_rank").cast("long").alias("selected_rank"))


@query("balance_unpreferred", _balance_sql("false", _FREE))
def _(spark, d):
    return _balanced(spark, d, F.lit(False))


@query("balance_preferred", _balance_sql("document_id = 'src0'", _PREFERRED))
def _(spark, d):
    return _balanced(spark, d, F.col("document_id") == "src0")


@query("document_counts", f"select query_id, document_id as document_key, count(*) as n from ({_balance_sql('false', _FREE)}) group by all")
def _(spark, d):
    return selection.document_counts(_balanced(spark, d, F.lit(False)).withColumnRenamed("document_id", "document_key"))


@query("primary_document", f"""with {corpus.evidence_sql()}, g as (select query_id, document_id, rank, least(1.0, score / max(score) over (partition by query_id)) as relevance, case when document_id = 'src0' then 0.8 else 0.0 end as name_score from evidence),
    p as (select query_id, document_id, least(1.0::double, 0.74 * max(relevance) + 0.21 * max(name_score) + least(0.08::double, 0.04 * (count(*) - 1))) as score, min(rank) as fr from g group by all),
    o as (select *, row_number() over w as place, lead(score) over w as next from p window w as (partition by query_id order by round(score, 9) desc, fr))
    select query_id, document_id as document_key, round(score, 6) as score, round(greatest(0, score - coalesce(next, 0)), 6) as margin,
           round(least(1.0::double, score * 0.75 + least(0.25::double, greatest(0, score - coalesce(next, 0)))), 6) as confidence
    from o where place = 1 and score >= 0.65 and (next is null or score - next >= 0.08)""")
def _(spark, d):
    from pyspark.sql.window import Window

    e = corpus.candidates(spark, d)
    relevance = F.least(F.lit(1.0), F.col("score") / F.max("score").over(Window.partitionBy("query_id")))
    graded = e.select("query_id", F.col("document_id").alias("document_key"), "rank", relevance.alias("relevance"), F.when(F.col("document_id") == "src0", 0.8).otherwise(0.0).alias("name_score"))
    found = selection.primary_document(graded)
    return found.select("query_id", "document_key", *[F.round(c, 6).alias(c) for c in ("score", "margin", "confidence")])


@query("logical_reference", f"""with {corpus.VERSIONS_SQL} select doc_id, case when doc_id % 4 = 0 then 'document:' || document_id when doc_id % 4 = 1 then 'name:' || least(lower(title), lower(document_id)) when doc_id % 4 = 2 then 'version:' || doc_id else 'unknown:' || version_number end as key from versions""")
def _(spark, d):
    v, r = corpus.versions(spark, d), F.col("doc_id") % 4
    names = F.when(r == 1, F.array(F.lower("title"), F.lower("document_id")))
    key = selection.reference_key(F.when(r == 0, F.col("document_id")), names, F.when(r == 2, F.col("doc_id")), F.col("version_number"))
    return v.select("doc_id", key.alias("key"))


def _needs(spark, d):
    """Two needs of each question: its first and its second half of words; the second is required for even ids alone."""
    q = corpus.questions(spark, d).withColumn("w", F.split("question", " ")).withColumn("h", F.ceil(F.size("w") / 2).cast("int"))
    first = q.select("query_id", F.lit("need_1").alias("need_id"), F.array_join(F.slice("w", F.lit(1), F.col("h")), " ").alias("need"), F.lit(True).alias("required"))
    second = q.select("query_id", F.lit("need_2").alias("need_id"), F.array_join(F.slice("w", F.col("h") + 1, F.size("w")), " ").alias("need"), (F.col("query_id") % 2 == 0).alias("required"))
    return first.unionByName(second)


_STOP = ", ".join(f"'{w}'" for w in __import__("attestor.functions.text", fromlist=["x"]).STOP_WORDS)
_TERMS = f"list_filter(list_distinct(regexp_extract_all(lower({{}}), '[a-z0-9][a-z0-9_-]*')), lambda t: length(t) > 1 and t not in ({_STOP}))"
GRADES_SQL = f"""{corpus.evidence_sql(20)}, h as (select item_id as query_id, string_split(text, ' ') as w, cast(ceil(len(string_split(text, ' ')) / 2.0) as int) as h from benchmark),
    needs as materialized (select query_id, 'need_1' as need_id, true as required, {_TERMS.format("array_to_string(w[:h], ' ')")} as terms from h
              union all select query_id, 'need_2', query_id % 2 = 0, {_TERMS.format("array_to_string(w[h + 1:], ' ')")} from h),
    texts as materialized (select e.query_id, e.rank, {_TERMS.format("d.text")} as terms from evidence e join documents d using (doc_id)),
    pairs as materialized (select query_id, need_id, required, rank, case when len(n.terms) = 0 then 0 else len(list_intersect(n.terms, t.terms)) / len(n.terms)::double end as score from needs n join texts t using (query_id)),
    eg as materialized (select query_id, rank, max(score) as relevance, max(score) >= 0.35 as relevant, string_agg(need_id, ',' order by need_id) filter (score >= 0.35) as supports from pairs group by all),
    ng as materialized (select query_id, need_id, required, coalesce(max(score), 0) as coverage, count(*) filter (score >= 0.35) as n_ranks,
           case when count(*) filter (score >= 0.35) = 0 then 'missing' when max(score) >= 0.6 then 'supported' else 'partial' end as status
           from needs left join pairs using (query_id, need_id, required) group by all),
    rp as materialized (select query_id, n.coverage, n.n_required, n.n_unresolved, coalesce(n_relevant, 0) as n_relevant from
           (select query_id, coalesce(avg(coverage) filter (required), 1) as coverage, count(*) filter (required) as n_required, count(*) filter (required and status <> 'supported') as n_unresolved from ng group by 1) n
           left join (select query_id, count(*) filter (relevant) as n_relevant from eg group by 1) using (query_id)),
    reports as (select *, case when n_relevant = 0 then 'missing' when n_required > 0 and n_unresolved = 0 then 'sufficient' else 'weak' end as status from rp)"""


def _graded(spark, d):
    evidence = corpus.candidates(spark, d, 20).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    needs = _needs(spark, d)
    return evidence, needs, grading.grade_pairs(evidence, needs)


@query("lexical_grade", f"with {GRADES_SQL} select query_id, rank, round(relevance, 6) as relevance, relevant, coalesce(supports, '') as supports from eg")
def _(spark, d):
    g = grading.evidence_grades(_graded(spark, d)[2])
    return g.select("query_id", F.col("rank").cast("long").alias("rank"), F.round("relevance", 6).alias("relevance"), "relevant", F.array_join("supports", ",").alias("supports"))


@query("need_status", f"with {GRADES_SQL} select query_id, need_id, required, round(coverage, 6) as coverage, n_ranks, status from ng")
def _(spark, d):
    _, needs, pairs = _graded(spark, d)
    return grading.need_grades(needs, pairs).select("query_id", "need_id", "required", F.round("coverage", 6).alias("coverage"), F.size("ranks").cast("long").alias("n_ranks"), "status")


@query("report_status", f"with {GRADES_SQL} select query_id, status, round(coverage, 6) as coverage, n_relevant, n_unresolved from reports")
def _(spark, d):
    _, needs, pairs = _graded(spark, d)
    r = grading.report(grading.need_grades(needs, pairs), grading.evidence_grades(pairs))
    return r.withColumn("coverage", F.round("coverage", 6))


@query("arbitrate_downgrade", f"""with {GRADES_SQL}, p as (select query_id, rank, relevance * 0.9 as p_relevance, rank % 3 <> 0 as p_relevant, ['need_1'] as p_supports from eg),
    f as (select query_id, rank, least(relevance, p_relevance) as relevance, relevant and p_relevant and contains(coalesce(supports, ''), 'need_1') as relevant from eg join p using (query_id, rank))
    select query_id, rank, round(relevance, 6) as relevance, relevant, case when relevant then 'need_1' else '' end as supports from f""")
def _(spark, d):
    prior = grading.evidence_grades(_graded(spark, d)[2])
    proposed = prior.select("query_id", "rank", (F.col("relevance") * 0.9).alias("relevance"), (F.col("rank") % 3 != 0).alias("relevant"), F.array(F.lit("need_1")).alias("supports"))
    final = grading.arbitrate(prior, proposed)
    return final.select("query_id", F.col("rank").cast("long").alias("rank"), F.round("relevance", 6).alias("relevance"), "relevant", F.array_join("supports", ",").alias("supports"))


@query("answer_gate", f"""with {GRADES_SQL}, k as (select distinct query_id from evidence where uploaded_at >= timestamp '2024-01-20'),
    n as (select query_id, count(*) as n_evidence from eg where relevant group by 1)
    select r.query_id, case when k.query_id is null then 'blocked_constraint_no_match' when r.status = 'missing' then 'blocked_insufficient_evidence' when coalesce(n_evidence, 0) = 0 then 'blocked_no_evidence'
           when r.status = 'weak' then 'partial' else 'complete' end as outcome, coalesce(n_evidence, 0) as n_evidence
    from reports r left join k using (query_id) left join n using (query_id)""")
def _(spark, d):
    evidence, needs, pairs = _graded(spark, d)
    grades = grading.evidence_grades(pairs)
    scope = versions.constraint_report(corpus.questions(spark, d), evidence, Constraints(uploaded=(datetime(2024, 1, 20), None)))
    return grading.answer_gate(grading.report(grading.need_grades(needs, pairs), grades), scope, evidence.join(grades.select("query_id", "rank", "relevant"), ["query_id", "rank"]))


@query("citation_projection", f"""with {corpus.evidence_sql(20)}, c as (select item_id as query_id, unnest([1, 3, 2]) as rank, unnest([0, 1, 2]) as position from benchmark)
    select c.query_id, c.position, c.rank, '[' || c.rank || ']' as label, sha256(substr(d.text, 1, 500)) as quote_hash, e.doc_id from c join evidence e on e.query_id = c.query_id and e.rank = c.rank join documents d using (doc_id)""")
def _(spark, d):
    evidence = corpus.candidates(spark, d, 20).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    answers = corpus.questions(spark, d).select("query_id", F.concat(F.lit("First [1], then [3,1] and [2] but not [99] or [x]: "), "question").alias("answer"))
    return grading.citations(answers, evidence).select("query_id", "position", "rank", "label", F.sha2("quote", 256).alias("quote_hash"), "doc_id")


@query("rerank_order", f"""with {GRADES_SQL}, s as (select query_id, rank, case when rank % 5 = 0 then null else relevance end as score from eg)
    select query_id, rank, row_number() over (partition by query_id order by score is null, round(score, 9) desc, rank) as new_rank from s""")
def _(spark, d):
    from pyspark.sql.window import Window

    g = grading.evidence_grades(_graded(spark, d)[2]).withColumn("score", F.when(F.col("rank") % 5 != 0, F.col("relevance")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").isNull(), F.round("score", 9).desc(), "rank")
    return g.select("query_id", F.col("rank").cast("long").alias("rank"), F.row_number().over(order).cast("long").alias("new_rank"))


@query("evidence_keys", "select doc_id, case when doc_id % 2 = 0 then 'chunk:' || doc_id else 'text:' || sha256(trim(text)) end as fusion_key, sha256(lower(trim(text)) || '|' || source || '|' || doc_id) as need_key, case when doc_id % 2 = 0 then 'chunk:' || doc_id else 'text:' || sha256(text) end as stability_key from documents")
def _(spark, d):
    chunk = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))
    keys = (fusion.evidence_key(chunk, F.col("text")), fusion.need_key(F.col("text"), F.col("source"), F.col("doc_id")), fusion.stability_key(chunk, F.col("text")))
    return corpus.documents(spark, d).select("doc_id", keys[0].alias("fusion_key"), keys[1].alias("need_key"), keys[2].alias("stability_key"))


def _status_log(spark, d):
    v = corpus.versions(spark, d)
    return v.select("document_id", "doc_id", "version_number", F.when(F.col("doc_id") % 7 == 0, "failed").when(F.col("doc_id") % 11 == 0, "processing").otherwise("ready").alias("status"))


_STATUS_SQL = f"{corpus.VERSIONS_SQL}, st as (select document_id, doc_id, version_number, case when doc_id % 7 = 0 then 'failed' when doc_id % 11 = 0 then 'processing' else 'ready' end as status from versions)"


@query("next_version", f"with {corpus.VERSIONS_SQL} select source as document_id, doc_id, row_number() over (partition by source order by doc_id) + (select max(version_number) from versions v where v.document_id = source) as version_number from documents")
def _(spark, d):
    incoming = table(spark, d, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("version_id"))
    found = registry.number_versions(incoming, corpus.versions(spark, d))
    return found.select("document_id", F.col("version_id").alias("doc_id"), F.col("version_number").cast("long").alias("version_number"))


@query("latest_ready", f"""with {_STATUS_SQL} select document_id, count(*) as n_versions, count(*) filter (status = 'ready') as n_ready, coalesce(max(version_number) filter (status = 'ready'), max(version_number)) as latest_version,
    case when count(*) filter (status = 'ready') > 0 then 'ready' when max_by(status, version_number) = 'failed' then 'failed' else 'processing' end as document_status from st group by 1""")
def _(spark, d):
    return registry.latest_ready(_status_log(spark, d)).withColumn("latest_version", F.col("latest_version").cast("long"))


@query("current_state", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as p from events) where p = 1")
def _(spark, d):
    return registry.current_state(table(spark, d, "events"), ("user_id",), "event_id").select("user_id", "event_id", "event_type")


@query("upsert_points", "select vec_id as id, label + 100 as label from embeddings where vec_id % 2 = 0 union all select vec_id, label from embeddings where vec_id % 2 <> 0")
def _(spark, d):
    stored = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return registry.upsert(stored, stored.where("id % 2 = 0").withColumn("label", F.col("label") + 100))


@query("paging", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 50 offset 100")
def _(spark, d):
    return registry.page(table(spark, d, "orders"), 100, 50, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("eager_children", f"with {corpus.VERSIONS_SQL} select source as document_id, (select count(*) from versions v where v.document_id = d.source) as n_children, (select string_agg(version_number || '=' || doc_id, ',' order by version_number) from versions v where v.document_id = d.source) as children from (select distinct source from documents) d")
def _(spark, d):
    v = corpus.versions(spark, d)
    found = registry.with_children(v.select("document_id").distinct(), v, "document_id", "version_number", ("doc_id",))
    line = F.transform("children", lambda c: F.concat(c["version_number"].cast("string"), F.lit("="), c["doc_id"].cast("string")))
    return found.select("document_id", F.size("children").cast("long").alias("n_children"), F.array_join(line, ",").alias("children"))


@query("keyword_corpus", "select doc_id, sha256(coalesce(nullif(trim(case when doc_id % 2 = 0 then source || ' ' || text end), ''), nullif(trim(text), ''))) as searched, sha256(nullif(trim(text), '')) as returned from documents where doc_id % 10 <> 3 and trim(text) <> ''")
def _(spark, d):
    from attestor.sources.tables import searchable

    p = corpus.documents(spark, d).select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", "source", "text")).alias("contextualized_text"), F.when(F.col("doc_id") % 10 == 3, "hierarchy_summary").alias("point_type"))
    return searchable(p, contextual=True).select("doc_id", F.sha2("text", 256).alias("searched"), F.sha2("evidence_text", 256).alias("returned"))
