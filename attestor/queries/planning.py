"""Plans over a corpus with versions, evaluation of a dataset, and what runs keep between steps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import fusion, grading, hierarchy, registry, selection, state, vectors, versions
from attestor.operators.versions import Constraints
from attestor.plans import pipelines
from attestor.sources.scratch import materialise
from attestor.sources.tables import table

from . import corpus, evidence, retrieval

QUERIES, ORACLE_SQL = {}, {}
_MAY = (datetime(2020, 3, 1), datetime(2020, 6, 1))
_KEY = "row_number() over (partition by query_id order by round(score, 9) + 0.0 desc, cast(doc_id as varchar))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def engine(spark, d, **changes) -> pipelines.Corpus:
    docs = corpus.documents(spark, d).select("doc_id", "text").join(corpus.versions(spark, d), "doc_id")
    points = corpus.kept(spark, d, "vectors", lambda: materialise(vectors.embed_documents(corpus.documents(spark, d), 64), "vectors", keep=True))
    sections = table(spark, d, "documents").select("doc_id", F.concat_ws(":", "source", "lang").alias("section_id"), F.col("source").alias("document_id"))
    return pipelines.Corpus(**({"documents": docs, "points": points, "sections": sections, "index": corpus.index(spark, d)} | changes))


def _told(df, *more):
    return df.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), *more)


def _hybrid_sql(allowed: str, wide: int, k: int) -> str:
    """CTEs ``fused`` (query_id, doc_id, score, rank) of BM25 and dense hits inside a predicate on doc_id."""
    return f"""kw as materialized (select query_id, doc_id, {_KEY} as rank from scored where score > 0 and {allowed}), pairs_ as materialized (select query_id, doc_id, coalesce(score, 0) as score from (select distinct id as query_id from vectors_q) cross join (select distinct id as doc_id from vectors_d) left join dense using (query_id, doc_id)),
        dn as materialized (select query_id, doc_id, {_KEY} as rank from pairs_ where {allowed}),
        fused as materialized (select *, {_KEY} as rank from (select query_id, doc_id, sum(1.0 / (60 + rank)) as score from (select * from kw where rank <= {wide} union all select * from dn where rank <= {wide}) group by all) qualify rank <= {k})"""


@query("executor_dated_latest", f"""with {corpus.BM25_SQL}, {retrieval.DENSE_SQL}, {corpus.VERSIONS_SQL}, inside as materialized (select doc_id from versions where published_at >= timestamp '2020-03-01' and published_at < timestamp '2020-06-01'),
    {_hybrid_sql("doc_id in (from inside)", 100, 40)}, t as (select f.query_id, f.doc_id, f.rank, dense_rank() over (partition by query_id, document_id order by version_number desc) as p from fused f join versions using (doc_id)),
    r as (select query_id, doc_id, row_number() over (partition by query_id order by rank) as rank from t where p = 1) select * from r where rank <= 10""")
def _(spark, d):
    plan = pipelines.Plan("hybrid", 10, Constraints(mode="latest", published=_MAY))
    return _told(pipelines.execute(engine(spark, d), corpus.questions(spark, d), plan))


@query("executor_balanced", f"""with {corpus.BM25_SQL}, {retrieval.DENSE_SQL}, {_hybrid_sql("true", 100, 40)}, s as (select f.*, row_number() over (partition by query_id, source order by rank) as seq from fused f join documents using (doc_id)),
    r as (select query_id, doc_id, row_number() over (partition by query_id order by case when seq <= 6 then 1 else 4 end, rank) as rank from s) select * from r where rank <= 10""")
def _(spark, d):
    return _told(pipelines.execute(engine(spark, d), corpus.questions(spark, d), pipelines.Plan("hybrid", 10, balance=True)))


_CONTEXT = "(select doc_id, source || ' ' || lang || ' ' || text as text from documents)"


@query("contextual_hybrid", f"""with {corpus.BM25_SQL.replace("from documents)", f"from {_CONTEXT})", 1)}, {retrieval.DENSE_SQL.replace("from documents)", f"from {_CONTEXT})", 1)}, {_hybrid_sql("true", 40, 10)} select query_id, doc_id, rank from fused""")
def _(spark, d):
    own = corpus.documents(spark, d).select("doc_id", F.concat_ws(" ", "source", "lang", "text").alias("text"))
    return _told(pipelines.contextual(engine(spark, d, contextual=own), corpus.questions(spark, d), 10))


def _halves(questions):
    """Two variants of each question: its first and its second half of words."""
    w = F.split("question", " ")
    h = F.ceil(F.size(w) / 2).cast("int")
    halves = F.array(F.array_join(F.slice(w, F.lit(1), h), " "), F.array_join(F.slice(w, h + 1, F.size(w)), " "))
    return questions.select("query_id", F.posexplode(halves).alias("i", "question")).select("query_id", (F.col("i") + 1).alias("position"), "question")


_VARIANTS = """vw as (select item_id, string_split(text, ' ') as w, text from benchmark),
    va as (select item_id, 0 as position, text from vw union all select item_id, 1, array_to_string(w[:cast(ceil(len(w) / 2.0) as int)], ' ') from vw union all select item_id, 2, array_to_string(w[cast(ceil(len(w) / 2.0) as int) + 1:], ' ') from vw),
    vk as (select *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as key from va where trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' qualify row_number() over (partition by item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) order by position) = 1),
    variants as materialized (select item_id * 10 + row_number() over (partition by item_id order by position) - 1 as item_id, text from vk)"""


@query("multi_query_variants", f"""with {_VARIANTS}, {corpus.BM25_SQL.replace("from benchmark", "from variants")}, {retrieval.DENSE_SQL.replace("from benchmark", "from variants")}, {_hybrid_sql("true", 80, 20)},
    v as (select query_id // 10 as query_id, doc_id, sum(case when query_id % 10 = 0 then 1.2 else 1.0 end / (60 + rank)) as score, count(*) as matches from fused group by all)
    select query_id, doc_id, {_KEY} as rank, matches from v qualify rank <= 10""")
def _(spark, d):
    own = engine(spark, d, providers=pipelines.Providers(variants=_halves))
    return _told(pipelines.multi_query(own, corpus.questions(spark, d), 10), "matches")


@query("hierarchical_pipeline")
def _(spark, d):
    return _told(pipelines.hierarchical(engine(spark, d), corpus.questions(spark, d), 10))


_CLEAN = r"replace(lower(trim(regexp_replace({}, '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'))), 'ß', 'ss')"


@query("evaluation_report", f"""with {corpus.BM25_SQL}, {retrieval.DENSE_SQL}, {_hybrid_sql("true", 40, 10)}, m as materialized (select f.query_id, f.rank from fused f join documents d using (doc_id) join benchmark b on b.item_id = f.query_id where contains({_CLEAN.format("d.text")}, {_CLEAN.format("b.text")})),
    c as (select item_id, (select min(rank) from m where m.query_id = item_id) as r from benchmark)
    select 'recall_at_' || k as metric, round(avg(case when r <= k then 1.0 else 0.0 end), 6) as value, count(*) as n from c cross join (values (1), (5), (10)) t(k) group by k
    union all select 'reciprocal_rank', round(avg(coalesce(1.0 / r, 0)), 6), count(*) from c""")
def _(spark, d):
    cases = corpus.questions(spark, d).withColumnRenamed("query_id", "case_id")
    expectations = cases.select("case_id", F.lit(0).alias("expectation_id"), F.lit(None).cast("string").alias("document_id"), F.array("question").alias("fragments"))
    report = pipelines.evaluate(engine(spark, d), cases, expectations, pipelines.Plan("hybrid", 10))[1]
    return report.withColumn("value", F.round("value", 6))


@query("need_resolution")
def _(spark, d):
    states, _ = pipelines.resolve_needs(engine(spark, d), evidence._needs(spark, d), pipelines.Limits(attempts=2))
    return states.select("query_id", "need_id", "strategy", "top_k", "attempts", "status", F.round("coverage", 6).alias("coverage"))


@query("rrf_details", f"""with {corpus.BM25_SQL}, {retrieval.DENSE_SQL}, hits as (select query_id, doc_id, rank, score, 'keyword' as source from bm25 where rank <= 20 union all select query_id, doc_id, rank, score, 'vector' from dense where rank <= 20),
    f as (select * from (select query_id, doc_id, sum(1.0 / (60 + rank)) as score from hits group by all) qualify {_KEY} <= 5) select query_id, doc_id, source, h.rank as source_rank, round(h.score, 6) as source_score from f join hits h using (query_id, doc_id)""")
def _(spark, d):
    lists = [("vector", 1.0, retrieval.dense(spark, d, 20)), ("keyword", 1.0, corpus.lexical_hits(spark, d, 20))]
    found = fusion.reciprocal_rank_fusion(lists, 5).select("query_id", "doc_id", F.explode("details").alias("x"))
    return found.select("query_id", "doc_id", "x.source", F.col("x.rank").cast("long").alias("source_rank"), F.round("x.score", 6).alias("source_score"))


@query("knn_others", f"with {retrieval.KNN_SQL} select query_id, doc_id, {_KEY} as rank from scored where query_id <> doc_id qualify rank <= 5")
def _(spark, d):
    return _told(vectors.knn_topk(retrieval.points(spark, d), retrieval.point_questions(spark, d), 5, same=False))


@query("cosine_pair_list", f"with {retrieval.UNIT_SQL} select a.label, a.vec_id as a, b.vec_id as b, round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 6) as similarity from normed a join normed b on a.label = b.label and a.vec_id // 64 = b.vec_id // 64 and a.vec_id < b.vec_id")
def _(spark, d):
    group = F.struct("label", F.floor(F.col("doc_id") / 64).alias("part"))  # groups as small as a document's
    p = retrieval.points(spark, d).select(group.alias("g"), F.col("doc_id").alias("id"), "vector")
    return hierarchy.cosine_pairs(p, "g").select("g.label", "a", "b", F.round("similarity", 6).alias("similarity"))


_GENERIC = ", ".join(f"'{w}'" for w in T.GENERIC_NAME_WORDS)
_TOKENS = r"list_filter(list_distinct(regexp_extract_all(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+')), lambda t: length(t) >= 2 and t not in (" + _GENERIC + "))"


@query("name_overlap", f"""with {corpus.VERSIONS_SQL}, n as (select doc_id, len(list_intersect({_TOKENS.format("title")}, {_TOKENS.format("'Which src1 Draft or ReportSrc2 draft 12?'")})) as n from versions)
    select doc_id, round(case when n = 0 then 0 else least(1.0, 0.6 + 0.2 * n) end::double, 6) as score from n""")
def _(spark, d):
    score = selection.name_scores(F.col("title"), F.lit("Which src1 Draft or ReportSrc2 draft 12?"))
    return corpus.versions(spark, d).select("doc_id", F.round(score, 6).alias("score"))


@query("preference_match", f"""with {corpus.VERSIONS_SQL} select doc_id, case when doc_id % 3 = 0 then document_id = 'src1' else coalesce(case when doc_id % 3 = 1 then doc_id in (4, 10, 19) end, false) or document_id || ' draft ' || version_number in ('src2 draft 1', 'src3 draft 2') end as matched from versions""")
def _(spark, d):
    v, r = corpus.versions(spark, d), F.col("doc_id") % 3
    names = T.known_names([], [F.col("title")])
    matched = selection.matches_preference(F.when(r == 0, F.col("document_id")), F.when(r == 1, F.col("doc_id")), names, F.lit("src1"), F.array(*[F.lit(x).cast("long") for x in (4, 10, 19)]), F.array(F.lit("src2 draft 1"), F.lit("src3 draft 2")))
    return v.select("doc_id", matched.alias("matched"))


@query("outcome_signature", """with a as (select doc_id, case when doc_id % 3 = 0 then 'complete' when doc_id % 3 = 1 then null else 'partial' end as p, doc_id % 5 = 0 as b, case when doc_id % 2 = 0 then text end as t from documents),
    o as (select *, coalesce(p, case when b then 'legacy_refusal' when coalesce(t, '') <> '' then 'legacy_answer' else 'legacy_no_answer' end) as outcome from a)
    select doc_id, outcome, case when p is null then 'absent|' || outcome || '|body:' || case when coalesce(t, '') <> '' then 'True' else 'False' end
        else 'schema:1.0|outcome:' || outcome || '|body:' || case when coalesce(t, '') <> '' then 'True' else 'False' end || '|supported_section:' || case when doc_id % 4 > 0 then 'True' else 'False' end || '|supported_count:' || (doc_id % 4)
             || '|unresolved_section:False|unresolved_count:0|citation_count:' || (doc_id % 7) end as signature from o""")
def _(spark, d):
    i = F.col("doc_id")
    p, t = F.when(i % 3 == 0, "complete").when(i % 3 == 2, "partial"), F.when(i % 2 == 0, F.col("text"))
    o = state.outcome(p, i % 5 == 0, t)
    supported = F.slice(F.array(*[F.lit("x")] * 3), F.lit(1), (i % 4).cast("int"))
    s = state.presentation_signature(F.when(p.isNotNull(), F.lit("1.0")), o, t, supported, F.array().cast("array<string>"), i % 7)
    return table(spark, d, "documents").select("doc_id", o.alias("outcome"), F.array_join(s, "|").alias("signature"))


@query("contextual_integrity", """select source, count(*) as n_chunks, count(*) filter (doc_id % 11 = 0) as n_missing, 0::bigint as n_extra, count(*) filter (doc_id % 13 = 0 and doc_id % 11 <> 0) as n_changed from documents group by 1""")
def _(spark, d):
    chunks = table(spark, d, "documents").select("source", F.col("doc_id").alias("ordinal"), F.sha2("text", 256).alias("content_hash"))
    contexts = chunks.where("ordinal % 11 <> 0").withColumn("content_hash", F.when(F.col("ordinal") % 13 == 0, "other").otherwise(F.col("content_hash")))
    return state.integrity_faults(chunks, contexts, "source")


@query("version_candidates", """with pool as (select source, max(doc_id) as newest from documents group by 1), u as (select doc_id, source from documents)
    select doc_id as upload_id, source as document_id from u where doc_id % 2 = 0 union all select doc_id, case when length(source) >= 4 then source end from u where doc_id % 2 = 1 and length(source) >= 4""")
def _(spark, d):
    docs = table(spark, d, "documents")
    known = docs.groupBy(F.col("source").alias("document_id")).agg(F.max("doc_id").alias("created_at")).select("document_id", "created_at", F.concat("document_id", F.lit(" draft 2")).alias("title"), F.concat("document_id", F.lit(".pdf")).alias("filename"))
    uploads = docs.select(F.col("doc_id").alias("upload_id"), F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(".PDF"))).otherwise(F.concat("source", F.lit("_v7.md"))).alias("filename"))
    return registry.same_document_candidates(uploads, known)


@query("arbitrated_needs", f"""with {evidence.GRADES_SQL}, n as (select query_id, need_id, required, coverage, status from ng),
    f as (select query_id, need_id, count(*) as n_ranks from (select query_id, rank, unnest(string_split(supports, ',')) as need_id from eg where relevant and rank % 3 <> 0) group by all)
    select query_id, need_id, round(case when n_ranks is null then 0 else least(coverage, coverage * 0.9) end, 6) as coverage, case when n_ranks is null then 'missing' when status = 'supported' then 'partial' else status end as status, coalesce(n_ranks, 0) as n_ranks
    from n left join f using (query_id, need_id)""")
def _(spark, d):
    _, needs, pairs = evidence._graded(spark, d)
    prior = grading.need_grades(needs, pairs)
    proposed = prior.select("query_id", "need_id", (F.col("coverage") * 0.9).alias("coverage"), F.lit("partial").alias("status"))
    grades = grading.evidence_grades(pairs)
    final = grading.arbitrate(grades, grades.withColumn("relevant", F.col("relevant") & (F.col("rank") % 3 != 0)))
    # a need that had no evidence stays missing, whatever is proposed
    told = grading.arbitrate_needs(prior, proposed, final)
    return told.select("query_id", "need_id", F.round("coverage", 6).alias("coverage"), "status", F.greatest(F.coalesce(F.size("ranks"), F.lit(0)), F.lit(0)).cast("long").alias("n_ranks"))


@query("missing_ranks", f"with {evidence.GRADES_SQL} select query_id, rank from eg where rank % 4 = 0")
def _(spark, d):
    prior = grading.evidence_grades(evidence._graded(spark, d)[2])
    return _told_ranks(grading.missing_ranks(prior, prior.where("rank % 4 <> 0")))


def _told_ranks(df):
    return df.select("query_id", F.col("rank").cast("long").alias("rank"))


@query("pushdown_specific", f"with {corpus.VERSIONS_SQL} select doc_id from versions where version_number in (2, 4) and published_at >= timestamp '2020-03-01' and published_at < timestamp '2020-06-01' and document_id || ' draft ' || version_number in ('src1 draft 2', 'src2 draft 4', 'src0 draft 2')")
def _(spark, d):
    c = Constraints(mode="specific", versions=(2, 4), published=_MAY, names=("src1 Draft 2", "“src2 draft 4.pdf”", "'src0_draft_2'"))
    return corpus.versions(spark, d).where(versions.pushdown(c)).select("doc_id")


@query("pushdown_latest", f"with {corpus.VERSIONS_SQL} select doc_id from versions where is_latest")
def _(spark, d):
    return corpus.versions(spark, d).where(versions.pushdown(Constraints(mode="latest"))).select("doc_id")


@query("matching_dates", f"""with {corpus.VERSIONS_SQL} select doc_id, concat_ws(',', case when published_at >= timestamp '2020-03-01' and published_at < timestamp '2024-01-05' then 'published_at' end, case when uploaded_at >= timestamp '2020-03-01' and uploaded_at < timestamp '2024-01-05' then 'uploaded_at' end) as dates from versions""")
def _(spark, d):
    c = Constraints(any_recorded=(datetime(2020, 3, 1), datetime(2024, 1, 5)))
    return corpus.versions(spark, d).select("doc_id", F.array_join(versions.matching_dates(c), ",").alias("dates"))


@query("window_keys", f"with {corpus.VERSIONS_SQL} select doc_id, case when doc_id % 3 = 0 then document_id when doc_id % 3 = 1 then title else 'unknown-document' end as document_key, case when doc_id % 2 = 0 then version_number end as number from versions")
def _(spark, d):
    r = F.col("doc_id") % 3
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.col("version_number").cast("string"))).otherwise(F.lit("vx"))
    key, number = versions.window_keys(F.when(r == 0, F.col("document_id")), [F.when(r == 1, F.col("title"))], text)
    return corpus.versions(spark, d).select("doc_id", key.alias("document_key"), number.cast("long").alias("number"))


@query("selection_summary", f"""with {corpus.evidence_sql()}, s as (select *, row_number() over (partition by query_id, document_id order by rank) as seq from evidence), v as (select *, row_number() over (partition by query_id order by case when seq <= 6 then 1 else 4 end, rank) as sr from s),
    k as (select query_id, document_id, count(*) as n from v where sr <= 10 group by all)
    select query_id, (select count(*) from evidence e where e.query_id = k.query_id) as n_candidates, sum(n)::bigint as n_selected, count(*) as n_documents, max(n) > 6 as relaxed from k group by 1""")
def _(spark, d):
    e = corpus.candidates(spark, d).withColumn("is_primary", F.lit(False)).withColumn("document_key", F.col("document_id"))
    return selection.selection_summary(e, selection.balance(e, 10), 10)


@query("passed_through", f"with {corpus.evidence_sql()} select query_id, doc_id, r as rank from (select *, row_number() over (partition by query_id order by rank) as r from evidence) where r <= 7")
def _(spark, d):
    kept = selection.passed_through(corpus.candidates(spark, d), 7)
    return kept.select("query_id", "doc_id", F.col("selected_rank").cast("long").alias("rank"))


@query("rerank_fallback", f"""with {evidence.GRADES_SQL}, s as (select query_id, rank, relevance, rank % 5 = 0 as fallback, case when rank % 5 = 0 then (count(*) over w - least(greatest(rank, 1), count(*) over w) + 1) / (count(*) over w)::double else least(1.0, greatest(0.0, relevance)) end as used from eg window w as (partition by query_id)),
    r as (select *, row_number() over (partition by query_id order by fallback, round(used, 9) desc, rank) as new_rank from s)
    select query_id, count(*) as n_candidates, count(*) filter (fallback) as n_fallbacks, count(*) filter (rank <> new_rank) as n_moved from r group by 1""")
def _(spark, d):
    g = grading.evidence_grades(evidence._graded(spark, d)[2])
    scored = selection.rerank(g.withColumn("rerank_score", F.when(F.col("rank") % 5 != 0, F.col("relevance"))))
    return selection.rerank_summary(scored)


@query("overall_status", f"""with {evidence.GRADES_SQL}, o as (select query_id, coalesce(avg(coverage) filter (required), 1) as coverage, count(*) filter (status <> 'missing') as n_some, count(*) filter (required and status <> 'supported') as n_open, count(*) filter (required) as n_required,
        coalesce(string_agg(need_id, ',' order by need_id) filter (status = 'supported'), '') as supported, coalesce(string_agg(need_id, ',' order by need_id) filter (required and status <> 'supported'), '') as unresolved from ng group by 1)
    select query_id, case when n_some = 0 then 'missing' when n_required > 0 and n_open = 0 then 'sufficient' else 'weak' end as status, round(coverage, 6) as coverage, supported, unresolved from o""")
def _(spark, d):
    _, needs, pairs = evidence._graded(spark, d)
    r = grading.overall_status(grading.need_grades(needs, pairs))
    return r.select("query_id", "status", F.round("coverage", 6).alias("coverage"), F.array_join("supported", ",").alias("supported"), F.array_join("unresolved", ",").alias("unresolved"))


@query("linked_citations", f"""with {corpus.evidence_sql(20)}, c as (select item_id as query_id, unnest([1, 5, 99]) as rank from benchmark) select c.query_id, c.rank, e.doc_id from c left join evidence e on e.query_id = c.query_id and e.rank = c.rank""")
def _(spark, d):
    own = corpus.candidates(spark, d, 20).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    named = corpus.questions(spark, d).select("query_id", F.explode(F.array(*[F.lit(x) for x in (1, 5, 99)])).alias("rank"))
    return grading.linked_citations(named, own).select("query_id", "rank", "doc_id")


@query("evidence_merge", f"""with {corpus.evidence_sql(20)}, h as (select query_id, doc_id, rank as held_rank, 0.5 as coverage from evidence where rank <= 5), n as (select query_id, doc_id, rank as position, 0.4 + (rank % 3) / 10.0 as coverage from evidence where rank between 3 and 12),
    m as (select query_id, doc_id, held_rank, position, case when h.coverage is null then n.coverage when n.coverage is null then h.coverage else greatest(h.coverage, n.coverage) end as coverage from h full join n using (query_id, doc_id)),
    r as (select *, coalesce(held_rank, coalesce(max(held_rank) over (partition by query_id), 0) + row_number() over (partition by query_id order by held_rank is not null, position, cast(doc_id as varchar))) as rank from m)
    select query_id, doc_id, rank, round(coverage, 6) as coverage from r where rank <= 10""")
def _(spark, d):
    e = corpus.candidates(spark, d, 20).withColumn("need_id", F.lit("n"))
    held = e.where("rank <= 5").select("query_id", "need_id", "doc_id", F.lit(0.5).alias("coverage"), F.col("rank").cast("int").alias("rank"))
    found = e.where("rank between 3 and 12").select("query_id", "need_id", "doc_id", F.col("rank").alias("position"), (F.lit(0.4) + (F.col("rank") % 3) / 10).alias("coverage"))
    return _told(pipelines.merge_evidence(held, found, 10), F.round("coverage", 6).alias("coverage"))


@query("evidence_pruning", f"with {corpus.evidence_sql(20)} select query_id, doc_id from evidence where rank % 4 = 1 or rank % 6 = 2")
def _(spark, d):
    e = corpus.candidates(spark, d, 20).withColumn("key", F.col("doc_id"))
    approved = e.select("query_id", "key", F.explode(F.array_compact(F.array(F.when(F.col("rank") % 4 == 1, "a"), F.when(F.col("rank") % 6 == 2, "b")))).alias("need_id"))
    return state.prune_evidence(e, approved)[1].select("query_id", "doc_id")


@query("trace_steps", "select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as step from events")
def _(spark, d):
    return state.number_steps(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", F.col("step").cast("long").alias("step"))


@query("text_cuts", """select doc_id, sha256(case when length(text) <= 300 then text else rtrim(substr(text, 1, 147)) || ' [...] ' || ltrim(right(text, 146)) end) as middle,
    sha256(case when length(text) <= 300 then text else rtrim(case when length(s) >= 150 then s when w <> '' then w else h end) end) as sentence
    from (select doc_id, text, h, regexp_extract(h, '(?s)^(.*[.!?])(?:\\s|$)', 1) as s, regexp_extract(h, '(?s)^(.*\\S)\\s', 1) as w from (select doc_id, text, substr(text, 1, 300) as h from documents))""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(state.middle_cut(F.col("text"), 300), 256).alias("middle"), F.sha2(state.sentence_cut(F.col("text"), 300), 256).alias("sentence"))


@query("redacted_settings", "select doc_id, case when doc_id % 2 = 0 then 'model,topK' else 'model,tokenizer,topK' end as kept from documents")
def _(spark, d):
    first = F.create_map(*[F.lit(x) for x in ("model", "a", "apiKey", "b", "topK", "5", "db_password", "c")])
    second = F.create_map(*[F.lit(x) for x in ("model", "a", "accessToken", "b", "tokenizer", "t", "topK", "5", "Authorization", "z")])
    kept = F.map_keys(state.redacted(F.when(F.col("doc_id") % 2 == 0, first).otherwise(second)))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(kept), ",").alias("kept"))


@query("collection_faults", "select 'unknown' as name, 64 as size, count(*) as n from embeddings where vec_id % 3 = 0")
def _(spark, d):
    held = table(spark, d, "embeddings").select(F.when(F.col("vec_id") % 3 == 0, F.create_map(F.lit("unknown"), "embedding")).otherwise(F.create_map(F.lit("chunk"), "embedding")).alias("vectors"))
    return state.collection_faults(held, {"chunk": 64, "summary": 64})


@query("source_context", f"with {corpus.VERSIONS_SQL} select doc_id, concat_ws('|', 'document=' || title, 'version=' || version_number, 'published=' || strftime(published_at, '%Y-%m-%d'), 'uploaded=' || strftime(uploaded_at, '%Y-%m-%d')) as context from versions")
def _(spark, d):
    told = state.source_context(F.col("title"), F.col("filename"), F.col("version_number"), F.col("published_at"), F.col("uploaded_at"), True, True)
    return corpus.versions(spark, d).select("doc_id", F.array_join(F.transform(told, lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|").alias("context"))


@query("merged_phrase", """select item_id as query_id, 'report about ' || array_to_string(string_split(text, ' ')[:3], ' ') || ' ' || 'Gamma delta' as phrase from benchmark""")
def _(spark, d):
    base = F.concat(F.lit("report about "), F.array_join(F.slice(F.split("text", " "), 1, 3), " "))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), state.merged_phrase(base, F.lit("the Report of Gamma delta gamma about"), ("the", "of", "gamma2")).alias("phrase"))


@query("attempt_summary", "select user_id as query_id, count(*) - 1 as n_retries, arg_max(event_type, event_id) as last_status, count(distinct event_type) > 1 as query_changed, sum(event_id % 3)::bigint as n_lookups from events group by 1")
def _(spark, d):
    a = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("attempt"), F.col("event_type").alias("query"), F.col("event_type").alias("status"), (F.col("event_id") % 3).alias("n_lookups"))
    return state.attempt_summary(a)


@query("attempt_faults", "select user_id as query_id, 'added_more_than_retrieved' as faults from events group by 1 having bool_or(event_id % 10 = 0)")
def _(spark, d):
    from pyspark.sql.window import Window

    e = table(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    a = e.select(F.col("user_id").alias("query_id"), F.lit("n").alias("need_id"), n.alias("attempt"), F.array(F.lit(1), F.lit(2)).alias("ranks"), F.lit(2).alias("n_retrieved"), F.when(F.col("event_id") % 10 == 0, 3).otherwise(2).alias("n_added"), F.lit("supported").alias("status"), F.lit(0.5).alias("score"))
    return state.attempt_faults(a).select("query_id", F.array_join("faults", ",").alias("faults"))


@query("unresolved_notes", f"with {evidence.GRADES_SQL} select query_id, string_agg('- ' || need_id, chr(10) order by need_id) filter (required and status <> 'supported') as notes from ng group by 1")
def _(spark, d):
    _, needs, pairs = evidence._graded(spark, d)
    return grading.unresolved_notes(grading.need_grades(needs, pairs).withColumn("need", F.col("need_id")))
