"""Plans, rounds of needs, scopes and checks on small tables with fixed expectations."""

from datetime import datetime, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import grading, hierarchy, lexical, selection, state, understanding, vectors, versions
from attestor.operators.versions import Constraints
from attestor.plans import pipelines

NOW = datetime(2026, 7, 18, 12, tzinfo=timezone.utc)
utc = lambda *a: datetime(*a, tzinfo=timezone.utc)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "name, want",
    [("'report.pdf'", "report"), ("“Annual Plan.docx”", "annual plan"), ("`a/b/Draft_4.md`", "draft 4"), ('"x', "x"), ("it's", "it s"), ("''", ""), ("Report.PDF", "report"), (" ' y.txt ' ", "y")],
)
def test_names_in_quotes(spark, name, want):
    assert one(spark, T.document_name, name) == want


def test_names_of_all_columns(spark):
    row = spark.createDataFrame([("draft 4", None, "Draft_4.pdf", "'Other'", " ")], "title_normalized string, filename_normalized string, title string, filename string, source_name string")
    names = row.select(T.known_names([F.col("title_normalized"), F.col("filename_normalized")], [F.col("title"), F.col("filename"), F.col("source_name")])).first()[0]
    assert sorted(names) == ["draft 4", "other"]
    assert row.where(versions.name_predicate(("OTHER.txt",), ("title_normalized", "title", "filename"))).count() == 1


@pytest.mark.parametrize(
    "question, scope",
    [
        ("files uploaded from March 2024 onwards", ("uploaded_at", utc(2024, 3, 1), None)),
        ("uploaded from 2024-01-02 to 2024-02-03", ("uploaded_at", utc(2024, 1, 2), utc(2024, 2, 4))),
        ("indexed today", ("uploaded_at", utc(2026, 7, 18), utc(2026, 7, 19))),
        ("published last year", ("published_at", utc(2025, 1, 1), utc(2026, 1, 1))),
        ("published in June", ("published_at", utc(2026, 6, 1), utc(2026, 7, 1))),
        ("published in August", ("published_at", utc(2025, 8, 1), utc(2025, 9, 1))),
        ("dated 3-4-2024", ("published_at", utc(2024, 4, 3), utc(2024, 4, 4))),
        ("written between Jan 2023 and March 2023", ("published_at", utc(2023, 1, 1), utc(2023, 4, 1))),
        ("issued until 5 Feb 2024", ("published_at", None, utc(2024, 2, 6))),
        ("published prior to 2020", ("published_at", None, utc(2020, 1, 1))),
        ("added after 31 December 2024", ("uploaded_at", utc(2025, 1, 1), None)),
        ("What happened in 2024?", None),
    ],
)
def test_more_date_scopes(question, scope):
    assert understanding.date_scope(question, NOW) == scope


def test_names_and_scopes_as_columns(spark):
    asked = spark.createDataFrame([(1, "Use the latest version of the Finance report, uploaded since May 2026"), (2, "What changed in plan_v4?"), (3, "according to the relevant document, what"), (4, None), (5, "Search in the manual named Blue Ocean Guide for x")], "query_id int, question string")
    found = {r.query_id: r for r in understanding.question_scopes(asked, NOW).collect()}
    assert [found[i].names for i in range(1, 6)] == [["Finance"], ["plan_v4"], [], [], ["Blue Ocean Guide"]]
    assert found[1].field == "uploaded_at" and found[1].start == datetime(2026, 5, 1) and found[1].end is None and found[4].field is None
    assert understanding.question_scopes(asked.where("false"), NOW).count() == 0


def test_nearest_without_the_question_itself(spark):
    points = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(9, [0.0, 0.0]), (10, None)], "doc_id int, vector array<double>")
    asked = points.where("doc_id in (2, 9)").withColumnRenamed("doc_id", "query_id")
    found = vectors.knn_topk(points, asked, 3, same=False).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == 2] == [3, 4, 5]
    assert vectors.knn_topk(points.where("false"), asked, 3).count() == 0 == vectors.knn_topk(points, asked.where("false"), 3).count()


def test_tiles_give_what_one_tile_gives(spark, monkeypatch):
    points = spark.range(40).selectExpr("id as doc_id", "array(cast(id % 7 as double), cast(id % 5 as double), 1d) as vector")
    asked = points.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "query_id")
    want = sorted(tuple(r) for r in vectors.knn_topk(points, asked, 4).select("query_id", "doc_id", "rank").collect())
    monkeypatch.setattr(vectors, "TILE", 6)
    assert sorted(tuple(r) for r in vectors.knn_topk(points, asked, 4).select("query_id", "doc_id", "rank").collect()) == want


def test_groups_are_numbered_by_their_first_chunk(spark):
    chunks = spark.createDataFrame([("d", i, v) for i, v in enumerate([[1.0, 0.0], [0.95, 0.05], [0.0, 1.0], [0.05, 0.95]])] + [("e", i, [float(i), 1.0]) for i in range(10)], "document_version_id string, ordinal int, vector array<double>")
    found = hierarchy.group_chunks(chunks.where("document_version_id = 'd'"), 2, 4).orderBy("ordinal").collect()
    assert [r.cluster for r in found] == [0, 0, 1, 1]
    groups = {}
    for r in hierarchy.group_chunks(chunks.where("document_version_id = 'e'"), 2, 3).collect():
        groups.setdefault(r.cluster, []).append(r.ordinal)
    assert len(groups) <= 3 and sorted(sum(groups.values(), [])) == list(range(10))
    firsts = [min(groups[c]) for c in sorted(groups)]
    assert firsts == sorted(firsts)


def test_arbitration_needs_every_rank(spark):
    prior = spark.createDataFrame([("q", 1, 0.5, True, ["n"]), ("q", 2, 0.5, True, ["n"])], "query_id string, rank int, relevance double, relevant boolean, supports array<string>")
    assert grading.arbitrate(prior, prior).count() == 2
    with pytest.raises(PySparkException, match="no proposal for rank 2"):
        grading.arbitrate(prior, prior.where("rank = 1")).collect()
    assert [r["rank"] for r in grading.missing_ranks(prior, prior.where("rank = 1")).collect()] == [2]


def test_chunks_and_contexts_belong_together(spark):
    chunks = spark.createDataFrame([("v", 0, "h0"), ("v", 1, "h1")], "document_version_id string, ordinal int, content_hash string")
    contexts = chunks.withColumn("contextualized_text", F.concat(F.lit("about "), "content_hash"))
    assert [r.contextualized_text for r in state.with_context(chunks, contexts).orderBy("ordinal").collect()] == ["about h0", "about h1"]
    for wrong in (contexts.where("ordinal = 0"), contexts.withColumn("content_hash", F.lit("x")), contexts.unionByName(contexts)):
        with pytest.raises(PySparkException):
            state.with_context(chunks, wrong).collect()
    faults = state.integrity_faults(chunks, contexts.where("ordinal = 0").unionByName(contexts.withColumn("ordinal", F.lit(7)).limit(1))).first()
    assert (faults.n_chunks, faults.n_missing, faults.n_extra, faults.n_changed) == (2, 1, 1, 0)


def test_inherited_constraints_and_their_description():
    question = Constraints(names=("a",), mode="latest", published=(datetime(2024, 1, 1), None))
    assert versions.inherited(None, question) == question
    told = versions.inherited(Constraints(mode="specific", versions=(2,)), question)
    assert (told.names, told.mode, told.versions, told.published) == (("a",), "specific", (2,), question.published)
    assert versions.describe(question) == "documents named a; versions: latest; published from 2024-01-01" and versions.describe(Constraints()) == "no restriction"


def corpus(spark, **changes):
    rows = [(1, "alpha pipeline flows are listed", "d1", 1), (2, "alpha pipeline flows are listed again", "d1", 2), (3, "the beta function", "d2", 1), (4, "nothing at all", "d3", 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, document_id string, version_number int").withColumn("is_latest", F.col("doc_id") != 1)
    docs = docs.withColumns({"published_at": F.lit("2024-01-01").cast("timestamp"), "uploaded_at": F.lit("2024-02-01").cast("timestamp"), "title": F.col("document_id"), "filename": F.col("document_id")})
    return pipelines.Corpus(**({"documents": docs, "points": pipelines.hash_vectors(docs)} | changes))


def test_a_plan_filters_before_it_retrieves(spark):
    asked = spark.createDataFrame([(1, "alpha pipeline flows")], "query_id int, question string")
    for name in pipelines.PIPELINES:
        every = pipelines.execute(corpus(spark), asked, pipelines.Plan(name, 2)).collect()
        latest = pipelines.execute(corpus(spark), asked, pipelines.Plan(name, 2, Constraints(mode="latest"), rerank=True)).collect()
        assert len(every) == 2 and 1 not in {r.doc_id for r in latest} and 2 in {r.doc_id for r in latest}, name
    with pytest.raises(ValueError):
        pipelines.Plan("no such pipeline")


def test_hierarchy_falls_back_to_all_chunks(spark):
    asked = spark.createDataFrame([(1, "alpha pipeline flows")], "query_id int, question string")
    sections = spark.createDataFrame([(1, "d1:0", "d1"), (2, "d1:0", "d1")], "doc_id int, section_id string, document_id string")
    routed = pipelines.hierarchical(corpus(spark, sections=sections), asked, 4).collect()
    assert {r.doc_id for r in routed} == {1, 2}
    fallen = pipelines.hierarchical(corpus(spark, sections=sections.where("false")), asked, 4).collect()
    assert len(fallen) == 4


def test_providers_plug_in(spark):
    asked = spark.createDataFrame([(1, "alpha pipeline flows")], "query_id int, question string")
    own = pipelines.Providers(score=lambda q, t: F.when(F.contains(t, F.lit("nothing")), 1.0).when(F.contains(t, F.lit("beta")), F.lit(None)).otherwise(0.1))
    found = pipelines.rerank(corpus(spark, providers=own), asked, 4).orderBy("rank").collect()
    assert found[0].doc_id == 4 and found[-1].doc_id == 3


def test_rounds_resolve_many_needs(spark):
    needs = spark.createDataFrame([(1, "need_1", "alpha pipeline flows"), (1, "need_2", "zeta omega kappa"), (2, "need_1", "beta function")], "query_id int, need_id string, need string")
    states, evidence = pipelines.resolve_needs(corpus(spark), needs, pipelines.Limits(attempts=2))
    told = {(r.query_id, r.need_id): (r.status, r.attempts) for r in states.collect()}
    assert told == {(1, "need_1"): ("supported", 1), (1, "need_2"): ("exhausted", 2), (2, "need_1"): ("supported", 1)}
    assert {(r.query_id, r.doc_id) for r in evidence.collect()} == {(1, 1), (1, 2), (2, 3)}
    none, nothing = pipelines.resolve_needs(corpus(spark), needs.where("false"))
    assert none.count() == 0 == nothing.count()
    held, _ = pipelines.resolve_needs(corpus(spark), needs, pipelines.Limits(attempts=3, attempts_in_all=1))
    assert {(r.query_id, r.need_id): r.attempts for r in held.collect()} == {(1, "need_1"): 1, (1, "need_2"): 0, (2, "need_1"): 1}


def test_merged_evidence_keeps_its_ranks(spark):
    held = spark.createDataFrame([(1, "n", 5, 0.5, 1), (1, "n", 6, 0.6, 2)], "query_id int, need_id string, doc_id int, coverage double, rank int")
    found = spark.createDataFrame([(1, "n", 6, 1, 0.9), (1, "n", 7, 3, 0.4), (1, "n", 8, 2, 0.4)], "query_id int, need_id string, doc_id int, position int, coverage double")
    assert sorted((r.doc_id, r.coverage, r["rank"]) for r in pipelines.merge_evidence(held, found, 3).collect()) == [(5, 0.5, 1), (6, 0.9, 2), (8, 0.4, 3)]


def test_an_evaluation_is_one_report(spark, tmp_path):
    cases = spark.createDataFrame([(1, "alpha pipeline flows"), (2, "beta function")], "case_id int, question string")
    expected = spark.createDataFrame([(1, 0, "d1", ["alpha"]), (2, 0, "d2", ["BETA  function"]), (2, 1, "d9", ["x"])], "case_id int, expectation_id int, document_id string, fragments array<string>")
    per, report = pipelines.evaluate(corpus(spark), cases, expected, pipelines.Plan("hybrid", 3), (1, 3))
    assert {(r.case_id, r.metric): r.value for r in per.collect()}[2, "recall_at_3"] == 0.5
    pipelines.write_report(report, str(tmp_path / "report"))
    assert {r.metric: r.n for r in spark.read.json(str(tmp_path / "report")).collect()} == {"recall_at_1": 2, "recall_at_3": 2, "reciprocal_rank": 2}


def test_an_index_scores_as_the_documents_do(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None), (4, "")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "b"), (2, "zzz")], "query_id int, question string")
    index = lexical.build_index(docs)
    assert index.size.first().n == 4 and index.size.first().mean_length == 1.25
    assert [(r.doc_id, r["rank"]) for r in lexical.bm25_topk(index, asked).orderBy("rank").collect()] == [(r.doc_id, r["rank"]) for r in lexical.bm25_topk(docs, asked).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert lexical.bm25_topk(docs.where("false"), asked).count() == 0


def test_cuts_and_checks(spark):
    assert one(spark, lambda c: state.middle_cut(c, 20), "abcdefghij klmnopqrst uvwxyz") == "abcdefg [...] uvwxyz"
    assert one(spark, lambda c: state.sentence_cut(c, 12), "One two. Three four five") == "One two."
    assert one(spark, lambda c: state.sentence_cut(c, 12), "abcdefg hijklmnop") == "abcdefg"
    settings = spark.createDataFrame([({"apiKey": "x", "model": "m", "maxTokens": "5", "refresh_token": "t"},)], "s map<string,string>").select(state.redacted(F.col("s"))).first()[0]
    assert settings == {"model": "m", "maxTokens": "5"}
    bad = spark.createDataFrame([(1, "n", 1, [1, 1], 2, 3, "supported", 1.5), (1, "n", 3, [], 2, 1, "supported", 0.5)], "query_id int, need_id string, attempt int, ranks array<int>, n_retrieved int, n_added int, status string, score double")
    assert state.attempt_faults(bad).first().faults == ["attempts_not_in_sequence", "ranks_not_unique", "added_more_than_retrieved", "score_out_of_range", "supported_without_evidence"]
    rows = spark.createDataFrame([("q", 1, 0.2), ("q", 2, None), ("q", 3, 0.9)], "query_id string, rank int, rerank_score double")
    assert [(r.original_rank, r.fallback) for r in selection.rerank(rows).orderBy("rank").collect()] == [(3, False), (1, False), (2, True)]
