"""Constraints by question: each row's own rules against the rules for one constraint, retrieval inside scopes, the second scan."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from attestor.operators import scopes, versions
from attestor.operators.scopes import Scopes
from attestor.operators.versions import Constraints
from attestor.plans import pipelines
from attestor.plans.pipelines import Corpus, Plan

DAY = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
SCOPES = {
    1: Constraints(),
    2: Constraints(mode="latest"),
    3: Constraints(names=("Guide.pdf", "NOTES")),
    4: Constraints(mode="specific", versions=(1, 3)),
    5: Constraints(mode="latest", published=(DAY(2), DAY(9))),
    6: Constraints(mode="all_except_latest", any_recorded=(None, DAY(8))),
    7: Constraints(mode="oldest_and_latest", uploaded=(DAY(3), None)),
    8: Constraints(mode="previous"),
    9: Constraints(mode="latest_and_previous", names=("guide",)),
    10: Constraints(mode="oldest"),
    11: Constraints(mode="all"),
    12: Constraints(mode="oldest", published=(DAY(1), None)),
}


@pytest.fixture(scope="module")
def documents(spark):
    r = random.Random(4)
    rows = []
    for i in range(60):
        name = ["guide", "notes", "plan"][i % 3]
        version = i // 3 % 5 + 1
        rows.append((i, f"{name} number {r.randint(1, 6)} tells about {r.choice(['wind', 'rain', 'sun'])} and {r.choice(['trees', 'rivers'])}", name, None if i % 11 == 0 else version, version == 5,
                     None if i % 7 == 0 else DAY(r.randint(0, 12)), DAY(r.randint(0, 12)), name.upper(), f"dir/{name}.pdf"))
    return spark.createDataFrame(rows, "doc_id long, text string, document_id string, version_number int, is_latest boolean, published_at timestamp, uploaded_at timestamp, title string, filename string").cache()


@pytest.fixture(scope="module")
def table(spark):
    return scopes.scope_table(spark, [((k,), c) for k, c in SCOPES.items()], "query_id long")


def ids(df):
    return sorted((r.query_id, r.doc_id) for r in df.select("query_id", "doc_id").collect())


def test_each_row_follows_its_own_scope(spark, documents, table):
    questions = spark.createDataFrame([(k,) for k in SCOPES], "query_id long")
    evidence = questions.crossJoin(documents.drop("text")).withColumn("rank", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("query_id").orderBy(F.xxhash64("doc_id", "query_id")))).cache()
    got = scopes.constrain(evidence, scopes.complete(table, questions), scopes.facts(documents)).cache()
    for k, c in SCOPES.items():
        want = versions.constrain(evidence.where(F.col("query_id") == k), c)
        assert sorted((r.doc_id, r["rank"]) for r in got.where(F.col("query_id") == k).collect()) == sorted((r.doc_id, r["rank"]) for r in want.collect()), c


def test_store_and_tiles_admit_the_same(spark, documents, table):
    questions = spark.createDataFrame([(k,) for k in SCOPES], "query_id long")
    own = Scopes(scopes.complete(table, questions), scopes.facts(documents))
    pairs = questions.crossJoin(documents.select("doc_id"))
    want = ids(own.inside(pairs))
    for k, c in SCOPES.items():
        assert [d for q, d in want if q == k] == sorted(r.doc_id for r in documents.where(versions.pushdown(c)).collect()), c
    p = own.points(documents.select("doc_id")).toPandas()
    found = []
    for q in own.questions(questions).toPandas().to_dict("records"):
        found += [(q["query_id"], d) for d in p["doc_id"][scopes.admitted_rows(p, q)]]
    assert sorted(found) == want


def test_inheritance_field_by_field(spark):
    own = scopes.scope_table(spark, [((1, "a"), Constraints()), ((1, "b"), Constraints(names=("own",), published=(DAY(1), None))), ((1, "c"), Constraints(mode="specific", versions=(7,))), ((2, "a"), Constraints(mode="oldest"))], "query_id long, need_id string")
    parent = scopes.scope_table(spark, [((1,), Constraints(names=("theirs",), mode="latest", uploaded=(DAY(3), DAY(4))))], "query_id long")
    got = {(r.query_id, r.need_id): r for r in scopes.inherited(own, parent).collect()}
    a, b, c, other = got[1, "a"], got[1, "b"], got[1, "c"], got[2, "a"]
    assert (a["names"], a["mode"], a.uploaded.start) == (["theirs"], "latest", DAY(3))
    assert (b["names"], b["mode"], b.published.start, b.uploaded) == (["own"], "latest", DAY(1), None)  # dates go together
    assert (c["names"], c["mode"], c["versions"], c.uploaded.end) == (["theirs"], "specific", [7], DAY(4))
    assert (other["names"], other["mode"]) == ([], "oldest")


def test_questions_without_scope_and_unknown_modes(spark, table):
    asked = spark.createDataFrame([(2,), (99,), (None,)], "query_id long")
    told = {r.query_id: r for r in scopes.complete(table, asked).withColumn("active", scopes.active()).collect()}
    assert told[2].active and told[2]["mode"] == "latest" and not told[99].active and (told[99]["mode"], told[99]["names"]) == ("none", []) and not told[None].active
    with pytest.raises(PySparkException, match="unknown version mode newer"):
        scopes.complete(table.withColumn("mode", F.lit("newer")), asked).collect()


@pytest.fixture(scope="module")
def corpus(spark, documents):
    points = pipelines.hash_vectors(documents.select("doc_id", "text")).cache()
    sections = documents.select("doc_id", F.concat_ws(":", "document_id", (F.col("doc_id") % 2).cast("string")).alias("section_id"), "document_id")
    return Corpus(documents, points, sections=sections, contextual=documents.select("doc_id", F.concat_ws(" ", "title", "text").alias("text")))


@pytest.mark.parametrize("name", sorted(pipelines.PIPELINES))
def test_every_pipeline_stays_inside_scopes(spark, corpus, documents, table, name):
    questions = spark.createDataFrame([(k, "What do the notes and the guide tell about rain, and how do rivers grow?") for k in (1, 2, 3, 5)], "query_id long, question string")
    found = pipelines.execute(corpus, questions, Plan(name, 4), table).cache()
    rows = {r.query_id: r for r in found.collect()}
    assert set(rows) == {1, 2, 3, 5} and found.groupBy("query_id", "rank").count().where("count > 1").isEmpty()
    by = {k: found.where(F.col("query_id") == k) for k in rows}
    assert by[2].where("version_number < 5").isEmpty() and by[3].where("document_id = 'plan'").isEmpty()
    assert by[5].where((F.col("published_at") < F.lit(DAY(2))) | (F.col("published_at") >= F.lit(DAY(9)))).isEmpty() and by[1].count() == 4


def test_alone_or_together_is_the_same(spark, corpus, table):
    questions = spark.createDataFrame([(k, "guide and notes on wind and rivers") for k in SCOPES], "query_id long, question string")
    got = pipelines.execute(corpus, questions, Plan("hybrid", 5), table).cache()
    for k in (2, 4, 5, 8, 12):
        want = pipelines.execute(corpus, questions.where(F.col("query_id") == k), Plan("hybrid", 5, SCOPES[k]))
        assert sorted((r["rank"], r.doc_id) for r in got.where(F.col("query_id") == k).collect()) == sorted((r["rank"], r.doc_id) for r in want.collect()), SCOPES[k]


def test_second_scan_only_where_stored_names_find_nothing(spark, corpus, documents):
    older = documents.withColumn("title_normalized", F.when(F.col("document_id") == "guide", "guide"))
    own = Corpus(older, corpus.points)
    asked = spark.createDataFrame([(1, "rain"), (2, "rain"), (3, "rain"), (4, "rain")], "query_id long, question string")
    table = scopes.scope_table(spark, [((1,), Constraints(names=("guide",))), ((2,), Constraints(names=("notes.pdf",))), ((3,), Constraints(names=("nothing of the kind",)))], "query_id long")
    rows = pipelines.execute(own, asked, Plan("baseline", 3), table).collect()
    told = {(r.query_id, r.document_id, r.fallback_scan) for r in rows if r.query_id != 4}
    assert told == {(1, "guide", False), (2, "notes", True)} and {r.fallback_scan for r in rows if r.query_id == 4} == {False}


def test_plan_constraints_are_a_default(spark, corpus):
    asked = spark.createDataFrame([(1, "rain"), (2, "rain")], "query_id long, question string")
    table = scopes.scope_table(spark, [((1,), Constraints(mode="specific", versions=(2,)))], "query_id long")
    rows = pipelines.execute(corpus, asked, Plan("baseline", 5, Constraints(names=("plan",), mode="latest")), table).collect()
    assert {(r.query_id, r.document_id) for r in rows} == {(1, "plan"), (2, "plan")}
    assert {r.version_number for r in rows if r.query_id == 1} == {2} and {r.is_latest for r in rows if r.query_id == 2} == {True}


def test_preferred_document_gets_its_quota(spark, corpus):
    asked = spark.createDataFrame([(1, "rain and rivers"), (2, "rain and rivers")], "query_id long, question string")
    first = spark.createDataFrame([(1, "plan")], "query_id long, document_key string")
    rows = pipelines.execute(corpus, asked, Plan("baseline", 5, balance=True), None, first).collect()
    assert sum(r.document_id == "plan" for r in rows if r.query_id == 1) >= 3 and len(rows) == 10


def test_validation_by_row(spark, documents, table):
    questions = spark.createDataFrame([(k,) for k in (1, 2, 8, 10, 11, 12)], "query_id long")
    hits = questions.crossJoin(documents.where("doc_id between 11 and 14").select("doc_id"))
    hits = hits.unionByName(spark.createDataFrame([(4, 1)], "query_id long, doc_id long"))
    own = scopes.complete(table, questions.unionByName(spark.createDataFrame([(3,), (4,)], "query_id long")))
    kept, report = scopes.validated(hits, own, scopes.facts(documents))
    told = {r.query_id: (r.n_candidates, r.n_matched, r.status) for r in report.collect()}
    versions_of = {r.doc_id: (r.version_number, r.is_latest, r.published_at) for r in documents.where("doc_id between 11 and 14").collect()}
    assert told[1] == (4, 4, "not_requested") and told[3] == (0, 0, "no_match") and told[4] == (1, 1, "matched")
    assert told[2][1] == sum(latest for _, latest, _ in versions_of.values()) and told[8][1] == sum(not latest for _, latest, _ in versions_of.values())
    assert told[10][1] == sum(v == 1 for v, _, _ in versions_of.values())
    assert told[12][1] == sum(v is not None and p is not None and p >= DAY(1) for v, _, p in versions_of.values())
    assert kept.count() == sum(t[1] for t in told.values())


def test_scopes_of_wording(spark):
    now = datetime(2026, 7, 18, 12, tzinfo=timezone.utc)
    asked = spark.createDataFrame([(1, "Use the latest version of the Finance report, uploaded since May 2026"), (2, "Compare version 2 with v4"), (3, "How does it work?"), (4, None)], "query_id long, question string")
    told = {r.query_id: r for r in scopes.complete(scopes.detected(asked, now), asked).withColumn("active", scopes.active()).collect()}
    assert (told[1]["mode"], told[1]["names"], told[1].uploaded.start, told[1].uploaded.end) == ("latest", ["finance"], datetime(2026, 5, 1), None)
    assert (told[2]["mode"], told[2]["versions"]) == ("specific", [2, 4]) and not told[3].active and not told[4].active


def test_empty_questions(spark, corpus, table):
    none = spark.createDataFrame([], "query_id long, question string")
    assert pipelines.execute(corpus, none, Plan("hybrid", 3), table).count() == 0
