"""From questions to answers on a small corpus: rounds, decisions, arbitration, scopes, budgets and gates."""

import pytest
from pyspark.sql import functions as F

from attestor.operators import scopes
from attestor.operators.versions import Constraints
from attestor.plans import agent, pipelines
from attestor.plans.agent import Agent, answer
from attestor.plans.pipelines import Corpus, Limits

DOCS = [
    (1, "Solar panels convert sunlight into electric current. They need little care.", "energy", 1, False),
    (2, "Solar panels convert sunlight to current with new cells.", "energy", 2, True),
    (3, "Wind turbines turn moving air into electric current.", "wind", 1, True),
    (4, "Bread needs flour, water, salt and yeast.", "kitchen", 1, True),
    (5, "", "empty", 1, True),
    (6, "Glaciers store fresh water for centuries.", "ice", 1, True),
]
QUESTIONS = [(1, "How do solar panels convert sunlight and what do wind turbines turn into current?"), (2, "Which quasars orbit zebras?"), (3, "Bread flour salt yeast?")]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([(*d, None, None, d[2].title(), f"{d[2]}.md") for d in DOCS], "doc_id long, text string, document_id string, version_number int, is_latest boolean, published_at timestamp, uploaded_at timestamp, title string, filename string").cache()
    return Corpus(docs, pipelines.hash_vectors(docs.select("doc_id", "text")).cache())


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id long, question string").cache()


def no_scope(spark):
    return scopes.scope_table(spark, [], "query_id long")


def by_id(df):
    return {r.query_id: r for r in df.collect()}


WAY = Agent(limits=Limits(top_k=2, attempts=2), strategies=("hybrid", "baseline"))


@pytest.fixture(scope="module")
def told(spark, corpus, questions):
    return answer(corpus, questions, WAY, own=no_scope(spark))


def test_outcomes(told):
    out = by_id(told.outcomes)
    assert (out[1].outcome, out[1].status, out[1].n_needs, out[1].complete) == ("complete", "sufficient", 2, True)
    assert (out[2].outcome, out[2].status, out[2].answer) == ("blocked_insufficient_evidence", "missing", agent.BLOCKED["blocked_insufficient_evidence"])
    assert (out[3].outcome, out[3].supported) == ("complete", ["need_1"]) and "Bread needs flour" in out[3].answer and "[1]" in out[3].answer
    assert out[1].n_attempts == 2 and out[2].n_attempts == 2


def test_rounds_follow_the_transitions(told):
    log = {(r.query_id, r.need_id, r["round"]): r for r in told.attempts.collect()}
    assert [log[2, "need_1", n].action for n in (1, 2)] == ["retry", "complete_exhausted"] and log[2, "need_1", 2].reason == "information_need_attempt_limit_reached"
    assert log[2, "need_1", 1].top_k == 2 and log[2, "need_1", 2].top_k == 4 and log[2, "need_1", 1].strategy != log[2, "need_1", 2].strategy
    assert log[3, "need_1", 1].action == "complete_supported" and (3, "need_1", 2) not in log


def test_evidence_citations_and_context(told):
    evidence = {(r.query_id, r["rank"]): r for r in told.evidence.collect()}
    assert evidence[3, 1].doc_id == 4 and not any(q == 2 for q, _ in evidence)
    cited = {(r.query_id, r["rank"]): r.doc_id for r in told.citations.collect()}
    assert cited[3, 1] == 4 and all(evidence[k].doc_id == v for k, v in cited.items())
    context = by_id(told.context)
    assert context[3].context.startswith("[1] Kitchen\nBread needs flour") and set(context) == {1, 3}


def test_context_takes_whole_blocks_that_fit(spark):
    rows = spark.createDataFrame([(1, 1, "T", "a" * 10), (1, 2, None, "b" * 10), (1, 3, "U", "c" * 10), (2, 1, "T", "d" * 100)], "query_id long, rank int, title string, text string")
    got = by_id(agent.evidence_context(rows, 34))
    assert got[1].context == "[1] T\n" + "a" * 10 + "\n\n[2] \n" + "b" * 10 and got[1].n_in_context == 2 and 2 not in got


def test_scopes_of_questions_and_needs(spark, corpus, questions):
    own = scopes.scope_table(spark, [((1,), Constraints(mode="latest")), ((3,), Constraints(names=("wind",)))], "query_id long")
    needs = spark.createDataFrame([(1, "a", "solar panels sunlight", True), (1, "b", "solar panels sunlight care", False), (3, "a", "bread flour", True)], "query_id long, need_id string, need string, required boolean")
    need_scopes = scopes.scope_table(spark, [((1, "b"), Constraints(mode="specific", versions=(1,)))], "query_id long, need_id string")
    told = answer(corpus, questions.where("query_id <> 2"), WAY, needs, own, need_scopes)
    links = {(r.query_id, r.need_id): r for r in told.needs.collect()}
    docs = {(r.query_id, r["rank"]): r.doc_id for r in told.evidence.collect()}
    assert {docs[1, k] for k in links[1, "a"].ranks} == {2} and {docs[1, k] for k in links[1, "b"].ranks} == {1}
    out = by_id(told.outcomes)
    assert out[1].outcome == "complete" and out[3].outcome == "blocked_insufficient_evidence"  # the wind document is in the scope but says nothing of bread
    checks = {(r.query_id, r.need_id, r["round"]): r.status for r in told.validation.collect()}
    assert checks[3, "a", 1] == "matched" and checks[1, "a", 1] == "matched"
    nothing = scopes.scope_table(spark, [((3,), Constraints(names=("no such document",)))], "query_id long")
    assert by_id(answer(corpus, questions.where("query_id = 3"), WAY, own=nothing).outcomes)[3].outcome == "blocked_constraint_no_match"


def test_arbiter_lowers_and_never_raises(spark, corpus, questions):
    def harsh(evidence):  # leaves the first rank of question 3 out, rejects all of question 1, approves what nobody did
        lowered = evidence.where("query_id = 1").select("query_id", "rank", (F.col("relevance") / 2).alias("relevance"), F.lit(False).alias("relevant"), "supports")
        return lowered.unionByName(evidence.sparkSession.createDataFrame([(2, 1, 1.0, True, ["need_1"])], lowered.schema))

    told = answer(corpus, questions, Agent(limits=WAY.limits, strategies=WAY.strategies, arbiter=harsh), own=no_scope(spark))
    out = by_id(told.outcomes)
    assert (out[1].status, out[1].outcome) == ("missing", "blocked_insufficient_evidence") and out[2].status == "missing" and out[3].outcome == "complete"
    assert {r.status for r in told.needs.where("query_id = 1").collect()} == {"missing"}


def test_partial_answers_name_what_is_missing(spark, corpus, questions):
    needs = spark.createDataFrame([(3, "a", "bread flour yeast", True), (3, "b", "quasars orbit zebras", True), (3, "c", "glaciers fresh water", False)], "query_id long, need_id string, need string, required boolean")
    out = by_id(answer(corpus, questions.where("query_id = 3"), WAY, needs, no_scope(spark)).outcomes)[3]
    assert out.outcome == "partial" and out.answer.endswith("Not found:\n- quasars orbit zebras") and out.coverage == pytest.approx(0.5)
    assert (out.supported, out.unresolved) == (["a", "c"], ["b"])


def test_budget_of_a_question_in_order_of_needs(spark, corpus, questions):
    needs = spark.createDataFrame([(2, f"n{i}", f"quasars zebras {i}", True) for i in range(4)], "query_id long, need_id string, need string, required boolean")
    told = answer(corpus, questions.where("query_id = 2"), Agent(limits=Limits(top_k=2, attempts=3, attempts_in_all=3), strategies=("baseline",)), needs, no_scope(spark))
    tried = {r.need_id: (r.attempts, r.resolution, r.reason) for r in told.needs.collect()}
    assert {k: v[0] for k, v in tried.items()} == {"n0": 1, "n1": 1, "n2": 1, "n3": 0}
    assert {v[1:] for v in tried.values()} == {("exhausted", "global_attempt_limit_reached")}


def test_low_confidence_is_classified_anew(spark, corpus, questions):
    def unsure(text):
        return F.lit("factual_lookup"), F.when(text.contains("Which quasars"), 0.9).otherwise(0.3)

    needs = spark.createDataFrame([(2, "a", "quasars", True), (2, "b", "zebras", True)], "query_id long, need_id string, need string, required boolean")
    told = answer(corpus, questions.where("query_id = 2"), Agent(limits=Limits(top_k=2, attempts=3), strategies=("rerank", "baseline"), classify=unsure), needs, no_scope(spark))
    log = {(r.need_id, r["round"]): r for r in told.attempts.collect()}
    assert [log["a", n].action for n in (1, 2, 3)] == ["reclassify", "retry", "complete_exhausted"]
    assert [log["a", n].strategy for n in (1, 2, 3)] == ["rerank", "baseline", "rerank"] and [log["a", n].top_k for n in (1, 2, 3)] == [2, 2, 4]
    assert {r.reclassified for r in told.needs.collect()} == {1}


def test_preference_follows_completed_needs(spark, corpus, questions):
    needs = spark.createDataFrame([(1, "a", "Wind turbines moving air electric current", True), (1, "b", "quasars", True)], "query_id long, need_id string, need string, required boolean")
    told = answer(corpus, questions.where("query_id = 1"), Agent(limits=WAY.limits, strategies=("baseline",), balance=True), needs, no_scope(spark))
    assert [r.document_key for r in told.preferred.collect()] == ["wind"]


def test_no_questions_and_no_needs(spark, corpus, questions):
    told = answer(corpus, questions.where("false"), WAY, own=no_scope(spark))
    assert all(t.count() == 0 for t in (told.outcomes, told.needs, told.evidence, told.citations, told.validation, told.attempts, told.context))
    needs = spark.createDataFrame([], "query_id long, need_id string, need string, required boolean")
    out = by_id(answer(corpus, questions.where("query_id = 3"), WAY, needs, no_scope(spark)).outcomes)[3]
    assert (out.outcome, out.n_needs, out.n_attempts) == ("blocked_insufficient_evidence", 0, 0)


def test_wrong_agents():
    with pytest.raises(ValueError, match="unknown strategies: magic"):
        Agent(strategies=("magic",))
    with pytest.raises(ValueError, match="at least one"):
        Agent(strategies=())
