"""The whole way from a table of questions to answers: needs in rounds, then aggregation, arbitration, context, gate and answer.

The states of all needs of all questions are one table. A round takes every open need that its question's budget allows, retrieves
by its strategy inside its scope, validates and grades what came, and joins the decision of each with the table of transitions,
which tells the next state. Nothing is done need by need on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.operators import grading, scopes, selection, state, understanding
from attestor.sources.scratch import materialise
from attestor.sources.tables import typed_union

from .pipelines import PIPELINES, Corpus, Limits, Plan, execute

#: What follows a decision: the need's status, whether its next attempt takes the next strategy and more rows, or a new classification.
TRANSITIONS = (
    ("retry", "pending", 1, 2, 0),
    ("reclassify", "pending", 0, 1, 1),
    ("complete_supported", "supported", 0, 1, 0),
    ("complete_exhausted", "exhausted", 0, 1, 0),
)
#: What is told instead of an answer.
BLOCKED = {
    "blocked_constraint_no_match": "No evidence lies inside what the question is restricted to.",
    "blocked_insufficient_evidence": "The evidence does not support an answer.",
    "blocked_no_evidence": "There is no evidence to answer from.",
}


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRANSITIONS), "action string, next_status string, steps int, widening int, reclassifications int")


def prior_grades(evidence: DataFrame) -> DataFrame:
    """The default arbiter: it proposes what the graders told."""
    return evidence.select("query_id", "rank", "relevance", "relevant", "supports")


def extracted(best: DataFrame, most: int = 240) -> DataFrame:
    """``(query_id, body)``: the default answer, a sentence of each need's best evidence (query_id, need_id, rank, text) with its rank."""
    line = F.concat(state.sentence_cut(F.trim(F.regexp_replace("text", r"\s+", " ")), most), F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("need_id", line.alias("line")))), lambda x: x["line"])
    return best.groupBy("query_id").agg(F.array_join(lines, "\n").alias("body"))


@dataclass(frozen=True)
class Agent:
    """How questions are worked through.

    ``strategies``: pipelines that may be used. ``classify``: a question's type and confidence. ``arbiter``: evidence (query_id, rank,
    text, relevance, relevant, supports) to proposals (without the text); ranks that it leaves out keep their grade. ``draft``: each
    need's best evidence to (query_id, body). ``context``: characters of evidence that a generator is given for a question.
    """

    limits: Limits = Limits()
    strategies: tuple[str, ...] = tuple(understanding.FALLBACKS)
    classify: Callable[[Column], tuple[Column, Column]] = understanding.classify
    arbiter: Callable[[DataFrame], DataFrame] = prior_grades
    draft: Callable[[DataFrame], DataFrame] = extracted
    balance: bool = False
    reclassifications: int = 1
    context: int = 12_000

    def __post_init__(self):
        if unknown := set(self.strategies) - set(PIPELINES):
            raise ValueError(f"unknown strategies: {', '.join(sorted(unknown))}")
        if not self.strategies:
            raise ValueError("at least one strategy must be there")

    def order(self, question: Column, kind: Column, confidence: Column) -> Column:
        """Strategies in the order in which a need tries them: its own, then the others that may follow it."""
        first = understanding.strategy(question, kind, confidence, understanding.hints(question) != "", hierarchical="hierarchical" in self.strategies, contextual="contextual" in self.strategies)
        every = F.array(*map(F.lit, self.strategies))
        orders = F.create_map(*[x for name, rest in understanding.FALLBACKS.items() for x in (F.lit(name), F.array(F.lit(name), *map(F.lit, rest)))])
        known = F.array_intersect(F.try_element_at(orders, first), every)
        return F.array_union(known, every)  # strategies without a place of their own come last


@dataclass(frozen=True)
class Answers:
    """``outcomes`` (query_id, outcome, status, coverage, answer, ...), ``needs`` and ``grades`` after arbitration, ``evidence``, ``citations``,
    ``validation`` and ``attempts`` of every round, the ``context`` that a generator is given, and the preferred documents if quotas are on."""

    outcomes: DataFrame
    needs: DataFrame
    grades: DataFrame
    evidence: DataFrame
    citations: DataFrame
    validation: DataFrame
    attempts: DataFrame
    context: DataFrame
    preferred: DataFrame | None = field(default=None)


def _id(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def answer(corpus: Corpus, questions: DataFrame, agent: Agent = Agent(), needs: DataFrame | None = None, own: DataFrame | None = None, need_scopes: DataFrame | None = None, now: datetime | None = None) -> Answers:
    """Answers of all ``questions`` (query_id, question).

    ``needs`` (query_id, need_id, need, required): by default the questions' clauses, all required. ``own``: the questions' scopes,
    by default those that their wording asks for; ``need_scopes`` (query_id, need_id, fields): scopes of needs, which inherit the
    question's where they are open. A question without needs, or whose budget is spent, has needs that nothing was tried for.
    """
    limits, spark = agent.limits, questions.sparkSession
    questions = materialise(questions.select("query_id", "question"), "questions", keep=True)
    if needs is None:
        needs = understanding.decompose(questions).withColumn("required", F.lit(True))
    own = scopes.detected(questions, now or datetime.now(timezone.utc)) if own is None else own
    own = scopes.complete(own, questions)
    if need_scopes is not None:
        keyed = needs.select("query_id", "need_id").withColumn("id", _id("query_id", "need_id"))
        theirs = scopes.complete(need_scopes.withColumn("id", _id("query_id", "need_id")), keyed, "id").join(keyed, "id")
        fields = scopes.inherited(theirs, own)
    else:
        fields = needs.select("query_id", "need_id").join(own, "query_id")
    table = materialise(fields.select("query_id", "need_id", *scopes.FIELDS), "need-scopes", keep=True)
    facts = scopes.facts(corpus.documents)

    kind, confidence = agent.classify(F.col("need"))
    states = needs.join(questions, "query_id").select(
        "query_id", "need_id", "need", "question", "required", confidence.alias("confidence"), agent.order(F.col("need"), kind, confidence).alias("order"),
        F.lit(0).alias("step"), F.lit(limits.top_k).alias("top_k"), F.lit(0).alias("attempts"), F.lit(0).alias("reclassified"), F.lit("pending").alias("status"), F.lit("").alias("reason"),
    )
    states = materialise(states, "states", keep=True)
    links, log, checks, preferred = None, [], [], None
    key = F.from_json("query_id", f"query_id {questions.schema['query_id'].dataType.simpleString()}, need_id {needs.schema['need_id'].dataType.simpleString()}")
    for round_ in range(limits.attempts):
        open_ = materialise(_taken(states, limits), "open", keep=True)
        at = sorted((r["strategy"], r["top_k"]) for r in open_.select("strategy", "top_k").distinct().collect())  # strategies, not needs
        if not at:
            break
        found = []
        for name, k in at:
            asked = open_.where((F.col("strategy") == name) & (F.col("top_k") == k))
            ids = asked.select(_id("query_id", "need_id").alias("id"), "query_id", "need_id", "need")
            scope = table.join(ids.select("query_id", "need_id", "id"), ["query_id", "need_id"]).drop("query_id", "need_id").withColumnRenamed("id", "query_id")
            first = None if preferred is None else preferred.join(ids.select("query_id", "id"), "query_id").select(F.col("id").alias("query_id"), "document_key")
            hits = execute(corpus, ids.select(F.col("id").alias("query_id"), F.col("need").alias("question")), Plan(name, k, balance=agent.balance), scope, first)
            found.append(hits.select("query_id", "doc_id", F.col("rank").cast("int").alias("position")))
        hits = materialise(reduce(DataFrame.unionByName, found).withColumn("_key", key).select("_key.query_id", "_key.need_id", "doc_id", "position"), "hits", keep=True)
        tried = table.join(open_.select("query_id", "need_id"), ["query_id", "need_id"])
        inside, check = scopes.validated(hits, tried, facts, ("query_id", "need_id"))
        checks.append(materialise(check.withColumn("round", F.lit(round_ + 1)), "checks", keep=True))
        graded = inside.join(open_.select("query_id", "need_id", "need"), ["query_id", "need_id"]).join(corpus.documents.select("doc_id", "text"), "doc_id")
        graded = graded.select("query_id", "need_id", "doc_id", F.lit(round_ + 1).alias("round"), "position", corpus.providers.supports(F.col("need"), F.col("text")).alias("score"))
        links = materialise(_linked(links, graded.where(F.col("score") >= grading.RELEVANT)), "links", keep=True)
        states, told = _advanced(spark, states, open_, links, agent)
        log.append(told.withColumn("round", F.lit(round_ + 1)))
        if agent.balance:
            preferred = _preferred(corpus, preferred, links, told, questions)
    if links is None:
        links = _linked(None, states.where("false").crossJoin(corpus.documents.select("doc_id").limit(0)).select("query_id", "need_id", "doc_id", F.lit(1).alias("round"), F.lit(1).alias("position"), F.lit(0.0).alias("score")))
    left = F.col("status") == "pending"
    states = states.withColumn("reason", F.when(left, "global_attempt_limit_reached").otherwise(F.col("reason"))).withColumn("status", F.when(left, "exhausted").otherwise(F.col("status")))
    return _concluded(corpus, agent, questions, states, links, log, checks, table, preferred)


def _taken(states: DataFrame, limits: Limits) -> DataFrame:
    """Open needs that this round works at, in order of their ids within their question's budget, with their ``strategy``."""
    own = Window.partitionBy("query_id")
    pending = F.col("status") == "pending"
    turn = F.count_if(pending).over(own.orderBy("need_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    told = states.withColumns({"_used": F.sum("attempts").over(own), "_turn": turn})
    place = F.least(F.col("step"), F.size("order") - 1)
    return told.where(pending & (F.col("_used") + F.col("_turn") <= limits.attempts_in_all)).withColumn("strategy", F.get("order", place)).drop("_used", "_turn")


def _linked(held: DataFrame | None, new: DataFrame) -> DataFrame:
    """Evidence that supports needs (query_id, need_id, doc_id), each with its best score and where it was found first."""
    both = new if held is None else held.unionByName(new)
    return both.groupBy("query_id", "need_id", "doc_id").agg(F.min("round").alias("round"), F.min_by("position", F.struct("round", "position")).alias("position"), F.max("score").alias("score"))


def _advanced(spark: SparkSession, states: DataFrame, open_: DataFrame, links: DataFrame, agent: Agent) -> tuple[DataFrame, DataFrame]:
    """States after a round, and the round's log of attempts: every tried need's decision meets the table of transitions."""
    limits, by = agent.limits, ["query_id", "need_id"]
    best = links.groupBy(*by).agg(F.max("score").alias("coverage"), F.count("*").alias("n_links"))
    told = states.join(open_.select(*by, "strategy"), by, "left").join(best, by, "left").na.fill(0, ["coverage", "n_links"])
    tried = F.col("strategy").isNotNull()
    told = told.withColumn("attempts", F.col("attempts") + tried.cast("int"))
    total = F.sum("attempts").over(Window.partitionBy("query_id"))
    support = F.when(F.col("n_links") == 0, "missing").when(F.col("coverage") >= grading.SUPPORTED, "supported").otherwise("partial")
    told = told.withColumns({"_total": total, "support": support})
    action, reason = understanding.retry_decision(F.col("support") == "supported", F.col("support"), F.col("_total"), limits.attempts_in_all, F.col("attempts"), limits.attempts, F.col("confidence"), F.col("reclassified"), agent.reclassifications)
    told = told.withColumns({"action": F.when(tried, action), "_reason": F.when(tried, reason)}).join(F.broadcast(transitions(spark)), "action", "left")
    again = F.coalesce(F.col("reclassifications") > 0, F.lit(False))
    whole = F.concat_ws(" ", "question", "need")  # a need that its own words do not place is placed with its question's
    kind, confidence = agent.classify(whole)
    nothing = F.lit(0)
    told = materialise(told, "told", keep=True)
    new = told.select(
        *by, "need", "question", "required", F.when(again, confidence).otherwise(F.col("confidence")).alias("confidence"),
        F.when(again, agent.order(whole, kind, confidence)).otherwise(F.col("order")).alias("order"),
        F.when(again, nothing).otherwise(F.col("step") + F.coalesce("steps", nothing)).alias("step"),
        F.least(F.col("top_k") * F.coalesce("widening", F.lit(1)), F.lit(max(limits.top_k, limits.most_top_k))).cast("int").alias("top_k"), "attempts",
        (F.col("reclassified") + F.coalesce("reclassifications", nothing)).alias("reclassified"), F.coalesce("next_status", "status").alias("status"), F.coalesce("_reason", "reason").alias("reason"),
    )
    log = told.where(tried).select(*by, "attempts", "strategy", "top_k", "support", "coverage", "n_links", "action", F.col("_reason").alias("reason"), "next_status")
    return materialise(new, "states", keep=True), log


def _preferred(corpus: Corpus, held: DataFrame | None, links: DataFrame, log: DataFrame, questions: DataFrame) -> DataFrame:
    """The document that leads a question's evidence, from what needs found that this round completed; the one before is kept unless it leads clearly."""
    done = log.where("next_status <> 'pending'").select("query_id", "need_id")
    names = corpus.documents.select("doc_id", F.col("document_id").cast("string").alias("document_key"), F.col("title").alias("name") if "title" in corpus.documents.columns else F.col("document_id").cast("string").alias("name"))
    graded = links.join(done, ["query_id", "need_id"], "left_semi").join(names, "doc_id").join(questions, "query_id")
    graded = graded.select("query_id", "document_key", F.col("position").alias("rank"), F.col("score").alias("relevance"), selection.name_scores(F.col("name"), F.col("question")).alias("name_score"))
    found = selection.primary_document(graded)
    return materialise(found if held is None else selection.keep_or_replace(held, found), "preferred", keep=True)


def ranked_evidence(links: DataFrame, most: int) -> DataFrame:
    """``(query_id, doc_id, rank)``: a question's evidence in the order in which its needs found it, ``most`` of it."""
    first = links.groupBy("query_id", "doc_id").agg(F.min(F.struct("round", "need_id", "position")).alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first", F.col("doc_id").cast("string")))
    return first.withColumn("rank", place).where(F.col("rank") <= most).select("query_id", "doc_id", "rank")


def evidence_context(evidence: DataFrame, most: int) -> DataFrame:
    """``(query_id, context, n_in_context)``: relevant evidence (query_id, rank, title, text) as numbered blocks, as many whole ones as fit."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.trim("text"))
    told = evidence.withColumn("block", block)
    length = F.sum(F.length("block") + 2).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = told.withColumn("_length", length).where(F.col("_length") - 2 <= most)
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"])
    return kept.groupBy("query_id").agg(F.array_join(blocks, "\n\n").alias("context"), F.count("*").alias("n_in_context"))


def resolution_report(states: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """``(query_id, n_needs, supported, unresolved, complete, n_attempts)`` of a question's needs; ids in order."""
    ids = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("need_id"))))
    done = F.col("status") == "supported"
    told = states.groupBy("query_id").agg(F.count("*").alias("n_needs"), ids(done).alias("supported"), ids(~done).alias("unresolved"), F.sum("attempts").alias("n_attempts"))
    return told.withColumn("complete", F.size("unresolved") == 0)


def _concluded(corpus: Corpus, agent: Agent, questions: DataFrame, states: DataFrame, links: DataFrame, log: list[DataFrame], checks: list[DataFrame], table: DataFrame, preferred: DataFrame | None) -> Answers:
    """Aggregation, arbitration, context, gate and answer of all questions."""
    spark = questions.sparkSession
    places = materialise(ranked_evidence(links, agent.limits.evidence), "ranked", keep=True)
    held = links.join(places, ["query_id", "doc_id"])
    pairs = held.select("query_id", "need_id", "rank", "score", F.lit(True).alias("relevant"))
    prior = grading.aggregate_needs(pairs)
    texts = corpus.documents.select("doc_id", "text", *[c for c in ("title", "document_id") if c in corpus.documents.columns])
    evidence = materialise(places.join(texts, "doc_id").join(prior, ["query_id", "rank"]), "evidence", keep=True)
    if "title" not in evidence.columns:
        evidence = evidence.withColumn("title", F.lit(None).cast("string"))

    prior = evidence.select("query_id", "rank", "relevance", "relevant", "supports")
    proposed = materialise(agent.arbiter(evidence.select("query_id", "rank", "text", "relevance", "relevant", "supports")), "proposed", keep=True)
    omitted = grading.missing_ranks(prior, proposed).withColumn("_omitted", F.lit(True))
    whole = prior.join(proposed.select("query_id", "rank"), ["query_id", "rank"], "left_semi")
    final = grading.arbitrate(whole, proposed).unionByName(prior.join(omitted.drop("_omitted"), ["query_id", "rank"], "left_semi"))
    final = materialise(final, "final", keep=True)

    needs = states.select("query_id", "need_id", "required", "need")
    scored = held.select("query_id", "need_id", "rank", "score")
    graded = grading.need_grades(needs, scored)
    as_they_are = graded.select("query_id", "need_id", "coverage", "status")
    bounded = materialise(grading.arbitrate_needs(graded, as_they_are, final).join(needs.select("query_id", "need_id", "need"), ["query_id", "need_id"]), "need-grades", keep=True)
    report = grading.report(bounded, final)

    validation = typed_union(checks, spark, f"query_id {questions.schema['query_id'].dataType.simpleString()}, need_id string, n_candidates long, n_matched long, n_rejected long, status string, round int")
    per = validation.groupBy("query_id").agg(F.max("n_matched").alias("n_matched"))
    asked = table.groupBy("query_id").agg(F.bool_or(scopes.active()).alias("asked"))
    scope = questions.select("query_id").join(asked, "query_id", "left").join(per, "query_id", "left")
    scope = scope.select("query_id", F.when(~F.coalesce("asked", F.lit(False)), "not_requested").when(F.coalesce("n_matched", F.lit(0)) > 0, "matched").otherwise("no_match").alias("status"))

    usable = evidence.select("query_id", "rank", "doc_id", "title", "text").join(final.select("query_id", "rank", "relevant"), ["query_id", "rank"])
    report = questions.select("query_id").join(report, "query_id", "left").na.fill({"status": "missing", "coverage": 0.0, "n_relevant": 0, "n_unresolved": 0})
    gate = grading.answer_gate(report, scope, usable)
    best = scored.join(final.where("relevant").select("query_id", "rank", F.explode("supports").alias("need_id")), ["query_id", "rank", "need_id"])
    best = best.groupBy("query_id", "need_id").agg(F.min_by("rank", F.struct(-F.col("score"), F.col("rank"))).alias("rank")).join(usable.where("trim(text) <> ''").select("query_id", "rank", "text"), ["query_id", "rank"])
    notes = grading.unresolved_notes(bounded)
    drafts = gate.join(agent.draft(best), "query_id", "left").join(notes, "query_id", "left")
    refusal = F.create_map(*[F.lit(x) for kv in BLOCKED.items() for x in kv])
    body = F.coalesce("body", F.lit(""))
    told = F.when(F.col("outcome").startswith("blocked"), F.try_element_at(refusal, F.col("outcome"))).when((F.col("outcome") == "partial") & F.col("notes").isNotNull(), F.concat(body, F.lit("\n\nNot found:\n"), F.col("notes"))).otherwise(body)
    answers = drafts.select("query_id", "outcome", "n_evidence", told.alias("answer"))
    resolution = resolution_report(states)
    outcomes = answers.join(report.select("query_id", "status", "coverage", "n_relevant", "n_unresolved"), "query_id").join(resolution, "query_id", "left").na.fill(0, ["n_needs", "n_attempts"])
    outcomes = materialise(outcomes, "outcomes", keep=True)
    cited = grading.citations(outcomes.where("outcome in ('complete', 'partial')").select("query_id", "answer"), usable.where("relevant"))
    attempts = typed_union(log, spark, f"query_id {questions.schema['query_id'].dataType.simpleString()}, need_id string, attempts int, strategy string, top_k int, support string, coverage double, n_links long, action string, reason string, next_status string, round int")
    context = evidence_context(usable.where("relevant"), agent.context)
    return Answers(outcomes, bounded.join(states.select("query_id", "need_id", "attempts", "reclassified", "reason", F.col("status").alias("resolution")), ["query_id", "need_id"]), final, usable, cited, validation, attempts, context, preferred)
