"""Retrieval pipelines by name, plans with constraints, and the rounds that work through many questions' needs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.functions import text as T
from attestor.operators import fusion, grading, hierarchy, lexical, scopes, selection, understanding, vectors, versions
from attestor.operators.scopes import Scopes
from attestor.operators.versions import Constraints
from attestor.sources.scratch import materialise

EMBEDDING_SIZE = 64


def hash_vectors(texts: DataFrame) -> DataFrame:
    """The default embedding of (doc_id, text): no model."""
    return vectors.embed_documents(texts, EMBEDDING_SIZE)


def clause_variants(questions: DataFrame) -> DataFrame:
    """The default variants of (query_id, question), as (query_id, position, question) from position 1: a question's clauses."""
    clauses = understanding.decompose(questions)
    return clauses.select("query_id", F.regexp_extract("need_id", r"(\d+)", 1).cast("int").alias("position"), F.col("need").alias("question"))


@dataclass(frozen=True)
class Providers:
    """Where models plug in; each default works without one.

    ``embed``: (doc_id, text) to (doc_id, vector). ``score``: question and text columns to a score of 0 to 1, such as a Pandas
    UDF; null where it fails. ``variants``: questions to paraphrases. ``supports``: need and text columns to a grade of 0 to 1.
    """

    embed: Callable[[DataFrame], DataFrame] = hash_vectors
    score: Callable[[Column, Column], Column] = T.lexical_coverage
    variants: Callable[[DataFrame], DataFrame] = clause_variants
    supports: Callable[[Column, Column], Column] = T.lexical_coverage


@dataclass(frozen=True)
class Corpus:
    """Documents (doc_id, text, and document_id, version data for constraints) and their vectors (doc_id, vector), kept as tables.

    ``contextual``: the same documents with the text that contextual search reads. ``sections``: (doc_id, section_id, document_id)
    for the hierarchy. ``index`` and ``contextual_index``: word indexes; without one, it is built for each call.
    """

    documents: DataFrame
    points: DataFrame
    contextual: DataFrame | None = None
    sections: DataFrame | None = None
    index: lexical.Index | None = None
    contextual_index: lexical.Index | None = None
    contextual_points: DataFrame | None = None
    providers: Providers = Providers()


@dataclass(frozen=True)
class Limits:
    top_k: int = 5
    most_top_k: int = 20
    attempts: int = 3
    attempts_in_all: int = 20
    candidates: int = 100
    evidence: int = 40


def embedded(corpus: Corpus, questions: DataFrame) -> DataFrame:
    asked = questions.select(F.col("query_id").alias("doc_id"), F.col("question").alias("text"))
    return corpus.providers.embed(asked).withColumnRenamed("doc_id", "query_id")


def widened(k: int, times: int, most: int) -> int:
    """Candidates to ask for: some times as many, within a limit, never fewer than wanted."""
    return max(k, min(k * times, most))


Allowed = DataFrame | Scopes | None


def inside(rows: DataFrame, allowed: Allowed) -> DataFrame:
    """Rows that are allowed: of all questions the same documents (doc_id), or of each those in its scope."""
    if isinstance(allowed, Scopes):
        return allowed.inside(rows)
    return rows if allowed is None else rows.join(allowed.select("doc_id"), "doc_id", "left_semi")


def baseline(corpus: Corpus, questions: DataFrame, k: int, allowed: Allowed = None) -> DataFrame:
    asked = embedded(corpus, questions)
    if isinstance(allowed, Scopes):
        return vectors.knn_topk(allowed.points(corpus.points), allowed.questions(asked), k, admits=scopes.admitted_rows)
    return vectors.knn_topk(inside(corpus.points, allowed), asked, k)


def keyword(corpus: Corpus, questions: DataFrame, k: int, allowed: Allowed = None) -> DataFrame:
    """Statistics stay those of the whole corpus; documents that are not allowed go before the best are chosen."""
    return lexical.ranked(inside(lexical.bm25_scores(corpus.index or corpus.documents.select("doc_id", "text"), questions), allowed), k)


def hybrid(corpus: Corpus, questions: DataFrame, k: int, allowed: Allowed = None) -> DataFrame:
    wide = widened(k, 4, 100)
    return fusion.reciprocal_rank_fusion([("vector", 1.0, baseline(corpus, questions, wide, allowed)), ("keyword", 1.0, keyword(corpus, questions, wide, allowed))], k)


def contextual(corpus: Corpus, questions: DataFrame, k: int, allowed: Allowed = None) -> DataFrame:
    """Hybrid over the texts with context; what is found are the documents themselves."""
    if corpus.contextual is None:
        return hybrid(corpus, questions, k, allowed)
    points = corpus.contextual_points if corpus.contextual_points is not None else corpus.providers.embed(corpus.contextual.select("doc_id", "text"))
    own = replace(corpus, documents=corpus.contextual, points=points, index=corpus.contextual_index)
    return hybrid(own, questions, k, allowed)


def multi_query(corpus: Corpus, questions: DataFrame, k: int, allowed: Allowed = None) -> DataFrame:
    """Fusion over the question and its variants, each of which is asked on its own."""
    original = questions.select("query_id", F.lit(0).alias("position"), "question")
    variants = fusion.distinct_variants(original.unionByName(corpus.providers.variants(questions)))
    asked = variants.select(F.to_json(F.struct("query_id", "variant")).alias("query_id"), "question", F.col("query_id").alias("_id"))
    if isinstance(allowed, Scopes):
        allowed = allowed.renamed(asked.select(F.col("_id").alias("query_id"), F.col("query_id").alias("new_id")))
    asked = asked.drop("_id")
    hits = hybrid(corpus, asked, widened(k, 2, 100), allowed)
    told = hits.withColumn("pair", F.from_json("query_id", f"query_id {questions.schema['query_id'].dataType.simpleString()}, variant int"))
    return fusion.fuse_variants(told.select("pair.query_id", "pair.variant", "doc_id", "rank"), k)


def hierarchical(corpus: Corpus, questions: DataFrame, k: int, allowed: Allowed = None) -> DataFrame:
    """Best documents, their best sections, the sections' best chunks. Questions that this finds nothing for get the nearest chunks of all."""
    fallback = lambda q: baseline(corpus, q, k, allowed).select("query_id", "doc_id", "score", "rank")
    if corpus.sections is None:
        return fallback(questions)
    asked, admits, points = vectors.directed(embedded(corpus, questions)), None, vectors.directed(corpus.points)
    if isinstance(allowed, Scopes):
        asked, admits, points = allowed.questions(asked), scopes.admitted_rows, allowed.points(points)
    else:
        points = inside(points, allowed)
    chunks = points.join(corpus.sections, "doc_id")
    documents = hierarchy.centroids(chunks, "document_id")
    sections = hierarchy.centroids(chunks, "section_id").join(chunks.select("section_id", "document_id").distinct(), "section_id")
    found = hierarchy.route(asked, documents, sections, chunks, k, admits=admits).select("query_id", "doc_id", "score", "rank")
    found = materialise(found, "routed", keep=True)
    return found.unionByName(fallback(questions.join(found.select("query_id").distinct(), "query_id", "left_anti")))


def rerank(corpus: Corpus, questions: DataFrame, k: int, allowed: Allowed = None) -> DataFrame:
    """Hybrid candidates in the scorer's order."""
    wide = hybrid(corpus, questions, widened(k, 4, 40), allowed)
    return scored(corpus, questions, wide, k).select("query_id", "doc_id", F.col("score_used").alias("score"), "rank")


def scored(corpus: Corpus, questions: DataFrame, hits: DataFrame, k: int | None = None) -> DataFrame:
    told = hits.join(corpus.documents.select("doc_id", "text"), "doc_id").join(questions, "query_id")
    told = told.withColumn("rerank_score", corpus.providers.score(F.col("question"), F.col("text"))).drop("question", "text")
    return selection.rerank(told, "rerank_score", k)


PIPELINES: dict[str, Callable[..., DataFrame]] = {
    "baseline": baseline,
    "keyword": keyword,
    "hybrid": hybrid,
    "contextual": contextual,
    "multi_query": multi_query,
    "hierarchical": hierarchical,
    "rerank": rerank,
}


@dataclass(frozen=True)
class Plan:
    """How a table of questions is answered: a pipeline, how many rows, and what the rows must satisfy."""

    pipeline: str = "hybrid"
    top_k: int = 5
    constraints: Constraints = Constraints()
    rerank: bool = False
    balance: bool = False

    def __post_init__(self):
        if self.pipeline not in PIPELINES:
            raise ValueError(f"unknown pipeline {self.pipeline!r}; there are {', '.join(PIPELINES)}")
        if self.top_k < 1:
            raise ValueError("top_k must be positive")


def execute(corpus: Corpus, questions: DataFrame, plan: Plan, own: DataFrame | None = None, preferred: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id, rank, score, document_id, version_number, ...)``: evidence of every question in one plan.

    What a constraint can tell of a document alone is applied before retrieval; what compares versions, to the candidates, of
    which there are then four times as many; after that come reranking and document quotas. ``corpus.documents`` has the columns
    that constraints ask for: document_id, version_number, is_latest, published_at, uploaded_at, title, filename.

    ``own``: a scope for each question (query_id and the fields of ``operators.scopes``), which inherits from the plan's
    constraints what it leaves open; the result then tells in ``fallback_scan`` which rows were found without the stored names.
    ``preferred`` (query_id, document_key): the document that quotas prefer for a question.
    """
    if own is not None:
        told = scoped_hits(corpus, questions, own, plan)
    else:
        c = plan.constraints
        allowed = corpus.documents.where(versions.pushdown(c)) if c.active else None
        wide = widened(plan.top_k, 4, 100) if c.active or plan.rerank or plan.balance else plan.top_k
        hits = PIPELINES[plan.pipeline](corpus, questions, wide, allowed).select("query_id", "doc_id", "score", "rank")
        told = hits.join(corpus.documents.drop("text"), "doc_id")
        told = versions.constrain(told, c) if c.active else told
    if plan.rerank:
        told = scored(corpus, questions, told).withColumn("score", F.col("score_used")).drop("rerank_score", "score_used", "fallback", "original_rank")
    if plan.balance:
        named = told.withColumn("document_key", F.col("document_id").cast("string"))
        if preferred is None:
            named = named.withColumn("is_primary", F.lit(False))
        else:
            first = preferred.select("query_id", F.col("document_key").cast("string").alias("document_key"), F.lit(True).alias("is_primary"))
            named = named.join(first, ["query_id", "document_key"], "left").na.fill(False, ["is_primary"])
        return selection.balance(named, plan.top_k).withColumn("rank", F.col("selected_rank")).drop("selected_rank", "document_key", "is_primary")
    return told.where(F.col("rank") <= plan.top_k)


def scoped_hits(corpus: Corpus, questions: DataFrame, own: DataFrame, plan: Plan) -> DataFrame:
    """Candidates of each question inside its own scope, with the documents' columns and ``fallback_scan``.

    Questions whose scope asks for something are asked for four times as many candidates than is wanted, the others for as many
    as the plan wants. A question that gets nothing by the names that the store has ready is asked once more without them, and
    what it finds is held against all names of its documents: older rows may not have their names ready.
    """
    spark = questions.sparkSession
    own = own.select("query_id", *scopes.FIELDS)
    if plan.constraints.active:
        own = scopes.inherited(scopes.complete(own, questions), questions.select("query_id").join(F.broadcast(scopes.scope_table(spark, [((), plan.constraints)], "").select(*scopes.FIELDS)), how="cross"))
    table = materialise(scopes.complete(own, questions).withColumn("active", scopes.active()), "scopes", keep=True)
    facts = scopes.facts(corpus.documents)
    pipeline = PIPELINES[plan.pipeline]
    asked = questions.join(table.where("active").select("query_id"), "query_id", "left_semi")
    free = questions.join(table.where("active").select("query_id"), "query_id", "left_anti")
    wide = widened(plan.top_k, 4, 100)
    hits = lambda q, k, scope: pipeline(corpus, q, k, scope).select("query_id", "doc_id", "score", "rank")
    found = []
    if not table.where("active").isEmpty():
        first = materialise(hits(asked, wide, Scopes(table, facts)).withColumn("fallback_scan", F.lit(False)), "scoped", keep=True)
        again = materialise(table.where("size(names) > 0").join(first.select("query_id").distinct(), "query_id", "left_anti"), "again", keep=True)
        if not again.isEmpty():
            q = asked.join(again.select("query_id"), "query_id", "left_semi")
            first = first.unionByName(hits(q, wide, Scopes(again.withColumn("names", F.array().cast("array<string>")), facts)).withColumn("fallback_scan", F.lit(True)))
        found.append(scopes.constrain(first.join(corpus.documents.drop("text"), "doc_id"), table, facts))
    if not table.where("not active").isEmpty():
        found.append(hits(free, wide if plan.rerank or plan.balance else plan.top_k, None).withColumn("fallback_scan", F.lit(False)).join(corpus.documents.drop("text"), "doc_id"))
    if not found:
        found.append(hits(questions, plan.top_k, None).withColumn("fallback_scan", F.lit(False)).join(corpus.documents.drop("text"), "doc_id"))
    return reduce(DataFrame.unionByName, found)


def evaluate(corpus: Corpus, cases: DataFrame, expectations: DataFrame, plan: Plan, ks: tuple[int, ...] = (1, 5, 10)) -> tuple[DataFrame, DataFrame]:
    """``(per case, report)`` of a dataset that one plan answers whole: recall at each k and reciprocal rank.

    ``cases``: case_id, question. ``expectations``: case_id, expectation_id, document_id, fragments. Per case (case_id, metric,
    value); the report is (metric, value, n) over cases that expect something.
    """
    from attestor.operators import evaluation

    found = execute(corpus, cases.select(F.col("case_id").alias("query_id"), "question"), plan)
    if "document_id" not in found.columns:
        found = found.withColumn("document_id", F.lit(None).cast("string"))
    evidence = found.join(corpus.documents.select("doc_id", "text"), "doc_id").select(F.col("query_id").alias("case_id"), "rank", "document_id", "text")
    matches = materialise(evaluation.expectation_matches(expectations, evidence), "matches", keep=True)
    rows = [evaluation.recall_at_k(expectations, matches, k).withColumn("metric", F.lit(f"recall_at_{k}")) for k in ks]
    rows.append(evaluation.reciprocal_rank(expectations.select("case_id").distinct(), matches).withColumn("metric", F.lit("reciprocal_rank")))
    told = reduce(DataFrame.unionByName, rows).select("case_id", "metric", "value")
    return told, told.groupBy("metric").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def write_report(report: DataFrame, path: str) -> None:
    """The report as JSON lines, which a later run may replace."""
    report.coalesce(1).write.mode("overwrite").json(path)  # a row per metric


def resolve_needs(corpus: Corpus, needs: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """``(states, evidence)`` of the needs of many questions, each worked at in rounds until it is supported or has no attempts left.

    ``needs``: query_id, need_id, need. A round is one plan over all open needs: each is retrieved by its next strategy, graded,
    pruned to what supports it, and merged into its evidence. States: query_id, need_id, need, strategy, top_k, attempts, status,
    coverage, order. Evidence: query_id, need_id, doc_id, coverage, rank; ranks never change once given, and a need keeps ``limits.evidence``.
    ``limits.attempts_in_all`` bounds the attempts of a question, its needs in order. A need without evidence ends as exhausted.
    """
    kind, confidence = understanding.classify(F.col("need"))
    first = understanding.strategy(F.col("need"), kind, confidence, understanding.hints(F.col("need")) != "", hierarchical=corpus.sections is not None)
    names = list(understanding.FALLBACKS)
    later = F.create_map(*[x for n in names for x in (F.lit(n), F.array(F.lit(n), *[F.lit(f) for f in understanding.FALLBACKS[n]]))])
    states = needs.select("query_id", "need_id", "need", first.alias("strategy"), F.lit(limits.top_k).alias("top_k"), F.lit(0).alias("attempts"), F.lit("pending").alias("status"), F.lit(0.0).alias("coverage"))
    states = states.withColumn("order", later[F.col("strategy")])
    states = materialise(states, "need-states", keep=True)
    evidence = None
    for round_ in range(limits.attempts):
        used = F.sum("attempts").over(Window.partitionBy("query_id"))
        turn = F.row_number().over(Window.partitionBy("query_id").orderBy((F.col("status") != "pending").cast("int"), "need_id"))
        open_ = states.withColumn("_free", (F.col("status") == "pending") & (used + turn <= limits.attempts_in_all)).where("_free").drop("_free")
        open_ = materialise(open_.withColumn("now", F.get("order", F.lit(round_))), "need-open", keep=True)
        at = {(r["now"], r["top_k"]) for r in open_.groupBy("now", "top_k").count().collect()}  # strategies, not needs
        if not at:
            break
        found = []
        for name, k in sorted(at):
            asked = open_.where((F.col("now") == name) & (F.col("top_k") == k)).select(F.to_json(F.struct("query_id", "need_id")).alias("query_id"), F.col("need").alias("question"))
            found.append(PIPELINES[name](corpus, asked, k).select("query_id", "doc_id", "rank"))
        hits = reduce(DataFrame.unionByName, found)
        key = F.from_json("query_id", f"query_id {needs.schema['query_id'].dataType.simpleString()}, need_id string")
        hits = hits.withColumn("k", key).select("k.query_id", "k.need_id", "doc_id", F.col("rank").alias("position"))
        graded = hits.join(open_.select("query_id", "need_id", "need"), ["query_id", "need_id"]).join(corpus.documents.select("doc_id", "text"), "doc_id")
        graded = graded.select("query_id", "need_id", "doc_id", "position", corpus.providers.supports(F.col("need"), F.col("text")).alias("coverage"))
        evidence = materialise(merge_evidence(evidence, graded.where(F.col("coverage") >= grading.RELEVANT), limits.evidence), "need-evidence", keep=True)
        best = evidence.groupBy("query_id", "need_id").agg(F.max("coverage").alias("best"))
        tried = open_.select("query_id", "need_id", F.lit(1).alias("tried"))
        told = states.join(tried, ["query_id", "need_id"], "left").join(best, ["query_id", "need_id"], "left")
        done = F.col("best") >= grading.SUPPORTED
        status = F.when(F.col("tried").isNull(), F.col("status")).when(done, "supported").when(F.col("attempts") + 1 >= limits.attempts, "exhausted").otherwise("pending")
        told = told.select("query_id", "need_id", "need", F.when(F.col("tried") == 1, F.get("order", F.lit(round_))).otherwise(F.col("strategy")).alias("strategy"), F.when(F.col("tried").isNull() | done, F.col("top_k")).otherwise(F.least(F.col("top_k") * 2, F.lit(limits.most_top_k))).alias("top_k"), (F.col("attempts") + F.coalesce("tried", F.lit(0))).alias("attempts"), status.alias("status"), F.coalesce("best", "coverage").alias("coverage"), "order")
        states = materialise(told, "need-states", keep=True)
    if evidence is None:
        evidence = merge_evidence(None, needs.where("false").select("query_id", "need_id", F.lit(0).alias("position"), F.lit(0.0).alias("coverage")).crossJoin(corpus.documents.select("doc_id").limit(0)), limits.evidence)
    states = states.withColumn("status", F.when(F.col("status") == "pending", "exhausted").otherwise(F.col("status")))
    return states, evidence


def merge_evidence(held: DataFrame | None, found: DataFrame, most: int = 40) -> DataFrame:
    """``(query_id, need_id, doc_id, coverage, rank)``: evidence of needs with what another attempt found (position, coverage).

    What was held keeps its rank and the better coverage; what is new gets the next ranks in order of position, as long as a need
    has fewer than ``most``.
    """
    own = ["query_id", "need_id", "doc_id"]
    new = found.groupBy(*own).agg(F.max("coverage").alias("_new"), F.min("position").alias("_position"))
    if held is None:
        both = new.select(*own, F.lit(None).cast("double").alias("coverage"), F.lit(None).cast("int").alias("rank"), "_new", "_position")
    else:
        both = held.join(new, own, "full_outer")
    need = Window.partitionBy("query_id", "need_id")
    last = F.coalesce(F.max("rank").over(need), F.lit(0))
    place = F.row_number().over(need.orderBy(F.col("rank").isNotNull(), "_position", F.col("doc_id").cast("string")))
    told = both.withColumn("_last", last).withColumn("rank", F.coalesce("rank", F.col("_last") + place))
    return told.where(F.col("rank") <= most).select(*own, F.greatest("coverage", "_new").alias("coverage"), "rank")


@dataclass
class NeedState:
    """One need's progress: its strategies and how many rows it asked for, its status, and what supports it."""

    need_id: str
    need: str
    strategy: str
    top_k: int
    tried: list[tuple[str, int]] = field(default_factory=list)
    status: str = "pending"
    evidence: dict = field(default_factory=dict)


def answer_question(corpus: Corpus, question: str, limits: Limits = Limits()) -> list[NeedState]:
    """The needs of one question, worked through by ``resolve_needs``; at most ``limits.evidence`` rows a need come to the driver."""
    asked = corpus.documents.sparkSession.createDataFrame([("q", question)], "query_id string, question string")
    states, evidence = resolve_needs(corpus, understanding.decompose(asked), limits)
    held: dict[str, dict] = {}
    for r in evidence.collect():
        held.setdefault(r["need_id"], {})[r["doc_id"]] = r["coverage"]
    out = []
    for r in states.orderBy("need_id").collect():
        tried = [(name, min(limits.most_top_k, limits.top_k << i)) for i, name in enumerate(r["order"][: r["attempts"]])]
        out.append(NeedState(r["need_id"], r["need"], r["strategy"], r["top_k"], tried, r["status"], held.get(r["need_id"], {})))
    return out
