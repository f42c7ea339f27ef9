"""Grading of evidence against information needs, arbitration, and the gate before an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import text as T

RELEVANT, SUPPORTED = 0.35, 0.6


def grade_pairs(evidence: DataFrame, needs: DataFrame) -> DataFrame:
    """``(query_id, need_id, required, rank, score)``: lexical coverage of each need by each piece of evidence of its question.

    ``evidence``: query_id, rank, text; ``needs``: query_id, need_id, need, required. Terms are cut once per side before the join.
    """
    e = evidence.select("query_id", "rank", T.content_terms(F.col("text")).alias("text_terms"))
    n = needs.select("query_id", "need_id", "required", T.content_terms(F.col("need")).alias("need_terms"))
    return e.join(n, "query_id").select("query_id", "need_id", "required", "rank", T.coverage_of_terms(F.col("need_terms"), F.col("text_terms")).alias("score"))


def evidence_grades(pairs: DataFrame) -> DataFrame:
    """``(query_id, rank, relevance, relevant, supports)`` per piece of evidence."""
    supports = F.array_sort(F.collect_set(F.when(F.col("score") >= RELEVANT, F.col("need_id"))))
    best = pairs.groupBy("query_id", "rank").agg(F.max("score").alias("relevance"), supports.alias("supports"))
    return best.select("query_id", "rank", "relevance", (F.col("relevance") >= RELEVANT).alias("relevant"), "supports")


def need_grades(needs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(query_id, need_id, required, coverage, ranks, status)`` per need; a need without evidence is missing."""
    ranks = F.array_sort(F.collect_set(F.when(F.col("score") >= RELEVANT, F.col("rank"))))
    best = pairs.groupBy("query_id", "need_id").agg(F.max("score").alias("coverage"), ranks.alias("ranks"))
    told = needs.select("query_id", "need_id", "required").join(best, ["query_id", "need_id"], "left")
    coverage, ranks = F.coalesce("coverage", F.lit(0.0)), F.coalesce("ranks", F.array().cast(f"array<{pairs.schema['rank'].dataType.simpleString()}>"))
    status = F.when(F.size(ranks) == 0, "missing").when(coverage >= SUPPORTED, "supported").otherwise("partial")
    return told.select("query_id", "need_id", "required", coverage.alias("coverage"), ranks.alias("ranks"), status.alias("status"))


def report(need_table: DataFrame, evidence_table: DataFrame) -> DataFrame:
    """``(query_id, status, coverage, n_relevant, n_unresolved)``: missing, sufficient or weak."""
    n = need_table.groupBy("query_id").agg(
        F.coalesce(F.avg(F.when(F.col("required"), F.col("coverage"))), F.lit(1.0)).alias("coverage"),
        F.count(F.when(F.col("required"), 1)).alias("n_required"),
        F.count(F.when(F.col("required") & (F.col("status") != "supported"), 1)).alias("n_unresolved"),
    )
    e = evidence_table.groupBy("query_id").agg(F.count(F.when(F.col("relevant"), 1)).alias("n_relevant"))
    told = n.join(e, "query_id", "left").na.fill(0, ["n_relevant"])
    status = F.when(F.col("n_relevant") == 0, "missing").when((F.col("n_required") > 0) & (F.col("n_unresolved") == 0), "sufficient").otherwise("weak")
    return told.select("query_id", status.alias("status"), "coverage", "n_relevant", "n_unresolved")


def arbitrate(prior: DataFrame, proposed: DataFrame) -> DataFrame:
    """Final grades (query_id, rank, relevance, relevant, supports): a proposal can only lower what graders approved.

    Every graded rank must be proposed: one that is not ends the query with an error. ``missing_ranks`` finds them beforehand.
    """
    p = proposed.select("query_id", "rank", *[F.col(c).alias(f"p_{c}") for c in ("relevance", "relevant", "supports")])
    whole = F.when(F.col("p_relevance").isNull(), F.raise_error(F.concat(F.lit("no proposal for rank "), F.col("rank").cast("string"))).cast("double")).otherwise(F.col("p_relevance"))
    both = prior.join(p, ["query_id", "rank"], "left").withColumn("p_relevance", whole).withColumn("shared", F.array_intersect("p_supports", "supports"))
    relevant = F.col("relevant") & F.col("p_relevant") & (F.size("shared") > 0)
    return both.select("query_id", "rank", F.least("relevance", "p_relevance").alias("relevance"), relevant.alias("relevant"), F.when(relevant, F.col("shared")).otherwise(F.array().cast("array<string>")).alias("supports"))


def missing_ranks(prior: DataFrame, proposed: DataFrame) -> DataFrame:
    return prior.select("query_id", "rank").join(proposed, ["query_id", "rank"], "left_anti")


def arbitrate_needs(prior: DataFrame, proposed: DataFrame, final: DataFrame) -> DataFrame:
    """Need grades after arbitration: ranks that still support the need, the lower status, the lower coverage or 0."""
    order = F.create_map(*[F.lit(x) for x in ("missing", 0, "partial", 1, "supported", 2)])
    ranks = final.where("relevant").select("query_id", "rank", F.explode("supports").alias("need_id")).groupBy("query_id", "need_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    p = proposed.select("query_id", "need_id", F.col("coverage").alias("p_coverage"), F.col("status").alias("p_status"))
    both = prior.drop("ranks").join(p, ["query_id", "need_id"]).join(ranks, ["query_id", "need_id"], "left")
    held = F.col("ranks").isNotNull()
    status = F.when(~held, "missing").when(order[F.col("status")] <= order[F.col("p_status")], F.col("status")).otherwise(F.col("p_status"))
    return both.select("query_id", "need_id", "required", F.when(held, F.least("coverage", "p_coverage")).otherwise(0.0).alias("coverage"), "ranks", status.alias("status"))


def answer_gate(reports: DataFrame, constraint: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(query_id, outcome, n_evidence)``: what may be answered, the first that holds of no constraint match, not answerable, no
    evidence, partial, complete. ``reports`` of ``report``, ``constraint`` of ``constraint_report``, ``evidence`` (query_id, rank, text,
    relevant)."""
    usable = evidence.where("relevant and trim(text) <> ''").groupBy("query_id").agg(F.count("*").alias("n_evidence"))
    told = reports.join(constraint.select("query_id", F.col("status").alias("scope")), "query_id", "left").join(usable, "query_id", "left").na.fill(0, ["n_evidence"])
    outcome = (
        F.when(F.col("scope") == "no_match", "blocked_constraint_no_match")
        .when(F.col("status") == "missing", "blocked_insufficient_evidence")
        .when(F.col("n_evidence") == 0, "blocked_no_evidence")
        .when(F.col("status") == "weak", "partial")
        .otherwise("complete")
    )
    return told.select("query_id", outcome.alias("outcome"), "n_evidence")


def citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(query_id, position, rank, label, quote, doc_id)``: evidence that an answer names as ``[rank]``, with the first 500 characters of it.

    ``evidence``: query_id, rank, text, doc_id. Evidence that is named but has no text or document keeps its row, with nulls.
    """
    allowed = evidence.groupBy("query_id").agg(F.collect_set("rank").alias("allowed"))
    named = answers.join(allowed, "query_id").select("query_id", F.posexplode(T.cited_ranks(F.col("answer"), F.col("allowed"))).alias("position", "rank"))
    return named.join(evidence, ["query_id", "rank"]).select("query_id", "position", "rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")).alias("label"), F.substring("text", 1, 500).alias("quote"), "doc_id")


def linked_citations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Stored ``citations`` (query_id, rank, ...) with the evidence that they name (query_id, rank, text, doc_id); without it: nulls."""
    return citations.join(evidence.select("query_id", "rank", F.col("doc_id"), F.substring("text", 1, 500).alias("quote")), ["query_id", "rank"], "left")


def aggregate_needs(graded: DataFrame) -> DataFrame:
    """``(query_id, rank, relevance, relevant, supports)`` of evidence graded need by need: ``graded`` (query_id, need_id, rank, score, relevant).

    A piece has the highest score that any need gave it, supports the needs that took it, and is relevant if one did.
    """
    took = F.array_sort(F.collect_set(F.when(F.col("relevant"), F.col("need_id"))))
    return graded.groupBy("query_id", "rank").agg(F.max("score").alias("relevance"), F.max("relevant").alias("relevant"), took.alias("supports"))


def overall_status(needs: DataFrame) -> DataFrame:
    """``(query_id, status, coverage, answerable, partly_answerable, supported, unresolved)`` of needs (need_id, required, coverage, status).

    Sufficient if every required need is supported, missing if no need has any support, else weak. Ids are in order.
    """
    ids = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("need_id"))))
    required, supported = F.col("required"), F.col("status") == "supported"
    told = needs.groupBy("query_id").agg(
        F.coalesce(F.avg(F.when(required, F.col("coverage"))), F.lit(1.0)).alias("coverage"),
        F.count_if(F.col("status") != "missing").alias("_some"),
        F.count_if(required).alias("_required"),
        ids(supported).alias("supported"),
        ids(required & ~supported).alias("unresolved"),
    )
    status = F.when(F.col("_some") == 0, "missing").when((F.col("_required") > 0) & (F.size("unresolved") == 0), "sufficient").otherwise("weak")
    told = told.withColumn("status", status)
    return told.select("query_id", "status", "coverage", (F.col("status") == "sufficient").alias("answerable"), (F.col("status") == "weak").alias("partly_answerable"), "supported", "unresolved")


def unresolved_notes(needs: DataFrame) -> DataFrame:
    """``(query_id, notes)``: a line ``- need`` for each required need without support, in order of ids; null where all have it."""
    open_ = F.col("required") & (F.col("status") != "supported")
    lines = F.transform(F.array_sort(F.collect_list(F.when(open_, F.struct("need_id", "need")))), lambda x: F.concat(F.lit("- "), x["need"]))
    return needs.groupBy("query_id").agg(F.nullif(F.array_join(lines, "\n"), F.lit("")).alias("notes"))
