"""Which documents evidence comes from: identity, primary document, quotas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.functions import text as T

PRIMARY_MIN, PRIMARY_MAX, SECONDARY_MAX, UNPREFERRED_MAX = 0.6, 0.8, 0.4, 0.6
MIN_SCORE, MIN_MARGIN, REPLACEMENT_MARGIN = 0.65, 0.08, 0.12


def reference_key(document_id: Column, names: Column, version_id: Column, rank: Column) -> Column:
    """Logical document of a piece of evidence: id, else first normalised name, else version, else the piece itself."""
    first = F.array_min(F.filter(names, lambda n: n.isNotNull() & (n != "")))
    return F.coalesce(F.concat(F.lit("document:"), document_id.cast("string")), F.concat(F.lit("name:"), first), F.concat(F.lit("version:"), version_id.cast("string")), F.concat(F.lit("unknown:"), rank.cast("string")))


def balance(evidence: DataFrame, top_k: int) -> DataFrame:
    """``top_k`` rows per question with document quotas: ``evidence`` (query_id, rank, document_key, is_primary).

    With a primary document: first its best share of PRIMARY_MIN, then others within SECONDARY_MAX each, then more of it within
    PRIMARY_MAX, then whatever is left by rank. Without: UNPREFERRED_MAX each, then the rest. A row's turn follows from its
    position in its document alone, so two windows replace the selection loop; tasks drop what cannot be selected.
    """
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    quota = lambda share: max(1, math.ceil(top_k * share))
    low = min(top_k, quota(PRIMARY_MIN))
    high = min(top_k, max(low, quota(PRIMARY_MAX)))
    seq = F.row_number().over(Window.partitionBy("query_id", "document_key").orderBy("rank"))
    preferred = F.max("is_primary").over(Window.partitionBy("query_id"))
    primary, n = F.col("is_primary"), F.col("_seq")
    turn = F.when(~F.col("_preferred"), F.when(n <= quota(UNPREFERRED_MAX), 1).otherwise(4)).otherwise(
        F.when(primary & (n <= low), 1).when(~primary & (n <= quota(SECONDARY_MAX)), 2).when(primary & (n <= high), 3).otherwise(4)
    )
    told = evidence.withColumn("_seq", seq).withColumn("_preferred", preferred).withColumn("_turn", turn)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_turn", "rank"))
    return told.withColumn("selected_rank", place).where(F.col("selected_rank") <= top_k).drop("_seq", "_preferred", "_turn")


def document_counts(selected: DataFrame) -> DataFrame:
    return selected.groupBy("query_id", "document_key").agg(F.count("*").alias("n"))


def primary_document(graded: DataFrame, support: Column | None = None) -> DataFrame:
    """``(query_id, document_key, score, margin, confidence)`` of the document that leads clearly, if one does.

    ``graded``: query_id, document_key, rank, relevance, name_score. The score is 0.74 of the best relevance, 0.21 of the best name
    overlap, and a little for breadth; it must reach MIN_SCORE and lead by MIN_MARGIN. ``support``: 1 for a supported need, 0.8
    for a partial one.
    """
    per = graded.groupBy("query_id", "document_key").agg(F.max("relevance").alias("r"), F.max("name_score").alias("s"), F.count("*").alias("n"), F.min("rank").alias("first_rank"))
    score = F.least(F.lit(1.0), F.lit(0.74) * F.col("r") + F.lit(0.21) * F.col("s") + F.least(F.lit(0.08), F.lit(0.04) * (F.col("n") - 1)))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "first_rank")
    told = per.withColumn("score", score).withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    best = told.where("place = 1").withColumn("margin", F.greatest(F.lit(0.0), F.col("score") - F.coalesce("next", F.lit(0.0))))
    best = best.where((F.col("score") >= MIN_SCORE) & (F.col("next").isNull() | (F.col("margin") >= MIN_MARGIN)))
    confidence = F.least(F.lit(1.0), (F.col("score") * 0.75 + F.least(F.lit(0.25), F.col("margin"))) * (F.lit(1.0) if support is None else support))
    return best.select("query_id", "document_key", "score", "margin", confidence.alias("confidence"))


def keep_or_replace(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Preference after a new proposal: the same document is reinforced, another replaces it from REPLACEMENT_MARGIN more on."""
    e = existing.select("query_id", *[F.col(c).alias(f"e_{c}") for c in ("document_key", "score", "margin", "confidence")])
    both = proposed.join(e, "query_id", "full_outer")
    same = F.col("document_key") == F.col("e_document_key")
    new = F.col("e_document_key").isNull() | (F.col("score") >= F.col("e_score") + REPLACEMENT_MARGIN)
    pick = lambda c: F.when(F.col("document_key").isNull(), F.col(f"e_{c}")).when(same, F.greatest(c, f"e_{c}")).when(new, F.col(c)).otherwise(F.col(f"e_{c}"))
    return both.select("query_id", *[pick(c).alias(c) for c in ("document_key", "score", "margin", "confidence")])


def name_scores(name: Column, question: Column) -> Column:
    """How well a document's name fits a question: overlap of the words that tell documents apart."""
    return T.name_overlap(T.informative_tokens(name), T.informative_tokens(question))


def matches_preference(document_id: Column, version_id: Column, names: Column, wanted_id: Column, wanted_versions: Column, wanted_names: Column) -> Column:
    """Whether evidence is of the preferred document: by ids if both have one, else by one of its versions, else by a common name."""
    by_version = F.coalesce(F.array_contains(wanted_versions, version_id), F.lit(False))
    by_name = F.coalesce(F.arrays_overlap(names, wanted_names), F.lit(False))
    return F.when(document_id.isNotNull() & wanted_id.isNotNull(), document_id == wanted_id).otherwise(by_version | by_name)


def passed_through(evidence: DataFrame, top_k: int) -> DataFrame:
    """The best ``top_k`` rows per question by rank, as a selection without quotas."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return evidence.withColumn("selected_rank", place).where(F.col("selected_rank") <= top_k)


def selection_summary(candidates: DataFrame, selected: DataFrame, top_k: int) -> DataFrame:
    """``(query_id, n_candidates, n_selected, n_documents, relaxed)``: ``relaxed`` if a document has more rows than its quota, as others had too few."""
    limit = max(1, math.ceil(top_k * UNPREFERRED_MAX))
    per = selected.groupBy("query_id", "document_key").agg(F.count("*").alias("n"))
    told = per.groupBy("query_id").agg(F.sum("n").alias("n_selected"), F.count("*").alias("n_documents"), (F.max("n") > limit).alias("relaxed"))
    return candidates.groupBy("query_id").agg(F.count("*").alias("n_candidates")).join(told, "query_id", "left").na.fill({"n_selected": 0, "n_documents": 0, "relaxed": False})


def claim_order(claims: DataFrame, most: int = 3) -> DataFrame:
    """``(query_id, need_id, position, selected)``: open needs in the order they are worked at, of which the first ``most`` now.

    ``claims``: query_id, need_id, coverage, status. Missing ones come first, then the least covered, then by id.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy((F.col("status") != "missing").cast("int"), "coverage", "need_id"))
    return claims.where("status <> 'supported'").select("query_id", "need_id", place.alias("position"), (place <= most).alias("selected"))


def rerank(evidence: DataFrame, score: str = "rerank_score", k: int | None = None) -> DataFrame:
    """``evidence`` (query_id, rank, and a scorer's column) in the scorer's order, with ``original_rank``, ``score_used`` and ``fallback``.

    Any column can be the scorer, so a model's Pandas UDF plugs in here. Scores count within 0 to 1. A row without a score gets
    ``(n - rank + 1) / n`` and stands behind all that have one. Ties keep their order.
    """
    n = F.count("*").over(Window.partitionBy("query_id"))
    place = F.least(F.greatest(F.col("rank"), F.lit(1)), n)
    missing = F.col(score).isNull() | F.isnan(score)
    told = evidence.withColumn("fallback", missing).withColumn("score_used", F.when(missing, (n - place + 1) / n).otherwise(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))))
    order = Window.partitionBy("query_id").orderBy("fallback", F.round("score_used", 9).desc(), "rank")
    told = told.withColumn("original_rank", F.col("rank")).withColumn("_place", F.row_number().over(order)).withColumn("rank", F.col("_place")).drop("_place")
    return told.where(F.col("rank") <= k) if k else told


def rerank_summary(reranked: DataFrame) -> DataFrame:
    """``(query_id, n_candidates, n_fallbacks, n_moved)`` of a reranking."""
    return reranked.groupBy("query_id").agg(F.count("*").alias("n_candidates"), F.count_if("fallback").alias("n_fallbacks"), F.count_if(F.col("rank") != F.col("original_rank")).alias("n_moved"))
