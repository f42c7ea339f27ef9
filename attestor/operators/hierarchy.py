"""Two-level context hierarchy: groups of similar chunks per document, and retrieval that goes through it."""

from __future__ import annotations

from collections.abc import Callable
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.sources.scratch import materialise

from .lexical import ranked
from .vectors import cosine, knn_topk, knn_within

TARGET, MOST_GROUPS = 8, 24
DOCUMENTS, SECTIONS, CHUNKS = 8, 24, 80


def cosine_pairs(points: DataFrame, group: str = "group_id") -> DataFrame:
    """``(group, a, b, similarity)`` of the pairs a < b inside each group (group, id, vector): for groups as small as a document."""
    left = points.select(group, F.col("id").alias("a"), F.col("vector").alias("va"))
    right = points.select(group, F.col("id").alias("b"), F.col("vector").alias("vb"))
    return left.join(right, group).where("a < b").select(group, "a", "b", cosine(F.col("va"), F.col("vb")).alias("similarity"))


def cohesion(points: DataFrame, group: str = "group_id") -> DataFrame:
    """``(group, id, cohesion)``: mean cosine to the others of the group; alone: 0.

    A mean of cosines is one dot product with the sum of unit vectors, so no pair is formed and one row per dimension is shuffled.
    """
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    unit = points.withColumn("_u", F.transform("vector", lambda v: v.cast("double") / norm))
    sums = unit.select(group, F.posexplode("_u").alias("i", "v")).groupBy(group, "i").agg(F.sum("v").alias("v"))
    total = sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("_sum"))
    count = points.groupBy(group).agg(F.count("*").alias("_n"))
    dot = F.aggregate(F.zip_with("_u", "_sum", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return unit.join(total, group).join(count, group).select(group, "id", F.when(F.col("_n") > 1, (dot - 1) / (F.col("_n") - 1)).otherwise(0.0).alias("cohesion"))


def group_chunks(chunks: DataFrame, target: int = TARGET, most: int = MOST_GROUPS) -> DataFrame:
    """``(document_version_id, ordinal, cluster)``: greedy groups of similar chunks of each document (ordinal, vector).

    The seed is the chunk left that is least like all others; it takes its nearest ones left up to the group size, which is
    the target or what keeps groups at ``most``. Groups are numbered by their smallest chunk. Sequential by nature: one document
    at a time, in one task, which compares a seed at a time, so memory is that of the document's vectors.
    """

    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ordinal")
        x = np.array(frame["vector"].tolist(), dtype=np.float64)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        size = max(target, math.ceil(len(x) / most))
        # a chunk's similarities to all others add up to its product with the sum of all
        means = np.round((x @ x.sum(axis=0) - (x * x).sum(axis=1)) / max(1, len(x) - 1), 12)
        left, cluster, groups = np.ones(len(x), dtype=bool), np.zeros(len(x), dtype=int), 0
        for seed in np.lexsort((np.arange(len(x)), means)):
            if not left[seed]:
                continue
            left[seed] = False
            others = np.flatnonzero(left)
            near = others[np.lexsort((others, -np.round(x[others] @ x[seed], 12)))][: size - 1]
            left[near] = False
            cluster[[seed, *near]] = groups
            groups += 1
        first = np.full(groups, len(x))
        np.minimum.at(first, cluster, np.arange(len(x)))
        place = np.empty(groups, dtype=int)
        place[np.argsort(first)] = np.arange(groups)
        return pd.DataFrame({"document_version_id": frame["document_version_id"], "ordinal": frame["ordinal"], "cluster": place[cluster]})

    kind = chunks.schema["document_version_id"].dataType.simpleString()
    return chunks.select("document_version_id", "ordinal", "vector").groupBy("document_version_id").applyInPandas(greedy, f"document_version_id {kind}, ordinal int, cluster int")


def section_spans(chunks: DataFrame) -> DataFrame:
    """``(document_version_id, cluster, section_id, first_page, last_page, n_chunks, titles)`` per section; titles in order of chunks."""
    titles = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("section_title").isNotNull(), F.struct("ordinal", "section_title")))), lambda x: x["section_title"]))
    spans = chunks.groupBy("document_version_id", "cluster").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count("*").alias("n_chunks"), titles.alias("titles"))
    return spans.withColumn("section_id", F.concat_ws(":", F.col("document_version_id").cast("string"), F.lit("section"), F.col("cluster").cast("string")))


def centroids(points: DataFrame, group: str) -> DataFrame:
    """``(group, vector)``: mean vector of each group, one row per dimension in the shuffle."""
    sums = points.select(group, F.posexplode("vector").alias("i", "v")).groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vector"))


def route(questions: DataFrame, documents: DataFrame, sections: DataFrame, chunks: DataFrame, k: int = 10, n_documents: int = DOCUMENTS, n_sections: int = SECTIONS, admits: Callable[[pd.DataFrame, dict], np.ndarray] | None = None) -> DataFrame:
    """``(query_id, doc_id, score, rank, document_id, section_id)``: best chunks inside the best sections of the best documents.

    ``documents`` (document_id, vector), ``sections`` (section_id, document_id, vector), ``chunks`` (doc_id, section_id, document_id,
    vector), ``questions`` (query_id, vector). Each level's winners, at most ``n`` per question, are the groups of the next, whose
    chunks and questions are multiplied in tiles. ``admits`` tells, as in ``knn_topk``, which chunks a question may have, from other
    columns of both, before the best are chosen. Vectors of length 0 are invisible.
    """
    top = knn_topk(documents.select(F.col("document_id").alias("doc_id"), "vector"), questions, n_documents).select("query_id", F.col("doc_id").alias("document_id"), F.col("score").alias("document_score"))
    inside = sections.join(top, "document_id").join(questions.select("query_id", F.col("vector").alias("_q")), "query_id")
    best = inside.select("query_id", "section_id", "document_id", "document_score", cosine(F.col("vector"), F.col("_q")).alias("score")).where("score is not null")
    best = ranked(best, n_sections, "section_id").select("query_id", "section_id", "document_id", "document_score", F.col("score").alias("section_score"))
    best = materialise(best, "routed-sections", keep=True)
    asked = materialise(best.select("query_id", "section_id").distinct().join(questions, "query_id"), "routed-questions", keep=True)
    hits = knn_within(chunks.drop("document_id"), asked, "section_id", min(k, CHUNKS), admits).join(best, ["query_id", "section_id"])
    return ranked(hits.select("query_id", "doc_id", "document_id", "section_id", "document_score", "section_score", "score"), min(k, CHUNKS))
