"""Rank fusion of several ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import ranked

K = 60
ORIGINAL_WEIGHT, VARIANT_WEIGHT = 1.2, 1.0


def evidence_key(chunk_id: Column, text: Column) -> Column:
    """Identity for fusion: the chunk, or the stripped text where there is none."""
    return F.when(chunk_id.isNotNull(), F.concat(F.lit("chunk:"), chunk_id.cast("string"))).otherwise(F.concat(F.lit("text:"), F.sha2(F.trim(text), 256)))


def need_key(text: Column, document_id: Column, version_id: Column) -> Column:
    """Identity within an information need: text in lower case with its document and version."""
    return F.sha2(F.concat_ws("|", F.lower(F.trim(text)), F.coalesce(document_id.cast("string"), F.lit("")), F.coalesce(version_id.cast("string"), F.lit(""))), 256)


def stability_key(chunk_id: Column, text: Column) -> Column:
    """Identity between repeated runs: the chunk, or the text as it stands."""
    return F.when(chunk_id.isNotNull(), F.concat(F.lit("chunk:"), chunk_id.cast("string"))).otherwise(F.concat(F.lit("text:"), F.sha2(text, 256)))


def reciprocal_rank_fusion(lists: list[tuple[str, float, DataFrame]], k: int, id_column: str = "doc_id", constant: int = K) -> DataFrame:
    """``(query_id, id, score, sources, details, rank)`` of (name, weight, ranked list with query_id, id, rank, score).

    One union and one aggregate by (question, key): the score is the sum of weight / (constant + rank); ``sources`` names the lists
    that have the key and ``details`` has each one's rank, score, weight and part, in order of the names. Ties go to the key as
    a string.
    """
    rows = []
    for name, weight, df in lists:
        own = F.col("score").cast("double") if "score" in df.columns else F.lit(None).cast("double")
        w = F.lit(float(weight))
        rows.append(df.select("query_id", id_column, F.struct(F.lit(name).alias("source"), F.col("rank").cast("int").alias("rank"), own.alias("score"), w.alias("weight"), (w / (F.lit(constant) + F.col("rank"))).alias("part")).alias("d")))
    union = reduce(DataFrame.unionByName, rows)
    fused = union.groupBy("query_id", id_column).agg(F.sum("d.part").alias("score"), F.array_sort(F.collect_list("d")).alias("details"))
    fused = fused.withColumn("sources", F.array_join(F.array_distinct(F.transform("details", lambda x: x["source"])), ","))
    return ranked(fused, k, id_column)


def fuse_variants(hits: DataFrame, k: int, id_column: str = "doc_id", constant: int = K) -> DataFrame:
    """Fusion over query variants: ``hits`` (query_id, variant, id, rank), where variant 0 is the original question and weighs more."""
    weight = F.when(F.col("variant") == 0, ORIGINAL_WEIGHT).otherwise(VARIANT_WEIGHT)
    fused = hits.groupBy("query_id", id_column).agg(F.sum(weight / (constant + F.col("rank"))).alias("score"), F.countDistinct("variant").alias("matches"))
    return ranked(fused, k, id_column)


def distinct_variants(variants: DataFrame, most: int = 4) -> DataFrame:
    """``(query_id, variant, question)``: variants (query_id, position, question) without repeats of folded text, original (position 0) first."""
    from pyspark.sql.window import Window

    key = F.lower(F.trim(F.regexp_replace("question", r"\s+", " ")))
    first = Window.partitionBy("query_id", "key").orderBy("position")
    kept = variants.withColumn("key", key).withColumn("n", F.row_number().over(first)).where("n = 1 and key <> ''")
    order = Window.partitionBy("query_id").orderBy("position")
    return kept.withColumn("variant", F.row_number().over(order) - 1).where(F.col("variant") < most).select("query_id", "variant", "question")
