"""Quality of retrieval and answers, and agreement between repeated runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import text as T


def expectation_matches(expectations: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(case_id, expectation_id, rank)``: evidence of a case that satisfies an expectation.

    ``expectations``: case_id, expectation_id, document_id (null: any), fragments (all must be in the text, blanks and case aside).
    """
    clean = lambda c: T.folded(T.normalize_text(c))
    e = evidence.select("case_id", "rank", F.col("document_id").alias("_found"), clean(F.col("text")).alias("_text"))
    both = expectations.join(e, "case_id")
    has = F.forall("fragments", lambda f: F.contains(F.col("_text"), clean(f)))
    return both.where((F.col("document_id").isNull() | (F.col("document_id") == F.col("_found"))) & has).select("case_id", "expectation_id", "rank")


def recall_at_k(expectations: DataFrame, matches: DataFrame, k: int) -> DataFrame:
    """``(case_id, value)``: share of expectations that different pieces of the top k satisfy, one each (maximum matching)."""

    def matched(frame: pd.DataFrame) -> pd.DataFrame:
        wanted = {e: sorted(set(g["rank"])) for e, g in frame[frame["rank"].notna()].groupby("expectation_id")}
        owner: dict = {}

        def place(e, seen: set) -> bool:
            for rank in wanted[e]:
                if rank not in seen:
                    seen.add(rank)
                    if rank not in owner or place(owner[rank], seen):
                        owner[rank] = e
                        return True
            return False

        hits = sum(place(e, set()) for e in sorted(wanted))
        return pd.DataFrame({"case_id": [frame["case_id"].iloc[0]], "value": [hits / frame["expectation_id"].nunique()]})

    rows = expectations.select("case_id", "expectation_id").join(matches.where(F.col("rank") <= k), ["case_id", "expectation_id"], "left")
    return rows.select("case_id", "expectation_id", "rank").groupBy("case_id").applyInPandas(matched, f"case_id {rows.schema['case_id'].dataType.simpleString()}, value double")


def reciprocal_rank(cases: DataFrame, matches: DataFrame) -> DataFrame:
    """``(case_id, value)``: 1 / the first matching rank over all evidence, 0 if none matches."""
    first = matches.groupBy("case_id").agg(F.min("rank").alias("r"))
    return cases.select("case_id").join(first, "case_id", "left").select("case_id", F.coalesce(1.0 / F.col("r"), F.lit(0.0)).alias("value"))


def citation_hit_rate(cases: DataFrame, cited: DataFrame, matches: DataFrame) -> DataFrame:
    """``(case_id, value)``: share of citations whose evidence matches an expectation; 0 without citations."""
    hit = cited.join(matches.select("case_id", "rank").distinct().withColumn("hit", F.lit(1)), ["case_id", "rank"], "left")
    rate = hit.groupBy("case_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("v"))
    return cases.select("case_id").join(rate, "case_id", "left").select("case_id", F.coalesce("v", F.lit(0.0)).alias("value"))


def with_status(cases: DataFrame, values: DataFrame) -> DataFrame:
    """All cases with value and status: computed, or not_applicable for those without expectations."""
    told = cases.select("case_id").join(values, "case_id", "left")
    return told.select("case_id", "value", F.when(F.col("value").isNull(), "not_applicable").otherwise("computed").alias("status"))


def mean_metric(values: DataFrame) -> DataFrame:
    """``(value, status, n)``: mean over computed values; not_implemented if all are, else not_applicable if none is computed."""
    n = F.count(F.when(F.col("status") == "computed", 1))
    mean = F.avg(F.when(F.col("status") == "computed", F.col("value")))
    status = F.when(n > 0, "computed").when((F.count("*") > 0) & (F.count(F.when(F.col("status") != "not_implemented", 1)) == 0), "not_implemented").otherwise("not_applicable")
    return values.agg(mean.alias("value"), status.alias("status"), n.alias("n"))


def _pairs(attempts: DataFrame, value: str) -> DataFrame:
    a = attempts.select("case_id", F.col("attempt").alias("a"), F.col(value).alias("va"))
    b = attempts.select("case_id", F.col("attempt").alias("b"), F.col(value).alias("vb"))
    return a.join(b, "case_id").where("a < b")


def _mean_over_pairs(attempts: DataFrame, value: str, similarity: Column) -> DataFrame:
    """Mean over pairs of attempts of a case; a case with one attempt counts once as 1."""
    alone = attempts.groupBy("case_id").agg(F.count("*").alias("n")).where("n = 1").select(F.lit(1.0).alias("s"))
    return _pairs(attempts, value).select(similarity.cast("double").alias("s")).unionByName(alone).agg(F.avg("s").alias("value"), F.count("*").alias("n"))


def exact_agreement(attempts: DataFrame, value: str) -> DataFrame:
    """``(value, n)``: how often two attempts (case_id, attempt) of a case agree, nulls alike.

    Pairs of equal values are counted by value, so a case with many attempts is never paired with itself.
    """
    per = attempts.groupBy("case_id", value).agg(F.count("*").alias("c")).groupBy("case_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"))
    told = per.select(F.when(F.col("n") == 1, 1.0).otherwise(F.col("same")).alias("same"), F.when(F.col("n") == 1, 1.0).otherwise(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    return told.agg((F.sum("same") / F.sum("pairs")).alias("value"), F.sum("pairs").cast("long").alias("n"))


def jaccard_agreement(attempts: DataFrame, value: str) -> DataFrame:
    """``(value, n)``: mean Jaccard similarity of the sets of two attempts of a case; two empty sets are alike."""
    union = F.size(F.array_union("va", "vb"))
    return _mean_over_pairs(attempts, value, F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("va", "vb")) / union))


def success_rate(attempts: DataFrame) -> DataFrame:
    n = F.count("*")
    return attempts.agg(F.when(n > 0, F.avg((F.col("status") == "succeeded").cast("int"))).alias("value"), n.alias("n"))


def stage_rates(diagnostics: DataFrame) -> DataFrame:
    """``(stage, n, repair_rate, fallback_rate)`` of (stage, outcome, repaired)."""
    return diagnostics.groupBy("stage").agg(F.count("*").alias("n"), F.avg(F.col("repaired").cast("int")).alias("repair_rate"), F.avg((F.col("outcome") == "fallback").cast("int")).alias("fallback_rate"))


def normal_answer(answers: DataFrame, column: str = "answer") -> DataFrame:
    """``answers`` with ``normal``: NFKC, folded, single blanks. Unicode normalisation has no built-in, so this one column is Arrow."""
    import unicodedata

    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: " ".join(unicodedata.normalize("NFKC", v).casefold().split()) if v is not None else "")

    return answers.withColumn("normal", nfkc(column))


def journey(attempts: DataFrame) -> DataFrame:
    """``(case_id, n_attempts, n_retries, n_changes, main_kind)`` of attempts (case_id, attempt, kind) in order; ties to the kind met first."""
    from pyspark.sql.window import Window

    told = attempts.withColumn("before", F.lag("kind").over(Window.partitionBy("case_id").orderBy("attempt")))
    per = told.groupBy("case_id").agg(F.count("*").alias("n_attempts"), F.count(F.when(F.col("before").isNotNull() & (F.col("before") != F.col("kind")), 1)).alias("n_changes"))
    kinds = attempts.groupBy("case_id", "kind").agg(F.count("*").alias("c"), F.min("attempt").alias("first"))
    main = kinds.groupBy("case_id").agg(F.max_by("kind", F.struct("c", (-F.col("first")).alias("first"))).alias("main_kind"))
    return per.join(main, "case_id").select("case_id", "n_attempts", (F.col("n_attempts") - 1).alias("n_retries"), "n_changes", "main_kind")
