"""What a run keeps between steps: pruned evidence, traces, outcomes, and checks that rows keep their promises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def prune_evidence(evidence: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(links, evidence)``: approved (query_id, need_id, key) of the evidence (query_id, key, ...), and the evidence that a need still refers to."""
    links = approved.select("query_id", "need_id", "key").distinct().join(evidence.select("query_id", "key").distinct(), ["query_id", "key"], "left_semi")
    return links, evidence.join(links.select("query_id", "key").distinct(), ["query_id", "key"], "left_semi")


def number_steps(trace: DataFrame, by: str = "run_id", order: str = "at", tie: str = "id") -> DataFrame:
    """``trace`` with ``step`` from 1 in each run, in order of time."""
    return trace.withColumn("step", F.row_number().over(Window.partitionBy(by).orderBy(order, tie)))


def outcome(presented: Column, blocked: Column, answer: Column) -> Column:
    """What became of a question: as it was presented, else what older runs say: refused, answered or neither."""
    told = F.coalesce(answer, F.lit("")) != ""
    return F.coalesce(presented, F.when(F.coalesce(blocked, F.lit(False)), "legacy_refusal").when(told, "legacy_answer").otherwise("legacy_no_answer"))


def presentation_signature(schema: Column, outcome_: Column, body: Column, supported: Column, unresolved: Column, citations: Column) -> Column:
    """Eight parts by which two presented answers are of one shape; three for an answer that was not presented (null schema)."""
    yes = lambda c: F.when(c, "True").otherwise("False")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    has_body = yes(F.coalesce(body, F.lit("")) != "")
    whole = F.array(
        F.concat(F.lit("schema:"), schema), F.concat(F.lit("outcome:"), outcome_), F.concat(F.lit("body:"), has_body),
        F.concat(F.lit("supported_section:"), yes(size(supported) > 0)), F.concat(F.lit("supported_count:"), size(supported).cast("string")),
        F.concat(F.lit("unresolved_section:"), yes(size(unresolved) > 0)), F.concat(F.lit("unresolved_count:"), size(unresolved).cast("string")),
        F.concat(F.lit("citation_count:"), F.coalesce(citations, F.lit(0)).cast("string")),
    )
    return F.when(schema.isNull(), F.array(F.lit("absent"), outcome_, F.concat(F.lit("body:"), has_body))).otherwise(whole)


def with_context(chunks: DataFrame, contextual: DataFrame, by: str = "document_version_id") -> DataFrame:
    """Chunks with their contextualised text, joined one to one by (version, ordinal); a chunk without it, or with another hash, is an error.

    ``chunks`` (by, ordinal, content_hash, ...), ``contextual`` (by, ordinal, content_hash, contextualized_text).
    """
    told = contextual.groupBy(by, "ordinal").agg(F.count("*").alias("_n"), F.min("content_hash").alias("_hash"), F.min("contextualized_text").alias("contextualized_text"))
    both = chunks.withColumn("_own", F.lit(True)).join(told, [by, "ordinal"], "full_outer")
    fault = F.when(F.col("_own").isNull(), "a context without its chunk").when(F.col("_n").isNull(), "a chunk without its context").when(F.col("_n") > 1, "two contexts of one chunk").when(F.col("_hash") != F.col("content_hash"), "a context of another text")
    checked = both.withColumn("ordinal", F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.lit(" at ordinal "), F.col("ordinal").cast("string"))).cast("int")).otherwise(F.col("ordinal")))
    return checked.select(*chunks.columns, "contextualized_text")


def integrity_faults(chunks: DataFrame, contextual: DataFrame, by: str = "document_version_id") -> DataFrame:
    """``(by, n_chunks, n_missing, n_extra, n_changed)``: what ``with_context`` would object to, by version."""
    own = chunks.select(by, "ordinal", F.col("content_hash").alias("a"), F.lit(1).alias("own"))
    theirs = contextual.select(by, "ordinal", F.col("content_hash").alias("b"), F.lit(1).alias("theirs"))
    both = own.join(theirs, [by, "ordinal"], "full_outer")
    return both.groupBy(by).agg(F.count("own").alias("n_chunks"), F.count_if(F.col("theirs").isNull()).alias("n_missing"), F.count_if(F.col("own").isNull()).alias("n_extra"), F.count_if(F.col("a") != F.col("b")).alias("n_changed"))


def attempt_faults(attempts: DataFrame) -> DataFrame:
    """``(query_id, need_id, faults)`` of attempts (query_id, need_id, attempt, ranks, n_retrieved, n_added, status, score) that break a promise.

    Attempts count from 1 without a gap, ranks are unique, no more is added than was retrieved, scores lie in 0 to 1, and what is
    supported has evidence.
    """
    per = attempts.groupBy("query_id", "need_id").agg(
        (F.sort_array(F.collect_list("attempt")) != F.sequence(F.lit(1), F.count("*").cast("int"))).alias("gap"),
        F.bool_or(F.size("ranks") != F.size(F.array_distinct("ranks"))).alias("rank"),
        F.bool_or(F.col("n_added") > F.col("n_retrieved")).alias("added"),
        F.bool_or(~F.col("score").between(0, 1)).alias("score"),
        F.bool_or((F.col("status") == "supported") & (F.size("ranks") == 0)).alias("support"),
    )
    names = {"gap": "attempts_not_in_sequence", "rank": "ranks_not_unique", "added": "added_more_than_retrieved", "score": "score_out_of_range", "support": "supported_without_evidence"}
    faults = F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in names.items()]))
    return per.select("query_id", "need_id", faults.alias("faults")).where(F.size("faults") > 0)


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """``(query_id, n_retries, last_status, query_changed, n_lookups)`` of a question's attempts (query_id, attempt, query, status, n_lookups)."""
    return attempts.groupBy("query_id").agg((F.count("*") - 1).alias("n_retries"), F.max_by("status", "attempt").alias("last_status"), (F.countDistinct("query") > 1).alias("query_changed"), F.sum("n_lookups").alias("n_lookups"))


def merged_phrase(base: Column, requirement: Column, noise: tuple[str, ...]) -> Column:
    """A retrieval phrase with the words of a requirement that it has not, unless they carry nothing."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))
    lower = F.transform(words(base), lambda w: F.lower(w))
    new = F.filter(words(requirement), lambda w: ~F.lower(w).isin(*noise) & ~F.array_contains(lower, F.lower(w)))
    once = F.filter(new, lambda w, i: F.array_position(F.transform(new, lambda x: F.lower(x)), F.lower(w)) == i + 1)
    return F.trim(F.concat_ws(" ", base, F.array_join(once, " ")))


def middle_cut(text: Column, most: int, marker: str = " [...] ") -> Column:
    """Text of at most ``most`` characters: beginning and end with a marker between; the beginning has the odd character."""
    room = most - len(marker)
    if room < 2:
        raise ValueError("no room besides the marker")
    head = (room + 1) // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, head)), F.lit(marker), F.ltrim(F.right(text, F.lit(room - head)))))


def sentence_cut(text: Column, most: int) -> Column:
    """Text of at most ``most`` characters: up to the last sentence's end in the second half, else to the last whole word."""
    head = F.substring(text, 1, most)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    word = F.regexp_extract(head, r"(?s)^(.*\S)\s", 1)
    cut = F.when(F.length(sentence) >= most // 2, sentence).when(word != "", word).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.rtrim(cut))


#: Ends of setting names that are kept out of snapshots.
SECRET_NAMES = ("password", "secret", "token", "api_key", "access_key", "credentials", "authorization")


def redacted(settings: Column) -> Column:
    """A map of settings without those whose name, in snake case, is or ends with a secret's."""
    snake = lambda k: F.lower(F.regexp_replace(F.regexp_replace(k, r"([a-z0-9])([A-Z])", "$1_$2"), r"[\s-]+", "_"))
    return F.map_filter(settings, lambda k, v: ~snake(k).rlike(f"(?:^|_)(?:{'|'.join(SECRET_NAMES)})$"))


def collection_faults(points: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``(name, size, n)``: vectors of a collection (a map column ``vectors``) that have no known name, or another size than it."""
    known = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]) if sizes else F.create_map().cast("map<string,int>")
    told = points.select(F.explode("vectors").alias("name", "v")).groupBy("name", F.size("v").alias("size")).agg(F.count("*").alias("n"))
    return told.where(F.coalesce(F.try_element_at(known, F.col("name")) != F.col("size"), F.lit(True)))


def source_context(title: Column, filename: Column, version: Column, published: Column, uploaded: Column, versioned: bool, dated: bool) -> Column:
    """What a reader is told of a source, as (key, value) pairs in order: its name always, versions and dates where the question is about them."""
    pair = lambda key, value: F.when(F.nullif(F.trim(value), F.lit("")).isNotNull(), F.struct(F.lit(key).alias("key"), value.alias("value")))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    pairs = [pair("document", F.coalesce(F.nullif(F.trim(title), F.lit("")), filename))]
    if versioned:
        pairs.append(pair("version", version.cast("string")))
    if dated:
        pairs += [pair("published", day(published)), pair("uploaded", day(uploaded))]
    return F.array_compact(F.array(*pairs))
