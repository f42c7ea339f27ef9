"""How the driver's tables stand for documents, versions, questions and attempts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import lexical, registry
from attestor.sources.scratch import materialise
from attestor.sources.tables import table

#: Hits of a question that are kept as a table.
MOST = 40
WORDS_SQL = r"regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table is one file and one task; texts are dealt to all cores before regular expressions run over them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs.inputFiles()) == 1 else docs


_kept: dict[tuple, object] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]) -> object:
    """What ``build`` made of these tables before in this session; a table whose files are others is built anew."""
    key = (spark.sparkContext.applicationId, name, *sorted(table(spark, sf_dir, "documents").inputFiles()), *sorted(table(spark, sf_dir, "benchmark").inputFiles()))
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The word index of all documents, which is a table that all lexical queries read."""
    return kept(spark, sf_dir, "index", lambda: lexical.build_index(documents(spark, sf_dir)))


def lexical_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Best documents of every question by BM25: the best MOST are a table, of which a query takes its ``k``."""
    if k > MOST:
        raise ValueError(f"at most {MOST}")
    found = kept(spark, sf_dir, "hits", lambda: materialise(lexical.bm25_topk(index(spark, sf_dir), questions(spark, sf_dir), MOST), "hits", keep=True))
    return found.where(F.col("rank") <= k)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a document, each of its rows a version; dates follow from the id, and every fifth version has no publication date."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), "doc_id", F.col("doc_id").alias("version_id"))
    numbered = registry.promote(registry.number_versions(rows)).drop("version_id")
    return numbered.select(
        "document_id",
        "doc_id",
        "version_number",
        "is_latest",
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("doc_id").cast("int"))).alias("uploaded_at"),
        F.when(F.col("doc_id") % 5 != 0, F.lit("2020-01-01").cast("timestamp") + F.make_interval(days=(F.col("doc_id") % 1500).cast("int"))).alias("published_at"),
        F.concat(F.col("document_id"), F.lit(" Draft "), F.col("version_number").cast("string")).alias("title"),
        F.concat(F.lit("files/"), F.col("document_id"), F.lit("_v"), F.col("version_number").cast("string"), F.lit(".PDF")).alias("filename"),
    )


VERSIONS_SQL = """versions as (
    select *, document_id || ' Draft ' || version_number as title, 'files/' || document_id || '_v' || version_number || '.PDF' as filename
    from (select source as document_id, doc_id, row_number() over (partition by source order by doc_id) as version_number,
                 row_number() over (partition by source order by doc_id desc) = 1 as is_latest,
                 timestamp '2024-01-01' + to_hours(doc_id) as uploaded_at,
                 case when doc_id % 5 <> 0 then timestamp '2020-01-01' + to_days(cast(doc_id % 1500 as int)) end as published_at
          from documents))"""


def candidates(spark: SparkSession, sf_dir: str, k: int = 40) -> DataFrame:
    """Evidence of every question: its best ``k`` documents by BM25 with their version data."""
    return lexical_hits(spark, sf_dir, k).join(versions(spark, sf_dir), "doc_id")


BM25_SQL = rf"""cut as materialized (select doc_id, {WORDS_SQL.format("text")} as words from documents),
    size as materialized (select count(*) as n, avg(len(words)) as mean_length from cut),
    asked as materialized (select query_id, term, count(*) as weight from (select item_id as query_id, unnest({WORDS_SQL.format("text")}) as term from benchmark) group by all),
    tf as materialized (select doc_id, length, term, count(*) as tf from (select doc_id, len(words) as length, unnest(words) as term from cut)
           where term in (select term from asked) group by all),
    df as materialized (select term, count(*) as df from tf group by 1),
    scored as materialized (select query_id, doc_id, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) as score
               from tf join df using (term) join asked using (term) cross join size group by all),
    bm25 as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, cast(doc_id as varchar)) as rank
             from scored where score > 0))"""


def evidence_sql(k: int = 40) -> str:
    return f"{BM25_SQL}, {VERSIONS_SQL}, evidence as materialized (select b.query_id, b.doc_id, b.score, b.rank, v.* exclude (doc_id) from bm25 b join versions v using (doc_id) where b.rank <= {k})"


#: Questions in English around the benchmark's invented passages, so that rules have something to find.
TEMPLATES = (
    "Compare version 2 with v4 of the policy about {} and how do they differ?",
    "What is the latest release of {}?",
    "Explain the architecture of {} and why does it matter?",
    "Use all older versions of the report on {}",
    "Which passage is the most relevant to {}?",
    "oldest and newest versions of {}",
    "Find the 2025 documents, page 3, written by {}",
    "What are the flows of {} and how do they function as well as which ones fail?",
    "current and previous policy on {}",
    "{}",
)


def rule_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark")
    text = F.col("text")
    asked = F.lit(None).cast("string")
    for i, t in enumerate(TEMPLATES):
        before, after = t.split("{}")
        asked = F.when(F.col("item_id") % len(TEMPLATES) == i, F.concat(F.lit(before), text, F.lit(after))).otherwise(asked)
    return q.select(F.col("item_id").alias("query_id"), asked.alias("question"))


RULE_QUESTIONS_SQL = "questions as (select item_id as query_id, case item_id % {} {} end as question from benchmark)".format(
    len(TEMPLATES), " ".join(f"when {i} then '{t.split('{}')[0]}' || text || '{t.split('{}')[1]}'" for i, t in enumerate(TEMPLATES))
)
