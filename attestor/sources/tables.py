"""Reading of files and tables, and writing of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that have a parser.
PARSERS = {"pdf": "pdf", "md": "markdown", "markdown": "markdown", "txt": "text"}
EVALUATION_SCHEMA = (
    "schema_version string, name string, version string, description string, default_top_k int, "
    "cases array<struct<id:string,question:string,expected_answer:string,top_k:int,tags:array<string>,"
    "expected_evidence:array<struct<description:string,document_id:string,document_version_id:string,metadata:map<string,string>,text_contains:array<string>>>>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_files(spark: SparkSession, path: str, most_bytes: int = 25 << 20) -> DataFrame:
    """``(path, length, parser, text, error)`` of files: the parser by suffix, the text as UTF-8 without a mark, else as Latin-1.

    Files of other kinds, and those over ``most_bytes``, come with an error and without text; a file of neither never fails the job.
    PDF text needs a parser that is not part of this library, so PDF files come with an error too.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    parser = F.create_map(*[F.lit(x) for pair in PARSERS.items() for x in pair])[suffix]
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8"))
    text = F.regexp_replace(F.coalesce(utf8, F.decode("content", "ISO-8859-1")), "^\ufeff", "")
    told = files.select("path", "length", parser.alias("parser"), text.alias("_text"))
    error = F.when(F.col("length") > most_bytes, "too_large").when(F.col("parser").isNull(), "unsupported_type").when(F.col("parser") == "pdf", "no_pdf_parser")
    return told.withColumn("error", error).select("path", "length", "parser", F.when(F.col("error").isNull(), F.col("_text")).alias("text"), "error")


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """One row per case of evaluation sets: ``(dataset, case_id, question, top_k, expectation_id, document_id, fragments)`` exploded."""
    sets = spark.read.schema(EVALUATION_SCHEMA).json(path, multiLine=True)
    cases = sets.select(F.col("name").alias("dataset"), "default_top_k", F.explode("cases").alias("c"))
    rows = cases.select("dataset", F.col("c.id").alias("case_id"), "c.question", F.coalesce("c.top_k", "default_top_k").alias("top_k"), F.posexplode_outer("c.expected_evidence").alias("expectation_id", "e"))
    return rows.select("dataset", "case_id", "question", "top_k", "expectation_id", F.col("e.document_id").alias("document_id"), F.col("e.text_contains").alias("fragments"))


def searchable(points: DataFrame, contextual: bool = False) -> DataFrame:
    """``(doc_id, text, evidence_text)`` of chunk points: what is searched and what is returned; summaries and blanks go."""
    own = F.nullif(F.trim("text"), F.lit(""))
    searched = F.coalesce(F.nullif(F.trim("contextualized_text"), F.lit("")), own) if contextual else own
    kept = points.where(~F.col("point_type").eqNullSafe("hierarchy_summary"))
    return kept.select("doc_id", searched.alias("text"), own.alias("evidence_text")).where("text is not null")


def write_points(points: DataFrame, path: str, by: str = "document_version_id") -> None:
    """Points as Parquet, range-partitioned and sorted by version, so that one version's points lie in few files and row groups."""
    points.repartitionByRange(by).sortWithinPartitions(by).write.mode("append").parquet(path)


def typed_union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """All rows of ``parts``; without parts, an empty table of ``schema``."""
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
