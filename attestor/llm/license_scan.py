"""Licence scan: canonical texts, hash-joined to the digests of known licences. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_registry import KNOWN, SPELLINGS

#: A line that names a copyright holder, or reserves rights. ``(?m)`` so that ``^`` starts a line. A line of a wrapped licence
#: that goes on after "copyright", as in "copyright notice", names nobody.
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b(?![^\p{L}\p{N}©\n]*(?:(?:notices?|holders?|owners?|laws?|licen[cs]es?|statements?|and|or|in)\b|$))"
    r"|\(c\)|©|all rights reserved)[^\n]*"
)
#: The same in the SQL, which has no look-ahead: it also takes out lines that go on after "copyright".
SQL_COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """Lower case, without copyright lines, punctuation as one blank, one blank around each line, equivalent spellings alike.

    A blank is put on both sides of each line feed, so a spelling is replaced between blanks, and again where two share one.
    """
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    t = F.regexp_replace(t, NOT_WORD, " ")
    t = F.concat(F.lit(" "), F.replace(t, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    t = F.replace(t, F.lit("  "), F.lit(" "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(f" {old} "), F.lit(f" {new} "))
    return t


def canonical_text(lines: Column) -> Column:
    """The lines as one text: line feeds are blanks, blanks at the ends go."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_digests(spark) -> DataFrame:
    """``(digest, license_id, canonical_chars)`` of the registry; a fixed few rows, so it may be broadcast."""
    known = spark.createDataFrame(list(KNOWN), "license_id string, known string")
    text = canonical_text(canonical_lines(F.col("known")))
    return known.select(F.sha2(text, 256).alias("digest"), "license_id", F.length(text).alias("canonical_chars")).dropDuplicates(["digest"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per doc_id: ``text_digest`` of the canonical whole text, ``text_license`` it equals (null: none), ``n_license_lines`` lines
    that equal a known text, and ``line_licenses``, their distinct ids in order joined by commas ("" if none).

    The whole text and each line are units; a unit whose canonical length no known text has cannot match and is not hashed.
    Units meet the registry in one broadcast hash join, then go back to their document after a combine in each task, so a hot
    document or notice costs its task one row. Null texts count as empty; rows with the same doc_id count as one document, with
    the smallest digest as its own. Null ids form a group. An empty table gives no rows; extra columns are ignored.
    """
    known = F.broadcast(known_digests(docs.sparkSession))
    lengths = sorted({r[0] for r in known.select("canonical_chars").collect()})
    lines = docs.select("doc_id", canonical_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    one_line = F.transform(F.split("lines", "\n"), lambda x: F.trim(x))
    fitting = F.filter(one_line, lambda x: F.length(x).isin(lengths))
    units = lines.select("doc_id", F.sha2(canonical_text(F.col("lines")), 256).alias("whole"), fitting.alias("fitting")).select(
        "doc_id",
        F.explode(F.concat(F.array(F.struct(F.lit(True).alias("is_text"), F.col("whole").alias("digest"))), F.transform("fitting", lambda x: F.struct(F.lit(False).alias("is_text"), F.sha2(x, 256).alias("digest"))))).alias("unit"),
    )
    found = units.select("doc_id", "unit.is_text", "unit.digest").join(known, "digest", "left").where("is_text or license_id is not null")
    per = found.groupBy("doc_id").agg(
        F.min(F.when(F.col("is_text"), F.col("digest"))).alias("text_digest"),
        F.min(F.when(F.col("is_text"), F.col("license_id"))).alias("text_license"),
        F.count(F.when(~F.col("is_text"), 1)).alias("n_license_lines"),
        F.collect_set(F.when(~F.col("is_text"), F.col("license_id"))).alias("ids"),
    )
    return per.select("doc_id", "text_digest", "text_license", "n_license_lines", F.concat_ws(",", F.array_sort("ids")).alias("line_licenses"))


def _sql_canonical(text: str) -> str:
    t = f"regexp_replace(lower({text}), '{SQL_COPYRIGHT_LINE}', '', 'g')"
    t = f"regexp_replace({t}, '{NOT_WORD}', ' ', 'g')"
    t = f"replace(' ' || replace({t}, chr(10), ' ' || chr(10) || ' ') || ' ', '  ', ' ')"
    for old, new in SPELLINGS:
        t = f"replace({t}, ' {old} ', ' {new} ')"
    return t


def oracle_sql() -> str:
    """The same result of ``documents`` in DuckDB's SQL, but for lines that SQL_COPYRIGHT_LINE alone takes out."""
    whole = "trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'))"
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    return f"""
    with known as (select sha256({whole}) as digest, min(license_id) as license_id
                   from (select license_id, {_sql_canonical("known")} as lines from (values {values}) k(license_id, known)) group by 1),
    docs as (select doc_id, {_sql_canonical("coalesce(text, '')")} as lines from documents),
    units as (select doc_id, true as is_text, sha256({whole}) as digest from docs
              union all select doc_id, false, sha256(trim(line)) from (select doc_id, unnest(string_split(lines, chr(10))) as line from docs)),
    found as (select doc_id, is_text, u.digest, license_id from units u left join known k on u.digest = k.digest where is_text or license_id is not null)
    select doc_id, min(digest) filter (is_text) as text_digest, min(license_id) filter (is_text) as text_license,
           count(*) filter (not is_text) as n_license_lines,
           coalesce(string_agg(distinct license_id, ',' order by license_id) filter (not is_text), '') as line_licenses
    from found group by doc_id"""
