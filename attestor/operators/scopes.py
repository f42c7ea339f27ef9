"""Constraints by question: a table of scopes that candidates are joined to, evaluated by row.

A scope has ``names`` (documents, as they compare), ``mode`` and ``versions`` (of a document), and half-open ranges ``published``,
``uploaded`` and ``any_recorded`` (either date). What a field leaves null or empty is not asked.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.functions import text as T
from attestor.sources.scratch import small

from . import understanding, versions, wording

RANGES = ("published", "uploaded", "any_recorded")
FIELDS = ("names", "mode", "versions", *RANGES)
_RANGE = "struct<start:timestamp,end:timestamp>"
SCHEMA = f"names array<string>, mode string, versions array<int>, {', '.join(f'{r} {_RANGE}' for r in RANGES)}"
#: Bytes of a scope in a hash table, about.
SCOPE_BYTES = 600


def scope_table(spark: SparkSession, scopes: Iterable[tuple[tuple, versions.Constraints]], keys: str) -> DataFrame:
    """Scopes from objects: ``keys`` is the schema of the key columns, such as ``query_id long``."""
    rows = [(*key, list(c.names), c.mode, list(c.versions), c.published, c.uploaded, c.any_recorded) for key, c in scopes]
    return spark.createDataFrame(rows, ", ".join(x for x in (keys, SCHEMA) if x))


def detected(questions: DataFrame, now: datetime, zone: Column | None = None) -> DataFrame:
    """``(query_id, scope fields)`` that the wording of questions (query_id, question) asks for: names, versions and dates.

    ``now`` is taken as UTC if it has no zone; ``zone``: the time zone of a question's days.
    """
    mode, numbers, _ = understanding.version_intent(F.col("question"))
    utc = now.astimezone(timezone.utc).replace(tzinfo=None) if now.tzinfo else now
    told = questions.select("query_id", mode.alias("mode"), F.when(mode == "specific", numbers).alias("versions"))
    return told.join(wording.question_scopes(questions, F.lit(utc.isoformat(" ")), zone), "query_id").select("query_id", *FIELDS)


def _asked(field: str, c: Callable[[str], Column]) -> Column:
    if field == "mode":
        return F.coalesce(~c("mode").isin("none", "all"), F.lit(False))
    return F.coalesce(F.size(c(field)) > 0, F.lit(False)) if field in ("names", "versions") else c(field).isNotNull()


def active() -> Column:
    """Whether a row's scope asks for anything."""
    return _asked("names", F.col) | _asked("mode", F.col) | F.col("published").isNotNull() | F.col("uploaded").isNotNull() | F.col("any_recorded").isNotNull()


def inherited(own: DataFrame, parent: DataFrame, by: str = "query_id") -> DataFrame:
    """Scopes of needs (``by``, other keys, scope fields) with what they leave open taken from their question's scope.

    Names, versions (mode and numbers together) and dates are inherited each as a whole: a need with any date keeps only its own.
    A need whose question has no scope keeps its own.
    """
    p = parent.select(by, *[F.col(f).alias(f"_{f}") for f in FIELDS])
    both = own.join(p, by, "left")
    mine, theirs = F.col, lambda f: F.coalesce(f"_{f}", f)
    has_mode = F.coalesce(mine("mode") != "none", F.lit(False))
    dated = F.coalesce(*[F.when(mine(r).isNotNull(), True) for r in RANGES], F.lit(False))
    taken = {"names": F.when(_asked("names", mine), mine("names")).otherwise(theirs("names"))}
    taken |= {f: F.when(has_mode, mine(f)).otherwise(theirs(f)) for f in ("mode", "versions")}
    taken |= {r: F.when(dated, mine(r)).otherwise(theirs(r)) for r in RANGES}
    return both.withColumns({f"_{f}": c for f, c in taken.items()}).select(*[c for c in own.columns if c not in FIELDS], *[F.col(f"_{f}").alias(f) for f in FIELDS])


def complete(scopes: DataFrame, questions: DataFrame, by: str = "query_id") -> DataFrame:
    """A scope for every question; names as they compare; one without a scope asks for nothing. Unknown modes are an error."""
    told = questions.select(by).join(scopes.select(by, *FIELDS), by, "left")
    mode = F.coalesce("mode", F.lit("none"))
    known = F.when(mode.isin(*versions.MODES), mode).otherwise(F.raise_error(F.concat(F.lit("unknown version mode "), mode)))
    names = F.array_distinct(F.filter(F.transform(F.coalesce("names", F.array().cast("array<string>")), T.document_name), lambda n: n != ""))
    return told.withColumns({"mode": known, "names": names})


def in_range(date: Column, bounds: Column) -> Column:
    """Whether a date lies in a half-open range with open ends; a missing date is outside, a missing range holds all."""
    start, end = bounds.getField("start"), bounds.getField("end")
    return F.when(bounds.isNull(), True).otherwise(date.isNotNull() & F.coalesce(date >= start, F.lit(True)) & F.coalesce(date < end, F.lit(True)))


def dates_match() -> Column:
    any_ = F.col("any_recorded")
    either = F.when(any_.isNull(), True).otherwise(in_range(F.col("published_at"), any_) | in_range(F.col("uploaded_at"), any_))
    return in_range(F.col("published_at"), F.col("published")) & in_range(F.col("uploaded_at"), F.col("uploaded")) & either


def names_match(own: Column) -> Column:
    """Whether one of a row's names is wanted; no wanted names hold all."""
    return F.when(F.size("names") == 0, True).otherwise(F.coalesce(F.arrays_overlap(own, F.col("names")), F.lit(False)))


def dated() -> Column:
    return F.col("published").isNotNull() | F.col("uploaded").isNotNull() | F.col("any_recorded").isNotNull()


def facts(documents: DataFrame) -> DataFrame:
    """``(doc_id, version_number, is_latest, published_at, uploaded_at, stored, known)``: what scopes look at.

    ``known``: all names of a document. ``stored``: those that lie ready for comparison in the columns ``title_normalized`` and
    ``filename_normalized``, which a store can filter by; without such columns, all names.
    """
    ready = [F.col(c) for c in ("title_normalized", "filename_normalized") if c in documents.columns]
    raw = [F.col(c) for c in ("title", "filename") if c in documents.columns]
    known = T.known_names(ready, raw)
    stored = T.known_names(ready, []) if ready else known
    of = lambda c, kind: (F.col(c) if c in documents.columns else F.lit(None)).cast(kind).alias(c)
    return documents.select("doc_id", of("version_number", "int"), of("is_latest", "boolean"), of("published_at", "timestamp"), of("uploaded_at", "timestamp"), stored.alias("stored"), known.alias("known"))


def admitted() -> Column:
    """What a store may leave out before retrieval: by dates, stored names, and modes that look at no other version.

    Latest and oldest together with dates are left for later, as they then mean those inside the dates.
    """
    number = F.col("version_number")
    mode = (
        F.when(F.col("mode") == "specific", F.array_contains("versions", number))
        .when((F.col("mode") == "latest") & ~dated(), F.col("is_latest"))
        .when((F.col("mode") == "oldest") & ~dated(), number == 1)
        .otherwise(True)
    )
    return dates_match() & names_match(F.col("stored")) & F.coalesce(mode, F.lit(False))


@dataclass(frozen=True)
class Scopes:
    """Scopes of questions, with the facts of all documents, as what retrieval may look at."""

    table: DataFrame
    facts: DataFrame

    def inside(self, rows: DataFrame) -> DataFrame:
        """Rows (query_id, doc_id, ...) that their question's scope admits."""
        told = rows.join(small(self.table, SCOPE_BYTES), "query_id").join(self.facts, "doc_id")
        return told.where(admitted()).select(*rows.columns)

    def renamed(self, ids: DataFrame) -> "Scopes":
        """The same for questions under other ids: ``ids`` (query_id, new_id)."""
        return Scopes(self.table.join(ids, "query_id").drop("query_id").withColumnRenamed("new_id", "query_id"), self.facts)

    def points(self, points: DataFrame) -> DataFrame:
        f = self.facts.select("doc_id", "version_number", "is_latest", *[F.col(c).cast("double").alias(c) for c in ("published_at", "uploaded_at")], "stored")
        return points.join(f, "doc_id")

    def questions(self, questions: DataFrame) -> DataFrame:
        ends = [F.col(r).getField(e).cast("double").alias(f"{r}_{e}") for r in RANGES for e in ("start", "end")]
        return questions.join(self.table.select("query_id", "names", "mode", "versions", *[F.col(r).isNotNull().alias(r) for r in RANGES], *ends), "query_id")


def admitted_rows(p: pd.DataFrame, q: dict) -> np.ndarray:
    """``admitted`` of a tile of points for one question, both as ``Scopes.points`` and ``Scopes.questions`` give them."""

    def within(column: str, field: str) -> np.ndarray:
        date, start, end = p[column].to_numpy(float), q[f"{field}_start"], q[f"{field}_end"]
        low, high = (-np.inf if start is None or np.isnan(start) else start), (np.inf if end is None or np.isnan(end) else end)
        return (date >= low) & (date < high)

    keep = np.ones(len(p), bool)
    if q["published"]:
        keep &= within("published_at", "published")
    if q["uploaded"]:
        keep &= within("uploaded_at", "uploaded")
    if q["any_recorded"]:
        keep &= within("published_at", "any_recorded") | within("uploaded_at", "any_recorded")
    if len(q["names"]):
        wanted = set(q["names"])
        keep &= np.fromiter((not wanted.isdisjoint(names) for names in p["stored"]), bool, len(p))
    undated = not (q["published"] or q["uploaded"] or q["any_recorded"])
    if q["mode"] == "specific":
        keep &= np.isin(p["version_number"].to_numpy(float), np.asarray(q["versions"], float))
    elif q["mode"] == "latest" and undated:
        keep &= p["is_latest"].fillna(False).to_numpy(bool)
    elif q["mode"] == "oldest" and undated:
        keep &= p["version_number"].to_numpy(float) == 1
    return keep


def select_versions(evidence: DataFrame, by: tuple[str, ...] = ("query_id", "document_id")) -> DataFrame:
    """Rows of ``evidence`` (version_number, and the row's mode and versions) that each row's own mode keeps.

    The same rules as ``versions.select_versions`` has for one mode: two orders of a document's versions and their ends tell all modes.
    """
    v, own = F.col("version_number"), Window.partitionBy(*by)
    told = evidence.withColumns({
        "_low": F.min(v).over(own), "_high": F.max(v).over(own),
        "_newest": F.dense_rank().over(own.orderBy(v.desc_nulls_last())), "_oldest": F.dense_rank().over(own.orderBy(v.asc_nulls_last())),
    })
    newest, oldest = F.col("_newest"), F.col("_oldest")
    keep = {
        "specific": F.array_contains("versions", v),
        "latest": v.isNull() | (newest == 1),
        "oldest": v.isNull() | (oldest == 1),
        "previous": v.isNull() | (newest == 2),
        "latest_and_previous": v.isNull() | (newest <= 2),
        "all_except_latest": v < F.col("_high"),
        "oldest_and_latest": (v == F.col("_low")) | (v == F.col("_high")),
    }
    rule = F.lit(True)
    for mode, condition in keep.items():
        rule = F.when(F.col("mode") == mode, F.coalesce(condition, F.lit(False))).otherwise(rule)
    return told.where(rule).drop("_low", "_high", "_newest", "_oldest")


def constrain(evidence: DataFrame, scopes: DataFrame, facts_: DataFrame) -> DataFrame:
    """Evidence (query_id, doc_id, document_id, version_number, rank, ...) inside its question's scope, ranked anew.

    Dates and names come first, so that relative versions are those inside them. Questions without a scope lose their rows: give
    them a scope that asks for nothing (``complete``).
    """
    columns = evidence.columns
    f = facts_.select("doc_id", *[c for c in ("published_at", "uploaded_at", "known") if c not in columns])
    told = evidence.join(small(scopes, SCOPE_BYTES), "query_id").join(f, "doc_id").where(dates_match() & names_match(F.col("known")))
    return versions.rerank_rows(select_versions(told).select(*columns))


def valid() -> Column:
    """Whether a piece of evidence keeps its scope's promise, by itself: relative modes trust the flag that it is the latest.

    With dates, relative modes were settled among what was retrieved, and only the number must be known.
    """
    number, latest, relative = F.col("version_number"), F.col("is_latest"), dated()
    numbered = number.isNotNull()
    mode = (
        F.when(F.col("mode") == "all", numbered)
        .when(F.col("mode") == "specific", F.array_contains("versions", number))
        .when(F.col("mode") == "latest", relative | F.coalesce(latest, F.lit(True)))
        .when(F.col("mode") == "previous", relative | F.coalesce(~latest, F.lit(True)))
        .when(F.col("mode") == "oldest", F.when(relative, numbered).otherwise(number == 1))
        .when(F.col("mode") == "all_except_latest", F.when(relative, numbered).otherwise(F.coalesce(~latest, numbered)))
        .when(F.col("mode") == "oldest_and_latest", F.when(relative, numbered).otherwise((number == 1) | F.coalesce(latest, F.lit(False))))
        .otherwise(True)
    )
    return dates_match() & names_match(F.col("known")) & F.coalesce(mode, F.lit(False))


def validated(evidence: DataFrame, scopes: DataFrame, facts_: DataFrame, by: tuple[str, ...] = ("query_id",)) -> tuple[DataFrame, DataFrame]:
    """``(evidence, report)``: rows that are inside their scope, and ``(by, n_candidates, n_matched, n_rejected, status)``.

    Status: not_requested for a scope that asks for nothing, whose rows all stay; matched, or no_match. Every row of ``scopes`` is
    in the report, with or without evidence.
    """
    own = F.when(active(), valid()).otherwise(True)
    told = evidence.join(small(scopes, SCOPE_BYTES), list(by)).join(facts_.select("doc_id", *[c for c in facts_.columns if c not in evidence.columns]), "doc_id").withColumn("_valid", own)
    counts = told.groupBy(*by).agg(F.count("*").alias("n_candidates"), F.count_if("_valid").alias("n_matched"))
    report = scopes.select(*by, active().alias("_active")).join(counts, list(by), "left").na.fill(0, ["n_candidates", "n_matched"])
    status = F.when(~F.col("_active"), "not_requested").when(F.col("n_matched") > 0, "matched").otherwise("no_match")
    return told.where("_valid").select(*evidence.columns), report.select(*by, "n_candidates", "n_matched", (F.col("n_candidates") - F.col("n_matched")).alias("n_rejected"), status.alias("status"))
