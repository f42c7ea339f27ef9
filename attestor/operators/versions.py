"""Version, name and date constraints on retrieved evidence."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.functions import text as T

MODES = ("all", "latest", "oldest", "previous", "latest_and_previous", "oldest_and_latest", "all_except_latest", "specific", "none")
#: Modes that a store may apply by itself. The others look at all versions that were retrieved: taking the newest away first would
#: make the second newest of a document look like its newest.
PUSHABLE = ("latest", "oldest", "specific")


@dataclass(frozen=True)
class Constraints:
    """What a question restricts evidence to. Dates are half open, in UTC; ``any_recorded`` takes either date."""

    names: tuple[str, ...] = ()
    mode: str = "none"
    versions: tuple[int, ...] = ()
    published: tuple[datetime | None, datetime | None] | None = None
    uploaded: tuple[datetime | None, datetime | None] | None = None
    any_recorded: tuple[datetime | None, datetime | None] | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown version mode {self.mode!r}")
        if (self.mode == "specific") != bool(self.versions):
            raise ValueError("version numbers belong to the mode 'specific' alone")

    @property
    def active(self) -> bool:
        return bool(self.names or self.mode not in ("none", "all") or self.published or self.uploaded or self.any_recorded)


def within(column: Column, bounds: tuple) -> Column:
    """Half-open range; a missing date is outside."""
    start, end = bounds
    inside = column.isNotNull()
    if start is not None:
        inside = inside & (column >= F.lit(start))
    if end is not None:
        inside = inside & (column < F.lit(end))
    return inside


def date_predicate(c: Constraints) -> Column:
    keep = F.lit(True)
    if c.published:
        keep = keep & within(F.col("published_at"), c.published)
    if c.uploaded:
        keep = keep & within(F.col("uploaded_at"), c.uploaded)
    if c.any_recorded:
        keep = keep & (within(F.col("published_at"), c.any_recorded) | within(F.col("uploaded_at"), c.any_recorded))
    return keep


def name_predicate(names: tuple[str, ...], columns: tuple[str, ...] = ("title", "filename")) -> Column:
    """Whether any of a row's names equals any of the wanted ones, all normalised."""
    if not names:
        return F.lit(True)
    wanted = F.array(*[T.document_name(F.lit(n)) for n in names])
    own = T.known_names([F.col(c) for c in columns if c.endswith("_normalized")], [F.col(c) for c in columns if not c.endswith("_normalized")])
    return F.arrays_overlap(own, wanted)


def pushdown(c: Constraints) -> Column:
    """The part that may be applied before retrieval: dates, names, and a version mode if it needs no other version.

    A relative mode together with dates is left for later, as "latest" then means the latest inside the dates.
    """
    keep = date_predicate(c) & name_predicate(c.names)
    dated = c.published or c.uploaded or c.any_recorded
    if c.mode == "specific":
        keep = keep & F.col("version_number").isin(*c.versions)
    elif c.mode == "latest" and not dated:
        keep = keep & F.col("is_latest")
    elif c.mode == "oldest" and not dated:
        keep = keep & (F.col("version_number") == 1)
    return keep


def select_versions(evidence: DataFrame, mode: str, versions: tuple[int, ...] = (), by: tuple[str, ...] = ("query_id", "document_id")) -> DataFrame:
    """Rows of ``evidence`` (version_number per document) that a mode keeps, from the versions that were retrieved.

    Rows without a version number stay in latest, oldest, previous and latest-and-previous, and go in all-except-latest and
    oldest-and-latest. ``previous`` is the second newest version retrieved, whatever the store filtered.
    """
    version = F.col("version_number")
    if mode in ("none", "all"):
        return evidence
    if mode == "specific":
        return evidence.where(version.isin(*versions))
    own = Window.partitionBy(*by)
    if mode in ("all_except_latest", "oldest_and_latest"):
        told = evidence.withColumn("_low", F.min(version).over(own)).withColumn("_high", F.max(version).over(own))
        keep = version < F.col("_high") if mode == "all_except_latest" else (version == F.col("_low")) | (version == F.col("_high"))
        return told.where(keep).drop("_low", "_high")
    newest = mode != "oldest"
    place = F.dense_rank().over(own.orderBy(version.desc_nulls_last() if newest else version.asc_nulls_last()))
    keep = {"latest": F.col("_place") == 1, "oldest": F.col("_place") == 1, "previous": F.col("_place") == 2, "latest_and_previous": F.col("_place") <= 2}[mode]
    return evidence.withColumn("_place", place).where(keep | version.isNull()).drop("_place")


def rerank_rows(evidence: DataFrame) -> DataFrame:
    """Ranks 1..n per question in the order of the ranks before."""
    return evidence.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def constrain(evidence: DataFrame, c: Constraints) -> DataFrame:
    """Evidence that satisfies every constraint, ranked anew. Dates and names come first, so relative versions are those inside them."""
    inside = evidence.where(date_predicate(c) & name_predicate(c.names))
    return rerank_rows(select_versions(inside, c.mode, c.versions))


def constraint_report(questions: DataFrame, evidence: DataFrame, c: Constraints) -> DataFrame:
    """``(query_id, n_candidates, n_matched, status)``: not_requested, matched or no_match; questions without evidence have no match."""
    kept = constrain(evidence, c).groupBy("query_id").agg(F.count("*").alias("n_matched"))
    counts = questions.select("query_id").join(evidence.groupBy("query_id").agg(F.count("*").alias("n_candidates")), "query_id", "left").join(kept, "query_id", "left").na.fill(0, ["n_candidates", "n_matched"])
    status = F.when(F.lit(not c.active), "not_requested").when(F.col("n_matched") > 0, "matched").otherwise("no_match")
    return counts.withColumn("status", status)


def matching_dates(c: Constraints) -> Column:
    """Names of the dates that satisfy the question's range on any recorded date, published first."""
    if not c.any_recorded:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(within(F.col(d), c.any_recorded), F.lit(d)) for d in ("published_at", "uploaded_at")]))


def describe(c: Constraints) -> str:
    """What a question restricts evidence to, as a line for people."""
    parts = [f"documents named {', '.join(c.names)}"] if c.names else []
    if c.mode not in ("none", "all"):
        parts.append(f"versions {', '.join(map(str, c.versions))}" if c.versions else f"versions: {c.mode.replace('_', ' ')}")
    for name, bounds in (("published", c.published), ("uploaded", c.uploaded), ("published or uploaded", c.any_recorded)):
        if bounds:
            ends = [f"{word} {end:%Y-%m-%d}" for word, end in zip(("from", "before"), bounds, strict=True) if end is not None]
            parts.append(f"{name} {' '.join(ends)}")
    return "; ".join(parts) or "no restriction"


def inherited(need: Constraints | None, question: Constraints) -> Constraints:
    """A need's own constraints part by part, else those of its question."""
    if need is None:
        return question
    own_mode = need.mode != "none"
    return Constraints(
        names=need.names or question.names,
        mode=need.mode if own_mode else question.mode,
        versions=need.versions if own_mode else question.versions,
        published=need.published or question.published,
        uploaded=need.uploaded or question.uploaded,
        any_recorded=need.any_recorded or question.any_recorded,
    )


def window_keys(document_id: Column, names: list[Column], version: Column) -> tuple[Column, Column]:
    """Document and number that versions are compared by: the id, else the first name there is, else one for all unknown ones; a whole number or nothing."""
    key = F.coalesce(document_id.cast("string"), *[F.nullif(F.trim(n), F.lit("")) for n in names], F.lit("unknown-document"))
    return key, F.when(version.cast("string").rlike(r"^\s*\d+\s*$"), F.trim(version.cast("string")).try_cast("int"))


def payload_predicate(**wanted: tuple) -> Column:
    """Rows whose columns have one of the wanted values each; a column without wanted values is not asked."""
    keep = F.lit(True)
    for name, values in wanted.items():
        if values:
            keep = keep & F.col(name).isin(*values)
    return keep
