"""Names and dates that questions ask for, found in columns: several fields and names a question, time zones by row.

Dates are found one way of writing after another; what one way has found is blanked out with as many characters, so that the next does
not see it and places stay those of the question.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import text as T

from .understanding import KINDS, NO_NAMES

# The wordings that tell dates of documents, as whole patterns.
UPLOADED = r"\b(uploaded|upload date|ingested|ingestion date|added|imported|indexed)\b"
PUBLISHED = r"\b(published|publication date|released|release date|issued|issue date)\b"
_THINGS = r"(?:data|documents?|sources?|files?|records?|evidence|information|chunks?)"
ANY_DATE = (
    rf"(?:\b{_THINGS}\b.{{0,48}}\b(?:from|in|during|between|before|after|since|until|through|dated)\b)"
    rf"|(?:\b(?:from|during|between|before|after|since|until|through)\b.{{0,48}}\b{_THINGS}\b)"
)
ONLY_USE = r"\b(?:only|exclusively)\b.{0,32}\b(?:use|using|consider|search|retrieve|based)\b|\b(?:use|using|consider|search|retrieve|based)\b.{0,32}\b(?:only|exclusively)\b"
RANGE = r"between|\bfrom\b.+\b(?:to|through|until)\b"
BEFORE, AFTER, SINCE, UNTIL = r"\b(before|earlier than|prior to)\b", r"\b(after|later than)\b", r"\bsince\b", r"\b(until|through)\b"
ONWARDS = r"\b(?:starting\s+from|from)\b.+\b(?:onward|onwards|forward|to\s+(?:the\s+)?present|until\s+now)\b"
COUNTED = r"\b(?:last|past|previous)\s+(\d+)\s+(day|days|week|weeks|month|months|year|years)\b"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

_MONTH = "(" + "|".join(MONTHS) + "|" + "|".join(m[:3] for m in MONTHS) + ")"
#: Ways to write a date in the order in which they take their place, and the groups that hold year, month and day.
WAYS = (
    (r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", 1, 2, 3),
    (r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b", 3, 2, 1),
    (rf"\b{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,)?\s+(\d{{4}})\b", 3, 1, 2),
    (rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{_MONTH}\s+(\d{{4}})\b", 3, 2, 1),
    (rf"\b{_MONTH}\s+(\d{{4}})\b", 2, 1, None),
    (r"\b((?:19|20)\d{2})\b", 1, None, None),
    (rf"\b{_MONTH}\b", None, 1, None),
)

# The wordings that name a document, as whole patterns.
_KIND = "(?:" + "|".join(KINDS) + ")"
_CUE = r"\b(?:use|using|consult|search|retrieve|consider|within|from|in|according\s+to|based\s+on)\b\s+(?:only\s+|exclusively\s+)?(?:the\s+)?"
_NAME = r"([A-Za-z0-9][A-Za-z0-9_.() /-]{0,100}?)"
NAMES = (
    (rf"(?iU){_CUE}(?:{_KIND}\s+)?(?:named\s+|called\s+|titled\s+)?[\"“`](.+?)[\"”`]", True),
    (r"(?iU)(?<![\w.-])([A-Za-z0-9][\w.-]*\.(?:pdf|md|markdown|txt|docx?|rtf|odt))(?![\w.-])", True),
    (rf"(?iU){_CUE}{_KIND}\s+(?:named\s+|called\s+|titled\s+)?{_NAME}(?=\s+(?:to|for|about|when|where|what|how|why|which|that)\b|[?!,;]|\.$|$)", False),
    (rf"(?iU){_CUE}(?!{_KIND}\b){_NAME}\s+{_KIND}\b", False),
    (r"(?iU)(?<![\w.-])([A-Za-z][\w.-]*[_-](?:draft|version|ver|v|revision|rev)[_-]?\d+)(?![\w.-])", True),
)
_EDITIONS = r"(?:versions?|revisions?|releases?|editions?)"
SELECTOR = (
    r"(?iU)^(?:the\s+)?(?:"
    rf"(?:oldest|earliest|initial|original|first|latest|newest|current|most\s+recent|previous|prior|preceding|all|every|each)(?:\s+available)?\s+(?:document\s+)?{_EDITIONS}"
    rf"|(?:all\s+)?(?:older|historical|superseded|non[- ]current)\s+(?:document\s+)?{_EDITIONS}"
    r"|(?:version|revision|release|edition)\s*(?:number\s*)?\d+"
    r")\s+of\s+(?:the\s+)?"
)
EDGES = " \"'`.,:;"


def document_names(question: Column) -> Column:
    """Names that a question gives, in order of the ways to give one, without a selector of versions before them and without repeats.

    Quotes name a document only after a word such as "use" or "according to". Wording such as "the relevant document" names none.
    """
    q = T.normalize_text(question)
    found = []
    for pattern, as_it_is in NAMES:
        names = F.transform(F.regexp_extract_all(q, F.lit(pattern), F.lit(1)), lambda n: F.btrim(n, F.lit(EDGES)))
        if not as_it_is:
            names = F.transform(names, lambda n: F.btrim(F.regexp_replace(n, SELECTOR, ""), F.lit(EDGES)))
        told = F.lit(as_it_is)
        found.append(F.transform(names, lambda n: F.struct(n.alias("name"), T.document_name(n).alias("key"), told.alias("told"))))  # noqa: B023
    words = lambda key: F.split(key, " ")
    generic = F.array(*map(F.lit, NO_NAMES))
    kept = F.filter(F.concat(*found), lambda x: (x["key"] != "") & (x["told"] | (F.size(F.array_except(words(x["key"]), generic)) > 0)))
    keys = F.transform(kept, lambda x: x["key"])
    first = F.filter(kept, lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    return F.coalesce(F.transform(first, lambda x: x["name"]), F.array().cast("array<string>"))


def _scan(rows: DataFrame) -> DataFrame:
    """``rows`` (_text in lower case, _now) with ``_spans``: (at, start, end) of each date in it; start is null for a date that there is not."""
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for pair in {m: i, m[:3]: i}.items() for x in pair])
    rows = rows.withColumn("_spans", F.array().cast("array<struct<at:int,start:date,end:date>>"))
    length = lambda values, n: F.aggregate(F.slice(values, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
    group = lambda g, i: F.get(F.col(f"_g{g}"), i)

    def span_of(year: int | None, month: int | None, day: int | None) -> Callable[[Column, Column], Column]:
        def span(_: Column, i: Column) -> Column:
            m = F.lit(1) if month is None else F.coalesce(F.try_element_at(months, group(month, i)), group(month, i).try_cast("int"))
            last = F.year("_now") - (m > F.month("_now")).cast("int")  # a month without a year is the last one that has begun
            y = last if year is None else group(year, i).cast("int")
            start = F.format_string("%04d-%02d-%02d", y, m, F.lit(1) if day is None else group(day, i).cast("int")).try_cast("date")
            end = F.date_add(start, 1) if day else F.add_months(start, 1 if month else 12)
            return F.struct((length("_parts", i + 1) + length("_found", i)).alias("at"), start.alias("start"), end.alias("end"))

        return span

    for pattern, *groups in WAYS:
        columns = {f"_g{g}": F.regexp_extract_all("_text", F.lit(pattern), F.lit(g)) for g in groups if g}
        rows = rows.withColumns({"_found": F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)), "_parts": F.split("_text", pattern, -1)} | columns)
        blank = F.array_join(F.transform("_parts", lambda p, i: F.concat(p, F.coalesce(F.repeat(F.lit("#"), F.length(F.get(F.col("_found"), i))), F.lit("")))), "")
        rows = rows.withColumn("_spans", F.concat("_spans", F.transform("_found", span_of(*groups)))).withColumn("_text", blank).drop("_found", "_parts", *columns)
    return rows.withColumn("_spans", F.array_sort("_spans"))


def question_scopes(questions: DataFrame, now: Column, zone: Column | None = None) -> DataFrame:
    """``(query_id, names, published, uploaded, any_recorded)``: names, and half-open date ranges in UTC, of questions (query_id, question).

    ``now``: a timestamp without a zone, in UTC; ``zone``: the time zone in which a question means its days, UTC by default; both may
    differ by row. Relative wording comes before absolute; a question with a date that there is not has no dates at all. Wording
    of uploads and of publication can both be there; dates of documents without such wording mean either. A year elsewhere is no scope.
    """
    zone = F.lit("UTC") if zone is None else zone
    told = questions.withColumns({"_zone": zone, "_now": F.convert_timezone(F.lit("UTC"), zone, now.cast("timestamp_ntz"))})
    text = F.lower(F.coalesce(T.normalize_text(F.col("question")), F.lit("")))
    told = _scan(told.withColumns({"_text": text, "_q": text}))
    q = F.col("_q")
    has = lambda pattern: q.rlike(pattern)
    local = lambda date: date.cast("timestamp_ntz")
    pair = lambda start, end: F.struct(start.cast("timestamp_ntz").alias("start"), end.cast("timestamp_ntz").alias("end"))
    nothing = F.lit(None)

    today = F.to_date("_now")
    month, year = F.trunc(today, "MM"), F.trunc(today, "YEAR")
    n, unit = F.regexp_extract(q, COUNTED, 1).try_cast("int"), F.regexp_extract(q, COUNTED, 2)
    back = lambda **amount: F.col("_now") - F.make_interval(**amount)
    counted = F.when(unit.startswith("day"), back(days=n)).when(unit.startswith("week"), back(weeks=n)).when(unit.startswith("month"), back(months=n)).otherwise(back(years=n))
    relative = (
        F.when(has(r"\btoday\b"), pair(today, F.date_add(today, 1)))
        .when(has(r"\byesterday\b"), pair(F.date_sub(today, 1), today))
        .when(has(r"\bthis month\b"), pair(month, F.add_months(month, 1)))
        .when(has(r"\b(?:last|previous) month\b"), pair(F.add_months(month, -1), month))
        .when(has(r"\bthis year\b"), pair(year, F.add_months(year, 12)))
        .when(has(r"\b(?:last|previous) year\b"), pair(F.add_months(year, -12), year))
        .when(n.isNotNull(), pair(counted, F.col("_now")))
    )
    start, end = F.get("_spans", F.lit(0))["start"], F.get("_spans", F.lit(0))["end"]
    absolute = (
        F.when((F.size("_spans") == 0) | F.exists("_spans", lambda s: s["start"].isNull()), nothing)
        .when(has(RANGE) & (F.size("_spans") > 1), pair(local(start), local(F.get("_spans", F.lit(1))["end"])))
        .when(has(BEFORE), pair(nothing, local(start)))
        .when(has(AFTER), pair(local(end), nothing))
        .when(has(SINCE) | has(ONWARDS), pair(local(start), nothing))
        .when(has(UNTIL), pair(nothing, local(end)))
        .otherwise(pair(local(start), local(end)))
    )
    told = told.withColumn("_range", F.coalesce(relative, absolute))
    utc = lambda e: F.convert_timezone(F.col("_zone"), F.lit("UTC"), F.col("_range")[e]).cast("timestamp").alias(e)
    bounds = F.when(F.col("_range").isNotNull(), F.struct(utc("start"), utc("end")))
    uploaded, published = has(UPLOADED), has(PUBLISHED)
    return told.select(
        "query_id", document_names(F.col("question")).alias("names"), F.when(published, bounds).alias("published"), F.when(uploaded, bounds).alias("uploaded"),
        F.when(~uploaded & ~published & (has(ANY_DATE) | has(ONLY_USE)), bounds).alias("any_recorded"),
    )
