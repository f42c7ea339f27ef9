"""Text functions, Column in and Column out, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every blank of Unicode, U+001C to U+001F and U+0085 included.
BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: Letters, digits and the underscore, of all scripts.
WORD = r"[\p{L}\p{N}_]+"

# Words that carry no content when a question is compared with a passage.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or",
    "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why", "with",
)
# Words of document names that do not tell documents apart.
GENERIC_NAME_WORDS = (
    "document", "documents", "file", "files", "pdf", "project", "plan", "spec", "specification", "functional", "realization",
    "realisation", "draft", "report", "version", "final", "the", "a", "an", "for", "of", "and",
)
# Suffixes that are no part of a document's name.
NAME_SUFFIX = r"(?i)\.(?:pdf|md|markdown|txt|doc|docx|rtf|odt|html?|csv|json|ya?ml)$"
# Quotes that may enclose a name.
QUOTED = "(?s)^(?:\"(.*)\"|'(.*)'|`(.*)`|\u201c(.*)\u201d|\u2018(.*)\u2019)$"
# Words that introduce a version number at the end of a name.
VERSION_SUFFIX = r"(?:(?: (?:draft|version|ver|revision|rev|release|edition|copy) ?\d+(?: \d+)*| v\d+(?: \d+)*))+$"


def folded(text: Column) -> Column:
    """Lower case with the one folding that matters besides: sharp s is ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize_text(text: Column) -> Column:
    """Runs of blanks are one space; none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def token_count(text: Column) -> Column:
    """Estimate of model tokens: 1.3 per word rounded down, 1 at least, 0 for blank text."""
    clean = normalize_text(text)
    return F.when(clean == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.size(F.split(clean, " ")) * F.lit(1.3)).cast("int")))


def first_heading(text: Column) -> Column:
    """The first markdown heading's title, 512 characters at most; null without one."""
    title = F.trim(F.regexp_extract(text, r"(?m)^#{1,6}[ \t]+(.+)$", 1))
    return F.when(title == "", F.lit(None)).otherwise(F.substring(title, 1, 512))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def words(text: Column) -> Column:
    """Folded words in order, repeats included."""
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def counted(values: Column) -> Column:
    """``array<struct<value, n>>``: distinct values of an array in order, and how often it has each; a null array counts as empty.

    Runs of the sorted array are counted inside the row, so nothing is shuffled. Arrays of one element bind what several steps read.
    """

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (n > 0) & ((i == 0) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1))))
        return F.flatten(F.transform(F.array(starts), lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("value"), (F.coalesce(F.get(at, j + 1), n) - p).cast("long").alias("n")))))

    return F.flatten(F.transform(F.array(F.sort_array(values)), lambda s: F.when(s.isNotNull(), runs(s)).otherwise(runs(F.slice(s, 1, 0)))))


def safe_filename(name: Column) -> Column:
    """What an object store takes: letters, digits, dot, underscore, hyphen; 180 characters at most; ``upload`` for nothing."""
    safe = F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), 1, 180)
    return F.when(F.coalesce(safe, F.lit("")) == "", F.lit("upload")).otherwise(safe)


def unquoted(name: Column) -> Column:
    """A name with single blanks and without the one pair of quotes that encloses it."""
    clean = normalize_text(name)
    inside = F.concat(*[F.regexp_extract(clean, QUOTED, i) for i in range(1, 6)])
    return F.when(clean.rlike(QUOTED), F.trim(inside)).otherwise(clean)


def document_name(name: Column) -> Column:
    """Title or file name for exact comparison: no quotes around it, last path part, no known suffix, folded, single spaces."""
    clean = unquoted(name)
    last = F.regexp_extract(F.regexp_replace(clean, r"[\\/]+$", ""), r"([^\\/]*)$", 1)
    return F.trim(F.regexp_replace(folded(F.regexp_replace(last, NAME_SUFFIX, "")), r"[^\p{L}\p{N}]+", " "))


def known_names(normalized: list[Column], raw: list[Column]) -> Column:
    """Distinct names that a row goes by: columns that hold names for comparison already, and titles or file names as they were given."""
    told = [F.lower(normalize_text(c)) for c in normalized] + [document_name(c) for c in raw]
    return F.array_distinct(F.array_compact(F.array(*[F.nullif(c, F.lit("")) for c in told])))


def document_identity(name: Column) -> Column:
    """Stem of a title or file name: the last suffix goes (also a title's, such as ``.1``), separators are single spaces."""
    last = F.regexp_extract(F.trim(name), r"([^/]*)$", 1)
    stem = F.when(last.rlike(r"^[^.].*\.[^.]+$|^\.+[^.]+\.[^.]+$"), F.regexp_replace(last, r"\.[^.]*$", "")).otherwise(last)
    return F.trim(F.regexp_replace(folded(stem), r"[\s._-]+", " "))


def family_key(name: Column) -> Column:
    """Identity without the version markers at its end, so drafts of one document share it."""
    return F.trim(F.regexp_replace(document_identity(name), VERSION_SUFFIX, ""))


def same_family(a: Column, b: Column) -> Column:
    return (family_key(a) == family_key(b)) & (F.length(family_key(a)) >= 4)


def content_terms(text: Column) -> Column:
    """Distinct lower-case ASCII terms of two characters or more that are no stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9_-]*"), F.lit(0)))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def lexical_coverage(query: Column, text: Column) -> Column:
    """Share of the query's content terms that the text has; 0 if either has none."""
    return coverage_of_terms(content_terms(query), content_terms(text))


def coverage_of_terms(query_terms: Column, text_terms: Column) -> Column:
    return F.when(F.size(query_terms) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query_terms, text_terms)) / F.size(query_terms))


def informative_tokens(name: Column) -> Column:
    """Distinct words that tell documents apart; camel case counts as several words."""
    parts = F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")), F.lit(r"[a-z0-9]+"), F.lit(0)))
    return F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(*GENERIC_NAME_WORDS))


def name_overlap(name_tokens: Column, query_tokens: Column) -> Column:
    shared = F.size(F.array_intersect(name_tokens, query_tokens))
    return F.when(shared == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.lit(0.6) + F.lit(0.2) * shared))


def cited_ranks(answer: Column, allowed: Column) -> Column:
    """Distinct ranks inside ``[1]`` or ``[1, 2]`` in order of mention, if allowed."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    ranks = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda r: r.try_cast("int"))
    return F.filter(F.array_distinct(ranks), lambda r: F.array_contains(allowed, r))
