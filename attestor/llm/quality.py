"""Quality rules whose cutoffs come from labelled holdouts with exact binomial bounds."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Shares of two counts, and what a clean text has of each at most, in thousandths: a share counts in units of that.
SHARES = {
    "symbols": ("n_symbols", "n_words", 100),
    "duplicate_lines": ("n_dup_lines", "n_lines", 300),
    "capitals": ("n_upper", "n_letters", 300),
    "marks": ("n_marks", "n_words", 100),
}
#: A rule is the largest of its shares; a document is rejected when that is above the rule's cutoff, in thousandths. All shares are
#: one rule, so a stratum has one test, which has the whole limit.
RULES = {"worst_share": ("symbols", "duplicate_lines", "capitals", "marks")}
#: Cutoffs tried for a rule, from strict to lax, in thousandths.
GRID = (250, 350, 500, 700, 1000, 1400, 2000, 2800, 4000, 5600, 8000, 11000, 16000)
#: At most this share of good documents may be rejected in a stratum, all rules together ...
MAX_FALSE_REJECTION = 0.02
#: ... with this probability of being wrong about any of them.
DELTA = 0.05
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")
_SYMBOLS, _MARKS = "#*$%&|<>", "!?"
WINDOW = 5


def repeated_words(words: list[str]) -> int:
    """Words that stand in a 5-word window found twice or more in the text, its first place included. Exact."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    if len(number) == len(words):
        return 0
    # windows get equal numbers when they are equal: of two words, of four, of five
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    four = np.unique(pair[:-2] * len(words) + pair[2:], return_inverse=True)[1]
    _, five, seen = np.unique(four[:n] * len(number) + ids[WINDOW - 1 :], return_inverse=True, return_counts=True)
    again = np.flatnonzero(seen[five] > 1)
    if not len(again):
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; words are runs without U+0020 and U+0009 to U+000D. Null counts as empty."""
    if not text:
        return (0,) * len(COUNTS)
    # str.split() would also cut at other blanks of Unicode
    words = [w.decode() for w in text.encode().split()] if not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    letters = text if text.isascii() else "".join(words)
    upper, lower = _case(letters)
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        upper + lower,
        sum(map(text.count, _MARKS)),
    )


def _case(text: str) -> tuple[int, int]:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    wide = codes[codes > 127]
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    lower = int(((codes >= 97) & (codes <= 122)).sum())
    for code, count in zip(*np.unique(wide, return_counts=True), strict=True):
        upper += int(count) * chr(code).isupper()
        lower += int(count) * chr(code).islower()
    return upper, lower


def count_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, the stratum (``lang``) and COUNTS of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = pd.DataFrame([text_counts(t) for t in batch["text"]], columns=list(COUNTS), dtype="int64")
            yield pd.concat([batch[["doc_id", "lang"]].reset_index(drop=True), counts], axis=1)

    schema = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInPandas(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def upper_bound(failures: int, trials: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a binomial probability: no larger one makes so few failures likelier than ``delta``."""
    if failures >= trials:
        return 1.0
    k = np.arange(failures + 1)
    log_choose = math.lgamma(trials + 1) - np.array([math.lgamma(i + 1) + math.lgamma(trials - i + 1) for i in k])
    low, high = failures / trials, 1.0
    for _ in range(60):
        p = (low + high) / 2
        terms = log_choose + k * math.log(p) + (trials - k) * math.log1p(-p)
        top = terms.max()
        if top + math.log(np.exp(terms - top).sum()) > math.log(delta):
            low = p
        else:
            high = p
    return high


def testable(trials: dict[str | None, int], limit: float, delta: float, rules: int) -> list[str | None]:
    """The strata with enough good documents for a cutoff that rejects none of them, when they share ``delta``.

    Only sizes are looked at, never outcomes, so leaving the others out takes nothing from the guarantee.
    """
    order = sorted(trials, key=lambda s: (-trials[s], str(s)))
    while order and upper_bound(0, trials[order[-1]], delta / (len(order) * rules)) > limit / rules:
        order.pop()
    return order


def select_cutoffs(good: dict[tuple[str | None, str], list[int]], trials: dict[str | None, int], limit: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> dict[tuple[str | None, str], int]:
    """The strictest cutoff of each stratum and rule whose false rejections are surely limited; none if no cutoff is.

    ``good[stratum, rule][i]``: good holdout documents above GRID[i]; ``trials[stratum]``: good holdout documents. The limit is
    shared by the rules, and ``delta`` by rules and testable strata (Bonferroni). The cutoffs of one rule are tested from the laxest
    to the strictest and testing stops at the first that fails, so the grid needs no correction (fixed sequence).
    """
    strata = testable(trials, limit, delta, len(RULES))
    tests = max(1, len(strata) * len(RULES))
    out = {}
    for (stratum, rule), above in good.items():
        for i in range(len(GRID) - 1, -1, -1):
            if stratum not in strata or upper_bound(above[i], trials[stratum], delta / tests) > limit / len(RULES):
                break
            out[stratum, rule] = GRID[i]
    return out


def share_above(rule: str, cutoff: Column | int) -> Column:
    """Whether one of a document's shares is above a cutoff in thousandths of its unit; shares of 0 are above none."""
    above = F.lit(False)
    for name in RULES[rule]:
        top, bottom, unit = SHARES[name]
        above = above | (F.col(top) * 1_000_000 > F.col(bottom) * (cutoff * unit))
    return above


def learn_cutoffs(counts: DataFrame, labels: DataFrame, limit: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> dict[tuple[str | None, str], int]:
    """Cutoffs by stratum and rule from all good labelled documents that pass the base rules.

    One aggregate per stratum runs on Spark; the driver gets counts, strata times rules times grid. A document with several
    labels counts as good if all say so, and rows with one doc_id are one trial: the one with the least counts. Strata with too
    few good documents get no cutoff, so nothing in them is rejected.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = counts.where(~base_failed()).join(good, "doc_id", "left_semi")
    once = held.groupBy("doc_id").agg(F.min(F.struct(*COUNTS, "lang")).alias("c")).select("c.*")
    rows = once.groupBy("lang").agg(F.count("*").alias("trials"), *[F.count(F.when(share_above(r, c), 1)).alias(f"{r}_{c}") for r in RULES for c in GRID]).collect()
    trials = {row["lang"]: row["trials"] for row in rows}
    above = {(row["lang"], r): [row[f"{r}_{c}"] for c in GRID] for row in rows for r in RULES}
    return select_cutoffs(above, trials, limit, delta)


def verdict(cutoffs: dict[tuple[str | None, str], int]) -> Column:
    """Whether no rule of the document's stratum rejects it."""
    rejected = F.lit(False)
    for (stratum, rule), cutoff in sorted(cutoffs.items(), key=str):
        rejected = rejected | (F.col("lang").eqNullSafe(F.lit(stratum)) & share_above(rule, cutoff))
    return ~rejected


def rate_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, COUNTS, ``base_failed`` and ``kept`` per row of ``docs`` (doc_id, lang, text).

    Rejected: fewer than 10 words, more than 20 % of words in repeated windows, or a share above the stratum's cutoff. Null
    texts count as empty and fail; a null language is a stratum; without labels only the base rules hold. Repeated rows are
    rated alike; an empty table gives no rows; extra columns are ignored.
    """
    counts = materialise(count_documents(docs), "quality-counts", keep=True)
    cutoffs = learn_cutoffs(counts, labels)
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(cutoffs))
