"""Names and dates of questions: the wordings and what they must give, by row."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from attestor.operators import wording

NOW = "2026-07-18 12:00:00"
D = datetime
UP, PUB, ANY = "uploaded", "published", "any_recorded"
DATES = [
    ("Find documents uploaded in May 2026.", {UP: (D(2026, 5, 1), D(2026, 6, 1))}),
    ("Use policies published on March 15, 2025.", {PUB: (D(2025, 3, 15), D(2025, 3, 16))}),
    ("Show documents uploaded in the last 3 months.", {UP: (D(2026, 4, 18, 12), D(2026, 7, 18, 12))}),
    ("Find the 2025 documents.", {}),
    ("What policies were published in 2024?", {PUB: (D(2024, 1, 1), D(2025, 1, 1))}),
    ("Only use data from May 2026.", {ANY: (D(2026, 5, 1), D(2026, 6, 1))}),
    ("Only use documents from May.", {ANY: (D(2026, 5, 1), D(2026, 6, 1))}),
    ("Only use documents from August.", {ANY: (D(2025, 8, 1), D(2025, 9, 1))}),
    ("Only use May 2026 for the answer.", {ANY: (D(2026, 5, 1), D(2026, 6, 1))}),
    ("Use documents uploaded since May 2026.", {UP: (D(2026, 5, 1), None)}),
    ("What changed in the API since 2020?", {}),
    ("Who won between 2019 and 2021?", {}),
    ("documents released in 2023", {PUB: (D(2023, 1, 1), D(2024, 1, 1))}),
    ("files imported in March 2024", {UP: (D(2024, 3, 1), D(2024, 4, 1))}),
    ("upload date 2024-03-01", {UP: (D(2024, 3, 1), D(2024, 3, 2))}),
    ("uploaded and published in 2023", {UP: (D(2023, 1, 1), D(2024, 1, 1)), PUB: (D(2023, 1, 1), D(2024, 1, 1))}),
    ("published 2024-13-45 and 2023", {}),
    ("published on 31/2/2024", {}),
    ("uploaded between 2024-01-05 and 7/3/2024", {UP: (D(2024, 1, 5), D(2024, 3, 8))}),
    ("issued from 3rd June 2020 to Sep 2021", {PUB: (D(2020, 6, 3), D(2021, 10, 1))}),
    ("added before 2020", {UP: (None, D(2020, 1, 1))}),
    ("added after Feb 29, 2024", {UP: (D(2024, 3, 1), None)}),
    ("ingested from 2021 onwards", {UP: (D(2021, 1, 1), None)}),
    ("indexed until 2021", {UP: (None, D(2022, 1, 1))}),
    ("published yesterday, not in 2020", {PUB: (D(2026, 7, 17), D(2026, 7, 18))}),
    ("uploaded last month", {UP: (D(2026, 6, 1), D(2026, 7, 1))}),
    ("uploaded this year", {UP: (D(2026, 1, 1), D(2027, 1, 1))}),
    ("published previous year", {PUB: (D(2025, 1, 1), D(2026, 1, 1))}),
    ("uploaded in the past 2 weeks", {UP: (D(2026, 7, 4, 12), D(2026, 7, 18, 12))}),
    ("uploaded in the last 1 years", {UP: (D(2025, 7, 18, 12), D(2026, 7, 18, 12))}),
    ("", {}),
    (None, {}),
]
NAMES = [
    ('Only use "Architecture Guide" to answer this.', ["Architecture Guide"]),
    ("According to Realization_Draft5.pdf, what changed?", ["Realization_Draft5.pdf"]),
    ("Use the Architecture Guide document to explain retries.", ["Architecture Guide"]),
    ("Explain how document metadata is validated.", []),
    ("Use only the oldest version of the relevant document that is available to you.", []),
    ("Use only the oldest version of the Architecture Guide document to explain retries.", ["Architecture Guide"]),
    ('What does "zero trust" mean?', []),
    ("use the non-current versions of the Budget report", ["Budget"]),
    ("search version 3 of the Budget report and budget.md", ["budget.md"]),
    ("What changed in plan_v4 and Plan-v4?", ["plan_v4"]),
    ("consult the manual named Blue Ocean Guide for x", ["Blue Ocean Guide"]),
    (None, []),
]


def test_dates(spark):
    rows = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(DATES)], "query_id int, question string")
    for r in wording.question_scopes(rows, F.lit(NOW)).collect():
        got = {f: (r[f].start, r[f].end) for f in (UP, PUB, ANY) if r[f] is not None}
        assert got == DATES[r.query_id][1], DATES[r.query_id][0]


def test_names(spark):
    rows = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(NAMES)], "query_id int, question string")
    for r in rows.select("query_id", wording.document_names(F.col("question")).alias("names")).collect():
        assert r.names == NAMES[r.query_id][1], NAMES[r.query_id][0]


def test_zone_and_now_by_row(spark):
    rows = spark.createDataFrame([(1, "uploaded today", "Asia/Tokyo", "2026-07-18 20:00:00"), (2, "uploaded today", "UTC", "2026-07-18 20:00:00"), (3, "published on 2024-07-01", "America/New_York", NOW)], "query_id int, question string, zone string, now string")
    got = {r.query_id: r for r in wording.question_scopes(rows, F.col("now"), F.col("zone")).collect()}
    assert (got[1].uploaded.start, got[1].uploaded.end) == (D(2026, 7, 18, 15), D(2026, 7, 19, 15))
    assert got[2].uploaded.start == D(2026, 7, 18) and got[3].published.start == D(2024, 7, 1, 4)


def test_empty_table(spark):
    assert wording.question_scopes(spark.createDataFrame([], "query_id int, question string"), F.lit(NOW)).count() == 0
