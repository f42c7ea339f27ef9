"""Nested records against plain Python."""

import itertools
import json

from pyspark.sql import functions as F

from attestor.operators import records

CASES = [
    {}, {"a": 1}, {"a": 1.0}, {"a": True}, {"a": "1"}, {"a": None}, {"a": {}}, {"a": []}, {"a": {"b": 1}}, {"a": {"b": 1, "c": [1, 2]}}, {"a": {"c": [2, 1]}},
    {"a": {"c": [1.0, 2]}}, {"a": [{"x": 1}]}, {"a": [{"x": 1, "y": 2}]}, {"a": [{}]}, {"a.b": 1}, {"a": 12345678901234567890}, {"a": 12345678901234567891}, {"a": 1e300}, {"a": 1e-30}, {"a": 0},
    {"a": {"b": 1, "c": [1, 2], "d": {"e": "f"}}, "g": "h"},
]


def subset(want, have):
    for key, value in want.items():
        if key not in have:
            return False
        if isinstance(value, dict):
            if not isinstance(have[key], dict) or not subset(value, have[key]):
                return False
        elif value != have[key]:
            return False
    return True


def test_containment_is_that_of_plain_python(spark):
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(CASES)] + [(98, None), (99, "{no json")], "h long, record string")
    held = records.record_paths(rows, "h", "record")
    wanted = records.record_paths(rows.withColumnRenamed("h", "w"), "w", "record")
    assert held.where("h > 90").isEmpty() and held.where("h = 0").count() == 1
    pairs = spark.createDataFrame(list(itertools.product(range(len(CASES)), repeat=2)), "w long, h long")
    got = {tuple(r) for r in records.contained(pairs, wanted, held, "w", "h").collect()}
    assert got == {(i, j) for i, j in itertools.product(range(len(CASES)), repeat=2) if subset(CASES[i], CASES[j])}


def test_diagnostics_stop_at_the_outermost(spark):
    good = {"schema_version": "1.0", "outcome": "primary_valid", "attempt_count": 2, "repair_attempted": False}
    cases = [
        good, {"x": {"structured_output": {**good, "more": good}}}, {"x": [good, {"y": {**good, "failure_code": "f"}}]},
        {"x": {**good, "attempt_count": True}}, {"x": {**good, "repair_attempted": 0}}, {"x": {**good, "schema_version": 1.0}}, {"x": {**good, "outcome": "other"}}, {"structured_output": good},
    ]
    paths = records.record_paths(spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i long, r string"), "i", "r")
    got = sorted((r.i, r.stage, r.failure_code or "", r.attempt_count, r.repair_attempted) for r in records.diagnostics(paths, "i").collect())
    assert got == [(0, "unknown", "", 2, False), (1, "x", "", 2, False), (2, "x.[]", "", 2, False), (2, "x.[].y", "f", 2, False), (7, "unknown", "", 2, False)]


def test_signatures_keep_the_order_asked_for(spark):
    rows = spark.createDataFrame([(1, json.dumps({"p": {"b": 2, "a": "x", "c": True, "d": 1.5}})), (2, "{}"), (3, "[1]")], "i long, r string")
    got = {r.i: r.signature for r in records.route_signature(records.record_paths(rows, "i", "r"), "i", [("p", ("b", "a", "c", "d"))]).collect()}
    assert got == {1: ["p:b:2", "p:a:x"], 2: [], 3: []}
    assert records.record_paths(rows.where(F.lit(False)), "i", "r").isEmpty()


def test_records_are_opened_inside_their_row(spark):
    good = {"schema_version": "1.0", "outcome": "primary_valid", "attempt_count": 2, "repair_attempted": False}
    deep = good
    for i in range(20):
        deep = [deep] if i % 2 else {"x": deep}
    cases = [
        good, {"x": {"structured_output": {**good, "more": good}}}, {"x": [good, {"y": {**good, "failure_code": "f"}}, 3, None, []]}, deep, {"a": "}{][", "b": good}, [], 7, {},
        {"x": {**good, "attempt_count": True}}, {"x": {**good, "repair_attempted": 0}}, {"x": {**good, "schema_version": 1.0}}, {"x": {**good, "outcome": None, "in": good}}, {"x": {**good, "failure_code": [1]}},
    ]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(98, None), (99, "{no json")], "i long, r string")
    direct = records.record_diagnostics(rows, ["i"], "r")
    assert "Exchange" not in direct._jdf.queryExecution().executedPlan().toString()
    plain = lambda df: sorted(map(repr, df.select("i", "stage", "outcome", "failure_code", "attempt_count", "repair_attempted").collect()))
    paths = records.record_paths(rows, "i", "r")
    assert plain(direct) == plain(records.diagnostics(paths, "i")) and direct.count() == 8
    # each value has a row
    values = lambda x: 1 + sum(map(values, x.values() if isinstance(x, dict) else x if isinstance(x, list) else []))
    assert {r.i: r["count"] for r in paths.groupBy("i").count().collect()} == {i: values(c) for i, c in enumerate(cases)}


def test_the_query_shuffles_groups_alone(spark):
    from attestor.queries.records import QUERIES

    plan = QUERIES["diagnostics_paths"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
