"""Nested records (JSON) as rows of paths: containment, diagnostics and coded values are joins and groupings over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.sources.scratch import materialise

#: Version and outcomes of a diagnostic that may be shown.
DIAGNOSTIC_VERSION = "1.0"
DIAGNOSTIC_OUTCOMES = ("primary_valid", "repair_valid", "fallback")


def _kind(value: Column) -> Column:
    def named(told: Column) -> Column:
        return (
            F.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").when(told == "VOID", "null")
            .when(told == "BIGINT", "integer").when(told == "STRING", "string").when(told == "BOOLEAN", "boolean").otherwise("number")
        )

    # an array of one element binds the schema, which is worked out once
    return F.get(F.transform(F.array(F.schema_of_variant(value)), named), 0)


def _node(path: Column, v: Column) -> Column:
    return F.struct(path.alias("path"), v.alias("v"), _kind(v).alias("kind"))


def _children(node: Column) -> Column:
    """``array<struct<path, v, kind>>``: the members or elements of a node; none of a scalar."""
    inner = lambda step, v: _node(F.concat(node["path"], F.array(step)), v)
    members = F.transform(F.map_entries(F.try_variant_get(node["v"], "$", "map<string,variant>")), lambda e: inner(F.concat(F.lit("."), e["key"]), e["value"]))
    elements = F.transform(F.try_variant_get(node["v"], "$", "array<variant>"), lambda x, i: inner(F.concat(F.lit("["), i.cast("string"), F.lit("]")), x))
    return F.when(node["kind"] == "object", members).when(node["kind"] == "array", elements).otherwise(F.slice(F.array(node), 1, 0))


def _opened(column: str, take: Callable[[Column], Column], kind: str, all_in: bool) -> Column:
    """``array<kind>``: what ``take`` makes of the nodes of a JSON text, level by level inside its row; nulls go. Without ``all_in``, nodes that
    it makes something of are not looked into.

    A text has at most as many levels of containers as opening brackets; those that it does not have cost next to nothing.
    """
    text = F.col(column)
    levels = F.length(text) - F.length(F.translate(text, "{[", "")) + 1
    # what is no JSON has no node
    top = F.transform(F.array_compact(F.array(F.try_parse_json(text))), lambda v: _node(F.array().cast("array<string>"), v))
    start = F.struct(F.array().cast(f"array<{kind}>").alias("found"), top.alias("level"))

    def step(held: Column, _: Column) -> Column:
        def after(told: Column) -> Column:
            found = F.concat(held["found"], F.transform(F.filter(told, lambda t: t["told"].isNotNull()), lambda t: t["told"]))
            entered = told if all_in else F.filter(told, lambda t: t["told"].isNull())
            return F.struct(found.alias("found"), F.flatten(F.transform(entered, lambda t: _children(t["node"]))).alias("level"))

        told = F.transform(held["level"], lambda node: F.struct(node.alias("node"), take(node).alias("told")))
        return F.when(F.size(held["level"]) == 0, held).otherwise(F.get(F.transform(F.array(told), after), 0))

    return F.aggregate(F.sequence(F.lit(1), levels), start, step, lambda held: held["found"])


def record_paths(records: DataFrame, by: str, column: str) -> DataFrame:
    """``(by, path, type, text, same)``: a row for each value in the JSON texts of ``records``, containers too.

    ``path`` is an array: ".key" for a member, "[i]" for an element, empty for the whole. ``text`` is a scalar's own text. Values are
    equal where type and ``same`` are: numbers and booleans compare as numbers, so 1, 1.0 and true are equal; an array's ``same`` is its
    size, and so is an object's inside an array, while an object outside has none, as others may have more members.
    Null texts and those that are no JSON have no rows. A record is opened inside its row, so nothing is shuffled; the rows are written once.
    """

    def told(node: Column) -> Column:
        v, path, type_ = node["v"], node["path"], node["kind"]
        boolean = F.try_variant_get(v, "$", "boolean").cast("int")
        number = F.when(type_ == "boolean", boolean.cast("double")).otherwise(F.try_variant_get(v, "$", "double"))
        exact = F.when(type_ == "boolean", boolean.cast("decimal(38,18)")).otherwise(F.try_variant_get(v, "$", "decimal(38,18)"))
        scalar = F.when(type_.isin("object", "array"), F.lit(None)).otherwise(F.try_variant_get(v, "$", "string"))
        held = F.when(type_ == "array", F.size(F.try_variant_get(v, "$", "array<variant>"))).otherwise(F.size(F.try_variant_get(v, "$", "map<string,variant>")))
        size = held.cast("string")
        same = (
            F.when((type_ == "array") | ((type_ == "object") & F.exists(path, lambda p: p.startswith("["))), size)
            .when(type_ == "string", scalar)
            .when(type_.isin("integer", "number", "boolean"), F.concat_ws("|", exact.cast("string"), (number + F.lit(0.0)).cast("string")))
        )
        return F.struct(path.alias("path"), type_.alias("type"), scalar.alias("text"), same.alias("same"))

    found = _opened(column, told, "struct<path:array<string>,type:string,text:string,same:string>", True)
    rows = records.where(F.col(column).isNotNull()).select(by, F.inline(found))
    return materialise(rows, "record-paths", keep=True)


def _compared(type_: Column) -> Column:
    return F.when(type_.isin("integer", "boolean"), "number").otherwise(type_)


def contained(pairs: DataFrame, wanted: DataFrame, held: DataFrame, wanted_by: str, held_by: str) -> DataFrame:
    """The ``pairs`` (wanted_by, held_by) whose wanted record lies in the held one: members of objects are compared one by one,
    arrays as a whole. ``wanted`` and ``held`` are ``record_paths``. A wanted id without paths asks for nothing."""
    need = pairs.select(wanted_by, held_by).distinct().join(wanted, wanted_by).select(wanted_by, held_by, "path", _compared(F.col("type")).alias("_type"), "same")
    have = held.select(F.col(held_by), "path", _compared(F.col("type")).alias("_held"), F.col("same").alias("_same"))
    missing = need.join(have, [held_by, "path"], "left").where(~((F.col("_type").eqNullSafe(F.col("_held"))) & F.col("same").eqNullSafe(F.col("_same"))))
    return pairs.join(missing.select(wanted_by, held_by).distinct(), [wanted_by, held_by], "left_anti")


def diagnostics(paths: DataFrame, by: str) -> DataFrame:
    """``(by, stage, outcome, failure_code, attempt_count, repair_attempted)`` of the objects in ``record_paths`` that are safe diagnostics.

    Safe: of DIAGNOSTIC_VERSION, one of DIAGNOSTIC_OUTCOMES, whole attempts, a boolean repair. What lies inside such an object is not
    looked at. The stage is the path, elements as "[]", without a "structured_output" at its end.
    """
    name = F.element_at("path", -1)
    of = lambda key, *types: F.max(F.when((name == f".{key}") & F.col("type").isin(*types), F.col("text")))
    scalar = ("string", "integer", "number", "boolean")
    found = paths.where(F.size("path") > 0).groupBy(by, F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(
        of("schema_version", "string").alias("_version"), of("outcome", "string").alias("outcome"), of("failure_code", *scalar).alias("failure_code"),
        of("attempt_count", "integer").cast("long").alias("attempt_count"), of("repair_attempted", "boolean").cast("boolean").alias("repair_attempted"),
    )
    found = found.where((F.col("_version") == DIAGNOSTIC_VERSION) & F.col("outcome").isin(*DIAGNOSTIC_OUTCOMES) & F.col("attempt_count").isNotNull() & F.col("repair_attempted").isNotNull())
    above = found.where("size(path) > 0").select(by, "path", F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice(F.col("path"), F.lit(1), n))).alias("_above"))
    nested = above.join(found.select(by, F.col("path").alias("_above")), [by, "_above"], "left_semi").select(by, "path").distinct()
    outer = found.join(nested, [by, "path"], "left_anti")
    return outer.select(by, _stage(F.col("path")).alias("stage"), "outcome", "failure_code", "attempt_count", "repair_attempted")


def _stage(path: Column) -> Column:
    parts = F.when(F.element_at(F.concat(F.array(F.lit("")), path), -1) == ".structured_output", F.slice(path, F.lit(1), F.size(path) - 1)).otherwise(path)
    shown = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("["), "[]").otherwise(F.substring(p, 2, 1 << 30))), ".")
    return F.coalesce(F.nullif(shown, F.lit("")), F.lit("unknown"))


def record_diagnostics(records: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """``diagnostics`` of the JSON texts of ``records``, with the columns ``by``: safe ones are told inside the row, from the object itself,
    so nothing is shuffled or written."""

    def told(node: Column) -> Column:
        def of(key: str, kind: str) -> Column:
            return F.try_variant_get(node["v"], f"$.{key}", kind)

        code = of("failure_code", "variant")
        code = F.when(_kind(code).isin("string", "integer", "number", "boolean"), F.try_variant_get(code, "$", "string"))
        shown = F.struct(_stage(node["path"]).alias("stage"), of("outcome", "string").alias("outcome"), code.alias("failure_code"), of("attempt_count", "long").alias("attempt_count"), of("repair_attempted", "boolean").alias("repair_attempted"))
        typed = lambda key, kind: of(key, "variant").isNotNull() & (_kind(of(key, "variant")) == kind)
        # what most objects lack is asked first
        return F.when(
            (node["kind"] == "object") & (of("schema_version", "string") == DIAGNOSTIC_VERSION) & of("outcome", "string").isin(*DIAGNOSTIC_OUTCOMES)
            & typed("schema_version", "string") & typed("outcome", "string") & typed("attempt_count", "integer") & typed("repair_attempted", "boolean"), shown,
        )

    found = _opened(column, told, "struct<stage:string,outcome:string,failure_code:string,attempt_count:bigint,repair_attempted:boolean>", False)
    return records.where(F.col(column).isNotNull()).select(*by, F.inline(found))


def route_signature(paths: DataFrame, by: str, parts: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """``(by, signature)``: codes "prefix:key:value" in the order of ``parts`` (prefix, keys), of the members of the object named prefix.

    Only texts and whole numbers are coded. A record with none of them has an empty signature.
    """
    order = {(prefix, key): i for i, (prefix, key) in enumerate((p, k) for p, keys in parts for k in keys)}
    at = F.create_map(*[x for (p, k), i in order.items() for x in (F.lit(f".{p}\n.{k}"), F.lit(i))])
    place = F.try_element_at(at, F.array_join("path", "\n"))
    code = F.when(F.col("type").isin("string", "integer") & place.isNotNull(), F.struct(place.alias("i"), F.concat_ws(":", F.substring(F.get("path", F.lit(0)), 2, 1 << 30), F.substring(F.get("path", F.lit(1)), 2, 1 << 30), F.col("text")).alias("code")))
    return paths.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(code)), lambda c: c["code"]).alias("signature"))
