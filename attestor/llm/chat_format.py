"""Chat formatting: schema fingerprints select declarative mappings to canonical turns, a reversible template, a loss mask.

DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Layouts: examples of records, of which the nested field paths are hashed, and where their turns are. ``list``: path of an array
#: and the names of role and text in it; ``parts``: (role, paths) in order, texts of several paths parted by an empty line.
LAYOUTS: dict[str, dict] = {
    "turn": {"examples": [{"role": "", "text": ""}, {"role": "", "content": ""}], "parts": [("$.role", ["$.text", "$.content"])]},
    "messages": {"examples": [{"messages": [{"role": "", "content": ""}]}], "list": ("$.messages", "role", "content")},
    "turns": {"examples": [{"turns": [{"role": "", "text": ""}]}], "list": ("$.turns", "role", "text")},
    "conversations": {"examples": [{"conversations": [{"from": "", "value": ""}]}], "list": ("$.conversations", "from", "value")},
    "prompt": {
        "examples": [{"prompt": "", "response": ""}, {"prompt": "", "completion": ""}, {"question": "", "answer": ""}],
        "parts": [("user", ["$.prompt", "$.question"]), ("assistant", ["$.response", "$.completion", "$.answer"])],
    },
    "instruction": {
        "examples": [{"instruction": "", "output": ""}, {"instruction": "", "input": "", "output": ""}, {"instruction": "", "response": ""}],
        "parts": [("user", ["$.instruction", "$.input"]), ("assistant", ["$.output", "$.response"])],
    },
    "system_prompt": {
        "examples": [{"system": "", "prompt": "", "response": ""}, {"system": "", "instruction": "", "output": ""}],
        "parts": [("system", ["$.system"]), ("user", ["$.prompt", "$.instruction"]), ("assistant", ["$.response", "$.output"])],
    },
}
#: Names that layouts give to roles of their own.
ROLE_NAMES = {"conversations": {"human": "user", "gpt": "assistant"}}
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Where a control string could begin, of this template or of common others: a backslash goes behind its first character.
CONTROL = r"(<)(?=/?s>|\|)|(\[)(?=/?INST\])"
LOSS_ROLE = "assistant"


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a variant: its schema with the types of all values taken out; null for null."""
    paths = F.regexp_replace(F.schema_of_variant(record), r"(?<=: |<)[A-Z]+(?:\(\d+,\d+\))?(?=[,>]|$)", "_")
    return F.sha2(paths, 256)


def _known(spark) -> dict[str, list[str]]:
    rows = [(name, json.dumps(e)) for name, layout in LAYOUTS.items() for e in layout["examples"]]
    found: dict[str, list[str]] = {}
    for name, digest in spark.createDataFrame(rows, "name string, example string").select("name", fingerprint(F.parse_json("example"))).collect():
        found.setdefault(name, []).append(digest)
    return found


def _turns(name: str, record: Column) -> Column:
    layout = LAYOUTS[name]
    if "list" in layout:
        path, role, text = layout["list"]
        items = F.try_variant_get(record, path, f"array<struct<`{role}`:string,`{text}`:string>>")
        label = lambda x: x[role]
        if name in ROLE_NAMES:
            names = F.create_map(*[F.lit(v) for pair in ROLE_NAMES[name].items() for v in pair])
            label = lambda x: F.coalesce(names[F.coalesce(x[role], F.lit(""))], x[role])
        return F.transform(items, lambda x: F.struct(F.coalesce(label(x), F.lit("")).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))
    turns = []
    for role, paths in layout["parts"]:
        label = F.coalesce(F.try_variant_get(record, role, "string"), F.lit("")) if role.startswith("$") else F.lit(role)
        turns.append(F.struct(label.alias("role"), F.concat_ws("\n\n", *[F.nullif(F.try_variant_get(record, p, "string"), F.lit("")) for p in paths]).alias("text")))
    return F.array(*turns)


def canonical_turns(records: DataFrame) -> DataFrame:
    """``(conv_id, turn, part, layout, role, text)`` of ``records`` (conv_id, turn, record as JSON): one row per canonical turn.

    A record is the whole conversation, or a piece of it in order of ``turn``. Its fingerprint selects the mapping. A record that is
    no JSON or has a layout that is not known gives one row with null layout, role and text, so nothing gets lost silently.
    Null roles and texts are empty.
    """
    parsed = records.select("conv_id", "turn", F.try_parse_json("record").alias("v")).withColumn("f", fingerprint(F.col("v")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout, digests in _known(records.sparkSession).items():
        hit = F.col("f").isin(digests)
        name, turns = F.when(hit, F.lit(layout)).otherwise(name), F.when(hit, _turns(layout, F.col("v"))).otherwise(turns)
    told = parsed.select("conv_id", "turn", name.alias("layout"), turns.alias("turns"))
    return told.select("conv_id", "turn", "layout", F.posexplode_outer("turns").alias("part", "t")).select("conv_id", "turn", "part", "layout", "t.role", "t.text")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss array<struct<start,length>>, n_unknown)`` of ``turns`` (conv_id, turn, part, role, text).

    ``<|turn|>role<|text|>text<|end|>`` per turn, in order of (turn, part, role, text), so ties have one order; control strings inside
    roles and texts are escaped. ``loss`` has the code points of each assistant text. Turns are formatted before they are
    shuffled; what meets in one task is one conversation's output, which is one value by its nature. Offsets are running sums.
    Rows of unknown layout (null role) add nothing to ``formatted`` and are counted in ``n_unknown``; a conversation of such rows
    alone is an empty string. Null texts are empty, a null conv_id is a conversation, repeated rows are turns each, an empty table
    gives no rows, and other columns are ignored.
    """
    t = turns.select("conv_id", "turn", "part", "role", "text", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "part", "role", "text")
    size = F.coalesce(F.length("head") + F.length("body") + F.lit(len(END)), F.lit(0))
    t = t.withColumn("at", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")).withColumn("i", F.row_number().over(order))
    piece = F.struct("i", F.coalesce(F.concat("head", "body", F.lit(END)), F.lit("")).alias("s"), F.col("role").isNull().alias("unknown"), F.when((F.col("role") == LOSS_ROLE) & (F.col("body") != ""), F.struct(F.col("at").alias("start"), F.length("body").cast("long").alias("length"))).alias("loss"))
    grouped = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return grouped.select("conv_id", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"), F.filter(F.transform("p", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss"), F.size(F.filter("p", lambda x: x["unknown"])).cast("long").alias("n_unknown"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns array<struct<role,text>>, loss_text, formatted_chars)``, from the formatted strings and masks alone.

    An empty string has no turns. Rows stay one by one; other columns are ignored.
    """
    segments = F.filter(F.split("formatted", r"<\|turn\|>"), lambda x: x != "")
    cut = F.transform(segments, lambda s: F.split(F.regexp_replace(s, r"<\|end\|>$", ""), r"<\|text\|>"))
    turns = F.transform(cut, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))
    # four bytes a code point, so that a span is found without reading what stands before it
    wide = formatted.withColumn("w", F.encode("formatted", "UTF-32"))
    spans = F.transform("loss", lambda x: F.decode(F.substring("w", (x["start"] * 4 + 1).cast("int"), (x["length"] * 4).cast("int")), "UTF-32"))
    return wide.select("conv_id", turns.alias("turns"), unescape(F.array_join(spans, "")).alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``; a conversation without turns has digests of nothing."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as JSON records of the layout ``turn``. A conversation is never one JSON value.

    Null roles and texts are empty; repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    return conversations.select("conv_id", "turn", record.alias("record"))


def mixed_records(conversations: DataFrame) -> DataFrame:
    """The same turns as JSON records of all layouts that hold one turn, as a table of many origins has them: a hash of the row chooses.

    Roles that a layout has a name of its own for are told by it; a role that is such a name, or none that a layout can hold,
    goes to the others. Nulls, repeated rows, empty tables and other columns as in ``turn_records``.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    names = ROLE_NAMES["conversations"]
    told = F.create_map(*[F.lit(v) for theirs, ours in names.items() for v in (ours, theirs)])[role]
    one = lambda r, t, value=role: F.struct(value.alias(r), text.alias(t))
    layouts = [
        F.to_json(one("role", "text")),
        F.to_json(one("role", "content")),
        F.to_json(F.struct(F.array(one("role", "content")).alias("messages"))),
        F.to_json(F.struct(F.array(one("role", "text")).alias("turns"))),
        F.to_json(F.struct(F.array(one("from", "value", told)).alias("conversations"))),
    ]
    which = F.pmod(F.xxhash64("conv_id", "turn", role, text), F.when(told.isNotNull(), 5).otherwise(4))
    record = layouts[0]
    for i, other in enumerate(layouts[1:], 1):
        record = F.when(which == i, other).otherwise(record)
    return conversations.select("conv_id", "turn", record.alias("record"))
