"""Nested records over the driver's tables: containment, diagnostics and route signatures by path."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import records
from attestor.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


@query("metadata_subset", "select doc_id from documents where coalesce(lang, 'und') = 'en' and coalesce(n_chars, 0) % 5 <> 0")
def _(spark, d):
    """Every document's record holds its language, tags and size; wanted are English, the same tags, and a size that is no multiple of five."""
    lang, source, size = F.coalesce("lang", F.lit("und")), F.coalesce("source", F.lit("none")), F.coalesce("n_chars", F.lit(0)).cast("long")
    docs = table(spark, d, "documents").select(
        "doc_id",
        F.to_json(F.struct(F.struct(lang.alias("lang"), F.array(source, lang).alias("tags"), F.struct(size.alias("chars")).alias("size")).alias("meta"), F.col("doc_id").alias("n"))).alias("held"),
        F.to_json(F.struct(F.struct(F.array(source, F.lit("en")).alias("tags"), F.struct(F.when(size % 5 != 0, size).otherwise(-1).cast("double").alias("chars")).alias("size")).alias("meta"))).alias("wanted"),
    )
    pairs = docs.select(F.col("doc_id").alias("wanted_id"), "doc_id")
    wanted = records.record_paths(docs.select(F.col("doc_id").alias("wanted_id"), "wanted"), "wanted_id", "wanted")
    return records.contained(pairs, wanted, records.record_paths(docs, "doc_id", "held"), "wanted_id", "doc_id").select("doc_id")


@query("diagnostics_paths", """select user_id, case when event_id % 4 = 0 then 'plan.[].grade' else 'plan.[]' end as stage, 'repair_valid' as outcome, event_type as failure_code, (event_id % 3)::bigint as attempt_count, event_id % 2 = 0 as repair_attempted, count(*) as n
    from events where event_id % 5 <> 0 group by all""")
def _(spark, d):
    """One record an event: a list of reports, a quarter of them one level further down; those of every fifth event are of another version."""
    i = F.col("event_id")
    report = F.struct(
        F.when(i % 5 == 0, "0.9").otherwise("1.0").alias("schema_version"), F.lit("repair_valid").alias("outcome"), F.col("event_type").alias("failure_code"), (i % 3).alias("attempt_count"),
        (i % 2 == 0).alias("repair_attempted"), F.struct(F.lit("1.0").alias("schema_version")).alias("inner"),
    )
    deep = F.when(i % 4 == 0, F.to_json(F.struct(F.array(F.struct(F.struct(report.alias("structured_output")).alias("grade"))).alias("plan"))))
    flat = F.to_json(F.struct(F.array(F.struct(report.alias("structured_output"))).alias("plan")))
    events = table(spark, d, "events").select("event_id", "user_id", F.coalesce(deep, flat).alias("record"))
    found = records.record_diagnostics(events, ["user_id"], "record")
    return found.groupBy("user_id", "stage", "outcome", "failure_code", "attempt_count", "repair_attempted").agg(F.count("*").alias("n"))


@query("route_signature", """select signature, count(*) as n from (select 'plan:strategy:' || event_type || '|plan:top_k:' || (event_id % 4)::varchar || case when event_id % 3 = 0 then '|retry:reason:again' else '' end as signature from events) group by 1""")
def _(spark, d):
    i = F.col("event_id")
    record = F.struct(F.struct((i % 4).alias("top_k"), F.col("event_type").alias("strategy"), (i % 2 == 0).alias("selected")).alias("plan"), F.when(i % 3 == 0, F.struct(F.lit("again").alias("reason"))).alias("retry"))
    paths = records.record_paths(table(spark, d, "events").select("event_id", F.to_json(record).alias("record")), "event_id", "record")
    told = records.route_signature(paths, "event_id", [("plan", ("strategy", "selected", "top_k")), ("retry", ("reason",))])
    return told.groupBy(F.array_join("signature", "|").alias("signature")).agg(F.count("*").alias("n"))
