"""Rules over questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import understanding as U
from attestor.sources.tables import table

from . import corpus

QUERIES, ORACLE_SQL = {}, {}
Q = "trim(regexp_replace(question, '\\s+', ' ', 'g'))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _m(pattern: str) -> str:
    return f"regexp_matches({Q}, '{pattern}')"


CLASS_SQL = f"""{corpus.RULE_QUESTIONS_SQL}, classes as (select query_id, question,
    case when {_m(U.COMPARISON)} then 'comparison' when {_m(U.VERSION)} or {_m(U.YEAR)} then 'version_specific' when {_m(U.BROAD)} then 'broad_explanation' else 'factual_lookup' end as kind,
    case when {_m(U.COMPARISON)} then 0.88 when {_m(U.VERSION)} or {_m(U.YEAR)} then 0.86 when {_m(U.BROAD)} then 0.78 else 0.66 end::double as confidence,
    concat_ws(',', case when {_m(U.DOCUMENT)} or {_m(U.FILENAME)} then 'document' end, case when {_m(U.VERSION)} or {_m(U.YEAR)} then 'document_version' end,
              case when {_m(U.YEAR)} or {_m(U.DATE_RANGE)} then 'date_range' end, case when {_m(U.SECTION)} then 'section' end, case when {_m(U.FILE_TYPE)} then 'file_type' end, case when {_m(U.AUTHOR)} then 'author' end) as hints from questions)"""


@query("classify_rules", f"with {CLASS_SQL} select query_id, kind, confidence, hints from classes")
def _(spark, d):
    kind, confidence = U.classify(F.col("question"))
    return corpus.rule_questions(spark, d).select("query_id", kind.alias("kind"), confidence.alias("confidence"), U.hints(F.col("question")).alias("hints"))


@query("version_intent", f"""with {corpus.RULE_QUESTIONS_SQL}, n as (select *, list_transform(regexp_extract_all({Q}, '{U.NUMBERED}'), lambda m: regexp_extract(m, '(\\d+)', 1)::int) as numbers from questions)
    select query_id, case when len(numbers) > 0 then 'specific' when {_m(U.NEWEST)} and {_m(U.PREVIOUS)} then 'latest_and_previous' when {_m(U.NEWEST)} and {_m(U.OLDEST)} then 'oldest_and_latest'
        when {_m(U.OLDER)} then 'all_except_latest' when {_m(U.EVERY)} then 'all' when {_m(U.NEWEST)} then 'latest' when {_m(U.OLDEST)} then 'oldest' when {_m(U.PREVIOUS)} then 'previous'
        when {_m(U.VERSIONS_COMPARED)} then 'latest_and_previous' else 'none' end as mode, array_to_string(numbers, ',') as numbers,
        case when len(numbers) > 1 then 0.96 when len(numbers) > 0 then 0.93 when {_m(U.NEWEST)} and {_m(U.PREVIOUS)} then 0.94 when {_m(U.NEWEST)} and {_m(U.OLDEST)} then 0.95 when {_m(U.OLDER)} then 0.91
        when {_m(U.EVERY)} then 0.93 when {_m(U.NEWEST)} or {_m(U.OLDEST)} then 0.91 when {_m(U.PREVIOUS)} then 0.89 when {_m(U.VERSIONS_COMPARED)} then 0.72 else 0 end::double as confidence from n""")
def _(spark, d):
    mode, numbers, confidence = U.version_intent(F.col("question"))
    return corpus.rule_questions(spark, d).select("query_id", mode.alias("mode"), F.array_join(F.transform(numbers, lambda n: n.cast("string")), ",").alias("numbers"), confidence.alias("confidence"))


_SPLIT = r"(?i)\s+(?:and|as well as)\s+(how|why|what|which|where|when|whether|explain|describe|identify|list)\b"


@query("decompose_split", f"""with {corpus.RULE_QUESTIONS_SQL}, p as (select query_id, {Q} as q, list_filter(list_transform(string_split(regexp_replace({Q}, '{_SPLIT}', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x, ' ,;?.')), lambda x: x <> '') as parts from questions),
    n as (select query_id, case when len(parts) <= 1 then [q] else parts[:6] end as needs from p)
    select query_id, 'need_' || i as need_id, needs[i] as need from (select query_id, needs, unnest(range(1, len(needs) + 1)) as i from n)""")
def _(spark, d):
    return U.decompose(corpus.rule_questions(spark, d))


@query("plan_strategy", f"""with {CLASS_SQL} select query_id, case when kind = 'version_specific' then 'hybrid' when kind = 'comparison' then 'multi_query' when {_m(U.DISCRIMINATIVE)} or confidence < 0.55 then 'rerank'
    when kind = 'broad_explanation' then 'hierarchical' when hints <> '' then 'hybrid' else 'baseline' end as strategy from classes""")
def _(spark, d):
    kind, confidence = U.classify(F.col("question"))
    return corpus.rule_questions(spark, d).select("query_id", U.strategy(F.col("question"), kind, confidence, U.hints(F.col("question")) != "").alias("strategy"))


@query("retry_decision", """with e as (select event_id, event_id % 5 = 0 as sufficient, case when event_id % 3 = 0 then 'missing' else 'weak' end as status, event_id % 23 as total, event_id % 4 as attempts, (event_id % 10) / 10.0 as confidence, event_id % 2 as reclassified from events)
    select event_id, case when sufficient then 'complete_supported' when total >= 20 or attempts >= 3 then 'complete_exhausted' when status = 'missing' and confidence < 0.55 and reclassified < 1 then 'reclassify' else 'retry' end as action,
        case when sufficient then 'evidence_sufficient' when total >= 20 then 'global_attempt_limit_reached' when attempts >= 3 then 'information_need_attempt_limit_reached'
             when status = 'missing' and confidence < 0.55 and reclassified < 1 then 'low_confidence_missing_evidence' else 'evidence_insufficient_retry_available' end as reason from e""")
def _(spark, d):
    i = F.col("event_id")
    action, reason = U.retry_decision(i % 5 == 0, F.when(i % 3 == 0, "missing").otherwise("weak"), i % 23, 20, i % 4, 3, (i % 10) / 10, i % 2)
    return table(spark, d, "events").select("event_id", action.alias("action"), reason.alias("reason"))


@query("claim_order", """select event_id, row_number() over (partition by user_id order by case when event_type = 'click' then 0 else 1 end, value, cast(event_id as varchar)) as place from events qualify place <= 3""")
def _(spark, d):
    from pyspark.sql.window import Window

    order = Window.partitionBy("user_id").orderBy(F.when(F.col("event_type") == "click", 0).otherwise(1), "value", F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", F.row_number().over(order).cast("long").alias("place")).where("place <= 3")


@query("citation_extract", r"""with a as (select item_id as query_id, 'See [1, 2] and [' || (item_id % 7) || '], [2,9] and [x] [' || (item_id % 3) || ' , 4]. ' || text as answer from benchmark),
    g as (select query_id, list_transform(flatten(list_transform(regexp_extract_all(answer, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda x: string_split_regex(x, '\s*,\s*'))), lambda x: x::int) as r from a),
    u as (select query_id, unnest(r) as rank, unnest(range(1, len(r) + 1)) as o from g)
    select query_id, string_agg(rank::varchar, ',' order by o) as ranks from (select query_id, rank, min(o) as o from u where rank in (1, 2, 3, 4, 5) group by all) group by 1""")
def _(spark, d):
    from attestor.functions import text as T

    i = F.col("item_id").cast("int")
    answer = F.concat(F.lit("See [1, 2] and ["), (i % 7).cast("string"), F.lit("], [2,9] and [x] ["), (i % 3).cast("string"), F.lit(" , 4]. "), "text")
    ranks = T.cited_ranks(answer, F.array(*[F.lit(n) for n in (1, 2, 3, 4, 5)]))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.transform(ranks, lambda r: r.cast("string")), ",").alias("ranks"))
