"""Questions with constraints of their own: retrieval inside each one's scope, the second scan, validation and inheritance."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import scopes, wording
from attestor.plans import pipelines

from . import corpus, planning, retrieval

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_MODES = ("none", "latest", "none", "none", "specific", "all_except_latest", "oldest_and_latest", "previous", "latest_and_previous", "oldest")


def question_scopes(spark, d):
    """Ten kinds of scopes in turn: none, each mode, names, and ranges of dates that begin with the question's id."""
    q = corpus.questions(spark, d)
    i, kind = F.col("query_id").cast("int"), F.col("query_id") % 10
    day = lambda start, days: F.to_timestamp(F.date_add(F.lit(start).cast("date"), days.cast("int")))
    span = lambda start, first, days: F.struct(day(start, first).alias("start"), day(start, first + days).alias("end"))
    mode = F.element_at(F.array(*map(F.lit, _MODES)), (kind + 1).cast("int"))
    titles = F.array(*[F.concat(F.lit("SRC"), (i % 7 + a).cast("string"), F.lit(" draft "), (i % 5 + a + 1).cast("string"), F.lit(".pdf")) for a in range(4)])
    return q.select(
        "query_id",
        F.when(kind == 2, titles).alias("names"),
        mode.alias("mode"),
        F.when(kind == 4, F.array(*[(i % 7 + a).cast("int") for a in (1, 2, 3)])).alias("versions"),
        F.when(kind.isin(3, 7, 9), span("2020-01-01", i % 300, F.lit(500))).alias("published"),
        F.when(kind == 8, F.struct(day("2024-01-01", i % 9).alias("start"), F.lit(None).cast("timestamp").alias("end"))).alias("uploaded"),
        F.when(kind == 5, span("2021-01-01", i % 300, F.lit(400))).alias("any_recorded"),
    )


SCOPES_SQL = f"""scopes as materialized (select item_id as query_id, item_id % 10 as kind, {list(_MODES)!r}[cast(item_id % 10 + 1 as int)] as mode,
        case when item_id % 10 = 2 then list_transform([0, 1, 2, 3], lambda a: 'src' || (item_id % 7 + a) || ' draft ' || (item_id % 5 + a + 1)) else [] end as names,
        case when item_id % 10 = 4 then [item_id % 7 + 1, item_id % 7 + 2, item_id % 7 + 3] end as numbers,
        case when item_id % 10 in (3, 7, 9) then timestamp '2020-01-01' + to_days(cast(item_id % 300 as int)) end as ps, case when item_id % 10 in (3, 7, 9) then timestamp '2020-01-01' + to_days(cast(item_id % 300 + 500 as int)) end as pe,
        case when item_id % 10 = 8 then timestamp '2024-01-01' + to_days(cast(item_id % 9 as int)) end as us,
        case when item_id % 10 = 5 then timestamp '2021-01-01' + to_days(cast(item_id % 300 as int)) end as s, case when item_id % 10 = 5 then timestamp '2021-01-01' + to_days(cast(item_id % 300 + 400 as int)) end as e from benchmark)"""
_DATES = """(ps is null or coalesce(published_at >= ps and published_at < pe, false)) and (us is null or coalesce(uploaded_at >= us, false))
        and (s is null or coalesce(published_at >= s and published_at < e, false) or coalesce(uploaded_at >= s and uploaded_at < e, false))"""


def _names(of: str) -> str:
    return f"(len(names) = 0 or list_has_any(names, {of}))"


_KNOWN = "[lower(title), document_id || ' v' || version_number]"
_STORED = "[lower(title)]"
_UNDATED = "ps is null and us is null and s is null"


def _admitted(stored: str) -> str:
    return f"""{_DATES} and {_names(stored)} and case when mode = 'specific' then list_contains(numbers, version_number) when mode = 'latest' and {_UNDATED} then is_latest
        when mode = 'oldest' and {_UNDATED} then version_number = 1 else true end"""


_KEPT = """case mode when 'specific' then list_contains(numbers, version_number) when 'latest' then newest = 1 when 'oldest' then oldest = 1 when 'previous' then newest = 2
        when 'latest_and_previous' then newest <= 2 when 'all_except_latest' then version_number < high when 'oldest_and_latest' then version_number in (low, high) else true end"""
_ENDS = """dense_rank() over (w order by version_number desc) as newest, dense_rank() over (w order by version_number) as oldest,
        min(version_number) over (w) as low, max(version_number) over (w) as high"""


def constrained_sql(k: int, wide: int, tag: str = "") -> str:
    """CTEs from ``scopes``, ``versions`` and the scores to ``found`` (query_id, doc_id, rank) of the hybrid plan for the best ``k``."""

    def hits(name, allowed, n, m):
        sql = planning._hybrid_sql(allowed, n, m)
        for old in ("kw", "pairs_", "dn", "fused"):
            sql = sql.replace(f"{old} as", f"{old}_{name} as").replace(f"from {old} ", f"from {old}_{name} ")
        return sql

    return f"""ok{tag} as materialized (select query_id, doc_id from scopes cross join versions where kind <> 0 and {_admitted(_KNOWN)}),
    {hits(f"a{tag}", f"(query_id, doc_id) in (select (query_id, doc_id) from ok{tag})", min(4 * wide, 100), wide)},
    {hits(f"f{tag}", "query_id in (select query_id from scopes where kind = 0)", min(4 * k, 100), k)},
    inside{tag} as (select f.query_id, f.doc_id, f.rank, s.mode, s.numbers, v.version_number, v.document_id from fused_a{tag} f join scopes s using (query_id) join versions v using (doc_id) where {_DATES} and {_names(_KNOWN)}),
    ends{tag} as (select *, {_ENDS.replace("(w order", "(partition by query_id, document_id order").replace("over (w)", "over (partition by query_id, document_id)")} from inside{tag}),
    found{tag} as materialized (select query_id, doc_id, rank from (select query_id, doc_id, row_number() over (partition by query_id order by rank) as rank from ends{tag} where {_KEPT}) where rank <= {k}
        union all select query_id, doc_id, rank from fused_f{tag})"""


@query("constrained_questions", f"with {corpus.BM25_SQL}, {retrieval.DENSE_SQL}, {corpus.VERSIONS_SQL}, {SCOPES_SQL}, {constrained_sql(10, 40)} select * from found")
def _(spark, d):
    found = pipelines.execute(planning.engine(spark, d), corpus.questions(spark, d), pipelines.Plan("hybrid", 10), question_scopes(spark, d))
    return planning._told(found)


@query("filter_fallback", f"""with {corpus.BM25_SQL}, {corpus.VERSIONS_SQL}, names as materialized (select item_id as query_id, list_transform([0, 1, 2, 3, 4, 5], lambda a: 'src' || (item_id % 3 + a) || ' draft ' || (item_id % 11 + a + 1)) as names from benchmark),
    scored_ as materialized (select query_id, doc_id, score, lower(title) as name, version_number % 2 = 0 as ready, names from scored join versions using (doc_id) join names using (query_id) where score > 0),
    first as (select query_id, doc_id, {planning._KEY} as rank from scored_ where ready and list_contains(names, name) qualify rank <= 40),
    again as (select query_id, doc_id, name, names, {planning._KEY} as rank from scored_ where query_id not in (select query_id from first) qualify rank <= 40),
    kept as (select query_id, doc_id, row_number() over (partition by query_id order by rank) as rank, false as fallback_scan from first
        union all select query_id, doc_id, row_number() over (partition by query_id order by rank), true from again where list_contains(names, name)) select * from kept where rank <= 10""")
def _(spark, d):
    own = planning.engine(spark, d)
    ready = F.when(F.col("version_number") % 2 == 0, F.lower("title"))  # older rows have no name ready
    own = pipelines.Corpus(own.documents.withColumn("title_normalized", ready), own.points, index=own.index)
    i = F.col("query_id")
    names = F.array(*[F.concat(F.lit("src"), (i % 3 + a).cast("string"), F.lit(" draft "), (i % 11 + a + 1).cast("string")) for a in range(6)])
    null = lambda kind: F.lit(None).cast(kind)
    ask = corpus.questions(spark, d).select("query_id", names.alias("names"), null("string").alias("mode"), null("array<int>").alias("versions"), *[null(scopes._RANGE).alias(r) for r in scopes.RANGES])
    return planning._told(pipelines.execute(own, corpus.questions(spark, d), pipelines.Plan("keyword", 10), ask), "fallback_scan")


_VALID = f"""case when kind = 0 then true else {_DATES} and {_names(_KNOWN)} and case mode when 'specific' then list_contains(numbers, version_number) when 'latest' then not ({_UNDATED}) or is_latest
    when 'previous' then not ({_UNDATED}) or not is_latest when 'oldest' then not ({_UNDATED}) or version_number = 1 when 'all_except_latest' then not ({_UNDATED}) or not is_latest
    when 'oldest_and_latest' then not ({_UNDATED}) or version_number = 1 or is_latest else true end end"""


@query("constraint_validation", f"""with {corpus.evidence_sql(40)}, {SCOPES_SQL}, v as (select query_id, {_VALID} as valid from evidence join scopes using (query_id)),
    c as (select query_id, count(*) as n, count(*) filter (valid) as m from v group by 1)
    select query_id, coalesce(n, 0) as n_candidates, coalesce(m, 0) as n_matched, coalesce(n - m, 0) as n_rejected, case when kind = 0 then 'not_requested' when m > 0 then 'matched' else 'no_match' end as status
    from scopes left join c using (query_id)""")
def _(spark, d):
    own = scopes.complete(question_scopes(spark, d), corpus.questions(spark, d))
    return scopes.validated(corpus.candidates(spark, d), own, scopes.facts(corpus.versions(spark, d)))[1]


@query("scope_inheritance", f"""with {SCOPES_SQL}, needs as (select a.query_id, b.* exclude (query_id) from scopes a join scopes b on b.query_id = a.query_id + 1)
    select n.query_id, case when len(n.names) > 0 then n.names[1] else q.names[1] end as first_name, case when n.mode <> 'none' then n.mode else q.mode end as mode, case when n.mode <> 'none' then n.numbers[1] else q.numbers[1] end as first_version,
        epoch(case when n.d then n.ps else q.ps end)::bigint as published, epoch(case when n.d then n.us else q.us end)::bigint as uploaded, epoch(case when n.d then n.s else q.s end)::bigint as any_recorded
    from (select *, coalesce(ps, us, s) is not null as d from needs) n join scopes q using (query_id)""")
def _(spark, d):
    q = scopes.complete(question_scopes(spark, d), corpus.questions(spark, d))
    needs = q.withColumn("query_id", F.col("query_id") - 1).join(q.select("query_id"), "query_id", "left_semi")  # a need has the next question's scope
    start = lambda r: F.unix_timestamp(F.col(r).getField("start")).alias(r)
    told = scopes.inherited(needs, q)
    return told.select("query_id", F.get("names", F.lit(0)).alias("first_name"), "mode", F.get("versions", F.lit(0)).cast("long").alias("first_version"), *map(start, scopes.RANGES))


#: Questions around the benchmark's whole texts, and what their wording asks for: names, then the ends of published, uploaded and any recorded date.
_ASKED = (
    ("Find documents uploaded in May 2026 about {}", (), None, ("2026-05-01", "2026-06-01"), None),
    ("Use policies published on March 15, 2025. {}", (), ("2025-03-15", "2025-03-16"), None, None),
    ("Show documents uploaded in the last 3 months on {}", (), None, ("2026-04-18 12:00:00", "2026-07-18 12:00:00"), None),
    ("Only use data from August: {}", (), None, None, ("2025-08-01", "2025-09-01")),
    ("What changed in the API since 2020? {}", (), None, None, None),
    ("Which were uploaded and published in 2023: {}", (), ("2023-01-01", "2024-01-01"), ("2023-01-01", "2024-01-01"), None),
    ("files imported between 2024-01-05 and 7/3/2024 {}", (), None, ("2024-01-05", "2024-03-08"), None),
    ("documents released before 2024-13-45 and 2023 {}", (), None, None, None),
    ('Only use "Architecture Guide" and plan_v4 to answer {}', ("Architecture Guide", "plan_v4"), None, None, None),
    ("According to Realization_Draft5.pdf, issued after Feb 29, 2024, what of {}", ("Realization_Draft5.pdf",), ("2024-03-01", None), None, None),
    ("Use the oldest version of the Finance report, added until 2021: {}", ("Finance",), None, (None, "2022-01-01"), None),
)


def _asked_sql(of: str, i: int) -> str:
    ends = lambda a: [None if a is None else a[k] for k in (0, 1)]
    return f"case item_id % {len(_ASKED)} " + " ".join(f"when {n} then timestamp '{v}'" for n, a in enumerate(_ASKED) if (v := ends(a[of])[i])) + " end"


@query("question_scopes", f"""select item_id as query_id, case item_id % {len(_ASKED)} {" ".join(f"when {n} then '{'|'.join(a[1])}'" for n, a in enumerate(_ASKED))} end as names,
    {", ".join(f"epoch({_asked_sql(of, i)})::bigint as {name}_{end}" for of, name in ((2, "published"), (3, "uploaded"), (4, "any_recorded")) for i, end in enumerate(("start", "end")))} from benchmark""")
def _(spark, d):
    q = corpus.questions(spark, d)
    asked = F.lit(None).cast("string")
    for n, (template, *_) in enumerate(_ASKED):
        before, after = template.split("{}")
        asked = F.when(F.col("query_id") % len(_ASKED) == n, F.concat(F.lit(before), "question", F.lit(after))).otherwise(asked)
    told = wording.question_scopes(q.withColumn("question", asked), F.lit("2026-07-18 12:00:00"))
    return told.select("query_id", F.array_join("names", "|").alias("names"), *[F.unix_timestamp(F.col(r).getField(e)).alias(f"{r}_{e}") for r in scopes.RANGES for e in ("start", "end")])
