"""Operators on small hand-made tables, with values worked out by hand."""

import math
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import chunking, evaluation, fusion, grading, hierarchy, lexical, registry, selection, understanding, vectors, versions
from attestor.plans import pipelines
from attestor.sources import tables
from attestor.streaming import ingest


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()[0]


def test_bm25_finds_the_one_document_with_the_words(spark):
    docs = spark.createDataFrame(
        [("a", "The architecture uses graph nodes and shared state."), ("b", "The zxqv-42 recovery token appears only in this operational runbook."), ("c", "The user interface displays citations and trace steps.")],
        "doc_id string, text string",
    )
    asked = spark.createDataFrame([(1, "zxqv 42 recovery token"), (2, "---")], "query_id int, question string")
    found = lexical.bm25_topk(docs, asked, 3).collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in found] == [(1, "b", 1)]
    assert found[0].score == pytest.approx(3.566652, abs=1e-6)


def test_no_documents_or_questions(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    asked = spark.createDataFrame([], "query_id int, question string")
    assert lexical.bm25_topk(docs, asked, 3).count() == 0


def test_fusion_scores(spark):
    v = spark.createDataFrame([(1, "S", 1), (1, "v", 2)], "query_id int, doc_id string, rank int")
    k = spark.createDataFrame([(1, "S", 1), (1, "k", 2)], "query_id int, doc_id string, rank int")
    found = fusion.reciprocal_rank_fusion([("vector", 1, v), ("keyword", 1, k)], 3).orderBy("rank").collect()
    assert [(r.doc_id, r.sources) for r in found] == [("S", "keyword,vector"), ("k", "keyword"), ("v", "vector")]
    assert [r.score for r in found] == pytest.approx([2 / 61, 1 / 62, 1 / 62])


def test_variants_weigh_less_than_the_original(spark):
    hits = spark.createDataFrame([(1, 0, "o", 1), (1, 0, "S", 2), (1, 1, "S", 1), (1, 1, "v", 2), (1, 2, "S", 1)], "query_id int, variant int, doc_id string, rank int")
    found = fusion.fuse_variants(hits, 2).orderBy("rank").collect()
    assert [(r.doc_id, r.matches) for r in found] == [("S", 3), ("o", 1)]
    assert [r.score for r in found] == pytest.approx([1.2 / 62 + 2 / 61, 1.2 / 61])


@pytest.mark.parametrize(
    "mode, numbers, kept",
    [
        ("none", [1, 2], [1, 2]),
        ("latest", [3, 2, 1], [3]),
        ("oldest", [3, 2, 1], [1]),
        ("previous", [3, 2, 1], [2]),
        ("all_except_latest", [3, 2, 1], [2, 1]),
        ("oldest_and_latest", [2, 3, 1], [3, 1]),
        ("latest_and_previous", [3, 2, 1], [3, 2]),
        ("latest", [3, None, 1], [3, None]),
        ("all_except_latest", [3, None, 1], [1]),
        ("oldest_and_latest", [3, None], [3]),
    ],
)
def test_version_modes(spark, mode, numbers, kept):
    e = spark.createDataFrame([(1, "d", n, i) for i, n in enumerate(numbers)], "query_id int, document_id string, version_number int, rank int")
    found = versions.rerank_rows(versions.select_versions(e, mode)).orderBy("rank").collect()
    assert [r.version_number for r in found] == kept
    assert [r["rank"] for r in found] == list(range(1, len(kept) + 1))


def test_latest_inside_dates(spark):
    e = spark.createDataFrame([(1, "d", n, 4 - n, datetime(2020 + n, 1, 1), None, "t", "f") for n in (3, 2, 1)], "query_id int, document_id string, version_number int, rank int, published_at timestamp, uploaded_at timestamp, title string, filename string")
    c = versions.Constraints(mode="latest", published=(None, datetime(2023, 1, 1)))
    assert [r.version_number for r in versions.constrain(e, c).collect()] == [2]
    assert versions.constrain(e, versions.Constraints(uploaded=(datetime(2000, 1, 1), None))).count() == 0  # a missing date is outside


def test_constraints_are_checked():
    with pytest.raises(ValueError):
        versions.Constraints(mode="newest")
    with pytest.raises(ValueError):
        versions.Constraints(mode="specific")


def test_balance_prefers_the_primary_document(spark):
    e = spark.createDataFrame([(1, r, "R" if r <= 3 else "F", r > 3) for r in range(1, 8)], "query_id int, rank int, document_key string, is_primary boolean")
    found = selection.balance(e, 5).orderBy("selected_rank").collect()
    assert [r["rank"] for r in found] == [4, 5, 6, 1, 2]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from("ABC"), min_size=1, max_size=14), st.integers(1, 8), st.booleans())
def test_balance_is_the_selection_loop(spark, keys, top_k, preferred):
    def loop():
        chosen, counts = [], {}

        def take(pool, limit, each):
            for r, key in pool:
                if len(chosen) >= limit:
                    return
                if r in chosen or (each is not None and counts.get(key, 0) >= each):
                    continue
                chosen.append(r)
                counts[key] = counts.get(key, 0) + 1

        rows = list(enumerate(keys, start=1))
        up = lambda share: max(1, math.ceil(top_k * share))
        first = [x for x in rows if x[1] == "A"] if preferred else []
        if first:
            low = min(top_k, up(0.6))
            high = min(top_k, max(low, up(0.8)))
            take(first, low, high)
            take([x for x in rows if x[1] != "A"], top_k, up(0.4))
            take(first, top_k, high)
        else:
            take(rows, top_k, up(0.6))
        take(rows, top_k, None)
        return chosen

    e = spark.createDataFrame([(1, r, k, preferred and k == "A") for r, k in enumerate(keys, start=1)], "query_id int, rank int, document_key string, is_primary boolean")
    assert [r["rank"] for r in selection.balance(e, top_k).orderBy("selected_rank").collect()] == loop()


def test_primary_document(spark):
    g = spark.createDataFrame([(1, "F", 1, 0.9, 0.8), (1, "R", 2, 0.9, 0.0)], "query_id int, document_key string, rank int, relevance double, name_score double")
    (r,) = selection.primary_document(g).collect()
    assert (r.document_key, r.score, r.margin, r.confidence) == ("F", pytest.approx(0.834), pytest.approx(0.168), pytest.approx(0.7935))


@pytest.mark.parametrize(
    "name, key",
    [("Realization_Draft4.pdf", "realization"), ("Redraft4.pdf", "redraft4"), ("Annual Report 2024.pdf", "annual report 2024"), ("Architecture-v2.md", "architecture"), ("Architecture version 3.md", "architecture"), ("Plan draft 2 v3", "plan")],
)
def test_family_keys(spark, name, key):
    assert one(spark, T.family_key, name) == key


def test_names(spark):
    assert one(spark, T.document_name, " 'dir\\Final_Report-2.PDF' ".replace("'", "")) == "final report 2"
    assert one(spark, T.safe_filename, "a b/ü.pdf") == "a_b_.pdf"
    assert understanding.document_names('See "Alpha Plan" and beta.pdf') == ["Alpha Plan", "beta.pdf"]


def test_text_functions(spark):
    assert one(spark, T.normalize_text, " a b\n\x1fc ") == "a b c"
    assert one(spark, T.token_count, "a b c") == 3 and one(spark, T.token_count, "  ") == 0 and one(spark, T.token_count, "a") == 1
    assert one(spark, T.first_heading, "x\n## Title \ny") == "Title" and one(spark, T.first_heading, "x") is None
    assert one(spark, lambda c: T.cited_ranks(c, F.array(F.lit(1), F.lit(2))), "[2, 1] [7] [2]") == [2, 1]


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="ab \n", max_size=900), st.integers(200, 400), st.integers(0, 199))
def test_windows_are_the_loop(spark, page, size, overlap):
    clean, expected, start = " ".join(page.split()), [], 0
    while clean:
        end = min(len(clean), start + size)
        if piece := clean[start:end].strip():
            expected.append(piece)
        if end == len(clean):
            break
        start = end - overlap
    pages = spark.createDataFrame([(1, 1, page)], "document_version_id int, page_number int, text string")
    assert [r.text for r in chunking.chunk_pages(pages, size, overlap).orderBy("ordinal").collect()] == expected


def test_ordinals_run_over_pages(spark):
    pages = spark.createDataFrame([(1, 1, "a"), (1, 2, " "), (1, 3, "b")], "document_version_id int, page_number int, text string")
    assert [(r.ordinal, r.page_number) for r in chunking.chunk_pages(pages).orderBy("ordinal").collect()] == [(1, 1), (2, 3)]
    near = chunking.with_neighbours(chunking.chunk_pages(pages)).orderBy("ordinal").collect()
    assert [r.neighbours for r in near] == ["b", "a"]
    with pytest.raises(ValueError):
        chunking.chunk_pages(pages, 100, 0)


def test_groups_of_similar_chunks(spark):
    chunks = spark.createDataFrame([(1, i, v) for i, v in enumerate([[1.0, 0.0], [0.95, 0.05], [0.0, 1.0], [0.05, 0.95]])], "document_version_id int, ordinal int, vector array<double>")
    groups = {}
    for r in hierarchy.group_chunks(chunks, 2, 4).collect():
        groups.setdefault(r.cluster, set()).add(r.ordinal)
    assert sorted(map(sorted, groups.values())) == [[0, 1], [2, 3]]
    many = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(10)], "document_version_id int, ordinal int, vector array<double>")
    found = hierarchy.group_chunks(many, 2, 3).collect()
    assert sorted(r.ordinal for r in found) == list(range(10)) and len({r.cluster for r in found}) <= 3


def test_cohesion_is_the_mean_over_pairs(spark):
    p = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 1.0]), (1, 2, [0.0, 2.0]), (2, 3, [1.0, 1.0])], "group_id int, id int, vector array<double>")
    pairs = hierarchy.cosine_pairs(p).collect()
    for r in hierarchy.cohesion(p).collect():
        own = [x.similarity for x in pairs if r.id in (x.a, x.b)]
        assert r.cohesion == pytest.approx(sum(own) / len(own) if own else 0.0)


def test_nearest_points(spark):
    p = spark.createDataFrame([(i, [float(i % 3 == 0), float(i % 3 == 1), 1.0]) for i in range(12)] + [(99, None), (98, [0.0, 0.0, 0.0])], "doc_id int, vector array<double>")
    asked = spark.createDataFrame([(7, [0.0, 1.0, 1.0])], "query_id int, vector array<double>")
    assert [r.doc_id for r in vectors.knn_topk(p, asked, 3).orderBy("rank").collect()] == [1, 10, 4]  # ties by id as a string
    assert 98 not in [r.doc_id for r in vectors.knn_topk(p, asked, 20).collect()]


def test_grading_and_arbitration(spark):
    e = spark.createDataFrame([(1, 1, "alpha beta gamma"), (1, 2, "unrelated words"), (1, 3, "alpha only")], "query_id int, rank int, text string")
    n = spark.createDataFrame([(1, "need_1", "alpha beta", True), (1, "need_2", "delta epsilon", False)], "query_id int, need_id string, need string, required boolean")
    pairs = grading.grade_pairs(e, n)
    grades = {r["rank"]: r for r in grading.evidence_grades(pairs).collect()}
    assert [grades[i].relevant for i in (1, 2, 3)] == [True, False, True] and grades[1].supports == ["need_1"]
    needs = {r.need_id: r for r in grading.need_grades(n, pairs).collect()}
    assert needs["need_1"].status == "supported" and needs["need_2"].status == "missing" and needs["need_1"].ranks == [1, 3]
    r = grading.report(grading.need_grades(n, pairs), grading.evidence_grades(pairs)).first()
    assert (r.status, r.n_relevant, r.n_unresolved) == ("sufficient", 2, 0)
    prior = grading.evidence_grades(pairs)
    proposed = prior.withColumn("relevant", F.col("rank") != 1).withColumn("relevance", F.lit(1.0))
    final = {r["rank"]: r for r in grading.arbitrate(prior, proposed).collect()}
    assert [final[i].relevant for i in (1, 2, 3)] == [False, False, True]
    assert all(final[i].relevance <= grades[i].relevance for i in final)
    told = grading.arbitrate_needs(grading.need_grades(n, pairs), grading.need_grades(n, pairs), grading.arbitrate(prior, proposed)).orderBy("need_id").collect()
    assert [(t.status, t.ranks) for t in told] == [("supported", [3]), ("missing", None)]


def test_recall_matches_one_to_one(spark):
    wanted = spark.createDataFrame([(1, 0), (1, 1)], "case_id int, expectation_id int")
    both_on_one = spark.createDataFrame([(1, 0, 1), (1, 1, 1)], "case_id int, expectation_id int, rank int")
    assert evaluation.recall_at_k(wanted, both_on_one, 5).first().value == 0.5
    swap = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 1)], "case_id int, expectation_id int, rank int")
    assert evaluation.recall_at_k(wanted, swap, 5).first().value == 1.0
    assert evaluation.recall_at_k(wanted, swap, 1).first().value == 0.5


def test_stability(spark):
    a = spark.createDataFrame([(1, 1, "x", ["a", "b"], "succeeded"), (1, 2, "x", ["a", "c"], "succeeded"), (2, 1, "y", [], "succeeded"), (2, 2, None, None, "failed")], "case_id int, attempt int, outcome string, ids array<string>, status string")
    good = a.where("status = 'succeeded'")
    assert evaluation.success_rate(a).first().value == 0.75
    assert evaluation.exact_agreement(good, "outcome").first().value == 1.0
    assert evaluation.jaccard_agreement(good, "ids").first().value == pytest.approx((1 / 3 + 1) / 2)
    assert evaluation.exact_agreement(good.where("false"), "outcome").first().value is None


@pytest.mark.parametrize(
    "question, mode",
    [("current and previous policy", "latest_and_previous"), ("Use all older versions", "all_except_latest"), ("oldest and newest versions", "oldest_and_latest"), ("ordinary question", "none"), ("Compare version 2 with v4", "specific"), ("every version's text in all versions", "all")],
)
def test_version_intent(spark, question, mode):
    assert one(spark, lambda c: understanding.version_intent(c)[0], question) == mode


NOW = datetime(2026, 7, 18, 12, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    "question, scope",
    [
        ("uploaded in May 2026", ("uploaded_at", datetime(2026, 5, 1, tzinfo=timezone.utc), datetime(2026, 6, 1, tzinfo=timezone.utc))),
        ("published in the last 3 months", ("published_at", datetime(2026, 4, 18, 12, tzinfo=timezone.utc), NOW)),
        ("Find the 2025 documents.", None),
        ("documents since May 2026", ("any_recorded", datetime(2026, 5, 1, tzinfo=timezone.utc), None)),
    ],
)
def test_date_scopes(question, scope):
    assert understanding.date_scope(question, NOW) == scope


def test_decomposition(spark):
    q = spark.createDataFrame([(1, "What are the pipeline flows and how do they function?"), (2, "plain and simple")], "query_id int, question string")
    assert [(r.query_id, r.need) for r in understanding.decompose(q).orderBy("query_id", "need_id").collect()] == [(1, "What are the pipeline flows"), (1, "how do they function"), (2, "plain and simple")]


def test_registry(spark):
    stored = spark.createDataFrame([("d", 1)], "document_id string, version_number int")
    new = spark.createDataFrame([("d", "b"), ("d", "a"), ("e", "c")], "document_id string, version_id string")
    assert sorted((r.document_id, r.version_id, r.version_number) for r in registry.number_versions(new, stored).collect()) == [("d", "a", 2), ("d", "b", 3), ("e", "c", 1)]
    v = spark.createDataFrame([("d", 1, "ready"), ("d", 2, "failed"), ("e", 1, "failed")], "document_id string, version_number int, status string")
    assert sorted((r.document_id, r.latest_version, r.document_status) for r in registry.latest_ready(v).collect()) == [("d", 1, "ready"), ("e", 1, "failed")]
    docs = spark.createDataFrame([(1, "Realization", "Realization_Draft4.pdf", 1), (2, "Other", "other.md", 2)], "document_id int, title string, filename string, created_at int")
    up = spark.createDataFrame([("u", "Realization_Draft5.pdf"), ("w", "other.txt"), ("x", "unknown.md")], "upload_id string, filename string")
    assert sorted((r.upload_id, r.document_id) for r in registry.same_document_candidates(up, docs).collect()) == [("u", 1), ("w", 2)]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("﻿# T\nx", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "c.bin").write_bytes(b"x")
    found = {r.path[-5:]: r for r in tables.read_files(spark, str(tmp_path)).collect()}
    assert found["/a.md"].text == "# T\nx" and found["b.txt"].text == "é" and found["c.bin"].error == "unsupported_type"


def test_evaluation_sets(spark, tmp_path):
    (tmp_path / "set.json").write_text('{"schema_version": "1.0", "name": "n", "version": "1", "default_top_k": 4, "cases": [{"id": "c", "question": "q", "expected_evidence": [{"text_contains": ["a"]}]}, {"id": "e", "question": "r"}]}')
    found = sorted(tables.read_evaluation(spark, str(tmp_path / "set.json")).collect(), key=lambda r: r.case_id)
    assert [(r.case_id, r.top_k, r.fragments) for r in found] == [("c", 4, ["a"]), ("e", 4, None)]


def test_stream_of_documents(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, 1, "hello world")], "document_version_id int, page_number int, text string").write.parquet(str(source))
    for _ in range(2):  # a second run finds nothing new
        arrivals = spark.readStream.schema("document_version_id int, page_number int, text string").parquet(str(source))
        ingest.ingest_stream(arrivals, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.text for r in ingest.read_chunks(spark, str(tmp_path / "out")).collect()] == ["hello world"]


def test_agent_loop(spark):
    docs = spark.createDataFrame([(1, "alpha pipeline flows are listed"), (2, "the beta function"), (3, "nothing")], "doc_id int, text string")
    corpus = pipelines.Corpus(docs, vectors.embed_documents(docs, pipelines.EMBEDDING_SIZE))
    states = pipelines.answer_question(corpus, "What are the alpha pipeline flows and what is zeta omega kappa?", pipelines.Limits(attempts=2))
    assert [s.status for s in states] == ["supported", "exhausted"]
    assert 1 in states[0].evidence and len(states[1].tried) == 2


def test_words_and_buckets_are_counted_inside_the_row(spark, monkeypatch):
    from attestor.operators import lexical, vectors

    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "--"), (5, "B b Straße strasse ß")], "doc_id long, text string")
    plans, write = {}, lexical.materialise

    def told(df, name, **more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, **more)

    monkeypatch.setattr(lexical, "materialise", told)
    postings = lexical.build_index(docs).postings
    assert "Exchange" not in plans["postings"]
    assert sorted(map(tuple, postings.select("doc_id", "term", "tf", "length").collect())) == [(1, "a", 2, 3), (1, "b", 1, 3), (5, "b", 2, 5), (5, "ss", 1, 5), (5, "strasse", 2, 5)]
    vectors_ = vectors.embed_documents(docs, 64)
    assert "Exchange" not in vectors_._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.vector for r in vectors_.collect()}
    assert set(got) == {1, 2, 4, 5} and sorted(abs(x) for x in got[1])[-2:] == [1 / 5**0.5, 2 / 5**0.5]


def test_routing_multiplies_tiles_and_passes_over_vectors_of_length_0(spark, monkeypatch):
    import math

    from attestor.operators import hierarchy, vectors

    monkeypatch.setattr(vectors, "TILE", 7)
    vector = lambda i: [0.0, 0.0] if i == 30 or i % 4 == 3 else [math.cos(i), math.sin(i)]
    rows = [(i, f"d{i % 2}", f"d{i % 2}:{i % 4}", vector(i)) for i in range(60)]
    chunks = spark.createDataFrame(rows, "doc_id long, document_id string, section_id string, vector array<double>")
    sections = hierarchy.centroids(chunks, "section_id").join(chunks.select("section_id", "document_id").distinct(), "section_id")
    asked = spark.createDataFrame([(q, [math.cos(q / 3), math.sin(q / 3)]) for q in range(20)], "query_id long, vector array<double>")
    found = hierarchy.route(asked, hierarchy.centroids(chunks, "document_id"), sections, chunks, 5, 2, 4)
    told: dict = {}
    for r in found.orderBy("query_id", "rank").collect():
        told.setdefault(r.query_id, []).append((r.doc_id, r.section_id))
    for q in range(20):
        scored = sorted((-round(math.cos(i - q / 3), 9), str(i), i) for i in range(60) if any(vector(i)))
        assert told[q] == [(i, rows[i][2]) for *_, i in scored[:5]]


def test_scores_of_a_document_are_added_up_without_a_shuffle(spark, monkeypatch):
    from math import log

    from attestor.operators import lexical

    monkeypatch.setattr(lexical, "PART", 3)
    texts = {i: " ".join(f"w{(i * j) % 7}" for j in range(1, 2 + i % 5)) for i in range(10)}
    docs = spark.createDataFrame([*texts.items(), (10, None), (11, "--")], "doc_id long, text string")
    index = lexical.build_index(docs)
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q}") for q in range(6)], "query_id long, question string")
    scores = lexical.bm25_scores(index, asked)
    assert "Exchange hashpartitioning" not in scores._jdf.queryExecution().executedPlan().toString()
    mean, want = sum(len(t.split()) for t in texts.values()) / 12, {}
    for q in range(6):
        for term, weight in ((f"w{q}", 2), (f"w{q + 1}", 1)):
            df = sum(term in t.split() for t in texts.values())
            for i, t in texts.items():
                if tf := t.split().count(term):
                    share = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t.split()) / mean))
                    want[q, i] = want.get((q, i), 0) + weight * log(1 + (12 - df + 0.5) / (df + 0.5)) * share
    got = {(r.query_id, r.doc_id): r.score for r in scores.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
