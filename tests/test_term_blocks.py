"""The index that lies by term gives what all postings give, and reads less."""

import random

import threading

import pytest
from pyspark.sql import functions as F

from attestor.operators import lexical, term_blocks
from attestor.sources import scratch


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    common, rare = [f"common{i}" for i in range(6)], [f"rare{i}" for i in range(300)]
    rows = [(i, " ".join(r.choice(common if r.random() < 0.8 else rare) for _ in range(r.randint(1, 40)))) for i in range(1500)]
    return spark.createDataFrame(rows + [(1500, None), (1501, ""), (1502, "common0 " * 90)], "doc_id long, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def index(docs):
    return lexical.build_index(docs)


QUESTIONS = [(1, "rare1 common0 common1"), (2, "common0 common1 common2 common0"), (3, "rare5"), (4, "nothing known"), (5, ""), (6, None), (7, "rare7 rare8 rare9 common3"), (8, "COMMON5 common5!")]


def questions(spark, ids=range(1, 9)):
    return spark.createDataFrame([q for q in QUESTIONS if q[0] in ids], "query_id long, question string")


@pytest.mark.parametrize("block, lists, k", [(128, 1_000_000, 10), (4, 1_000_000, 3), (8, 200, 10), (1, 300, 1), (16, 1_000_000, 2000)])
def test_same_best_as_all_postings(spark, index, monkeypatch, block, lists, k):
    monkeypatch.setattr(term_blocks, "BLOCK", block)
    monkeypatch.setattr(term_blocks, "LIST", lists)
    own = term_blocks.build_blocks(index)
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    assert rows(term_blocks.blocks_topk(own, questions(spark), k)) == rows(lexical.bm25_topk(index, questions(spark), k))


def test_tiers_hold_one_then_four_times_as_many_blocks(spark):
    tiers = [r[0] for r in spark.range(90).select(term_blocks.tier(F.col("id"))).collect()]
    assert tiers == [0] + [1] * 4 + [2] * 16 + [3] * 64 + [4] * 5



def test_fewer_words_read_fewer_files(spark, index, monkeypatch, tmp_path):
    monkeypatch.setattr(term_blocks, "BLOCK", 4)
    own = term_blocks.build_blocks(index)
    all_blocks = own.bounds.count()
    few = term_blocks.wanted_blocks(own, questions(spark, [3]), 3)
    many = term_blocks.wanted_blocks(own, questions(spark, [1, 2, 7]), 3)
    different = lambda df: df.select("term", "list", "block").distinct().count()
    assert different(few) < different(many) < all_blocks / 2

    def files(ids):
        """Files that the scan of the blocks of these questions reads."""
        scan = term_blocks.files_of(own.blocks, term_blocks.wanted_blocks(own, questions(spark, ids), 3))
        scan.collect()
        return scan._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()

    whole = own.blocks.select("bucket", "tier").distinct().count()
    assert 0 < files([3]) <= 4 and files([3]) < files([1, 7]) < whole


def test_blocks_of_common_words_are_left_out(spark, index, monkeypatch):
    monkeypatch.setattr(term_blocks, "BLOCK", 4)
    own = term_blocks.build_blocks(index)
    wanted = term_blocks.wanted_blocks(own, questions(spark, [8]), 3).groupBy("term").count()
    there = own.bounds.groupBy("term").agg(F.count("*").alias("n"))
    told = {r.term: (r["count"], r.n) for r in wanted.join(there, "term").collect()}
    assert set(told) == {"common5"} and told["common5"][0] < told["common5"][1] / 10


def test_empty_corpus_and_questions(spark, index):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert term_blocks.blocks_topk(term_blocks.build_blocks(none), questions(spark), 3).count() == 0
    assert term_blocks.blocks_topk(term_blocks.build_blocks(index), questions(spark, []), 3).count() == 0


def test_scratches_of_threads_are_apart(spark):
    begun, ended, found = threading.Event(), threading.Event(), []

    def other():
        with scratch.scratch(spark):
            table = scratch.materialise(spark.range(3), "thread")
            begun.set()
            ended.wait(60)
            found.append(table.count())

    thread = threading.Thread(target=other)
    with scratch.scratch(spark):
        thread.start()
        assert begun.wait(60)
        mine = scratch.materialise(spark.range(5), "thread")
    ended.set()
    thread.join()
    assert found == [3]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        mine.count()


def test_blocks_of_asked_words_alone_answer_the_same(spark):
    from attestor.operators import lexical, term_blocks

    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} x{i}") for i in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "w1 w4"), (1, "w2 none x7")], "query_id long, question string")
    index = lexical.build_index(docs)
    blocks = term_blocks.build_blocks(index, lexical.question_terms(asked).select("term").distinct())
    assert {r.term for r in blocks.heads.collect()} == {"w1", "w4", "w2", "x7"}
    told = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    assert told(term_blocks.blocks_topk(blocks, asked, 5)) == told(lexical.bm25_topk(index, asked, 5))
