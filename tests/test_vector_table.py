"""The table by pivot gives what all points give, and reads the cells that it must."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from attestor.operators import vector_table, vectors

SIZE = 6


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, SIZE))
    rows = [(i, (centres[i % 12] + r.normal(scale=0.05, size=SIZE)).tolist()) for i in range(900)]
    rows += [(900 + i, rows[i][1]) for i in range(0, 40)]  # equal vectors: ties by id
    return spark.createDataFrame([*rows, (2000, [0.0] * SIZE), (2001, None), (None, rows[0][1])], "doc_id long, vector array<double>").cache()


def asked(points):
    return points.where("doc_id % 37 = 0 or doc_id = 2001 or doc_id = 905").withColumnRenamed("doc_id", "query_id")


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 7)) for r in df.where("query_id is not null and doc_id is not null").collect())


@pytest.mark.parametrize("pivots, block, k", [(24, 512, 10), (1, 16, 3), (256, 64, 1), (8, 512, 5000)])
def test_same_neighbours_as_all_points(spark, points, monkeypatch, pivots, block, k):
    monkeypatch.setattr(vector_table, "BLOCK", block)
    known = points.where("doc_id is not null")
    table = vector_table.build_table(known, SIZE, pivots)
    assert rows(vector_table.table_topk(table, asked(known), k)) == rows(vectors.knn_topk(known, asked(known), k))


def test_cells_far_away_are_not_read(spark, points):
    table = vector_table.build_table(points, SIZE, 24)
    one = vector_table._asked(table, asked(points).where("query_id = 37"))
    wanted = vector_table.wanted_cells(table, one, 5)
    cells = table.cells.count()
    assert 0 < wanted.count() < cells / 3
    scan = vector_table.files_of(table, wanted)
    scan.collect()
    read = scan._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()
    assert read == wanted.count()


def test_sizes_and_names_are_checked_when_written(spark):
    good = spark.createDataFrame([(1, {"a": [1.0, 0.0], "b": [1.0, 2.0, 3.0]}), (2, {"a": [0.0, 1.0]})], "doc_id long, vectors map<string,array<double>>")
    tables = vector_table.write_collection(good, {"a": 2, "b": 3})
    assert tables["a"].cells.groupBy().sum("n").first()[0] == 2 and tables["b"].cells.groupBy().sum("n").first()[0] == 1
    with pytest.raises(PySparkException, match="unknown vector b"):
        vector_table.write_collection(good, {"a": 2})
    with pytest.raises(PySparkException, match="vector b of point 1 has 3 numbers instead of 4"):
        vector_table.write_collection(good, {"a": 2, "b": 4})
    with pytest.raises(PySparkException, match="another size than 3"):
        vector_table.build_table(spark.createDataFrame([(1, [1.0])], "doc_id long, vector array<double>"), 3)


def test_no_points_and_no_questions(spark, points):
    none = points.where("false")
    assert vector_table.table_topk(vector_table.build_table(none, SIZE), asked(points), 3).count() == 0
    assert vector_table.table_topk(vector_table.build_table(points, SIZE, 4), asked(none), 3).count() == 0


def test_cells_are_wanted_by_parts_of_questions_without_their_vectors(spark, points):
    known = points.where("doc_id is not null")
    table = vector_table.build_table(known, SIZE, 24)
    wanted = vector_table.wanted_cells(table, vector_table._asked(table, asked(known)), 50)
    assert wanted.columns == ["part", "pivot", "ring", "places"]
    assert 0 < wanted.count() <= table.cells.count()  # all questions are one part, and a cell that several want is one row
