"""Exact nearest neighbours from a table of points that lies by pivot: cells that cannot hold one of the best are not read.

Points are unit vectors, and lie in files by their nearest pivot and by ring, their distance from it in steps of RING. By the triangle
inequality a point of a ring is as far from a question as the question's distance from the pivot and the ring's ends tell at least. A
batch of questions first reads the cells around it, whose k-th best gives each question a bar, and then only cells that can be nearer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.sources.scratch import materialise, small

from .lexical import PLACES, ranked

#: Pivots at most, whatever the table holds; width of a ring; points and questions of a row at most.
PIVOTS, RING, BLOCK = 256, 0.1, 512
#: Distances are computed with this error at most, many times over; bounds are widened by it.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorTable:
    """``blocks`` (pivot, ring, ids, vectors: rows of 64-bit numbers), ``cells`` (pivot, ring, low, high, n) and the ``pivots``, one row each."""

    blocks: DataFrame
    cells: DataFrame
    pivots: np.ndarray
    size: int


def checked(points: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``(doc_id, name, vector)`` of points with named vectors (doc_id, vectors map); a name that is not known, or another size than its name's, is an error."""
    told = points.select("doc_id", F.explode("vectors").alias("name", "vector"))
    known = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]) if sizes else F.create_map().cast("map<string,int>")
    size, wanted = F.size("vector"), F.try_element_at(known, F.col("name"))
    fault = F.when(wanted.isNull(), F.concat(F.lit("unknown vector "), F.col("name"))).when(size != wanted, F.format_string("vector %s of point %s has %d numbers instead of %d", F.col("name"), F.col("doc_id").cast("string"), size, wanted))
    return told.withColumn("name", F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("name")))


def write_collection(points: DataFrame, sizes: dict[str, int]) -> dict[str, VectorTable]:
    """A table for each named vector of ``points`` (doc_id, vectors), whose names and sizes are checked as they are written."""
    told = materialise(checked(points, sizes), "vectors", keep=True)
    return {name: build_table(told.where(F.col("name") == name), size) for name, size in sizes.items()}


def _units(batch: pa.RecordBatch, column: str, size: int) -> np.ndarray:
    x = np.array(batch.column(column).to_pylist(), np.float64)
    x = x.reshape(-1, size)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def build_table(points: DataFrame, size: int, pivots: int = PIVOTS) -> VectorTable:
    """The table of ``points`` (doc_id, vector of ``size`` numbers). Points without a vector, or of length 0, are invisible.

    Pivots are ``pivots`` points at most, and no more than the root of all, chosen by a hash of their ids: their number is a parameter, so tasks have them all.
    """
    told = points.where("vector is not null").select("doc_id", F.col("vector").cast("array<double>").alias("vector"))
    wrong = F.concat(F.lit("a vector has another size than "), F.lit(str(size)))
    told = told.withColumn("vector", F.when(F.size("vector") != size, F.raise_error(wrong).cast("array<double>")).otherwise(F.col("vector")))
    told = told.where(F.exists("vector", lambda v: v != 0))
    pivots = min(pivots, 1 + math.isqrt(told.count()))  # a small table has few cells
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(pivots).select("vector").collect()
    at = np.array([r.vector for r in chosen], np.float64).reshape(-1, size)
    at = np.unique(at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-300), axis=0)
    kind = told.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(batch, "vector", size)
            d = _distances(x, at)
            nearest = d.argmin(axis=1)
            own = d[np.arange(len(x)), nearest]
            yield pa.RecordBatch.from_arrays([pa.array(nearest, pa.int32()), pa.array(np.floor(own / RING), pa.int32()), pa.array(own), batch.column("doc_id"), pa.array([row.tobytes() for row in x], pa.binary())], ["pivot", "ring", "distance", "doc_id", "vector"])

    placed = materialise(told.mapInArrow(place, f"pivot int, ring int, distance double, doc_id {kind}, vector binary"), "placed", keep=True)
    # a cell's rows of BLOCK points each: full blocks do not need to be in order, so a hash deals them
    counts = placed.groupBy("pivot", "ring").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n"))
    cells = materialise(counts, "cells", keep=True)
    parts = small(cells.select("pivot", "ring", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    # dealt by pivot at once, so that a vector is shuffled once for its block and its file
    dealt = placed.join(parts, ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).repartition("pivot")
    blocks = dealt.groupBy("pivot", "ring", "part").agg(F.collect_list(F.struct("doc_id", "vector")).alias("p"))
    blocks = blocks.select("pivot", "ring", F.col("p.doc_id").alias("ids"), F.col("p.vector").alias("vectors"))
    written = materialise(blocks.sortWithinPartitions("pivot", "ring"), "vector-table", keep=True, by=("pivot", "ring"))
    return VectorTable(written, cells, at, size)


def _asked(table: VectorTable, questions: DataFrame) -> DataFrame:
    """``(part, query_ids, queries)``: questions as unit vectors, dealt to parts of about BLOCK; cells are wanted by a part's places, so vectors are not repeated."""
    size, kind = table.size, questions.schema["query_id"].dataType.simpleString()

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array([row.tobytes() for row in _units(batch, "vector", size)], pa.binary())], ["query_id", "vector"])

    told = questions.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    told = materialise(told.mapInArrow(unit, f"query_id {kind}, vector binary"), "asked", keep=True)
    part = F.pmod(F.xxhash64("query_id", "vector"), F.lit(max(1, math.ceil(told.count() / BLOCK)))).cast("int")
    parts = told.groupBy(part.alias("part")).agg(F.collect_list(F.struct("query_id", "vector")).alias("q"))
    return materialise(parts.select("part", F.col("q.query_id").alias("query_ids"), F.col("q.vector").alias("queries")), "question-parts", keep=True)


def _matrix(vectors: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(-1, size)


def _cells_of(table: VectorTable, parts: DataFrame, k: int, bars: bool) -> DataFrame:
    """``(part, pivot, ring, places)``: the cells that questions of ``parts`` want, and the places of these in their part.

    With ``bars`` (places and bars of a part), all cells that reach as near as the question's bar; else the cells around it that have ``k`` points.
    """
    cells = np.array([tuple(r) for r in table.cells.select("pivot", "ring", "low", "high", "n").collect()]).reshape(-1, 5)  # PIVOTS times the rings of the sphere at most
    cells = cells[np.lexsort((cells[:, 1], cells[:, 0]))]
    pivot, ring, n = (cells[:, i].astype(np.int64) for i in (0, 1, 4))
    low, high, at, size = cells[:, 2], cells[:, 3], table.pivots, table.size

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, queries, *held in zip(*(batch.column(c).to_pylist() for c in ("part", "queries", *(("at", "bar") if bars else ()))), strict=True):
                d = _distances(_matrix(queries, size), at)[:, pivot]
                if bars:
                    bar = np.full(len(d), np.inf)  # a question without k points wants all
                    if held[0]:
                        bar[held[0]] = held[1]
                    wanted = np.maximum(0.0, np.maximum(d - high, low - d)) <= (bar + SLACK)[:, None]
                else:
                    order = np.argsort(d + high, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    wanted = np.zeros(d.shape, bool)
                    np.put_along_axis(wanted, order, before < k, axis=1)
                some = np.flatnonzero(wanted.any(axis=0))
                columns = (np.full(len(some), part), pivot[some], ring[some])
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array([np.flatnonzero(wanted[:, c]).astype(np.int32) for c in some], pa.list_(pa.int32()))], ["part", "pivot", "ring", "places"])

    return parts.drop("query_ids").mapInArrow(choose, "part int, pivot int, ring int, places array<int>")


def files_of(table: VectorTable, wanted: DataFrame) -> DataFrame:
    """Blocks of the cells (pivot, ring) that are wanted; there are PIVOTS times the rings of cells at most."""
    rings: dict[int, list[int]] = {}
    for pivot, ring in wanted.select("pivot", "ring").distinct().collect():
        rings.setdefault(ring, []).append(pivot)
    return table.blocks.where(reduce(lambda a, b: a | b, [(F.col("ring") == r) & F.col("pivot").isin(sorted(p)) for r, p in sorted(rings.items())], F.lit(False)))


def _nearest(table: VectorTable, parts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(query_id, doc_id, score, asked)``: the best ``k`` of each block for the questions that want its cell (part, pivot, ring, places);
    ``asked`` is a question's part and place in one number."""
    size, ids = table.size, table.blocks.schema["ids"].dataType.elementType
    rows = files_of(table, wanted).join(small(wanted, BLOCK * 4 + 64), ["pivot", "ring"]).join(small(parts, BLOCK * (size * 8 + 40)), "part")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for names, vectors, query_ids, queries, part, places in zip(*(batch.column(c).to_pylist() for c in ("ids", "vectors", "query_ids", "queries", "part", "places")), strict=True):
                x, q = _matrix(vectors, size), _matrix(queries, size)
                scores = q[places] @ x.T
                told = np.round(scores, PLACES) + 0.0
                order = np.array([str(n) for n in names])
                for i, s in enumerate(told):
                    # all that are as good as the k-th, so that ties are settled by id
                    keep = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                    for j in keep[np.lexsort((order[keep], -s[keep]))][:k].tolist():
                        for column, value in zip(out, (query_ids[places[i]], names[j], scores[i, j], (part << 32) + places[i]), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column("query_ids").type.value_type), pa.array(out[1], batch.column("ids").type.value_type), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())], ["query_id", "doc_id", "score", "asked"])

    kind = parts.schema["query_ids"].dataType.elementType.simpleString()
    return rows.select("ids", "vectors", "query_ids", "queries", "part", "places").mapInArrow(best, f"query_id {kind}, doc_id {ids.simpleString()}, score double, asked long")


def wanted_cells(table: VectorTable, asked: DataFrame, k: int) -> DataFrame:
    """``(part, pivot, ring, places)``: the cells that can hold one of a question's best ``k``, of questions as ``_asked`` has them.

    Cells in order of how far their farthest point can be have ``k`` points together somewhere: those are read first, and the
    distance of the k-th best among them is the bar. Cells are chosen part by part, so pairs of questions and cells are not rows.
    """
    first = materialise(_cells_of(table, asked, k, False), "first", keep=True)
    kth = ranked(_nearest(table, asked, first, k), k, by="asked").where(F.col("rank") == k)
    bar = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score")))
    kth = kth.select(F.shiftright("asked", 32).cast("int").alias("part"), F.struct(F.col("asked").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at"), bar.alias("bar")).alias("b"))
    bars = materialise(kth.groupBy("part").agg(F.collect_list("b").alias("b")), "bars", keep=True)
    return _cells_of(table, asked.join(bars, "part", "left").select("part", "query_ids", "queries", F.col("b.at").alias("at"), F.col("b.bar").alias("bar")), k, True)


def table_topk(table: VectorTable, questions: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the ``k`` points nearest to each question (query_id, vector), as ``knn_topk`` has them.

    Points stay where they lie: questions are sent to the cells that they want, and a block's best ``k`` are what is shuffled. A
    table without points has no neighbours.
    """
    if not len(table.pivots):
        return questions.where("false").select("query_id", F.lit(None).cast(table.blocks.schema["ids"].dataType.elementType).alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    asked = _asked(table, questions)
    wanted = materialise(wanted_cells(table, asked, k), "wanted", keep=True)
    return ranked(_nearest(table, asked, wanted, k).drop("asked"), k)
