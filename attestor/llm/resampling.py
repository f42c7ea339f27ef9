"""Target-distribution importance resampling: hashed word runs weigh documents towards a target, the best of a random draw are ranked.

Array-scored weights: counts of all buckets make one array of gains, whose length is a parameter and not the corpus', and a document's
weight is the sum of its features' places in that array. The draw takes the k highest keys exactly: the k-th composite key of score,
doc_id and row is found digit by digit from counts of a digit's values (radix selection), so that only the drawn rows are sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

#: Bits of a digit: at most 2 ** DIGIT counts come to the driver at once.
DIGIT = 14
#: Distinct features whose bucket a task remembers.
MEMO = 200_000
#: A-Z become a-z; bytes that are no digit, no letter and part of no longer UTF-8 character become blanks.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Buckets(dict):
    """Bucket of a feature; the first MEMO features are remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(self) < MEMO:
            self[feature] = found
        return found


def _features(text: bytes | None, least: int, most: int) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of ``least`` to ``most`` consecutive words."""
    words = (text or b"").translate(WORD_BYTES).split()
    out = list(words) if least == 1 else []
    for n in range(max(2, least), most + 1):
        out += map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return len(words), out


def bucket_counts(texts: DataFrame, buckets: int = 10_000, least: int = 1, most: int = 1) -> np.ndarray:
    """Number of features in each bucket, over all rows of ``text``; null and empty texts have none.

    A task adds up its rows in one array of ``buckets`` numbers; at most that many sums come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = np.fromiter(map(of.__getitem__, _features(text, least, most)[1]), np.int64)
                total += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    sums = texts.select(F.col("text").cast("binary")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's smoothed share of the target over its share of the source, rounded down."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(b + 1) * float(s + n)) / (float(a + 1) * float(t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def score_documents(docs: DataFrame, gain: np.ndarray, seed: int = 2024, least: int = 1, most: int = 1) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of each row: the weight plus Gumbel noise that the seed and the doc_id fix.

    Null texts have no words and weight 0; a null doc_id counts as an empty one; repeated rows are rows each.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Buckets(len(gain))
        for batch in batches:
            n_words, n_features, weight, total = [], [], [], []
            for text, doc in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                n, found = _features(text, least, most)
                w = int(gain[np.fromiter(map(of.__getitem__, found), np.int64, len(found))].sum()) if found else 0
                h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
                n_words.append(n)
                n_features.append(len(found))
                weight.append(w)
                total.append(w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight, total))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def first_k(rows: DataFrame, keys: list[Column], k: int) -> Column:
    """Condition that holds for exactly the ``k`` rows of ``rows`` (written already, at least k) with the smallest composite key.

    ``keys``: long columns without nulls, the most weighty first; together they must tell all rows apart. Each round counts one
    digit's values among the rows that agree with the digits found so far, and keeps the value in which the k-th row lies. It
    ends as soon as all rows with that value belong to the k.
    """
    taken, equal = F.lit(False), F.lit(True)
    if k <= 0:
        return taken
    for key in keys:
        low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
        if n == k:
            break
        narrow = high - low < 2**63
        offset = key - F.lit(low) if narrow else key.bitwiseXOR(F.lit(-(2**63)))
        width = (high - low).bit_length() if narrow else 64
        while width and n != k:
            bits = min(DIGIT, width)
            width -= bits
            digit = F.shiftrightunsigned(offset, width).bitwiseAND(F.lit(2**bits - 1))
            for value, count in sorted(rows.groupBy(digit.alias("digit")).count().collect()):
                if count >= k:
                    break
                k -= count
            taken, n = taken | (equal & (digit < value)), count
            equal, rows = equal & (digit == value), rows.where(digit == value)
        if n == k:
            break
    return taken | equal


def rank_rows(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """``rows`` (``k`` of them) with ``rank`` from 1 in ``order``, which tells all rows apart: ranges are sorted, each in a task."""
    spark = rows.sparkSession
    ranges = rows.repartitionByRange(max(1, min(shuffle_partitions(spark), -(-k // 1000))), *order).sortWithinPartitions(*order)
    placed = materialise(ranges.withColumns({"part": F.spark_partition_id(), "rank": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)) + 1}), "ranges", keep=True)
    before, starts = 0, []
    for part, n in sorted(placed.groupBy("part").count().collect()):  # as many rows as there are ranges
        starts.append((part, before))
        before += n
    starts = spark.createDataFrame(starts, "part int, before long")
    return placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, least: int = 1, most: int = 1) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null for rows that are not drawn.

    ``docs``: doc_id, text; ``target``: text. Features are runs of ``least`` to ``most`` words. Of the rows with at least
    ``least_words`` words, ``percent`` in a hundred with the highest scores are drawn, ties to the smaller doc_id. Rows that are
    equal in both are told apart by their place, so the number drawn is exact. Null ids come last among ties; null and empty
    texts have no features and are not drawn; an empty table gives no rows; an empty target counts nothing; other columns are
    not read.
    """
    gain = gains(bucket_counts(docs, buckets, least, most), bucket_counts(target, buckets, least, most))
    scored = materialise(score_documents(docs, gain, seed, least, most).withColumn("row", F.monotonically_increasing_id()), "scored", keep=True)
    enough = F.col("n_words") >= least_words
    rows = scored.where(enough)
    k = rows.count() * percent // 100
    id_key = F.coalesce("doc_id", F.lit(2**63 - 1))
    drawn = F.coalesce(enough & first_k(rows, [F.bitwise_not("score"), id_key, F.col("row")], k), F.lit(False))
    ranked = rank_rows(scored.where(drawn), [F.desc("score"), id_key, F.col("row")], k) if k else scored.where("false").withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")).select(columns))
