"""BM25 from an index that lies by term: blocks in order of impact, of which only those that can matter are read, exactly.

A term's postings lie in blocks of BLOCK, the highest shares of the score first, and a block tells its highest share. Blocks are
files by the term's bucket and by tier: the first block of a list, the next FAN, the next FAN squared, and so on. A batch of
questions reads in two steps:

* the first blocks of its terms. The sums of what they tell of a document are lower bounds, and the k-th best of a question's
  lower bounds is a bar that its k-th best document reaches;
* those blocks whose bound reaches the bar: a document in a block scores at most the block's share, and the most that the
  question's other terms can give. What is left out belongs to documents below the bar, so the best k have all their postings
  and their exact scores.

Both steps first ask for the buckets and tiers that they want, of which there are few whatever the corpus holds, and Spark reads the
files of those alone. The bar helps where few words carry a question; with many, the most that the others can give is high, and what is
saved is the postings of words that nobody asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.sources.scratch import materialise, small

from .lexical import K1, B, Index, build_index, idf, question_terms, ranked

BLOCK, FAN, BUCKETS = 128, 4, 16
#: Postings of a term from which on it has several lists, each in an order of its own.
LIST = 1_000_000
#: Scores may differ by this from their sum in another order; ranks look at fewer places.
SLACK = 1e-8


@dataclass(frozen=True)
class BlockIndex:
    """``blocks`` (bucket, tier, term, list, block, most, postings), their ``bounds`` without the postings, ``heads`` (term, head: the most of
    any of its blocks); ``frequencies`` and ``size`` as of ``Index``."""

    blocks: DataFrame
    heads: DataFrame
    bounds: DataFrame
    frequencies: DataFrame
    size: DataFrame


def tier(block: Column) -> Column:
    """0 for the first block of a list, 1 for the next FAN, 2 for the next FAN squared, and so on."""
    return F.when(block == 0, 0).otherwise(F.floor(F.log(float(FAN), (block - 1) * (FAN - 1) / FAN + 1) + 1e-9).cast("int") + 1)


def build_blocks(docs: DataFrame | Index, terms: DataFrame | None = None) -> BlockIndex:
    """The index of ``docs`` (doc_id, text), or of their word index, written to the shared folder.

    A term in very many documents has one list for each LIST of them, so no task sorts more than that. With ``terms`` (term, distinct), all that
    will be asked for, other words' postings are left where they lie, as no answer depends on them; statistics stay those of all words.
    """
    index = docs if isinstance(docs, Index) else build_index(docs)
    mean = F.col("mean_length")
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    frequent = small(materialise(index.frequencies.where(F.col("df") > LIST).select("term", F.ceil(F.col("df") / LIST).cast("int").alias("lists")), "frequent", keep=True), 120)
    postings = index.postings if terms is None else index.postings.join(small(terms), "term", "left_semi")
    told = postings.join(F.broadcast(index.size), how="cross").join(frequent, "term", "left")
    of_list = F.pmod(F.xxhash64("doc_id"), F.coalesce("lists", F.lit(1))).cast("int")
    told = told.select("term", of_list.alias("list"), "doc_id", share.alias("share"))
    place = F.row_number().over(Window.partitionBy("term", "list").orderBy(F.desc("share"), F.col("doc_id").cast("string"))) - 1
    told = told.withColumn("block", F.floor(place / BLOCK).cast("int"))
    blocks = told.groupBy("term", "list", "block").agg(F.max("share").alias("most"), F.collect_list(F.struct("doc_id", "share")).alias("postings"))
    blocks = blocks.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"), tier(F.col("block")).alias("tier"), "term", "list", "block", "most", "postings")
    written = materialise(blocks.repartition("bucket", "tier").sortWithinPartitions("bucket", "tier", "term"), "term-blocks", keep=True, by=("bucket", "tier"))
    bounds = materialise(written.select("bucket", "tier", "term", "list", "block", "most"), "bounds", keep=True)
    heads = materialise(bounds.groupBy("term").agg(F.max("most").alias("head")), "heads", keep=True)
    return BlockIndex(written, heads, bounds, index.frequencies, index.size)


def _weights(index: BlockIndex, questions: DataFrame) -> DataFrame:
    """``(query_id, term, bucket, w, limit)``: weight of a question's term, and the most that its other terms can give together."""
    told = question_terms(questions).join(index.frequencies, "term").join(F.broadcast(index.size), how="cross").join(index.heads, "term")
    told = told.select("query_id", "term", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"), (F.col("weight") * idf()).alias("w"), "head")
    most = F.col("w") * F.col("head")
    return told.withColumn("limit", F.sum(most).over(Window.partitionBy("query_id")) - most)


def files_of(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blocks in the files (bucket, tier) that are wanted: at most BUCKETS times the tiers, which grow with the logarithm of a list."""
    buckets: dict[int, list[int]] = {}
    for bucket, tier_ in wanted.select("bucket", "tier").distinct().collect():
        buckets.setdefault(tier_, []).append(bucket)
    return blocks.where(reduce(lambda a, b: a | b, [(F.col("tier") == t) & F.col("bucket").isin(sorted(b)) for t, b in sorted(buckets.items())], F.lit(False)))


def _scores(blocks: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``(query_id, doc_id, score)`` of what the wanted blocks (keys, query_id, w) tell."""
    rows = files_of(blocks, wanted).join(wanted, keys).select("query_id", "w", F.explode("postings").alias("p"))
    return rows.groupBy("query_id", "p.doc_id").agg(F.sum(F.col("w") * F.col("p.share")).alias("score"))


def wanted_blocks(index: BlockIndex, questions: DataFrame, k: int) -> DataFrame:
    """``(query_id, w, bucket, tier, term, list, block)``: the blocks that can hold one of a question's best ``k`` documents."""
    weights = small(materialise(_weights(index, questions), "weights", keep=True), 200)
    first = weights.withColumn("tier", F.lit(0))
    lower = _scores(index.blocks, first, ["bucket", "tier", "term"])
    bar = ranked(lower, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    told = index.bounds.join(weights, ["bucket", "term"]).join(small(materialise(bar, "bars", keep=True)), "query_id", "left")
    reaches = F.col("bar").isNull() | (F.col("w") * F.col("most") + F.col("limit") >= F.col("bar") - SLACK)
    return told.where(reaches).select("query_id", "w", "bucket", "tier", "term", "list", "block")


def blocks_topk(index: BlockIndex, questions: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the best ``k`` documents of every question (query_id, question), as ``bm25_topk`` has them.

    A question with fewer than ``k`` documents in its first blocks has no bar, and all blocks of its terms are read.
    """
    wanted = small(materialise(wanted_blocks(index, questions, k), "wanted", keep=True), 200)
    scored = _scores(index.blocks, wanted, ["bucket", "tier", "term", "list", "block"])
    return ranked(scored.where("score > 0"), k)

