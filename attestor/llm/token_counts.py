"""Token totals by source, language and tokenizer version, kept up to date by signed changes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, files
from .tokens import blank_chunks, byte_bpe

KEYS = ("source", "lang", "tokenizer_version")
TOTALS = ("documents", "tokens", "chars")


def count_tokens(docs: DataFrame, tokenizer_path: str, version: str, ranks_path: str | None = None) -> DataFrame:
    """``(doc_id, source, lang, tokenizer_version, tokens, chars)`` of every document's whole text.

    Texts are cut where byte-level pre-tokenisation always cuts; a task tokenises each distinct chunk once and adds lengths up.
    Null texts count as empty: 0 tokens. Null sources and languages stay null, which is a group of its own. Repeated rows are
    documents each, an empty table gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = byte_bpe(tokenizer_path, ranks_path)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                chunks = [blank_chunks(t or "") for t in part["text"]]
                table.learn(chunks)
                tokens = [len(table.joined(c)) // 4 for c in chunks]
                table.forget()
                yield pd.DataFrame({"doc_id": part["doc_id"], "source": part["source"], "lang": part["lang"], "tokens": tokens, "chars": [len(t or "") for t in part["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text").mapInPandas(run, "doc_id long, source string, lang string, tokens long, chars long")
    return rows.withColumn("tokenizer_version", F.lit(version))


def estimated_counts(docs: DataFrame, version: str) -> DataFrame:
    """The same columns without a tokenizer, as a first load has them: a token for each four bytes, rounded up."""
    text = F.coalesce("text", F.lit(""))
    tokens, chars = F.ceil(F.octet_length(text) / 4), F.length(text).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", tokens.alias("tokens"), chars.alias("chars"), F.lit(version).alias("tokenizer_version"))


def insertions(counts: DataFrame) -> DataFrame:
    """Signed changes that add every counted document."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("documents"), "tokens", "chars")


def deletions(counts: DataFrame) -> DataFrame:
    """Signed changes that take every counted document away."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).alias("tokens"), (-F.col("chars")).alias("chars"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed changes that replace earlier counts of the same documents: one deletion and one insertion each."""
    return deletions(before).unionByName(insertions(after))


def rollup(changes: DataFrame) -> DataFrame:
    """Additive totals by group; groups whose documents, tokens and chars are all 0 again disappear. Sums combine before the shuffle."""
    sums = changes.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS])
    return sums.where(" or ".join(f"{c} <> 0" for c in TOTALS))


class TokenLedger:
    """Totals at ``path``, one folder of summed changes per batch.

    A batch is one directory named by its id. It is written under another name and renamed at the end, which succeeds for one writer
    alone, so a repeated, retried or doubled commit changes nothing and one that dies leaves nothing that is read. Totals are the
    sum over committed batches; ``compact``, which one writer runs at a time, folds them into a snapshot that lists them, and
    deletes what it folded. Only batches since the last snapshot are listed on the driver.
    """

    SCHEMA = "source string, lang string, tokenizer_version string, documents long, tokens long, chars long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        fs, path = files(self.spark, f"{self.path}/{name}")
        return fs.exists(path)

    def _named(self, kind: str) -> list[str]:
        fs, path = files(self.spark, self.path)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{kind}=") and self._exists(f"{n}/_SUCCESS"))

    def _renamed(self, old: str, new: str) -> bool:
        """Give a directory its name; False if another has it already."""
        jvm = self.spark._jvm
        fs, path = files(self.spark, f"{self.path}/{new}")
        if fs.exists(path):
            return False
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(files(self.spark, f"{self.path}/{old}")[1], path, none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        return True

    def _snapshot(self) -> str | None:
        return (self._named("snapshot") or [None])[-1]

    def _folded(self) -> DataFrame:
        last = self._snapshot()
        names = self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(f"{self.path}/snapshot={last}/names") if last else names

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch once; True if it was new. Batch ids may hold letters, digits, ``_`` and ``-``. An empty batch is a batch too."""
        if not batch_id or not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"bad batch id {batch_id!r}")
        if self._exists(f"batch={batch_id}/_SUCCESS") or not self._folded().where(F.col("batch") == batch_id).isEmpty():
            return False
        attempt = f"attempt-{uuid.uuid4().hex}"
        rollup(changes).write.parquet(f"{self.path}/{attempt}")
        done = self._renamed(attempt, f"batch={batch_id}")
        if not done:
            delete(self.spark, f"{self.path}/{attempt}")
        return done

    def _fresh(self) -> list[str]:
        """Committed batches that the snapshot does not hold: all, unless a compaction died before it deleted what it folded."""
        names = self._named("batch")
        if not names:
            return []
        held = {r[0] for r in self._folded().where(F.col("batch").isin(names)).collect()}
        return [n for n in names if n not in held]

    def totals(self) -> DataFrame:
        last = self._snapshot()
        paths = [f"{self.path}/batch={b}" for b in self._fresh()] + [f"{self.path}/snapshot={last}/totals"] * bool(last)
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return rollup(self.spark.read.schema(self.SCHEMA).option("recursiveFileLookup", "true").parquet(*paths))

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot; its name comes last, then what it folded goes."""
        last, fresh = self._snapshot(), self._fresh()
        attempt, number = f"attempt-{uuid.uuid4().hex}", f"{int(last or -1) + 1:08d}"
        self.totals().write.parquet(f"{self.path}/{attempt}/totals")
        self._folded().unionByName(self.spark.createDataFrame([(b,) for b in fresh], "batch string")).write.parquet(f"{self.path}/{attempt}/names")
        fs, marker = files(self.spark, f"{self.path}/{attempt}/_SUCCESS")
        fs.create(marker, True).close()
        if not self._renamed(attempt, f"snapshot={number}"):
            raise RuntimeError("another writer compacts this ledger")
        for old in [f"batch={b}" for b in fresh] + [f"snapshot={last}"] * bool(last):
            delete(self.spark, f"{self.path}/{old}")
