"""What the operators share: scratch tables and the read of an input table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.sources.scratch import BROADCAST_BYTES, checkpoint_root, dealt, delete, discard, files, freed, materialise, scratch, small
from attestor.sources.tables import table

__all__ = ["BROADCAST_BYTES", "checkpoint_root", "dealt", "delete", "discard", "files", "freed", "materialise", "scratch", "shuffle_partitions", "small", "table", "without"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids``. Ids are counted first: few are broadcast, many are shuffled."""
    gone = materialise(ids.select("doc_id").where("doc_id is not null").distinct(), "gone", keep=True)
    return docs.join(small(gone), "doc_id", "left_anti")
