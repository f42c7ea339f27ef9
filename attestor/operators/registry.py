"""Document, version and run tables: numbering, readiness, latest flags, upserts, paging, nested reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number_versions(incoming: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``incoming`` (document_id, version_id) with ``version_number``: on from the highest existing number of the document, in order of id."""
    own = F.row_number().over(Window.partitionBy("document_id").orderBy("version_id"))
    if existing is None:
        return incoming.withColumn("version_number", own)
    high = existing.groupBy("document_id").agg(F.max("version_number").alias("_high"))
    return incoming.withColumn("_n", own).join(high, "document_id", "left").withColumn("version_number", F.col("_n") + F.coalesce("_high", F.lit(0))).drop("_n", "_high")


def latest_ready(versions: DataFrame) -> DataFrame:
    """``(document_id, n_versions, n_ready, latest_version, document_status)``: newest ready version, else the newest."""
    ready = F.when(F.col("status") == "ready", F.col("version_number"))
    per = versions.groupBy("document_id").agg(F.count("*").alias("n_versions"), F.count(ready).alias("n_ready"), F.coalesce(F.max(ready), F.max("version_number")).alias("latest_version"), F.max_by("status", "version_number").alias("_newest"))
    status = F.when(F.col("n_ready") > 0, "ready").when(F.col("_newest") == "failed", "failed").otherwise("processing")
    return per.withColumn("document_status", status).drop("_newest")


def current_state(log: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The last row of an append-only log per key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return log.withColumn("_place", place).where("_place = 1").drop("_place")


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Stored points with incoming ones put in by id. The last of several incoming rows with one id is not defined: ids are unique."""
    return stored.join(incoming, key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def promote(versions: DataFrame) -> DataFrame:
    """``is_latest`` from the numbers themselves, so no row is updated when a version is added."""
    high = versions.groupBy("document_id").agg(F.max("version_number").alias("_high"))
    return versions.drop("is_latest").join(high, "document_id").withColumn("is_latest", F.col("version_number") == F.col("_high")).drop("_high")


def page(rows: DataFrame, offset: int, limit: int, newest: str = "created_at", tie: str = "id") -> DataFrame:
    """A page of at most 100 rows, newest first."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100 and offset 0 or more")
    return rows.orderBy(F.col(newest).desc(), F.col(tie)).offset(offset).limit(limit)


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, columns: tuple[str, ...], name: str = "children") -> DataFrame:
    """Parents with an array of their children's ``columns`` in order; none: empty."""
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name))
    kind = grouped.schema[name].dataType.simpleString()
    return parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def same_document_candidates(incoming: DataFrame, documents: DataFrame, newest: int = 250) -> DataFrame:
    """``(upload_id, document_id)`` of the document that an upload is a version of.

    Among the ``newest`` documents: one whose title or file name has the same identity, else the only one of the same family.
    """
    from attestor.functions import text as T

    pool = documents.orderBy(F.col("created_at").desc(), "document_id").limit(newest)
    names = pool.select("document_id", F.explode(F.array_distinct(F.array("title", "filename"))).alias("name")).where("name is not null")
    known = names.select("document_id", T.document_identity(F.col("name")).alias("identity"), T.family_key(F.col("name")).alias("family")).distinct()
    asked = incoming.select("upload_id", T.document_identity(F.col("filename")).alias("identity"), T.family_key(F.col("filename")).alias("family"))
    exact = asked.join(known.select("document_id", "identity"), "identity").groupBy("upload_id").agg(F.min("document_id").alias("document_id"))
    family = asked.where("length(family) >= 4").join(known.select("document_id", "family").distinct(), "family").groupBy("upload_id").agg(F.countDistinct("document_id").alias("n"), F.min("document_id").alias("document_id")).where("n = 1").drop("n")
    return exact.unionByName(family.join(exact, "upload_id", "left_anti"))
