"""Documents to overlapping character windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.functions import text as T


def chunk_pages(pages: DataFrame, max_chars: int = 1200, overlap: int = 200) -> DataFrame:
    """``(document_version_id, ordinal, text, content_hash, token_count, page_number, section_title)``.

    ``pages``: document_version_id, page_number, text. Windows of ``max_chars`` start every ``max_chars - overlap`` characters of the
    normalised page; their number has a closed form, so a page explodes where it lies. Ordinals run from 1 over all pages of a
    version, after blank windows are dropped. One shuffle, by version, of finished chunks.
    """
    if max_chars < 200 or not 0 <= overlap < max_chars:
        raise ValueError("max_chars must be 200 or more and overlap less than it")
    step = max_chars - overlap
    clean = pages.select("document_version_id", "page_number", T.first_heading(F.col("text")).alias("section_title"), T.normalize_text(F.col("text")).alias("page"))
    many = F.when(F.length("page") <= max_chars, 1).otherwise(F.ceil((F.length("page") - max_chars) / step) + 1).cast("int")
    cut = clean.where("page <> ''").select("*", F.explode(F.sequence(F.lit(0), many - 1)).alias("window"))
    chunks = cut.withColumn("text", F.trim(F.substring("page", F.col("window") * step + 1, F.lit(max_chars)))).where("text <> ''").drop("page")
    order = Window.partitionBy("document_version_id").orderBy("page_number", "window")
    return chunks.select("document_version_id", F.row_number().over(order).alias("ordinal"), "text", T.content_hash(F.col("text")).alias("content_hash"), T.token_count(F.col("text")).alias("token_count"), "page_number", "section_title")


def with_neighbours(chunks: DataFrame, before: int = 2, after: int = 2, budget: int = 6000) -> DataFrame:
    """``chunks`` with ``neighbours``: tails of the chunks before and heads of those after, in ``budget`` characters.

    Each side has half of the budget; what one side leaves goes to the other.
    """
    order = Window.partitionBy("document_version_id").orderBy("ordinal")
    joined = lambda low, high: F.array_join(F.collect_list("text").over(order.rowsBetween(low, high)), "\n")
    sides = chunks.withColumn("_a", joined(-before, -1)).withColumn("_b", joined(1, after))
    half = budget // 2
    room_a = F.greatest(F.lit(half), budget - F.length("_b")).cast("int")
    room_b = F.greatest(F.lit(half), budget - F.length("_a")).cast("int")
    return sides.withColumn("neighbours", F.concat_ws("\n", F.nullif(F.right(F.col("_a"), room_a), F.lit("")), F.nullif(F.left(F.col("_b"), room_b), F.lit("")))).drop("_a", "_b")
