"""Text blocks of PDF pages: normalised, ordered, and grouped into page sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.text import excerpt, squash, strip, text_lines


def pdf_blocks(raw_blocks: DataFrame) -> DataFrame:
    """Blocks with squashed text, empty ones dropped.

    Readers order them by (page, y0, x0); each template does so inside one file.
    """
    return raw_blocks.withColumn("text", squash(F.col("text"))).where(F.col("text") != "")


def pdf_page_sections(pages: DataFrame) -> DataFrame:
    """A section per non-empty page ``(file_id, page, text)``, titled by its first line."""
    lines = text_lines(F.col("text"))
    kept = pages.withColumn("text", strip(F.col("text"))).where(F.col("text") != "")
    key = F.concat(F.lit("page-"), F.col("page").cast("string"))
    return kept.select(
        "file_id",
        "page",
        key.alias("section_key"),
        key.alias("anchor"),
        F.coalesce(
            F.substring(F.get(lines, F.lit(0)), 1, 120), F.concat(F.lit("Page "), F.col("page").cast("string"))
        ).alias("chapter_title"),
        "text",
        excerpt(lines).alias("excerpt"),
        F.col("page").alias("page_start"),
        F.col("page").alias("page_end"),
    )


def page_range_text(pages: DataFrame, dishes: DataFrame) -> DataFrame:
    """Raw text of each recipe's page range, pages in order with a blank line between.

    A missing start is page 1; a missing end is the start, and without both the whole file. The
    join is on the file; a recipe's own pages are what its row holds.
    """
    body = pages.select(
        "file_id", "page", F.array_join(text_lines(F.col("text")), "\n").alias("body")
    ).where(F.col("body") != "")
    last = F.coalesce("page_end", "page_start", F.lit(2147483647))
    first = F.greatest(F.coalesce("page_start", F.lit(1)), F.lit(1))
    hits = dishes.join(body, "file_id").where((F.col("page") >= first) & (F.col("page") <= last))
    return hits.groupBy("recipe_id").agg(
        F.array_sort(F.collect_list(F.struct("page", "body"))).alias("found")
    ).select("recipe_id", F.array_join(F.transform("found", lambda p: p["body"]), "\n\n").alias("text"))
