"""Exact substring search over an index of three-character grams.

Every searched field is lowered, ended with two marks and taken apart into the grams that begin at each of its
characters; the index holds each gram with the recipes that have it, in folders by a hash of the gram's first
two characters. A gram is stored as one number, its three code points side by side, so that grams are made a field at
a time and sorted as numbers. A term of three or more characters is in no recipe that lacks one of its grams, so its
recipes are those in all their posting lists, read from a few folders. A shorter term is the beginning of a gram.
Candidates are confirmed on their own fields, so results are those of a scan over all texts, but only the
texts of candidates are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.search import keyword_score, search_fields

MARK = "\x00"
FOLDERS = 64
GRAM = 3
POINT_BITS = 21  # of a code point
# Grams that a task makes before it passes their lists on, about.
BATCH_GRAMS = 500_000


def grams_of(fields: Iterable[str | None]) -> np.ndarray:
    """Distinct grams that begin at each character of the fields, as numbers."""
    found = [np.empty(0, np.int64)]
    for field in fields:
        if field:
            points = np.frombuffer((field + MARK * (GRAM - 1)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            found.append(points[:-2] << 2 * POINT_BITS | points[1:-1] << POINT_BITS | points[2:])
    return np.unique(np.concatenate(found))


def _gram_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each gram of some dishes, with those that have it."""

    def lists(owners: list[int | None], made: list[np.ndarray]) -> pa.RecordBatch:
        grams = np.concatenate(made)
        order = np.argsort(grams, kind="stable")
        grams, held = grams[order], np.repeat(np.arange(len(owners)), list(map(len, made)))[order]
        first = np.flatnonzero(np.diff(grams, prepend=-1))
        ends = pa.array(np.append(first, len(grams)).astype(np.int32))
        ids = pa.array(owners, pa.int64()).take(pa.array(held))
        return pa.RecordBatch.from_arrays([pa.array(grams[first]), pa.ListArray.from_arrays(ends, ids)], names=["gram", "recipe_ids"])

    owners, made, size = [], [], 0
    for batch in batches:
        for owner, fields in zip(batch.column("recipe_id"), batch.column("fields"), strict=True):
            owners.append(owner.as_py())
            made.append(grams_of(fields.as_py()))
            size += len(made[-1])
            if size >= BATCH_GRAMS:
                yield lists(owners, made)
                owners, made, size = [], [], 0
    if owners:
        yield lists(owners, made)


def folder_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(F.shiftright(gram, POINT_BITS)), F.lit(FOLDERS)).cast("int")


def build_postings(dishes: DataFrame, path: str) -> None:
    """Write the index of ``dishes``: ``(gram, recipe_ids)`` in folders, sorted by gram, so files know their range.

    A gram has a list for each few dishes that a task took together, so no list grows with the input.
    """
    fields = dishes.select(F.col("recipe_id").cast("bigint").alias("recipe_id"), F.array(*search_fields().values()).alias("fields"))
    rows = fields.mapInArrow(_gram_lists, "gram bigint, recipe_ids array<bigint>").withColumn("folder", folder_of(F.col("gram")))
    # A frequent gram is in the lists of all tasks: they are dealt by a recipe as well.
    spread = F.pmod(F.xxhash64(F.get("recipe_ids", F.lit(0))), F.lit(8))
    rows.repartition("folder", spread).sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(path)


def gram_number(gram: str) -> int:
    """The number of three characters; of fewer, the least number that begins with them."""
    return sum(ord(c) << POINT_BITS * (GRAM - 1 - i) for i, c in enumerate(gram))


def term_grams(term: str) -> list[int]:
    return list(dict.fromkeys(gram_number(term[i : i + GRAM]) for i in range(len(term) - GRAM + 1)))


def _folders(spark: SparkSession, grams: Sequence[int]) -> list[int]:
    """Folders of grams of a query, whose number is that of its characters."""
    rows = spark.createDataFrame([(g,) for g in grams], "gram bigint").select(folder_of(F.col("gram"))).distinct()
    return sorted(r[0] for r in rows.collect())


def candidates(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame:
    """``recipe_id`` of the recipes that may hold any of ``terms``."""
    postings = spark.read.schema("gram bigint, recipe_ids array<bigint>, folder int").parquet(path)
    recipe = F.explode("recipe_ids").alias("recipe_id")
    found = spark.createDataFrame([], "recipe_id bigint")
    for term in dict.fromkeys(terms):
        if len(term) < GRAM:
            # With two characters the folder is known; one character may begin grams in any.
            least = gram_number(term)
            part = postings.where(F.col("gram").between(least, least + (1 << POINT_BITS * (GRAM - len(term))) - 1))
            if len(term) == GRAM - 1:
                part = part.where(F.col("folder").isin(_folders(spark, [least])))
            hits = part.select(recipe).distinct()
        else:
            grams = term_grams(term)
            lists = postings.where(F.col("gram").isin(grams) & F.col("folder").isin(_folders(spark, grams)))
            hits = lists.select(recipe).groupBy("recipe_id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("recipe_id")
        found = found.union(hits)
    return found.distinct()


def indexed_keyword_score(dishes: DataFrame, path: str, terms: Sequence[str]) -> DataFrame:
    """``keyword_score`` over the candidates that the index names; no terms give no rows."""
    named = candidates(dishes.sparkSession, path, terms)
    return keyword_score(dishes.join(named, "recipe_id", "left_semi"), terms)
