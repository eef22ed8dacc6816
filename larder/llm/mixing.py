"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``n`` of the mix holds one block of equally many words. The golden-ratio point ``n * g mod 1``
falls into one source's stretch of the cumulative weights, so every stretch of the schedule, long
or short, holds each source in its share. A slot's rank within its source names a block of that
source, whose documents lie shuffled by a hash, end to end, and are repeated when the target is
above their size.

Ranks and word offsets are counted in parts and summed, so that a source with a third of all rows
is not one task's work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import id_text, stored, text_of, word_count, words_of

GOLDEN = 0.6180339887498949
BLOCK_WORDS = 4096
PARTS = 1024
SLOTS_PER_PART = 1 << 16
# Cells of the unit interval by which points meet the stretches of the sources.
CELLS = 1024


@dataclass(frozen=True)
class Recipe:
    """Sources by code point, NULL last, weigh ``weights`` in turn and share ``ratio`` of all
    words; no source gives more than ``most_repeats`` times its words."""

    weights: tuple[int, ...] = (3, 1, 2)
    ratio: float = 1.5
    most_repeats: int = 2
    block_words: int = BLOCK_WORDS


def source_targets(sizes: DataFrame, recipe: Recipe) -> DataFrame:
    """``(_no, _source, _size, _target, _quota)`` for each source of ``sizes(_source, _size)``.

    With sources in the order of (limit / weight), the share a unit of weight gets if the sources
    before are at their limits rises while they are and falls after; its peak is the final share.
    One row a source: the windows run over sources, not over documents.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in recipe.weights])
    summed = sizes.groupBy("_source").agg(F.sum("_size").alias("_size"))
    named = summed.withColumn("_no", F.row_number().over(order)).withColumn(
        "_weight", F.element_at(weights, ((F.col("_no") - 1) % len(recipe.weights) + 1).cast("int"))
    )
    limit = F.col("_size") * recipe.most_repeats
    rising = Window.orderBy((limit / F.col("_weight")).asc(), F.col("_no").asc())
    everything = Window.partitionBy()
    shares = named.withColumn("_held", F.sum(limit).over(rising) - limit).withColumn(
        "_rest", F.sum("_weight").over(everything) - F.sum("_weight").over(rising) + F.col("_weight")
    )
    shares = shares.withColumn(
        "_level", (F.sum("_size").over(everything) * F.lit(float(recipe.ratio)) - F.col("_held")) / F.col("_rest")
    )
    level = F.greatest(F.max("_level").over(everything), F.lit(0.0))
    target = F.least(limit.cast("double"), level * F.col("_weight"))
    return shares.select("_no", "_source", "_size", target.alias("_target")).withColumn(
        "_quota", F.round("_target").cast("bigint")
    )


def _blocks(quota: Column, recipe: Recipe) -> Column:
    return F.ceil(quota / F.lit(recipe.block_words)).cast("bigint")


def schedule(targets: DataFrame, recipe: Recipe) -> DataFrame:
    """``(_no, _rank, slot)``: the slot of every block that a source gives.

    Slots beyond a source's quota are left out, and blocks that the points did not reach follow
    the last slot, so exactly the quotas are taken. Slots are unique and may have gaps.
    """
    spark = targets.sparkSession
    needed = targets.select("_no", _blocks(F.col("_quota"), recipe).alias("_needed")).where("_needed > 0")
    slots = needed.agg(F.coalesce(F.sum("_needed"), F.lit(0))).first()[0]
    upto = F.sum("_needed").over(Window.orderBy("_no"))
    stretches = needed.select("_no", "_needed", (upto - F.col("_needed")).alias("_first")).select(
        "*", (F.col("_first") / F.lit(float(max(slots, 1)))).alias("_low"),
        ((F.col("_first") + F.col("_needed")) / F.lit(float(max(slots, 1)))).alias("_high"),
    )
    cells = F.sequence(F.floor(F.col("_low") * CELLS), F.floor(F.col("_high") * CELLS))
    by_cell = stretches.select("_no", "_needed", "_low", "_high", F.explode(cells).alias("_cell"))
    point = F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0))
    points = spark.range(slots).select("id", point.alias("_point")).withColumn("_cell", F.floor(F.col("_point") * CELLS))
    drawn = points.join(by_cell, "_cell").where("_point >= _low and _point < _high")
    drawn = drawn.select("_no", "id", F.floor(F.col("id") / SLOTS_PER_PART).alias("_part"))
    counts = drawn.groupBy("_no", "_part").agg(F.count("*").alias("_slots"))
    ahead = Window.partitionBy("_no").orderBy("_part")
    before = counts.select("_no", "_part", (F.sum("_slots").over(ahead) - F.col("_slots")).alias("_before"))
    within = Window.partitionBy("_no", "_part").orderBy("id")
    ranked = drawn.withColumn("_place", F.row_number().over(within)).join(before, ["_no", "_part"])
    ranked = ranked.select("_no", "id", (F.col("_before") + F.col("_place") - 1).alias("_rank"))
    blocks = stretches.select("_no", "_first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_needed") - 1)).alias("_rank"))
    joined = blocks.join(ranked, ["_no", "_rank"], "left")
    return joined.select("_no", "_rank", F.coalesce("id", F.lit(slots) + F.col("_first") + F.col("_rank")).alias("slot"))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, *columns: Column) -> DataFrame:
    """Source, size in words and shuffling key of each row, beside the given columns; written out."""
    return stored(
        docs.select(
            *columns, F.col(source).cast("string").alias("_source"), word_count(text_of(text)).alias("_size"),
            F.md5(id_text(doc_id).cast("binary")).alias("_key"),
        )
    )


def _placed(rows: DataFrame, recipe: Recipe) -> tuple[DataFrame, DataFrame]:
    """Sized rows with their place in their source's run of words, and the targets of the sources."""
    rows = rows.withColumn("_part", F.floor(F.conv(F.substring("_key", 1, 3), 16, 10).cast("int") * PARTS / 4096))
    targets = stored(source_targets(rows.select("_source", "_size"), recipe))
    match = F.col("_source").eqNullSafe(F.col("_named"))
    counts = rows.groupBy("_source", "_part").agg(F.sum("_size").alias("_words"))
    ahead = Window.partitionBy("_source").orderBy("_part")
    before = counts.select(
        F.col("_source").alias("_named"), F.col("_part").alias("_at"),
        (F.sum("_words").over(ahead) - F.col("_words")).alias("_before"),
    )
    within = Window.partitionBy("_source", "_part").orderBy("_key", "_size")
    rows = rows.withColumn("_upto", F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(before, match & (F.col("_part") == F.col("_at"))).drop("_named", "_at")
    sides = targets.select(
        F.col("_source").alias("_named"), "_no", F.col("_size").alias("_source_size"), "_target", "_quota"
    )
    rows = rows.join(sides, match).withColumn("_start", F.col("_before") + F.col("_upto") - F.col("_size"))
    return rows.select("_row", "_no", "_source", "_size", "_source_size", "_target", "_quota", "_start"), targets


def _spans(placed: DataFrame, recipe: Recipe, *columns: str) -> DataFrame:
    """The stretch of each row that each pass over its source takes, in the source's run of words."""
    passes = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(recipe.most_repeats - 1))).alias("epoch"))
    begin = F.col("_start") + F.col("epoch") * F.col("_source_size")
    spans = passes.select(
        *columns, "_no", "_size", "_start", "epoch", begin.alias("_from"),
        F.least(begin + F.col("_size"), F.col("_quota")).alias("_to"),
    )
    return spans.where("_to > _from")


def mix(
    docs: DataFrame, recipe: Recipe = Recipe(), doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """The mix, and each row's share of it.

    The first frame lists the pieces ``(slot, source, block, epoch, doc_id, word_from, word_to)``,
    words counted from 0 within the document; read by slot it is the mixed stream. The second has
    ``(doc_id, size, source_size, target, taken, first_slot)`` for each row of ``docs``, added up from
    the first; ``first_slot`` is the least slot with words of the row, NULL where the mix takes none. Sizes are words; NULL and empty texts have none and are never taken. Rows without an
    id share a hash and keep their own places; repeated rows are mixed each by itself. Without
    any words the mix is empty and targets are 0. Reruns agree.
    """
    placed, targets = _placed(_sized(docs, doc_id, text, source, F.col(doc_id).alias("_row")), recipe)
    placed = stored(placed)
    width = F.lit(recipe.block_words)
    spans = _spans(placed, recipe, "_row", "_source")
    cuts = F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))
    pieces = spans.select("*", F.explode(cuts).alias("_rank"))
    pieces = pieces.select(
        "_row", "_source", "_no", "_start", "epoch", "_rank", "_from",
        F.greatest("_from", F.col("_rank") * width).alias("_a"),
        F.least("_to", (F.col("_rank") + 1) * width).alias("_b"),
    )
    pieces = stored(pieces.join(schedule(targets, recipe), ["_no", "_rank"]))
    taken = pieces.groupBy("_no", "_start").agg(
        F.sum(F.col("_b") - F.col("_a")).alias("_taken"), F.min("slot").alias("first_slot")
    )
    taken = taken.withColumn("_some", F.lit(True))
    shares = placed.withColumn("_some", F.col("_size") > 0).join(taken, ["_no", "_start", "_some"], "left")
    shares = shares.select(
        F.col("_row").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.coalesce("_taken", F.lit(0)).cast("bigint").alias("taken"),
        "first_slot",
    )
    stream = pieces.select(
        "slot", F.col("_source").alias("source"), F.col("_rank").alias("block"), "epoch", F.col("_row").alias("doc_id"),
        (F.col("_a") - F.col("_from")).alias("word_from"), (F.col("_b") - F.col("_from")).alias("word_to"),
    )
    return stream, shares


def mixed_documents(
    docs: DataFrame, recipe: Recipe = Recipe(), doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """``docs`` as the mix takes them, in the order of their slots, with columns as given.

    NULL and empty texts have no words and are not taken; rows without an id and repeated rows are mixed each by
    itself, ties of the shuffling hash by size. No rows give none.

    A document comes once for each pass that takes it. The last document of a source's quota may
    be taken in part: then its text is those words, joined by blanks, and ``n_chars`` their length.
    """
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_held")
    # Rows are numbered as they are written, so that only numbers and sizes go through the plan.
    texts = _sized(docs, doc_id, text, source, F.monotonically_increasing_id().alias("_row"), held)
    placed, targets = _placed(texts.select("_row", "_source", "_size", "_key"), recipe)
    spans = _spans(placed, recipe, "_row").withColumn("_rank", F.floor(F.col("_from") / F.lit(recipe.block_words)))
    spans = spans.join(schedule(targets, recipe), ["_no", "_rank"]).select("_row", "_size", "_from", "_to", "slot")
    spans = spans.join(texts.select("_row", "_held"), "_row")
    whole = F.col("_to") - F.col("_from") == F.col("_size")
    part = F.array_join(F.slice(words_of(F.col("_held")[text]), 1, (F.col("_to") - F.col("_from")).cast("int")), " ")
    taken = F.when(whole, F.col("_held")[text]).otherwise(part)
    columns = []
    for name in docs.columns:
        value = F.col("_held")[name]
        if name == text:
            value = taken
        elif name == "n_chars":
            value = F.when(whole, value).otherwise(F.length(taken).cast(docs.schema[name].dataType))
        columns.append(value.alias(name))
    return spans.repartitionByRange("slot", "_from").sortWithinPartitions("slot", "_from").select(*columns)
