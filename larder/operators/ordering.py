"""Ranks and positions that hold when one group has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import cut_lineage

_PARTITION_BITS = 33
# Longest list that one task orders.
SHORT_LIST = 10000


def ranked(
    df: DataFrame,
    order: Sequence[Column],
    keys: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """1-based row number of each row within ``keys`` by ``order``, without a group-wide task.

    Rows are range-partitioned on (keys, order), so a hot group spreads over many partitions.
    A row's number is its place in its partition plus the rows of the partitions before it,
    less the rows before its group. ``order`` must be total within a group. The sorted frame
    is written once, because both the counts and the rows are read from it.
    """
    by = [F.col(k) for k in keys] + list(order)
    spread = df.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = cut_lineage(spread.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PARTITION_BITS)
    # One row per partition: small by construction, like the window over it.
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = sizes.select(
        "_part",
        (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"),
    )
    numbered = placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(
        "_number",
        F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1)) + 1,
    )
    if not keys:
        return numbered.withColumn(name, F.col("_number")).drop("_at", "_part", "_before", "_number")
    first = numbered.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min("_number").alias("_first")
    )
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        numbered.join(first, match)
        .withColumn(name, F.col("_number") - F.col("_first") + 1)
        .drop("_at", "_part", "_before", "_number", "_first", *[f"_k{i}" for i in range(len(keys))])
    )


def rank_map(scores: DataFrame, score: str = "score", tie: str = "recipe_id") -> DataFrame:
    """Rank by score, best first; equal scores keep their order (a row number, not a rank)."""
    return ranked(scores, [F.desc(score), F.asc(tie)])


def top_ranked(df: DataFrame, order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows with their rank.

    A short list is cut by a distributed top-k, and only it reaches the window. A list too long
    for one task is ranked over all partitions.
    """
    if n > SHORT_LIST:
        return ranked(df, order, name=name).where(F.col(name) <= n)
    top = df.orderBy(*order).limit(n)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def prev_next(members: DataFrame, order: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """Neighbours of each recipe in its list, by joining ranks one apart."""
    placed = ranked(members.select(*keys, "recipe_id", "position"), order, keys)
    near = placed.select(*keys, "rank", "recipe_id")
    back = near.select(*keys, (F.col("rank") + 1).alias("rank"), F.col("recipe_id").alias("previous_id"))
    ahead = near.select(*keys, (F.col("rank") - 1).alias("rank"), F.col("recipe_id").alias("next_id"))
    on = [*keys, "rank"]
    return near.join(back, on, "left").join(ahead, on, "left")


def positions(drafts: DataFrame, existing: DataFrame, order: Sequence[Column], ids: Sequence[str] = ()) -> DataFrame:
    """Continue each cookbook's numbering after the dishes it holds already.

    With ``ids``, columns that identify a draft within its cookbook and of which ``order`` is made, only these are
    ranked; drafts meet their numbers by them.
    """
    held = existing.groupBy("cookbook_id").agg(F.count("*").alias("held"))
    placed = ranked(drafts.select("cookbook_id", *ids) if ids else drafts, order, ["cookbook_id"])
    numbered = placed.join(held, "cookbook_id", "left").withColumn("position", F.coalesce("held", F.lit(0)) + F.col("rank"))
    numbered = numbered.drop("held", "rank")
    return drafts.join(numbered, ["cookbook_id", *ids]) if ids else numbered
