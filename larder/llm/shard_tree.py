"""Sharding by a hierarchical weighted hash tree.

A key descends from regions to racks to shards. At every level each child draws -ln(u) / weight
from a hash of the key and the child's name, and the least draw wins. A draw depends on the child
alone, so a change of one weight moves keys only into or out of that child, and only the subtrees
whose weights changed are touched. A shard added in a region of its own takes keys only into
itself. Built-in expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import bind
from larder.llm.common import id_text, md5_fraction, stored, text_of

# Parts in which the rows of a shard are numbered; each is sorted by itself.
PARTS = 1024


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def regular_tree(shards: int, shards_per_rack: int = 4, racks_per_region: int = 2) -> list[Leaf]:
    per_region = shards_per_rack * racks_per_region
    return [Leaf(s // per_region, s // shards_per_rack, s) for s in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a rack and a region of its own."""
    return [
        *tree,
        Leaf(1 + max(x.region for x in tree), 1 + max(x.rack for x in tree), 1 + max(x.shard for x in tree), weight),
    ]


def _children(tree: list[Leaf]) -> dict[str, dict[str, float]]:
    """Names and weights below each node; a name is the path to it."""
    found: dict[str, dict[str, float]] = {}
    for leaf in tree:
        path = ["", f"/{leaf.region}", f"/{leaf.region}/{leaf.rack}", f"/{leaf.region}/{leaf.rack}/{leaf.shard}"]
        for above, below in zip(path, path[1:], strict=False):
            weights = found.setdefault(above, {})
            weights[below] = weights.get(below, 0.0) + leaf.weight
    return found


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key (text); a tree is one literal, however many keys there are."""
    entries = []
    for node, below in _children(tree).items():
        kids = [F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight")) for name, weight in below.items()]
        entries += [F.lit(node), F.array(*kids)]
    table = F.create_map(*entries)

    def chosen(node: Column) -> Column:
        draws = F.transform(
            F.element_at(table, node),
            lambda child: F.struct(
                (-F.ln(md5_fraction(F.concat(key, child["name"]))) / child["weight"]).alias("draw"),
                child["name"].alias("name"),
            ),
        )
        return F.array_min(draws)["name"]

    leaf = bind(bind(bind(F.lit(""), chosen), chosen), chosen)
    return F.element_at(F.split(leaf, "/"), -1).cast("int")


def assign_shards(
    docs: DataFrame, tree: list[Leaf], grown_tree: list[Leaf] | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, a row for each row of ``docs``.

    ``size`` is the UTF-8 bytes of the text plus 1; a NULL text has none and the checksum 0.
    ``slot`` numbers a shard's rows from 0 without gaps, in the order of a hash part and the id.
    Rows without an id share one key. Repeated rows take slots of their own. ``grown_shard`` is
    the shard under ``grown_tree``, NULL without one. Other columns are ignored.
    """
    key = id_text(doc_id)
    raw = text_of(text).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        shard_of(key, tree).alias("shard"),
        (shard_of(key, grown_tree) if grown_tree else F.lit(None).cast("int")).alias("grown_shard"),
        F.floor(md5_fraction(F.concat(key, F.lit("#"))) * PARTS).cast("int").alias("_part"),
    )
    rows = stored(rows)
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_rows"))
    ahead = Window.partitionBy("shard").orderBy("_part")
    before = counts.select("shard", "_part", (F.sum("_rows").over(ahead) - F.col("_rows")).alias("_before"))
    within = Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("_place", F.row_number().over(within)).join(before, ["shard", "_part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_before") + F.col("_place") - 1).alias("slot"), "grown_shard",
    )
