"""Near-duplicate groups by min-max hashing.

One pass hashes each text's distinct five-word shingles under ``PERMUTATIONS`` permutations and
keeps the least *and* the greatest value of each, so a permutation gives two signature values for
one evaluation. Bands are made of minima of different permutations, or of maxima, so that values
of one band stay independent. Every value also leaves one bit; the bits bound a pair's likeness
before full sets are moved.

Equal shingle sets become one node first. In a bucket no pairs are listed: all nodes meet one hub,
links are confirmed on full sets, components are formed, and only buckets that still hold more
than one component go on, with another hub, as long as a round settles nine tenths. What is left is compared
across components so that no link between different texts is lost: pairs of small groups after a
look at sizes and signature bits, large groups (a shared passage, copies just below the threshold)
in blocks of bounded size, each of which reports only the links that its own components need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import WORD, hashed_words, lists, lower_words, mixed, slices, stored
from larder.llm.components import components

SHINGLE = 5
PERMUTATIONS = 125
ROWS = 5  # a pair at 0.75 meets in none of the 50 bands once in 760,000, one at 0.8 once in 400 million
SAME_PERCENT = 75
# Of 250 signature bits a pair at 0.75 differs in 31 on average, standard deviation 5.2; 68 is seven
# deviations off. Pairs beyond it are not compared on full sets.
MOST_BITS_APART = 68
# Above so many pairs across components for each row left, hubs come first.
PAIRS_PER_ROW = 4
# Groups of more nodes that share a hub are compared in blocks of two parts of so many nodes each, or
# fewer where their sets would hold more shingles than that.
SMALL_GROUP = 32
BLOCK_NODES = 400
BLOCK_SHINGLES = 1_000_000
# Ways in which the rows of one hub are dealt where they meet what is known of it.
HUB_SALTS = 32

_random = np.random.default_rng(20240607)
_FACTORS = (_random.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_MASKS = _random.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_WORD_FACTORS = _random.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_BAND_FACTORS = _random.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND_SALTS = _random.integers(0, 1 << 63, 2 * PERMUTATIONS // ROWS, dtype=np.uint64)
# Orders in which a bucket's hub is the first node, one for each round.
_HUB_ORDERS = [0, -1, 0x5DEECE66D1CE4E5B, -0x2545F4914F6CDD1D, 0x369DEA0F31A53F85, -0x27BB2EE687B0B0FD]
_BLOCK = 4096


def shingle_set(text: str | None, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a text of fewer words is one shingle."""
    tokens = lower_words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    width = min(SHINGLE, len(tokens))
    sums = np.full(len(tokens) - width + 1, width, np.uint64)
    for i in range(width):
        sums += hashes[i : len(tokens) - width + 1 + i] * _WORD_FACTORS[i]
    return np.unique(mixed(sums))


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of the shingles under each permutation."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), _BLOCK):
        values = (short[None, at : at + _BLOCK] ^ _MASKS[:, None]) * _FACTORS[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    rows = np.concatenate([low, high]).reshape(-1, ROWS).astype(np.uint64)
    return mixed((rows * _BAND_FACTORS).sum(axis=1, dtype=np.uint64) + _BAND_SALTS).view(np.int64)


def signature_bits(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    bits = (np.concatenate([low, high]) * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(np.pad(bits.astype(np.uint8), (0, 256 - len(bits)))).view(np.int64)


_SKETCH = "doc_id bigint, text_hash bigint, n_shingles bigint, print_a bigint, print_b bigint, bands array<bigint>, bits array<bigint>"


def _sketches(batches):
    memo = hashed_words()
    for batch in slices(batches, "text"):
        sizes, prints, bands, bits = [], [], [], []
        for text in batch.column("text").to_pylist():
            shingles = shingle_set(text, memo)
            sizes.append(len(shingles))
            if not len(shingles):
                prints.append((0, 0))
                bands.append(np.empty(0, np.int64))
                bits.append(np.empty(0, np.int64))
                continue
            again = mixed(shingles + np.uint64(0x9E3779B97F4A7C15))
            prints.append((np.bitwise_xor.reduce(again).view(np.int64), again.sum(dtype=np.uint64).view(np.int64)))
            low, high = signature(shingles)
            bands.append(band_keys(low, high))
            bits.append(signature_bits(low, high))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array(sizes, pa.int64()),
                pa.array([p[0] for p in prints], pa.int64()),
                pa.array([p[1] for p in prints], pa.int64()),
                lists(bands, pa.int64()),
                lists(bits, pa.int64()),
            ],
            names=["doc_id", "text_hash", "n_shingles", "print_a", "print_b", "bands", "bits"],
        )


def _sets(batches):
    memo = hashed_words()
    for batch in slices(batches, "text"):
        sets = [shingle_set(text, memo).view(np.int64) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(sets, pa.int64())], names=["node", "shingles"])


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    text = F.col(text).cast("string")
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")
    )


def _alike(inner: Column, left: Column, right: Column) -> Column:
    return inner * 100 >= (left + right - inner) * SAME_PERCENT


def _near(a: str, b: str) -> Column:
    """What a pair at the threshold fulfils by its sizes and, but for chance, by its bits."""
    apart = sum(
        (F.bit_count(F.get(f"{a}_bits", F.lit(i)).bitwiseXOR(F.get(f"{b}_bits", F.lit(i)))) for i in range(4)), F.lit(0)
    )
    smaller, larger = F.least(f"{a}_n", f"{b}_n"), F.greatest(f"{a}_n", f"{b}_n")
    return (smaller * 100 >= larger * SAME_PERCENT) & (apart <= MOST_BITS_APART)


def _named(df: DataFrame, side: str, *columns: str) -> DataFrame:
    return df.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are alike."""
    full = pairs.join(_named(sets, "a", "shingles"), "a").join(_named(sets, "b", "shingles"), "b")
    inner = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return stored(full.where(_alike(inner, F.size("a_shingles"), F.size("b_shingles"))).select("a", "b"))


def _lone_links(spark) -> DataFrame:
    return spark.createDataFrame([], "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each row of ``docs``.

    Rows are linked when 100 * intersection >= 75 * union of their shingle sets. NULL and empty
    texts have no shingles, are linked with nothing and are kept. A row repeated whole gives equal
    rows; each text is judged by itself where an id has several. A row without an id is linked with
    nothing, has a NULL component and is kept. Other columns of ``docs`` are not read.
    """
    return _classed(_narrow(docs, doc_id, text)).select("doc_id", "n_shingles", "component_id", "kept")


def _classed(rows: DataFrame) -> DataFrame:
    """The result of ``near_duplicates`` with the hash of each row's text."""
    sketches = stored(rows.mapInArrow(_sketches, _SKETCH))
    usable = sketches.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    prints = ["print_a", "print_b", "n_shingles"]
    nodes = usable.groupBy(*prints).agg(F.min("doc_id").alias("node"))
    labels = _labels(rows, usable, stored(nodes))
    placed = sketches.select("doc_id", "text_hash", *prints).join(nodes, prints, "left").join(labels, "node", "left")
    component = F.when(
        F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("label", "node")
    ).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _labels(rows: DataFrame, usable: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, label)`` of the nodes that have a link."""
    first = usable.join(
        nodes.select(*[F.col(c) for c in ("print_a", "print_b", "n_shingles")], F.col("node").alias("doc_id")),
        ["print_a", "print_b", "n_shingles", "doc_id"],
    ).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bands", "bits")
    banded = first.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("_low"), F.max("node").alias("_high"))
    shared = shared.where("_low <> _high").select("key")
    buckets = stored(banded.join(shared, "key"))
    members = stored(buckets.select("node").distinct())
    marks = stored(first.join(members, "node").select("node", "n", "bits"))
    wanted = members.select(F.col("node").alias("doc_id"))
    sets = stored(rows.join(wanted, "doc_id").mapInArrow(_sets, "node bigint, shingles array<bigint>"))

    tested = links = _lone_links(rows.sparkSession)
    labels = None
    left, pairs_left, rows_left = _open_buckets(buckets.withColumn("label", F.col("node")), _HUB_ORDERS[0])
    for order in _HUB_ORDERS[1:]:
        if pairs_left <= PAIRS_PER_ROW * rows_left:
            break
        hubs = left.where("node = hub").select("key", F.col("label").alias("_hub_label"))
        pairs = left.join(hubs, "key").where("label <> _hub_label")
        pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        pairs = pairs.join(_named(marks, "a", "n", "bits"), "a").join(_named(marks, "b", "n", "bits"), "b")
        pairs = stored(pairs.where(_near("a", "b")).select("a", "b").join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(pairs)
        found = _confirmed(pairs, sets)
        if not found.limit(1).count():
            break
        links = links.union(found)
        labels = components(links)
        held = pairs_left
        left, pairs_left, rows_left = _open_buckets(_relabelled(left, labels), order)
        if pairs_left * 10 > held:
            break
    if not rows_left:
        return labels if labels is not None else _no_labels(rows.sparkSession)
    # Links between components that are still apart.
    grouped = stored(left.select("hub", "node", "label").distinct())
    sizes = grouped.join(marks.select("node", "n"), "node").groupBy("hub").agg(
        F.count("*").alias("_size"), F.sum("n").alias("_shingles")
    )
    sizes = stored(sizes.where(F.col("_size") > SMALL_GROUP)).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(HUB_SALTS - 1).cast("bigint")))
    )
    salt = F.pmod(F.xxhash64("node"), F.lit(HUB_SALTS).cast("bigint"))
    small = left.withColumn("_salt", salt).join(sizes.select("hub", "_salt"), ["hub", "_salt"], "left_anti")
    marked = small.select("key", "node", "label").join(marks, "node")
    one, two = (_named(stored(marked), x, "key", "label", "n", "bits") for x in "ab")
    apart = (F.col("a_key") == F.col("b_key")) & (F.col("a") < F.col("b")) & (F.col("a_label") != F.col("b_label"))
    pairs = one.join(two, apart & _near("a", "b")).select("a", "b").distinct()
    found = _confirmed(stored(pairs.join(tested, ["a", "b"], "left_anti")), sets)
    found = stored(found.union(_block_links(grouped.withColumn("_salt", salt).join(sizes, ["hub", "_salt"]), sets)))
    if found.limit(1).count():
        return components(links.union(found))
    return labels if labels is not None else _no_labels(rows.sparkSession)


def _block_links(grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across labels among the nodes of each hub, enough to connect what is connected.

    A hub's nodes are dealt to parts of about ``BLOCK_NODES`` nodes and ``BLOCK_SHINGLES`` shingles, whichever is
    less; a block holds two parts, or one with itself, so a group of any size is spread over blocks of bounded size.
    """
    parts = F.ceil(F.greatest(F.col("_size") / BLOCK_NODES, F.col("_shingles") / BLOCK_SHINGLES))
    dealt = grouped.withColumn("_parts", parts).withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_parts")))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_other")
    spread = dealt.select("hub", "node", "label", "_part", others)
    blocks = spread.select(
        "hub", "node", "label", F.least("_part", "_other").alias("_i"), F.greatest("_part", "_other").alias("_j"),
        (F.col("_part") > F.col("_other")).alias("second"),
    )
    full = blocks.join(sets, "node")
    return full.groupBy("hub", "_i", "_j").applyInArrow(_linked, "a bigint, b bigint")


def _linked(block: pa.Table) -> pa.Table:
    """The links between differently labelled nodes of a block that join its components."""
    node, label = (block.column(name).to_numpy() for name in ("node", "label"))
    second, column = block.column("second").to_numpy(zero_copy_only=False), block.column("shingles").combine_chunks()
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy()[ends[0] : ends[-1]]
    ends = ends - ends[0]
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(len(node)), sizes)
    order = np.argsort(flat, kind="stable")
    token = np.cumsum(np.concatenate([[0], flat[order][1:] != flat[order][:-1]])) if len(flat) else order
    of = np.empty(len(flat), np.int64)
    of[order] = token
    holders, starts = owner[order], np.searchsorted(token, np.arange((token[-1] if len(token) else -1) + 2))
    both = len(np.unique(second)) == 2
    group = {x: x for x in label.tolist()}

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    found = []
    for x in range(len(node)):
        if both and second[x]:
            continue
        own = of[ends[x] : ends[x + 1]]
        common = np.bincount(np.concatenate([holders[starts[t] : starts[t + 1]] for t in own]), minlength=len(node))
        alike = common * 100 >= (sizes + sizes[x] - common) * SAME_PERCENT
        alike &= second if both else np.arange(len(node)) > x
        for y in np.flatnonzero(alike & (label != label[x])):
            left, right = root(int(label[x])), root(int(label[y]))
            if left != right:
                group[left] = right
                found.append((min(node[x], node[y]), max(node[x], node[y])))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def _no_labels(spark) -> DataFrame:
    return spark.createDataFrame([], "node bigint, label bigint")


def _relabelled(left: DataFrame, labels: DataFrame) -> DataFrame:
    return left.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))


def _open_buckets(placed: DataFrame, order: int) -> tuple[DataFrame, float, int]:
    """Rows ``(key, node, label, hub)`` of the buckets of ``placed`` that hold more than one
    component; the number of pairs across components in them, and of rows."""
    placed = stored(placed)
    torn = placed.groupBy("key").agg(
        F.min("label").alias("_low"), F.max("label").alias("_high"),
        F.min(F.col("node").bitwiseXOR(F.lit(order))).alias("_first"),
    )
    torn = torn.where("_low <> _high").select("key", F.col("_first").bitwiseXOR(F.lit(order)).alias("hub"))
    left = stored(placed.join(torn, "key").select("key", "node", "label", "hub"))
    across = left.groupBy("key", "label").count().groupBy("key").agg(
        F.sum("count").alias("_m"), F.sum(F.col("count") * F.col("count")).alias("_same")
    )
    pairs, rows = across.agg(
        F.coalesce(F.sum((F.col("_m") * F.col("_m") - F.col("_same")) / 2), F.lit(0.0)), F.coalesce(F.sum("_m"), F.lit(0))
    ).first()
    return left, pairs, rows


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, one that has the group's least id.

    Each text is judged by itself where an id has several, and equal rows are copies. Rows without an id or
    without words are near duplicates of nothing and all stay. Columns are as given; no rows give none.
    """
    classes = _classed(_narrow(docs, doc_id, text)).where("kept and doc_id is not null and n_shingles > 0")
    # A group may hold several texts of its least id; the one of least hash stays.
    chosen = classes.groupBy("component_id").agg(F.min("text_hash").alias("__kept_text"))
    chosen = chosen.select(F.col("component_id").alias("__kept_id"), "__kept_text")
    alone = F.col(doc_id).cast("bigint").isNull() | ~F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(WORD)
    keys = {"__kept_id": F.col(doc_id).cast("bigint"), "__kept_text": F.xxhash64(F.col(text).cast("string"))}
    kept = docs.where(~alone).withColumns(keys).join(chosen, ["__kept_id", "__kept_text"], "left_semi").dropDuplicates(["__kept_id", "__kept_text"])
    return kept.select(*docs.columns).unionByName(docs.where(alone))
