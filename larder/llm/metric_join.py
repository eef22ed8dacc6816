"""Near-duplicate vectors by an exact range join in metric space.

Cosine 0.98 or more is an angle of at most ``acos(0.98)`` between directions, and angles obey the
triangle inequality. Pivots, a bounded sample of directions, part the space: a vector is at home in
the cell of its nearest pivot. A vector whose angle to the border between its home and another cell
is within the range may have partners there, so it is a guest in that cell too; for each pair of cells
the higher one sends guests to the lower, hence a pair meets once. Cells (label, pivot) join
independently, large ones in blocks of bounded size.

Equal vectors of a label are one node with a count. A block reports each node's number of partners
and one link for each node to the least of its group in the block, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import number_array, stored
from larder.llm.components import components

COSINE = 0.98
# A cell is meant to be the home of so many nodes of the largest label. Pivots are broadcast: they are
# 1,024 at most, drawn from a sample of twice as many.
CELL_NODES = 500
MOST_PIVOTS = 1024
# Pivots closer than this cosine would part a group of near copies; the later one is left out.
APART = 0.9
# Nodes of each side of a block.
BLOCK_NODES = 1500
# Rounding of unit vectors moves an angle's sine by far less.
SLACK = 1e-9


def directions(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaling by the largest component first keeps squares from running over."""
    vectors = vectors.astype(np.float64)
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=0.0)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def spread_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """The first of ``sample`` and each further one that is not near one already taken."""
    taken: list[np.ndarray] = []
    for vector in sample:
        if len(taken) == most:
            break
        if not taken or float((np.array(taken) @ vector).max()) < APART:
            taken.append(vector)
    return np.array(taken).reshape(len(taken), sample.shape[1])


def cells_of(units: np.ndarray, pivots: np.ndarray, sine: float) -> tuple[np.ndarray, np.ndarray]:
    """``home`` of each vector, and a matrix of the lower cells that it may have partners in.

    With ``u`` the direction from another pivot to the home pivot, ``units @ u`` is the sine of the angle
    to the border; a partner beyond the border is at least that angle away.
    """
    near = units @ pivots.T
    home = near.argmax(axis=1)
    between = pivots @ pivots.T
    lengths = np.sqrt(np.maximum(2.0 - 2.0 * between, 0.0))[home]
    ahead = near[np.arange(len(units)), home][:, None] - near
    guests = (ahead <= lengths * (sine + SLACK) + SLACK) & (np.arange(len(pivots)) < home[:, None])
    return home, guests


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


_USED = "row bigint, length int, print_a bigint, print_b bigint"


def _prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit print of each vector that can be linked; -0.0 prints as 0.0."""
    for batch in batches:
        prints, rows, lengths = [], [], []
        column = batch.column("vector")
        flat = column.flatten().to_numpy(zero_copy_only=False) + 0.0
        ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        for row, begin, end in zip(batch.column("row").to_pylist(), ends[:-1], ends[1:], strict=True):
            vector = flat[begin:end]
            if np.isfinite(vector).all() and vector.any():
                prints.append(xxhash.xxh3_128_digest(vector.tobytes()))
                rows.append(row)
                lengths.append(end - begin)
        pair = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(lengths, pa.int32()), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
            names=["row", "length", "print_a", "print_b"],
        )


def _joined(block: pa.Table) -> pa.Table:
    """Partners of each node of a block, and a link to the least node of its group where it has any."""
    names = ["node", "partners", "other"]
    second = block.column("second").to_numpy(zero_copy_only=False)
    node, weight = block.column("node").to_numpy(), block.column("weight").to_numpy()
    units = directions(_matrix(block.column("vector").combine_chunks()))
    left, right = np.flatnonzero(~second), np.flatnonzero(second)
    alone = bool(block.column("same")[0].as_py())
    if alone:
        right = left
    if not len(left) or not len(right):
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    alike = units[left] @ units[right].T >= block.column("cosine")[0].as_py()
    if alone:
        np.fill_diagonal(alike, False)
    rows, columns = np.flatnonzero(alike.any(axis=1)), np.flatnonzero(alike.any(axis=0))
    alike = alike[np.ix_(rows, columns)]
    left, right = left[rows], right[columns]
    found = {
        "node": node[left] if alone else np.concatenate([node[left], node[right]]),
        "partners": alike @ weight[right] if alone else np.concatenate([alike @ weight[right], weight[left] @ alike]),
    }
    # Least label on either side, over and over until nothing changes.
    low, high = node[left].copy(), node[right].copy()
    top = np.iinfo(np.int64).max
    while len(left):
        lowered = np.minimum(low, np.where(alike, high[None, :], top).min(axis=1))
        raised = np.minimum(high, np.where(alike, lowered[:, None], top).min(axis=0))
        if (lowered == low).all() and (raised == high).all():
            break
        low, high = lowered, raised
    found["other"] = np.minimum(low, high) if alone else np.concatenate([low, high])
    return pa.table({n: pa.array(found[n], pa.int64()) for n in names})


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for each row of ``vectors``.

    Rows of one label are linked when the cosine of their vectors is ``cosine`` (above 0) or more.
    Rows whose label is NULL or whose vector is NULL, empty, zero or holds NULL or non-finite components are
    linked with nothing, and so are vectors of different lengths. ``n_links`` counts the other rows that a row
    is linked with; a repeated row is one of them. ``component_id`` is the least id that links lead to; a NULL id is none, and a
    row without one that leads to none has NULL. Rows without an id are kept, all others when their id is
    ``component_id``. Other columns are not read; no rows give none.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    spark = vectors.sparkSession
    kind = number_array(vectors, embedding)
    taken = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast(kind).alias("vector")
    )
    rows = stored(taken.withColumn("row", F.monotonically_increasing_id()))
    usable = rows.where(
        F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    )
    prints = stored(usable.select("row", "vector").mapInArrow(_prints, _USED))
    same = ["label", "length", "print_a", "print_b"]
    placed = stored(rows.select("row", "vec_id", "label").join(prints, "row", "left"))
    # A node is known by one of its rows.
    nodes = stored(
        placed.where("print_a is not null").groupBy(*same)
        .agg(F.min("row").alias("node"), F.count("*").alias("weight"), F.min("vec_id").alias("_least"))
    )
    links = stored(_links(spark, rows, nodes, cosine))
    partners = links.groupBy("node").agg(F.sum("partners").alias("partners"))
    labels = components(links.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.join(partners, "node", "left").join(
        labels.select("node", F.col("label").alias("group")), "node", "left"
    ).withColumn("group", F.coalesce("group", "node"))
    known = stored(known)
    least = known.groupBy("group").agg(F.min("_least").alias("component_id"))
    known = known.join(least, "group").select(
        *same, (F.coalesce("partners", F.lit(0)) + F.col("weight") - 1).cast("bigint").alias("n_links"), "component_id"
    )
    told = placed.join(known, same, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("print_a").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return told.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(spark, rows: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """``(node, partners, other)``: partners met in a block, and a node of the same group."""
    kept = stored(nodes.select("node", "label", "length", "weight").join(
        rows.select(F.col("row").alias("node"), "vector"), "node"
    ))
    lengths = [r.length for r in kept.select("length").distinct().limit(2).collect()]
    if not lengths:
        return spark.createDataFrame([], "node bigint, partners bigint, other bigint")
    largest = kept.groupBy("label", "length").count().agg(F.max("count")).first()[0]
    wanted = min(MOST_PIVOTS, -(-largest // CELL_NODES))
    # Vectors of another length than the pivots' are all at home in one cell of their own.
    base = kept.agg(F.max("length")).first()[0]
    sample = kept.where(F.col("length") == base).orderBy(F.xxhash64("node"), "node").limit(2 * wanted)
    pivots = spread_pivots(directions(np.array([r.vector for r in sample.collect()])), wanted)
    sine = math.sqrt(1.0 - cosine * cosine)

    def celled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                node = part.column("node").to_numpy()
                fits = part.column("length").to_numpy() == base
                where = np.flatnonzero(fits)
                found = _matrix(part.filter(pa.array(fits)).column("vector")).reshape(len(where), base)
                units = directions(found)
                home, guests = cells_of(units, pivots, sine)
                at_home = np.zeros(len(node), np.int64)
                at_home[where] = home
                vector, cell = np.nonzero(guests)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([node, node[where][vector]])),
                        pa.array(np.concatenate([at_home, cell]).astype(np.int32)),
                        pa.array(np.arange(len(node) + len(cell)) >= len(node)),
                    ],
                    names=["node", "cell", "guest"],
                )

    cells = kept.select("node", "length", "vector").mapInArrow(celled, "node bigint, cell int, guest boolean")
    cells = stored(cells.join(kept.select("node", "label", "length"), "node"))
    key = ["label", "length", "cell"]
    sizes = cells.groupBy(*key).agg(
        F.ceil(F.count_if(~F.col("guest")) / BLOCK_NODES).alias("_homes"),
        F.ceil(F.count_if("guest") / BLOCK_NODES).alias("_guests"),
    )
    # Sides of a cell: parts of its homes, then parts of its guests. A block is two parts of homes, one
    # part of them with itself, or a part of homes with one of guests.
    side = F.when(~F.col("guest"), F.pmod(F.xxhash64("node"), F.col("_homes"))).otherwise(
        F.col("_homes") + F.pmod(F.xxhash64("node"), F.col("_guests"))
    )
    sides = cells.join(sizes.where("_homes > 0"), key).withColumn("_side", side)
    met = F.when(F.col("guest"), F.sequence(F.lit(0).cast("bigint"), F.col("_homes") - 1)).otherwise(
        F.sequence(F.lit(0).cast("bigint"), F.col("_homes") + F.col("_guests") - 1)
    )
    blocks = sides.select(*key, "node", "_side", F.explode(met).alias("_other")).select(
        *key, "node", F.least("_side", "_other").alias("_i"), F.greatest("_side", "_other").alias("_j"),
        (F.col("_side") > F.col("_other")).alias("second"), (F.col("_side") == F.col("_other")).alias("same"),
    )
    full = blocks.join(kept.select("node", "weight", "vector"), "node").withColumn("cosine", F.lit(float(cosine)))
    return full.groupBy(*key, "_i", "_j").applyInArrow(_joined, "node bigint, partners bigint, other bigint")
