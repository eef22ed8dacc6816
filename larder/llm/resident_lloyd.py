"""Short codes for vectors: Lloyd's rounds over members that stay with their owners.

A vector is cut into equal parts; each position has a codebook of its own. A part is a member of the
entry it is assigned to, and rows are dealt once to owners by (position, entry, salt) and written.
In a round every owner sums its resident members, the sums of a codebook (at most positions x
entries rows) give its new entries, and the members are assigned again where they are. Only those
whose entry changes are shuffled, to the owners of their new entries; all others stay in their place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import number_array, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# Integer components beyond this (vector components beyond 262,144) are taken as this, so that sums
# and squares of 64-bit integers hold them.
MOST = 1 << 26
# Members of one position that an owner is meant to hold; a hot entry has as many owners as it needs.
OWNED = 1_000_000


def whole_vector(name: str) -> Column:
    """That a vector is there, is not empty and has neither NULL nor non-finite components."""
    wrong = F.exists(
        F.col(name), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return F.col(name).isNotNull() & (F.size(name) > 0) & ~wrong


def integers(vectors: np.ndarray) -> np.ndarray:
    """Components as integers: 256 times each, rounded down."""
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def nearest(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry to each part, the lowest of equal ones, and its squared distance; exact."""
    width = parts.shape[1]
    biggest = max(int(np.abs(parts).max(initial=0)), int(np.abs(codebook).max(initial=0)), 1)
    entry = np.empty(len(parts), np.int64)
    exact = 3 * width * biggest * biggest < 1 << 53  # whole numbers that doubles hold
    for at in range(0, len(parts), 8192):
        block = parts[at : at + 8192]
        if exact:
            centres = codebook.astype(np.float64)
            far = (centres * centres).sum(axis=1) - 2.0 * (block.astype(np.float64) @ centres.T)
        else:
            far = sum((block[:, j, None] - codebook[None, :, j]) ** 2 for j in range(width))
        entry[at : at + 8192] = far.argmin(axis=1)
    return entry, ((parts - codebook[entry]) ** 2).sum(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


_MEMBER = "row bigint, position int, entry int, salt int, part array<int>"


def _member_batch(row, position, entry, salt, part) -> pa.RecordBatch:
    ends = np.arange(len(row) + 1, dtype=np.int32) * part.shape[1]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row, pa.int64()),
            pa.array(position, pa.int32()),
            pa.array(entry, pa.int32()),
            pa.array(salt, pa.int32()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel().astype(np.int32))),
        ],
        names=["row", "position", "entry", "salt", "part"],
    )


def _assigned(batch: pa.RecordBatch, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry and error of each member of a batch."""
    position, parts = batch.column("position").to_numpy(), _matrix(batch.column("part")).astype(np.int64)
    entry, error = np.zeros(len(position), np.int64), np.zeros(len(position), np.int64)
    for p in np.unique(position):
        here = np.flatnonzero(position == p)
        entry[here], error[here] = nearest(parts[here], codebooks[p])
    return entry, error


def _dealt(members: DataFrame) -> DataFrame:
    return members.repartition("position", "entry", "salt")


def _updated(members: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """New entries: the rounded-down mean of an entry's members, summed where they reside.

    One row comes back for each entry with members: positions x entries at most, whatever the input.
    """
    width = codebooks.shape[2]
    sums = [F.sum(F.get("part", F.lit(j)).cast("bigint")).alias(f"s{j}") for j in range(width)]
    changed = codebooks.copy()
    for row in members.groupBy("position", "entry").agg(F.count("*").alias("members"), *sums).collect():
        changed[row.position, row.entry] = [row[f"s{j}"] // row.members for j in range(width)]
    return changed


def vector_codes(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error)``, a row for each row of ``vectors`` whose vector is whole, and the
    codebooks (position, entry, component).

    Rows whose vector is NULL, empty or holds NULL or non-finite components go; so do those whose length
    is not that of the kept vector of least id, or no multiple of ``parts``. Codebooks start from the
    ``entries`` kept rows of least id (equal ids by vector, NULL ids last), or from all if there are fewer.
    Repeated rows are members of their own. Components beyond 262,144 count as that. No rows left give no rows and
    empty codebooks. Other columns are not read. ``entries`` is at most 256, as an index takes two hex digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    kind = number_array(vectors, embedding)
    kept = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast(kind).alias("vector")
    ).where(whole_vector("vector") & (F.size("vector") % parts == 0))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    width = len(first[0].vector) // parts if first else 1
    kept = kept.where(F.size("vector") == width * parts)
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    codebooks = integers(np.array([s.vector for s in seeds]).reshape(len(seeds), parts * width))
    codebooks = codebooks.reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    salts = max(16, -(-vectors.count() // OWNED))

    rows = stored(kept.withColumn("row", F.monotonically_increasing_id()))
    if not seeds:
        empty = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return empty.limit(0), codebooks

    def members_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column("row").to_numpy()
            cut = integers(_matrix(batch.column("vector"))).reshape(len(row), parts, width)
            for p in range(parts):
                entry, _ = nearest(cut[:, p], codebooks[p])
                salt = (row ^ (row >> 16)) % salts
                yield _member_batch(row, np.full(len(row), p), entry, salt, cut[:, p])

    members = stored(_dealt(rows.select("row", "vector").mapInArrow(members_of, _MEMBER)))
    for _ in range(rounds - 1):
        books = _updated(members, codebooks)

        def again(batches: Iterable[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    entry, _ = _assigned(batch, books)
                    yield batch.append_column("next", pa.array(entry, pa.int32()))

        seen = stored(members.mapInArrow(again, f"{_MEMBER}, next int"))
        stay = seen.where("next = entry").drop("next")
        moved = seen.where("next <> entry").withColumn("entry", F.col("next")).drop("next")
        members, codebooks = stay.unionByName(stored(_dealt(moved))), books
    codebooks = _updated(members, codebooks) if rounds else codebooks
    last = codebooks

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                entry, error = _assigned(batch, last)
                position = batch.column("position")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), position, pa.array(entry, pa.int64()), pa.array(error, pa.int64())],
                    names=["row", "position", "entry", "error"],
                )

    ends = members.mapInArrow(coded, "row bigint, position int, entry bigint, error bigint")
    # Eight indices of eight bits fill a number; gathering a row's indices is an or of numbers.
    held = [
        F.bit_or(F.when(F.expr(f"position div 8 = {k}"), F.expr("shiftleft(entry, 8 * (7 - position % 8))")).otherwise(0))
        for k in range(-(-parts // 8))
    ]
    spelt = [F.lower(F.lpad(F.hex(f"c{k}"), 16, "0")).substr(1, 2 * min(8, parts - 8 * k)) for k in range(len(held))]
    codes = ends.groupBy("row").agg(F.sum("error").alias("error"), *[x.alias(f"c{k}") for k, x in enumerate(held)])
    codes = codes.select("row", F.concat(*spelt).alias("code"), "error")
    return rows.select("row", "vec_id", "label").join(codes, "row").drop("row"), codebooks


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the errors summed over rows of equal label; NULL labels are one."""
    codes = stored(codes)
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def codebooks_digest(codebooks: np.ndarray) -> str:
    """sha256 of all components, by part, entry and position in the part, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
