"""Fill-in-middle by a piece table.

A document is one descriptor over its immutable text buffer. Cutting splits descriptors, an
arrangement permutes the parts and puts a descriptor over the sentinel buffer before each, and the
inverse permutation restores their order. Nothing is copied until an output is written, and hashes
take the descriptors' bytes in turn. Restoring starts from the written output alone: it is a buffer
of its own, is cut where its sentinels stand, and the inverse permutation gives the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import slices

# The sentinels before prefix, middle and suffix, and the order of the three parts.
SENTINELS = (b"<P>", b"<M>", b"<S>")
ARRANGEMENTS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
MARK = 3  # bytes of a sentinel; the sentinel of part i is bytes 3i to 3i + 3 of its buffer
_MARKS = b"".join(SENTINELS)
TEXT, MARKS = 0, 1

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Piece(NamedTuple):
    """Bytes ``start`` to ``end`` of a buffer."""

    buffer: int
    start: int
    end: int


def cut(pieces: list[Piece], at: list[int]) -> list[list[Piece]]:
    """The pieces parted at ascending offsets of what they spell; a piece across one is split."""
    parts, rest = [], list(pieces)
    done = 0
    for offset in at:
        part = []
        while rest and done < offset:
            piece = rest[0]
            taken = min(piece.end - piece.start, offset - done)
            part.append(Piece(piece.buffer, piece.start, piece.start + taken))
            done += taken
            rest[:1] = [Piece(piece.buffer, piece.start + taken, piece.end)] if piece.start + taken < piece.end else []
        parts.append(part)
    return [*parts, rest]


def arranged(parts: list[list[Piece]], form: str) -> list[Piece]:
    """Prefix, middle and suffix in the order of ``form``, each behind its sentinel."""
    return [x for i in ARRANGEMENTS[form] for x in (Piece(MARKS, MARK * i, MARK * i + MARK), *parts[i])]


def restored(output: bytes, form: str) -> list[Piece]:
    """Descriptors over an output that spell the text it was made from.

    The text holds no sentinel and no end of a sentinel begins one, so each is found where it was put.
    """
    if form not in ARRANGEMENTS:
        return [Piece(TEXT, 0, len(output))]
    order = ARRANGEMENTS[form]
    begins = [0]
    for i in order[1:]:
        begins.append(output.index(SENTINELS[i], begins[-1] + MARK))
    ends = [*begins[1:], len(output)]
    parts = [Piece(TEXT, begin + MARK, end) for begin, end in zip(begins, ends, strict=True)]
    return [parts[order.index(i)] for i in range(3)]


def spelled(pieces: list[Piece], *buffers: bytes) -> Iterator[memoryview]:
    """The bytes of each descriptor in turn, without copies."""
    views = [memoryview(x) for x in buffers]
    return (views[p.buffer][p.start : p.end] for p in pieces)


def digest(pieces: list[Piece], *buffers: bytes) -> str:
    hashed = hashlib.sha256()
    for view in spelled(pieces, *buffers):
        hashed.update(view)
    return hashed.hexdigest()


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers from the first 32 hex digits of sha256 of seed, colon and id; no id is spelled empty."""
    spelt = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(spelt[i : i + 8], 16) for i in range(0, 32, 8)]


def _unit_ends(text: bytes) -> np.ndarray:
    """Where each unit ends: a run of blanks with the word behind it, or the blanks at the end."""
    blank = _BLANK[np.frombuffer(text, np.uint8)]
    if not len(blank):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(ends, len(blank))


def _points(text: bytes, begin: int, end: int) -> int:
    part = np.frombuffer(text, np.uint8)[begin:end]
    return int(np.count_nonzero((part & 0xC0) != 0x80))


_MADE = (
    "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
    "pieces array<struct<buffer:int,start:bigint,end:bigint>>, output binary, output_sha256 string"
)
_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def _transformed(text: bytes, doc_id: int | None, seed: int, percent: int, spm_percent: int) -> tuple:
    h1, h2, h3, h4 = draws(doc_id, seed)
    ends = _unit_ends(text)
    n = len(ends)
    whole = [Piece(TEXT, 0, len(text))] if text else []
    if not text or h3 % 100 >= percent or any(mark in text for mark in SENTINELS):
        return n, "plain", None, None, whole
    form = "spm" if h4 % 100 < spm_percent else "psm"
    first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    pieces = arranged(cut(whole, [first, second]), form)
    return n, form, _points(text, 0, first), _points(text, first, second), pieces


def fill_in_middle(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80
) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, pieces, output, output_sha256)``, a row for each
    row of ``docs``.

    ``n`` is the number of units (a word with the blanks before it, or the blanks at the end). The two
    cuts, whether a text is rearranged and its form follow from ``seed`` and the id, so rows of one id and text are
    equal and repeated rows repeat. NULL reads as an empty text; empty texts, texts that hold a sentinel and
    ``100 - percent`` of a hundred stay plain, with NULL lengths. A NULL id draws as an empty one. ``pieces``
    describe the output over buffers 0 (the text) and 1 (the sentinels ``<P><M><S>``), in bytes.
    Texts of any length are taken whole. Other columns are not read, and no rows give none.
    """
    taken = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = [_transformed(t, i, seed, percent, spm_percent) for t, i in zip(texts, ids, strict=True)]
            pieces = [r[4] for r in rows]
            outputs = [b"".join(spelled(p, t, _MARKS)) for p, t in zip(pieces, texts, strict=True)]
            hashes = [digest(p, t, _MARKS) for p, t in zip(pieces, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([[p._asdict() for p in x] for x in pieces], _PIECES),
                    pa.array(outputs, pa.binary()),
                    pa.array(hashes, pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"],
            )

    return taken.mapInArrow(made, _MADE).withColumn("output", F.col("output").cast("string"))


def restore(made: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``made`` with ``output`` replaced by ``restored``, the text it was made from, and ``restored_sha256``.

    Reads outputs and forms only. A NULL output reads as empty, a form other than ``psm`` and ``spm``
    as plain. Columns of those two names are replaced; all others stay as they are.
    """
    kept = made.drop("restored", "restored_sha256")
    others = [c for c in kept.columns if c != output]
    taken = kept.select(*others, F.coalesce(F.col(output).cast("string"), F.lit("")).cast("binary").alias("restored"))
    schema = taken.withColumn("restored_sha256", F.lit("")).schema

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "restored"):
            outputs, forms = batch.column("restored").to_pylist(), batch.column(form).to_pylist()
            pieces = [restored(t, f) for t, f in zip(outputs, forms, strict=True)]
            rebuilt = [b"".join(spelled(p, t)) for p, t in zip(pieces, outputs, strict=True)]
            hashes = [digest(p, t) for p, t in zip(pieces, outputs, strict=True)]
            arrays = [batch.column(c) for c in others] + [pa.array(rebuilt, pa.binary()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, "restored", "restored_sha256"])

    return taken.mapInArrow(texts, schema).withColumn("restored", F.col("restored").cast("string"))
