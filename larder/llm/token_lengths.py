"""Token counts of whole texts by a given byte-level tokenizer.

An Arrow function returns lengths only. Texts are split at safe boundaries: a single blank between
two characters that are not white space, where the tokenizer's own pre-splitting always parts. A
count is then the sum over pieces, so a text of any length needs no more memory than its pieces.
Pieces not met before are encoded in batches of about equal bytes; lengths of short pieces are
remembered up to a bound.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import slices

_SAFE = re.compile(r" (?<=\S )(?=\S)")
BATCH_BYTES = 1 << 18
LONGEST_KEPT = 64
MOST_KEPT = 400_000


def balanced(pieces: Iterable[str], most: int) -> Iterator[list[str]]:
    """Batches of about ``most`` characters; a longer piece is a batch of its own."""
    batch, size = [], 0
    for piece in pieces:
        if batch and size + len(piece) > most:
            yield batch
            batch, size = [], 0
        batch.append(piece)
        size += len(piece)
    if batch:
        yield batch


class Lengths:
    """Token counts with one tokenizer, remembering short pieces."""

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._batch_bytes = batch_bytes
        self._known: dict[str, int] = {}

    def of(self, texts: list[str | None]) -> list[int]:
        split = []
        for text in texts:
            pieces = _SAFE.split(text) if text else []
            pieces[1:] = [" " + piece for piece in pieces[1:]]
            split.append(pieces)
        new = {piece for pieces in split for piece in pieces if piece not in self._known}
        if len(self._known) + len(new) > MOST_KEPT:
            self._known = {}
            new = {piece for pieces in split for piece in pieces}
        for batch in balanced(sorted(new), self._batch_bytes):
            found = self._tokenizer.encode_batch(batch, add_special_tokens=False)
            self._known.update((piece, len(encoding)) for piece, encoding in zip(batch, found, strict=True))
        counts = [sum(map(self._known.__getitem__, pieces)) for pieces in split]
        for piece in new:
            if len(piece) > LONGEST_KEPT:
                del self._known[piece]
        return counts


def token_counts(
    docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, a row for each row of ``docs``.

    ``tokenizer_path`` is a byte-level BPE file of the tokenizers library that every worker can
    read. Special strings inside a text count as the library takes them by default. NULL and
    empty texts have 0 bytes and 0 tokens; ids may be NULL or repeated; other columns are ignored.
    """

    def lengths(batches):
        counter = Lengths(tokenizer_path)
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counter.of(texts), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(lengths, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
