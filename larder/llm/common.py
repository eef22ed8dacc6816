"""Helpers shared by the training-text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import ensure_checkpoint_dir

# A word is a run of anything but blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def text_of(name: str) -> Column:
    """A text column; NULL reads as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(words_of(c)).cast("bigint")


def id_text(name: str) -> Column:
    """An id as text; NULL reads as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_of(name: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(id_text(name).cast("binary")), F.lit(folds))


def md5_fraction(text: Column) -> Column:
    """The first 52 bits of the text's md5 as a number above 0 and below 1."""
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (number.cast("double") + 0.5) / F.lit(float(1 << 52))


def number_array(df: DataFrame, name: str) -> str:
    """The type to read a vector column by: single precision stays, as it is half the bytes and turns into
    doubles without loss; all else becomes double."""
    kept = df.schema[name].dataType.simpleString()
    return kept if kept == "array<float>" else "array<double>"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and read it back.

    Later jobs read the files, so a lost executor costs the reading of them, not the work behind.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class WordMemo(dict):
    """Value of a word, worked out once and remembered for up to ``most`` words."""

    def __init__(self, value, most: int = 300_000):
        super().__init__()
        self._value, self._most = value, most

    def __missing__(self, word):
        if len(self) >= self._most:
            self.clear()
        value = self[word] = self._value(word)
        return value


def hashed_words() -> WordMemo:
    return WordMemo(xxhash.xxh3_64_intdigest)


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one (a published finaliser of xor-shifts and products)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one array per row."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))


def slices(batches: Iterable[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` of text; a longer text stays whole."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        column = batch.column(at)
        length = pc.binary_length if column.type in (pa.binary(), pa.large_binary()) else pc.utf8_length
        ends = np.cumsum(pc.fill_null(length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
