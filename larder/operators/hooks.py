"""Hooks for a user's own embedder and section reader, on Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

# Fixed value: texts per embedding call.
EMBEDDING_BATCH = 24


def give_back() -> None:
    """Free the batches that were read.

    A column whose string functions were used and these functions refer to each other, so only the collector frees them.
    Such objects are few, however many bytes they hold: it would come late, and a worker grow with each batch it has read.
    """
    gc.collect()


def embed_column(
    df: DataFrame, text_col: str, fn: Callable[[Sequence[str]], Sequence[Sequence[float]]], batch_size: int = EMBEDDING_BATCH
) -> DataFrame:
    """Add ``embedding`` by calling ``fn`` on lists of at most ``batch_size`` texts."""
    schema = StructType([*df.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = []
            texts = frame[text_col].tolist()
            for start in range(0, len(texts), batch_size):
                vectors.extend(list(map(float, v)) for v in fn(texts[start : start + batch_size]))
            yield frame.assign(embedding=vectors)
            del frame, texts, vectors
            give_back()

    return df.mapInPandas(embed, schema)


def extract_with(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """Rows that ``fn`` makes of each batch of sections."""

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)
            del frame
            give_back()

    return df.mapInPandas(extract, schema)
