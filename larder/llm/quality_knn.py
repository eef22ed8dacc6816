"""Quality scores by nearest-neighbour voting in a latent semantic space.

A bounded, class-balanced sample of labelled texts is turned into weighted term vectors; a
truncated singular value decomposition gives the latent space. The sample's latent vectors are
broadcast (their number and width are parameters, so their size is bounded). Every document is
projected into the space and compared with all of them by exact cosine products, block by block;
the labels of its nearest neighbours are weighted by similarity.

Terms are hashed words, word shapes, word endings, and marks of repetition. Nothing but the text
is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import WordMemo, fold_of, id_text, lists, slices, text_of

SAMPLE_PER_CLASS = 1500  # labelled texts of each class that the space and the votes rest on
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 8  # power of the cosine that weighs a neighbour's label
FOLDS = 5
CUT = 0.3
BLOCK_ROWS = 256

# Ranges of hashed terms: words, shapes, endings, repetition.
WORDS, SHAPES, ENDINGS, MARKS = 2048, 512, 512, 16
TERMS = WORDS + SHAPES + ENDINGS + MARKS


def _shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one sign each; other characters as they are."""
    signs, last = [], ""
    for c in word[:32]:
        sign = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if sign != last:
            signs.append(sign)
            last = sign
    return "".join(signs)


def _hash(text: str, modulus: int) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) % modulus


def _terms_of(word: str) -> int:
    """The word's three term numbers and a print of the word, packed into one number."""
    low = word.lower()
    return (
        _hash(low, WORDS)
        | _hash(_shape(word), SHAPES) << 11
        | _hash("-" + low[-3:], ENDINGS) << 20
        | (xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) & 0x3FFFFFFF) << 29
    )


def term_vector(text: str | None, memo: dict) -> np.ndarray:
    """Square roots of the terms' shares in a text, so that long and short texts compare."""
    vector = np.zeros(TERMS, np.float32)
    words = text.split() if text else []
    if not words:
        return vector
    packed = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
    count = len(packed)
    vector[:WORDS] = np.bincount(packed & 0x7FF, minlength=WORDS)
    vector[WORDS : WORDS + SHAPES] = np.bincount((packed >> 11) & 0x1FF, minlength=SHAPES)
    vector[WORDS + SHAPES : WORDS + SHAPES + ENDINGS] = np.bincount((packed >> 20) & 0x1FF, minlength=ENDINGS)
    prints = packed >> 29
    marks = vector[WORDS + SHAPES + ENDINGS :]
    marks[0] = count
    marks[1] = np.count_nonzero(prints[1:] == prints[:-1])
    if count > 8:
        runs = prints[:-3] * 3 + prints[1:-2] * 5 + prints[2:-1] * 7 + prints[3:] * 11
        marks[2] = len(runs) - len(np.unique(runs))
    lines = [line for line in text.split("\n") if line.strip()]
    marks[3] = count * (len(lines) - len(set(lines))) / max(1, len(lines))
    marks[4 + min(11, int(np.log2(count + 1)))] = count / 4
    return np.sqrt(vector / count)


def _vectors(batches):
    memo = WordMemo(_terms_of)
    for batch in slices(batches, "text"):
        vectors = [term_vector(text, memo) for text in batch.column("text").to_pylist()]
        kept = [np.flatnonzero(v) for v in vectors]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("label"),
                lists([k.astype(np.int32) for k in kept], pa.int32()),
                lists([v[k] for v, k in zip(vectors, kept, strict=True)], pa.float32()),
            ],
            names=["label", "terms", "values"],
        )


class Space:
    """Term weights, projection, and the sample's latent vectors with their labels."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS):
        held = np.count_nonzero(vectors, axis=0)
        self.idf = np.log((1 + len(vectors)) / (1 + held)).astype(np.float32) + 1
        weighted = vectors * self.idf
        width = min(dimensions, max(1, len(vectors)))
        # A randomised decomposition: a random sketch of the range, sharpened twice.
        sketch = weighted @ np.random.default_rng(7).standard_normal((TERMS, width + 16), dtype=np.float32)
        for _ in range(2):
            basis, _ = np.linalg.qr(sketch)
            sketch = weighted @ (weighted.T @ basis)
        basis, _ = np.linalg.qr(sketch)
        _, _, axes = np.linalg.svd(basis.T @ weighted, full_matrices=False)
        self.axes = np.ascontiguousarray((axes[:width] * self.idf).T.astype(np.float32))
        self.latent = self.project(vectors)
        self.labels = labels.astype(np.float32)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        latent = vectors @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def score(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, weighted by similarity."""
        cosines = self.project(vectors) @ self.latent.T
        count = min(neighbours, cosines.shape[1])
        near = np.argpartition(-cosines, count - 1, axis=1)[:, :count]
        weights = np.maximum(np.take_along_axis(cosines, near, axis=1), 0) ** SHARPNESS + 1e-9
        return np.clip((weights * self.labels[near]).sum(axis=1) / weights.sum(axis=1), 0, 1)


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
    per_class: int = SAMPLE_PER_CLASS, folds: int = FOLDS,
) -> DataFrame:
    """``(label, text)``: up to ``per_class`` labelled documents of each class outside fold 0.

    Only labels of documents in ``docs`` are drawn, by a hash of the id, so that those of documents
    that are gone take no places.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & (fold_of(doc_id, folds) != 0))
    known = known.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(label).cast("int").alias("label")).distinct()
    known = known.join(docs.select(F.col(doc_id).cast("bigint").alias("_id")), "_id", "left_semi")
    drawn = None
    for value in (0, 1):
        one = known.where(F.col("label") == value).orderBy(F.md5(id_text("_id").cast("binary")), "_id").limit(per_class)
        drawn = one if drawn is None else drawn.union(one)
    texts = docs.select(F.col(doc_id).cast("bigint").alias("_id"), text_of(text).alias("text"))
    return texts.join(F.broadcast(drawn), "_id").select("label", "text")


def fit(sample: DataFrame, most: int = 2 * SAMPLE_PER_CLASS) -> Space | None:
    """The latent space of a bounded sample; None when it has no rows."""
    order = Window.partitionBy("label").orderBy(F.md5(F.col("text").cast("binary")))
    # Rows that share an id could exceed the bound; the sample is cut to it again.
    bounded = sample.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("label", "text")
    rows = bounded.mapInArrow(_vectors, "label int, terms array<int>, values array<float>").toArrow()
    if not rows.num_rows:
        return None
    vectors = np.zeros((rows.num_rows, TERMS), np.float32)
    for i, (terms, values) in enumerate(zip(rows.column("terms"), rows.column("values"), strict=True)):
        vectors[i, terms.values.to_numpy()] = values.values.to_numpy()
    order_ = np.lexsort((vectors.sum(axis=1), rows.column("label").to_numpy()))
    return Space(vectors[order_], rows.column("label").to_numpy()[order_])


def with_scores(docs: DataFrame, space: Space | None, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in a new column; all 0.5 without a space.

    A NULL or empty text has no direction and gets the plain average of its neighbours' labels.
    """
    if space is None:
        return docs.withColumn(score, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(space)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = WordMemo(_terms_of)
        for texts in batches:
            found = [np.empty(0)]
            for at in range(0, len(texts), BLOCK_ROWS):
                block = np.stack([term_vector(t, memo) for t in texts.iloc[at : at + BLOCK_ROWS]])
                found.append(shared.value.score(block))
            yield pd.Series(np.concatenate(found), dtype="float64")

    return docs.withColumn(score, scored(text_of(text)))


def quality_scores(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row for each row of ``docs``.

    Labels of fold 0 are never learned from. Labels other than 0 and 1, labels without an id and
    labels of no document are ignored; a document with both labels counts once for each. Without
    any label every score is 0.5. Ids may be NULL (then they count as fold 0) or repeated; other
    columns are ignored.
    """
    space = fit(training_sample(docs, labels, label, doc_id, text))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (fold_of(doc_id, FOLDS) == 0).alias("held_out"), text_of(text).alias("_text")
    )
    scored = with_scores(rows, space, "_text").drop("_text")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_predicted(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` predicted to be of label 1, with their columns as given.

    NULL texts read as empty, NULL ids are never in the training sample, and each of repeated rows is judged alike. No
    rows give none.
    """
    space = fit(training_sample(docs, labels, label, doc_id, text))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of(text).alias("_text"))
    return with_scores(held, space, "_text").where(F.col("score") >= CUT).select("row.*")
