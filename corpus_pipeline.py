"""Corpus preparation: quality rules, quality classifier, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and
returns a DataFrame; it is written as Parquet and read again as the next stage's input. All but
the last stage return the columns of documents. NULL and empty texts, NULL ids, repeated rows,
no rows at all and further columns are handled as the operators say.
"""

from __future__ import annotations

from larder.llm import minhash, mixing, packing, quality_knn, quality_rules
from larder.llm.common import stored


def quality_rule_stage(spark, docs, sf_dir):
    """Drops the documents that fail a rule of the current policy."""
    return quality_rules.keep_good(docs)


def classifier_stage(spark, docs, sf_dir):
    """Drops the documents predicted to be of low quality, by labels of documents still here."""
    return quality_knn.keep_predicted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark, docs, sf_dir):
    """Keeps one document of each group of near duplicates."""
    return minhash.keep_one(docs)


def mixing_stage(spark, docs, sf_dir):
    """Takes each source's words up to its target, documents whole but for a source's last one."""
    return mixing.mixed_documents(docs)


def packing_stage(spark, docs, sf_dir):
    """Places every word of every document in a sequence of a permitted length."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# Min-max hashing and nearest neighbours are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
