"""Structured Streaming jobs: ingest, queue, job status, toggles, facet and review counts.

Each job is a function of a streaming DataFrame. The queries run them with the available-now
trigger and read the finished result back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from larder.functions.ingredients import index_name
from larder.functions.metadata import embedding_text
from larder.operators.hooks import embed_column
from larder.operators.routing import book_drafts
from larder.session import cut_lineage, ensure_checkpoint_dir
from larder.sources.shelves import Shelves

# Fixed values.
REQUESTED = "requested"
BUSY = ("queued", "processing")
MAX_REASON = 500
NO_TEXT = "No text in the uploaded document."
NO_CANDIDATES = "No recipe candidates were extracted."
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Tables of the library, children first.
LIBRARY = {
    "index": "cookbook_id bigint, recipe_id string, name string",
    "toggles": "cookbook_id bigint, recipe_id string, kind string",
    "vectors": "cookbook_id bigint, recipe_id string, embedding array<float>",
    "dishes": "cookbook_id bigint, recipe_id string, position bigint, anchor string, title string, review_status string",
    "rejects": "cookbook_id bigint, upload_no bigint, extract_error string",
    "cookbooks": "cookbook_id bigint, upload_no bigint, status string, recipe_count bigint, needs_review_count bigint, extract_error string",
}


def run_available(writer, checkpoint: str) -> StreamingQuery:
    """Start a writer over what is there now and wait until it is done."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's checkpoint folder, shared by all executors."""
    unique = spark.range(1).select(F.expr("uuid()")).first()[0]
    return f"{ensure_checkpoint_dir(spark)}/{name}-{unique}"


def append_changes(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
    make: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Write each batch's rows to its own folder of a change log.

    Only what changed is written, never the whole table. A batch that runs again overwrites its
    own folder, so a restart neither loses nor doubles rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if make is None else make(batch)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run_available(stream.writeStream.outputMode(mode).foreachBatch(write), checkpoint)


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table that a change log stands for: per key, the rows of its last batch."""
    log = spark.read.parquet(path)
    last = log.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return log.join(last, [*keys, "batch"], "left_semi").drop("batch")


# --- toggles, facets, reviews ----------------------------------------------------------------


def last_write(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Last written value per key, kept in the state store; updates hold the changed keys only."""
    last = F.max_by(F.struct(value, "ts", "event_id"), F.struct("ts", "event_id")).alias("last")
    return stream.groupBy(*keys).agg(last).select(*keys, "last.*")


def stream_toggles(toggles: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Membership of favourites and want-to-try: the last write wins."""
    return append_changes(last_write(toggles, ["kind", "recipe_id"], "is_on"), path, checkpoint, "update")


def stream_job_status(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Latest status of every cookbook ``(cookbook_id, status, ts, event_id)``."""
    return append_changes(last_write(events, ["cookbook_id"], "status"), path, checkpoint, "update")


def stream_review_status(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Latest review of every recipe; the counts per cookbook are read from it."""
    return append_changes(last_write(events, ["cookbook_id", "recipe_id"], "status"), path, checkpoint, "update")


def review_counts(latest: DataFrame) -> DataFrame:
    return latest.groupBy("cookbook_id").agg(F.count_if(F.col("status") == "needs_review").alias("needs_review_count"))


def stream_facet_index(arrivals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The inverted index ``(name, recipe_id)``: each pair is appended when first seen."""
    return append_changes(arrivals.select("name", "recipe_id").dropDuplicates(["name", "recipe_id"]), path, checkpoint)


# --- queue -----------------------------------------------------------------------------------


class Admission(StatefulProcessor):
    """Whether a cookbook is queued or being processed: one boolean per key, which can expire."""

    def __init__(self, expiry_ms: int | None):
        self._expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._busy = handle.getValueState("busy", "busy boolean", ttlDurationMs=self._expiry_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Whole columns at a time: a request is admitted when what came before it left the cookbook idle."""
        ids, wants, busy = (
            np.concatenate(x)
            for x in zip(
                *[
                    (f["event_id"].to_numpy(), (f["status"] == REQUESTED).to_numpy(), f["status"].isin([REQUESTED, *BUSY]).to_numpy())
                    for f in rows
                ],
                strict=True,
            )
        )
        order = np.argsort(ids, kind="stable")
        ids, wants, busy = ids[order], wants[order], busy[order]
        before = np.concatenate([[self._busy.exists() and bool(self._busy.get()[0])], busy[:-1]])
        self._busy.update((bool(busy[-1]),))
        admitted = ids[wants & ~before]
        yield pd.DataFrame({"cookbook_id": np.full(len(admitted), key[0]), "event_id": admitted})

    def close(self) -> None:
        pass


def enqueue_once(requests: DataFrame, expiry_ms: int | None = None) -> DataFrame:
    """Requests that reach the queue: those for a cookbook that is not queued or being processed.

    ``requests`` is ``(cookbook_id, event_id, status)`` where status is ``requested`` or what the
    worker reports; a batch's events count in the order of their ids. With ``expiry_ms`` a cookbook that nothing
    comes for in that time counts as idle again, so state holds the cookbooks of that time only. Expiry goes by
    the clock and needs a job with an interval trigger: one with the available-now trigger would not end. State is kept
    in RocksDB.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return requests.groupBy("cookbook_id").transformWithStateInPandas(
        Admission(expiry_ms), "cookbook_id bigint, event_id bigint", "append", "none" if expiry_ms is None else "processingTime"
    )


# --- ingest ----------------------------------------------------------------------------------


def new_library(spark: SparkSession, root: str, buckets: int = 64) -> Shelves:
    """Empty tables that ``stream_ingest`` fills, children first."""
    return Shelves.create(spark, root, {name: spark.createDataFrame([], schema) for name, schema in LIBRARY.items()}, buckets)


def ingest_uploads(uploads: DataFrame, shelves: Shelves, embed: Callable | None = None) -> None:
    """Read the e-books of a batch and store what they give in place of what they gave before.

    An upload is ``(cookbook_id, upload_no, files)`` with ``files`` an array of ``(doc_no, doc, html)``. The last
    upload of a cookbook counts; one that is older than what is stored is passed over, so a batch that runs
    again, or after a later one, changes nothing. Dishes, index names and vectors are replaced; toggles of the
    old dishes go. A book without text or without drafts has a row in ``rejects``, and the batch goes on.
    """
    last = uploads.groupBy("cookbook_id").agg(F.max("upload_no").alias("upload_no"))
    known = shelves.read("cookbooks").select("cookbook_id", F.col("upload_no").alias("_stored"))
    due = last.join(known, "cookbook_id", "left").where("_stored is null or _stored <= upload_no").drop("_stored")
    due = cut_lineage(due)
    files = uploads.join(due, ["cookbook_id", "upload_no"]).select("cookbook_id", F.explode("files").alias("f"))
    docs = files.select("cookbook_id", "f.*").dropDuplicates(["cookbook_id", "doc_no"])
    bad = F.coalesce(F.trim(F.regexp_replace("html", "<[^>]*>", " ")), F.lit("")) == ""
    docs = cut_lineage(docs.withColumn("bad", bad))
    drafts = cut_lineage(book_drafts(docs.where("not bad").drop("bad")))
    made = drafts.groupBy("cookbook_id").agg(
        F.count("*").alias("recipe_count"), F.count_if(F.col("review_status") == "needs_review").alias("needs_review_count")
    )
    read = docs.where("not bad").select("cookbook_id").distinct().withColumn("_read", F.lit(True))
    told = due.join(made, "cookbook_id", "left").join(read, "cookbook_id", "left").fillna(0, ["recipe_count", "needs_review_count"])
    reason = F.when(F.col("_read").isNull(), NO_TEXT).when(F.col("recipe_count") == 0, NO_CANDIDATES)
    status = F.when(F.col("_read").isNull(), "failed").when(F.col("recipe_count") == 0, "partially_extracted").otherwise("extracted")
    told = cut_lineage(told.withColumns({"status": status, "extract_error": F.substring(reason, 1, MAX_REASON)}))
    names = drafts.select("cookbook_id", "recipe_id", F.explode("ingredients").alias("i")).select(
        "cookbook_id", "recipe_id", index_name(F.col("i.canonical_name"), F.col("i.normalized_name"), F.col("i.raw")).alias("name")
    )
    new = {
        "index": names.where("name <> ''").distinct(),
        "dishes": drafts,
        "rejects": told.where("extract_error is not null"),
        "cookbooks": told,
    }
    if embed is not None:
        texts = drafts.select(
            "cookbook_id", "recipe_id", embedding_text(F.col("title"), F.col("ingredients"), F.col("method_steps")).alias("text")
        )
        new["vectors"] = embed_column(texts, "text", embed)
    shelves.replace(new, owners=due)


def stream_ingest(uploads: DataFrame, shelves: Shelves, checkpoint: str, embed: Callable | None = None) -> StreamingQuery:
    """Store queued e-books batch by batch; see ``ingest_uploads``."""

    def store(batch: DataFrame, _batch_id: int) -> None:
        ingest_uploads(batch, shelves, embed)

    return run_available(uploads.writeStream.foreachBatch(store), checkpoint)
