"""Streaming queries, run over what is available and read back, and the user hooks."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import hooks
from larder.plans.document_queries import books
from larder.sources import views
from larder.streaming import jobs


def _stream(spark, d, name):
    """A table as a stream of its file."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _kept(spark, keys, start):
    """Run a job into a scratch change log and read the table it stands for."""
    path = jobs.scratch(spark, "log")
    start(path, jobs.scratch(spark, "stream"))
    return jobs.latest_rows(spark, path, keys)


def stream_toggles(spark, d):
    toggles = views.toggles_of(_stream(spark, d, "events"))
    table = _kept(spark, ["kind", "recipe_id"], lambda path, check: jobs.stream_toggles(toggles, path, check))
    return table.where("is_on").select("kind", "recipe_id", "event_id")


STATUS = {
    "signup": "queued", "view": "processing", "click": "extracted", "purchase": "partially_extracted", "error": "failed",
}


def _status(events):
    names = F.create_map(*(F.lit(v) for pair in STATUS.items() for v in pair))
    return events.select(
        F.col("user_id").alias("cookbook_id"), F.coalesce(F.element_at(names, F.col("event_type")), F.lit("staged")).alias("status"), "ts", "event_id"
    )


def stream_job_status(spark, d):
    events = _status(_stream(spark, d, "events"))
    table = _kept(spark, ["cookbook_id"], lambda path, check: jobs.stream_job_status(events, path, check))
    return table.select("cookbook_id", "status", "event_id")


def stream_facet_counts(spark, d):
    lines = _stream(spark, d, "lineitem").select(F.col("l_orderkey").alias("recipe_id"), F.col("l_partkey").alias("name"))
    table = _kept(spark, ["name", "recipe_id"], lambda path, check: jobs.stream_facet_index(lines, path, check))
    return table.groupBy("name").agg(F.count("*").alias("recipe_count"))


def stream_review_counts(spark, d):
    events = _stream(spark, d, "events").select(
        (F.get_json_object("props", "$.k").cast("bigint") % 10).alias("cookbook_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("recipe_id"),
        F.when(F.col("event_type") == "error", "needs_review").otherwise("verified").alias("status"), "ts", "event_id",
    )
    table = _kept(spark, ["cookbook_id", "recipe_id"], lambda path, check: jobs.stream_review_status(events, path, check))
    return jobs.review_counts(table)


def stream_enqueue_dedup(spark, d):
    events = _stream(spark, d, "events").select(
        F.col("user_id").alias("cookbook_id"), "event_id",
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "extracted").otherwise("requested").alias("status"),
    )
    path = jobs.scratch(spark, "queue")
    writer = jobs.enqueue_once(events).writeStream.outputMode("append").format("parquet").option("path", path)
    jobs.run_available(writer, jobs.scratch(spark, "stream"))
    return spark.read.parquet(path)


def sent(spark, uploads):
    """Uploads as a stream of two batches. Files are as many as tasks: two would be written and split by few."""
    path = jobs.scratch(spark, "uploads")
    files = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    uploads.repartition(files, "cookbook_id", "upload_no").write.parquet(path)
    written = spark.read.parquet(path)
    half = max(1, -(-len(written.inputFiles()) // 2))
    return spark.readStream.schema(written.schema).option("maxFilesPerTrigger", half).parquet(path)


def stream_ingest(spark, d):
    """Every e-book uploaded, some again and some without text, over tables that hold older rows of some."""
    own = books(spark, d)
    shown = F.when(F.col("cookbook_id") % 13 == 0, F.concat(F.lit("<p> </p>"), F.lit("<br>"))).otherwise(F.col("html"))
    entry = F.struct("doc_no", "doc", shown.alias("html"))
    first = own.groupBy("cookbook_id").agg(F.lit(1).cast("bigint").alias("upload_no"), F.collect_list(entry).alias("files"))
    # Sent again, of these only the plain document is left.
    again = first.where(F.col("cookbook_id") % 5 == 0).withColumns(
        {"upload_no": F.lit(2).cast("bigint"), "files": F.filter("files", lambda f: f["doc_no"] % 4 == 1)}
    )
    stream = sent(spark, first.unionByName(again))
    old = own.select("cookbook_id").distinct()
    old = old.union(old.select(F.col("cookbook_id") + 1000000))
    key = F.concat(F.lit("old"), F.col("cookbook_id").cast("string"))
    shelves = jobs.new_library(spark, jobs.scratch(spark, "library"), buckets=8)
    before = {
        "index": old.select("cookbook_id", key.alias("recipe_id"), F.lit("salt").alias("name")),
        "toggles": old.select("cookbook_id", key.alias("recipe_id"), F.lit("favourite").alias("kind")),
        "vectors": old.select("cookbook_id", key.alias("recipe_id"), F.array(F.lit(1.0).cast("float")).alias("embedding")),
        "dishes": old.select(
            "cookbook_id", key.alias("recipe_id"), F.lit(1).cast("bigint").alias("position"), F.lit("a").alias("anchor"),
            F.lit("Old").alias("title"), F.lit("verified").alias("review_status"),
        ),
    }
    shelves.replace(before, owners=old)
    jobs.stream_ingest(stream, shelves, jobs.scratch(spark, "stream"), _hashed)
    none = F.lit(None).cast("string")
    parts = [
        shelves.read("dishes").select(F.lit("dishes").alias("table"), "cookbook_id", "recipe_id", F.concat_ws("|", F.col("position").cast("string"), "anchor", "title", "review_status").alias("detail")),
        shelves.read("index").select(F.lit("index").alias("table"), "cookbook_id", "recipe_id", F.when(F.startswith("recipe_id", F.lit("old")), F.col("name")).alias("detail")).distinct(),
        shelves.read("toggles").select(F.lit("toggles").alias("table"), "cookbook_id", "recipe_id", F.col("kind").alias("detail")),
        shelves.read("vectors").select(F.lit("vectors").alias("table"), "cookbook_id", "recipe_id", F.size("embedding").cast("string").alias("detail")),
        shelves.read("rejects").select(F.lit("rejects").alias("table"), "cookbook_id", none.alias("recipe_id"), F.col("extract_error").alias("detail")),
        shelves.read("cookbooks").select(
            F.lit("cookbooks").alias("table"), "cookbook_id", none.alias("recipe_id"),
            F.concat_ws("|", F.col("upload_no").cast("string"), "status", F.col("recipe_count").cast("string"), F.col("needs_review_count").cast("string")).alias("detail"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def _hashed(texts):
    """A stand-in embedder: four numbers from the hash of each text."""
    return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:4]] for t in texts]


def embed_column(spark, d):
    docs = views.documents(spark, d).select("recipe_id", "text")
    done = hooks.embed_column(docs, "text", _hashed)
    return done.select("recipe_id", F.round(F.element_at("embedding", 1) * 255, 0).cast("int").alias("first_byte"))


def extract_with(spark, d):
    docs = views.documents(spark, d).select("recipe_id", "text")

    def count_lines(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"recipe_id": frame["recipe_id"], "lines": frame["text"].str.count("\n") + 1})

    return hooks.extract_with(docs, count_lines, "recipe_id bigint, lines bigint")


QUERIES = {
    f.__name__: f
    for f in (
        stream_toggles, stream_job_status, stream_facet_counts, stream_review_counts, stream_enqueue_dedup, stream_ingest,
        embed_column, extract_with,
    )
}
