"""Streams fed in several batches reach the batch result."""

import random
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from larder.operators.catalogue import toggle_state
from larder.plans import stream_queries
from larder.streaming import jobs


@pytest.fixture
def events(spark):
    rows = [(i, i // 3, "favourite" if i % 2 else "want_to_try", (i * 7) % 11, (i * 5) % 3 != 0) for i in range(200)]
    return spark.createDataFrame(rows, "event_id long, ts long, kind string, recipe_id long, is_on boolean")


def _fed(spark, df, name):
    """The frame as a stream of four files, one to a batch."""
    path = jobs.scratch(spark, name)
    for part in range(4):
        df.where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_toggles_over_batches(spark, events):
    path = jobs.scratch(spark, "log")
    jobs.stream_toggles(_fed(spark, events, "toggles"), path, jobs.scratch(spark, "check"))
    got = jobs.latest_rows(spark, path, ["kind", "recipe_id"]).where("is_on")
    want = toggle_state(events)
    columns = ["kind", "recipe_id", "event_id"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert spark.read.parquet(path).select("batch").distinct().count() == 4


def test_facet_index_over_batches(spark, events):
    named = events.select("event_id", F.col("kind").alias("name"), "recipe_id")
    path = jobs.scratch(spark, "log")
    jobs.stream_facet_index(_fed(spark, named, "names"), path, jobs.scratch(spark, "check"))
    got = spark.read.parquet(path).select("name", "recipe_id")
    assert got.count() == got.distinct().count() == named.select("name", "recipe_id").distinct().count()


def test_requests_while_busy_are_ignored(spark):
    rows = [(1, 1, "requested"), (1, 2, "requested"), (1, 3, "processing"), (1, 4, "requested"), (1, 5, "extracted"), (1, 6, "requested"), (2, 7, "requested")]
    df = spark.createDataFrame(rows, "cookbook_id long, event_id long, status string")
    source = jobs.scratch(spark, "requests")
    df.coalesce(1).write.parquet(source)
    out = jobs.scratch(spark, "queue")
    writer = jobs.enqueue_once(spark.readStream.schema(df.schema).parquet(source)).writeStream.format("parquet").option("path", out)
    jobs.run_available(writer, jobs.scratch(spark, "check"))
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 6, 7]


def test_requests_over_many_batches_equal_a_replay(spark):
    draw = random.Random(4)
    kinds = ["requested", "requested", "processing", "extracted", "failed", "queued"]
    rows = [(draw.randrange(6) if i % 3 else 0, i, draw.choice(kinds)) for i in range(400)]
    df = spark.createDataFrame(rows, "cookbook_id long, event_id long, status string")
    source = jobs.scratch(spark, "requests")
    for part in range(5):  # each batch is a later stretch, in no order inside
        df.where(F.floor(F.col("event_id") / 80) == part).orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(source)
    out, check = jobs.scratch(spark, "queue"), jobs.scratch(spark, "check")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.run_available(jobs.enqueue_once(stream).writeStream.format("parquet").option("path", out), check)
    status, want = {}, []
    for book, event, kind in rows:
        if kind != "requested":
            status[book] = kind
        elif status.get(book) not in jobs.BUSY:
            status[book] = "queued"
            want.append((book, event))
    assert sorted((r.cookbook_id, r.event_id) for r in spark.read.parquet(out).collect()) == sorted(want)


def test_a_request_that_nothing_came_of_expires(spark):
    schema = "cookbook_id long, event_id long, status string"
    source, out = jobs.scratch(spark, "requests"), jobs.scratch(spark, "queue")
    spark.createDataFrame([(1, 1, "requested"), (1, 2, "requested")], schema).coalesce(1).write.parquet(source)
    stream = jobs.enqueue_once(spark.readStream.schema(schema).parquet(source), expiry_ms=1000)
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", jobs.scratch(spark, "check"))

    def admitted():
        try:  # the sink's log names the files that are whole
            return sorted(r.event_id for r in spark.read.parquet(out).collect())
        except AnalysisException:  # nothing is written yet
            return None

    query = writer.trigger(processingTime="1 second").start()
    try:
        for event, want in ((3, [1]), (4, [1, 3])):
            until = time.time() + 60
            while time.time() < until:
                time.sleep(2)
                if admitted() == want:
                    break
            else:
                pytest.fail(f"{want} did not come")
            time.sleep(3)
            spark.createDataFrame([(1, event, "requested")], schema).coalesce(1).write.mode("append").parquet(source)
    finally:
        query.stop()


PLAIN = "<h2>Soup</h2><p>Serves 4</p><ul><li>200g flour</li><li>2 eggs</li></ul><p>Method</p><p>Mix. {}</p>"
UPLOADS = "cookbook_id bigint, upload_no bigint, files array<struct<doc_no:bigint,doc:string,html:string>>"


def _upload(spark, *rows):
    return spark.createDataFrame([(b, n, [(i, f"c{i}.xhtml", h) for i, h in enumerate(files)]) for b, n, files in rows], UPLOADS)


def test_uploads_replace_what_is_stored_once(spark, tmp_path):
    shelves = jobs.new_library(spark, str(tmp_path / "library"), buckets=4)

    def state():
        return {n: sorted(map(str, shelves.read(n).collect())) for n in shelves.tables}

    first = _upload(spark, (1, 1, [PLAIN.format(1), PLAIN.format(2)]), (2, 1, ["<p>talk</p>"]), (3, 1, [None, " "]), (4, 1, [PLAIN.format(3)]))
    jobs.ingest_uploads(first, shelves, lambda texts: [[float(len(t))] for t in texts])
    assert sorted((r.cookbook_id, r.position) for r in shelves.read("dishes").collect()) == [(1, 1), (1, 2), (4, 1)]
    assert sorted((r.cookbook_id, r.extract_error) for r in shelves.read("rejects").collect()) == [(2, jobs.NO_CANDIDATES), (3, jobs.NO_TEXT)]
    assert shelves.read("vectors").count() == 3 and shelves.read("index").count() == 6
    dish = shelves.read("dishes").where("cookbook_id = 1 and position = 2").first().recipe_id
    likes = spark.createDataFrame([(1, dish, "favourite"), (4, "x", "favourite")], jobs.LIBRARY["toggles"])
    shelves.upsert("toggles", likes, ["recipe_id", "kind"])
    # Read again with one dish less; a repeated row of the upload and an older one change nothing.
    second = _upload(spark, (1, 2, [PLAIN.format(9)]), (1, 2, [PLAIN.format(9)]), (1, 1, [PLAIN.format(1)] * 3), (3, 2, [PLAIN.format(5)]))
    jobs.ingest_uploads(second, shelves)
    now = state()
    assert sorted((r.cookbook_id, r.position) for r in shelves.read("dishes").collect()) == [(1, 1), (3, 1), (4, 1)]
    assert [r.cookbook_id for r in shelves.read("toggles").collect()] == [4]
    assert [r.cookbook_id for r in shelves.read("vectors").collect()] == [4]
    assert [r.cookbook_id for r in shelves.read("rejects").collect()] == [2]
    for again in (second, first):
        jobs.ingest_uploads(again.where("cookbook_id <> 2 and cookbook_id <> 4"), shelves)
        assert state() == now
    jobs.ingest_uploads(first.limit(0), shelves)
    assert state() == now


def test_uploads_are_two_batches_of_many_files(spark):
    """Two files were written by two tasks, however large the input."""
    uploads = spark.createDataFrame([(i, 1, [(1, "a", "<p>x</p>")]) for i in range(60)], "cookbook_id bigint, upload_no bigint, files array<struct<doc_no:bigint,doc:string,html:string>>")
    stream, seen = stream_queries.sent(spark, uploads), []
    writer = stream.writeStream.foreachBatch(lambda batch, _: seen.append(batch.select("cookbook_id", F.input_file_name()).collect()))
    jobs.run_available(writer, jobs.scratch(spark, "stream"))
    assert len(seen) == 2 and all(len({file for _, file in batch}) > 1 for batch in seen)
    assert sorted(i for batch in seen for i, _ in batch) == list(range(60))
