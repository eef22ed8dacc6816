"""Stored tables: only the buckets of changed cookbooks are rewritten."""

import os

import pytest
from pyspark.sql import functions as F

from larder.sources.shelves import Shelves, bucket_of

BUCKETS = 16


def tables(spark):
    books = spark.range(40).select(F.col("id").alias("cookbook_id"), F.concat(F.lit("Book "), "id").alias("title"))
    dishes = spark.range(400).select(F.col("id").alias("recipe_id"), (F.col("id") % 40).alias("cookbook_id"), F.lit("old").alias("state"))
    index = dishes.select("cookbook_id", "recipe_id", F.explode(F.array(F.lit("salt"), F.lit("oil"))).alias("name"))
    vectors = dishes.select("cookbook_id", "recipe_id", F.array(F.col("recipe_id") / 4, F.lit(1.0)).alias("embedding"))
    return {"index": index, "vectors": vectors, "dishes": dishes, "cookbooks": books}


@pytest.fixture
def shelves(spark, tmp_path):
    return Shelves.create(spark, str(tmp_path / "shelves"), tables(spark), BUCKETS)


def files(shelves):
    found = {}
    for folder, _, names in os.walk(shelves.root):
        for name in names:
            path = os.path.join(folder, name)
            if "bucket=" in path and name.endswith(".parquet"):
                found[os.path.relpath(path, shelves.root)] = os.stat(path).st_mtime_ns
    return found


def rows(df):
    return sorted(map(tuple, df.collect()))


def buckets(spark, ids):
    return {r[0] for r in spark.createDataFrame([(i,) for i in ids], "id bigint").select(bucket_of(F.col("id"), BUCKETS)).collect()}


def untouched(before, after, touched):
    """Files outside the touched buckets are the very same; inside them all are new."""
    outside = {f: t for f, t in before.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert outside and outside.items() <= after.items()
    assert all(f not in before for f in after if int(f.split("bucket=")[1].split("/")[0]) in touched)


def test_replace_rewrites_only_the_buckets_of_its_cookbooks(spark, shelves):
    before, old = files(shelves), {n: rows(shelves.read(n)) for n in shelves.tables}
    new = {
        "dishes": spark.createDataFrame([(1000, 3, "new"), (1001, 77, "new")], "recipe_id bigint, cookbook_id bigint, state string"),
        "index": spark.createDataFrame([(3, 1000, "rice"), (4, 9, "stray")], "cookbook_id bigint, recipe_id bigint, name string"),
    }
    for _ in range(2):  # a change that runs again gives the same tables
        touched = shelves.replace(new)
        assert set(touched) == buckets(spark, [3, 77])
        assert rows(shelves.read("dishes")) == sorted([r for r in old["dishes"] if r[1] != 3] + [(1000, 3, "new"), (1001, 77, "new")])
        assert rows(shelves.read("index")) == sorted([r for r in old["index"] if r[0] != 3] + [(3, 1000, "rice")])
        assert rows(shelves.read("vectors")) == [r for r in old["vectors"] if r[0] != 3]
        assert rows(shelves.read("cookbooks")) == [r for r in old["cookbooks"] if r[0] != 3]
    untouched(before, files(shelves), set(touched))


def test_deleting_empties_buckets_and_children(spark, shelves):
    before, old = files(shelves), {n: rows(shelves.read(n)) for n in shelves.tables}
    gone = [i for i in range(40) if buckets(spark, [i]) == buckets(spark, [5])]
    touched = shelves.delete(spark.createDataFrame([(i,) for i in gone], "cookbook_id bigint"))
    assert set(touched) == buckets(spark, [5])
    for name, was in old.items():
        at = shelves.tables[name].names.index("cookbook_id")
        assert rows(shelves.read(name)) == [r for r in was if r[at] not in gone]
    untouched(before, files(shelves), set(touched))
    assert shelves.delete(spark.createDataFrame([], "cookbook_id bigint")) == []


def test_upsert_of_whole_vectors(spark, shelves):
    old = {r[1]: r for r in rows(shelves.read("vectors"))}
    data = [(7, 7, [0.5, 0.25]), (7, 47, [9.0, 8.0]), (7, 47, [9.0, 7.0]), (7, 5000, [1.0, 2.0]), (None, 6000, [3.0, 4.0])]
    new = spark.createDataFrame(data, "cookbook_id bigint, recipe_id bigint, embedding array<double>")
    for _ in range(2):
        touched = shelves.upsert("vectors", new, ["recipe_id"])
    want = {**old, 7: data[0], 47: data[1], 5000: data[3], 6000: data[4]}
    assert sorted(map(tuple, shelves.read("vectors").collect()), key=lambda r: r[1]) == sorted(want.values(), key=lambda r: r[1])
    assert len(touched) <= 2


def test_a_hot_cookbook_is_several_files(spark, tmp_path):
    hot = spark.range(20000).select(F.lit(1).cast("bigint").alias("cookbook_id"), F.col("id").alias("recipe_id"))
    shelves = Shelves.create(spark, str(tmp_path / "hot"), {"dishes": hot}, BUCKETS)
    with_aqe = files(shelves)
    assert len(with_aqe) >= 1 and shelves.read("dishes").count() == 20000
    shelves.upsert("dishes", hot.limit(3), ["recipe_id"])
    assert shelves.read("dishes").count() == 20000
