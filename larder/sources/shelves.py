"""Stored tables of the library, changed one cookbook at a time.

Every table is a folder of Parquet files, parted by a bucket of the cookbook that a row belongs to;
child tables (index names, toggles, vectors) carry the cookbook of their recipe and lie in the same
bucket as it. A change reads and rewrites the buckets of the cookbooks it names, by dynamic partition
overwrite, and leaves all other files alone. A bucket that loses its last row is rewritten too, as
each rewritten bucket holds a marker row that readers skip.

Changes are functions of what is stored and what is new, so one that runs again gives the same tables.
Children are written before their parents: after a failure between two tables the change is run again.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

BUCKETS = 64
OWNER = "cookbook_id"
BUCKET, LIVE = "bucket", "is_row"
# Tasks that a bucket's rows are spread over when it is written; a large cookbook is not one task.
SPREAD = 8


def bucket_of(owner: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(buckets)).cast("int")


class Shelves:
    """Tables below ``root``; the bucket count is fixed when they are created.

    ``tables`` gives each table's schema in the order in which changes write them, parents last.
    Each has a column ``cookbook_id``; rows whose cookbook is NULL lie in a bucket of their own kind.
    """

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, StructType], buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.tables = dict(tables)

    @classmethod
    def create(cls, spark: SparkSession, root: str, tables: Mapping[str, DataFrame], buckets: int = BUCKETS) -> Shelves:
        """Write ``tables`` as new folders; children first in the mapping, parents last."""
        shelves = cls(spark, root, {name: df.schema for name, df in tables.items()}, buckets)
        for name, df in tables.items():
            shelves._write(name, shelves._placed(df), overwrite=False)
        return shelves

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        """The rows of a table as they are now."""
        return self._files(name).where(LIVE).select(*self.tables[name].names)

    def replace(self, new: Mapping[str, DataFrame], owners: DataFrame | None = None) -> list[int]:
        """Rows of ``new`` replace all rows of their cookbooks, in every table; returns the buckets touched.

        Cookbooks are those of ``owners``, by default those of the last table in ``new`` (the parents). Tables
        that ``new`` does not name lose their rows of these cookbooks. Rows of other cookbooks in ``new`` are not stored.
        """
        if owners is None:
            owners = new[[name for name in self.tables if name in new][-1]]
        return self._change(owners, lambda name: new.get(name))

    def delete(self, owners: DataFrame) -> list[int]:
        """Drop the cookbooks of ``owners`` from every table."""
        return self._change(owners, lambda name: None)

    def upsert(self, name: str, rows: DataFrame, keys: Iterable[str]) -> list[int]:
        """Rows of ``rows`` replace those with equal keys and are added where there are none.

        A key belongs to one cookbook. Of rows of ``rows`` with equal keys one stays, the greatest by all columns that
        can be ordered.
        """
        keys = list(dict.fromkeys([OWNER, *keys]))
        names = self.tables[name].names
        rest = [c for c in names if c not in keys]
        one = rows.select(*names).groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_rest")) if rest else rows.select(*keys).distinct()
        one = one.select(*[F.col(c) if c in keys else F.col("_rest")[c].alias(c) for c in names])
        touched = self._touched(rows)
        known = [F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in keys]
        condition = known[0]
        for more in known[1:]:
            condition = condition & more
        marks = rows.select(*[F.col(c).alias(f"_new_{c}") for c in keys]).distinct()
        kept = self._stored(name, touched).join(marks, condition, "left_anti")
        self._rewrite(name, kept.unionByName(one), touched)
        return touched

    # --- how ---------------------------------------------------------------------------------

    def _files(self, name: str) -> DataFrame:
        schema = StructType(list(self.tables[name].fields)).add(LIVE, BooleanType()).add(BUCKET, IntegerType())
        return self.spark.read.schema(schema).parquet(self.path(name))

    def _stored(self, name: str, touched: list[int]) -> DataFrame:
        """Rows of some buckets; the others' folders are not listed for reading."""
        return self._files(name).where(F.col(BUCKET).isin(touched) & F.col(LIVE)).select(*self.tables[name].names)

    def _touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows' cookbooks: numbers below the bucket count."""
        return sorted(r[0] for r in rows.select(bucket_of(F.col(OWNER), self.buckets)).distinct().collect())

    def _change(self, owners: DataFrame, new) -> list[int]:
        named = owners.select(OWNER).distinct()
        touched = self._touched(named)
        gone = named.select(F.col(OWNER).alias("_gone"))
        match = F.col(OWNER).eqNullSafe(F.col("_gone"))
        for name in self.tables:
            rows = self._stored(name, touched).join(gone, match, "left_anti")
            added = new(name)
            if added is not None:
                rows = rows.unionByName(added.select(*self.tables[name].names).join(gone, match, "left_semi"))
            self._rewrite(name, rows, touched)
        return touched

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select("*", F.lit(True).alias(LIVE), bucket_of(F.col(OWNER), self.buckets).alias(BUCKET))

    def _rewrite(self, name: str, rows: DataFrame, touched: list[int]) -> None:
        if not touched:
            return
        nothing = [F.lit(None).cast(field.dataType).alias(field.name) for field in self.tables[name].fields]
        marks = self.spark.range(1).select(
            *nothing, F.lit(False).alias(LIVE), F.explode(F.array(*[F.lit(b) for b in touched])).alias(BUCKET)
        )
        self._write(name, self._placed(rows).unionByName(marks), overwrite=True)

    def _write(self, name: str, rows: DataFrame, overwrite: bool) -> None:
        # Rows of a bucket meet in some tasks, so that it is a few files and a large one is no single task's work.
        spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in (LIVE, BUCKET)]), F.lit(SPREAD))
        writer = rows.repartition(F.col(BUCKET), spread).write.partitionBy(BUCKET)
        if overwrite:
            writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.parquet(self.path(name))
