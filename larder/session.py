"""Session set-up and lineage cutting shared by the jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "larder", cores: str = "*", **conf: str) -> SparkSession:
    """Local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    ``spark.checkpoint.dir`` wins. A temporary folder is used only by a local master that
    names none, as in tests; a cluster must name a shared one.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="larder-checkpoint-")
    context.setCheckpointDir(named)
    return named


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of few splits, such as one small file of long texts.

    A large input has more splits than the session has cores and is left as it is.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by key for dear work on few bytes, whose partitions adaptive execution would merge."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


# Rows that one task of a keyed step is given, about.
TASK_ROWS = 250_000


def sized(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal rows out by key to tasks of bounded size: with more rows come more tasks, not larger ones.

    ``rows`` is about how many rows the step works on. Steps on these keys or on more of them then need no other exchange.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartition(n, *keys)


def computed_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a dear column that later filters read without computing it again.

    A filter on a projected column is pushed below the projection together with its expression;
    it cannot pass a generator, so the column is generated as a one-element array.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back, so recomputing starts there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and read it back: compressed, where a checkpoint holds whole rows.

    What its writing shuffled is deleted at once, not when the driver happens to collect its garbage. Partitioning and order
    are not known to what reads it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)
