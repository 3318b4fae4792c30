"""Session helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    The folder is the cluster's ``spark.checkpoint.dir``. A local session without one (tests) gets a folder of its
    own; elsewhere that is an error, as executors could not share it.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="corpusloom-"))
    return df.checkpoint(eager=True)


#: A key is hot when it holds more than this share of the rows, so at most 1/share keys can be hot.
HOT_SHARE = 1 / 256
#: Below so many rows a key is never worth a plan of its own.
HOT_LEAST = 50_000


def hot_keys(df: DataFrame, key: str) -> list:
    """The keys that hold more than ``HOT_SHARE`` of the rows: at most 256 values, whatever the size of ``df``."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    floor = max(HOT_LEAST, int(df.count() * HOT_SHARE))
    return [r[0] for r in counts.where(F.col("count") > floor).collect()]


def lookup(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Left join against a table with unique keys, safe against hot and null keys.

    Rows whose key is null never enter the exchange, rows of a hot key meet a broadcast of the (at most
    256) looked-up rows, and all others take the ordinary shuffled join.
    """
    hot = hot_keys(left, key)
    k = F.col(key)
    is_hot = k.isin(hot) if hot else F.lit(False)
    plain = left.where(k.isNotNull() & ~is_hot).join(right, k == F.col(right_key), "left")
    none = left.where(k.isNull())
    for f in right.schema.fields:
        none = none.withColumn(f.name, F.lit(None).cast(f.dataType))
    out = plain.unionByName(none)
    if hot:
        few = right.where(F.col(right_key).isin(hot))
        out = out.unionByName(left.where(is_hot).join(F.broadcast(few), k == F.col(right_key), "left"))
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartitioned by keys to the session's number of shuffle partitions.

    For groups that go to Python: their rows are few but take long, and a plan that looks at bytes alone would
    put them into one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def ample(df: DataFrame, key: str) -> DataFrame:
    """``df`` in at least as many partitions as tasks can run at once.

    For work in Python over a table that has fewer (a small file, or one that cannot be split); larger tables are
    left as they are read and not shuffled.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, key)


def number(df: DataFrame, order: list[str], first: int, name: str = "id") -> DataFrame:
    """``df`` with running numbers from ``first`` in the order of columns that tell all rows apart.

    The rows are sorted over all partitions and numbered within each behind what goes before it, so the numbers are
    the same in every run and no task holds more than its part.
    """
    rows = cut(df.drop(name).orderBy(*order)).withColumn("_part", F.spark_partition_id())
    sizes = {r[0]: r[1] for r in rows.groupBy("_part").count().collect()}  # one row for each partition
    start, at = {}, first
    for k in sorted(sizes):
        start[k] = at
        at += sizes[k]
    within = F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)
    begin = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("_part")) if start else F.lit(first)
    return rows.withColumn(name, (begin + within).cast("long")).drop("_part")
