"""Helpers shared by the training-data operators: table access and shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares for cut lineage.

    Where none is named, a local session gets a temporary one; on a cluster that is an error, as executors would not
    see each other's files.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sievewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of an execution at its end, rather than when the driver's memory is collected.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Executions inside leave no shuffle files; only for those whose result nothing computes again."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def materialise(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back; returns it with its path."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that no later plan reads."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores after it as make it unlike every column of df (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_rid(docs: DataFrame, key: str = "doc_id", rid: str = "rid") -> DataFrame:
    """Adds a unique row id, a long that later scans give again, as the column `rid`, which docs must not have (see free_name).

    Where the key is unique and never null it is the id. Else (repeated rows, null keys) the rows are written
    once with a number each, as numbers given anew by each scan may differ after an executor is lost.
    """
    if rid.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {rid} of its own")
    if key in docs.columns:
        repeated = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())
        if is_empty(repeated):
            return docs.withColumn(rid, F.col(key).cast("long"))
    return materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")[0]


def hash_sample(df: DataFrame, size: int, *keys: str, total: int | None = None) -> DataFrame:
    """About `size` to twice as many rows, those whose keys hash below a bound; the same rows on each run. All, if there are fewer.

    Only rows of the sample leave a task, however many tasks there are.
    """
    total = df.count() if total is None else total
    if total <= size:
        return df
    bound = -(1 << 63) + int((1 << 64) * min(1.0, 1.5 * size / total)) - 1
    return df.where(F.xxhash64(*keys) <= bound)


_HELD: dict[tuple, object] = {}


def held(key: tuple, build):
    """What build() makes, kept in this process until another key is asked for: a worker that goes from one operator to the
    next holds the tables of one of them only."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
