"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str | None:
    """The folder in spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster without one has none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        folder = "file://" + tempfile.mkdtemp(prefix="sievewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    return None


def path(spark: SparkSession, label: str) -> str | None:
    folder = root(spark)
    return folder and f"{folder}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table that later plans read; df itself where no folder is shared."""
    to = path(df.sparkSession, label)
    if to is None:
        return df
    schema = df.schema
    df.write.parquet(to)
    return df.sparkSession.read.schema(schema).parquet(to)


def bucketed(df: DataFrame, label: str, by: str) -> DataFrame:
    """As written, dealt by a column into buckets, which later plans that group or join by it read without a shuffle."""
    spark = df.sparkSession
    to = path(spark, label)
    if to is None:
        return df.repartition(by)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"scratch_{uuid.uuid4().hex}"
    df.repartition(n, by).write.format("parquet").bucketBy(n, by).sortBy(by).option("path", to).saveAsTable(table)
    return unnamed(spark, table)


def unnamed(spark: SparkSession, table: str) -> DataFrame:
    """A table over a folder of its own, without its name, which nothing else needs: the files stay."""
    df = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return df
