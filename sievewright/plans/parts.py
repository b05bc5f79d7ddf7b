"""Parts that many queries share: made once, kept as tables in the shared folder, read by all, in later sessions too.

A part lies under `<spark.checkpoint.dir>/parts/<name>/<input>/<state>`, where the state is a digest of time, size and number
of the files of the tables that it is made of (`reads`) and of the layout. A session that finds it reads it; if the files change, the
state is another, the part is made anew and the old one is removed. It is written aside and moved into place when it
is whole, so that a lost writer leaves nothing that is read, and of two writers the first wins.

A part may be bucketed: it is then read through a table over its folder, and operators that need rows of a key together read it
without a shuffle. In a local session without a folder a temporary one is used; on a cluster that names none, nothing is kept and
each query makes its own. What a query shares is made when the query is called, not when its result is read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import scratch

TABLES = ("documents", "benchmark")
#: Changes whenever kept parts of an earlier layout must not be read.
LAYOUT = 1
#: Bytes of input files for a bucket, about.
BUCKET_BYTES = 32_000_000


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def _state(spark: SparkSession, sf_dir: str, reads: tuple[str, ...]) -> tuple[str, int]:
    """A digest of time, size and number of the input files, and their bytes."""
    out, size = [LAYOUT], 0
    for name in reads:
        file = f"{sf_dir}/{name}.parquet"
        files = _files(spark, file)
        summary = files.getContentSummary(_path(spark, file))
        out.append((name, files.getFileStatus(_path(spark, file)).getModificationTime(), summary.getLength(), summary.getFileCount()))
        size += summary.getLength()
    return hashlib.md5(repr(out).encode()).hexdigest(), size


def buckets_of(spark: SparkSession, sf_dir: str, reads: tuple[str, ...]) -> int:
    return _buckets(spark, _state(spark, sf_dir, reads)[1])


def _buckets(spark: SparkSession, size: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def _put(spark: SparkSession, made: DataFrame, path: str, by: str | None, buckets: int) -> None:
    aside = f"{path}-{uuid.uuid4().hex}"
    writer = made.write.format("parquet")
    if by is None:
        writer.save(aside)
    else:
        table = f"part_{uuid.uuid4().hex}"
        writer.bucketBy(buckets, by).sortBy(by).option("path", aside).saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # the files of a table with a path stay
    files = _files(spark, path)
    if not files.rename(_path(spark, aside), _path(spark, path)) or files.exists(_path(spark, f"{path}/{aside.rsplit('/', 1)[1]}")):
        files.delete(_path(spark, aside), True)  # another session was first
        files.delete(_path(spark, f"{path}/{aside.rsplit('/', 1)[1]}"), True)


def _read(spark: SparkSession, path: str, by: str | None, buckets: int) -> DataFrame:
    if by is None:
        return spark.read.parquet(path)
    table = f"part_{uuid.uuid4().hex}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return scratch.unnamed(spark, table)


def part(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame], reads: tuple[str, ...] = TABLES, by: str | None = None) -> DataFrame:
    """The part `name` of an input folder, made of the tables `reads` by make(spark, sf_dir) where it isn't kept; bucketed by a column where one is given."""
    root = scratch.root(spark)
    if root is None:
        return make(spark, sf_dir)
    state, size = _state(spark, sf_dir, reads)
    buckets = _buckets(spark, size) if by else 0
    folder = f"{root}/parts/{name}/{hashlib.md5(sf_dir.encode()).hexdigest()}"
    path = f"{folder}/{state}-{buckets}"
    files = _files(spark, path)
    if not files.exists(_path(spark, f"{path}/_SUCCESS")):
        made = make(spark, sf_dir)
        files.mkdirs(_path(spark, folder))
        old = [s.getPath() for s in files.listStatus(_path(spark, folder))]
        _put(spark, made, path, by, buckets)
        for p in old:  # of the input as it was, or left by a lost writer
            if not p.getName().startswith(f"{state}-"):
                files.delete(p, True)
    return _read(spark, path, by, buckets)
