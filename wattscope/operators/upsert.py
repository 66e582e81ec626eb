"""Insert-or-replace by key."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattscope.operators.pick import first_per_key
from wattscope.session import hadoop_files, materialize


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Stored rows whose key does not arrive, and one row of each key that does.

    Of incoming rows with the same key the first in ``order`` counts; without one, the row whose other
    columns are largest, compared one after the other, so that the outcome does not hang on arrival.
    """
    rest = order or [F.desc(c) for c in incoming.columns if c not in keys]
    incoming = first_per_key(incoming, keys, rest) if rest else incoming.dropDuplicates(keys)
    return stored.join(incoming, keys, "left_anti").unionByName(incoming)


def read_table(spark: SparkSession, path: str, columns: T.StructType | str) -> DataFrame:
    """A Parquet table of declared columns; empty while nothing has been written."""
    try:
        return spark.read.schema(columns).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def upsert_partitions(incoming: DataFrame, path: str, keys: list[str], partition: str) -> None:
    """Upsert into a Parquet table partitioned by ``partition``, which must be one of ``keys``.

    Only the partitions that receive rows are read and replaced; writing the same rows again leaves the table as it is.
    """
    if partition not in keys:
        raise ValueError(f"{partition} must belong to the key {keys}")
    stored = _touched_partitions(incoming, path, partition)
    replace_partitions(upsert(incoming.where("false") if stored is None else stored, incoming, keys), path, [partition])


def _touched_partitions(incoming: DataFrame, path: str, partition: str) -> DataFrame | None:
    """What is stored in the partitions that rows arrive for; their folders are named, so no other is listed."""
    spark = incoming.sparkSession
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    # A handful of partition values (days).
    values = [r[0] for r in incoming.select(F.col(partition).cast("string")).distinct().collect()]
    folders = [f"{path}/{escaped(partition)}={'__HIVE_DEFAULT_PARTITION__' if v is None else escaped(v)}" for v in values]
    there = [f for f in folders if (at := hadoop_files(spark, f))[1].exists(at[0])]
    return spark.read.schema(incoming.schema).option("basePath", path).parquet(*there) if there else None


def upsert_files(incoming: DataFrame, path: str, keys: list[str], partition: str) -> int:
    """As ``upsert_partitions``, but only files that hold an arriving key are rewritten; how many those were.

    For tables of large partitions of which an upsert hits little. The new rows are written aside, then the list
    of files they replace; from then on the upsert is decided. It is carried out by moving the new files in and
    removing the old ones, and if that is cut short, the next upsert carries it out first. In between a reader
    may see rows twice, never too few; where that must not be, use ``upsert_partitions``.
    """
    if partition not in keys:
        raise ValueError(f"{partition} must belong to the key {keys}")
    spark = incoming.sparkSession
    recover(spark, path)
    aside = f"{path}/_upserts/{uuid.uuid4().hex}"
    rest = [F.desc(c) for c in incoming.columns if c not in keys]
    rows = materialize(first_per_key(incoming, keys, rest) if rest else incoming.dropDuplicates(keys), "upsert")
    stored = _touched_partitions(rows, path, partition)
    hit = spark.createDataFrame([], "name string")
    if stored is not None:
        named = stored.select("*", F.col("_metadata.file_path").alias("_file"))
        hit = materialize(named.join(rows.select(*keys), keys, "left_semi").select(F.col("_file").alias("name")).distinct(), "touched-files")
        kept = named.join(hit, named["_file"] == hit["name"], "left_semi").drop("_file")
        rows = kept.join(rows.select(*keys), keys, "left_anti").unionByName(rows)
    rows.write.partitionBy(partition).parquet(f"{aside}/new")
    hit.coalesce(1).write.parquet(f"{aside}/old")
    return _carry_out(spark, path, aside)


def recover(spark: SparkSession, path: str) -> None:
    """Carry out the upserts of a table that were decided and cut short; forget those that were not decided."""
    at, files = hadoop_files(spark, f"{path}/_upserts")
    for status in files.listStatus(at) if files.exists(at) else []:
        aside = status.getPath().toString()
        if files.exists(hadoop_files(spark, f"{aside}/old/_SUCCESS")[0]):
            _carry_out(spark, path, aside)
        else:
            files.delete(status.getPath(), True)


def _carry_out(spark: SparkSession, path: str, aside: str) -> int:
    new, files = hadoop_files(spark, f"{aside}/new")
    base, it, there = files.makeQualified(new).toString(), files.listFiles(new, True), []
    while it.hasNext():
        there.append(it.next().getPath())
    for file in there:
        name = file.toString()[len(base) + 1:]
        if not name.startswith("_"):
            to, _ = hadoop_files(spark, f"{path}/{name}")
            files.mkdirs(to.getParent())
            if not files.rename(file, to):
                raise OSError(f"{file} could not be moved to {to}")
    # Names of files of the touched partitions.
    old = [r["name"] for r in spark.read.schema("name string").parquet(f"{aside}/old").collect()]
    for name in old:
        files.delete(hadoop_files(spark, unquote(name))[0], False)
    files.delete(hadoop_files(spark, aside)[0], True)
    return len(old)


def replace_partitions(rows: DataFrame, path: str, partitions: list[str]) -> None:
    """Write ``rows``, replacing exactly the partitions they fall into."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partitions).parquet(path))
