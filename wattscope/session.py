"""Session defaults the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    # Days and windows are UTC everywhere.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Re-running a day replaces that day only.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Chained stateful streaming operators and transformWithState.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Counting its rows costs the store a look-up for every write.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def build_session(app: str = "wattscope", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings above; sizes (memory, shuffle partitions) come from ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests) gets a temporary one where none is named: on a cluster a
    machine's own folder would be lost with the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/wattscope-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of this application; all of them go with ``release``, at the latest when the driver ends."""
    own = _application_folder(spark)
    if own not in _known:
        _known.add(own)
        path, files = hadoop_files(spark, own)
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{own}/{label}-{uuid.uuid4().hex}"


_known: set[str] = set()


def hadoop_files(spark: SparkSession, folder: str):
    """A path and the file system it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application now; frames that read them can't be used any more."""
    own = _application_folder(spark)
    path, files = hadoop_files(spark, own)
    files.delete(path, True)
    _known.discard(own)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    For a reduced set that several branches of a plan read: the input behind it is scanned
    once, and losing an executor later repeats only what comes after.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
