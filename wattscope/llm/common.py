"""What the operators of this package share: session settings, scratch tables, tables by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattscope.session import materialize, new_folder, prepare

#: Rows in an Arrow batch. Texts may be long, so a batch is a few hundred of them, not ten thousand.
BATCH_ROWS = 256


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or that name with as many underscores behind it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document is held out, by the checksum of its id; a null id is never held out."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    return F.coalesce(rest == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, text, target`` of at most about ``most`` documents of either label (0, 1), and how many there are.

    Which documents are taken is decided on ids alone, by a hash, and texts are then read by a lookup of these
    ids, so no text of another document moves. A document labelled twice with different values has no known
    label. A rare label is taken whole.
    """
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.min(label).cast("int").alias("target"), F.max(label).cast("int").alias("other")).where("target = other")
             .select("doc_id", "target").join(docs.select("doc_id").distinct(), "doc_id"))
    counts = {r[0]: r[1] for r in known.groupBy("target").count().collect()}
    taken = bounded_sample(known, "target", most, counts).select(F.col("doc_id").alias("_id"), "target")
    own = docs.select("doc_id", "text")
    # At most about 2 * most ids, whatever the tables hold.
    return own.join(F.broadcast(taken), own["doc_id"] == taken["_id"]).select("doc_id", "text", "target"), counts


def bounded_sample(df: DataFrame, label: str, most: int, counts: dict | None = None) -> DataFrame:
    """About ``most`` rows of each value of ``label`` at most, chosen by a hash of doc_id.

    The share kept of each value follows from its count, so a rare value is taken whole.
    """
    if counts is None:
        counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        share = int(min(1.0, most / n) * 1_000_000)
        keep = F.when(F.col(label) == F.lit(value),
                      F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share).otherwise(keep)
    return df.where(keep)


__all__ = ["BATCH_ROWS", "bounded_sample", "held_out", "labelled_sample", "materialize", "new_folder", "ready", "table", "unused"]
