"""The corpus pipeline: documents in, packed training sequences out.

quality        documents that the classifier rejects go; it learns from labels of documents not held out
near_copies    of each class of near copies one document stays
benchmark      documents contaminated with benchmark items go
personal_data  personal data and terms that give it away are replaced in the text; n_chars follows
packing        what is left is cut into sequences

Each stage works on all its predecessor kept, whatever other columns there are. Nulls, empty and repeated rows are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattscope.llm import decontam, jaccard, packing, pii, quality
from wattscope.llm.catalog import word_vocabulary
from wattscope.llm.common import held_out, new_folder, ready, table, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs.where(~held_out(3, 1)), table(spark, sf_dir, "labels"))
    name = unused(docs, "score")
    return quality.score(docs, model, name).where(F.col(name) >= 0.5).drop(name)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = unused(docs, "contamination")
    marked = decontam.mark(docs, table(spark, sf_dir, "benchmark"), name=name)
    return marked.where(~decontam.is_contaminated(name=name)).drop(name)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans, clean = unused(docs, "pii"), unused(docs, "clean")
    found = pii.find(docs, spans).withColumn(clean, F.when(F.size(spans) > 0, pii.sanitised(F.col("text"), F.col(spans))))
    changed = {"text": F.coalesce(clean, "text"),
               "n_chars": F.when(F.col(clean).isNotNull(), F.char_length(clean).cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*(changed[c].alias(c) if c in changed else c for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, word_vocabulary())


STAGES = [("quality", quality_stage), ("near_copies", near_copies_stage), ("benchmark", benchmark_stage),
          ("personal_data", personal_data_stage), ("packing", packing_stage)]

#: SQL can't learn the classifier of the first stage, nor tokenize in the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage is written and read again, so a lost executor costs one stage at most."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
