"""A training corpus from raw documents, in five stages.

Toxic documents go, then documents that the quality rules reject, then all but one document of each group
of near copies; what is left is mixed to the source targets and packed into sequences.  Each stage takes
(spark, docs, sf_dir), where docs is all that the stage before it kept, and returns a DataFrame; `run` writes
each result as Parquet in the shared folder and reads it again for the next stage.

Defined cases: a null or empty text has no words and goes with the quality rules; a null source is a source; rows without an
id are kept or dropped by their text alone; of equal rows one stays; labels that are null or lack an id are no
labels; an empty table stays empty; columns of any other name come through all stages but the last, whose columns are
those of the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaymark.llm import line_rules, mixing, ngram_join, packing, toxicity
from quaymark.llm.common import discard, keep, table


#: Rows that go to Python at a time.  A batch of whole texts is held by the JVM outside its heap and by the worker, a few times each.
BATCH = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have the session send at most `BATCH` rows to Python at a time; a smaller limit of the user's stays.

    It is set for the session, since the plans of the stages run after they have been returned; it changes no result.
    """
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH:
        spark.conf.set(_ROWS, str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.filter_documents(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return line_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs, held=60_000)  # executors have grown in the stages before


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, hashes and a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
