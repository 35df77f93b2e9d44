"""A training-corpus pipeline over ``documents``: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's ``docs``. All but the last return exactly the columns of their input, so
null ids and texts, repeated rows, empty tables and further columns pass as each operator
documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, sentencepieces, simhash, toxicity
from tessera.llm.common import slices, table, written
from tessera.llm.queries import MIX_WEIGHTS

#: No SQL: the stages score with trained models and hash sketches. Each is tested against a plain version (tests/llm/test_pipeline.py).
ORACLE_SQL = None
#: A text is rejected below this posterior.
MIN_SCORE = 0.5


#: Arrow batches of this application: whole texts pass through them, and a task holds several copies of one.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def configured(spark: SparkSession) -> SparkSession:
    """The session with this application's Arrow batches."""
    for name, value in BATCH.items():
        spark.conf.set(name, value)
    return spark


def judged(decide: Callable[[list[str | None]], list[bool]]) -> Callable[[str], Column]:
    """A column function over texts, taken in small slices of Spark's Arrow batches."""

    @F.arrow_udf("boolean")
    def fine(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            parts = slices(iter([pa.record_batch([part], names=["text"])]), 0)
            yield pa.array([x for b in parts for x in decide(b.column(0).to_pylist())], pa.bool_())

    return fine


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learnt language; rejects null, letterless and ambiguous ones, and what no language codes as its own texts.

    A text alone decides, so repeated rows stay or go together; other columns are carried.
    """
    shared = configured(spark).sparkContext.broadcast(langid.train(docs))
    fine = judged(lambda texts: langid.spoken(texts, shared.value, MIN_SCORE))
    return docs.where(fine("text"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the tagger scores below one half; a null text counts as an empty one.

    A text alone decides, so repeated rows stay or go together; other columns are carried.
    """
    shared = configured(spark).sparkContext.broadcast(toxicity.train(docs, table(spark, sf_dir, "labels")))
    fine = judged(lambda texts: [score < 0.5 for score, _ in toxicity.tag(texts, shared.value)])
    return docs.where(fine("text"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five-word shingles: that with the smallest id.

    Null and empty texts are one group; repeated rows are one document; other columns are carried.
    """
    configured(spark)
    return simhash.deduplicate(docs, radius=3, shingle=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights of their sources, in random order.

    Repeated rows have equal counts; a null source is a source; other columns are carried.
    """
    return mixing.mix(docs, MIX_WEIGHTS).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of every remaining row, repeated ones too; a null text has no ids."""
    configured(spark)
    return sentencepieces.encode(docs).select("doc_id", "ids", "n_tokens")


STAGES = [("language_id", language), ("toxicity", toxic), ("simhash_dedup", deduplicated), ("mixing", mixed), ("sentencepiece", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
