"""Held-out folds and bounded training samples shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, md5_unit, small

FOLDS = 5
#: Text bytes of a sample over all labels; many labels share it, so each still has some.
MOST_BYTES = 64_000_000
#: Rows of a label that are ranked: so many times those wanted, and so many more; fewer than wanted never come.
SPARE, LEAST_RANKED = 4, 100


def remainder(key: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(remainder(key) == 0, F.lit(False))


def learnable(rows: DataFrame, label: str) -> DataFrame:
    """(doc_id, ``label``) of the labelled rows outside the held-out fold."""
    return rows.where((remainder() != 0) & F.col(label).isNotNull()).select("doc_id", label)


def sample(rows: DataFrame, docs: DataFrame, label: str, per_label: int, max_bytes: int) -> list[tuple[object, str]]:
    """At most ``per_label`` (label, text) pairs of each label, ``max_bytes`` of text in all a label.

    ``rows`` has doc_id and ``label``; only rows outside the held-out fold with a label take part, by
    the order of a hash of their ids, and of them those with a text give whole texts while a label's
    bytes last. Every label is there, however many there are: with more than ``MOST_BYTES`` /
    ``max_bytes`` labels each has an equal share of ``MOST_BYTES``, and its first text in any case.
    Repeated rows count once; of an id's texts the longest is taken. Texts are read for picked ids only.
    """
    known = learnable(rows, label).withColumn("u", md5_unit("sample", F.col("doc_id").cast("string")))
    # by the labels' counts, far more than the first rows of each pass; so a label's task sees few, however many there are
    counts = cut(known.groupBy(F.col(label).alias("of")).count())
    known = known.join(small(counts), F.col(label) == F.col("of")).where(F.col("u") * F.col("count") <= SPARE * per_label + LEAST_RANKED)
    nth = F.dense_rank().over(Window.partitionBy(label).orderBy("u", "doc_id"))
    first = cut(known.withColumn("nth", nth).where(F.col("nth") <= per_label).select("doc_id", label, "nth").distinct())
    labels = first.select(label).distinct().count()
    ids = first.select(F.col("doc_id").alias("id")).distinct()
    texts = docs.where(F.col("text").isNotNull())
    of = texts.join(small(ids), F.col("doc_id") == F.col("id")).groupBy("id").agg(F.max(F.struct(F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"))).alias("t"))
    upto = F.sum("t.n").over(Window.partitionBy(label).orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    least = F.min("nth").over(Window.partitionBy(label))
    most = min(max_bytes, MOST_BYTES // max(1, labels))
    sized = first.join(of, F.col("doc_id") == F.col("id")).withColumns({"upto": upto, "least": least})
    picked = cut(sized.where((F.col("upto") <= most) | (F.col("nth") == F.col("least"))).select("id", F.col("t.h").alias("h"), F.col(label).alias("value")))
    found = texts.join(small(picked), (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("h"))).select("value", "id", "text")
    return [(value, text) for value, _, text in sorted({tuple(r) for r in found.collect()})]
