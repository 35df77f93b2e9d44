"""Mixing sources to target weights by Poisson replication.

Source s with n_s of N documents and target share w_s has the mean repetition rate
N * w_s / n_s. Each document's count is a Poisson draw at that rate, found by inverting the
distribution at a uniform number hashed from the seed and the document's id, so it depends
on nothing else in its partition and a lost task repeats it exactly. A document appears as
often as its count says, and a shuffle into ranges of a hash of id and copy number orders all
copies at random.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, key_text, md5_unit

#: Sources whose rates are held as one literal map; beyond it they are joined, salted.
MAX_SOURCES = 10_000
SALTS = 64
#: A draw with a larger mean is the sum of draws with means up to this.
MAX_MEAN = 500.0
#: Copies of a document that are made at once.
COPIES = 1024


def poisson(u: Column, mean: Column) -> Column:
    """The smallest k with P(X <= k) >= u for X ~ Poisson(mean); mean at most ``MAX_MEAN``."""
    zero = F.exp(-mean)
    start = F.struct(F.lit(0).alias("k"), zero.alias("p"), zero.alias("c"))

    def step(s: Column, _: Column) -> Column:
        p = s["p"] * mean / (s["k"] + 1)
        return F.when(u > s["c"], F.struct((s["k"] + 1).alias("k"), p.alias("p"), (s["c"] + p).alias("c"))).otherwise(s)

    most = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["k"])


def count_of(key: Column, mean: Column, seed: int) -> Column:
    """A Poisson count hashed from ``key``; large means are split into equal parts and summed."""
    parts = F.greatest(F.lit(1), F.ceil(mean / MAX_MEAN).cast("int"))
    draw = lambda j: poisson(md5_unit(str(seed), j.cast("string"), key), mean / parts)
    drawn = F.aggregate(F.transform(F.sequence(F.lit(1), parts), draw), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when(mean > 0, drawn).otherwise(0)


def rates(docs: DataFrame, weights: dict[str, float], rest: float, source: str = "source") -> DataFrame:
    """(source, rate) for each source; null is the source ``null``. Weights are relative; others have ``rest``."""
    name = key_text(F.col(source))
    per = docs.groupBy(name.alias("source")).count()
    given = F.from_json(F.lit(json.dumps(weights)), "map<string,double>")
    per = per.withColumn("weight", F.coalesce(F.try_element_at(given, F.col("source")), F.lit(float(rest))))
    total = per.agg(F.sum("count").alias("n"), F.sum("weight").alias("w")).first()
    n, w = total["n"] or 0, total["w"] or 1.0
    return per.select("source", (F.lit(float(n)) * F.col("weight") / (F.lit(float(w)) * F.col("count"))).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float], rest: float = 1.0, seed: int = 0, key: str = "doc_id", source: str = "source", names: dict[str, str] | None = None) -> DataFrame:
    """``docs``, each row as often as its Poisson count, in a global random order.

    Adds ``rate``, ``copies``, ``copy`` (from 0) and ``order_key``, under names of their own if
    ``docs`` has such columns; ``names``, if given, is filled with the names used. Rows with
    count 0 are absent. A null source is a source; rows with equal ids have equal counts; an
    empty table stays empty; a source with weight 0 gives no rows.
    """
    new = {c: fresh(docs, c) for c in ("rate", "copies", "copy", "order_key")}
    if names is not None:
        names.update(new)
    per = rates(docs, weights, rest, source)
    known = per.limit(MAX_SOURCES + 1).collect()
    name, id_ = key_text(F.col(source)), key_text(F.col(key))
    if len(known) <= MAX_SOURCES:
        rate = F.try_element_at(F.from_json(F.lit(json.dumps({r["source"]: repr(r["rate"]) for r in known})), "map<string,string>"), name).cast("double")
        rows = docs.withColumn(new["rate"], rate)
    else:
        salt, at = fresh(docs, "salt"), fresh(docs, "source_name")
        per = per.select(F.col("source").alias(at), F.col("rate").alias(new["rate"]), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
        rows = docs.withColumns({at: name, salt: F.pmod(F.xxhash64(id_), F.lit(SALTS)).cast("int")}).join(per, [at, salt]).drop(at, salt)
    rows = rows.withColumn(new["copies"], count_of(id_, F.col(new["rate"]), seed))
    # in two steps, so that no row holds an array of all its copies
    first = F.col(new["copy"]) * COPIES
    rows = rows.withColumn(new["copy"], F.explode(F.when(F.col(new["copies"]) > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col(new["copies"]) - 1) / COPIES)))))
    rows = rows.withColumn(new["copy"], F.explode(F.sequence(first, F.least(first + COPIES, F.col(new["copies"])) - 1)))
    rows = rows.withColumn(new["order_key"], F.md5(F.concat_ws("|", F.lit(f"order{seed}"), id_, F.col(new["copy"]).cast("string"))))
    # the keys are uniform, so equal ranges of their first digits are equal parts: no pass to sample them
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.shiftright(F.conv(F.substring(new["order_key"], 1, 8), 16, 10).cast("long") * parts, 32).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions(new["order_key"])
