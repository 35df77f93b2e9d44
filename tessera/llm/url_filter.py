"""URL rules decided through a Bloom filter cascade.

Level 0 encodes the listed keys. Level 1 encodes the keys of the corpus that level 0
wrongly accepts, level 2 the listed keys that level 1 wrongly accepts, and so on until a
level accepts nothing wrongly. A key of the corpus is listed exactly if the first level
that rejects it is an odd one, so over the key universe the cascade was built for
membership is exact and a probe is a few bit tests: no join, no shuffle.

Everything runs as DataFrame expressions. The bits of a level are collected as one
array of longs whose size follows the listed keys (never the corpus); a list whose
level 0 would pass ``MAX_BITS`` is answered by a shuffled semi join instead.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Bits a level may have before the list is held as a table and joined (16 MB).
MAX_BITS = 1 << 27
#: Wrongly accepted share of the universe at level 0, and at each later level.
FIRST_RATE, LATER_RATE = 1 / 256, 1 / 2

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` are 64-bit words, ``hashes`` draws per key."""

    words: tuple[int, ...]
    hashes: int
    salt: int

    def accepts(self, key: Column) -> Column:
        """True where every bit of ``key`` is set. ``key`` must not be null."""
        bits = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")

        def all_set(words: Column) -> Column:
            found = F.lit(True)
            for place in places(key, len(self.words) * 64, self.hashes, self.salt):
                found = found & (F.getbit(F.get(words, F.floor(place / 64).cast("int")), (place % 64).cast("int")) == 1)
            return found

        # an array of one array names the words, which so stand in the plan once
        return F.exists(F.array(bits), all_set)


def places(key: Column, m: int, hashes: int, salt: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(salt * 64 + i), key), F.lit(m)) for i in range(hashes)]


def level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """The Bloom filter of ``keys`` (column ``key``, ``n`` rows) with the given error rate."""
    m = max(64, 64 * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(-math.log2(rate)))
    at = F.explode(F.array(*places(F.col("key"), m, hashes, salt)))
    rows = (
        keys.select(at.alias("at"))
        .groupBy(F.floor(F.col("at") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
        .collect()
    )
    bits = {r["word"]: r["bits"] for r in rows}
    return Level(tuple(bits.get(i, 0) for i in range(m // 64)), hashes, salt)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact membership for any key of the universe; null is never a member."""
        verdict = F.lit(len(self.levels) % 2 == 1)  # accepted by all levels
        for i in reversed(range(len(self.levels))):
            verdict = F.when(self.levels[i].accepts(key), verdict).otherwise(F.lit(i % 2 == 1))
        return F.coalesce(key.isNotNull() & verdict, F.lit(False))


def build(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """A cascade for the keys ``listed`` against all keys of ``universe`` (both: column ``key``).

    The universe is scanned once, against level 0; later levels see only the keys that
    are still wrong. Null keys take no part; repeated ones count once. Returns None if
    level 0 would pass ``MAX_BITS``. An empty list gives a cascade that holds nothing.
    """
    listed = listed.where("key is not null").select("key").distinct()
    n = listed.count()
    if n * -math.log2(FIRST_RATE) * 1.45 > MAX_BITS:
        return None
    if not n:
        return Cascade(())
    levels = [level(listed, n, FIRST_RATE, 0)]
    wrong = universe.where(F.col("key").isNotNull() & levels[0].accepts(F.col("key"))).select("key").distinct()
    wrong = cut(wrong.join(listed, "key", "left_anti"))
    right = listed
    while n := wrong.count():
        if n * -math.log2(LATER_RATE) * 1.45 > MAX_BITS:
            return None
        levels.append(level(wrong, n, LATER_RATE, len(levels)))
        right, wrong = wrong, right.where(levels[-1].accepts(F.col("key")))
    return Cascade(tuple(levels))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.substring_index(F.translate(rest, "?#", "//"), "/", 1)
    return F.coalesce(F.translate(host, ASCII_UPPER, ASCII_UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.substring_index(F.translate(rest, "?#", "//"), "/", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.coalesce(F.substring_index(F.translate(tail, "#", "?"), "?", 1), F.lit(""))


def judge(pages: DataFrame, rules: dict[str, str], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` maps ``host + path`` (like ``net/es/``) to ``allow`` or ``block``. A rule fits
    its host and all subdomains where the url's path starts with the rule's path; the
    longest that fits decides. The candidate keys of a url are its host suffixes and
    prefixes of its path with as many labels and characters as some rule has, so a host of
    many labels has no more keys than the rules have shapes; the rule of a url is its
    longest candidate in the cascade. A url without one is ``default``: the cascade proves
    that none of its keys is listed.

    Null, empty and ``://``-less urls have empty host and path and no rule. Columns of
    ``pages`` named like the new ones are replaced. No rules: all ``default``.
    """
    spark = pages.sparkSession
    shapes = sorted({(r[: r.index("/")].count(".") + 1, len(r) - r.index("/")) for r in rules})
    framed = pages.drop(*[c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict", "keys_", "labels_")])
    framed = framed.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    fits = F.filter(
        F.from_json(F.lit(json.dumps([{"n": n, "m": m} for n, m in shapes])), "array<struct<n:int,m:int>>"),
        lambda x: (x["n"] <= F.col("labels_")) & (x["m"] <= F.length("path")),
    )
    key = lambda x: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -x["n"]), F.col("path").substr(F.lit(1), x["m"]))
    framed = framed.withColumn("labels_", F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1)
    keys = F.when(F.col("host") != "", F.transform(fits, key)).otherwise(F.array().cast("array<string>"))
    framed = framed.withColumn("keys_", keys).drop("labels_")
    listed = spark.createDataFrame([(r,) for r in rules], "key string")
    cascade = build(listed, framed.select(F.explode("keys_").alias("key")))
    if cascade is None:
        return _joined(framed, spark.createDataFrame(list(rules.items()), "rule string, verdict string"), default)
    hits = F.filter("keys_", cascade.contains)
    best = F.get(F.array_sort(hits, lambda a, b: F.length(b) - F.length(a)), F.lit(0))
    blocked = [r for r, v in rules.items() if v == "block"]
    verdict = F.when(F.col("rule").isNull(), default).when(_in(F.col("rule"), blocked), "block").otherwise("allow")
    return framed.withColumn("rule", best).withColumn("verdict", verdict).drop("keys_")


def _in(col: Column, values: list[str]) -> Column:
    return col.isin(values) if values else F.lit(False)


def _joined(framed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The way for lists beyond ``MAX_BITS``: each page's longest listed key by a shuffled join."""
    row = F.monotonically_increasing_id()
    rows = cut(framed.withColumn("row_", row))
    hits = rows.select("row_", F.explode("keys_").alias("rule")).hint("shuffle_hash").join(rules, "rule")
    best = hits.groupBy("row_").agg(F.max_by(F.struct("rule", "verdict"), F.length("rule")).alias("best_"))
    out = rows.join(best, "row_", "left")
    return out.withColumns({"rule": F.col("best_.rule"), "verdict": F.coalesce("best_.verdict", F.lit(default))}).drop("row_", "best_", "keys_")
