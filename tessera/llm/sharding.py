"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards, each with a weight. A key descends from the root:
at each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the key and the
child's name, and the smallest draw wins. A child's draw depends on its own weight alone,
so a changed weight moves keys only into or out of that child, and a change that leaves
the weight of a subtree's root as it was moves keys only within that subtree.

A new shard enters as a region of its own: it takes rows from everywhere into itself and
moves none between the others. Slots number the rows of a shard without gaps in the order
of a hash: rows fall into ``BUCKETS`` hash ranges a shard, small counts give each range its
first slot, and a window numbers the rows within a range. No task holds a whole shard.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import key_text, md5_unit

#: Hash ranges a shard: three hexadecimal digits.
BUCKETS = 16**3


@dataclass(frozen=True)
class Tree:
    """``children`` maps a node's name ("" for the root) to (name, weight) pairs; leaves are shard numbers."""

    children: dict[str, list[tuple[str, float]]]

    def shards(self) -> list[int]:
        return sorted(int(name) for kids in self.children.values() for name, _ in kids if name not in self.children)


def tree(regions: list[list[list[tuple[int, float]]]]) -> Tree:
    """A tree from nested lists: regions of racks of (shard, weight). A node weighs what its shards weigh."""
    children: dict[str, list[tuple[str, float]]] = {"": []}
    for racks in regions:
        first = min(shard for rack in racks for shard, _ in rack)
        region = f"region{first}"
        children[region] = []
        for rack in racks:
            name = f"rack{min(shard for shard, _ in rack)}"
            children[name] = [(str(shard), float(w)) for shard, w in rack]
            children[region].append((name, float(sum(w for _, w in rack))))
        children[""].append((region, sum(w for _, w in children[region])))
    return Tree(children)


def balanced(shards: int, base: int = 16) -> Tree:
    """``shards`` equal shards: up to ``base`` in two regions of two racks, each later one a region of its own.

    So the trees for n and n + 1 shards (n >= base) differ by one region, and one more shard
    takes rows only into itself.
    """
    first = list(range(min(shards, base)))
    cut_ = lambda xs: [part for part in (xs[: (len(xs) + 1) // 2], xs[(len(xs) + 1) // 2 :]) if part]
    regions = [[[(s, 1.0) for s in rack] for rack in cut_(region)] for region in cut_(first)]
    return tree([*regions, *[[[(s, 1.0)]] for s in range(base, shards)]])


def shard_of(key: Column, t: Tree, seed: int = 0) -> Column:
    """The shard a key (text, not null) descends to."""
    levels = {name: [{"id": i, "w": w} for i, w in kids if w > 0] for name, kids in t.children.items()}
    kids = F.from_json(F.lit(json.dumps(levels)), "map<string,array<struct<id:string,w:double>>>")
    node: Column = F.lit("")
    for _ in range(3):
        draws = F.transform(
            F.element_at(kids, node),
            lambda c: F.struct((-F.log(md5_unit(str(seed), c["id"], key)) / c["w"]).alias("draw"), c["id"].alias("id")),
        )
        node = F.array_min(draws)["id"]
    return node.cast("int")


def shard(docs: DataFrame, shards: int = 16, grown: bool = True, t: Tree | None = None, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    ``size`` is the text's UTF-8 length plus 1 (null: 1), ``text_crc32`` its CRC-32 (null: that of
    no bytes, 0). The law is ``key``: the id and the tree decide. ``grown_shard`` is the shard under
    one more shard. A null id is a key of its own; equal ids share a shard; equal rows take
    consecutive slots. An empty table gives no rows. Other columns are not carried.
    """
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.length(bytes_) + 1).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
    )
    name = key_text(F.col("doc_id"))
    rows = rows.withColumns({
        "shard": shard_of(name, t or balanced(shards), seed),
        "grown_shard": shard_of(name, balanced(shards + 1), seed) if grown and t is None else F.lit(None).cast("int"),
        "place": F.md5(F.concat_ws("|", name, F.col("text_crc32").cast("string"), F.col("size").cast("string"))),
    })
    rows = rows.withColumn("bucket", F.substring("place", 1, 3))
    # shards x BUCKETS rows at most, whatever the input
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("place", "doc_id")
    rows = rows.withColumn("nth", F.row_number().over(within) - 1).join(F.broadcast(starts), ["shard", "bucket"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"), "grown_shard")
