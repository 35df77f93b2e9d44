r"""SimHash near-duplicate groups through covering locality-sensitive hashing.

A text's fingerprint is the SimHash of its word shingles. For radius r, every bit position
gets a non-zero vector of r + 1 bits, and each of the 2^(r+1) - 1 non-zero vectors v gives a
mask: the positions whose vector has odd product with v. For any r positions some v is
orthogonal to all their vectors, so two fingerprints that differ in at most those positions
agree under that mask: every pair within the radius meets in some table.

Equal fingerprints are merged first, so a group of copies is one row. A bucket with more
than ``CAP`` fingerprints is split by a second covering family over the bits its mask left
free, after which at most 2^(free bits) of them can meet (2^16 at radius 3). Buckets are
sorted streams of integers; each gives a spanning forest of its links, never its pairs.
Components are found by alternating large-star and small-star steps over those edges.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, cut_few, fresh, slices, small, written

SEED = 42
BITS = 64
#: Fingerprints a bucket may have before it is split.
CAP = 2048
#: Neighbours that make a node a hub, and the shares they are dealt into.
HUB, SALTS = 1000, 16
#: Min-wise views of near_duplicates(): VIEWS keys of ROWS minima each.
VIEWS, ROWS = 48, 6
#: Shingle hashes of one candidate cluster that a worker holds in memory; more go to a file.
HELD = 1 << 23


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words (fewer words: of the whole; no word: none)."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    begins = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1).tolist()[min(size, len(w)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begins, stops, strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash as a signed 64-bit integer; 0 for no hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view(np.int64)[0])


def covering(radius: int, positions: list[int], seed: int = 0) -> list[int]:
    """The masks of a covering family over ``positions``: every pair within ``radius`` agrees under one."""
    n = 1 << (radius + 1)
    order = np.random.default_rng(seed).permutation(positions).tolist()
    vector = {p: 1 + i % (n - 1) for i, p in enumerate(order)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tables(radius: int) -> list[int]:
    return covering(radius, list(range(BITS)))


def inner_tables(mask: int, radius: int) -> list[int]:
    """Finer masks for a bucket of ``mask``: it plus a covering of its free bits."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | m for m in covering(radius, free, seed=1)]


def links_within(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (<= radius bits) among distinct fingerprints, by breadth-first search."""
    left, edges = fps, []
    while len(left):
        root, frontier = int(left[0]), [left[0]]
        left = left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= radius
            if near.any():
                found = left[near]
                edges += [(int(f), root) for f in found]
                frontier += list(found)
                left = left[~near]
    return edges


def _grouped(batches: Iterator[pa.RecordBatch], groups: Callable[[np.ndarray], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Apply ``groups`` to each run of equal (t, k) in sorted batches of (t, k, id)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held = np.empty((0, 3), np.int64)

    def out(rows: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        edges = [e for part in np.split(rows[:, 2], ends) if len(part) > 1 for e in groups(part)]
        return pa.record_batch([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], schema=schema)

    for batch in batches:
        held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)])
        ends = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(1)) + 1
        if len(ends):
            yield out(held[: ends[-1]], ends[:-1])
            held = held[ends[-1] :]
    if len(held):
        yield out(held, np.empty(0, np.int64))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the component's smallest node.

    The neighbours of a node with more than ``HUB`` of them meet its minimum under ``SALTS`` salts.
    """

    def settle(e: DataFrame, most: int | None = None) -> tuple[DataFrame, tuple]:
        e = e.where("a <> b").distinct()
        e = cut(e) if most is None else cut_few(e, most)
        return e, tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, mark = settle(edges)
    while mark[0]:
        most = 2 * mark[0]  # no step makes more edges, or has more nodes
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"), F.count("*").alias("c"))
        least = cut_few(least.select("n", F.least("n", "m").alias("m"), "c"), most)
        hubs = least.where(F.col("c") > HUB).select(F.col("n").alias("hub"))
        ahead, salts = both.where("b > a").withColumn("s", F.lit(0)), F.array(F.lit(0))
        if hubs.limit(1).count():
            dealt = F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(0)
            ahead = ahead.join(small(hubs), F.col("a") == F.col("hub"), "left").withColumn("s", dealt)
            salts = F.when(F.col("c") > HUB, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(salts)
        every = least.withColumn("t", F.explode(salts))
        large, _ = settle(ahead.join(every, (F.col("a") == F.col("n")) & (F.col("s") == F.col("t"))).select(F.col("b").alias("a"), F.col("m").alias("b")), most)
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        rest = large.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now, new = settle(rest.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))), most)
        if new == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def alike(x: int, y: int | np.ndarray, both: int | np.ndarray) -> bool | np.ndarray:
    """Whether sets of x and y members, ``both`` of them shared, have a Jaccard similarity of 4/5 or more."""
    return 9 * both >= 4 * (x + y)


def similar_within(sizes: np.ndarray, flat: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (``alike``) among distinct sorted sets laid end to end, as places.

    Ordered from rare to common, two alike sets share one of their first n - ceil(4n/5) + 1 members, so
    only sets that do are compared; any fixed order makes this exact, so the counts may be hashed.
    """
    ends = np.cumsum(sizes)
    mask = np.uint64((1 << min(24, len(flat).bit_length() + 2)) - 1)
    counts = np.zeros(int(mask) + 1, np.int64)
    for i in range(0, len(flat), 1 << 20):
        counts += np.bincount((flat[i : i + (1 << 20)] & mask).astype(np.int64), minlength=len(counts))
    heads = []
    for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        h = np.asarray(flat[end - n : end])
        heads.append(h[np.lexsort((h, counts[(h & mask).astype(np.int64)]))[: n - (4 * n + 4) // 5 + 1]])
    mark = np.zeros(len(counts), bool)
    del counts
    owner = np.repeat(np.arange(len(sizes)), [len(h) for h in heads])
    token = np.concatenate(heads) if heads else np.empty(0, np.uint64)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    alive, left, listed, edges = np.ones(len(sizes), bool), len(sizes), len(sizes), []
    for root in range(len(sizes)):
        if not alive[root]:
            continue
        alive[root], left, frontier = False, left - 1, [root]
        while frontier and left:
            if 2 * left < listed:
                still = alive[owner]
                token, owner, listed = token[still], owner[still], left
            x = frontier.pop()
            low, high = (np.searchsorted(token, heads[x], side) for side in ("left", "right"))
            runs = high - low
            near = np.zeros(len(sizes), bool)
            near[owner[np.repeat(low - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())]] = True
            near = np.flatnonzero(near & alive)
            near = near[(5 * sizes[near] >= 4 * sizes[x]) & (5 * sizes[x] >= 4 * sizes[near])]
            if not len(near):
                continue
            own = np.asarray(flat[ends[x] - sizes[x] : ends[x]])
            mark[(own & mask).astype(np.int64)] = True
            for part in np.split(near, np.flatnonzero(np.diff(np.cumsum(sizes[near]) >> 20)) + 1):
                other = np.concatenate([flat[ends[y] - sizes[y] : ends[y]] for y in part.tolist()])
                most = np.add.reduceat(mark[(other & mask).astype(np.int64)], np.cumsum(sizes[part]) - sizes[part], dtype=np.int64)
                for y in part[alike(len(own), sizes[part], most)].tolist():  # an upper bound; now exactly
                    other = np.asarray(flat[ends[y] - sizes[y] : ends[y]])
                    both = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
                    if alike(len(own), len(other), both):
                        alive[y], left = False, left - 1
                        edges.append((y, root))
                        frontier.append(y)
            mark[(own & mask).astype(np.int64)] = False
    return edges


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): the links of each cluster, from batches of (cluster, node, shingles) sorted by cluster and node."""
    now, nodes, sizes, parts, file = None, [], [], [], None

    def out() -> pa.RecordBatch:
        flat = np.memmap(file, np.uint64, "r") if file else np.concatenate(parts)
        edges = similar_within(np.array(sizes, np.int64), flat)
        return pa.record_batch([pa.array([nodes[e[i]] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        ends = np.cumsum(np.diff(batch.column(2).offsets.to_numpy())).tolist()
        flat, begin = batch.column(2).flatten().to_numpy().view(np.uint64), 0
        for cluster, node, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends, strict=True):
            if cluster != now:
                if len(nodes) > 1:
                    yield out()
                now, nodes, sizes, parts, held, file = cluster, [], [], [], 0, None
            if not nodes or nodes[-1] != node:  # repeated rows come one after the other
                nodes.append(node)
                sizes.append(end - begin)
                held += end - begin
                parts.append(flat[begin:end].copy())
                if held > HELD:
                    file = file or tempfile.TemporaryFile()
                    file.write(b"".join(p.tobytes() for p in parts))
                    file.flush()
                    parts, held = [], HELD
            begin = end
    if len(nodes) > 1:
        yield out()


def _shingle_sets(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["cluster", "node", "shingles"])

    return run


def _fingerprints(shingle: int, views: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        mult = (rng.integers(0, 1 << 31, VIEWS * ROWS, dtype=np.uint32) << 1) | np.uint32(1)
        add = rng.integers(0, 1 << 32, VIEWS * ROWS, dtype=np.uint32)
        fold = (rng.integers(0, 1 << 62, ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        for batch in slices(batches, 1):
            key, texts = batch.column(0), batch.column(1)
            fps, nodes, keys = [], [], []
            for i in range(len(texts)):
                h = shingle_hashes(texts[i].as_py(), shingle)
                fps.append(fingerprint(h))
                if views:
                    nodes.append(_signed(xxhash.xxh64_intdigest(np.unique(h).tobytes(), SEED)))
                    keys.append(view_keys(h, mult, add, fold))
            cols = [key, pa.array(fps, pa.int64())]
            if views:
                cols += [pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.record_batch(cols, names=["doc", "fp", "node", "views"][: len(cols)])

    return run


def view_keys(h: np.ndarray, mult: np.ndarray, add: np.ndarray, fold: np.ndarray) -> list[int]:
    """One key a view: its ROWS minima over the hashes, folded into 64 bits. No hashes: no keys."""
    if not len(h):
        return []
    x = np.unique((h >> np.uint64(32)).astype(np.uint32))
    least = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, (x[i : i + 2048, None] * mult + add).min(0), out=least)
    wide = least.reshape(-1, len(fold)).astype(np.uint64)
    mixed = (wide + np.uint64(0x9E3779B97F4A7C15)) * fold
    mixed ^= mixed >> np.uint64(29)
    return (mixed * fold[::-1]).sum(1, dtype=np.uint64).view(np.int64).tolist()


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fp) of each row: its key and its SimHash as a signed long; null text like empty: 0."""
    slim = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    return slim.mapInArrow(_fingerprints(shingle, False), "doc long, fp long")


def _edges(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): spanning forests of the links among the distinct fingerprints (column fp)."""
    masks = [_signed(m) for m in tables(radius)]
    entry = lambda t, m: F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
    rows = distinct.select("fp", F.explode(F.array(*[entry(t, m) for t, m in enumerate(masks)])).alias("x")).select("x.t", "x.k", "fp")
    sizes = rows.groupBy("t", "k").count().where("count > 1")
    rows = rows.join(sizes, ["t", "k"])
    plain = rows.where(F.col("count") <= CAP).select("t", "k", "fp")
    inner = [[_signed(x) for x in inner_tables(m, radius)] for m in tables(radius)]
    finer = F.element_at(F.array(*[F.array(*[F.lit(x) for x in xs]) for xs in inner]), (F.col("t") + 1).cast("int"))
    split = rows.where(F.col("count") > CAP).select("t", "fp", F.posexplode(finer).alias("p", "m"))
    split = split.select(((F.col("t") + 1) * 64 + F.col("p")).alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("k"), "fp")
    forest = lambda batches: _grouped(batches, lambda part: links_within(part, radius))
    ordered = plain.union(split).repartition("t", "k").sortWithinPartitions("t", "k")
    return ordered.mapInArrow(forest, "a long, b long")


def group(docs: DataFrame, radius: int = 3, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs``.

    Fingerprints at most ``radius`` bits apart link; a component's id is its smallest id. Null and
    empty texts have fingerprint zero, which links like any other; null ids are never the
    smallest unless alone. Repeated rows are returned as often as they come; an empty table
    gives no rows. Ids must be integers; other columns are not carried.
    """
    fps = written(fingerprints(docs, shingle, key, text))
    distinct = fps.groupBy("fp").agg(F.min("doc").alias("least"))
    roots = components(_edges(distinct, radius))
    linked = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = linked.join(ids, "root").select("fp", "component_id")
    out = fps.join(of, "fp")
    return out.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = 3, shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with the columns of ``docs``.

    Two texts are near-duplicates if their sets of ``shingle`` words have a Jaccard similarity of 0.8 or
    more; a group is what such pairs connect. Candidates are what SimHash links within ``radius``
    bits and what agrees in one of ``VIEWS`` min-wise views (``ROWS`` minima each): a pair of
    similarity s meets with probability 1 - (1 - s^6)^48, and misses with 5e-7 at 0.8. Inside what the
    candidates connect, the shingle sets themselves are compared, so no other pair is a link.
    Kept is the smallest id, a null one last; of rows with equal ids the one with the smaller row hash, once.
    """
    row = fresh(docs, "row_hash")
    hashed = docs.withColumn(row, F.xxhash64(*[F.col(c) for c in docs.columns]))
    slim = hashed.select(F.struct(F.col(key).cast("long").alias("id"), F.col(row).alias("h")).alias("doc"), F.col(text).alias("text"))
    sketches = written(slim.mapInArrow(_fingerprints(shingle, True), "doc struct<id:long,h:long>, fp long, node long, views array<long>"))
    count = sketches.count()
    # equal shingle sets are one node
    distinct = written(sketches.groupBy("node", "views").agg(F.min("fp").alias("fp"), F.min(F.struct(F.col("doc.id").isNull(), "doc.id", "doc.h")).alias("least")))
    near = _edges(distinct.select("fp").distinct(), radius)
    hub = lambda fp, root: distinct.groupBy(F.col("fp").alias(fp)).agg(F.min("node").alias(root))
    # candidates: same fingerprint, linked fingerprints, same view; a bucket is a star around its smallest node
    star = lambda rows, key: rows.select(F.col("node").alias("a"), F.min("node").over(Window.partitionBy(key)).alias("b")).where("a <> b")
    fp_edges = near.select(F.col("a").alias("x"), F.col("b").alias("y")).join(hub("fp1", "a"), F.col("x") == F.col("fp1")).join(hub("fp2", "b"), F.col("y") == F.col("fp2")).select("a", "b")
    seen = distinct.select("node", F.posexplode("views").alias("v", "k")).select("node", F.xxhash64("v", "k").alias("view"))
    clusters = components(reduce(DataFrame.union, [star(distinct, "fp"), fp_edges, star(seen, "view")])).withColumnRenamed("root", "cluster")
    # links: the shingle sets of each cluster, from one text a node
    members = distinct.select(F.col("node").alias("own"), F.col("least.id").alias("id"), F.col("least.h").alias("h")).join(clusters, F.col("own") == F.col("node")).select("id", "h", "cluster", "node")
    sets = slim.join(small(cut_few(members, count)), (F.col("doc.h") == F.col("h")) & F.col("doc.id").eqNullSafe(F.col("id"))).select("cluster", "node", "text")
    sets = sets.mapInArrow(_shingle_sets(shingle), "cluster long, node long, shingles array<long>")
    roots = components(sets.repartition("cluster").sortWithinPartitions("cluster", "node").mapInArrow(_verified, "a long, b long"))
    linked = distinct.select(F.col("node").alias("own"), "least").join(roots, F.col("own") == F.col("node"), "left").select("least", F.coalesce("root", "own").alias("root"))
    kept = linked.groupBy("root").agg(F.min("least").alias("m")).select(F.col("m.id").alias("kept_id"), F.col("m.h").alias("kept_hash"))
    # by id and row hash: the rows that go, and of those that stay the repeated ones; the texts of all others cross no shuffle
    rows = sketches.groupBy("doc").count().select(F.col("doc.id").alias("id"), F.col("doc.h").alias("h"), "count")
    gone = small(cut_few(rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_hash")), "left_anti").select("id", "h"), count))
    repeated = small(cut_few(rows.where("count > 1").select("id", "h"), count))
    same = lambda df, other: (df[row] == other["h"]) & df[key].cast("long").eqNullSafe(other["id"])
    out = hashed.join(gone, same(hashed, gone), "left_anti")
    twice = out.join(repeated, same(out, repeated), "left_semi").dropDuplicates([row])
    return out.join(repeated, same(out, repeated), "left_anti").union(twice).select(*docs.columns)
