"""SimHash groups, top-k search and deduplication against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from tessera.llm import simhash, topk
from pyspark.sql import functions as F


def test_covering_masks_cover():
    masks = simhash.tables(3)
    rng = random.Random(1)
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not flips & m for m in masks)
    for mask in masks[:3]:
        inner = simhash.inner_tables(mask, 3)
        free = [i for i in range(64) if not mask >> i & 1]
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(free, 3))
            assert any(not flips & m for m in inner)


def plain_fingerprint(text):
    """The contract read word by word: a bit is 1 if more than half of the shingles' hashes have it."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                part[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted((d if d is not None else -1, f"{fps[i]:016x}", ids.get(find(i))) for i, (d, _) in enumerate(rows))


def texts():
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(900)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE  two"), (None, "null id text here"), (5, "null id text here"), (6, "x" * 50_000)]
    for i in range(60):
        words = list(base)
        words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((10 + i, " ".join(words)))
    rows += [(200 + i, " ".join(f"u{rng.randrange(10_000)}" for _ in range(50))) for i in range(40)]
    return rows + rows[7:9]


def test_groups(spark, monkeypatch):
    rows = texts()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    for cap, hub in ((2048, 1000), (4, 2)):  # the second splits buckets and salts hubs
        monkeypatch.setattr(simhash, "CAP", cap)
        monkeypatch.setattr(simhash, "HUB", hub)
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.group(df).collect())
        assert got == brute_groups(rows)
    assert simhash.group(df.limit(0)).count() == 0


def test_deduplicate_keeps_one_of_each_group(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, near = [], []
    for g in range(20):
        base = [word() for _ in range(200)]
        rows.append((g * 10, " ".join(base)))
        for c in range(3):
            words = list(base)
            for _ in range(2):
                words[rng.randrange(200)] = word()
            near.append((g * 10 + 1 + c, " ".join(words)))
    clean = [(1000 + i, " ".join(word() for _ in range(150))) for i in range(40)]
    all_rows = rows + near + clean + [clean[0], (2000, None), (2001, "")]
    df = spark.createDataFrame([(d, t, "c", 1, 2) for d, t in all_rows], "doc_id long, text string, row_hash string, h int, id int")
    out = simhash.deduplicate(df)
    assert out.columns == df.columns
    kept = [r.doc_id for r in out.collect()]
    assert len(kept) == len(set(kept))
    assert {d for d, _ in clean} <= set(kept) and {d for d, _ in rows} <= set(kept)
    assert len(set(kept) & {d for d, _ in near}) <= 2
    assert (2000 in kept) and 2001 not in kept


def brute_kept(rows):
    """The smallest id of what pairs with five-word shingle sets of Jaccard similarity 0.8 or more connect."""
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                part[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def test_deduplicate_compares_the_shingle_sets(spark, monkeypatch):
    """Pairs at 0.6, 0.7, 0.79, 0.8 and 0.9 by their number of shared shingles, chains, and nested bases."""
    rows, n = [], 0
    words = lambda k: [f"w{n}x{i}" for i in range(k)]
    for shared, total in ((60, 100), (70, 100), (79, 100), (80, 100), (90, 100), (4, 5), (3, 4)):
        for _ in range(12):
            n += 1
            text = words(total + 4)
            rows += [(len(rows), " ".join(text[: shared + 4])), (len(rows) + 1, " ".join(text))]
    for _ in range(6):  # neighbours at 0.9, the ends far apart
        n += 1
        text = words(164)
        rows += [(len(rows) + i, " ".join(text[5 * i : 5 * i + 100])) for i in range(12)]
    want = brute_kept(rows)
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    for held in (simhash.HELD, 50):  # the second keeps sets in files
        monkeypatch.setattr(simhash, "HELD", held)
        assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == want


def test_similar_within_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        sets = list({np.unique(np.concatenate([base[rng.random(60) < rng.choice([0.5, 0.85, 0.95])], rng.integers(0, 1 << 63, rng.integers(0, 9), dtype=np.uint64)])).tobytes() for _ in range(30)})
        sets = [np.frombuffer(x, np.uint64) for x in sets]
        part = list(range(len(sets)))
        got = list(part)
        for a, b in ((i, j) for i in range(len(sets)) for j in range(i)):
            if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])):
                part = [part[b] if x == part[a] else x for x in part]
        for a, b in simhash.similar_within(np.array([len(x) for x in sets]), np.concatenate(sets)):
            got = [got[b] if x == got[a] else x for x in got]
        pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
        assert [part[i] == part[j] for i, j in pairs] == [got[i] == got[j] for i, j in pairs]


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 32))
    x = (centres[rng.integers(0, 5, 600)] + 0.3 * rng.normal(size=(600, 32))) / 6
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.1, None]), (602, [float("nan")] * 32), (603, []), (604, [0.5]), (660, [0.25])]
    rows += [(5000 + i, x[0].tolist()) for i in range(30)] + [rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.whole(df)
    got = {}
    for r in topk.search(v, v.where(F.col("vec_id") % 20 == 0), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = {i: np.floor(64 * np.float32(e).astype(float)).astype(int) for i, e in rows if e and None not in e and np.isfinite(e).all()}
    for q in (i for i in ints if i % 20 == 0):
        same = [c for c in ints if c != q and len(ints[c]) == len(ints[q])]
        best = sorted(((-int(ints[q] @ ints[c]), c) for c in same))[:20]
        assert sorted(got.get(q, [])) == [(n + 1, c, -s) for n, (s, c) in enumerate(best)]


def test_topk_counts_repeats_once_before_the_cut(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-9, 10, 8).tolist()) for i in range(120)]
    rows += [(500, [90] * 8)] * 50 + [(0, rng.integers(-9, 10, 8).tolist()), (7, [80] * 8)]  # 0 and 7 have two vectors
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").coalesce(1)
    kept = {(i, tuple(v)) for i, v in rows}
    want = {q: sorted((-int(np.dot(a, b)), c) for i, a in kept if i == q for c, b in kept if c != q)[:20] for q in (0, 1, 7, 500)}
    for block in (topk.QUERY_BLOCK, 2):
        monkeypatch.setattr(topk, "QUERY_BLOCK", block)
        got = {}
        for r in topk.search(df, df.where("vec_id in (0, 1, 7, 500)"), 20).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert got == want


def test_bounds_prune_and_stay_exact():
    rng = np.random.default_rng(4)
    q, c = rng.integers(-5, 6, (3, 64)), rng.integers(-5, 6, (5000, 64))
    c[:50] *= 8
    best = topk.Best(3, 7)
    for i in range(0, 5000, 500):
        topk.scan(q, np.array([-1, -2, -3]), c[i : i + 500], np.arange(i, i + 500), best)
    for j in range(3):
        want = sorted(zip(-(c @ q[j]), range(5000), strict=True))[:7]
        assert list(zip((-best.score[best.query == j]).tolist(), best.id[best.query == j].tolist(), strict=True)) == [(int(s), i) for s, i in want]
