"""The pipeline's stages, each against a plain version over the rows it was given."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from zlib import crc32

import pytest

import corpus_pipeline
from tessera.llm import langid, sentencepieces, toxicity
from tessera.llm.queries import MIX_WEIGHTS

FOLDER = "/root/testdata/sf0.001"
HELD = [i for i in range(9000, 9100) if crc32(str(i).encode()) % 5 == 0][:4]


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows given, rows returned) of each stage over the smallest tables and some junk."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # ids of the held-out fold, so that no junk is learnt from
    junk = [(HELD[0], "qzx7 kjv9 " * 40, "en", "src0", 400), (HELD[1], "ffe81b20c4 9a01d7 " * 30, "de", "src1", 540), (HELD[2], None, None, None, None), (HELD[3], "", "en", "src2", 0)]
    docs = docs.union(spark.createDataFrame(junk, docs.schema)).union(docs.limit(2)).cache()
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER).cache()
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_language_stage(spark, stages):
    before, after = stages["language_id"]
    model = langid.train(before)
    assert rows(after) == Counter(tuple(r) for r in before.collect() if langid.spoken([r.text], model) == [True])
    kept = {r.doc_id for r in after.collect()}
    assert not kept & set(HELD)
    plain = [r for r in before.collect() if r.doc_id < 9000 and len(r.text) >= 300]
    assert sum(r.doc_id in kept for r in plain) >= 0.99 * len(plain)


def test_toxicity_stage(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert rows(after) == Counter(tuple(r) for r in before.collect() if toxicity.tag([r.text], model)[0][0] < 0.5)


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_dedup_stage(stages):
    before, after = stages["simhash_dedup"]
    given = sorted({tuple(r) for r in before.collect()})
    sets = [shingles(r[1]) for r in given]
    group = list(range(len(given)))
    for i in range(len(given)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for r, g in zip(given, group, strict=True):
        best.setdefault(g, r)
    assert len(best) < len(given)
    assert rows(after) == Counter(best.values())


def copies(doc_id, rate):
    """Poisson inversion at the hashed uniform number, term by term."""
    total = 0
    parts = max(1, math.ceil(rate / 500))
    for part in range(1, parts + 1):
        u = (int(hashlib.md5(f"0|{part}|{doc_id}".encode()).hexdigest()[:13], 16) + 1) / 2**52
        k, p = 0, math.exp(-rate / parts)
        below = p
        while u > below:
            k += 1
            p *= rate / parts / k
            below += p
        total += k
    return total


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    given = [tuple(r) for r in before.collect()]
    n = Counter(r[3] for r in given)
    weight = {s: MIX_WEIGHTS.get(s, 1.0) for s in n}
    rate = {s: len(given) * weight[s] / sum(weight.values()) / n[s] for s in n}
    assert rows(after) == Counter({r: c for r in given if (c := copies(r[0], rate[r[3]]))})


def test_piece_stage(stages):
    before, after = stages["sentencepiece"]
    model = sentencepieces.Model.load()
    want = Counter((r.doc_id, tuple(model.encode(r.text))) for r in before.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in after.collect()) == want
    assert all(r.n_tokens == len(r.ids) for r in after.collect())


def test_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    want = Counter((r.doc_id, tuple(r.ids), r.n_tokens) for r in docs.collect())
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "ids", "n_tokens"]
    assert Counter((r.doc_id, tuple(r.ids), r.n_tokens) for r in got.collect()) == want and len(want) > 50
