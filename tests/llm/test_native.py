"""URL rules, sharding, quality rules and mixing: odd rows, brute force, and the laws they promise."""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, quality, sharding, url_filter
from tessera.llm.queries import URL_RULES

TEXTS = ["", None, "one", "a b c a b c a b c\na b c\n\nx", "é ü\tß 漢字", "x" * 100_000, "w " * 60, "w " * 60, "line one here\nline one here\n" + " ".join(f"word{i}" for i in range(80))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s" if i % 2 else None, 1, "clash") for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "null id " * 30, None, "s", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, rate string")


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([i for i, c in enumerate(tail) if c in "?#"], default=len(tail))]
    best = None
    for r in URL_RULES:
        h, p = r[: r.index("/")], r[r.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(r) > len(best)):
            best = r
    return host, path, best, URL_RULES[best] if best else "allow"


def test_url_rules(spark):
    urls = ["http://example.com/en/x", "https://WWW.Example.com/en/", "http://a.net/fr/1?x=/es/", "http://net/es/", "http://com", "com/en/", None, "", "x://y#z/://", "http://notexample.com/en/", "http://a.b.example.com/en/q#f", "http://É.com/", "http://evil.org/en/", "http://" + "a." * 10_000 + "net/es/x", "http://" + "a" * 100_000 + ".com/"]
    pages = spark.createDataFrame([(i, u, "host?") for i, u in enumerate(urls + urls[:2])], "page_id int, url string, host string")
    got = url_filter.judge(pages, URL_RULES).select("url", "host", "path", "rule", "verdict").collect()
    assert Counter(map(tuple, got)) == Counter((u, *brute_rule(u)) for u in urls + urls[:2])
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, {}).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    listed = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(50_000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filter.build(listed, universe)
    assert len(cascade.levels) > 1
    wrong = universe.where(cascade.contains(F.col("key")) != (F.substring("key", 2, 9).cast("int") < 500))
    assert wrong.count() == 0


def test_url_rules_by_join_agree(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.net/fr/x"), (2, "http://q.org/")], "page_id int, url string")
    monkeypatch.setattr(url_filter, "MAX_BITS", 1)
    assert {r.page_id: r.rule for r in url_filter.judge(pages, URL_RULES).collect()} == {1: "net/fr/", 2: None}


def test_shards(spark, docs):
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
        if r.doc_id is not None and r.doc_id < len(TEXTS):
            raw = (TEXTS[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 1, crc32(raw))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.shard(docs.limit(0)).count() == 0


def test_tree_moves_only_within_changed_subtrees(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    before = sharding.tree([[[(0, 1), (1, 1)], [(2, 2)]], [[(3, 2)], [(4, 1), (5, 1)]]])
    after = sharding.tree([[[(0, 1.5), (1, 0.5)], [(2, 2)]], [[(3, 2)], [(4, 1), (5, 1)]]])
    moved = keys.select(sharding.shard_of(F.col("key"), before).alias("a"), sharding.shard_of(F.col("key"), after).alias("b")).groupBy("a", "b").count().collect()
    assert {(r.a, r.b) for r in moved if r.a != r.b} == {(1, 0)}
    sizes = Counter({r.a: r["count"] for r in moved if r.a == r.b})
    assert 0.2 < sizes[2] / 20_000 < 0.3


def brute_quality(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + o for i, w in enumerate(windows) if seen[w] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_base_counts(spark, docs):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is not None:
            want = brute_quality(TEXTS[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r.kept and r.base_failed)


def test_frequent_lines_deplete(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    shared = " ".join(f"common{j}" for j in range(55))
    rows = [(i, f"{shared.upper() if i % 2 else shared}\n{own(i)}", "h") for i in range(30)] + [(100 + i, shared, "h") for i in range(3)] + [(200, shared, "other"), (201, own(201), "h")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id int, text string, source string"), max_docs=20).collect()}
    assert got[0].removed_words == 55 and got[0].kept and got[1].kept
    assert not got[100].kept and got[200].kept and got[201].removed_words == 0


def test_mixing(spark, docs):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"))
    out = mixing.mix(many, {"a": 6.0, "b": 1.0}, rest=1.0)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] / 15_000 - 1) < 0.05 and abs(n["b"] / 2_500 - 1) < 0.1
    assert out.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("copies").alias("c")).where("n <> c").count() == 0
    keys = [r.order_key for r in out.select("order_key").collect()]
    assert keys == sorted(keys)
    odd = mixing.mix(docs, {"null": 1.0}, names=(names := {}))
    assert names["rate"] == "rate_" and set(docs.columns) < set(odd.columns)
    assert odd.where("source is null").count() >= 0 and mixing.mix(docs.limit(0), {}).count() == 0


def test_a_document_with_many_copies(spark):
    """One document among 20,000 that is to be half of all: its copies are made a part at a time and none is lost."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "rare").otherwise("rest").alias("source"))
    out = [r for r in mixing.mix(docs, {}).select("doc_id", "copies", "copy").collect() if r.doc_id == 7]
    assert abs(len(out) - 10_000) < 600 and sorted(r.copy for r in out) == list(range(out[0].copies))


def test_written_tables_can_be_deleted(spark):
    from tessera.llm.common import clean, written

    clean(spark)
    table = written(spark.range(5))
    assert table.count() == 5 and clean(spark) == 1 and clean(spark) == 0
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(table.inputFiles()[0])


def test_poisson_is_inverted(spark):
    means = [0.3, 2.0, 700.0]
    for mean in means:
        rows = spark.range(4000).select(mixing.count_of(F.col("id").cast("string"), F.lit(mean), 1).alias("n")).agg(F.avg("n").alias("m"), F.variance("n").alias("v")).first()
        assert abs(rows.m - mean) < 4 * (mean / 4000) ** 0.5 and abs(rows.v / mean - 1) < 0.15
