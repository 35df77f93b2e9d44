"""Language, toxicity, pieces, page text and the pipeline."""

from __future__ import annotations

import math
import os
import random
import time

import numpy as np
import pytest

from tessera.llm import html_text, langid, sentencepieces, toxicity
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "12 34 !"), (5, "a" * 200_000), (None, "der die das und")]


def test_ppm_code_lengths_match_a_direct_reading():
    pairs = [("x", "abracadabra abra"), ("y", "hocus pocus hocus")]
    model = langid.fit(pairs)
    text = "abra pocus z"

    def slow(lang):
        data = "\n" * 3 + "".join(t + "\n" * 3 for lg, t in pairs if lg == lang)
        stream = "\n" * 3 + text
        bits = 0.0
        for i in range(3, len(stream)):
            for k in (3, 2, 1, 0, -1):
                if k < 0:
                    bits += 8
                    break
                ctx = stream[i - k : i]
                nexts = [data[j + k] for j in range(len(data) - k) if data[j : j + k] == ctx]
                if not nexts:
                    continue
                kinds = len(set(nexts))
                if stream[i] in nexts:
                    bits += math.log2((len(nexts) + kinds) / nexts.count(stream[i]))
                    break
                bits += math.log2((len(nexts) + kinds) / kinds)
        return bits

    got = model.totals([text.encode()])[0]
    assert np.allclose(got, [slow("x"), slow("y")], rtol=1e-5)


def test_long_texts_are_scored_in_pieces(monkeypatch):
    model = langid.fit([("x", "some words here " * 20), ("y", "andere worte dort " * 20)])
    texts = [b"some words dort " * 50, b"q", b"andere worte " * 30]
    whole = model.totals(texts)
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert np.allclose(model.totals(texts), whole, rtol=1e-4)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.train(docs)
    held = langid.identify(docs, model).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.where("lang = lang_pred").count() / held.count() >= 0.97
    odd = langid.identify(spark.createDataFrame(ODD, "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in odd if r.doc_id in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "und")
    assert all(0 <= r.score <= 1 for r in odd) and not next(r for r in odd if r.doc_id is None).held_out
    assert langid.train(docs.limit(0)) is None
    assert langid.identify(docs.limit(3), None).select("lang_pred").distinct().collect()[0][0] == "und"


def test_forward_backward_matches_enumeration(monkeypatch):
    monkeypatch.setattr(toxicity, "LANE", 3)
    rng = np.random.default_rng(0)
    emit, trans, start = rng.normal(size=9), np.array([[0.9, 0.1], [0.6, 0.4]]), np.array([0.8, 0.2])
    first = np.zeros(9, bool)
    first[[0, 4]] = True
    p, _ = toxicity.marginals(emit, first, trans, start)
    for lo, hi in ((0, 4), (4, 9)):
        total, hits = 0.0, np.zeros(hi - lo)
        for bits in range(1 << (hi - lo)):
            y = [(bits >> i) & 1 for i in range(hi - lo)]
            w = start[y[0]] * math.prod(trans[a, b] for a, b in zip(y, y[1:], strict=False)) * math.exp(sum(e for e, s in zip(emit[lo:hi], y, strict=True) if s))
            total += w
            hits += w * np.array(y)
        assert np.allclose(p[lo:hi], hits / total)


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(1)
    pairs = []
    for i in range(300):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        if i % 3 == 0:
            for _ in range(4):
                words.insert(rng.randrange(60), rng.choice(["vile", "filth", "scumbag"]))
        pairs.append((int(i % 3 == 0), " ".join(words)))
    return toxicity.fit(pairs)


def test_toxic_spans(spark, tagger):
    (bad, spans), (good, none), *rest = toxicity.tag(["w1 w2 you Vile, filth w3", "w1 w2 w3 w4", None, "", "x" * 100_000], tagger)
    assert bad > 0.5 > good and not none
    assert {"w1 w2 you Vile, filth w3"[s["start"] : s["end"]].lower().replace(",", "") for s in spans} & {"vile filth", "vile", "filth"}
    assert all(0 <= s <= 1 for s, _ in rest)
    rows = toxicity.score(spark.createDataFrame(ODD + ODD[:1], "doc_id long, text string"), tagger).collect()
    assert len(rows) == len(ODD) + 1 and all(r.predicted == int(r.score >= 0.5) for r in rows)
    assert 0 < toxicity.tag(["a b"], toxicity.fit([]))[0][0] < 1


def test_spans_are_offsets_of_the_text(tagger):
    """Lower-casing some letters changes their number; offsets are those of the text as it is."""
    for text in ("İİİ filth here", "w1 VILE İ filth w2"):
        spans = toxicity.tag([text], tagger)[0][1]
        assert spans and all({w.lower() for w in toxicity.split(text[s["start"] : s["end"]])} <= {"vile", "filth", "scumbag"} for s in spans)


def test_transitions_are_fitted(tagger):
    """The chain learnt from single toxic words among plain ones: texts start plain and stay plain."""
    assert tagger.trans.shape == (2, 2) and tagger.start.shape == (2,)
    assert tagger.start[0] > tagger.start[1] and tagger.trans[0, 0] > tagger.trans[1, 1]


def test_other_labels_take_no_part(spark):
    docs = spark.createDataFrame([(i, f"plain words {i} here" if i % 2 else f"vile filth {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2 if i < 40 else 7 if i < 50 else None) for i in range(60)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).theta.any()
    assert 0 < toxicity.tag(["x"], toxicity.train(docs, labels.limit(0)))[0][0] < 1


def test_a_sample_has_all_labels(spark):
    from tessera.llm.folds import sample

    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 1500).alias("lang"))
    pairs = sample(docs.select("doc_id", "lang"), docs, "lang", 3, 15)
    assert len({lang for lang, _ in pairs}) > 1490  # a label with all six documents held out has none to learn
    assert max(__import__("collections").Counter(lang for lang, _ in pairs).values()) <= 3
    per = {}
    for lang, text in pairs:
        per[lang] = per.get(lang, 0) + len(text)
    assert max(per.values()) <= 15
    many = docs.union(docs.where("doc_id < 3")).withColumn("lang", F.lit("x"))
    first = sample(many.select("doc_id", "lang"), many, "lang", 50, 10**6)
    assert len(first) == len(set(first)) == 50


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    held = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).where("held_out").join(labels, "doc_id").collect()
    found = [r.predicted for r in held if r.toxic == 1]
    clean = [r.predicted for r in held if r.toxic == 0]
    assert sum(found) / len(found) > 0.8 and sum(clean) / len(clean) < 0.05


@pytest.fixture(scope="module")
def pieces():
    if not os.path.exists(sentencepieces.MODEL_PATH):
        pytest.skip("no public tokenizer file")
    return sentencepieces.Model.load()


SAMPLES = ["", "hello world", "  two  blanks ", "tab\tnew\nline", "漢字 🙂 é", "a" * 3000, "\x00\x7f", "   ", "x▂y"]


def test_pieces_round_trip(pieces):
    for t in SAMPLES:
        assert pieces.decode(pieces.encode(t)) == t
    assert pieces.encode(None) == []


def test_viterbi_is_optimal(pieces):
    rng = random.Random(2)
    by_text = {pieces.pieces[i]: pieces.scores[i] for i, k in enumerate(pieces.kinds) if k in (1, 4)}
    for _ in range(60):
        chunk = "▁" + "".join(rng.choice("theandiqz漢🙂") for _ in range(rng.randint(1, 9)))
        best = [0.0] + [-math.inf] * len(chunk)
        for i in range(len(chunk)):
            for j in range(i + 1, len(chunk) + 1):
                s = by_text.get(chunk[i:j], pieces.unknown_score if j == i + 1 else None)
                if s is not None:
                    best[j] = max(best[j], best[i] + s)
        ids = pieces.path(chunk)
        got = sum(pieces.scores[i] for i in ids if pieces.kinds[i] != sentencepieces.BYTE)
        unknown = sum(c not in by_text for c in set(chunk)) and sum(c not in by_text for c in chunk)
        assert math.isclose(got + unknown * pieces.unknown_score, best[-1], rel_tol=1e-12)


def test_words_and_whole_texts_agree(pieces):
    whole = sentencepieces.Model(pieces.pieces, pieces.scores, pieces.kinds)
    whole.chunk = __import__("re").compile(r"(?s).+")
    for t in ("the quick brown fox  jumps", "over the\nlazy dog "):
        assert whole.encode(t) == pieces.encode(t)


def test_pieces_column(spark, pieces):
    rows = sentencepieces.encode(spark.createDataFrame([*ODD, ODD[1], (9, "der 漢")], "doc_id long, text string"), pieces).collect()
    assert len(rows) == len(ODD) + 2
    assert all(r.decoded == (dict(ODD) | {9: "der 漢"}).get(r.doc_id, "der die das und" if r.doc_id is None else None) or r.doc_id == 1 and r.decoded == "" for r in rows)
    assert all(r.n_tokens == len(r.ids) for r in rows)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; tail</h1><p>First <b>bold<br>text</p><p>x &lt; y &#233;<div class=comments><p>nice</div><aside>See also</aside><form>Name</form><script>var a="</p>";</script>
<p>Last   line</article><footer>&copy; me</footer></body></html>"""


def test_article_text(spark):
    plain = lambda x: f"<body><p>Menu one<p>Menu two<p>{x}<p>Legal</body>"
    rows = [(1, "http://a.b/x/1", PAGE), (2, "http://a.b/y/2", plain("Only here")), (3, "http://a.b/y/3", plain("Only there")), (4, None, None), (5, "http://c.d/", ""), (6, "http://c.d/<", "a < b <i>c</i>"), (6, "http://c.d/<", "a < b <i>c</i>"), (None, "bad url", "<p>" * 3000 + "deep")]
    got = html_text.extract(spark.createDataFrame([(*r, "c") for r in rows], "page_id int, url string, html string, shared string")).collect()
    by_id = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert by_id[1] == "Head & tail\nFirst bold text\nx < y é\nLast line"
    assert by_id[2] == "Only here" and by_id[3] == "Only there"
    assert by_id[4] == by_id[5] == "" and by_id[6] == "a < b c" and by_id[None] == "deep"
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("page", ["<a " * 300_000, "<b>" * 150_000 + "</i>" * 150_000, "<p>" * 300_000, "<a \"'" * 200_000, "<!--" * 250_000, "</" * 400_000 + ">", "<td><tr>" * 120_000, "&" * 900_000, "<div class='" + "ad " * 300_000 + "'>x", "<li hidden " + " " * 900_000 + ">y"])
def test_hostile_pages_take_linear_time(page):
    begin = time.perf_counter()
    html_text.lines_of(page)
    assert time.perf_counter() - begin < 5


def test_class_tokens_mark_as_a_whole():
    marks = "cookie-notice ad sidebar site-header post-comments related-posts adSlot3 navbar"
    assert all(map(html_text.is_mark, marks.split()))
    assert not any(map(html_text.is_mark, "side-by-side social-history notice-of-findings article-header article-body heading gradient".split()))
    kept = '<article><p>a<div class="side-by-side"><p>b</div><div class="social-history"><p>c</div><div id="notice-of-findings"><p>d</div></article>'
    assert html_text.lines_of(kept) == (["a", "b", "c", "d"], [html_text.ARTICLE] * 4)


def test_pages_against_a_plain_version(spark):
    """Pages of random paragraphs: in an article all stay; in main or bare, those shared with the nearest other page go."""
    rng = random.Random(11)
    pages = []
    for i in range(160):
        lines = [f"line {rng.randrange(12)}" for _ in range(rng.randrange(1, 9))]
        frame = rng.choice(["article", "main", "body", "body"])
        pages.append((i, f"h{rng.randrange(3)}.x", f"/{rng.choice('abc')}/{rng.choice('abc')}{rng.randrange(40)}", frame, lines))
    pages += [(200 + i, h, p + "9", f, x) for i, (_, h, p, f, x) in enumerate(pages[:8])]  # copies at other paths
    rows = [(i, f"http://{h}{p}", f"<{f}>" + "".join(f"<p>{x}" for x in lines) + f"</{f}>") for i, h, p, f, lines in pages]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(5)).collect()}
    path_of = {}
    for _, h, p, _, lines in pages:
        path_of[h, tuple(lines)] = min(path_of.get((h, tuple(lines)), p), p)
    for i, h, p, frame, lines in pages:
        if frame == "article":
            assert got[i] == "\n".join(lines)
            continue
        own = path_of[h, tuple(lines)]
        others = sorted((q, x) for (g, x), q in path_of.items() if g == h and x != tuple(lines))
        # copies share a path only by chance, so neighbours are told by path
        before, after = [x for x in others if x[0] < own], [x for x in others if x[0] > own]
        if len({q for q, _ in others} | {own}) != len(others) + 1:
            continue
        near = [x for x in (before[-1:] or [None])[:1] + (after[:1] or [None]) if x]
        best = max(near, key=lambda x: len(os.path.commonprefix([x[0], own])))[1]
        table = [[0] * (len(best) + 1) for _ in range(len(lines) + 1)]
        for a in range(len(lines)):
            for b in range(len(best)):
                table[a + 1][b + 1] = table[a][b] + 1 if lines[a] == best[b] else max(table[a][b + 1], table[a + 1][b])
        kept = got[i].split("\n") if got[i] else []
        assert len(kept) == len(lines) - table[-1][-1], (i, lines, best, kept)
        rest = iter(lines)
        assert all(x in rest for x in kept)


def test_longest_common_subsequence(monkeypatch):
    rng = random.Random(1)
    for limit in (1 << 28, 6):
        monkeypatch.setattr(html_text, "ROWS_BITS", limit)
        for _ in range(300):
            a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in "ab")
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a)):
                for j in range(len(b)):
                    best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
            marks = html_text.shared_lines(np.array(a, int), np.array(b, int))
            kept, rest = [x for x, m in zip(a, marks, strict=True) if m], iter(b)
            assert len(kept) == best[-1][-1] and all(x in rest for x in kept)


def test_neighbours_across_ranges(spark):
    """Each page of a host shares its frame with any neighbour, wherever the ranges of the URL order are cut."""
    rows = [(i, f"http://h{i % 2}.x/p/{i:04d}", f"<p>Frame {i % 2}<p>Own {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(7)
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {i: f"Own {i}" for i, _, _ in rows}


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline

    rows = [(i, t, None, None, None, "c") for i, t in ODD] + [(10 + i, "The and of " * 30, "en", "src0", 5, "c") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies string")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, "/root/testdata/sf0.001")
            assert name == "sentencepiece" or out.columns == docs.columns
            out.collect()


def test_uniform_hash_of_folds(spark):
    from zlib import crc32

    from tessera.llm.folds import held_out

    rows = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (crc32(str(r.id).encode()) % 5 == 0) for r in rows)
    assert spark.range(1).select(F.lit(None).cast("long").alias("doc_id")).select(held_out()).first()[0] is False
