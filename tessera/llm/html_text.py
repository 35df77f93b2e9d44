"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines (its blocks). Pages of a host are ordered by URL path; a page is paired
with the one of its two neighbours whose path shares the longer beginning, the line hashes
of both are aligned by longest common subsequence, and lines the pages share are deleted.

Differencing alone can neither tell boilerplate that the neighbour lacks nor keep an article that
the neighbour repeats, so the markup has the last word where it speaks: lines in navigation,
headers, footers, sidebars, forms, notices, adverts and comments go, and lines of an
``article`` element stay. Differencing decides about all other lines: those of a ``main``
element where a page has one, and on pages without either every unmarked line.

Pages of a host with the same lines are one page, at the smallest of their paths, so copies don't
delete each other. Only line hashes are sorted by URL, those of hosts where a line is open to
differencing. Neighbours are found inside ranges of the global order, and the first and last page
of each range are matched through a table with a row a range, so a host with a third of all
pages is many ranges' work. The text of pages without an open line crosses no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import slices, written
from tessera.llm.url_filter import host_of, path_of

#: Fixed values of HTML: elements that start a block, have no end tag, or hold no text of the page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td"
    " tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
CHROME = frozenset("head nav footer aside form button select option menu dialog svg canvas object audio video map search datalist".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that end what stays open inside them.
SCOPES = frozenset("article aside body div footer form header html main nav section table ul ol dl blockquote figure".split())
#: Words of class, id and role tokens that mark what isn't the article. A token is a mark if every part of it,
#: cut at hyphens, underscores and inner capitals, is one of these or a plain word below, and one is of these.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert"
    " popup modal overlay newsletter subscribe signup sidebar side nav navbar navigation menu breadcrumb breadcrumbs footer header masthead comment comments"
    " disqus replies respond share sharing social related recommended recommendations pagination pager widget toolbar login search skip".split()
)
PLAIN = frozenset("bar box block section list area top bottom left right main site page global inner outer wrap wrapper container content unit slot item items link links text primary secondary privacy form button buttons policy message".split())
#: What comments, related links and sharing are of.
OWNED = frozenset("comment comments disqus replies respond share sharing social related recommended recommendations ad ads advert sponsored".split())
OWNERS = frozenset("article articles post posts story stories entry reader user blog".split())
PART = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+(?![a-z])")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""")
DROPPED, UNMARKED, MAIN, ARTICLE = 0, 1, 2, 3


class Open:
    """The open elements, with what their lines are; finds the innermost of a name without a walk."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.kinds: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    @property
    def kind(self) -> int:
        return self.kinds[-1] if self.kinds else UNMARKED

    def push(self, name: str, kind: int) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name in SCOPES:
            self.scopes.append(len(self.names))
        self.names.append(name)
        self.kinds.append(kind)

    def find(self, names: set[str] | frozenset[str], within: bool) -> int:
        """The innermost element of one of ``names``, inside the innermost scope if ``within``; -1 if none."""
        at = max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)
        return at if not within or not self.scopes or at > self.scopes[-1] else -1

    def cut(self, at: int) -> None:
        """Close element ``at`` and all inside it."""
        while len(self.names) > at:
            name = self.names.pop()
            self.kinds.pop()
            self.places[name].pop()
            if name in SCOPES:
                self.scopes.pop()


def lines_of(page: str | None) -> tuple[list[str], list[int]]:
    """The lines of a page and for each what the markup says: DROPPED, UNMARKED, in MAIN or in an ARTICLE.

    Linear in the page: each character is looked at a bounded number of times, whatever is left open.
    """
    page = page or ""
    lines: list[str] = []
    kinds: list[int] = []
    stack = Open()
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            lines.append(text)
            kinds.append(stack.kind)

    def close(at: int) -> None:
        if stack.kinds[at - 1 if at else 0] != stack.kind or (not at and stack.kind != UNMARKED):
            flush()
        stack.cut(at)

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        begin = page.find("<", at)
        if begin < 0 or begin > last:  # no tag can end any more
            cut = page.find("<!--", at)
            parts.append(page[at : cut if cut >= 0 else n])
            break
        parts.append(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else n
            continue
        lead = page[begin + 1 : begin + 3]
        if lead[:1] in ("!", "?"):
            at = page.find(">", begin) + 1
            continue
        if not (lead[:1].isascii() and lead[:1].isalpha()) and not (lead[:1] == "/" and lead[1:].isascii() and lead[1:].isalpha()):
            parts.append("<")
            at = begin + 1
            continue
        m = TAG.match(page, begin)
        if m:
            name, ends, attributes, at = m[2].lower(), m[1], m[3], m.end()
        else:  # a quote that never closes: the tag ends at the next bracket; at most once a kind of quote
            at = page.find(">", begin) + 1
            bare = TAG.match(re.sub("[\"']", " ", page[begin:at]))
            name, ends, attributes = bare[2].lower(), bare[1], bare[3]
        if ends:
            if name in BLOCKS:
                flush()
            found = stack.find({name}, name not in SCOPES)
            if found >= 0:
                close(found)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(f"</{name}\\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in SELF_CLOSING:
            found = stack.find(SELF_CLOSING[name], True)
            if found >= 0:
                close(found)
        now = kind = stack.kind
        if name in CHROME or (name == "header" and now < MAIN) or marked(attributes, name):
            kind = DROPPED
        elif name == "main" and now == UNMARKED:
            kind = MAIN
        elif name == "article" and now != DROPPED:
            kind = ARTICLE
        if kind != now:
            flush()
        if not attributes.endswith("/") or name in BLOCKS:
            stack.push(name, kind)
    flush()
    return lines, kinds


def marked(attributes: str, name: str) -> bool:
    """Whether class, id, role or hidden mark an element (but never body, article or main) as not the article."""
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key == "hidden" or (key in ("class", "id", "role") and any(map(is_mark, "".join(values).split()))):
            return True
    return False


@lru_cache(4096)
def is_mark(token: str) -> bool:
    """Whether a class token speaks of nothing but what isn't the article: ``cookie-notice``, but not ``side-by-side``."""
    parts = [p.lower() for p in PART.findall(token)] if len(token) < 100 else []
    of_article = any(p in OWNED for p in parts)
    return any(p in MARKS for p in parts) and all(p in MARKS or p in PLAIN or (of_article and p in OWNERS) for p in parts)


def shared_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of ``a`` are in one longest common subsequence of ``a`` and ``b`` (bit-parallel, exact)."""
    out = np.zeros(len(a), bool)
    x, y = a.tolist(), b.tolist()
    low = 0
    while low < min(len(x), len(y)) and x[low] == y[low]:
        low += 1
    out[:low] = True
    end = 0
    while end < min(len(x), len(y)) - low and x[-1 - end] == y[-1 - end]:
        end += 1
    out[len(x) - end :] = True
    for i in _align(x[low : len(x) - end], y[low : len(y) - end]):
        out[low + i] = True
    return out


#: Bits of rows kept for tracing back; larger alignments are halved.
ROWS_BITS = 1 << 28


def _rows(x: list[int], y: list[int]) -> Iterator[int]:
    """For each beginning of ``x`` a number whose zero bits are where the common length with y grows."""
    places: dict[int, int] = {}
    for j, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for v in x:
        hit = row & places.get(v, 0)
        row = (row + hit | row - hit) & full
        yield row


def _align(x: list[int], y: list[int]) -> list[int]:
    if not x or not y:
        return []
    if len(x) * len(y) > ROWS_BITS and len(x) > 1:
        half = len(x) // 2
        ahead, behind = (np.concatenate([[0], np.cumsum(1 - _bits(r, len(y)))]) for r in (_last(x[:half], y), _last(x[half:][::-1], y[::-1])))
        j = int((ahead + behind[::-1]).argmax())
        return _align(x[:half], y[:j]) + [half + i for i in _align(x[half:], y[j:])]
    rows = list(_rows(x, y))
    found, i, j = [], len(x), len(y)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            found.append(i)
    return found


def _last(x: list[int], y: list[int]) -> int:
    row = 0
    for row in _rows(x, y):  # noqa: B007
        pass
    return row


def _bits(row: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n].astype(np.int64)


def _common(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, url, host, path, digest, hashes, text, lines, open): text where no line is open, else the lines kept or open."""
    for b in slices(batches, 4):
        hashes, digests, texts, lines, places = [], [], [], [], []
        for page in b.column(4).to_pylist():
            found, kinds = lines_of(page)
            own = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in found), np.uint64, len(found)).view(np.int64)
            hashes.append(own)
            digests.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
            sure = {ARTICLE} & set(kinds)
            loose = MAIN if MAIN in kinds else UNMARKED if not sure else None
            keep = [i for i, k in enumerate(kinds) if k == ARTICLE or k == loose]
            free = any(kinds[i] == loose for i in keep)
            texts.append(None if free else "\n".join(found[i] for i in keep))
            lines.append([found[i] for i in keep] if free else None)
            places.append([i if kinds[i] == loose else -1 for i in keep] if free else None)
        yield pa.record_batch(
            [
                *b.columns[:4],
                pa.array(digests, pa.int64()),
                pa.array(hashes, pa.list_(pa.int64())),
                pa.array(texts, pa.string()),
                pa.array(lines, pa.list_(pa.string())),
                pa.array(places, pa.list_(pa.int32())),
            ],
            names=["page", "url", "host", "path", "digest", "hashes", "text", "lines", "places"],
        )


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for host, path, own, before, after in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
            near = [x for x in (before, after) if x and x["host"] == host]
            best = max(near, key=lambda x: _common(x["path"], path), default=None)
            out.append(shared_lines(np.array(own, np.int64), np.array(best["hashes"], np.int64)).tolist() if best else [False] * len(own))
        yield pa.record_batch([*b.columns[:2], pa.array(out, pa.list_(pa.bool_()))], names=["host", "digest", "shared"])


def differences(pages: DataFrame) -> DataFrame:
    """(host, digest, shared) from (host, path, digest, hashes): which lines each page shares with the nearest other page of its host.

    Pages of a host with equal digests are one page, at their smallest path; of two neighbours whose
    paths share as long a beginning the earlier counts. A page alone on its host shares nothing.
    """
    one = pages.groupBy("host", "digest").agg(F.min(F.struct("path", "hashes")).alias("least"))
    one = one.select("host", "digest", F.col("least.path").alias("path"), F.col("least.hashes").alias("hashes"))
    order = ["host", "path", "digest"]
    ranged = one.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id())
    ranged = written(ranged).withColumn("me", F.struct("host", "path", "hashes"))
    place = F.struct(*order)
    ends = ranged.groupBy("p").agg(F.min_by("me", place).alias("first"), F.max_by("me", place).alias("last"))
    by_range = Window.orderBy("p")  # one row a range
    ends = ends.select("p", F.lag("last").over(by_range).alias("before"), F.lead("first").over(by_range).alias("after"))
    within = Window.partitionBy("p").orderBy(*order)
    near = ranged.withColumns({"lag": F.lag("me").over(within), "lead": F.lead("me").over(within)}).join(ends, "p")
    near = near.select("host", "digest", "path", "hashes", F.coalesce("lag", "before"), F.coalesce("lead", "after"))
    return near.mapInArrow(_flags, "host string, digest long, shared array<boolean>")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``.

    Blocks are joined by one newline; character references are decoded, white space in a block is
    one blank. Null, empty and textless pages have an empty text. Pages without a host (null url) are
    neighbours of each other. Repeated rows come as often as they are; an empty table gives
    no rows; other columns are not carried.
    """
    slim = pages.select(F.col(key).alias("page"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(page).alias("html"))
    kind = dict(slim.dtypes)["page"]
    rows = written(slim.mapInArrow(_parsed, f"page {kind}, url string, host string, path string, digest long, hashes array<long>, text string, lines array<string>, places array<int>"))
    settled = rows.where("text is not null").select("page", "url", "text")
    loose = rows.where("text is null")
    flags = differences(rows.join(loose.select("host").distinct(), "host", "left_semi").select("host", "path", "digest", "hashes"))
    gone = F.transform("places", lambda i: F.coalesce(F.get("shared", i), F.lit(False)) & (i >= 0))
    text = F.array_join(F.filter("lines", lambda x, i: ~F.get(F.col("gone"), i)), "\n")
    rows = settled.union(loose.join(flags, ["host", "digest"]).withColumn("gone", gone).select("page", "url", text.alias("text")))
    return rows.select(F.col("page").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
