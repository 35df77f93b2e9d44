"""Patterns with free predicates over mapped tables: what their bound terms can match is all that is read, and nothing is lost."""

from __future__ import annotations

import os
import re
from collections import Counter

import pytest

from tessera import catalog
from tessera import terms as R
from tessera.sources.dataset import Dataset
from tessera.sources.mapped import NS, Mapping, TableMap

FOLDER = os.environ.get("TESSERA_TABLES", "/root/testdata/sf0.001")


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    return text


@pytest.mark.parametrize(("name", "read", "filters"), [("path_nps", {"nation", "supplier"}, ("EqualTo(n_nationkey,3)", "EqualTo(s_nationkey,3)")), ("unbound_predicate", {"region"}, ("EqualTo(r_regionkey,2)",))])
def test_only_tables_that_can_match_are_read(spark, name, read, filters):
    text = plan(spark, name)
    assert set(re.findall(r"/(\w+)\.parquet", text)) == read
    assert all(f in text for f in filters)


@pytest.fixture(scope="module")
def pair(spark):
    """A mapped dataset, and all its triples as quads."""
    place = spark.createDataFrame([(1, "one", 2.0, True, [1.5, 2.0]), (2, "3", None, False, None), (-9223372036854775808, "low", 7.0, None, [])], "id bigint, name string, size double, ok boolean, list array<double>")
    tag = spark.createDataFrame([("07", 7, 1), ("7", None, 2), ("a/b", 3, None), ("1", 1, 1)], "code string, n int, at int")
    link = spark.createDataFrame([("x", 1, "7", 1), ("x", 2, "07", 2), ("x/1", 2, "a/b", None), ("y", 1, None, 1)], "a string, b int, code string, at int")
    row = spark.createDataFrame([(1, "7"), (1, "7"), (2, None)], "at bigint, code string")
    refs = {"at": ("at", "place"), "code": ("tag", "tag")}
    tables = (TableMap("place", place, ("id",)), TableMap("tag", tag, ("code",), {"at": ("at", "place")}), TableMap("link", link, ("a", "b"), refs, {"code": NS + "link_code"}), TableMap("row", row, (), refs))
    mapped = Dataset(spark, mapping=Mapping(tables), star=False)
    return mapped, Dataset(spark, mapped.all_quads().cache(), star=False), Dataset(spark, mapped.active(None).selectExpr("s", "p", "o", "string(null) g").cache(), star=False)


def bag(data, text):
    return Counter(tuple(sorted((n, R.nt(t)) for n, t in row.items())) for row in data.terms(catalog.PREFIX + text))


ENDS = [R.Iri(NS + x) for x in ("place/1", "place/01", "place/+1", f"place/-{1 << 63}", f"place/{1 << 63}", "place/9", "tag/7", "tag/07", "tag/a/b", "link/x/1", "link/x/1/2", "link/x", "Place", "nothing")]
ENDS += [R.Literal(x) for x in ("one", "7", "3")] + [R.Literal(x, R.XSD + "integer") for x in ("7", "07", f"-{1 << 63}")] + [R.Literal("one", R.LANG_STRING, "en")]
ENDS += [R.Literal("2.0E0", R.XSD + "double"), R.Literal("2.0", R.XSD + "double"), R.Literal("true", R.XSD + "boolean"), R.Literal("[1.5, 2.0]", R.CDT + "List"), R.Literal("[1.5,2.0]", R.CDT + "List")]


def test_bound_ends_lose_nothing(pair):
    triples = [(R.from_row(r.s), r.p, R.from_row(r.o)) for r in pair[2].quads.collect()]
    want = Counter()
    for i, x in enumerate(ENDS):
        want.update((i, s) for s, p, o in triples if o == x and p != NS + "at")
        want.update((i, o) for s, p, o in triples if s == x and p != NS + "link_code")
    parts = [f"{{ ?v !(:at|^:link_code) {R.nt(x)} BIND({i} AS ?n) }}" for i, x in enumerate(ENDS)]
    got = Counter((int(r["n"].value), r["v"]) for k in range(0, len(parts), 7) for r in pair[0].terms(f"{catalog.PREFIX}SELECT * {{ {' UNION '.join(parts[k : k + 7])} }}"))
    assert got == want
    assert len({i for i, _ in want}) == 16


@pytest.mark.parametrize("text", [
    f"SELECT * {{ <{NS}tag/1> !(rdf:type) <{NS}place/1> }}", f"SELECT * {{ <{NS}tag/1> !(:at) <{NS}place/1> }}",
    "SELECT * { ?x !(rdf:type) ?x }", "SELECT * { ?x !(:at|:tag|rdf:type)/!(:name|^:tag) ?y }", f"SELECT * {{ <{NS}place/1> ?p ?o . ?x :nowhere <{NS}place/1> }}",
])
def test_other_patterns_lose_nothing(pair, text):
    assert bag(pair[0], text) == bag(pair[2], text)


def test_named_graphs_lose_nothing(pair):
    mapped, quads, _ = pair
    pattern = f"?s !(rdf:type|^:none) <{NS}place/1>"
    for text in (f"SELECT * {{ GRAPH ?g {{ {pattern} }} }}", f"SELECT * {{ GRAPH <{NS}graph/link> {{ {pattern} }} }}", f"SELECT * FROM <{NS}graph/tag> FROM <{NS}graph/row> {{ {pattern} }}"):
        assert bag(mapped, text) == bag(quads, text)


def test_match_reads_what_it_is_asked_for(pair):
    mapped, quads, _ = pair
    one, at = R.Iri(NS + "place/1"), R.Iri(NS + "at")
    for given in ((one,), (None, at), (None, at, one, R.Iri(NS + "graph/tag")), (R.Iri(NS + "nothing"),)):
        assert mapped.count(*given) == quads.count(*given)
