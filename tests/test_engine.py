"""Operators of the SPARQL engine on small graphs, formats, updates, extensions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera import terms as R
from tessera.functions.registry import Registry
from tessera.isomorphism import canonical, isomorphic, subgraph
from tessera.plans import unparse
from tessera.plans.parser import parse_query, parse_update
from tessera.sources import readers, results, writers
from tessera.sources.dataset import Dataset
from tessera.streaming import quad_stream
from tessera.terms import XSD

TRIG = """@prefix : <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a :p :b . :b :p :c . :c :p :a . :a :q "x"@en-us, "y" ; :n 1, 2.5, "07"^^xsd:integer, 1e1, true, "zz"^^:dt .
:a :when "2020-02-03T04:05:06.5+02:00"^^xsd:dateTime . [] :q "blank" . :l :list (1 "two" :three) .
<< :a :p :b >> :source :s .
:g1 { :a :p :z . :a :q "in g1" } :g2 { :z :p :a }"""
PRE = f"PREFIX : <http://x/> PREFIX xsd: <{XSD}> PREFIX cdt: <{R.CDT}> PREFIX rdf: <{R.RDF}> "


@pytest.fixture(scope="module")
def data(spark):
    d = Dataset.of(spark, readers.parse(TRIG, "trig", "http://x/"))
    return d.with_quads(d.quads.cache())


def values(data, text, *names):
    out = [tuple(R.nt(r[n]) if n in r else None for n in names) for r in data.terms(PRE + text)]
    return sorted(out, key=repr)


CASES = [
    ("SELECT ?o { :a :p+ ?o }", ["<http://x/a>", "<http://x/b>", "<http://x/c>"]),
    ("SELECT ?o { ?o :p* :b }", ["<http://x/a>", "<http://x/b>", "<http://x/c>"]),
    ("SELECT ?o { :nowhere :p* ?o }", ["<http://x/nowhere>"]),
    ("SELECT ?o { :a (:p/:p) ?o }", ["<http://x/c>"]),
    ("SELECT ?o { ?o :n ?v FILTER(?v = 7) }", ["<http://x/a>"]),
    ("SELECT ?o { :a :n ?o FILTER(?o < 8) } ORDER BY ?o", ['"07"^^<http://www.w3.org/2001/XMLSchema#integer>', '"1"^^<http://www.w3.org/2001/XMLSchema#integer>', '"2.5"^^<http://www.w3.org/2001/XMLSchema#decimal>']),
    ("SELECT (SUM(?v) AS ?o) { :a :n ?v FILTER(isNumeric(?v)) }", ['"20.5E0"^^<http://www.w3.org/2001/XMLSchema#double>']),
    ("SELECT (SUM(?v) AS ?o) { :a :n ?v }", [None]),
    ("SELECT (COUNT(?v) AS ?o) { :a :n ?v }", ['"6"^^<http://www.w3.org/2001/XMLSchema#integer>']),
    ("SELECT (LANG(?v) AS ?o) { :a :q ?v FILTER(LANGMATCHES(LANG(?v), 'en')) }", ['"en-US"']),
    ("SELECT (HOURS(?v) AS ?o) { :a :when ?v }", ['"4"^^<http://www.w3.org/2001/XMLSchema#integer>']),
    ("SELECT (TIMEZONE(?v) AS ?o) { :a :when ?v }", ['"PT2H"^^<http://www.w3.org/2001/XMLSchema#dayTimeDuration>']),
    ("SELECT ?o { :a :when ?v BIND(?v = '2020-02-03T02:05:06.5Z'^^xsd:dateTime AS ?o) }", ['"true"^^<http://www.w3.org/2001/XMLSchema#boolean>']),
    ("SELECT ?o { GRAPH ?o { :a :p ?x } }", ["<http://x/g1>"]),
    ("SELECT ?o { GRAPH :g1 { :a :q ?o } }", ['"in g1"']),
    ("SELECT ?o FROM :g1 FROM :g2 { ?x :p ?o }", ["<http://x/a>", "<http://x/z>"]),
    ("SELECT ?o { ?x :p ?o FILTER NOT EXISTS { ?o :q ?y } }", ["<http://x/b>", "<http://x/c>"]),
    ("SELECT ?o { ?x :p ?o MINUS { :b :p ?o } }", ["<http://x/a>", "<http://x/b>"]),
    ("SELECT ?o { ?x :p ?o MINUS { :b :p ?other } }", ["<http://x/a>", "<http://x/b>", "<http://x/c>"]),
    ("SELECT ?o { << ?s :p ?o >> :source :s }", ["<http://x/b>"]),
    ("SELECT (SUBJECT(?t) AS ?o) { ?t :source :s }", ["<http://x/a>"]),
    ("SELECT (cdt:get(?l, 2) AS ?o) { BIND('[1, \"b\", null]'^^cdt:List AS ?l) }", ['"b"']),
    ("SELECT ?o { BIND(cdt:Map('k', 1) AS ?m) UNFOLD(?m AS ?o) }", ['"k"']),
    ("SELECT ?o { BIND('[1, 2.0]'^^cdt:List = '[1.0, 2]'^^cdt:List AS ?o) }", ['"true"^^<http://www.w3.org/2001/XMLSchema#boolean>']),
    ("SELECT (FOLD(?v ORDER BY ?v) AS ?o) { VALUES ?v { 3 1 2 } }", [f'"[1, 2, 3]"^^<{R.CDT}List>']),
    ("SELECT ?o { VALUES ?o { 1 'a' :b } }", ['"1"^^<http://www.w3.org/2001/XMLSchema#integer>', '"a"', "<http://x/b>"]),
    ("SELECT (STRAFTER('abc'@en, 'b') AS ?o) {}", ['"c"@en']),
    ("SELECT (REPLACE('abab', '(a)(b)', '$2$1') AS ?o) {}", ['"baba"']),
    ("SELECT (1/0 AS ?o) {}", [None]),
    ("SELECT (IF(1/0, 1, 2) AS ?o) {}", [None]),
    ("SELECT (COALESCE(1/0, 'ok') AS ?o) {}", ['"ok"']),
    ("SELECT ?o { { :a :q ?o } UNION { :b :q ?o } FILTER(LANG(?o) = '') }", ['"y"']),
    ("SELECT ?o { OPTIONAL { :nobody :q ?x } { :a :p ?o } }", ["<http://x/b>"]),
    ("SELECT (STRLEN(GROUP_CONCAT(?v; SEPARATOR='')) AS ?o) { :a :q ?v }", ['"2"^^<http://www.w3.org/2001/XMLSchema#integer>']),
    ("SELECT ?o { ?o !(:p|:q|:n|:when|:list|:source|rdf:first|rdf:rest|rdf:type) ?y }", []),
]


@pytest.mark.parametrize(("text", "want"), CASES, ids=[c[0][:60] for c in CASES])
def test_query(data, text, want):
    assert [v for (v,) in values(data, text, "o")] == sorted(want, key=lambda x: repr((x,)))


def test_construct_describe_ask(data):
    got = {(R.nt(R.from_row(r.s)), r.p, R.nt(R.from_row(r.o))) for r in data.construct(PRE + "CONSTRUCT { ?o :r ?s } WHERE { ?s :p ?o FILTER(?s = :a) }").collect()}
    assert got == {("<http://x/b>", "http://x/r", "<http://x/a>")}
    assert data.construct(PRE + "DESCRIBE :b").count() == 1
    blanks = data.construct(PRE + "CONSTRUCT { _:n :r ?s } WHERE { ?s :p ?o }").collect()
    assert len({r.s.v for r in blanks}) == 3
    assert data.ask(PRE + "ASK { :a :p :b }") and not data.ask(PRE + "ASK { :b :p :b }")


def test_updates(data):
    d = data.update(PRE + "INSERT DATA { :new :p 1 . GRAPH :g9 { :x :y :z } } ; DELETE WHERE { :a :p ?x } ; DELETE { ?s :q ?v } INSERT { ?s :r ?v } WHERE { ?s :q ?v FILTER(LANG(?v) = '') }")
    assert d.holds(R.Iri("http://x/new")) and not d.ask(PRE + "ASK { :a :p ?x }") and d.ask(PRE + "ASK { :a :r 'y' ; :q 'x'@en-US }")
    assert d.update(PRE + "MOVE :g1 TO :g3").ask(PRE + "ASK { GRAPH :g3 { :a :p :z } FILTER NOT EXISTS { GRAPH :g1 { ?a ?b ?c } } }")
    assert d.update("CLEAR NAMED").graphs().count() == 0 and d.update("DROP ALL").count() == 0
    assert d.update("CREATE GRAPH <http://x/e> ; LOAD SILENT <file:///nowhere.ttl>").etag() == d.etag()
    w = d.update(PRE + "WITH :g1 DELETE { ?s :q ?o } WHERE { ?s :q ?o }")
    assert not w.ask(PRE + "ASK { GRAPH :g1 { ?s :q ?o } }") and w.ask(PRE + "ASK { ?s :q ?o }")


def test_lists_and_access(data):
    head = data.match(p=R.Iri("http://x/list")).first().o
    assert data.rdf_list(R.from_row(head)) == [R.Literal("1", XSD + "integer"), R.Literal("two"), R.Iri("http://x/three")]
    start, more = data.add_list([R.Literal("m")])
    assert more.rdf_list(start) == [R.Literal("m")] and more.count() == data.count() + 2
    assert data.graph_nodes("http://x/g2").count() == 2


def test_extensions(spark, data):
    r = Registry(functions={"http://f/twice": lambda t: R.struct(R.LITERAL, F.concat(t["v"], t["v"]), t["dt"])}, forms={"http://f/known": lambda t: R.struct(R.LITERAL, F.when(t.isNull(), "no").otherwise("yes"), F.lit(R.STRING))}, aggregates={"http://f/longest": lambda t: F.max_by(t, F.length(t["v"]))})
    d = Dataset(spark, data.quads, registry=r, endpoints={"http://e/": data})
    q = "SELECT (<http://f/twice>('ab') AS ?a) (<http://f/known>(?none) AS ?b) (<http://f/twice>(?none) AS ?c) {}"
    assert values(d, q, "a", "b", "c") == [('"abab"', '"no"', None)]
    assert values(d, "SELECT (<http://f/longest>(?v) AS ?l) { GRAPH ?g { ?s :q ?v } }", "l") == [('"in g1"',)]
    assert values(d, "SELECT ?o { SERVICE <http://e/> { :a :p ?o } }", "o") == [("<http://x/b>",)]
    assert values(d, "SELECT ?o { :b :p ?o SERVICE SILENT <http://none/> { ?x :p ?o } }", "o") == [("<http://x/c>",)]


@pytest.mark.parametrize("form", ["srj", "srx", "tsv"])
def test_result_formats_round_trip(data, form):
    rows = data.terms(PRE + "SELECT ?x ?o { { ?x :q ?o } UNION { ?x :source ?o } UNION { ?x :n ?o } }")
    names, back = results.parse(results.write(["x", "o"], rows, form), form)
    assert names == ["x", "o"] and isomorphic([(r["x"], r["o"]) for r in back], [(r["x"], r["o"]) for r in rows])
    assert results.parse(results.write_boolean(True, form), form) is True if form != "tsv" else True


def test_other_result_formats():
    rows = [{"a": R.Literal('x,"y'), "b": R.Blank("b")}, {"a": R.Iri("http://x/<")}]
    assert results.parse(results.write(["a", "b"], rows, "csv"), "csv")[1][0] == {"a": R.Literal('x,"y'), "b": R.Blank("b")}
    assert "&lt;" in results.write(["a", "b"], rows, "html") and results.write(["a"], rows, "text").count("|") == 6


@pytest.mark.parametrize("form", ["nquads", "trig", "turtle", "rdfxml", "canonical"])
def test_serialisers_round_trip(form):
    quads = [q for q in readers.parse(TRIG, "trig", "http://x/") if form in ("nquads", "trig") or q[3] is None]
    if form == "rdfxml":
        quads = [q for q in quads if not isinstance(q[0], R.Triple)]
    text = writers.serialise(quads, form, {"e": "http://x/"})
    back = readers.parse(text, {"canonical": "ntriples"}.get(form, form), "http://x/")
    assert isomorphic(back, quads)


def test_files_are_read_natively(spark, tmp_path):
    (tmp_path / "a.nq").write_text('<http://a> <http://p> "x\\n\\u00e9\\"q"@EN .\n# comment\n\n_:b <http://p> << <http://a> <http://p>  "1" >> <http://g> .\n')
    got = readers.read(spark, str(tmp_path / "a.nq"))
    assert {(r.s.k, r.o.v, r.o.lang, r.g) for r in got.collect()} == {(2, 'x\né"q', "en", None), (1, '<< <http://a> <http://p> "1" >>', None, "http://g")}
    (tmp_path / "b.ttl").write_text("<x> <p> 1 .")
    assert readers.read(spark, str(tmp_path / "b.ttl")).count() == 1
    (tmp_path / "in").mkdir()
    stream = quad_stream(spark, str(tmp_path / "in"))
    (tmp_path / "in/1.nt").write_text("<http://a> <http://p> <http://o> .\n")
    query = stream.writeStream.format("memory").queryName("quads_in").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("quads_in").count() == 1


def test_isomorphism():
    a = readers.parse("_:a <p:p> _:b . _:b <p:p> _:a . _:c <p:p> _:c .", "turtle")
    b = readers.parse("_:x <p:p> _:x . _:y <p:p> _:z . _:z <p:p> _:y .", "turtle")
    c = readers.parse("_:x <p:p> _:y . _:y <p:p> _:z . _:z <p:p> _:x .", "turtle")
    assert isomorphic(a, b) and not isomorphic(a, c) and subgraph(a[:1], b) and canonical(a) != canonical(c)


QUERIES = [c[0] for c in CASES] + ["SELECT DISTINCT ?x (COUNT(*) AS ?n) { ?x ?p ?o OPTIONAL { ?o ?q ?z FILTER(?z > ?n0) } } GROUP BY ?x HAVING(COUNT(*) > 1) ORDER BY DESC(?n) LIMIT 3 OFFSET 1", "ASK { { ?a ?b ?c } UNION { GRAPH ?g { ?c ?b ?a } } MINUS { ?a :p 1 } }"]


@pytest.mark.parametrize("text", QUERIES, ids=[q[:50] for q in QUERIES])
def test_unparse_round_trips(text):
    once = unparse.query(parse_query(PRE + text))
    assert unparse.query(parse_query(once)) == once


def test_unparse_updates():
    text = PRE + "INSERT DATA { :a :b :c } ; WITH :g DELETE { ?s ?p ?o } INSERT { GRAPH :h { ?s ?p ?o } } USING :u WHERE { ?s ?p ?o } ; CLEAR SILENT NAMED ; COPY DEFAULT TO :g ; LOAD <http://x/f> INTO GRAPH :g ; CREATE GRAPH :n"
    once = unparse.update(parse_update(text))
    assert unparse.update(parse_update(once)) == once


def test_registered_datatype(spark):
    r = Registry(datatypes={"http://d/len": lambda v: F.length(v)})
    d = Dataset.of(spark, [], registry=r)
    q = "SELECT ?e ?l { VALUES (?a ?b) { ('xx'^^<http://d/len> 'yy'^^<http://d/len>) } BIND(?a = ?b AS ?e) BIND(?a < 'zzz'^^<http://d/len> AS ?l) }"
    assert [(r["e"].value, r["l"].value) for r in d.terms(q)] == [("true", "true")]


def test_term_maps(spark):
    from tessera import rdf, termmaps

    d = Dataset.of(spark, [(rdf.blank("b"), rdf.iri("http://p"), rdf.dtliteral(v, XSD + t)) for v, t in (("+007", "integer"), ("1.500", "decimal"), ("15e1", "double"), ("1", "boolean"), ("bad", "integer"))])
    got = {R.from_row(r.o).value for r in termmaps.map_quads(d.quads, termmaps.canonical).collect()}
    assert got == {"7", "1.5", "1.5E2", "true", "bad"}
    assert {r.s.v for r in termmaps.map_quads(d.quads, lambda t: termmaps.rename_blanks(t, "k")).collect()} == {"kb"}
    moved = termmaps.rewrite_iris(R.const(R.Iri("http://p/x")), "http://p/", "urn:")
    assert spark.range(1).select(moved.alias("t")).first().t.v == "urn:x"


def test_algebra_by_constructors(spark, data):
    from tessera.rdf import bgp, iri, select, triple, variable

    q = select(bgp(triple(iri("http://x/a"), iri("http://x/p"), variable("o"))))
    assert data.select(q).collect()[0].o == "http://x/b"


def test_one_frame_a_graph(spark, data):
    t = data.quads.where("g is null").select("s", "p", "o")
    d = Dataset.of_graphs(spark, {None: t, "http://x/copy": t})
    assert d.ask(PRE + "ASK { :a :p :b GRAPH :copy { :a :p :b } }")


def test_negotiation():
    assert results.negotiate("text/csv;q=0.5, application/sparql-results+xml") == "srx"
    assert results.negotiate("*/*") == "srj" and results.negotiate("image/png") == "srj"


DIFFERENTIAL = ["{ ?s :p ?o . ?o :p ?z FILTER(?s != ?z) }", "{ { ?s :p ?o } UNION { ?s :q ?o } FILTER(ISIRI(?o)) }", "{ { ?s :p ?o } { ?o :p ?z } OPTIONAL { ?z :q ?v } FILTER(BOUND(?v) && ?s = :b) }", "{ { ?s :q ?o FILTER(LANG(?o) = '') } { VALUES ?s { :a :b } } }", "{ ?s :n ?o FILTER EXISTS { ?s :p ?x FILTER(?x != ?o) } }"]


@pytest.mark.parametrize("pattern", DIFFERENTIAL)
def test_rewrites_change_nothing(data, pattern):
    from dataclasses import replace

    text = PRE + "SELECT * " + pattern
    bag = lambda d: sorted(repr(sorted((k, R.nt(v)) for k, v in r.items())) for r in d.terms(text))
    assert bag(data) == bag(replace(data, optimize=False))
