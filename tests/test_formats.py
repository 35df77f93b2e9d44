"""Own small documents for each rule of the RDF grammars, with the triples they must give, and documents to reject."""

from __future__ import annotations

import pytest

from tessera import terms as R
from tessera.isomorphism import isomorphic
from tessera.plans.parser import SyntaxError_, parse_query, parse_update
from tessera.sources import readers
from tessera.sources.dataset import Dataset

BASE = "http://example.org/dir/doc"
PRE = "@prefix : <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . "
INT, DEC, DBL, BOOL = (f"^^<http://www.w3.org/2001/XMLSchema#{t}>" for t in ("integer", "decimal", "double", "boolean"))
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

TURTLE = {
    "iris": ("<http://x/a> <p> <#f>, <../up>, <?q> .", "<http://x/a> <http://example.org/dir/p> <http://example.org/dir/doc#f> .\n<http://x/a> <http://example.org/dir/p> <http://example.org/up> .\n<http://x/a> <http://example.org/dir/p> <http://example.org/dir/doc?q> ."),
    "base": ("@base <http://y/z/> . <a> <b> <c> . BASE <http://w/> <a> <b> <c> .", "<http://y/z/a> <http://y/z/b> <http://y/z/c> .\n<http://w/a> <http://w/b> <http://w/c> ."),
    "prefixes": ("@prefix e: <http://e/> . PREFIX : <http://x/> e:a :b e:c\\,d, e:x%20y, e:1.2 .", "<http://e/a> <http://x/b> <http://e/c,d> .\n<http://e/a> <http://x/b> <http://e/x%20y> .\n<http://e/a> <http://x/b> <http://e/1.2> ."),
    "lists of objects": (PRE + ":a :p :b , :c ; :q :d ; ; a :T ; .", f"<http://x/a> <http://x/p> <http://x/b> .\n<http://x/a> <http://x/p> <http://x/c> .\n<http://x/a> <http://x/q> <http://x/d> .\n<http://x/a> <{RDF}type> <http://x/T> ."),
    "numbers": (PRE + ":a :p 1, -2, +3.5, .5, 1e3, -1.2E-4, true, false .", "\n".join(f"<http://x/a> <http://x/p> {x} ." for x in (f'"1"{INT}', f'"-2"{INT}', f'"+3.5"{DEC}', f'".5"{DEC}', f'"1e3"{DBL}', f'"-1.2E-4"{DBL}', f'"true"{BOOL}', f'"false"{BOOL}'))),
    "strings": (PRE + r""":a :p "d", 's', "\t\"\u00e9\U0001F600", "x"@en, 'y'@de-AT, "1"^^xsd:integer .""", "\n".join(f"<http://x/a> <http://x/p> {x} ." for x in ('"d"', '"s"', '"\\t\\"é😀"', '"x"@en', '"y"@de-AT', f'"1"{INT}'))),
    "long strings": (PRE + ':a :p """a\n"b" \'\'c""", \'\'\'d"""\n\'e\'\'\' .', '<http://x/a> <http://x/p> "a\\n\\"b\\" \'\'c" .\n<http://x/a> <http://x/p> "d\\"\\"\\"\\n\'e" .'),
    "blank nodes": (PRE + "_:a :p _:b.c , [] . [ :q :c ; :r [ :s _:a ] ] :t 1 . [ :u 2 ] .", f'_:a <http://x/p> _:b .\n_:a <http://x/p> _:c .\n_:d <http://x/q> <http://x/c> .\n_:d <http://x/r> _:e .\n_:e <http://x/s> _:a .\n_:d <http://x/t> "1"{INT} .\n_:f <http://x/u> "2"{INT} .'),
    "collections": (PRE + ":a :p ( 1 :b ) , () . ( :c ) :q :d .", f'<http://x/a> <http://x/p> _:l .\n_:l <{RDF}first> "1"{INT} .\n_:l <{RDF}rest> _:m .\n_:m <{RDF}first> <http://x/b> .\n_:m <{RDF}rest> <{RDF}nil> .\n<http://x/a> <http://x/p> <{RDF}nil> .\n_:n <{RDF}first> <http://x/c> .\n_:n <{RDF}rest> <{RDF}nil> .\n_:n <http://x/q> <http://x/d> .'),
    "comments": (PRE + "# one\n:a#two\n :p :b . # three", "<http://x/a> <http://x/p> <http://x/b> ."),
    "quoted": (PRE + "<< :a :b :c >> :p << _:x :q << :d :e 1 >> >> .", f'<< <http://x/a> <http://x/b> <http://x/c> >> <http://x/p> << _:x <http://x/q> << <http://x/d> <http://x/e> "1"{INT} >> >> .'),
    "annotations": (PRE + ":a :p :b {| :source :s ; :when 1 |} , :c .", f'<http://x/a> <http://x/p> <http://x/b> .\n<< <http://x/a> <http://x/p> <http://x/b> >> <http://x/source> <http://x/s> .\n<< <http://x/a> <http://x/p> <http://x/b> >> <http://x/when> "1"{INT} .\n<http://x/a> <http://x/p> <http://x/c> .'),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", TURTLE)
def test_turtle(name):
    text, want = TURTLE[name]
    got = [q[:3] for q in readers.parse(text, "turtle", BASE)]
    assert isomorphic(got, [q[:3] for q in readers.parse(want, "ntriples")])


BAD_TURTLE = ["<a> <b> .", "<a> <b> <c>", ":a :b :c .", "<a> \"p\" <c> .", "\"s\" <p> <o> .", "<a> <b> 'x .", "<a> <b> ( 1 .", "<a> <b> [ <c> ] .", "@prefix x <http://x/> .", "<a b> <c> <d> .", "<a> <b> <c> ; ; <d> .", "<< <a> <b> >> <c> <d> .", "<< <a> <b> ( 1 ) >> <c> <d> .", "<a> <b> true1 .", "<a> <b> \"x\"@ .", "<a> <b> \"\\q\" .", "<a> _:p <c> .", "a <b> <c> ."]


@pytest.mark.parametrize("text", BAD_TURTLE)
def test_bad_turtle(text):
    with pytest.raises(ValueError):
        readers.parse(text, "turtle", BASE)


def test_trig():
    got = readers.parse("@prefix : <http://x/> . :a :p :b . :g { :a :p 1 . :c :q [] } GRAPH _:h { :d :p :e } { :f :p :i }", "trig", BASE)
    assert {(R.nt(q[2]) if not isinstance(q[2], R.Blank) else "[]", None if q[3] is None else type(q[3]).__name__) for q in got} == {("<http://x/b>", None), (f'"1"{INT}', "Iri"), ("[]", "Iri"), ("<http://x/e>", "Blank"), ("<http://x/i>", None)}
    for bad in ("@prefix : <http://x/> . :g { :a :p :b ", "@prefix : <http://x/> . :g { :g { :a :p :b } }", "{ <a> <b> <c> } ; <d> <e>"):
        with pytest.raises(ValueError):
            readers.parse(bad, "trig", BASE)


XML = f'<rdf:RDF xmlns:rdf="{RDF}" xmlns="http://x/" xml:base="http://b/d/">%s</rdf:RDF>'
RDFXML = {
    '<rdf:Description rdf:about="a"><p rdf:resource="c"/><q>text</q></rdf:Description>': '<http://b/d/a> <http://x/p> <http://b/d/c> .\n<http://b/d/a> <http://x/q> "text" .',
    '<T rdf:ID="i" e:p="v" xmlns:e="http://x/"/>': f'<http://b/d/#i> <{RDF}type> <http://x/T> .\n<http://b/d/#i> <http://x/p> "v" .',
    '<T rdf:nodeID="n"><p rdf:parseType="Resource"><q xml:lang="en">x</q></p></T>': f'_:n <{RDF}type> <http://x/T> .\n_:n <http://x/p> _:m .\n_:m <http://x/q> "x"@en .',
    '<rdf:Description rdf:about="a"><p rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">1</p><p><T/></p></rdf:Description>': f'<http://b/d/a> <http://x/p> "1"{INT} .\n<http://b/d/a> <http://x/p> _:t .\n_:t <{RDF}type> <http://x/T> .',
    '<rdf:Bag rdf:about="a"><rdf:li>x</rdf:li><rdf:li>y</rdf:li></rdf:Bag>': f'<http://b/d/a> <{RDF}type> <{RDF}Bag> .\n<http://b/d/a> <{RDF}_1> "x" .\n<http://b/d/a> <{RDF}_2> "y" .',
    '<rdf:Description rdf:about="a"><p rdf:parseType="Collection"><rdf:Description rdf:about="m"/></p></rdf:Description>': f"<http://b/d/a> <http://x/p> _:l .\n_:l <{RDF}first> <http://b/d/m> .\n_:l <{RDF}rest> <{RDF}nil> .",
    '<rdf:Description rdf:about="a"><p rdf:ID="r">v</p></rdf:Description>': f'<http://b/d/a> <http://x/p> "v" .\n<http://b/d/#r> <{RDF}type> <{RDF}Statement> .\n<http://b/d/#r> <{RDF}subject> <http://b/d/a> .\n<http://b/d/#r> <{RDF}predicate> <http://x/p> .\n<http://b/d/#r> <{RDF}object> "v" .',
}


@pytest.mark.parametrize("text", RDFXML)
def test_rdfxml(text):
    got = [q[:3] for q in readers.parse(XML % text, "rdfxml", BASE)]
    assert isomorphic(got, [q[:3] for q in readers.parse(RDFXML[text], "ntriples")])


@pytest.mark.parametrize("text", ['<rdf:Description rdf:about="a" rdf:ID="b"/>', '<rdf:Description rdf:ID="1x"/>', '<T rdf:ID="i"/><T rdf:ID="i"/>', "<rdf:Description", '<rdf:Description rdf:bagID="q"/>', "<rdf:li/>"])
def test_bad_rdfxml(text):
    with pytest.raises(ValueError):
        readers.parse(XML % text, "rdfxml", BASE)


GOOD_STAR = [
    "SELECT * { << ?s :p ?o >> :q ?z }", "SELECT * { ?s :p ?o {| :q ?z ; :r 1 |} }", "SELECT * { << << :a :b ?c >> :p ?o >> ?q ?z }", "SELECT (<< ?s ?p ?o >> AS ?t) { ?s ?p ?o }",
    "SELECT * { ?s ?p ?o FILTER(isTRIPLE(<< ?s ?p ?o >>) && SUBJECT(?s) = :a) }", "CONSTRUCT { << ?s ?p ?o >> :q 1 } WHERE { ?s ?p ?o }", "ASK { :a :p << :b :q _:x >> }", "SELECT * { VALUES ?t { << :a :b :c >> } }",
]
BAD_STAR = ["SELECT * { << ?s :p ?o }", "SELECT * { << ?s ?p >> ?q ?z }", "SELECT * { ?s << :a :b :c >> ?o }", "SELECT * { << ?s :p/:q ?o >> ?x ?y }", "SELECT * { ?s :p ?o {| |} }", "SELECT * { << ( 1 ) :p ?o >> ?x ?y }", "SELECT (<< ?s ?p >> AS ?t) {}", "SELECT * { ?s :p/:q ?o {| :r 1 |} }"]


@pytest.mark.parametrize("text", GOOD_STAR)
def test_star_syntax(text):
    parse_query("PREFIX : <http://x/> " + text)
    assert parse_update("PREFIX : <http://x/> INSERT DATA { << :a :b :c >> :p :o {| :q 1 |} }").operations


@pytest.mark.parametrize("text", BAD_STAR)
def test_bad_star_syntax(text):
    with pytest.raises(SyntaxError_):
        parse_query("PREFIX : <http://x/> " + text)


def test_star_evaluation(spark):
    data = Dataset.of(spark, readers.parse(PRE + ":a :p :b {| :since 1 |} . :c :p :d . << :c :p :d >> :since 2 . << << :a :p :b >> :since 1 >> :by :me .", "turtle"))
    ask = lambda q: sorted(tuple(sorted((k, R.nt(v)) for k, v in r.items())) for r in data.terms("PREFIX : <http://x/> " + q))
    assert ask("SELECT ?s ?k { << ?s :p ?o >> :since ?k }") == [(("k", f'"1"{INT}'), ("s", "<http://x/a>")), (("k", f'"2"{INT}'), ("s", "<http://x/c>"))]
    assert ask("SELECT ?who { << << ?s :p ?o >> :since ?k >> :by ?who }") == [(("who", "<http://x/me>"),)]
    assert ask("SELECT ?o { ?s :p ?o {| :since 2 |} }") == [(("o", "<http://x/d>"),)]
    assert ask("SELECT ?p { ?t :since 1 BIND(PREDICATE(?t) AS ?p) }") == [(("p", "<http://x/p>"),)]
    assert ask("SELECT ?t { VALUES ?t { << :c :p :d >> } ?t :since ?k }") == [(("t", "<< <http://x/c> <http://x/p> <http://x/d> >>"),)]
    assert data.ask("PREFIX : <http://x/> ASK { FILTER(<< :a :p 1 >> = << :a :p 1.0 >> && !sameTerm(<< :a :p 1 >>, << :a :p 1.0 >>)) }")


def test_blank_labels_in_lists_follow_the_document():
    quads = readers.parse(f'_:b <http://x/p> "[1, _:b, [_:c], \\"_:d\\"]"^^<{R.CDT}List> .'.replace('"[1', '"[1'), "turtle", BASE, "s-")
    label = quads[0][0].value
    assert label.startswith("s-") and quads[0][2].value == f'[1, _:{label}, [_:s-c], "_:d"]'
