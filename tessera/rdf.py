"""Short constructors for terms and patterns."""

from __future__ import annotations

from tessera.plans import algebra as A
from tessera.terms import LANG_STRING, XSD, Blank, Iri, Literal, Triple, Var, language


def iri(value: str) -> Iri:
    return Iri(value)


def blank(label: str) -> Blank:
    return Blank(label)


def variable(name: str) -> Var:
    return Var(name)


def literal(value: object) -> Literal:
    """A literal of a Python value's type."""
    if isinstance(value, bool):
        return Literal("true" if value else "false", XSD + "boolean")
    if isinstance(value, int):
        return Literal(str(value), XSD + "integer")
    return Literal(repr(value), XSD + "double") if isinstance(value, float) else Literal(str(value))


def langliteral(value: str, lang: str) -> Literal:
    return Literal(value, LANG_STRING, language(lang))


def dtliteral(value: str, datatype: str) -> Literal:
    return Literal(value, datatype)


def triple(s: object, p: object, o: object) -> Triple:
    return Triple(s, p, o)


def bgp(*triples: Triple) -> A.Bgp:
    return A.Bgp(tuple(triples))


def select(pattern: A.Node, *names: str) -> A.Query:
    """A SELECT query over a pattern, for Dataset.select()."""
    return A.Query("SELECT", A.Project(pattern, tuple(names or [n for n in A.scope(pattern) if n[0] != "."])))
