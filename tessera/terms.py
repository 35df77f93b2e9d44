"""RDF terms: driver-side values, their N-Triples form, and the TERM struct used in DataFrames.

A TERM column is ``struct<k:int, v:string, dt:string, lang:string>`` with k 1 blank node, 2 IRI,
3 literal, 4 quoted triple (v is then its canonical N-Triples text). An unbound variable is a
null struct. Struct equality is term identity.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
CDT = "http://w3id.org/awslabs/neptune/SPARQL-CDTs/"
BLANK, IRI_, LITERAL, TRIPLE = 1, 2, 3, 4
TERM = "struct<k:int,v:string,dt:string,lang:string>"

INTEGERS = [XSD + n for n in ("integer long int short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte").split()]
NUMERIC = [*INTEGERS, XSD + "decimal", XSD + "float", XSD + "double"]
STRING, LANG_STRING = XSD + "string", RDF + "langString"


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Blank:
    value: str


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = STRING
    lang: str | None = None


@dataclass(frozen=True)
class Triple:
    s: object
    p: object
    o: object


@dataclass(frozen=True)
class Var:
    name: str


Term = Iri | Blank | Literal | Triple


def language(tag: str) -> str:
    """A language tag in its conventional case: ``en-US``, ``zh-Hant``."""
    head, *rest = tag.lower().split("-")
    return "-".join([head, *[x.upper() if len(x) == 2 else x.title() if len(x) == 4 else x for x in rest]])


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def escape(text: str) -> str:
    return re.sub(r'[\\"\n\r\t]', lambda m: _ESCAPES[m[0]], text)


_UNESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    if "\\" not in text:
        return text

    def plain(m: re.Match) -> str:
        if m[1] or m[2]:
            return chr(int(m[1] or m[2], 16))
        if m[3] not in _UNESCAPES:
            raise ValueError(f"bad escape {m[0]!r}")
        return _UNESCAPES[m[3]]

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", plain, text, flags=re.S)


def nt(t: object) -> str:
    """The N-Triples text of a term."""
    match t:
        case Iri(v):
            return f"<{v}>"
        case Blank(v):
            return f"_:{v}"
        case Literal(v, _, lang) if lang:
            return f'"{escape(v)}"@{lang}'
        case Literal(v, dt, _):
            return f'"{escape(v)}"' + (f"^^<{dt}>" if dt != STRING else "")
        case Triple(s, p, o):
            return f"<< {nt(s)} {nt(p)} {nt(o)} >>"
        case Var(n):
            return f"?{n}"
    raise TypeError(f"not a term: {t!r}")


_NT = re.compile(r'\s*(?:(<<)|(>>)|<([^<>"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>"{}|^`\\\x00-\x20]*)*)>|_:([^\s<>"]+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)', re.S)


def parse_nt(text: str, at: int = 0) -> tuple[Term, int]:
    """One term at a place of an N-Triples text, and where it ends."""
    m = _NT.match(text, at)
    if not m or m[2]:
        raise ValueError(f"no term at {text[at : at + 40]!r}")
    if m[1]:
        s, at = parse_nt(text, m.end())
        p, at = parse_nt(text, at)
        o, at = parse_nt(text, at)
        end = _NT.match(text, at)
        if not end or not end[2]:
            raise ValueError("unclosed quoted triple")
        return Triple(s, p, o), end.end()
    if m[3] is not None:
        return Iri(unescape(m[3])), m.end()
    if m[4] is not None:
        return Blank(m[4].rstrip(".")), m.end() - (len(m[4]) - len(m[4].rstrip(".")))
    if m[7]:
        return Literal(unescape(m[5]), LANG_STRING, language(m[7])), m.end()
    return Literal(unescape(m[5]), unescape(m[6]) if m[6] else STRING), m.end()


def row(t: Term | None) -> tuple | None:
    """A term as the fields of a TERM struct."""
    match t:
        case None:
            return None
        case Iri(v):
            return (IRI_, v, None, None)
        case Blank(v):
            return (BLANK, v, None, None)
        case Literal(v, dt, lang):
            return (LITERAL, v, dt, lang)
        case Triple():
            return (TRIPLE, nt(t), None, None)
    raise TypeError(f"not a ground term: {t!r}")


def from_row(r: object) -> Term | None:
    """The term of a TERM struct's Row, tuple or dict."""
    if r is None:
        return None
    k, v, dt, lang = (r["k"], r["v"], r["dt"], r["lang"]) if isinstance(r, dict) else tuple(r)
    if k == IRI_:
        return Iri(v)
    if k == BLANK:
        return Blank(v)
    return Literal(v, dt, lang) if k == LITERAL else parse_nt(v)[0]


def struct(k: Column | int, v: Column, dt: Column | None = None, lang: Column | None = None) -> Column:
    """A TERM column; null where ``v`` is null."""
    k = F.lit(k) if isinstance(k, int) else k
    none = F.lit(None).cast("string")
    whole = F.struct(k.cast("int").alias("k"), v.alias("v"), (none if dt is None else dt).alias("dt"), (none if lang is None else lang).alias("lang"))
    return F.when(v.isNotNull(), whole)


def const(t: Term) -> Column:
    """A constant TERM column."""
    k, v, dt, lang = row(t)
    opt = lambda x: F.lit(x).cast("string")
    return F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"), opt(dt).alias("dt"), opt(lang).alias("lang"))


def escaped(v: Column) -> Column:
    """N-Triples escapes of a string column."""
    for raw, safe in _ESCAPES.items():
        v = F.replace(v, F.lit(raw), F.lit(safe))
    return v


def nt_column(t: Column) -> Column:
    """The N-Triples text of a TERM column; null stays null."""
    quoted = F.concat(F.lit('"'), escaped(t["v"]), F.lit('"'))
    literal = F.when(t["lang"].isNotNull(), F.concat(quoted, F.lit("@"), t["lang"])).when(t["dt"] == STRING, quoted).otherwise(F.concat(quoted, F.lit("^^<"), t["dt"], F.lit(">")))
    return F.when(t["k"] == IRI_, F.concat(F.lit("<"), t["v"], F.lit(">"))).when(t["k"] == BLANK, F.concat(F.lit("_:"), t["v"])).when(t["k"] == LITERAL, literal).otherwise(t["v"])
