"""SPARQL result formats: JSON, XML, CSV, TSV, HTML and text tables."""

from __future__ import annotations

import csv
import html
import io
import json
import xml.etree.ElementTree as ET
from collections.abc import Iterable
from functools import cache
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import terms as R
from tessera.plans.parser import Parser
from tessera.terms import LANG_STRING, STRING, Blank, Iri, Literal, Triple

Rows = tuple[list[str], list[dict[str, R.Term]]]
_NS = "{http://www.w3.org/2005/sparql-results#}"
_XML = "{http://www.w3.org/XML/1998/namespace}"
#: Result format by media type.
MEDIA = {"application/sparql-results+json": "srj", "application/sparql-results+xml": "srx", "text/csv": "csv", "text/tab-separated-values": "tsv", "text/html": "html", "text/plain": "text"}


def _json_term(d: dict) -> R.Term:
    kind, v = d["type"], d["value"]
    if kind == "uri":
        return Iri(v)
    if kind == "bnode":
        return Blank(v)
    if kind == "triple":
        part = lambda *names: next(_json_term(v[n]) for n in names if n in v)
        return Triple(part("subject", "s"), part("predicate", "property", "p"), part("object", "o"))
    if "xml:lang" in d:
        return Literal(v, LANG_STRING, R.language(d["xml:lang"]))
    return Literal(v, d.get("datatype", STRING))


def _xml_term(e: ET.Element) -> R.Term:
    tag = e.tag.removeprefix(_NS)
    if tag == "uri":
        return Iri(e.text or "")
    if tag == "bnode":
        return Blank(e.text or "")
    if tag == "triple":
        return Triple(*(_xml_term(next(iter(e.find(_NS + n)))) for n in ("subject", "predicate", "object")))
    lang = e.get(_XML + "lang")
    return Literal(e.text or "", LANG_STRING, R.language(lang)) if lang else Literal(e.text or "", e.get("datatype", STRING))


def parse(text: str, form: str) -> Rows | bool:
    """(variables, solutions) or the boolean of a result document: srj, srx, tsv or csv (plain literals)."""
    form = MEDIA.get(form, form)
    if form == "srj":
        d = json.loads(text)
        if "boolean" in d:
            return d["boolean"]
        return d["head"].get("vars", []), [{n: _json_term(t) for n, t in b.items()} for b in d["results"]["bindings"]]
    if form == "srx":
        root = ET.fromstring(text)
        boolean = root.find(_NS + "boolean")
        if boolean is not None:
            return boolean.text.strip() == "true"
        names = [v.get("name") for v in root.iter(_NS + "variable")]
        return names, [{b.get("name"): _xml_term(next(iter(b))) for b in r.iter(_NS + "binding")} for r in root.iter(_NS + "result")]
    if form == "tsv":
        head, *rows = text.rstrip("\n").split("\n")
        names = [n.lstrip("?$") for n in head.rstrip("\r").split("\t")]
        return names, [{n: Parser(c).data_term() if not c.startswith("_:") else Blank(c[2:]) for n, c in zip(names, r.rstrip("\r").split("\t"), strict=True) if c} for r in rows]
    if form == "csv":
        table = list(csv.reader(io.StringIO(text)))
        return table[0], [{n: Blank(c[2:]) if c.startswith("_:") else Literal(c) for n, c in zip(table[0], r, strict=True) if c} for r in table[1:]]
    raise ValueError(f"no result format {form!r}")


def _json_of(t: R.Term) -> dict:
    match t:
        case Iri(v):
            return {"type": "uri", "value": v}
        case Blank(v):
            return {"type": "bnode", "value": v}
        case Triple(s, p, o):
            return {"type": "triple", "value": {"subject": _json_of(s), "predicate": _json_of(p), "object": _json_of(o)}}
    d = {"type": "literal", "value": t.value}
    if t.lang:
        return d | {"xml:lang": t.lang}
    return d | ({"datatype": t.datatype} if t.datatype != STRING else {})


def _xml_of(t: R.Term) -> str:
    match t:
        case Iri(v):
            return f"<uri>{escape(v)}</uri>"
        case Blank(v):
            return f"<bnode>{escape(v)}</bnode>"
        case Triple(s, p, o):
            return f"<triple><subject>{_xml_of(s)}</subject><predicate>{_xml_of(p)}</predicate><object>{_xml_of(o)}</object></triple>"
    extra = f" xml:lang={quoteattr(t.lang)}" if t.lang else f" datatype={quoteattr(t.datatype)}" if t.datatype != STRING else ""
    return f"<literal{extra}>{escape(t.value)}</literal>"


def write(names: list[str], rows: Iterable[dict[str, R.Term]], form: str) -> str:
    """A result document of solutions on the driver."""
    form = MEDIA.get(form, form)
    if form == "srj":
        return json.dumps({"head": {"vars": names}, "results": {"bindings": [{n: _json_of(r[n]) for n in names if n in r} for r in rows]}}, ensure_ascii=False)
    if form == "srx":
        body = "".join("<result>" + "".join(f"<binding name={quoteattr(n)}>{_xml_of(r[n])}</binding>" for n in names if n in r) + "</result>\n" for r in rows)
        head = "".join(f"<variable name={quoteattr(n)}/>" for n in names)
        return f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{head}</head>\n<results>\n{body}</results></sparql>\n'
    if form == "csv":
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\r\n")
        w.writerow(names)
        w.writerows([[_text(r.get(n)) for n in names] for r in rows])
        return out.getvalue()
    if form == "tsv":
        lines = ["\t".join("?" + n for n in names), *("\t".join(R.nt(r[n]) if n in r else "" for n in names) for r in rows)]
        return "\n".join(lines) + "\n"
    cells = [[R.nt(r[n]) if n in r else "" for n in names] for r in rows]
    if form == "html":
        row = lambda tag, xs: "<tr>" + "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in xs) + "</tr>\n"
        return f"<table>\n<thead>{row('th', names)}</thead>\n<tbody>\n{''.join(row('td', c) for c in cells)}</tbody>\n</table>\n"
    if form == "text":
        widths = [max([len(n), *(len(c[i]) for c in cells)]) for i, n in enumerate(names)]
        line = lambda xs: "| " + " | ".join(x.ljust(w) for x, w in zip(xs, widths, strict=True)) + " |\n"
        rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+\n"
        return rule + line(names) + rule + "".join(map(line, cells)) + rule
    raise ValueError(f"no result format {form!r}")


def write_boolean(value: bool, form: str) -> str:
    form = MEDIA.get(form, form)
    text = "true" if value else "false"
    if form == "srj":
        return f'{{"head": {{}}, "boolean": {text}}}'
    if form == "srx":
        return f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>{text}</boolean></sparql>\n'
    return text + "\n"


def _text(t: R.Term | None) -> str:
    return "" if t is None else f"_:{t.value}" if isinstance(t, Blank) else R.nt(t) if isinstance(t, Triple) else t.value


def tsv_lines(terms: DataFrame) -> DataFrame:
    """TERM columns as lines of a TSV result (column value), for ``write.text``; the header is ``?name`` fields."""
    cells: list[Column] = [F.coalesce(R.nt_column(F.col(n)), F.lit("")) for n in terms.columns]
    return terms.select(F.concat_ws("\t", *cells).alias("value"))


def json_lines(terms: DataFrame) -> DataFrame:
    """TERM columns as one JSON binding a line (column value), the members of a JSON result's bindings.

    Only quoted triples, whose parts are terms themselves, go through Python.
    """

    def term(c: Column) -> Column:
        kind = F.when(c["k"] == R.IRI_, "uri").when(c["k"] == R.BLANK, "bnode").otherwise("literal")
        datatype = F.when((c["dt"] != STRING) & c["lang"].isNull(), c["dt"])
        plain = F.to_json(F.struct(kind.alias("type"), c["v"].alias("value"), datatype.alias("datatype"), c["lang"].alias("xml:lang")))
        return F.when(c["k"] == R.TRIPLE, _triple_json()(F.when(c["k"] == R.TRIPLE, c["v"]))).when(c.isNotNull(), plain)

    members = [F.concat(F.lit(json.dumps(n) + ":"), term(F.col(n))) for n in terms.columns]
    return terms.select(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")).alias("value"))


@cache
def _triple_json():
    """The JSON of quoted triples from their N-Triples text."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else json.dumps(_json_of(R.parse_nt(x, 0)[0]), separators=(",", ":")) for x in texts], dtype=object)

    return run


def negotiate(accept: str, media: dict[str, str] = MEDIA, default: str = "srj") -> str:
    """The format an HTTP Accept header prefers among those of ``media`` (media type to format)."""
    best, best_q = None, 0.0
    for part in accept.split(","):
        kind, *parameters = [x.strip() for x in part.split(";")]
        q = next((float(p[2:]) for p in parameters if p.startswith("q=")), 1.0)
        found = [f for m, f in media.items() if kind in (m, "*/*", m.split("/")[0] + "/*")]
        if found and q > best_q:
            best, best_q = (default if kind == "*/*" else found[0]), q
    return best or default
