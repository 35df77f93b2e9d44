"""RDF/XML documents to triples, by a namespace-aware SAX handler."""

from __future__ import annotations

import io
import xml.sax
from xml.sax.handler import ContentHandler, feature_external_ges, feature_namespaces
from xml.sax.saxutils import escape, quoteattr

from tessera.plans.parser import resolve
from tessera.terms import LANG_STRING, RDF, STRING, Blank, Iri, Literal, language

XML = "http://www.w3.org/XML/1998/namespace"
#: Fixed names of the grammar that aren't allowed as property or node elements.
CORE = {RDF + n for n in "RDF ID about parseType resource nodeID datatype".split()}
OLD = {RDF + n for n in "aboutEach aboutEachPrefix bagID".split()}


class RdfXmlError(ValueError):
    """A document that breaks the RDF/XML grammar."""


class Frame:
    """An open element: ``node`` (with its subject), ``property`` (waiting for content), ``collection`` or ``literal``."""

    def __init__(self, kind: str, base: str, lang: str):
        self.kind, self.base, self.lang = kind, base, lang
        self.subject: object = None
        self.predicate = ""
        self.object: object = None
        self.datatype = self.reified = None
        self.text: list[str] = []
        self.items: list = []
        self.li = 0
        self.depth = 0


class Handler(ContentHandler):
    def __init__(self, base: str, scope: str):
        super().__init__()
        self.base, self.scope, self.n = base, scope, 0
        self.out: list[tuple] = []
        self.frames: list[Frame] = []
        self.ids: set[str] = set()
        self.namespaces: list[tuple[str | None, str]] = []

    def blank(self) -> Blank:
        self.n += 1
        return Blank(f"{self.scope}g{self.n}")

    def add(self, s: object, p: str, o: object, reified: str | None = None) -> None:
        self.out.append((s, Iri(p), o, None))
        if reified:
            r = Iri(reified)
            for name, x in (("type", Iri(RDF + "Statement")), ("subject", s), ("predicate", Iri(p)), ("object", o)):
                self.out.append((r, Iri(RDF + name), x, None))

    def text_literal(self, value: str, lang: str) -> Literal:
        return Literal(value, LANG_STRING, language(lang)) if lang else Literal(value, STRING)

    def startPrefixMapping(self, prefix, uri):  # noqa: N802
        self.namespaces.append((prefix, uri))

    def endPrefixMapping(self, prefix):  # noqa: N802
        for i in reversed(range(len(self.namespaces))):
            if self.namespaces[i][0] == prefix:
                del self.namespaces[i]
                return

    def startElementNS(self, name, qname, attrs):  # noqa: N802
        top = self.frames[-1] if self.frames else None
        if top and top.kind == "literal":
            top.depth += 1
            top.text.append(self.open_tag(name, attrs, top.depth == 1))
            return
        base, lang = (top.base, top.lang) if top else (self.base, "")
        found = {}
        for (ns, local), value in attrs.items():
            if ns == XML:
                if local == "base":
                    base = resolve(base, value).split("#")[0]
                elif local == "lang":
                    lang = value
            elif ns is None and local.lower().startswith("xml"):
                continue
            else:
                found[(ns or (RDF if local in ("ID", "about", "resource", "parseType", "type", "nodeID", "datatype", "bagID", "aboutEach") else "")) + local] = value
        iri = (name[0] or "") + name[1]
        if set(found) & OLD:
            raise RdfXmlError("bagID and aboutEach are not allowed")
        if iri == RDF + "RDF" and not self.frames:
            self.frames.append(Frame("root", base, lang))
        elif top is None or top.kind in ("root", "property", "collection"):
            self.node(iri, found, base, lang, top)
        else:
            self.property(iri, found, base, lang, top)

    def ident(self, value: str, base: str) -> str:
        if not value or not (value[0].isalpha() or value[0] == "_") or not all(c.isalnum() or c in "._-·" for c in value):
            raise RdfXmlError(f"bad ID {value!r}")
        iri = resolve(base, "#" + value)
        if iri in self.ids:
            raise RdfXmlError(f"ID {value!r} is used twice")
        self.ids.add(iri)
        return iri

    def node_id(self, value: str) -> Blank:
        if not value or not (value[0].isalpha() or value[0] == "_") or ":" in value or "/" in value:
            raise RdfXmlError(f"bad nodeID {value!r}")
        return Blank(self.scope + "n" + value)

    def node(self, iri: str, attrs: dict, base: str, lang: str, top: Frame | None) -> None:
        if iri in CORE or iri in OLD or iri == RDF + "li":
            raise RdfXmlError(f"<{iri}> can't be a node element")
        f = Frame("node", base, lang)
        given = [a for a in ("ID", "about", "nodeID") if RDF + a in attrs]
        if len(given) > 1:
            raise RdfXmlError("a node has one of ID, about and nodeID")
        if "ID" in given:
            f.subject = Iri(self.ident(attrs[RDF + "ID"], base))
        elif "about" in given:
            f.subject = Iri(resolve(base, attrs[RDF + "about"]))
        else:
            f.subject = self.node_id(attrs[RDF + "nodeID"]) if given else self.blank()
        if iri != RDF + "Description":
            self.add(f.subject, RDF + "type", Iri(iri))
        self.property_attributes(f.subject, attrs, base, lang, {"ID", "about", "nodeID"})
        if top and top.kind == "property":
            if top.object is not None:
                raise RdfXmlError("a property element holds one node")
            top.object = f.subject
            self.add(top.subject, top.predicate, f.subject, top.reified)
        elif top and top.kind == "collection":
            top.items.append(f.subject)
        self.frames.append(f)

    def property_attributes(self, subject: object, attrs: dict, base: str, lang: str, skip: set[str]) -> None:
        for a, value in attrs.items():
            if a.startswith(RDF) and a[len(RDF) :] in skip:
                continue
            if a == RDF + "type":
                self.add(subject, a, Iri(resolve(base, value)))
            elif a in CORE or a == RDF + "li" or a == RDF + "Description":
                raise RdfXmlError(f"attribute <{a}> is not allowed here")
            else:
                self.add(subject, a, self.text_literal(value, lang))

    def property(self, iri: str, attrs: dict, base: str, lang: str, top: Frame) -> None:
        if iri in CORE or iri in OLD or iri == RDF + "Description":
            raise RdfXmlError(f"<{iri}> can't be a property element")
        if iri == RDF + "li":
            top.li += 1
            iri = f"{RDF}_{top.li}"
        f = Frame("property", base, lang)
        f.subject, f.predicate = top.subject, iri
        if RDF + "ID" in attrs:
            f.reified = self.ident(attrs.pop(RDF + "ID"), base)
        kind = attrs.pop(RDF + "parseType", None)
        f.datatype = attrs.pop(RDF + "datatype", None)
        if kind is not None and ({RDF + "resource", RDF + "nodeID"} & set(attrs)):
            raise RdfXmlError("parseType can't go with resource or nodeID")
        if RDF + "resource" in attrs and RDF + "nodeID" in attrs:
            raise RdfXmlError("a property has one of resource and nodeID")
        if kind == "Resource":
            f.kind = "node"
            f.subject = self.blank()
            self.add(top.subject, iri, f.subject, f.reified)
        elif kind == "Collection":
            f.kind = "collection"
        elif kind is not None:
            f.kind = "literal"
        elif attrs:
            resource = attrs.pop(RDF + "resource", None)
            node = attrs.pop(RDF + "nodeID", None)
            o = Iri(resolve(base, resource)) if resource is not None else self.node_id(node) if node is not None else self.blank()
            self.property_attributes(o, attrs, base, lang, set())
            self.add(top.subject, iri, o, f.reified)
            f.object = o
        self.frames.append(f)

    def characters(self, content):
        if not self.frames:
            return
        top = self.frames[-1]
        if top.kind == "literal":
            top.text.append(escape(content))
        elif top.kind == "property":
            top.text.append(content)
        elif content.strip():
            raise RdfXmlError(f"text {content.strip()[:20]!r} is not allowed here")

    def endElementNS(self, name, qname):  # noqa: N802
        top = self.frames[-1]
        if top.kind == "literal" and top.depth:
            top.depth -= 1
            top.text.append(f"</{self.qname(name)}>")
            return
        self.frames.pop()
        if top.kind == "property" and top.object is None:
            text = "".join(top.text)
            dt = top.datatype
            self.add(top.subject, top.predicate, Literal(text, resolve(top.base, dt)) if dt is not None else self.text_literal(text, top.lang), top.reified)
        elif top.kind == "literal":
            self.add(top.subject, top.predicate, Literal("".join(top.text), RDF + "XMLLiteral"), top.reified)
        elif top.kind == "collection":
            cells = [self.blank() for _ in top.items]
            nil = Iri(RDF + "nil")
            self.add(top.subject, top.predicate, cells[0] if cells else nil, top.reified)
            for i, item in enumerate(top.items):
                self.add(cells[i], RDF + "first", item)
                self.add(cells[i], RDF + "rest", cells[i + 1] if i + 1 < len(cells) else nil)

    def qname(self, name) -> str:
        ns, local = name
        if ns is None:
            return local
        prefix = next((p for p, u in reversed(self.namespaces) if u == ns), None)
        return f"{prefix}:{local}" if prefix else local

    def open_tag(self, name, attrs, first: bool) -> str:
        ns = name[0]
        prefix = next((p for p, u in reversed(self.namespaces) if u == ns), None) if ns else None
        declared = f' xmlns{":" + prefix if prefix else ""}={quoteattr(ns)}' if first and ns else ""
        inner = "".join(f" {self.qname(k)}={quoteattr(v)}" for k, v in sorted(attrs.items(), key=lambda x: (x[0][0] or "", x[0][1])))
        return f"<{self.qname(name)}{declared}{inner}>"


def parse(text: str, base: str = "", scope: str = "") -> list[tuple]:
    """Distinct (s, p, o, None) of a document."""
    handler = Handler(base, scope)
    reader = xml.sax.make_parser()
    reader.setFeature(feature_namespaces, True)
    reader.setFeature(feature_external_ges, False)
    reader.setContentHandler(handler)
    try:
        reader.parse(io.BytesIO(text.encode()))
    except xml.sax.SAXException as e:
        raise RdfXmlError(str(e)) from None
    return list(dict.fromkeys(handler.out))
