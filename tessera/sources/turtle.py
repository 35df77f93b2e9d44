"""Turtle and TriG documents to terms, with quoted triples and annotations."""

from __future__ import annotations

import re

from tessera import terms as R
from tessera.plans.parser import Parser, SyntaxError_
from tessera.terms import Blank, Iri, Literal, Triple

_BAD_IRI = re.compile(r'[<>"{}|^`\\\x00-\x20]')


class Turtle(Parser):
    """Shares the token and triples grammar of SPARQL templates; adds directives, graph blocks and Turtle's own strictness."""

    def __init__(self, text: str, base: str = "", trig: bool = False, scope: str = ""):
        self.trig, self.scope = trig, scope
        super().__init__(text, base, codepoints=False)
        self.template = True
        self.depth = 0

    def quads(self) -> list[tuple]:  # type: ignore[override]
        out: list[tuple] = []
        while self.kind() != "end":
            if not self.directive():
                self.statement(out)
        return list(dict.fromkeys(out))

    def directive(self) -> bool:
        kind, text = self.tokens[self.at]
        at_form = kind == "lang" and text in ("@prefix", "@base")
        word = text.upper() if kind == "word" else ""
        if not at_form and word not in ("PREFIX", "BASE"):
            return False
        self.at += 1
        if text.lstrip("@").upper() == "PREFIX":
            name = self.next("pname")
            if not name.endswith(":") or ":" in name[:-1]:
                self.fail(f"{name!r} is not a prefix")
            self.prefixes[name[:-1]] = self.resolve(self._iri_text(self.next("iri")))
        else:
            self.base = self.resolve(self._iri_text(self.next("iri")))
        if at_form:
            self.need(".")
        return True

    @staticmethod
    def _iri_text(token: str) -> str:
        value = R.unescape(token[1:-1]) if "\\" in token else token[1:-1]
        if _BAD_IRI.search(value):
            raise SyntaxError_(f"bad IRI {token}")
        return value

    def iri(self) -> str:
        if self.kind() == "iri":
            return self.resolve(self._iri_text(self.next("iri")))
        return super().iri()

    def label(self, text: str) -> Blank:
        return Blank(self.scope + text)

    def term(self, quoted: bool = False) -> object:
        if self.kind() == "var":
            self.fail("variables are not allowed")
        return super().term(quoted)

    def quoted(self) -> Triple:
        self.need("<<")
        s = self.term()
        if isinstance(s, Literal):
            self.fail("a literal can't be a subject")
        p = Iri(self.verb_iri())
        o = self.term()
        self.need(">>")
        return Triple(s, p, o)

    def statement(self, out: list) -> None:
        if self.trig and (self.peek("{") or self.peek("GRAPH") or self._names_graph()):
            self.take("GRAPH")
            g = None if self.peek("{") else self.term()
            self.need("{")
            found: list = []
            while not self.take("}"):
                self.triples(found)
                if not self.take("."):
                    self.need("}")
                    break
            out.extend((t.s, t.p, t.o, g) for t in found)
            return
        found = []
        self.triples(found)
        self.need(".")
        out.extend((t.s, t.p, t.o, None) for t in found)

    def _names_graph(self) -> bool:
        if self.kind() in ("iri", "pname", "blank"):
            return self.tokens[self.at + 1] == ("op", "{")
        return self.peek("[") and self.tokens[self.at + 1] == ("op", "]") and self.tokens[self.at + 2] == ("op", "{")

    def triples(self, out: list) -> None:
        if self.peek("[") and self.tokens[self.at + 1] != ("op", "]"):
            s = self.node(out)
            if not (self.peek(".") or self.peek("}")):
                self.property_list(s, out)
            return
        s = self.node(out)
        if isinstance(s, Literal):
            self.fail("a literal can't be a subject")
        self.property_list(s, out)


def parse(text: str, base: str = "", trig: bool = False, scope: str = "") -> list[tuple]:
    """Distinct (s, p, o, g) of a document; ``scope`` goes in front of blank node labels."""
    return Turtle(text, base, trig, scope).quads()
