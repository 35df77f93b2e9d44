"""The quoted-triple evaluation suite: queries and updates against golden results."""

from __future__ import annotations

import os

import pytest

from tessera import terms as R
from tessera.isomorphism import isomorphic
from tessera.sources import readers, results
from tessera.sources.dataset import Dataset
from tests import w3c

CASES = w3c.entries("rdf-star/sparql/eval/manifest.ttl")


def canonical(t):
    """Numbers up to their lexical form."""
    if isinstance(t, R.Triple):
        return R.Triple(canonical(t.s), canonical(t.p), canonical(t.o))
    if isinstance(t, R.Literal) and t.datatype in R.NUMERIC:
        return R.Literal(repr(float(t.value)), t.datatype)
    return t


def load(spark, path):
    if path is None or not os.path.exists(path):  # one entry's data file, an empty graph, is not in the suite
        return Dataset.of(spark, [])
    return Dataset.of(spark, readers.parse(w3c.text(path), readers.format_of(path), "file://" + path))


def quads(df):
    return [(canonical(R.from_row(r.s)), R.Iri(r.p), canonical(R.from_row(r.o)), *([R.Iri(r.g) if r.g else None] if "g" in df.columns else [])) for r in df.collect()]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c["name"])
def test_case(spark, case):
    action = case["action"]
    data = load(spark, action["data"])
    text = w3c.text(action["query"])
    golden = case["result"]["file"]
    form = os.path.splitext(golden)[1][1:]
    if action["query"].endswith("ru"):
        want = [(*(canonical(t) for t in q[:3]), q[3]) for q in readers.parse(w3c.text(golden), "trig", "file://" + golden)]
        assert isomorphic(quads(data.update(text).quads), want)
    elif form in ("ttl", "nt"):
        want = [tuple(canonical(t) for t in q[:3]) for q in readers.parse(w3c.text(golden), "turtle", "file://" + golden)]
        assert isomorphic(quads(data.construct(text)), want)
    else:
        found = results.parse(w3c.text(golden), form)
        if isinstance(found, bool):
            assert data.ask(text) == found
            return
        names, rows = found
        got = data.terms(text)
        as_rows = lambda xs: [tuple(canonical(x[n]) if n in x else None for n in names) for x in xs]
        tagged = lambda xs: [(*r, i) for r, i in _numbered(xs)]
        assert isomorphic(tagged(as_rows(got)), tagged(as_rows(rows)))


def _numbered(rows):
    """Repeated rows get numbers, so that bags compare as sets."""
    seen: dict = {}
    for r in sorted(rows, key=repr):
        shape = repr([None if isinstance(t, R.Blank) else t for t in r])
        seen[shape, r] = seen.get((shape, r), -1) + 1
        yield r, R.Literal(str(seen[shape, r]))
