"""Reads W3C-style manifests of test entries from the folder TESSERA_SUITES names; without it those tests have no cases."""

from __future__ import annotations

import os

from tessera import terms as R
from tessera.sources import readers

ROOT = os.environ.get("TESSERA_SUITES", "")
MF = "http://www.w3.org/2001/sw/DataAccess/tests/test-manifest#"
QT = "http://www.w3.org/2001/sw/DataAccess/tests/test-query#"
UT = "http://www.w3.org/2009/sparql/tests/test-update#"


def text(path: str) -> str:
    with open(path, encoding="utf-8", newline="") as f:
        return f.read()


def entries(manifest: str) -> list[dict]:
    """Test entries: kind, name, action and result as file paths; None paths where absent."""
    path = f"{ROOT}/{manifest}"
    if not os.path.exists(path):
        return []
    index: dict = {}
    for s, p, o, _ in readers.parse(text(path), "turtle", "file://" + path):
        index.setdefault(s, {}).setdefault(p.value, []).append(o)

    def files(node: object) -> dict:
        if isinstance(node, R.Iri):
            return {"file": node.value[7:]}
        d = index.get(node, {})
        one = lambda k: d[k][0].value[7:] if k in d and isinstance(d[k][0], R.Iri) else None
        return {"query": one(QT + "query") or one(UT + "request"), "data": one(QT + "data") or one(UT + "data")}

    def result(found: dict) -> dict:
        return found if "file" in found else {"file": found["data"]}

    out = []
    for d in index.values():
        if MF + "action" in d:
            kind = d[R.RDF + "type"][0].value.split("#")[-1]
            out.append({"kind": kind, "name": d[MF + "name"][0].value, "action": files(d[MF + "action"][0]), "result": result(files(d[MF + "result"][0])) if MF + "result" in d else {}})
    return out
