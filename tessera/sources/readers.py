"""RDF files to quads.

N-Triples and N-Quads are split by line and parsed with native string functions; the
other formats are parsed a file a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import terms as R
from tessera.functions import cdt
from tessera.sources import rdfxml, turtle
from tessera.sources.dataset import QUADS

#: Format by file name ending and by media type.
ENDINGS = {"nt": "ntriples", "nq": "nquads", "ttl": "turtle", "turtle": "turtle", "trig": "trig", "rdf": "rdfxml", "xml": "rdfxml", "owl": "rdfxml"}
MEDIA = {"application/n-triples": "ntriples", "application/n-quads": "nquads", "text/turtle": "turtle", "application/trig": "trig", "application/rdf+xml": "rdfxml"}

_IRI = r'<[^<>"{}|^`\x00-\x20]*>'
_BLANK = r"_:[^\s<>\"]+"
_LITERAL = r'"(?:[^"\\\n\r]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?'
_QUOTED = r"<<.*>>"
LINE = rf"^\s*({_QUOTED}|{_IRI}|{_BLANK})\s*({_IRI})\s*({_QUOTED}|{_IRI}|{_LITERAL}|{_BLANK})\s*({_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$"


def format_of(path: str) -> str:
    ending = path.rsplit(".", 1)[-1].lower()
    if ending not in ENDINGS:
        raise ValueError(f"no RDF format for {path!r}")
    return ENDINGS[ending]


def unescaped(v: Column) -> Column:
    """N-Triples string escapes, natively; texts with \\u escapes go through a UDF."""
    plain = v
    marks = F.lit("\x00")
    plain = F.replace(plain, F.lit("\\\\"), marks)
    for code, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\b", "\b"), ("\\f", "\f"), ("\\'", "'")):
        plain = F.replace(plain, F.lit(code), F.lit(char))
    plain = F.replace(plain, marks, F.lit("\\"))
    return F.when(~F.contains(v, F.lit("\\")), v).otherwise(plain)


def _decoded(v: Column) -> Column:
    """\\u escapes by an Arrow UDF over the few texts that have one."""
    return F.pandas_udf(_unescape_all, "string")(v)


def _unescape_all(s: pd.Series) -> pd.Series:
    return s.map(lambda x: R.unescape(x) if isinstance(x, str) else x)


def term_column(text: Column, scope: Column, uescapes: bool) -> Column:
    """A TERM from its N-Triples text."""
    fix = _decoded if uescapes else unescaped
    body = fix(F.regexp_extract(text, r'(?s)^"((?:[^"\\]|\\.)*)"', 1))
    dt = F.regexp_extract(text, r'(?s)^"(?:[^"\\]|\\.)*"\^\^<([^>]*)>$', 1)
    lang = F.regexp_extract(text, r'(?s)^"(?:[^"\\]|\\.)*"@([A-Za-z0-9-]+)$', 1)
    head = F.lower(F.substring_index(lang, "-", 1))
    region = F.regexp_extract(lang, r"-([A-Za-z]{2})$", 1)
    tag = F.when(~F.contains(lang, F.lit("-")), F.lower(lang)).when((region != "") & (F.length(lang) == F.length(head) + 3), F.concat(head, F.lit("-"), F.upper(region))).otherwise(F.lower(lang))
    literal = F.startswith(text, F.lit('"'))
    kind = F.when(literal, R.LITERAL).when(F.startswith(text, F.lit("<<")), R.TRIPLE).when(F.startswith(text, F.lit("<")), R.IRI_).otherwise(R.BLANK)
    iri = F.substring(text, F.lit(2), F.length(text) - 2)
    value = F.when(kind == R.LITERAL, body).when(kind == R.TRIPLE, _canonical(text)).when(kind == R.IRI_, fix(iri)).otherwise(F.concat(scope, F.substring(text, F.lit(3), F.length(text))))
    datatype = F.when(kind == R.LITERAL, F.when(lang != "", R.LANG_STRING).when(dt != "", dt).otherwise(R.STRING))
    return R.struct(kind, value, datatype, F.when((kind == R.LITERAL) & (lang != ""), tag))


def _canonical(text: Column) -> Column:
    """A quoted triple with single blanks between its parts."""
    spaced = F.regexp_replace(text, r"<<\s*", "<< ")
    return F.regexp_replace(F.regexp_replace(spaced, r"\s*>>", " >>"), r"(>|\")\s+(?=[<_\"])", "$1 ")


def lines(rows: DataFrame, scope: Column, uescapes: bool = True) -> DataFrame:
    """Quads of N-Triples or N-Quads lines (column value). Blank lines and comments are dropped; a bad line is an error."""
    rows = rows.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.regexp_extract("value", LINE, i)
    fine = F.when(F.col("value").rlike(LINE), part(1)).otherwise(F.raise_error(F.concat(F.lit("not N-Quads: "), F.substring("value", 1, 100))))
    rows = rows.select(fine.alias("s"), part(2).alias("p"), part(3).alias("o"), part(4).alias("g"), scope.alias("scope"))
    iri = lambda c: _decoded(F.substring(c, F.lit(2), F.length(c) - 2)) if uescapes else F.substring(c, F.lit(2), F.length(c) - 2)
    return rows.select(
        term_column(F.col("s"), F.col("scope"), uescapes).alias("s"),
        iri(F.col("p")).alias("p"),
        cdt.relabelled(term_column(F.col("o"), F.col("scope"), uescapes), F.col("scope")).alias("o"),
        F.when(F.col("g") != "", F.substring("g", F.lit(2), F.length("g") - 2)).alias("g"),
    )


def read(spark: SparkSession, path: str, form: str | None = None, base: str | None = None) -> DataFrame:
    """The quads of a file or folder, each once; blank node labels are kept apart by file.

    ``form`` is a format name or media type, by default that of the file's ending.
    """
    form = MEDIA.get(form or "", form) or format_of(path)
    scope = F.concat(F.lit("f"), F.substring(F.md5(F.input_file_name()), 1, 8))
    if form in ("ntriples", "nquads"):
        # lines with \u escapes are few: only they go through Python
        rows = spark.read.text(path).withColumn("scope", scope)
        coded = F.contains(F.col("value"), F.lit("\\u")) | F.contains(F.col("value"), F.lit("\\U"))
        quads = lines(rows.where(~coded), F.col("scope"), False).unionByName(lines(rows.where(coded), F.col("scope"), True))
        return quads.distinct()
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield batch(parse(content.decode("utf-8-sig"), form, name if base is None else base, "f" + hashlib.md5(name.encode()).hexdigest()[:8]))

    return files.mapInArrow(run, QUADS)


def parse(text: str, form: str, base: str = "", scope: str = "") -> list[tuple]:
    """(s, p, o, g) driver-side terms of a document in memory."""
    form = MEDIA.get(form, form)
    if form == "rdfxml":
        return _lists(rdfxml.parse(text, base, scope), scope)
    if form in ("ntriples", "nquads"):
        out = []
        for line in text.splitlines():
            if line.strip() and not line.lstrip().startswith("#"):
                out.append(_line(line, form))
        return list(dict.fromkeys(out))
    return _lists(turtle.parse(text, base, form == "trig", scope), scope)


def _lists(quads: list[tuple], scope: str) -> list[tuple]:
    """Quads whose list and map literals name the same blank nodes as the document does."""
    if not scope:
        return quads
    own = lambda t: R.Literal(cdt.relabel(t.value, scope), t.datatype) if isinstance(t, R.Literal) and t.datatype in (cdt.LIST, cdt.MAP) and "_:" in t.value else t
    return [tuple(map(own, q)) for q in quads]


def _line(line: str, form: str) -> tuple:
    found, at = [], 0
    while True:
        rest = line[at:].lstrip()
        if rest.startswith("."):
            if rest[1:].split("#")[0].strip():
                raise ValueError(f"text after the dot: {line!r}")
            break
        t, at = R.parse_nt(line, at)
        found.append(t)
    if not (len(found) == 3 or len(found) == 4 and form == "nquads") or isinstance(found[0], R.Literal) or not isinstance(found[1], R.Iri):
        raise ValueError(f"not a statement: {line!r}")
    return (*found[:3], found[3] if len(found) == 4 else None)


def batch(quads: list[tuple]) -> pa.RecordBatch:
    term = pa.struct([("k", pa.int32()), ("v", pa.string()), ("dt", pa.string()), ("lang", pa.string())])
    field = lambda t: dict(zip(("k", "v", "dt", "lang"), R.row(t), strict=True))
    columns = [pa.array([field(q[0]) for q in quads], term), pa.array([q[1].value for q in quads], pa.string()), pa.array([field(q[2]) for q in quads], term), pa.array([q[3].value if q[3] is not None else None for q in quads], pa.string())]
    return pa.record_batch(columns, names=["s", "p", "o", "g"])
