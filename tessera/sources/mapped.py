"""Relational tables as virtual RDF: a declarative mapping, without materialised triples.

Each row is a subject with an IRI template over key columns (or a hash of the row where no key
is unique), a class, a predicate a column and, for foreign keys, a predicate whose object is the
target's IRI. Triple patterns that share a subject become one scan of the table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import terms as R
from tessera.functions.values import kind_of
from tessera.terms import RDF

NS = "http://example.org/"
TYPE = RDF + "type"


@dataclass(frozen=True)
class TableMap:
    """``keys``: columns of the subject template, or none for a row hash. ``refs``: column to (predicate, target table)."""

    name: str
    df: DataFrame
    keys: tuple[str, ...] = ()
    refs: dict[str, tuple[str, str]] = field(default_factory=dict)
    predicates: dict[str, str] = field(default_factory=dict)

    @property
    def prefix(self) -> str:
        return f"{NS}{self.name}/"

    @property
    def type(self) -> str:
        return NS + self.name[:1].upper() + self.name[1:]

    @property
    def graph(self) -> str:
        return f"{NS}graph/{self.name}"

    @property
    def key(self) -> Column:
        if not self.keys:
            return F.sha2(F.to_json(F.struct(*self.df.columns)), 256)
        return F.col(self.keys[0]) if len(self.keys) == 1 else F.concat_ws("/", *[F.col(k).cast("string") for k in self.keys])

    def columns(self) -> dict[str, tuple[str, str]]:
        """Predicate to (column, kind) of the columns with a literal form."""
        out = {}
        for f in self.df.schema.fields:
            if isinstance(f.dataType, T.ArrayType):
                out[self.predicates.get(f.name, NS + f.name)] = (f.name, "list")
            else:
                out[self.predicates.get(f.name, NS + f.name)] = (f.name, kind_of(f.dataType))
        return out

    def references(self) -> dict[str, tuple[str, str]]:
        """Predicate to (column, target table)."""
        return {NS + p: (c, t) for c, (p, t) in self.refs.items()}


    def where_subject(self, s: R.Term) -> DataFrame | None:
        """The rows of one subject; None where no row can be."""
        if not isinstance(s, R.Iri) or not s.value.startswith(self.prefix):
            return None
        rest = s.value[len(self.prefix) :]
        found = self.is_text(self.keys[0], rest) if len(self.keys) == 1 else self.key == rest
        return None if found is None else self.df.where(found)

    def is_text(self, column: str, text: str) -> Column | None:
        """Whether a column prints as this text, None if none of its values can; numbers and strings are compared as they are, which Parquet can filter."""
        kind = self.df.schema[column].dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            whole = re.fullmatch("0|-?[1-9][0-9]{0,18}", text) and -(1 << 63) <= int(text) < 1 << 63
            return F.col(column) == int(text) if whole else None
        return F.col(column) == text if isinstance(kind, T.StringType) else F.col(column).cast("string") == text


@dataclass(frozen=True)
class Wanted:
    """What a pattern fixes of its triples: terms (None where any will do), and predicates it leaves out."""

    s: R.Term | None = None
    p: R.Iri | None = None
    o: R.Term | None = None
    without: tuple[str, ...] = ()

    def predicate(self, p: str) -> bool:
        return p not in self.without and (self.p is None or p == self.p.value)


@dataclass(frozen=True)
class Mapping:
    tables: tuple[TableMap, ...]

    def candidates(self, predicates: set[str], types: set[str], graphs: list[str]) -> list[TableMap]:
        """The tables of these graphs that have all these predicates (and a class among ``types``)."""
        return [t for t in self.tables if t.graph in graphs and predicates <= {TYPE, *t.columns(), *t.references()} and types <= {t.type}]

    def table(self, name: str) -> TableMap:
        return next(t for t in self.tables if t.name == name)


#: The driver's tables: key columns and foreign keys.
_TABLES: dict[str, tuple[tuple[str, ...], dict[str, tuple[str, str]]]] = {
    "region": (("r_regionkey",), {}),
    "nation": (("n_nationkey",), {"n_regionkey": ("region", "region")}),
    "customer": (("c_custkey",), {"c_nationkey": ("customer_nation", "nation")}),
    "supplier": (("s_suppkey",), {"s_nationkey": ("supplier_nation", "nation")}),
    "part": (("p_partkey",), {}),
    "orders": (("o_orderkey",), {"o_custkey": ("customer", "customer")}),
    "lineitem": ((), {"l_orderkey": ("order", "orders"), "l_partkey": ("part", "part"), "l_suppkey": ("supplier", "supplier")}),
    "events": (("event_id",), {"user_id": ("user", "customer")}),
    "documents": (("doc_id",), {}),
    "embeddings": (("vec_id",), {}),
    "pages": (("page_id",), {}),
    "benchmark": (("item_id",), {}),
    "labels": (("doc_id",), {"doc_id": ("labelled", "documents")}),
    "conversations": (("conv_id", "turn"), {}),
}


@lru_cache(maxsize=8)
def tables(spark, folder: str) -> Mapping:
    """The mapping of the Parquet tables of a folder. A column name used by two tables gets the table's name in front.

    Schemas and file lists are read once for a session and folder; call ``tables.cache_clear()`` after files change.
    """
    maps = []
    names: dict[str, int] = {}
    frames = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in _TABLES}
    for df in frames.values():
        for c in df.columns:
            names[c] = names.get(c, 0) + 1
    for n, (keys, refs) in _TABLES.items():
        own = {c: f"{NS}{n}_{c}" for c in frames[n].columns if names[c] > 1}
        maps.append(TableMap(n, frames[n], keys, refs, own))
    return Mapping(tuple(maps))
