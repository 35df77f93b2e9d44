"""Quoted triples: comparison by value and access to components (Arrow UDFs over N-Triples text)."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import functions as F

from tessera import terms as R


def value(t: R.Term) -> object:
    """What ``=`` compares: numbers by value, quoted triples by component."""
    if isinstance(t, R.Triple):
        return ("triple", value(t.s), value(t.p), value(t.o))
    if isinstance(t, R.Literal) and t.datatype in R.NUMERIC:
        try:
            return ("number", float(t.value))
        except ValueError:
            pass
    return t


def order(t: R.Term) -> tuple:
    """A sort key: blank < IRI < literal < triple, numbers by value."""
    match t:
        case R.Blank(v):
            return (1, v)
        case R.Iri(v):
            return (2, v)
        case R.Triple(s, p, o):
            return (4, order(s), order(p), order(o))
    if t.datatype in R.NUMERIC:
        try:
            return (3, 1, float(t.value), t.value)
        except ValueError:
            pass
    return (3, 0, t.value, t.lang or "", t.datatype)


def _text(key: tuple) -> str:
    """A key tuple as text that sorts like it."""
    out = []
    for x in key:
        if isinstance(x, tuple):
            out.append(_text(x))
        elif isinstance(x, float):
            bits = int.from_bytes(__import__("struct").pack(">d", x), "big")
            out.append(f"{bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63):016x}")
        else:
            out.append(str(x))
    return "\x00".join(out) + "\x00"


def _map2(f, a: pd.Series, b: pd.Series) -> pd.Series:
    quoted = lambda x: isinstance(x, str) and x.startswith("<<")
    return pd.Series([f(R.parse_nt(x)[0], R.parse_nt(y)[0]) if quoted(x) and quoted(y) else None for x, y in zip(a, b, strict=True)], dtype=object)


@cache
def equal_udf():
    @F.pandas_udf("boolean")
    def equal(a: pd.Series, b: pd.Series) -> pd.Series:
        return _map2(lambda x, y: value(x) == value(y), a, b)

    return equal


@cache
def less_udf(or_equal: bool):
    def less(x: R.Triple, y: R.Triple) -> bool | None:
        """Component by component: equal values are skipped, the first other pair decides if it has an order."""
        for a, b in ((x.s, y.s), (x.p, y.p), (x.o, y.o)):
            if isinstance(a, R.Triple) and isinstance(b, R.Triple):
                if value(a) == value(b):
                    continue
                return less(a, b)
            if value(a) == value(b):
                continue
            if isinstance(a, R.Literal) and isinstance(b, R.Literal) and order(a)[:2] == order(b)[:2]:
                return order(a) < order(b)
            return None
        return or_equal

    @F.pandas_udf("boolean")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return _map2(less, a, b)

    return udf


@cache
def sort_udf():
    @F.pandas_udf("string")
    def key(a: pd.Series) -> pd.Series:
        return pd.Series([_text(order(R.parse_nt(x)[0])) if isinstance(x, str) and x.startswith("<<") else x for x in a], dtype=object)

    return key


@cache
def part_udf(place: int):
    """Component 0, 1 or 2 of a quoted triple as a TERM."""

    @F.pandas_udf(R.TERM)
    def part(a: pd.Series) -> pd.DataFrame:
        rows = []
        for x in a:
            t = R.parse_nt(x)[0] if isinstance(x, str) and x.startswith("<<") else None
            rows.append(R.row((t.s, t.p, t.o)[place]) if t else (None, None, None, None))
        return pd.DataFrame(rows, columns=["k", "v", "dt", "lang"])

    return part


def part(t, place: int):
    """A component of a TERM column; NULL where it is no quoted triple."""
    got = part_udf(place)(F.when(t["k"] == R.TRIPLE, t["v"]))
    return F.when(got["k"].isNotNull(), got)
