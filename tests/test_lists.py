"""List functions: native expressions on lists of numbers agree with the functions on parsed values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera import terms as R
from tessera.functions import cdt

LISTS = ["[]", "[1]", "[3, 1, 2]", "[0.5, -2, 1.0E-4]", '["a", 1]', "[ 1,2 ]", "[01, 1]", "[null]", "[1, [2]]", "not a list", None]
INTS = ["0", "1", "2", "3", "-1", "01", "4", None]


def literal(v, dt):
    return None if v is None else R.row(R.Literal(v, dt))


def plain(name, args):
    f, nulls = cdt.FUNCTIONS[name]
    terms = [None if a is None else R.Literal(a[0], a[1]) for a in args]
    try:
        got = None if not nulls and None in terms else f(*terms)
    except (cdt.CdtError, TypeError, ValueError):
        return None
    return None if got is None else tuple(R.row(cdt.literal(got)))


@pytest.mark.parametrize(("name", "kinds"), [("size", "l"), ("head", "l"), ("tail", "l"), ("reverse", "l"), ("get", "li"), ("listGet", "li"), ("concat", "ll"), ("subseq", "li"), ("subseq", "lii"), ("contains", "li"), ("containsTerm", "li"), ("sequence", "i"), ("sequence", "ii")])
def test_native_and_parsed_agree(spark, name, kinds):
    integer = R.XSD + "integer"
    rows = [[]]
    for k in kinds:
        rows = [[*r, None if v is None else (v, cdt.LIST if k == "l" else integer)] for r in rows for v in (LISTS if k == "l" else INTS)]
    names = [f"a{i}" for i in range(len(kinds))]
    data = [(i, *[literal(*a) if a else None for a in r]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, " + ", ".join(f"{n} {R.TERM}" for n in names))
    got = {r.i: r.x for r in df.select("i", cdt.call(name, [F.col(n) for n in names]).alias("x")).collect()}
    for i, args in enumerate(rows):
        want = plain(name, args)
        assert (None if got[i] is None else tuple(got[i])) == want, (args, got[i], want)
