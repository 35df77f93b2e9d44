"""Joins on variables that can be unbound, against the definition of compatible solutions."""

from __future__ import annotations

import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from tessera.operators import relation as rel
from tessera.operators.relation import Bound, Relation, new_name


def relation(spark, names, rows, sure=()):
    vs = {n: Bound(new_name(), "str", None, n not in sure) for n in names}
    return Relation(spark.createDataFrame(rows, ", ".join(f"{b.name} string" for b in vs.values())), vs)


def bag(r):
    names = sorted(r.vars)
    return Counter(tuple((n, row[r.vars[n].name]) for n in names if row[r.vars[n].name] is not None) for row in r.df.collect())


def solutions(names, rows):
    return [{n: v for n, v in zip(names, r, strict=True) if v is not None} for r in rows]


def compatible(a, b):
    return all(a[n] == b[n] for n in a.keys() & b.keys())


def frozen(x):
    return tuple(sorted(x.items()))


@pytest.mark.parametrize(("left", "right", "sure"), [("abx", "aby", ""), ("abx", "aby", "b"), ("ax", "ay", ""), ("abcx", "abcy", "c"), ("x", "y", "")])
def test_against_the_definition(spark, left, right, sure):
    rng = random.Random(left + right + sure)

    def rows(names, n):
        return [tuple(None if m not in sure and m not in "xy" and rng.random() < 0.4 else f"{rng.randrange(3)}" for m in names) for _ in range(n)]

    a, b = rows(left, 25), rows(right, 12)
    x, y = relation(spark, left, a, (*sure, "x")), relation(spark, right, b, (*sure, "y"))
    us, vs = solutions(left, a), solutions(right, b)
    fits = lambda u, v: u["x"] != v["y"]
    condition = lambda scope: scope["x"].col != scope["y"].col
    assert bag(rel.join(x, y)) == Counter(frozen({**u, **v}) for u, v in product(us, vs) if compatible(u, v))
    for given, holds in ((None, lambda u, v: True), (condition, fits)):
        want = Counter()
        for u in us:
            found = [frozen({**u, **v}) for v in vs if compatible(u, v) and holds(u, v)]
            want.update(found or [frozen(u)])
        assert bag(rel.join(x, y, "left", given)) == want
    assert bag(rel.minus(x, y)) == Counter(frozen(u) for u in us if not any(compatible(u, v) and u.keys() & v.keys() for v in vs))


def test_no_nested_loop_for_variables_that_can_be_unbound(spark):
    x, y = (relation(spark, names, [(None, "1"), ("2", "3")], (names[1],)) for names in ("ax", "ay"))
    big = lambda r: Relation(r.df.withColumn(r.vars["a"].name, F.col(r.vars["a"].name)).hint("merge"), r.vars)
    plan = rel.minus(big(x), big(y)).df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
