"""Aggregates to Spark aggregate columns.

Unbound and erroneous inputs are skipped; SUM and AVG are an error if a bound input is no
number, 0 over nothing. GROUP_CONCAT orders its parts, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import terms as R
from tessera.functions import cdt
from tessera.functions.expressions import Expressions, UnsupportedError
from tessera.functions.values import DBL, DEC, FLT, INT, NUMBERS, SPARK, STR, TERM, Val, constant_term, exact, lexical, lift, number, rank, sort_keys, text_of_number
from tessera.plans import algebra as A
from tessera.terms import CDT, XSD


@dataclass(frozen=True)
class Made:
    """An aggregate column of a kind, and what is done with it after grouping (column to value)."""

    column: Column
    kind: str
    finish: Callable[[Column], Val] | None = None


def aggregate(a: A.Agg, ex: Expressions, relation) -> Made:
    if a.iri:
        return _custom(a, ex)
    if a.op == "COUNT" and not a.args:
        whole = F.struct(*[b.col for n, b in relation.vars.items() if n[0] != "."]) if relation.vars else F.lit(1)
        return Made((F.count_distinct(whole) if a.distinct else F.count(F.lit(1))).cast("bigint"), INT)
    v = ex.value(a.args[0])
    if a.op == "COUNT":
        return Made(F.count_distinct(v.col) if a.distinct else F.count(v.col), INT)
    if a.op == "SUM":
        return _sum(v, a.distinct)
    if a.op == "AVG":
        return _avg(v, a.distinct)
    if a.op in ("MIN", "MAX", "SAMPLE"):
        least = a.op != "MAX"
        if v.kind != TERM:
            return Made((F.min if least else F.max)(v.col), v.kind)
        key = F.struct(*sort_keys(v, ex.star))
        return Made((F.min_by if least else F.max_by)(F.when(v.col.isNotNull(), v.col), F.when(v.col.isNotNull(), key)), TERM)
    if a.op == "GROUP_CONCAT":
        text = lexical(v)
        parts = F.sort_array((F.collect_set if a.distinct else F.collect_list)(text))
        return Made(F.array_join(parts, a.separator), STR)
    if a.op == "FOLD":
        return _fold(a, ex)
    raise UnsupportedError(f"no aggregate {a.op}")


def _sum(v: Val, distinct: bool) -> Made:
    total = F.sum_distinct if distinct else F.sum
    if v.kind in NUMBERS:
        return Made(F.coalesce(total(v.col).cast(SPARK[v.kind]), F.lit(0).cast(SPARK[v.kind])), v.kind)
    if v.kind != TERM:
        return Made(F.when(F.count(v.col) == 0, F.lit(0).cast("bigint")), INT)
    return Made(_parts(v, total), TERM, lambda s: Val(TERM, _number_of(s, s["whole"], s["real"], s["top"])))


def _parts(v: Val, total: Callable[[Column], Column]) -> Column:
    """Sums of the exact and the real values, the highest type, the count and the number of inputs that are no numbers."""
    return F.struct(
        total(exact(v)).cast(SPARK[DEC]).alias("whole"), total(number(v)).alias("real"), F.max(rank(v)).alias("top"),
        (F.count_distinct(v.col) if total is F.sum_distinct else F.count(number(v))).alias("n"), F.count_if(v.col.isNotNull() & number(v).isNull()).alias("bad"),
    )


def _number_of(s: Column, whole: Column, real: Column, top: Column) -> Column:
    text = F.when(top == 1, whole.cast("decimal(38,0)").cast("string")).when(top == 2, text_of_number(whole, DEC)).when(top > 2, text_of_number(real, DBL))
    dt = F.when(top == 1, XSD + "integer").when(top == 2, XSD + "decimal").when(top == 3, XSD + "float").otherwise(XSD + "double")
    return F.when(s["bad"] == 0, F.coalesce(R.struct(R.LITERAL, text, dt), R.const(R.Literal("0", XSD + "integer"))))


def _avg(v: Val, distinct: bool) -> Made:
    total = F.sum_distinct if distinct else F.sum
    if v.kind in (INT, DEC):
        n = (F.count_distinct if distinct else F.count)(v.col)
        mean = F.try_divide(total(v.col).cast(SPARK[DEC]), n.cast("decimal(20,0)")).cast(SPARK[DEC])
        return Made(F.coalesce(mean, F.lit(0).cast(SPARK[DEC])), DEC)
    if v.kind in (FLT, DBL):
        mean = F.try_divide(total(v.col), (F.count_distinct if distinct else F.count)(v.col))
        return Made(F.coalesce(mean, F.lit(0.0)), DBL)
    if v.kind != TERM:
        return Made(F.when(F.count(v.col) == 0, F.lit(0).cast("bigint")), INT)

    def finish(s: Column) -> Val:
        whole = F.try_divide(s["whole"], s["n"].cast("decimal(20,0)")).cast(SPARK[DEC])
        return Val(TERM, _number_of(s, whole, F.try_divide(s["real"], s["n"]), F.greatest(s["top"], F.lit(2))))

    def guarded(s: Column) -> Val:
        return Val(TERM, F.when((s["n"] == 0) & (s["bad"] == 0), R.const(R.Literal("0", XSD + "integer"))).otherwise(finish(s).col))

    return Made(_parts(v, total), TERM, guarded)


def _fold(a: A.Agg, ex: Expressions) -> Made:
    """A list (one argument, nulls kept) or a map (two; a later entry replaces an earlier one)."""
    vals = [constant_term(ex.value(e)) for e in a.args]
    keys = []
    for i, (e, up) in enumerate(a.order):
        for j, k in enumerate(sort_keys(ex.value(e), ex.star)):
            keys.append((f"k{i}_{j}", k, up))
    item = F.struct(*[k.alias(n) for n, k, _ in keys], *[v.alias(n) for v, n in zip(vals, "ab", strict=False)])
    rows = (F.collect_set if a.distinct else F.collect_list)(item)

    def compare(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for n, _, up in reversed(keys):
            first, second = (x[n], y[n]) if up else (y[n], x[n])
            lower = (first < second) | (first.isNull() & second.isNotNull())
            higher = (first > second) | (first.isNotNull() & second.isNull())
            out = F.when(lower, -1).when(higher, 1).otherwise(out)
        return out

    if keys:
        rows = F.array_sort(rows, compare)
    pairs = F.to_json(F.transform(rows, lambda x: F.struct(*[x[n].alias(n) for n in "ab"[: len(vals)]])))
    kind = "list" if len(vals) == 1 else "map"
    return Made(pairs, STR, lambda s: Val(TERM, R.struct(R.LITERAL, cdt.collect_udf(kind)(s), F.lit(cdt.LIST if kind == "list" else cdt.MAP))))


def _custom(a: A.Agg, ex: Expressions) -> Made:
    if a.op in ex.registry.aggregates:
        return Made(ex.registry.aggregates[a.op](constant_term(ex.value(a.args[0]))), TERM)
    if a.op in (CDT + "listAgg", CDT + "mapAgg"):
        return _fold(A.Agg("FOLD", a.args, a.distinct), ex)
    raise UnsupportedError(f"unknown aggregate <{a.op}>")


__all__ = ["aggregate", "lift"]
