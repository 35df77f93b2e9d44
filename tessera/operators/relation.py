"""Solution relations: a DataFrame whose columns carry SPARQL variables, and joins between them.

Column names are unique in a process, so joined relations never clash. NULL is an unbound
variable; ``maybe`` says whether a variable can be unbound, and decides whether a join is an
equi-join or has to let NULL be compatible with everything.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import IRI, TERM, Val, lift

_numbers = count()


def new_name() -> str:
    return f"c{next(_numbers)}"


@dataclass(frozen=True)
class Bound:
    """Where a variable lies: column name, kind (values.py), prefix of an IRI template, whether it can be unbound."""

    name: str
    kind: str = TERM
    prefix: str | None = None
    maybe: bool = False

    @property
    def col(self) -> Column:
        return F.col(self.name)

    @property
    def val(self) -> Val:
        if self.prefix is not None:
            return Val(IRI, F.concat(F.lit(self.prefix), self.col.cast("string")), (self.prefix, self.col))
        return Val(self.kind, self.col)

    def like(self, other: Bound) -> bool:
        return (self.kind, self.prefix) == (other.kind, other.prefix)


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    vars: dict[str, Bound]

    def scope(self) -> dict[str, Val]:
        return {n: b.val for n, b in self.vars.items()}

    def renamed(self) -> Relation:
        """The same solutions under new column names (for self-joins)."""
        new = {n: replace(b, name=new_name()) for n, b in self.vars.items()}
        return Relation(self.df.select(*[b.col.alias(new[n].name) for n, b in self.vars.items()]), new)

    def keep(self, names: list[str]) -> Relation:
        kept = {n: self.vars[n] for n in names if n in self.vars}
        return Relation(self.df.select(*[b.name for b in kept.values()]), kept)

    def lifted(self, names: list[str]) -> Relation:
        """These variables as TERM columns."""
        new, columns = dict(self.vars), {}
        for n in names:
            b = self.vars[n]
            if b.kind != TERM or b.prefix is not None:
                new[n] = Bound(new_name(), TERM, None, b.maybe)
                columns[new[n].name] = lift(b.val)
        return Relation(self.df.withColumns(columns) if columns else self.df, new)

    def where(self, condition: Column) -> Relation:
        return Relation(self.df.where(condition), self.vars)

    def with_var(self, name: str, v: Val, maybe: bool = True) -> Relation:
        b = Bound(new_name(), v.kind, v.raw[0] if v.raw else None, maybe)
        return Relation(self.df.withColumn(b.name, v.raw[1] if v.raw else v.col), {**self.vars, name: b})


def unify(left: Relation, right: Relation, names: list[str]) -> tuple[Relation, Relation]:
    """Both with these shared variables in one representation."""
    differ = [n for n in names if not left.vars[n].like(right.vars[n])]
    plain_iri = [n for n in differ if left.vars[n].kind == right.vars[n].kind == IRI]
    for n in plain_iri:
        left, right = (x if x.vars[n].prefix is None else x.with_var(n, Val(IRI, x.vars[n].val.col), x.vars[n].maybe) for x in (left, right))
    rest = [n for n in differ if n not in plain_iri]
    return left.lifted(rest), right.lifted(rest)


def _compatible(a: Bound, b: Bound) -> Column:
    same = a.col == b.col
    if a.maybe:
        same = a.col.isNull() | same
    return b.col.isNull() | same if b.maybe else same


def join(left: Relation, right: Relation, how: str = "inner", condition=None) -> Relation:
    """Compatible join (``inner`` or ``left``). ``condition`` gets the joined scope and gives the ON condition of a left join."""
    shared = [n for n in left.vars if n in right.vars]
    left, right = unify(left, right, shared)
    right = right.renamed()
    sure = [n for n in shared if not left.vars[n].maybe and not right.vars[n].maybe]
    if how == "inner" and shared and not sure:
        return _split(left, right, shared)
    if how == "left" and shared and not sure:
        matched = join(left, right)
        if condition is not None:
            matched = matched.where(condition(matched.scope()))
        return union(matched, unmatched(left, right, condition))
    merged, on = _condition(left, right, shared, condition)
    df = left.df.join(right.df, reduce(lambda a, b: a & b, on), how) if on else left.df.crossJoin(right.df) if how == "inner" else left.df.join(right.df, F.lit(True), how)
    out = {n: b if n in left.vars else replace(b, maybe=b.maybe or how == "left") for n, b in {**right.vars, **left.vars}.items()}
    for n, c in merged.items():
        out[n] = replace(left.vars[n], name=new_name(), maybe=left.vars[n].maybe and (right.vars[n].maybe or how == "left"))
        df = df.withColumn(out[n].name, c)
    order = [*left.vars, *[n for n in right.vars if n not in left.vars]]
    return Relation(df.select(*dict.fromkeys(out[n].name for n in order)), {n: out[n] for n in order})


def _condition(left: Relation, right: Relation, shared: list[str], condition) -> tuple[dict[str, Column], list[Column]]:
    """What variables unbound on the left become, and the conjuncts of a compatible join."""
    merged = {n: F.coalesce(left.vars[n].col, right.vars[n].col) for n in shared if left.vars[n].maybe}
    on = [_compatible(left.vars[n], right.vars[n]) for n in shared]
    if condition is not None:
        vals = {n: b.val for n, b in {**right.vars, **left.vars}.items()}
        for n in merged:
            vals[n] = Val(left.vars[n].kind, merged[n]) if left.vars[n].prefix is None else replace(left.vars[n].val, col=F.concat(F.lit(left.vars[n].prefix), merged[n].cast("string")), raw=(left.vars[n].prefix, merged[n]))
        on.append(condition(vals))
    return merged, on


def _part(r: Relation, n: str, bound: bool) -> Relation:
    """The solutions with (then surely) or without a value for a variable; without, the variable is left out."""
    b = r.vars[n]
    if bound:
        return Relation(r.df.where(b.col.isNotNull()), {**r.vars, n: replace(b, maybe=False)}) if b.maybe else r
    return Relation(r.df.where(b.col.isNull() if b.maybe else F.lit(False)), {k: v for k, v in r.vars.items() if k != n})


def _split(left: Relation, right: Relation, shared: list[str]) -> Relation:
    """An inner join without a surely bound key: bound rows meet by an equi-join, unbound ones by the rest."""
    n = shared[0]
    pieces = [join(_part(left, n, True), _part(right, n, True))]
    if left.vars[n].maybe:
        pieces.append(join(_part(left, n, False), right))
    if right.vars[n].maybe:
        pieces.append(join(_part(left, n, True), _part(right, n, False)))
    return union(*pieces)


def unmatched(left: Relation, right: Relation, condition=None) -> Relation:
    """Left solutions without a compatible right one (that meets the condition); split by boundness as ``_split`` is."""
    shared = [n for n in left.vars if n in right.vars]
    left, right = unify(left, right, shared)
    right = right.renamed()
    if not shared or any(not left.vars[n].maybe and not right.vars[n].maybe for n in shared):
        _, on = _condition(left, right, shared, condition)
        return Relation(left.df.join(right.df, reduce(lambda a, b: a & b, on) if on else F.lit(True), "left_anti"), left.vars)
    n = shared[0]
    bound = unmatched(_part(left, n, True), _part(right, n, True), condition)
    if right.vars[n].maybe:
        bound = unmatched(bound, _part(right, n, False), condition)
    return union(bound, unmatched(_part(left, n, False), right, condition)) if left.vars[n].maybe else bound


def union(*relations: Relation) -> Relation:
    """All solutions of all relations (a bag), as one flat union."""
    names = list(dict.fromkeys(n for r in relations for n in r.vars))
    parts = list(relations)
    out = {}
    for n in names:
        having = [r.vars[n] for r in parts if n in r.vars]
        if any(not b.like(having[0]) for b in having):
            if all(b.kind == IRI for b in having):
                parts = [r.with_var(n, Val(IRI, r.vars[n].val.col), r.vars[n].maybe) if n in r.vars and r.vars[n].prefix is not None else r for r in parts]
            else:
                parts = [r.lifted([n]) if n in r.vars else r for r in parts]
        having = [r.vars[n] for r in parts if n in r.vars]
        out[n] = replace(having[0], name=new_name(), maybe=len(having) < len(parts) or any(b.maybe for b in having))
    types = {}
    for n in names:
        r = next(r for r in parts if n in r.vars)
        types[n] = r.df.schema[r.vars[n].name].dataType
    frames = [r.df.select(*[(r.vars[n].col if n in r.vars else F.lit(None).cast(types[n])).alias(out[n].name) for n in names] or [F.lit(1).alias("unit")]) for r in parts]
    return Relation(reduce(DataFrame.union, frames), out)


def minus(left: Relation, right: Relation) -> Relation:
    """Left solutions without a compatible right one that shares a bound variable; split by boundness as ``_split`` is."""
    shared = [n for n in left.vars if n in right.vars]
    if not shared:
        return left
    left, right = unify(left, right, shared)
    right = right.keep(shared).renamed()
    if any(not left.vars[n].maybe and not right.vars[n].maybe for n in shared):
        on = reduce(lambda a, b: a & b, [_compatible(left.vars[n], right.vars[n]) for n in shared])
        return Relation(left.df.join(right.df, on, "left_anti"), left.vars)
    n = shared[0]
    bound = minus(_part(left, n, True), _part(right, n, True))
    if right.vars[n].maybe:
        bound = minus(bound, _part(right, n, False))
    return union(bound, minus(_part(left, n, False), right)) if left.vars[n].maybe else bound


def semi(left: Relation, right: Relation, names: list[str], how: str = "left_semi") -> Relation:
    """Left solutions with (``left_semi``) or without (``left_anti``) a right one that is identical on ``names``; unbound equals unbound."""
    left, right = unify(left, right, names)
    right = right.keep(names).renamed()
    equal = [left.vars[n].col.eqNullSafe(right.vars[n].col) if left.vars[n].maybe or right.vars[n].maybe else left.vars[n].col == right.vars[n].col for n in names]
    on = reduce(lambda a, b: a & b, equal) if equal else F.lit(True)
    return Relation(left.df.join(right.df, on, how), left.vars)
