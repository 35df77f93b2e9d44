"""Property paths: joins and unions for the fixed-length ones, a semi-naive frontier loop for closures.

A path is compiled to pairs (from, to), with the graph as a third column in GRAPH ?g. Sequence
and alternative keep duplicates; ``?``, ``*`` and ``+`` give each pair once. A closure starts
from a bound end where there is one; every round joins only the newest pairs with the step, and only
those that are new are written.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import terms as R
from tessera.functions.values import IRI, TERM, Val, lift
from tessera.operators import relation as rel
from tessera.operators.relation import Bound, Relation, new_name
from tessera.plans import algebra as A
from tessera.shared import cut
from tessera.terms import Triple, Var

FROM, TO = ".from", ".to"
#: Rounds of a closure that are kept as frames of their own before they become one.
ROUNDS = 16


class Paths:
    def __init__(self, compiler):
        self.c = compiler

    def path(self, s: object, p: A.Node, o: object, graph: object) -> Relation:
        """Solutions of a path pattern; quoted-triple ends with variables are matched after."""
        if isinstance(p, A.Alternative):
            return rel.union(self.path(s, p.left, o, graph), self.path(s, p.right, o, graph))
        if isinstance(p, A.Inverse):
            return self.path(o, p.path, s, graph)
        if isinstance(p, A.Sequence_):
            mid = Var(f".m{new_name()}")
            r = rel.join(self.path(s, p.left, mid, graph), self.path(mid, p.right, o, graph))
            return Relation(r.df, {n: b for n, b in r.vars.items() if n != mid.name})
        if isinstance(p, A.Link):
            return self.c.bgp([Triple(s, R.Iri(p.iri), o)], graph)
        if isinstance(p, A.Negated):
            r = self.negated(p, s, o, graph)
            return r if r.vars else Relation(r.df.select(F.lit(1).alias(new_name())), {})
        ends = [None if A.variables_of(x) else x for x in (s, o)]
        if isinstance(p, A.Repeat):
            pairs = self.repeat(p, graph, *ends)
        else:
            pairs = self.pairs(p, graph)
        return self.bind(pairs, s, o)

    def bind(self, r: Relation, s: object, o: object) -> Relation:
        a, b = r.vars[FROM], r.vars[TO]
        out = {n: v for n, v in r.vars.items() if n not in (FROM, TO)}
        df = r.df
        for end, bound in ((s, a), (o, b)):
            if isinstance(end, Var):
                if end.name in out:
                    both = out[end.name]
                    df = df.where(both.col == bound.col if both.like(bound) else lift(both.val) == lift(bound.val))
                else:
                    out[end.name] = bound
            elif isinstance(end, Triple) and A.variables_of(end):
                r2 = self.c.inside(Relation(df, out), end, lift(bound.val))
                df, out = r2.df, r2.vars
            else:
                df = df.where(self.equals(bound, end))
        r = Relation(df, out)
        return r if out else Relation(r.df.select(F.lit(1).alias(new_name())), {})

    def equals(self, b: Bound, t: R.Term):
        if b.prefix is not None and isinstance(t, R.Iri):
            rest = t.value[len(b.prefix) :]
            if not t.value.startswith(b.prefix):
                return F.lit(False)
            return b.col == F.lit(int(rest)) if rest.isdigit() and len(rest) < 19 else b.col.cast("string") == rest
        if b.kind == IRI:
            return b.val.col == t.value if isinstance(t, R.Iri) else F.lit(False)
        return lift(b.val) == R.const(t)

    def pairs(self, p: A.Node, graph: object) -> Relation:
        """All (from, to) pairs of a path (a bag)."""
        match p:
            case A.Link(iri):
                return self.c.bgp([Triple(Var(FROM), R.Iri(iri), Var(TO))], graph)
            case A.Inverse(q):
                return self.swap(self.pairs(q, graph))
            case A.Alternative(a, b):
                return rel.union(self.pairs(a, graph), self.pairs(b, graph))
            case A.Sequence_(a, b):
                return self.chain(self.pairs(a, graph), self.pairs(b, graph))
            case A.Repeat():
                return self.repeat(p, graph, None, None)
            case A.Negated():
                return self.negated(p, Var(FROM), Var(TO), graph)
        raise ValueError(f"not a path: {p}")

    def negated(self, p: A.Negated, s: object, o: object, graph: object) -> Relation:
        """Triples between two ends, either way, by all predicates but some; bound ends reach the scans."""
        parts = []
        if p.forward or not p.has_reverse:
            parts.append(self.without(p.forward, s, o, graph))
        if p.has_reverse:
            parts.append(self.without(p.reverse, o, s, graph))
        return parts[0] if len(parts) == 1 else rel.union(*parts)

    def without(self, iris: tuple, s: object, o: object, graph: object) -> Relation:
        r = self.c.quad(Triple(s, Var(".p"), o), graph, without=iris)
        return Relation(r.df, {n: b for n, b in r.vars.items() if n != ".p"})

    def swap(self, r: Relation) -> Relation:
        return Relation(r.df, {**r.vars, FROM: r.vars[TO], TO: r.vars[FROM]})

    def chain(self, a: Relation, b: Relation) -> Relation:
        """Composition of two pair relations."""
        left = Relation(a.df, {(".mid" if n == TO else n): v for n, v in a.vars.items()})
        right = Relation(b.df, {(".mid" if n == FROM else n): v for n, v in b.vars.items()})
        r = rel.join(left, right)
        return Relation(r.df, {n: v for n, v in r.vars.items() if n != ".mid"})

    def unique(self, r: Relation) -> Relation:
        return Relation(r.df.select(*[b.name for b in r.vars.values()]).distinct(), r.vars)

    def repeat(self, p: A.Repeat, graph: object, start: R.Term | None, end: R.Term | None) -> Relation:
        step = self.pairs(p.path, graph)
        a, b = step.vars[FROM], step.vars[TO]
        if not a.like(b):
            step = step.lifted([FROM, TO])
        if start is None and end is not None:
            return self.swap(self.closure(p, self.swap(step), graph, end))
        return self.closure(p, step, graph, start)

    def closure(self, p: A.Repeat, step: Relation, graph: object, start: R.Term | None) -> Relation:
        step = self.unique(step)
        if p.most is None:
            step = Relation(cut(step.df), step.vars)
        reached = step if start is None else step.where(self.equals(step.vars[FROM], start))
        if p.most is None:
            frontier = reached if start is None else Relation(cut(reached.df), reached.vars)
            rounds = [frontier]
            while not frontier.df.isEmpty():
                new = self.unique(self.chain(frontier.renamed(), step.renamed()))
                new = self.except_(new, rel.union(*rounds))
                frontier = Relation(cut(new.df), new.vars)
                rounds.append(frontier)
                if len(rounds) > ROUNDS:
                    whole = rel.union(*rounds)
                    rounds = [Relation(cut(whole.df), whole.vars)]
            reached = rel.union(*rounds)
        if p.least:
            return reached
        zero = self.identity(graph, start, reached)
        return self.unique(rel.union(reached, zero))

    def except_(self, a: Relation, b: Relation) -> Relation:
        names = list(a.vars)
        return rel.semi(a, Relation(b.df, b.vars), names, "left_anti")

    def identity(self, graph: object, start: R.Term | None, like: Relation) -> Relation:
        """Zero-length pairs: of the bound end, else of every node of the graph."""
        spark = self.c.spark
        if start is not None:
            b = Bound(new_name(), TERM)
            df = spark.range(1).select(R.const(start).alias(b.name))
            r = Relation(df, {FROM: b, TO: b})
            if isinstance(graph, Var):
                r = rel.join(r, self.c.graph_names(graph))
            return r
        if isinstance(graph, Var):
            quads = self.c.data.named()
            nodes = quads.select(F.col("s").alias("t"), "g").union(quads.select("o", "g")).distinct()
            t, g = Bound(new_name(), TERM), Bound(new_name(), IRI)
            return Relation(nodes.select(F.col("t").alias(t.name), F.col("g").alias(g.name)), {FROM: t, TO: t, graph.name: g})
        b = Bound(new_name(), TERM)
        return Relation(self.c.data.graph_nodes(graph).select(F.col("term").alias(b.name)), {FROM: b, TO: b})


__all__ = ["Paths", "Val"]
