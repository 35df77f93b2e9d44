"""Algebra to DataFrames.

Patterns become relations whose columns stay native where the source is a mapped table, so
Catalyst sees plain filters, joins and aggregates. Triple patterns that share a subject are one
scan of the table that has all their predicates; on quads each pattern is a filtered scan.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import terms as R
from tessera.functions import cdt
from tessera.functions.aggregates import aggregate
from tessera.functions.expressions import Expressions, UnsupportedError
from tessera.functions.values import BOOL, IRI, STR, TERM, Val, from_term, kind_of, lift, sort_keys, truth
from tessera.operators import relation as rel
from tessera.operators.paths import Paths
from tessera.operators.relation import Bound, Relation, new_name
from tessera.plans import algebra as A
from tessera.shared import cut
from tessera.sources.mapped import TYPE, TableMap, Wanted
from tessera.terms import Triple, Var


#: Solutions up to which HINT broadcast is obeyed.
BROADCAST_ROWS = 1_000_000


def list_literal(array: Column) -> Column:
    """A native array of numbers or strings as a list literal."""
    item = F.transform(array.cast("array<string>"), lambda x: F.coalesce(x, F.lit("null")))
    return R.struct(R.LITERAL, F.concat(F.lit("["), F.array_join(item, ", "), F.lit("]")), F.lit(cdt.LIST))


class Compiler:
    """Compiles patterns of one query over a dataset.

    ``graph`` is None in the default graph, an IRI in GRAPH <iri>, and a Var in GRAPH ?g, where every scan
    carries the graph as that variable. A ``seed`` relation is joined below the innermost filters, which
    is how correlated EXISTS patterns see outer variables.
    """

    def __init__(self, dataset):
        self.data = dataset
        self.spark = dataset.spark
        self.paths = Paths(self)

    def expressions(self, scope: dict[str, Val], exists: dict | None = None, row_id: Column | None = None) -> Expressions:
        return Expressions(scope, self.data.registry, self.data.base, self.data.star and self.data.quads is not None, exists, row_id)

    def unit(self) -> Relation:
        """One solution without bindings."""
        return Relation(self.spark.range(1).select(F.lit(1).alias(new_name())), {})

    def empty(self, names: list[str]) -> Relation:
        vs = {n: Bound(new_name(), TERM, None, True) for n in names}
        return Relation(self.unit().df.select(*[F.lit(None).cast(R.TERM).alias(b.name) for b in vs.values()] or [F.lit(1).alias(new_name())]).where("false"), vs)

    def compile(self, n: A.Node, graph: object = None, seed: Relation | None = None) -> Relation:
        match n:
            case A.Bgp(triples):
                return self.seeded(self.bgp(list(triples), graph), seed)
            case A.Path(s, p, o):
                return self.seeded(self.paths.path(s, p, o, graph), seed)
            case A.Join(a, b):
                return rel.join(self.compile(a, graph, seed), self.compile(b, graph))
            case A.LeftJoin(a, b, condition):
                return self.left_join(self.compile(a, graph, seed), b, condition, graph)
            case A.Union():
                return rel.union(*[self.compile(x, graph, seed) for x in _branches(n)])
            case A.Minus(a, b):
                return rel.minus(self.compile(a, graph, seed), self.compile(b, graph))
            case A.Filter(c, e):
                return self.filter(self.compile(c, graph, seed), e, graph)
            case A.Graph(g, c):
                return self.graph(g, c, seed)
            case A.Extend(c, v, e):
                return self.extend(self.compile(c, graph, seed), v, e, graph)
            case A.Unfold(c, e, vs):
                return self.unfold(self.compile(c, graph, seed), e, vs, graph)
            case A.Table(vs, rows):
                return self.seeded(self.table(vs, rows), seed)
            case A.Service(endpoint, c, silent):
                return self.seeded(self.service(endpoint.value, c, silent), seed)
            case A.Group():
                return self.seeded(self.group(n, graph), seed)
            case A.Project(c, vs):
                keep = [*vs, *([graph.name] if isinstance(graph, Var) else [])]
                return self.seeded(self.project(self.compile(c, graph), keep), seed)
            case A.Distinct(c) | A.Reduced(c):
                return self.seeded(self.distinct(c, graph), seed)
            case A.OrderBy(c, keys):
                return self.seeded(self.order_by(self.compile(c, graph), keys, graph), seed)
            case A.Slice(c, offset, limit):
                return self.seeded(self.slice(self.compile(c, graph), offset, limit), seed)
            case A.Hint(c, name):
                r = self.compile(c, graph, seed)
                known = name.lower() in ("merge", "shuffle_hash") or (name.lower() == "broadcast" and r.df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS)
                return Relation(r.df.hint(name), r.vars) if known else r
            case A.Query():
                return self.compile(n.child, graph, seed)
        raise UnsupportedError(f"no compilation of {type(n).__name__}")

    def seeded(self, r: Relation, seed: Relation | None) -> Relation:
        return r if seed is None else rel.join(seed, r)

    # triple patterns

    def bgp(self, triples: list[Triple], graph: object) -> Relation:
        if not triples:
            return self.graph_names(graph) if isinstance(graph, Var) else self.unit()
        parts = self.stars(triples, graph)
        done = parts.pop(0)
        while parts:  # connected parts first: a Cartesian product is the last resort
            i = next((i for i, p in enumerate(parts) if set(p.vars) & set(done.vars)), 0)
            done = rel.join(done, parts.pop(i))
        return done

    def stars(self, triples: list[Triple], graph: object) -> list[Relation]:
        """Relations of the pattern, the most restricted first."""
        if self.data.mapping is None:
            return [self.quad(t, graph) for t in sorted(triples, key=_freedom)]
        groups: dict[object, list[Triple]] = {}
        for t in triples:
            groups.setdefault(t.s, []).append(t)
        parts = []
        for s, group in groups.items():
            fixed = [t for t in group if isinstance(t.p, R.Iri) and not isinstance(s, (R.Triple, R.Literal))]
            free = [t for t in group if t not in fixed]
            found = self.star(s, fixed, graph) if fixed else None
            if fixed and found is None:
                singles = [self.star(s, [t], graph) or self.quad(t, graph) for t in fixed]
                parts += [(sum(map(_freedom, fixed)), r) for r in singles]
            elif fixed:
                parts.append((min(map(_freedom, fixed)), found))
            parts += [(_freedom(t) + 10, self.quad(t, graph)) for t in free]
        return [r for _, r in sorted(parts, key=lambda x: x[0])]

    def star(self, s: object, triples: list[Triple], graph: object) -> Relation | None:
        """One scan for patterns of one subject; None if no mapped table has all their predicates."""
        types = {t.o.value for t in triples if t.p.value == TYPE and isinstance(t.o, R.Iri)}
        graphs = self.data.mapped_names() if isinstance(graph, Var) else self.data.mapped(graph)
        tables = self.data.mapping.candidates({t.p.value for t in triples}, types, graphs)
        if isinstance(s, R.Iri):
            tables = [t for t in tables if s.value.startswith(t.prefix)]
        if not tables:
            return None
        found = [self.scan(t, s, triples, graph) for t in tables]
        if self.data.quads is not None:
            found.append(reduce(rel.join, [self.quad(t, graph, mapped=False) for t in triples]))
        return rel.union(*found)

    def scan(self, t: TableMap, s: object, triples: list[Triple], graph: object) -> Relation:
        columns, refs = t.columns(), t.references()
        df, vs, out = t.df, {}, {}
        conditions: list[Column] = []

        def bind(name: str, v: Val) -> None:
            if name in vs:
                a, b = vs[name], v
                conditions.append(a.raw[1] == b.raw[1] if a.raw and b.raw and a.raw[0] == b.raw[0] else lift(a) == lift(b) if a.kind != b.kind else a.col == b.col)
            else:
                vs[name] = v

        if isinstance(s, R.Iri):
            conditions.append(t.key.cast("string") == s.value[len(t.prefix) :])
        else:
            bind(s.name, Val(IRI, F.concat(F.lit(t.prefix), t.key.cast("string")), (t.prefix, t.key)))
        for x in triples:
            if x.p.value == TYPE:
                v = Val(IRI, F.lit(t.type), constant=R.Iri(t.type))
            elif x.p.value in refs:
                column, target = refs[x.p.value]
                prefix = self.data.mapping.table(target).prefix
                v = Val(IRI, F.concat(F.lit(prefix), F.col(column).cast("string")), (prefix, F.col(column)))
                conditions.append(F.col(column).isNotNull())
            else:
                column, kind = columns[x.p.value]
                v = Val(TERM, list_literal(F.col(column))) if kind == "list" else Val(kind, F.col(column))
                conditions.append(F.col(column).isNotNull())
            if isinstance(x.o, Var):
                bind(x.o.name, v)
            else:
                conditions.append(_is(v, x.o))
        if isinstance(graph, Var):
            bind(graph.name, Val(IRI, F.lit(t.graph)))
        if conditions:
            df = df.where(reduce(lambda a, b: a & b, conditions))
        for name, v in vs.items():
            out[name] = Bound(new_name(), v.kind, v.raw[0] if v.raw else None)
        return Relation(df.select(*[(v.raw[1] if v.raw else v.col).alias(out[n].name) for n, v in vs.items()] or [F.lit(1).alias(new_name())]), out)

    def quad(self, t: Triple, graph: object, mapped: bool = True, without: tuple[str, ...] = ()) -> Relation:
        """A filtered scan of the quads for one pattern, of predicates that are not ``without``."""
        data = self.data if mapped else replace(self.data, mapping=None)
        wanted = Wanted(*[None if A.variables_of(x) else x for x in (t.s, t.p, t.o)], without)
        if isinstance(graph, Var):
            quads = data.named(wanted)
        else:
            quads = data.active(graph, wanted)
        columns: dict[str, Val] = {}
        conditions: list[Column] = [~F.col("p").isin(*without)] if without else []
        pending: list[tuple[object, Val]] = [(t.p, Val(IRI, F.col("p"))), (t.s, Val(TERM, F.col("s"))), (t.o, Val(TERM, F.col("o")))]
        if isinstance(graph, Var):
            pending.append((graph, Val(IRI, F.col("g"))))
        nested: list[tuple[Triple, Val]] = []
        for x, v in pending:
            if isinstance(x, Var):
                if x.name in columns:
                    a = columns[x.name]
                    conditions.append(a.col == v.col if a.kind == v.kind else lift(a) == lift(v))
                else:
                    columns[x.name] = v
            elif isinstance(x, Triple) and A.variables_of(x):
                conditions.append(v.col["k"] == R.TRIPLE)
                nested.append((x, v))
            elif v.kind == IRI:
                conditions.append(v.col == x.value if isinstance(x, R.Iri) else F.lit(False))
            else:
                conditions.append(v.col == R.const(x))
        df = quads.where(reduce(lambda a, b: a & b, conditions)) if conditions else quads
        vs = {n: Bound(new_name(), v.kind) for n, v in columns.items()}
        extra = [(x, new_name(), v) for x, v in nested]
        df = df.select(*[v.col.alias(vs[n].name) for n, v in columns.items()], *[v.col.alias(name) for _, name, v in extra] or ([F.lit(1).alias(new_name())] if not columns else []))
        r = Relation(df, vs)
        for x, name, _ in extra:
            r = self.inside(r, x, F.col(name))
        return r

    def inside(self, r: Relation, x: Triple, quoted: Column) -> Relation:
        """Match a quoted-triple pattern against a TERM column: bind its variables, check its terms."""
        from tessera.functions import star

        for i, part in enumerate((x.s, x.p, x.o)):
            name = new_name()
            df = r.df.withColumn(name, star.part(quoted, i))
            got = F.col(name)
            if isinstance(part, Var):
                if part.name in r.vars:
                    r = Relation(df.where(lift(r.vars[part.name].val) == got), r.vars)
                else:
                    r = Relation(df.where(got.isNotNull()), {**r.vars, part.name: Bound(name)})
            elif isinstance(part, Triple) and A.variables_of(part):
                r = self.inside(Relation(df.where(got["k"] == R.TRIPLE), r.vars), part, got)
            else:
                r = Relation(df.where(got == R.const(part)), r.vars)
        return r

    # operators

    def graph(self, g: object, child: A.Node, seed: Relation | None) -> Relation:
        if isinstance(g, R.Iri):
            return self.compile(child, g.value, seed)
        r = self.compile(child, g, seed)
        return r if g.name in r.vars else rel.join(r, self.graph_names(g))

    def graph_names(self, g: Var) -> Relation:
        b = Bound(new_name(), IRI)
        df = replace(self.data, mapping=None).named().select(F.col("g").alias(b.name)).distinct()
        if self.data.mapping:
            df = df.union(self.spark.createDataFrame([(x,) for x in self.data.mapped_names()], "g string")).distinct()
        return Relation(df, {g.name: b})

    def filter(self, r: Relation, e: A.Node, graph: object) -> Relation:
        """Conjuncts one by one; a conjunct that is an EXISTS is a semi or anti join."""
        for part in _conjuncts(e):
            negated = isinstance(part, A.Call) and part.op == "!" and isinstance(part.args[0], A.Exists)
            x = part.args[0] if negated else part
            if isinstance(x, A.Exists):
                r = self.exists(r, x.pattern, x.negated != negated, graph)
            else:
                flags, r = self.flags(r, part, graph)
                r = r.where(truth(self.expressions(r.scope(), flags).value(part)))
        return r

    def exists(self, r: Relation, pattern: A.Node, negated: bool, graph: object) -> Relation:
        inner, names = self.correlated(r, pattern, graph)
        return rel.semi(r, inner, names, "left_anti" if negated else "left_semi")

    def correlated(self, r: Relation, pattern: A.Node, graph: object) -> tuple[Relation, list[str]]:
        """The pattern's solutions and the variables that tie them to ``r``."""
        used = set(A.scope(pattern)) | {v for x in pattern.walk() if isinstance(x, (A.Filter, A.Extend)) for v in A.expr_variables(x.expr)}
        used |= {graph.name} if isinstance(graph, Var) else set()
        names = [n for n in r.vars if n in used]
        simple = isinstance(pattern, (A.Bgp, A.Path)) and all(not r.vars[n].maybe for n in names)
        if simple:
            return self.compile(pattern, graph), names
        seed = r.keep(names).renamed()
        seed = Relation(seed.df.distinct(), seed.vars) if names else self.unit()
        inner = self.compile(pattern, graph, seed)
        for n in names:  # the seed's own columns: a pattern may bind what the outer row leaves unbound
            if r.vars[n].maybe:
                inner = Relation(inner.df, {**inner.vars, n: seed.vars[n]}) if seed.vars[n].name in inner.df.columns else inner
        return inner, names

    def flags(self, r: Relation, e: A.Node, graph: object) -> tuple[dict, Relation]:
        """A boolean column for each EXISTS inside an expression, by a left join on the outer variables."""
        flags = {}
        for x in e.walk():
            if isinstance(x, A.Exists) and x not in flags:
                inner, names = self.correlated(r, x.pattern, graph)
                left, right = rel.unify(r, inner, names)
                right = right.keep(names).renamed()
                flag = new_name()
                right_df = right.df.distinct().withColumn(flag, F.lit(True))
                on = [left.vars[n].col.eqNullSafe(right.vars[n].col) for n in names]
                df = left.df.join(right_df, reduce(lambda a, b: a & b, on), "left") if on else left.df.join(right_df.select(flag).limit(1), F.lit(True), "left")
                r = Relation(df, left.vars)
                found = F.coalesce(F.col(flag), F.lit(False))
                flags[x] = ~found if x.negated else found
        return flags, r

    def left_join(self, left: Relation, right: A.Node, condition: A.Node | None, graph: object) -> Relation:
        inner = self.compile(right, graph)
        if condition is None:
            return rel.join(left, inner, "left")
        if any(isinstance(x, A.Exists) for x in condition.walk()):
            row = new_name()
            left = Relation(left.df.withColumn(row, F.monotonically_increasing_id()), {**left.vars, ".row" + row: Bound(row, "int")})
            matched = self.filter(rel.join(left, inner), condition, graph)
            kept = [n for n in matched.vars if n not in left.vars or n == ".row" + row]
            out = rel.join(left, matched.keep(kept), "left")
            return Relation(out.df, {n: b for n, b in out.vars.items() if n != ".row" + row})
        return rel.join(left, inner, "left", lambda scope: F.coalesce(truth(self.expressions(scope).value(condition)), F.lit(False)))

    def extend(self, r: Relation, v: str, e: A.Node, graph: object) -> Relation:
        if isinstance(e, A.Ref) and e.name in r.vars:
            return Relation(r.df, {**r.vars, v: r.vars[e.name]})
        flags, r = self.flags(r, e, graph)
        row = None
        if any(isinstance(x, A.Call) and x.op == "BNODE" and x.args for x in e.walk()):
            row = F.monotonically_increasing_id()
        val = self.expressions(r.scope(), flags, row).value(e)
        if val.constant is not None and val.kind not in (IRI, STR):
            keep = val.kind != TERM and lexical_is_canonical(val)
            val = val if keep else Val(TERM, R.const(val.constant))
        return r.with_var(v, val, maybe=not isinstance(e, A.Const))

    def unfold(self, r: Relation, e: A.Node, vs: tuple, graph: object) -> Relation:
        """A row an item: its value and position (lists), its key and value (maps). Anything else keeps its row, unbound."""
        flags, r = self.flags(r, e, graph)
        t = new_name()
        df = r.df.withColumn(t, lift(self.expressions(r.scope(), flags).value(e)))
        items = F.from_json(cdt.entries_udf()(F.col(t)["v"], F.col(t)["dt"]), cdt.ENTRY)
        item = new_name()
        whole = F.when(items.isNull(), F.array(F.lit(None).cast(cdt.ENTRY[6:-1]))).otherwise(items)
        df = df.withColumn(item, F.explode(whole))
        entry, is_map = F.col(item), F.col(t)["dt"] == cdt.MAP
        first = F.when(is_map, entry["key"]).otherwise(entry["value"])
        second = F.when(is_map, entry["value"]).otherwise(entry["key"])
        r = Relation(df, r.vars)
        for name, c in zip(vs, (first, second), strict=False):
            r = r.with_var(name, Val(TERM, c))
        return r

    def table(self, names: tuple, rows: tuple) -> Relation:
        """VALUES; a column of one native kind stays native."""
        if not names:
            return Relation(self.spark.range(len(rows)).select(F.lit(1).alias(new_name())), {})
        vs, columns, types = {}, [], []
        for i, n in enumerate(names):
            cells = [r[i] for r in rows]
            kinds = {from_term(c).kind for c in cells if c is not None}
            kind = kinds.pop() if len(kinds) == 1 and kinds <= {IRI, STR} else TERM
            vs[n] = Bound(new_name(), kind, None, None in cells or not cells)
            columns.append([None if c is None else c.value if kind != TERM else R.row(c) for c in cells])
            types.append(f"{vs[n].name} {'string' if kind != TERM else R.TERM}")
        data = [tuple(c[i] for c in columns) for i in range(len(rows))]
        return Relation(self.spark.createDataFrame(data, ", ".join(types)), vs)

    def service(self, endpoint: str, child: A.Node, silent: bool) -> Relation:
        if endpoint not in self.data.endpoints:
            if silent:
                return self.unit()
            raise UnsupportedError(f"no dataset is registered for endpoint <{endpoint}>")
        found = self.data.endpoints[endpoint]
        return rel.join(self.given(found), self.compile(child)) if isinstance(found, DataFrame) else Compiler(found).compile(child)

    def given(self, df: DataFrame) -> Relation:
        """A frame's rows as solutions; its columns are the variables, null is unbound."""
        vs = {f.name: Bound(new_name(), TERM if isinstance(f.dataType, StructType) else kind_of(f.dataType), None, True) for f in df.schema.fields}
        return Relation(df.select(*[F.col(n).alias(b.name) for n, b in vs.items()]), vs)

    def group(self, n: A.Group, graph: object) -> Relation:
        r = self.compile(n.child, graph)
        for name, e in n.keys:
            if not (isinstance(e, A.Ref) and e.name == name):
                r = self.extend(r, name, e, graph)
        flags: dict = {}
        for _, a in n.aggregates:
            for e in a.args:
                more, r = self.flags(r, e, graph)
                flags |= more
        ex = self.expressions(r.scope(), flags)
        keys = [k for k, _ in n.keys if k in r.vars]
        if isinstance(graph, Var) and graph.name in r.vars and graph.name not in keys:
            keys.append(graph.name)
        if any(a.op == "RANK" for _, a in n.aggregates):
            return self.rank(r, keys, n.aggregates, ex)
        vs = {k: r.vars[k] for k in keys}
        made = {v: aggregate(a, ex, r) for v, a in n.aggregates}
        names = {v: new_name() for v in made}
        columns = [m.column.alias(names[v]) for v, m in made.items()] or [F.count(F.lit(1)).alias(new_name())]
        df = (r.df.groupBy(*[b.name for b in vs.values()]) if keys or not n.implicit else r.df).agg(*columns)
        out = Relation(df, {**vs, **{v: Bound(names[v], made[v].kind, None, True) for v in made}})
        for v, m in made.items():
            if m.finish is not None:
                val = m.finish(F.col(names[v]))
                out = Relation(out.df, {k: b for k, b in out.vars.items() if k != v}).with_var(v, val)
        return out

    def rank(self, r: Relation, keys: list[str], aggregates: tuple, ex: Expressions) -> Relation:
        """Every row, with its place (from 0) in its group's order.

        Rows are dealt into ranges of group and order; a row's place is its place in its part of the group plus the
        sizes of the parts before, so a group is the work of as many tasks as it has ranges.
        """
        for v, a in aggregates:
            groups = [r.vars[k].name for k in keys]
            part, start, nth = new_name(), new_name(), new_name()
            sorts = [(new_name(), c, up) for e, up in a.order for c in sort_keys(ex.value(e), self.data.star and self.data.quads is not None)]
            order = {n: c for n, c, _ in sorts}
            by = [F.col(n).asc_nulls_first() if up else F.col(n).desc_nulls_last() for n, _, up in sorts]
            # materialised, since the ranges come from a sample
            dealt = cut(r.df.withColumns(order).repartitionByRange(*groups, *by).withColumn(part, F.spark_partition_id()))
            sizes = dealt.groupBy(part, *groups).agg(F.count(F.lit(1)).alias(nth))
            before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
            sizes = sizes.select(F.col(part).alias(f"{part}_"), *[F.col(g).alias(f"{g}_") for g in groups], F.coalesce(F.sum(nth).over(before), F.lit(0)).alias(start))
            same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (part, *groups)])
            within = Window.partitionBy(part, *groups).orderBy(*by)
            placed = dealt.withColumn(nth, F.row_number().over(within) - 1).join(sizes, same)
            r = Relation(placed, r.vars).with_var(v, Val("int", (F.col(start) + F.col(nth)).cast("bigint")), maybe=False)
        return r

    def project(self, r: Relation, names: list[str]) -> Relation:
        missing = [n for n in names if n not in r.vars]
        for n in missing:
            r = r.with_var(n, Val(TERM, F.lit(None).cast(R.TERM)))
        if not names:
            return Relation(r.df.select(F.lit(1).alias(new_name())), {})
        seen: dict[str, str] = {}
        columns, vs = [], {}
        for n in dict.fromkeys(names):
            b = r.vars[n]
            name = b.name if b.name not in seen else new_name()
            seen[name] = n
            columns.append(b.col.alias(name))
            vs[n] = replace(b, name=name)
        return Relation(r.df.select(*columns), vs)

    def distinct(self, c: A.Node, graph: object) -> Relation:
        """Distinct solutions; an ORDER BY below is applied again after, as far as its keys are projected."""
        if isinstance(c, A.Project) and isinstance(c.child, A.OrderBy):
            r = self.distinct(A.Project(c.child.child, c.vars), graph)
            if all(A.expr_variables(e) <= set(r.vars) for e, _ in c.child.keys):
                r = self.order_by(r, c.child.keys, graph)
            return r
        r = self.compile(c, graph)
        return Relation(r.df.select(*[b.name for b in r.vars.values()]).distinct() if r.vars else r.df.limit(1), r.vars)

    def ordering(self, v: Val, up: bool) -> list[Column]:
        return [k.asc_nulls_first() if up else k.desc_nulls_last() for k in sort_keys(v, self.data.star and self.data.quads is not None)]

    def order_by(self, r: Relation, keys: tuple, graph: object) -> Relation:
        for e, _ in keys:
            flags, r = self.flags(r, e, graph)
        ex = self.expressions(r.scope(), flags)
        made, order = {}, []
        for e, up in keys:
            v = ex.value(e)
            parts = sort_keys(v, self.data.star and self.data.quads is not None)
            if v.kind == TERM:  # as columns of their own: they are computed once, and the order doesn't tie whole expressions to the plan
                names = [new_name() for _ in parts]
                made.update(zip(names, parts, strict=True))
                parts = [F.col(n) for n in names]
            order += [k.asc_nulls_first() if up else k.desc_nulls_last() for k in parts]
        if not made:
            return Relation(r.df.orderBy(*order), r.vars)
        return Relation(r.df.withColumns(made).orderBy(*order).select(*r.df.columns), r.vars)

    def slice(self, r: Relation, offset: int, limit: int | None) -> Relation:
        df = r.df.offset(offset) if offset else r.df
        return Relation(df if limit is None else df.limit(limit), r.vars)


def lexical_is_canonical(v: Val) -> bool:
    """Whether a native constant prints as it was written."""
    text = v.constant.value
    if v.kind == "int":
        return text == str(int(text))
    return v.kind == BOOL


def _is(v: Val, t: R.Term) -> Column:
    """Whether a scanned value is exactly a term."""
    if isinstance(t, R.Iri):
        if v.kind != IRI:
            return F.lit(False)
        if v.constant is not None:
            return F.lit(v.constant == t)
        prefix, key = v.raw
        rest = t.value[len(prefix) :]
        if not t.value.startswith(prefix):
            return F.lit(False)
        return key == F.lit(int(rest)) if rest.isdigit() and len(rest) < 19 else key.cast("string") == rest
    c = from_term(t)
    if c.kind == v.kind != TERM:
        return v.col == c.col
    return lift(v) == R.const(t)


def _freedom(t: Triple) -> int:
    """How little a pattern restricts: bound subjects count most, then objects, then predicates."""
    return 4 * bool(A.variables_of(t.s)) + 2 * bool(A.variables_of(t.o)) + 3 * isinstance(t.p, Var) + (t.p == R.Iri(TYPE))


def _branches(n: A.Node) -> list[A.Node]:
    return [*_branches(n.left), *_branches(n.right)] if isinstance(n, A.Union) else [n]


def _conjuncts(e: A.Node) -> list[A.Node]:
    if isinstance(e, A.Call) and e.op == "&&":
        return [x for a in e.args for x in _conjuncts(a)]
    return [e]


__all__ = ["Compiler", "DataFrame", "list_literal"]
