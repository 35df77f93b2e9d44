"""Query forms: SELECT, ASK, CONSTRUCT, DESCRIBE."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import terms as R
from tessera.functions.values import IRI, TERM, lift
from tessera.operators.compiler import Compiler
from tessera.operators.relation import Relation
from tessera.plans import algebra as A
from tessera.plans.parser import parse_query
from tessera.plans.rewrite import rewrite
from tessera.terms import Triple, Var


def parsed(data, text: str | A.Query) -> A.Query:
    q = parse_query(text, data.base, set(data.registry.aggregates)) if isinstance(text, str) else text
    return rewrite(q) if data.optimize else q


def focused(data, q: A.Query):
    """The dataset under the query's FROM clauses."""
    if not q.default and not q.named:
        return data
    return replace(data, default_graphs=q.default, named_graphs=q.named)


def solutions(data, q: A.Query) -> Relation:
    return Compiler(focused(data, q)).compile(q.child)


def native(r: Relation) -> DataFrame:
    """The visible variables as columns of their own names: typed values, and the lexical text of other terms."""
    columns = []
    for n, b in r.vars.items():
        if n[0] == ".":
            continue
        v = b.val
        columns.append((F.when(v.col["k"] == R.BLANK, F.concat(F.lit("_:"), v.col["v"])).otherwise(v.col["v"]) if v.kind == TERM else v.col).alias(n))
    return r.df.select(*columns)


def select(data, text: str | A.Query) -> DataFrame:
    q = parsed(data, text)
    if q.form == "ASK":
        return solutions(data, q).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))
    if q.form != "SELECT":
        raise ValueError("construct() runs CONSTRUCT and DESCRIBE queries")
    return native(solutions(data, q))


def term_frame(data, text: str | A.Query) -> DataFrame:
    """A SELECT query's solutions with every variable as a TERM column."""
    r = solutions(data, parsed(data, text))
    return r.df.select(*[lift(b.val).alias(n) for n, b in r.vars.items() if n[0] != "."])


def terms(data, text: str | A.Query) -> list[dict[str, R.Term]]:
    df = term_frame(data, text)
    return [{n: R.from_row(row[n]) for n in df.columns if row[n] is not None} for row in df.collect()]


def ask(data, text: str | A.Query) -> bool:
    return not solutions(data, parsed(data, text)).df.isEmpty()


def position(x: object, r: Relation, row) -> object:
    """A template position as a TERM column: constants, variables, fresh blank nodes a row, quoted triples."""
    if isinstance(x, Var):
        return lift(r.vars[x.name].val) if x.name in r.vars else F.lit(None).cast(R.TERM)
    if isinstance(x, R.Blank):
        return R.struct(R.BLANK, F.concat(F.lit(f"{x.value}r"), row.cast("string")))
    if isinstance(x, Triple):
        s, p, o = (position(y, r, row) for y in (x.s, x.p, x.o))
        text = F.concat(F.lit("<< "), R.nt_column(s), F.lit(" "), R.nt_column(p), F.lit(" "), R.nt_column(o), F.lit(" >>"))
        return R.struct(R.TRIPLE, F.when(s["k"].isin(R.BLANK, R.IRI_, R.TRIPLE) & (p["k"] == R.IRI_), text))
    return R.const(x)


def instantiate(r: Relation, template: tuple) -> DataFrame:
    """(s, p, o, g) of quad templates over the solutions; incomplete and illegal quads are left out."""
    needs_rows = any(isinstance(y, R.Blank) for q in template for y in _leaves(q))
    df, row = r.df, F.lit(0)
    if needs_rows:
        df = df.withColumn(".row", F.monotonically_increasing_id())
        row = F.col("`.row`")
    parts = []
    for s, p, o, g in template:
        graph = F.lit(None).cast("string") if g is None else position(g, r, row)["v"]
        legal = F.lit(True) if g is None else graph.isNotNull() & (position(g, r, row)["k"] == R.IRI_)
        parts.append(F.struct(position(s, r, row).alias("s"), position(p, r, row).alias("p"), position(o, r, row).alias("o"), graph.alias("g"), legal.alias("legal")))
    if not parts:
        return df.sparkSession.createDataFrame([], f"s {R.TERM}, p string, o {R.TERM}, g string")
    rows = df.select(F.explode(F.array(*parts)).alias("x"))
    fine = F.col("x.s.k").isin(R.BLANK, R.IRI_, R.TRIPLE) & (F.col("x.p.k") == R.IRI_) & F.col("x.o").isNotNull() & F.col("x.legal")
    return rows.where(fine).select("x.s", F.col("x.p.v").alias("p"), "x.o", "x.g").distinct()


def _leaves(x: object):
    if isinstance(x, Triple):
        x = (x.s, x.p, x.o)
    if isinstance(x, tuple):
        for y in x:
            yield from _leaves(y)
    else:
        yield x


def construct(data, text: str | A.Query) -> DataFrame:
    q = parsed(data, text)
    r = solutions(data, q)
    if q.form == "CONSTRUCT":
        template = tuple((t.s, t.p, t.o, None) for t in q.what)
        return instantiate(r, template).select("s", "p", "o").distinct()
    if q.form != "DESCRIBE":
        raise ValueError("select() runs SELECT and ASK queries")
    found = [r.df.select(lift(r.vars[t.name].val).alias("term")) if isinstance(t, Var) and t.name in r.vars else data.spark.range(1).select(R.const(t).alias("term")) for t in q.what if not (isinstance(t, Var) and t.name not in r.vars)]
    quads = focused(data, q).active(None)
    if not found:
        return quads.where("false")
    wanted = reduce(DataFrame.union, found).where("term is not null").distinct()
    return quads.join(wanted, quads.s == wanted.term, "left_semi").distinct()


__all__ = ["IRI", "ask", "construct", "select", "solutions", "term_frame", "terms"]
