"""SPARQL Update: each operation makes a new version of the dataset.

A WHERE clause is evaluated against the version before the operation; deletions come before
insertions. Versions are cut from their lineage in the shared checkpoint folder.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import terms as R
from tessera.operators.compiler import Compiler
from tessera.operators.forms import instantiate
from tessera.plans import algebra as A
from tessera.plans.parser import parse_update
from tessera.plans.rewrite import rewrite
from tessera.shared import cut
from tessera.sources.dataset import QUADS


class UpdateError(ValueError):
    """An operation that can't be done (a graph or document that is not there)."""


def apply(data, text: str | A.Update):
    update = parse_update(text, data.base) if isinstance(text, str) else text
    if data.quads is None:
        data = data.with_quads(data.spark.createDataFrame([], QUADS))
    for op in update.operations:
        data = data.with_quads(cut(operation(data, op)))
    return data


def _of_graph(g: str | None):
    return F.col("g").isNull() if g is None else F.col("g").eqNullSafe(F.lit(g))


def operation(data, op: A.Node) -> DataFrame:
    quads = data.quads
    match op:
        case A.Modify():
            return modify(data, op)
        case A.Clear(target, graph):
            gone = {"ALL": F.lit(True), "DEFAULT": F.col("g").isNull(), "NAMED": F.col("g").isNotNull()}.get(target)
            return quads.where(~(_of_graph(graph) if gone is None else gone))
        case A.Create():
            return quads
        case A.Copy(kind, source, target):
            if source == target:
                return quads
            moved = quads.where(_of_graph(source)).withColumn("g", F.lit(target).cast("string"))
            rest = quads
            if kind in ("COPY", "MOVE"):
                rest = rest.where(~_of_graph(target))
            if kind == "MOVE":
                rest = rest.where(~_of_graph(source))
            return rest.unionByName(moved).distinct()
        case A.Load(url, graph, silent):
            from tessera.sources.readers import read

            try:
                loaded = cut(read(data.spark, url))
            except (OSError, ValueError, PySparkException) as e:
                if silent:
                    return quads
                raise UpdateError(f"can't load <{url}>: {e}") from e
            if graph is not None:
                loaded = loaded.withColumn("g", F.lit(graph))
            return quads.unionByName(loaded).distinct()
    raise UpdateError(f"no operation {type(op).__name__}")


def modify(data, op: A.Modify) -> DataFrame:
    seen = data
    if op.using or op.using_named:
        seen = replace(data, default_graphs=op.using, named_graphs=op.using_named)
    elif op.with_ is not None:
        seen = replace(data, default_graphs=(op.with_,))
    r = Compiler(seen).compile(rewrite(op.where))
    graph = None if op.with_ is None else R.Iri(op.with_)
    template = lambda qs: tuple((s, p, o, graph if g is None else g) for s, p, o, g in qs)
    quads = data.quads
    if op.delete:
        gone = instantiate(r, template(op.delete)).select(*[F.col(c).alias(f"{c}_") for c in "spog"])
        same = (F.col("s") == F.col("s_")) & (F.col("p") == F.col("p_")) & (F.col("o") == F.col("o_")) & F.col("g").eqNullSafe(F.col("g_"))
        quads = quads.join(gone, same, "left_anti")
    if op.insert:
        quads = quads.unionByName(instantiate(r, template(op.insert))).distinct()
    return quads
