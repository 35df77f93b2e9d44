"""Datasets: quads in a DataFrame, mapped tables, or both, with what a query needs around them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import terms as R
from tessera.functions.registry import Registry
from tessera.functions.values import lift
from tessera.shared import cut
from tessera.sources.mapped import TYPE, Mapping, TableMap, Wanted

QUADS = f"s {R.TERM}, p string, o {R.TERM}, g string"


@dataclass(frozen=True)
class Dataset:
    """An immutable dataset version.

    ``quads`` has columns s, p, o, g (s and o TERM, p and g IRIs as text, g null in the default graph).
    Mapped tables are part of the default graph, and each is a named graph of its own.
    ``default_graphs`` makes named graphs the default one (FROM); ``named_graphs`` limits GRAPH.
    ``endpoints`` maps SERVICE IRIs to datasets, or to frames whose rows are solutions: their columns are
    the variables (numbers, texts, booleans, timestamps, or TERM structs), to be used as SERVICE <iri> {}. ``star`` says whether quoted triples can occur. With
    ``optimize`` off, queries are compiled as they are written (for differential tests).
    """

    spark: SparkSession
    quads: DataFrame | None = None
    mapping: Mapping | None = None
    registry: Registry = field(default_factory=Registry)
    endpoints: dict[str, Dataset | DataFrame] = field(default_factory=dict)
    base: str = ""
    star: bool = True
    default_graphs: tuple[str, ...] | None = None
    named_graphs: tuple[str, ...] | None = None
    optimize: bool = True

    @staticmethod
    def of_graphs(spark: SparkSession, graphs: dict[str | None, DataFrame], **options) -> Dataset:
        """From a frame of (s, p, o) triples for each graph; None is the default graph."""
        frames = [df.select("s", "p", "o", F.lit(g).cast("string").alias("g")) for g, df in graphs.items()]
        return Dataset(spark, reduce(DataFrame.unionByName, frames), **options)

    @staticmethod
    def of(spark: SparkSession, quads: Iterable[tuple], **options) -> Dataset:
        """From (s, p, o) or (s, p, o, g) tuples of driver-side terms."""
        rows = [(R.row(q[0]), q[1].value, R.row(q[2]), q[3].value if len(q) > 3 and q[3] is not None else None) for q in quads]
        return Dataset(spark, spark.createDataFrame(list(dict.fromkeys(rows)), QUADS), **options)

    def with_quads(self, quads: DataFrame) -> Dataset:
        return replace(self, quads=quads)

    def mapped(self, name: str | None) -> list[str]:
        """The mapped tables' graphs that a named graph, or (None) the default graph, is made of.

        A table is in the default graph and in a graph of its own; FROM and FROM NAMED choose among the latter.
        """
        graphs = [t.graph for t in self.mapping.tables] if self.mapping else []
        if name is None:
            return graphs if self.default_graphs is None else [g for g in graphs if g in self.default_graphs]
        return [g for g in graphs if g == name and (self.named_graphs is None or g in self.named_graphs)]

    def mapped_names(self) -> list[str]:
        """The mapped tables' graphs that a GRAPH variable ranges over."""
        return [t.graph for t in self.mapping.tables if self.named_graphs is None or t.graph in self.named_graphs] if self.mapping else []

    def _tables(self, graphs: list[str], named: bool, wanted: Wanted) -> list[DataFrame]:
        tables = [t for t in (self.mapping.tables if self.mapping else ()) if t.graph in graphs]
        found = [table_quads(t, self.mapping, t.graph if named else None, wanted) for t in tables]
        return [df for df in found if df is not None]

    def _union(self, frames: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], QUADS)

    def all_quads(self, wanted: Wanted = Wanted()) -> DataFrame:
        """Everything as quads, each once: mapped tables in their own graphs. Of mapped tables only what is wanted is read, see ``active``."""
        return self._union([*([] if self.quads is None else [self.quads]), *self._tables([t.graph for t in self.mapping.tables] if self.mapping else [], True, wanted)])

    def active(self, graph: str | None, wanted: Wanted = Wanted()) -> DataFrame:
        """(s, p, o) of a named graph or (None) the default one; a merge of graphs is a set.

        Of mapped tables only the triples that are ``wanted`` are read and given; those of ``quads`` are all given.
        """
        frames = self._tables(self.mapped(graph), False, wanted)
        if self.quads is not None:
            if graph is not None:
                here = F.col("g") == graph if self.named_graphs is None or graph in self.named_graphs else F.lit(False)
            elif self.default_graphs is None:
                here = F.col("g").isNull()
            else:
                here = F.col("g").isin(*self.default_graphs) if self.default_graphs else F.lit(False)
            frames.append(self.quads.where(here))
        found = self._union(frames).select("s", "p", "o")
        return found.distinct() if graph is None and len(self.default_graphs or ()) > 1 else found

    def named(self, wanted: Wanted = Wanted()) -> DataFrame:
        """(s, p, o, g) of all named graphs a GRAPH variable ranges over; ``wanted`` as in ``active``."""
        frames = self._tables(self.mapped_names(), True, wanted)
        if self.quads is not None:
            quads = self.quads.where("g is not null")
            frames.append(quads if self.named_graphs is None else quads.where(F.col("g").isin(*self.named_graphs) if self.named_graphs else F.lit(False)))
        return self._union(frames)

    # access by pattern

    def graph_nodes(self, graph: str | None = None) -> DataFrame:
        """The distinct subjects and objects (column term) of a graph."""
        found = self.active(graph)
        return found.select(F.col("s").alias("term")).union(found.select("o")).distinct()

    def match(self, s: R.Term | None = None, p: R.Term | None = None, o: R.Term | None = None, g: R.Term | None = None) -> DataFrame:
        """The quads with these terms."""
        quads = self.all_quads(Wanted(s, p, o))
        for name, t in (("s", s), ("o", o)):
            if t is not None:
                quads = quads.where(F.col(name) == R.const(t))
        for name, t in (("p", p), ("g", g)):
            if t is not None:
                quads = quads.where(F.col(name) == t.value)
        return quads

    def count(self, *pattern: R.Term | None) -> int:
        return self.match(*pattern).count()

    def holds(self, *pattern: R.Term | None) -> bool:
        return not self.match(*pattern).isEmpty()

    def graphs(self) -> DataFrame:
        """The distinct names of the graphs that are not the default one."""
        return self.all_quads().where("g is not null").select("g").distinct()

    def rdf_list(self, head: R.Term, graph: str | None = None) -> list[R.Term]:
        """The members of an RDF collection, in order; a loop or a fork is an error.

        Cells learn their distance from the head by pointer doubling: a list of n cells takes log n joins.
        """
        nil = R.Iri(R.RDF + "nil")
        if head == nil:
            return []
        rows = self.list_cells(graph)
        at = rows.where(F.col("cell") == R.const(head)).select("list", "place").collect()
        if len(at) == 1:
            own = rows.where((F.col("list") == R.const(R.from_row(at[0].list))) & (F.col("place") >= at[0].place)).orderBy("place").collect()
            if [r.place - at[0].place for r in own] == list(range(len(own))) and own[-1].end is not None and R.from_row(own[-1].end) == nil:
                return [R.from_row(r.member) for r in own]
        raise ValueError(f"{R.nt(head)} is not the head of a list")

    def list_cells(self, graph: str | None = None) -> DataFrame:
        """(list, cell, place, member, end) of each cell of all RDF collections of a graph, under each list's head.

        ``end`` is what the last cell points to (rdf:nil in a whole list), null elsewhere. Cells in a loop
        have no head and are left out; a cell with two members or successors gives a place twice.
        """
        cells = self.active(graph).where(F.col("p").isin(R.RDF + "first", R.RDF + "rest"))
        first = cells.where(F.col("p") == R.RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("member"))
        rest = cells.where(F.col("p") == R.RDF + "rest").select(F.col("s").alias("cell"), F.col("o").alias("next"))
        back = rest.select(F.col("next").alias("cell"), F.col("cell").alias("up"))
        # each cell with an ancestor ``up`` at ``place`` steps; heads have none above
        reach = cut(first.select("cell").distinct().join(back, "cell", "left").select("cell", F.coalesce("up", "cell").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("place")))
        heads = cut(reach.where("place = 0").select(F.col("up").alias("head")))
        most = 2 * reach.count()
        while True:
            step = reach.select(F.col("cell").alias("up"), F.col("up").alias("above"), F.col("place").alias("more"))
            reach = cut(reach.join(step, "up").select("cell", F.col("above").alias("up"), (F.col("place") + F.col("more")).alias("place")).distinct())
            open_ = reach.join(heads, F.col("up") == F.col("head"), "left_anti").agg(F.max("place")).first()[0]
            if open_ is None or open_ > most:  # beyond the number of cells: a loop
                break
        placed = reach.join(heads, F.col("up") == F.col("head")).select("cell", F.col("up").alias("list"), "place").join(first, "cell")
        ends = rest.join(first.select(F.col("cell").alias("next")), "next", "left_anti").select("cell", F.col("next").alias("end"))
        return placed.join(ends, "cell", "left").select("list", "cell", "place", "member", "end")

    def list_literals(self, graph: str | None = None) -> DataFrame:
        """(list, literal): each RDF collection of a graph as a list literal; those that are no whole list are left out."""
        member = F.when((F.col("member")["dt"] == R.XSD + "integer"), F.col("member")["v"]).otherwise(R.nt_column(F.col("member")))
        rows = self.list_cells(graph).groupBy("list").agg(
            F.sort_array(F.collect_list(F.struct("place", member.alias("text")))).alias("cells"), F.max(F.coalesce(F.col("end")["v"] == R.RDF + "nil", F.lit(False))).alias("whole")
        )
        rows = rows.where(F.col("whole") & (F.transform("cells", lambda c: c["place"]) == F.sequence(F.lit(0).cast("long"), F.size("cells") - F.lit(1).cast("long"))))
        text = F.concat(F.lit("["), F.array_join(F.transform("cells", lambda c: c["text"]), ", "), F.lit("]"))
        return rows.select("list", R.struct(R.LITERAL, text, F.lit(R.CDT + "List")).alias("literal"))

    def list_from_head(self, head: R.Term, graph: str | None = None) -> R.Literal:
        """An RDF collection as a list literal."""
        from tessera.functions import cdt

        return cdt.literal(self.rdf_list(head, graph))

    def rdf_sequence(self, node: R.Term, graph: str | None = None) -> list[R.Term]:
        """The members rdf:_1, rdf:_2 ... of a container, in order."""
        n = F.regexp_extract("p", f"^{R.RDF}_([0-9]+)$", 1)
        rows = self.active(graph).where((F.col("s") == R.const(node)) & (n != "")).orderBy(n.cast("long")).select("o").collect()
        return [R.from_row(r.o) for r in rows]

    def add_list(self, members: list[R.Term], graph: str | None = None) -> tuple[R.Term, Dataset]:
        """The head of a new RDF collection, and the dataset with it."""
        import uuid

        stem = uuid.uuid4().hex
        cells = [R.Blank(f"l{stem}{i}") for i in range(len(members))]
        nil = R.Iri(R.RDF + "nil")
        g = R.Iri(graph) if graph else None
        quads = [q for i, m in enumerate(members) for q in ((cells[i], R.Iri(R.RDF + "first"), m, g), (cells[i], R.Iri(R.RDF + "rest"), cells[i + 1] if i + 1 < len(cells) else nil, g))]
        added = Dataset.of(self.spark, quads).quads
        return (cells[0] if cells else nil), self.with_quads(added if self.quads is None else self.quads.unionByName(added))

    def etag(self) -> str:
        """A hash of the quads: equal for equal datasets, whatever their order."""
        text = F.concat_ws(" ", R.nt_column(F.col("s")), "p", R.nt_column(F.col("o")), "g")
        row = self.all_quads().agg(F.sum(F.xxhash64(text).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
        return f"{row['n']}-{row['h']}"

    # queries

    def select(self, text: str) -> DataFrame:
        """A SELECT or ASK query's solutions; typed columns stay typed, other terms are given as lexical text."""
        from tessera.operators.forms import select

        return select(self, text)

    def construct(self, text: str) -> DataFrame:
        """(s, p, o) TERM triples of a CONSTRUCT or DESCRIBE query."""
        from tessera.operators.forms import construct

        return construct(self, text)

    def terms(self, text: str) -> list[dict[str, R.Term]]:
        """A SELECT query's solutions on the driver, as dicts of the bound variables."""
        from tessera.operators.forms import terms

        return terms(self, text)

    def ask(self, text: str) -> bool:
        from tessera.operators.forms import ask

        return ask(self, text)

    def update(self, text: str) -> Dataset:
        """The dataset after a SPARQL Update request."""
        from tessera.operators.update import apply

        return apply(self, text)


def table_quads(t: TableMap, mapping: Mapping, graph: str | None = None, wanted: Wanted = Wanted()) -> DataFrame | None:
    """A mapped table as quads of a graph: one array of triples a row, exploded. None if it has no wanted ones.

    A fixed subject or object is looked for in the table's own columns, so that only columns and rows that can
    have it are read.
    """
    from tessera.functions.cdt import LIST
    from tessera.functions.values import DATATYPE, INT, IRI, STR, Val
    from tessera.operators.compiler import list_literal

    df = t.df if wanted.s is None else t.where_subject(wanted.s)
    if df is None:
        return None
    parts, matches = [], []

    def add(p: str, o: Column, match: Column | None) -> None:
        """A triple of each row whose object can be the wanted one; ``match`` says of which rows it is, None of none."""
        if wanted.predicate(p) and (wanted.o is None or match is not None):
            triple = F.struct(F.lit(p).alias("p"), o.alias("o"))
            parts.append(triple if wanted.o is None else F.when(match, triple))
            matches.append(match)

    def literal(c: str, kind: str, o: Column) -> Column | None:
        x = wanted.o
        if not isinstance(x, R.Literal) or x.lang is not None or x.datatype != (LIST if kind == "list" else DATATYPE[kind]):
            return None
        return t.is_text(c, x.value) if kind in (INT, STR) else o == R.const(x)

    add(TYPE, R.const(R.Iri(t.type)), F.lit(True) if wanted.o == R.Iri(t.type) else None)
    for p, (c, kind) in t.columns().items():
        o = list_literal(F.col(c)) if kind == "list" else lift(Val(kind, F.col(c)))
        add(p, o, literal(c, kind, o))
    for p, (c, target) in t.references().items():
        prefix = mapping.table(target).prefix
        key = wanted.o.value[len(prefix) :] if isinstance(wanted.o, R.Iri) and wanted.o.value.startswith(prefix) else None
        add(p, lift(Val(IRI, F.concat(F.lit(prefix), F.col(c).cast("string")))), None if key is None else t.is_text(c, key))
    if not parts:
        return None
    if wanted.o is not None:
        df = df.where(reduce(lambda a, b: a | b, matches))
    s = R.struct(R.IRI_, F.concat(F.lit(t.prefix), t.key.cast("string")))
    rows = df.select(s.alias("s"), F.array(*parts).alias("x")).select("s", F.explode("x").alias("x")).select("s", "x.p", "x.o")
    return rows.where("o is not null").withColumn("g", F.lit(graph).cast("string"))
