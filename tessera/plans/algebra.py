"""The logical algebra: frozen nodes for patterns, expressions, paths, queries and updates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from tessera.terms import Triple, Var


class Node:
    """A node; ``children`` are the fields that are nodes or tuples of nodes."""

    def transform(self, f: Callable[[Node], Node]) -> Node:
        """Rewrite bottom-up."""
        new = {}
        for x in fields(self):
            v = getattr(self, x.name)
            if isinstance(v, Node):
                new[x.name] = v.transform(f)
            elif isinstance(v, tuple):
                new[x.name] = tuple(_deep(y, f) for y in v)
        return f(replace(self, **new) if new else self)

    def walk(self):
        """This node and all below."""
        yield self
        for x in fields(self):
            yield from _walk(getattr(self, x.name))


def _deep(y, f):
    if isinstance(y, Node):
        return y.transform(f)
    return tuple(_deep(z, f) for z in y) if isinstance(y, tuple) else y


def _walk(v):
    if isinstance(v, Node):
        yield from v.walk()
    elif isinstance(v, tuple):
        for y in v:
            yield from _walk(y)


# expressions


@dataclass(frozen=True)
class Const(Node):
    term: object


@dataclass(frozen=True)
class Ref(Node):
    name: str


@dataclass(frozen=True)
class Call(Node):
    """A built-in (upper-case name or operator sign) or a function IRI (``iri`` set)."""

    op: str
    args: tuple = ()
    iri: bool = False


@dataclass(frozen=True)
class Agg(Node):
    """An aggregate. ``args`` is empty for COUNT(*); FOLD has one or two; ``iri`` for custom ones."""

    op: str
    args: tuple = ()
    distinct: bool = False
    separator: str = " "
    order: tuple = ()
    iri: bool = False


@dataclass(frozen=True)
class Exists(Node):
    pattern: Node
    negated: bool = False


@dataclass(frozen=True)
class Quoted(Node):
    """A quoted triple with expressions inside."""

    s: Node
    p: Node
    o: Node


# property paths


@dataclass(frozen=True)
class Link(Node):
    iri: str


@dataclass(frozen=True)
class Inverse(Node):
    path: Node


@dataclass(frozen=True)
class Sequence_(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Alternative(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Negated(Node):
    forward: tuple
    reverse: tuple
    has_reverse: bool = False


@dataclass(frozen=True)
class Repeat(Node):
    """``?`` (0, 1), ``*`` (0, None) or ``+`` (1, None)."""

    path: Node
    least: int
    most: int | None


# patterns


@dataclass(frozen=True)
class Bgp(Node):
    triples: tuple = ()


@dataclass(frozen=True)
class Path(Node):
    s: object
    path: Node
    o: object


@dataclass(frozen=True)
class Join(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class LeftJoin(Node):
    left: Node
    right: Node
    condition: Node | None = None


@dataclass(frozen=True)
class Minus(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Union(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Filter(Node):
    child: Node
    expr: Node


@dataclass(frozen=True)
class Graph(Node):
    graph: object
    child: Node


@dataclass(frozen=True)
class Extend(Node):
    child: Node
    var: str
    expr: Node


@dataclass(frozen=True)
class Unfold(Node):
    child: Node
    expr: Node
    vars: tuple


@dataclass(frozen=True)
class Table(Node):
    vars: tuple
    rows: tuple


@dataclass(frozen=True)
class Service(Node):
    endpoint: object
    child: Node
    silent: bool = False


@dataclass(frozen=True)
class Group(Node):
    """``keys`` are (variable name, expression); ``aggregates`` (variable name, Agg)."""

    child: Node
    keys: tuple
    aggregates: tuple
    implicit: bool = False


@dataclass(frozen=True)
class Project(Node):
    child: Node
    vars: tuple


@dataclass(frozen=True)
class Distinct(Node):
    child: Node


@dataclass(frozen=True)
class Reduced(Node):
    child: Node


@dataclass(frozen=True)
class OrderBy(Node):
    """``keys`` are (expression, ascending)."""

    child: Node
    keys: tuple


@dataclass(frozen=True)
class Slice(Node):
    child: Node
    offset: int = 0
    limit: int | None = None


@dataclass(frozen=True)
class Hint(Node):
    child: Node
    name: str


# queries and updates


@dataclass(frozen=True)
class Query(Node):
    """``form``: SELECT, ASK, CONSTRUCT or DESCRIBE; ``what``: template triples or described terms."""

    form: str
    child: Node
    what: tuple = ()
    default: tuple = ()
    named: tuple = ()


@dataclass(frozen=True)
class Modify(Node):
    """Quad templates are (s, p, o, g); g None is the graph of WITH or the default one."""

    delete: tuple
    insert: tuple
    where: Node
    with_: str | None = None
    using: tuple = ()
    using_named: tuple = ()


@dataclass(frozen=True)
class Clear(Node):
    target: str
    graph: str | None = None
    silent: bool = False
    drop: bool = False


@dataclass(frozen=True)
class Create(Node):
    graph: str
    silent: bool = False


@dataclass(frozen=True)
class Copy(Node):
    """ADD, COPY or MOVE; None is the default graph."""

    kind: str
    source: str | None
    target: str | None
    silent: bool = False


@dataclass(frozen=True)
class Load(Node):
    url: str
    graph: str | None = None
    silent: bool = False


@dataclass(frozen=True)
class Update(Node):
    operations: tuple


def variables_of(x: object) -> list[str]:
    """Variable names of a term pattern or triple, in order."""
    if isinstance(x, Var):
        return [x.name]
    if isinstance(x, Triple):
        return [*variables_of(x.s), *variables_of(x.p), *variables_of(x.o)]
    if isinstance(x, tuple):
        return [n for y in x for n in variables_of(y)]
    return []


def scope(n: Node) -> list[str]:
    """The in-scope variables of a pattern, in order of appearance; names with a dot in front are hidden."""
    match n:
        case Bgp(triples):
            found = variables_of(triples)
        case Path(s, _, o):
            found = variables_of((s, o))
        case Join(a, b) | LeftJoin(a, b) | Union(a, b):
            found = scope(a) + scope(b)
        case Minus(a, _):
            found = scope(a)
        case Graph(g, c):
            found = variables_of(g) + scope(c)
        case Extend(c, v, _):
            found = [*scope(c), v]
        case Unfold(c, _, vs):
            found = [*scope(c), *vs]
        case Table(vs, _) | Project(_, vs):
            found = list(vs)
        case Group(_, keys, aggregates):
            found = [k for k, _ in keys] + [a for a, _ in aggregates]
        case Service(e, c):
            found = scope(c)
        case Filter() | Distinct() | Reduced() | OrderBy() | Slice() | Hint() | Query():
            found = scope(n.child)
        case _:
            found = []
    return list(dict.fromkeys(found))


def expr_variables(e: Node) -> set[str]:
    """Variables an expression reads, those of EXISTS patterns included."""
    out: set[str] = set()
    for x in e.walk():
        if isinstance(x, Ref):
            out.add(x.name)
        elif isinstance(x, Exists):
            out.update(scope(x.pattern))
            for y in x.pattern.walk():
                if isinstance(y, Filter):
                    out |= expr_variables(y.expr)
    return out
