"""List and map literals: their lexical forms, functions, equality and order.

A list literal is ``[item, ...]`` and a map literal ``{key: value, ...}``; items are RDF terms in
Turtle syntax, numbers and booleans in short form, nested lists and maps, or null.
Functions on lists of numbers are native array expressions; others work on parsed values in Arrow UDFs.
Results are TERM columns in canonical form.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import terms as R
from tessera.functions import star
from tessera.terms import CDT, XSD

LIST, MAP = CDT + "List", CDT + "Map"
_SHORT = re.compile(r"\s*(?:([+-]?(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+)|([+-]?\d*\.\d+)|([+-]?\d+)|(true|false)\b|(null)\b)")
_QUOTED = re.compile(r"""\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)')(?:\^\^<([^>]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?""", re.S)


_BLANK = re.compile(r"_:(\w(?:[\w.-]*[\w-])?)")


class CdtError(ValueError):
    """A literal that is not a list or map, or an argument out of range."""


def _space(text: str, at: int) -> int:
    while at < len(text) and text[at] in " \t\r\n":
        at += 1
    return at


def _item(text: str, at: int) -> tuple[object, int]:
    at = _space(text, at)
    if text[at : at + 1] in ("[", "{"):
        value, end = _parse(text, at)
        return R.Literal(write(value), LIST if isinstance(value, list) else MAP), end
    if m := _SHORT.match(text, at):
        for i, dt in enumerate(("double", "decimal", "integer", "boolean"), 1):
            if m[i]:
                return R.Literal(m[i], XSD + dt), m.end()
        return None, m.end()
    if m := _QUOTED.match(text, at):
        value = R.unescape(m[1] if m[1] is not None else m[2])
        return (R.Literal(value, R.LANG_STRING, R.language(m[4])) if m[4] else R.Literal(value, m[3] or R.STRING)), m.end()
    if m := _BLANK.match(text, at):  # a label ends before the comma or bracket that follows
        return R.Blank(m[1]), m.end()
    try:
        return R.parse_nt(text, at)
    except ValueError as e:
        raise CdtError(str(e)) from None


def _parse(text: str, at: int) -> tuple[list | dict, int]:
    at = _space(text, at)
    opening = text[at : at + 1]
    if opening not in ("[", "{"):
        raise CdtError(f"no list or map: {text[:40]!r}")
    closing, at = ("]" if opening == "[" else "}"), at + 1
    out: list | dict = [] if opening == "[" else {}
    at = _space(text, at)
    if text[at : at + 1] == closing:
        return out, at + 1
    while True:
        item, at = _item(text, at)
        if isinstance(out, dict):
            at = _space(text, at)
            if text[at : at + 1] != ":" or not isinstance(item, (R.Iri, R.Literal)):
                raise CdtError("a map entry needs an IRI or literal key and a colon")
            out[item], at = _item(text, at + 1)
        else:
            out.append(item)
        at = _space(text, at)
        if text[at : at + 1] == closing:
            return out, at + 1
        if text[at : at + 1] != ",":
            raise CdtError(f"expected a comma at {text[at : at + 20]!r}")
        at += 1


def parse(text: str) -> list | dict:
    """The value of a lexical form."""
    value, at = _parse(text, 0)
    if _space(text, at) != len(text):
        raise CdtError("text after the list or map")
    return value


def write(value: list | dict) -> str:
    """The canonical lexical form."""
    if isinstance(value, dict):
        return "{" + ", ".join(f"{_write(k)}: {_write(v)}" for k, v in value.items()) + "}"
    return "[" + ", ".join(map(_write, value)) + "]"


def _write(t: object) -> str:
    if t is None:
        return "null"
    if isinstance(t, R.Literal):
        if t.datatype in (LIST, MAP):
            return t.value
        if t.datatype in (XSD + "integer", XSD + "decimal", XSD + "double", XSD + "boolean"):
            m = _SHORT.fullmatch(t.value)
            if m and m[("double", "decimal", "integer", "boolean").index(t.datatype[len(XSD) :]) + 1]:
                return t.value
    return R.nt(t)


def of(t: object) -> list | dict:
    """The value of a list or map literal."""
    if isinstance(t, R.Literal) and t.datatype in (LIST, MAP):
        value = parse(t.value)
        if isinstance(value, list) == (t.datatype == LIST):
            return value
    raise CdtError("not a list or map")


def literal(value: object) -> R.Term:
    if isinstance(value, (list, dict)):
        return R.Literal(write(value), LIST if isinstance(value, list) else MAP)
    if isinstance(value, bool):
        return R.Literal("true" if value else "false", XSD + "boolean")
    return R.Literal(str(value), XSD + "integer") if isinstance(value, int) else value


def relabel(text: str, scope: str) -> str:
    """A list or map literal whose blank node labels are prefixed by a scope; an ill-formed one is left as it is."""

    def moved(t: object) -> object:
        if isinstance(t, R.Blank):
            return R.Blank(scope + t.value)
        return R.Literal(relabel(t.value, scope), t.datatype) if isinstance(t, R.Literal) and t.datatype in (LIST, MAP) else t

    try:
        value = parse(text)
    except (CdtError, ValueError):
        return text
    return write([moved(x) for x in value] if isinstance(value, list) else {k: moved(v) for k, v in value.items()})


@cache
def relabel_udf():
    @F.pandas_udf("string")
    def run(texts: pd.Series, scopes: pd.Series) -> pd.Series:
        return pd.Series([x if x is None else relabel(x, s) for x, s in zip(texts, scopes, strict=True)], dtype=object)

    return run


def relabelled(t: Column, scope: Column) -> Column:
    """A TERM whose blank nodes inside a list or map literal get the scope; only literals with some go through Python."""
    some = t["dt"].isin(LIST, MAP) & F.contains(t["v"], F.lit("_:"))
    text = F.coalesce(relabel_udf()(F.when(some, t["v"]), scope), t["v"])
    return F.when(some, R.struct(R.LITERAL, text, t["dt"])).otherwise(t)


def equal(a: object, b: object) -> bool | None:
    """``=`` of items: None is an error (two different blank nodes, literals of unknown datatypes)."""
    if a is None or b is None:
        return a is b
    if isinstance(a, R.Blank) and isinstance(b, R.Blank):
        return True if a == b else None
    lists = [isinstance(x, R.Literal) and x.datatype in (LIST, MAP) for x in (a, b)]
    if all(lists):
        x, y = of(a), of(b)
        if type(x) is not type(y) or len(x) != len(y):
            return False
        if isinstance(x, dict):
            pairs = []
            for k, v in x.items():
                match_ = [u for j, u in y.items() if star.value(j) == star.value(k)]
                if not match_:
                    return False
                pairs.append((v, match_[0]))
        else:
            pairs = list(zip(x, y, strict=True))
        found = [equal(v, u) for v, u in pairs]
        return False if False in found else None if None in found else True
    if star.value(a) == star.value(b):
        return True
    unknown = lambda t: isinstance(t, R.Literal) and t.datatype not in (*R.NUMERIC, R.STRING, R.LANG_STRING, XSD + "boolean", XSD + "dateTime", LIST, MAP)
    return None if unknown(a) or unknown(b) and isinstance(a, R.Literal) and isinstance(b, R.Literal) else False


def _key_order(k: object) -> tuple:
    return (0 if isinstance(k, R.Iri) else 1, star.order(k))


def compare(a: object, b: object) -> int | None:
    """-1, 0 or 1 by ``<``; None where there is no order. Null comes first."""
    if a is None or b is None:
        return (a is not None) - (b is not None)
    if isinstance(a, R.Literal) and isinstance(b, R.Literal) and {a.datatype, b.datatype} <= {LIST, MAP}:
        x, y = of(a), of(b)
        if type(x) is not type(y):
            return None
        if isinstance(x, dict):
            x, y = ([z for k in sorted(m, key=_key_order) for z in (k, m[k])] for m in (x, y))
        for v, u in zip(x, y, strict=False):
            if isinstance(v, R.Iri) and isinstance(u, R.Iri):
                c: int | None = (v.value > u.value) - (v.value < u.value)
            else:
                c = compare(v, u)
            if c != 0:
                return c
        return (len(x) > len(y)) - (len(x) < len(y))
    if equal(a, b):
        return 0
    if isinstance(a, R.Literal) and isinstance(b, R.Literal):
        x, y = star.order(a), star.order(b)
        if x[1] == y[1] and (x[1] == 1 or a.datatype == b.datatype):
            return -1 if x < y else 1
    return None


def _whole(t: object) -> int:
    if not (isinstance(t, R.Literal) and t.datatype in R.INTEGERS):
        raise CdtError("an integer is needed")
    return int(t.value)


def _list(t: object) -> list:
    value = of(t)
    if not isinstance(value, list):
        raise CdtError("a list is needed")
    return value


def _map(t: object) -> dict:
    value = of(t)
    if not isinstance(value, dict):
        raise CdtError("a map is needed")
    return value


def _key(t: object) -> object:
    if not isinstance(t, (R.Iri, R.Literal)):
        raise CdtError("a key must be an IRI or a literal")
    return t


def get(ct: object, key: object) -> object:
    value = of(ct)
    if isinstance(value, dict):
        return value.get(_key(key))
    i = _whole(key)
    if i < 1:
        raise CdtError("list positions start at 1")
    return value[i - 1] if i <= len(value) else None


def subseq(ct: object, start: object, length: object = None) -> list:
    value, i = _list(ct), _whole(start)
    n = len(value) - i + 1 if length is None else _whole(length)
    if i < 1 or n < 0 or i + n > len(value) + 1:
        raise CdtError("out of range")
    return value[i - 1 : i - 1 + n]


def _first(value: list) -> object:
    if not value:
        raise CdtError("the list is empty")
    return value[0]


def _tail(value: list) -> list:
    if not value:
        raise CdtError("the list is empty")
    return value[1:]


def _text(t: object) -> str:
    if not isinstance(t, R.Literal):
        raise CdtError("a literal is needed")
    return t.value


def split(text: object, by: object) -> list:
    parts = _text(text).split(_text(by)) if _text(by) else list(_text(text))
    while parts and not parts[-1]:
        parts.pop()
    return [R.Literal(p) for p in parts]


def make_map(*args: object) -> dict:
    pairs = zip(args[::2], args[1::2], strict=True) if len(args) % 2 == 0 else ()
    if len(args) % 2:
        raise CdtError("a map needs pairs")
    return {k: v for k, v in pairs if isinstance(k, (R.Iri, R.Literal))}


def _zip(a: object, b: object) -> list:
    x, y = _list(a), _list(b)
    if len(x) != len(y):
        raise CdtError("lists of different lengths")
    return [literal([v, u]) for v, u in zip(x, y, strict=True)]


def _sequence(*args: object) -> list:
    start, end = (1, _whole(args[0])) if len(args) == 1 else (_whole(args[0]), _whole(args[1]))
    return [literal(i) for i in range(start, end + 1)]


#: Functions by local name: what they do with terms, and whether they take nulls (errors) as arguments.
FUNCTIONS: dict[str, tuple[Callable, bool]] = {
    "List": (lambda *a: list(a), True),
    "listCreate": (lambda *a: list(a), True),
    "get": (get, False),
    "listGet": (lambda a, i: get(literal(_list(a)), i), False),
    "subseq": (subseq, False),
    "size": (lambda a: len(of(a)), False),
    "listSize": (lambda a: len(_list(a)), False),
    "mapSize": (lambda a: len(_map(a)), False),
    "reverse": (lambda a: _list(a)[::-1], False),
    "head": (lambda a: _first(_list(a)), False),
    "tail": (lambda a: _tail(_list(a)), False),
    "contains": (lambda a, t: any(x is not None and equal(x, t) is True for x in _list(a)), False),
    "containsTerm": (lambda a, t: t in _list(a), False),
    "concat": (lambda *a: [x for y in a for x in _list(y)], False),
    "sequence": (_sequence, False),
    "zip": (_zip, False),
    "split": (split, False),
    "Map": (make_map, True),
    "mapCreate": (make_map, True),
    "put": (lambda m, k, v=None: {**_map(m), _key(k): v}, True),
    "remove": (lambda m, k: {j: v for j, v in _map(m).items() if j != _key(k)}, False),
    "keys": (lambda m: list(_map(m)), False),
    "containsKey": (lambda m, k: _key(k) in _map(m), False),
    "mapGet": (lambda m, k: _map(m).get(_key(k)), False),
    "merge": (lambda a, b: {**_map(b), **_map(a)}, False),
}


_INT, _NUMBER = r"-?(?:0|[1-9]\d*)", r"-?\d+(?:\.\d+)?(?:E-?\d+)?"


def _list_of(item: str, t: Column) -> Column:
    """Whether a TERM is a list literal in canonical form whose items all match a pattern."""
    return F.coalesce((t["dt"] == LIST) & t["v"].rlike(rf"^\[(?:{item}(?:, {item})*)?\]$"), F.lit(False))


def _items(t: Column) -> Column:
    """The items' texts of such a list as a native array."""
    return F.when(t["v"] == "[]", F.array().cast("array<string>")).otherwise(F.split(F.substring(t["v"], F.lit(2), F.length(t["v"]) - 2), ", "))


def _integer(t: Column) -> Column:
    return F.coalesce((t["dt"] == XSD + "integer") & t["v"].rlike(f"^{_INT}$") & (F.length(t["v"]) < 10), F.lit(False))


def _number(text: Column) -> Column:
    dt = F.when(F.contains(text, F.lit("E")), XSD + "double").when(F.contains(text, F.lit(".")), XSD + "decimal").otherwise(XSD + "integer")
    return F.when(text.isNotNull(), R.struct(R.LITERAL, text, dt))


def _as_list(items: Column) -> Column:
    return R.struct(R.LITERAL, F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")), F.lit(LIST))


def _native(name: str, args: list[Column]) -> tuple[Column, Column] | None:
    """Where a function needs no Python (its lists hold numbers), and what it gives there; NULL is an error."""
    numbers = lambda *ts: reduce(lambda a, b: a & b, [_list_of(_NUMBER, t) for t in ts])
    whole = lambda t: t["v"].cast("int")
    truth = lambda c: R.struct(R.LITERAL, c.cast("string"), F.lit(XSD + "boolean"))
    match name, args:
        case "size" | "listSize", [a]:
            return numbers(a), _number(F.size(_items(a)).cast("string"))
        case "get" | "listGet", [a, i]:
            return numbers(a) & _integer(i), F.when(whole(i) >= 1, _number(F.get(_items(a), whole(i) - 1)))
        case "head", [a]:
            return numbers(a), _number(F.get(_items(a), F.lit(0)))
        case "tail", [a]:
            return numbers(a), F.when(F.size(_items(a)) > 0, _as_list(F.slice(_items(a), F.lit(2), F.greatest(F.size(_items(a)) - 1, F.lit(0)))))
        case "reverse", [a]:
            return numbers(a), _as_list(F.reverse(_items(a)))
        case "concat", [_, *_]:
            return numbers(*args), _as_list(F.concat(*map(_items, args)))
        case "subseq", [a, i, *n]:
            size = F.size(_items(a))
            count = whole(n[0]) if n else size - whole(i) + 1
            fits = (whole(i) >= 1) & (count >= 0) & (whole(i) + count <= size + 1)
            return numbers(a) & _integer(i) & (_integer(n[0]) if n else F.lit(True)), F.when(fits, _as_list(F.slice(_items(a), F.greatest(whole(i), F.lit(1)), F.greatest(count, F.lit(0)))))
        case "contains" | "containsTerm", [a, t]:
            return _list_of(_INT, a) & _integer(t), truth(F.array_contains(_items(a), t["v"]))
        case "sequence", ([_] | [_, _]) as ends:
            start, end = (F.lit(1), whole(ends[0])) if len(ends) == 1 else (whole(ends[0]), whole(ends[1]))
            items = F.when(end < start, F.array().cast("array<string>")).otherwise(F.sequence(start, F.greatest(start, end)).cast("array<string>"))
            return reduce(lambda a, b: a & b, map(_integer, ends)), _as_list(items)
    return None


def call(name: str, args: list[Column]) -> Column:
    """A function of TERM columns as a TERM column; an error gives NULL. Lists of numbers stay native, other rows go through Arrow.

    Arguments are named once, by one-element arrays, so that nested calls don't multiply their expressions.
    """
    packed = F.struct(*[a.alias(f"a{i}") for i, a in enumerate(args)] or [F.lit(0).alias("none")])

    def native(s: Column) -> Column:
        fits, value = _native(name, [s[f"a{i}"] for i in range(len(args))])
        return F.when(fits, value)

    if _native(name, [F.col("x")] * len(args)) is None:
        found, rest = None, packed
    else:
        found = F.get(F.transform(F.array(packed), native), F.lit(0))
        rest = F.when(found.isNull(), packed)
    parsed = F.get(F.filter(F.array(_udf(name, len(args))(F.to_json(rest))), lambda x: x["k"].isNotNull()), F.lit(0))
    return parsed if found is None else F.coalesce(found, parsed)


def _term(d: dict | None) -> R.Term | None:
    return None if d is None or d.get("k") is None else R.from_row({k: d.get(k) for k in ("k", "v", "dt", "lang")})


@cache
def _udf(name: str, n: int):
    f, nulls = FUNCTIONS[name]

    @F.pandas_udf(R.TERM)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            given = json.loads(text) if isinstance(text, str) else None
            args = [_term(given.get(f"a{i}")) for i in range(n)] if given is not None else None
            try:
                got = None if args is None or (not nulls and any(a is None for a in args)) else f(*args)
                rows.append(R.row(literal(got)) if got is not None else (None,) * 4)
            except (CdtError, TypeError, ValueError):
                rows.append((None,) * 4)
        return pd.DataFrame(rows, columns=["k", "v", "dt", "lang"])

    return run


@cache
def equal_udf():
    @F.pandas_udf("boolean")
    def eq(a: pd.Series, da: pd.Series, b: pd.Series, db: pd.Series) -> pd.Series:
        return pd.Series([_safe(equal, x, dx, y, dy) for x, dx, y, dy in zip(a, da, b, db, strict=True)], dtype=object)

    return eq


def _safe(f: Callable, x: str, dx: str, y: str, dy: str) -> object:
    if not {dx, dy} <= {LIST, MAP}:
        return None
    try:
        return f(R.Literal(x, dx), R.Literal(y, dy))
    except CdtError:
        return None


@cache
def less_udf(or_equal: bool):
    @F.pandas_udf("boolean")
    def lt(a: pd.Series, da: pd.Series, b: pd.Series, db: pd.Series) -> pd.Series:
        found = [_safe(compare, x, dx, y, dy) for x, dx, y, dy in zip(a, da, b, db, strict=True)]
        return pd.Series([None if c is None else c <= 0 if or_equal else c < 0 for c in found], dtype=object)

    return lt


ENTRY = "array<struct<pos:int,key:" + R.TERM + ",value:" + R.TERM + ">>"


@cache
def entries_udf():
    """The entries of a list or map literal, in order; NULL for anything else."""

    @F.pandas_udf("string")
    def run(v: pd.Series, dt: pd.Series) -> pd.Series:
        out = []
        field = lambda t: None if t is None else dict(zip(("k", "v", "dt", "lang"), R.row(t), strict=True))
        for x, d in zip(v, dt, strict=True):
            try:
                value = of(R.Literal(x, d)) if d in (LIST, MAP) else None
            except CdtError:
                value = None
            if value is None:
                out.append(None)
            elif isinstance(value, list):
                out.append(json.dumps([{"pos": i + 1, "key": field(literal(i + 1)), "value": field(t)} for i, t in enumerate(value)]))
            else:
                out.append(json.dumps([{"pos": i + 1, "key": field(k), "value": field(t)} for i, (k, t) in enumerate(value.items())]))
        return pd.Series(out, dtype=object)

    return run


@cache
def collect_udf(kind: str):
    """A list (or map) literal from a JSON array of TERMs (or of pairs)."""

    @F.pandas_udf("string")
    def run(items: pd.Series) -> pd.Series:
        out = []
        for text in items:
            found = json.loads(text)
            term = lambda d: None if d is None else R.from_row({k: d.get(k) for k in ("k", "v", "dt", "lang")})
            if kind == "list":
                out.append(write([term(x.get("a")) for x in found]))
            else:
                out.append(write({term(x.get("a")): term(x.get("b")) for x in found if x.get("a") and x["a"]["k"] in (R.IRI_, R.LITERAL)}))
        return pd.Series(out, dtype=object)

    return run
