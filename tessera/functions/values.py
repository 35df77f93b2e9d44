"""Typed columns: what an expression compiles to, and comparison, ordering and truth over them.

A value is native (a Spark column of one XSD type, or an IRI as text) wherever types are known
at compile time, so filters on mapped tables reach the Parquet scan; otherwise it is a TERM
struct and dispatches on its datatype at run time. An error is NULL, which makes SQL's
three-valued AND, OR and NOT those of SPARQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import terms as R
from tessera.terms import CDT, INTEGERS, NUMERIC, STRING, XSD

INT, DEC, FLT, DBL, BOOL, STR, TIME, IRI, TERM = "int dec flt dbl bool str time iri term".split()
#: Kinds and the datatype they stand for.
DATATYPE = {INT: XSD + "integer", DEC: XSD + "decimal", FLT: XSD + "float", DBL: XSD + "double", BOOL: XSD + "boolean", STR: STRING, TIME: XSD + "dateTime"}
SPARK = {INT: "bigint", DEC: "decimal(38,18)", FLT: "float", DBL: "double", BOOL: "boolean", STR: "string", TIME: "timestamp_ntz"}
NUMBERS = (INT, DEC, FLT, DBL)


@dataclass(frozen=True)
class Val:
    """A column of a kind. ``raw`` is (prefix, key column) of an IRI built from a template."""

    kind: str
    col: Column
    raw: tuple[str, Column] | None = None
    constant: object = None


def kind_of(spark_type: T.DataType) -> str:
    if isinstance(spark_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    return {T.DoubleType: DBL, T.FloatType: FLT, T.DecimalType: DEC, T.BooleanType: BOOL, T.StringType: STR, T.TimestampNTZType: TIME, T.TimestampType: TIME}[type(spark_type)]


def text_of_number(col: Column, kind: str) -> Column:
    """The lexical form of a native number: decimals with one fractional digit at least, doubles with an exponent."""
    text = col.cast("string")
    if kind == DEC:
        trimmed = F.regexp_replace(F.format_string("%s", text), r"(\.\d*?)0+$", "$1")
        trimmed = F.when(text.contains("."), trimmed).otherwise(F.concat(text, F.lit(".0")))
        return F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)
    if kind in (FLT, DBL):
        special = F.when(F.isnan(col), "NaN").when(col == float("inf"), "INF").when(col == float("-inf"), "-INF")
        return F.coalesce(special, F.when(text.contains("E"), text).otherwise(F.concat(text, F.lit("E0"))))
    return text


def lexical(v: Val) -> Column:
    """The string STR() gives."""
    if v.kind == TERM:
        return F.when(v.col["k"].isin(R.IRI_, R.LITERAL), v.col["v"])
    if v.kind in NUMBERS:
        return text_of_number(v.col, v.kind)
    if v.kind == TIME:
        return F.concat(F.regexp_replace(F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit("Z"))
    return v.col.cast("string")


def lift(v: Val) -> Column:
    """Any value as a TERM."""
    if v.kind == TERM:
        return v.col
    if v.kind == IRI:
        return R.struct(R.IRI_, v.col)
    return R.struct(R.LITERAL, lexical(v), F.lit(DATATYPE[v.kind]))


def number(v: Val) -> Column:
    """The numeric value as double; NULL for anything else."""
    if v.kind in NUMBERS:
        return v.col.cast("double")
    if v.kind != TERM:
        return F.lit(None).cast("double")
    text = F.when(v.col["v"] == "INF", "Infinity").when(v.col["v"] == "-INF", "-Infinity").otherwise(v.col["v"])
    return F.when((v.col["k"] == R.LITERAL) & v.col["dt"].isin(NUMERIC), F.expr("1") * text.try_cast("double"))


def exact(v: Val) -> Column:
    """The value of an integer or decimal as decimal(38,18)."""
    if v.kind in (INT, DEC):
        return v.col.cast(SPARK[DEC])
    if v.kind != TERM:
        return F.lit(None).cast(SPARK[DEC])
    return F.when((v.col["k"] == R.LITERAL) & v.col["dt"].isin([*INTEGERS, XSD + "decimal"]), v.col["v"].try_cast(SPARK[DEC]))


def rank(v: Val) -> Column:
    """1 integer, 2 decimal, 3 float, 4 double; NULL for no number."""
    if v.kind in NUMBERS:
        return F.lit(NUMBERS.index(v.kind) + 1)
    if v.kind != TERM:
        return F.lit(None).cast("int")
    dt = v.col["dt"]
    found = F.when(dt.isin(INTEGERS), 1).when(dt == XSD + "decimal", 2).when(dt == XSD + "float", 3).when(dt == XSD + "double", 4)
    return F.when(number(v).isNotNull(), found)


def instant(v: Val) -> Column:
    """A dateTime as a UTC timestamp; NULL for anything else. A missing zone counts as UTC."""
    if v.kind == TIME:
        return v.col
    if v.kind != TERM:
        return F.lit(None).cast("timestamp_ntz")
    text = F.when((v.col["k"] == R.LITERAL) & (v.col["dt"] == XSD + "dateTime"), v.col["v"])
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.to_timestamp_ntz(F.date_format(zoned.try_cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))


def boolean(v: Val) -> Column:
    """The value of a boolean literal; NULL for anything else."""
    if v.kind == BOOL:
        return v.col
    if v.kind != TERM:
        return F.lit(None).cast("boolean")
    return F.when(v.col["dt"] == XSD + "boolean", F.when(v.col["v"].isin("true", "1"), True).when(v.col["v"].isin("false", "0"), False))


def plain(v: Val) -> Column:
    """The text of an xsd:string or language-tagged literal; NULL for anything else."""
    if v.kind == STR:
        return v.col
    if v.kind != TERM:
        return F.lit(None).cast("string")
    return F.when((v.col["k"] == R.LITERAL) & v.col["dt"].isin(STRING, R.LANG_STRING), v.col["v"])


def simple(v: Val) -> Column:
    """The text of an xsd:string literal; NULL for anything else."""
    if v.kind == STR:
        return v.col
    if v.kind != TERM:
        return F.lit(None).cast("string")
    return F.when((v.col["k"] == R.LITERAL) & (v.col["dt"] == STRING), v.col["v"])


def truth(v: Val) -> Column:
    """The effective boolean value; NULL (an error) for IRIs, blank nodes and other datatypes."""
    if v.kind == BOOL:
        return v.col
    if v.kind in NUMBERS:
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if v.kind == STR:
        return F.length(v.col) > 0
    if v.kind != TERM:
        return F.lit(None).cast("boolean")
    dt, n = v.col["dt"], number(v)
    literal = F.when(dt == XSD + "boolean", F.coalesce(boolean(v), F.lit(False))).when(dt.isin(NUMERIC), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False))).when(dt.isin(STRING, R.LANG_STRING), F.length(v.col["v"]) > 0)
    return F.when(v.col["k"] == R.LITERAL, literal)


#: Datatypes whose values are compared; two unequal literals of another one are an error.
KNOWN = [*NUMERIC, STRING, R.LANG_STRING, XSD + "boolean", XSD + "dateTime"]
_TRIPLE_EQUAL = None


def equal(a: Val, b: Val, star: bool = False) -> Column:
    """SPARQL ``=``."""
    if a.kind in NUMBERS and b.kind in NUMBERS:
        return a.col == b.col
    if a.kind == b.kind and a.kind in (BOOL, STR, TIME):
        return a.col == b.col
    if a.kind == IRI and b.kind == IRI:
        for x, y in ((a, b), (b, a)):
            if x.raw and y.raw and x.raw[0] == y.raw[0]:
                return x.raw[1] == y.raw[1]
            if x.raw and y.constant is not None:
                prefix, key = x.raw
                rest = y.constant.value.removeprefix(prefix)
                return key.cast("string") == rest if not rest.isdigit() or len(rest) > 18 else key == F.lit(int(rest)) if y.constant.value.startswith(prefix) else F.lit(False) & key.isNotNull()
        return a.col == b.col
    if TERM not in (a.kind, b.kind):
        both = a.col.isNotNull() & b.col.isNotNull()
        return F.when(both, F.lit(False))
    if {a.kind, b.kind} & set(NUMBERS) and (a.kind != TERM or b.kind != TERM):
        other = a if a.kind == TERM else b
        return F.when(number(other).isNotNull(), number(a) == number(b)).when(_opaque(other), F.lit(None)).when(other.col.isNotNull(), F.lit(False))
    x, y = lift(a), lift(b)
    identical = (x["k"] == y["k"]) & (x["v"] == y["v"]) & x["dt"].eqNullSafe(y["dt"]) & x["lang"].eqNullSafe(y["lang"])
    l_, r = Val(TERM, x), Val(TERM, y)
    out = F.when(x.isNull() | y.isNull(), F.lit(None).cast("boolean"))
    out = out.when(number(l_).isNotNull() & number(r).isNotNull(), number(l_) == number(r))
    out = out.when(instant(l_).isNotNull() & instant(r).isNotNull(), instant(l_) == instant(r))
    out = out.when(boolean(l_).isNotNull() & boolean(r).isNotNull(), boolean(l_) == boolean(r))
    if star:
        out = out.when((x["k"] == R.TRIPLE) & (y["k"] == R.TRIPLE), _triples()(x["v"], y["v"]))
    out = out.when(_is_cdt(x) & _is_cdt(y), _cdt_equal()(x["v"], x["dt"], y["v"], y["dt"]))
    out = out.when(identical, F.lit(True))
    out = out.when((x["k"] == R.LITERAL) & (y["k"] == R.LITERAL) & (_opaque(l_) | _opaque(r)), F.lit(None).cast("boolean"))
    return out.otherwise(F.lit(False))


def _opaque(v: Val) -> Column:
    return (v.col["k"] == R.LITERAL) & ~v.col["dt"].isin(KNOWN)


def _is_cdt(t: Column) -> Column:
    return t["dt"].isin(CDT + "List", CDT + "Map")


def _triples():
    from tessera.functions import star

    return star.equal_udf()


def _cdt_equal():
    from tessera.functions import cdt

    return cdt.equal_udf()


def same(a: Val, b: Val) -> Column:
    """sameTerm()."""
    if a.kind == b.kind != TERM:
        return a.col == b.col
    if TERM not in (a.kind, b.kind):
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    return lift(a) == lift(b)


def less(a: Val, b: Val, or_equal: bool = False, star: bool = False) -> Column:
    """SPARQL ``<`` (``<=``); NULL for what has no order."""
    op = (lambda x, y: x <= y) if or_equal else (lambda x, y: x < y)
    if a.kind in NUMBERS and b.kind in NUMBERS or a.kind == b.kind and a.kind in (BOOL, STR, TIME):
        return op(a.col, b.col)
    if TERM not in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    out = F.when(number(a).isNotNull() & number(b).isNotNull(), op(number(a), number(b)))
    if {a.kind, b.kind} & set(NUMBERS):
        return out
    out = out.when(instant(a).isNotNull() & instant(b).isNotNull(), op(instant(a), instant(b)))
    if TIME in (a.kind, b.kind):
        return F.when(instant(a).isNotNull() & instant(b).isNotNull(), op(instant(a), instant(b)))
    out = out.when(simple(a).isNotNull() & simple(b).isNotNull(), op(simple(a), simple(b)))
    out = out.when(boolean(a).isNotNull() & boolean(b).isNotNull(), op(boolean(a), boolean(b)))
    if a.kind == b.kind == TERM:
        out = out.when((a.col["lang"] == b.col["lang"]), op(a.col["v"], b.col["v"]))
        if star:
            from tessera.functions.star import less_udf

            triple = (a.col["k"] == R.TRIPLE) & (b.col["k"] == R.TRIPLE)
            out = out.when(triple, less_udf(or_equal)(a.col["v"], b.col["v"]))
        from tessera.functions import cdt

        out = out.when(_is_cdt(a.col) & _is_cdt(b.col), cdt.less_udf(or_equal)(a.col["v"], a.col["dt"], b.col["v"], b.col["dt"]))
    return out


def sort_keys(v: Val, star: bool = False) -> list[Column]:
    """Columns whose order is that of ORDER BY: unbound, blank, IRI, literal, quoted triple; numbers by value."""
    if v.kind != TERM:
        return [v.col]
    t = v.col
    keys = [t["k"], number(v), instant(v)]
    text = t["v"]
    if star:
        from tessera.functions.star import sort_udf

        text = F.when(t["k"] == R.TRIPLE, sort_udf()(t["v"])).otherwise(text)
    return [*keys, text, t["lang"], t["dt"]]


def from_term(t: R.Term) -> Val:
    """A constant; native where its datatype has a native kind and its form is canonical enough."""
    if isinstance(t, R.Iri):
        return Val(IRI, F.lit(t.value), constant=t)
    if isinstance(t, R.Literal):
        try:
            if t.datatype == STRING:
                return Val(STR, F.lit(t.value), constant=t)
            if t.datatype == XSD + "integer" and abs(int(t.value)) < 1 << 62:
                return Val(INT, F.lit(int(t.value)), constant=t)
            if t.datatype == XSD + "decimal":
                return Val(DEC, F.lit(t.value).cast(SPARK[DEC]), constant=t)
            if t.datatype == XSD + "double":
                return Val(DBL, F.lit(float(t.value.replace("INF", "inf"))), constant=t)
            if t.datatype == XSD + "boolean" and t.value in ("true", "false"):
                return Val(BOOL, F.lit(t.value == "true"), constant=t)
            if t.datatype == XSD + "dateTime":
                return Val(TIME, F.lit(_utc(t.value)).cast("timestamp_ntz"), constant=t)
        except ValueError:
            pass
    return Val(TERM, R.const(t), constant=t)


def _utc(text: str) -> str:
    from datetime import UTC, datetime

    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return (at.astimezone(UTC) if at.tzinfo else at).replace(tzinfo=None).isoformat(sep=" ")


def constant_term(v: Val) -> Column:
    """A value as a TERM that keeps a constant's own lexical form."""
    return R.const(v.constant) if v.constant is not None else lift(v)
