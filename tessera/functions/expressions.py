"""Expressions to columns: operators, built-in functions, casts and extension functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import terms as R
from tessera.functions import cdt, star
from tessera.functions.registry import Registry
from tessera.functions.values import (
    BOOL,
    DBL,
    DEC,
    FLT,
    INT,
    IRI,
    NUMBERS,
    SPARK,
    STR,
    TERM,
    TIME,
    Val,
    constant_term,
    equal,
    from_term,
    instant,
    less,
    lexical,
    lift,
    number,
    plain,
    rank,
    same,
    simple,
    text_of_number,
    truth,
)
from tessera.functions.values import exact as _exact
from tessera.plans import algebra as A
from tessera.plans.parser import resolve
from tessera.terms import CDT, INTEGERS, NUMERIC, STRING, XSD


class UnsupportedError(ValueError):
    """A construct that has no evaluation."""


class Expressions:
    """Compiles expressions over ``scope`` (variable name to Val).

    ``exists`` maps Exists nodes to boolean columns computed before; ``star`` says whether quoted triples
    can occur; ``now`` is the query's one timestamp; ``row_id`` a column that tells solutions apart.
    """

    def __init__(self, scope: dict[str, Val], registry: Registry, base: str = "", star_: bool = False, exists: dict | None = None, row_id: Column | None = None):
        self.scope, self.registry, self.base, self.star = scope, registry, base, star_
        self.exists, self.row_id = exists or {}, row_id

    def truth(self, e: A.Node) -> Column:
        return truth(self.value(e))

    def value(self, e: A.Node) -> Val:
        match e:
            case A.Const(t):
                return from_term(t)
            case A.Ref(name):
                return self.scope.get(name) or Val(TERM, F.lit(None).cast(R.TERM))
            case A.Exists():
                return Val(BOOL, self.exists[e])
            case A.Quoted(s, p, o):
                return Val(TERM, self.quoted(*(constant_term(self.value(x)) for x in (s, p, o))))
            case A.Call(op, args, True):
                return self.extension(op, [self.value(a) for a in args])
            case A.Call(op, args):
                return self.call(op, args)
        raise UnsupportedError(f"no value for {e}")

    def quoted(self, s: Column, p: Column, o: Column) -> Column:
        text = F.concat(F.lit("<< "), R.nt_column(s), F.lit(" "), R.nt_column(p), F.lit(" "), R.nt_column(o), F.lit(" >>"))
        return R.struct(R.TRIPLE, F.when(s["k"].isin(R.BLANK, R.IRI_, R.TRIPLE) & (p["k"] == R.IRI_), text))

    def extension(self, iri: str, args: list[Val]) -> Val:
        terms = [constant_term(a) for a in args]
        if iri in self.registry.functions:
            bound = reduce(lambda x, y: x & y, [t.isNotNull() for t in terms], F.lit(True))
            return Val(TERM, F.when(bound, self.registry.functions[iri](*terms)))
        if iri in self.registry.forms:
            return Val(TERM, self.registry.forms[iri](*terms))
        if iri.startswith(XSD) and len(args) == 1:
            return self.cast(iri[len(XSD) :], args[0])
        if iri.startswith(CDT) and iri[len(CDT) :] in cdt.FUNCTIONS:
            return Val(TERM, cdt.call(iri[len(CDT) :], terms))
        raise UnsupportedError(f"unknown function <{iri}>")

    # operators and functions

    def call(self, op: str, args: tuple) -> Val:
        if op == "!":
            return Val(BOOL, ~self.truth(args[0]))
        if op == "&&":
            return Val(BOOL, self.truth(args[0]) & self.truth(args[1]))
        if op == "||":
            return Val(BOOL, self.truth(args[0]) | self.truth(args[1]))
        if op == "BOUND":
            return Val(BOOL, self.value(args[0]).col.isNotNull())
        v = [self.value(a) for a in args]
        if op == "=":
            return Val(BOOL, self.equal(*v))
        if op == "!=":
            return Val(BOOL, ~self.equal(*v))
        if op in ("<", "<="):
            return Val(BOOL, self.less(v[0], v[1], op == "<="))
        if op in (">", ">="):
            return Val(BOOL, self.less(v[1], v[0], op == ">="))
        if op == "IN":
            return Val(BOOL, self.within(v[0], v[1:]))
        if op in ("+", "-", "*", "/"):
            return arithmetic(op, *v)
        if op == "NEG":
            return arithmetic("-", Val(INT, F.lit(0)), v[0]) if v[0].kind not in (FLT, DBL) else Val(v[0].kind, -v[0].col)
        if op == "POS":
            return v[0] if v[0].kind in NUMBERS else Val(TERM, F.when(number(v[0]).isNotNull(), lift(v[0])))
        if op == "IF":
            a, b = alike(v[1], v[2])
            return Val(a.kind, F.when(truth(v[0]), a.col).when(~truth(v[0]), b.col))
        if op == "COALESCE":
            if not v:
                return Val(TERM, F.lit(None).cast(R.TERM))
            both = v if len({x.kind for x in v}) == 1 else [Val(TERM, constant_term(x)) for x in v]
            return Val(both[0].kind, F.coalesce(*[x.col for x in both]))
        return getattr(self, f"f_{op.lower()}")(*v)

    def registered(self, a: Val, b: Val, compare: Callable[[Column, Column], Column], other: Column) -> Column:
        """A comparison by a registered datatype where both operands have it."""
        if TERM not in (a.kind, b.kind) or not self.registry.datatypes:
            return other
        x, y = constant_term(a), constant_term(b)
        out = None
        for iri, value in self.registry.datatypes.items():
            both = (x["dt"] == iri) & (y["dt"] == iri)
            got = compare(value(x["v"]), value(y["v"]))
            out = F.when(both, got) if out is None else out.when(both, got)
        return out.otherwise(other)

    def equal(self, a: Val, b: Val) -> Column:
        return self.registered(a, b, lambda x, y: x == y, equal(a, b, self.star))

    def less(self, a: Val, b: Val, or_equal: bool) -> Column:
        return self.registered(a, b, (lambda x, y: x <= y) if or_equal else (lambda x, y: x < y), less(a, b, or_equal, self.star))

    def within(self, x: Val, options: list[Val]) -> Column:
        if not options:
            return F.lit(False)
        if x.kind in (INT, STR) and all(o.kind == x.kind and o.constant is not None for o in options):
            return x.col.isin([int(o.constant.value) if x.kind == INT else o.constant.value for o in options])
        return reduce(lambda a, b: a | b, [self.equal(x, o) for o in options])

    def f_str(self, x: Val) -> Val:
        return Val(STR, x.col if x.kind == STR else lexical(x))

    def f_lang(self, x: Val) -> Val:
        if x.kind != TERM:
            return Val(STR, F.when(x.col.isNotNull() & F.lit(x.kind != IRI), F.lit("")))
        return Val(STR, F.when(x.col["k"] == R.LITERAL, F.coalesce(x.col["lang"], F.lit(""))))

    def f_langmatches(self, tag: Val, range_: Val) -> Val:
        t, r = F.lower(simple(tag)), F.lower(simple(range_))
        return Val(BOOL, F.when(r == "*", t != "").otherwise((t == r) | F.startswith(t, F.concat(r, F.lit("-")))))

    def f_datatype(self, x: Val) -> Val:
        t = constant_term(x)
        return Val(IRI, F.when(t["k"] == R.LITERAL, t["dt"]))

    def f_iri(self, x: Val) -> Val:
        if x.kind == IRI:
            return x
        if isinstance(x.constant, R.Literal):
            return from_term(R.Iri(resolve(self.base, x.constant.value)))
        text = simple(x) if x.kind != TERM else F.coalesce(simple(x), F.when(x.col["k"] == R.IRI_, x.col["v"]))
        if self.base:
            base = self.base
            relative = F.udf(lambda t: None if t is None else resolve(base, t), "string")
            text = F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), text).otherwise(relative(text))
        return Val(IRI, text)

    def f_bnode(self, x: Val | None = None) -> Val:
        if x is None:
            return Val(TERM, R.struct(R.BLANK, F.concat(F.lit("b"), F.replace(F.uuid(), F.lit("-"), F.lit("")))))
        row = self.row_id.cast("string") if self.row_id is not None else F.lit("")
        return Val(TERM, R.struct(R.BLANK, F.concat(F.lit("b"), F.substring(F.sha2(F.concat_ws("|", row, simple(x)), 256), 1, 24))))

    def f_strdt(self, x: Val, dt: Val) -> Val:
        return Val(TERM, R.struct(R.LITERAL, F.when(_iri(dt).isNotNull(), simple(x)), _iri(dt)))

    def f_strlang(self, x: Val, lang: Val) -> Val:
        return Val(TERM, R.struct(R.LITERAL, F.when(simple(lang).isNotNull() & (simple(lang) != ""), simple(x)), F.lit(R.LANG_STRING), simple(lang)))

    def f_sameterm(self, x: Val, y: Val) -> Val:
        if x.constant is not None or y.constant is not None:
            return Val(BOOL, constant_term(x) == constant_term(y)) if x.kind == TERM or y.kind == TERM else Val(BOOL, same(x, y))
        return Val(BOOL, same(x, y))

    def _kind(self, x: Val, native: bool, *kinds: int) -> Val:
        return Val(BOOL, F.when(x.col.isNotNull(), F.lit(native) if x.kind != TERM else x.col["k"].isin(*kinds)))

    def f_isiri(self, x: Val) -> Val:
        return self._kind(x, x.kind == IRI, R.IRI_)

    def f_isblank(self, x: Val) -> Val:
        return self._kind(x, False, R.BLANK)

    def f_isliteral(self, x: Val) -> Val:
        return self._kind(x, x.kind != IRI, R.LITERAL)

    def f_istriple(self, x: Val) -> Val:
        return self._kind(x, False, R.TRIPLE)

    def f_isnumeric(self, x: Val) -> Val:
        return Val(BOOL, F.when(x.col.isNotNull(), F.lit(x.kind in NUMBERS) if x.kind != TERM else number(x).isNotNull()))

    # numbers

    def _same_type(self, x: Val, f: Callable[[Column], Column]) -> Val:
        if x.kind in NUMBERS:
            return Val(x.kind, f(x.col).cast(SPARK[x.kind]))
        out = F.when(rank(x) == 1, f(_exact(x)).cast("bigint").cast("string"))
        out = out.when(rank(x) == 2, text_of_number(f(_exact(x)).cast(SPARK[DEC]), DEC)).when(rank(x) > 2, text_of_number(f(number(x)).cast("double"), DBL))
        return Val(TERM, R.struct(R.LITERAL, out, F.when(rank(x) == 1, XSD + "integer").otherwise(lift(x)["dt"])))

    def f_abs(self, x: Val) -> Val:
        return self._same_type(x, F.abs)

    def f_round(self, x: Val) -> Val:
        return self._same_type(x, lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)")) if x.kind != DBL else F.floor(c + 0.5))

    def f_ceil(self, x: Val) -> Val:
        return self._same_type(x, F.ceil)

    def f_floor(self, x: Val) -> Val:
        return self._same_type(x, F.floor)

    def f_rand(self) -> Val:
        return Val(DBL, F.rand())

    # strings

    def _like(self, x: Val, text: Column) -> Val:
        """A string with the datatype and language of ``x``."""
        if x.kind == STR:
            return Val(STR, text)
        if x.kind != TERM:
            return Val(STR, F.lit(None).cast("string"))
        return Val(TERM, R.struct(R.LITERAL, F.when(plain(x).isNotNull(), text), x.col["dt"], x.col["lang"]))

    def f_strlen(self, x: Val) -> Val:
        return Val(INT, F.length(plain(x)).cast("bigint"))

    def f_substr(self, x: Val, start: Val, length: Val | None = None) -> Val:
        """Characters whose position p has start <= p < start + length, positions from 1."""
        first = F.floor(number(start) + 0.5).cast("int")
        text = plain(x)
        stop = F.length(text) + 1 if length is None else first + F.floor(number(length) + 0.5).cast("int")
        at = F.greatest(first, F.lit(1))
        return self._like(x, F.when(stop > at, F.substring(text, at, stop - at)).when(text.isNotNull() & stop.isNotNull(), F.lit("")))

    def f_ucase(self, x: Val) -> Val:
        return self._like(x, F.upper(plain(x)))

    def f_lcase(self, x: Val) -> Val:
        return self._like(x, F.lower(plain(x)))

    def _compatible(self, x: Val, y: Val) -> Column:
        """Argument compatibility: the second is simple or has the language of the first."""
        if y.kind == STR or x.kind != TERM and y.kind != TERM:
            return F.lit(True)
        lang = x.col["lang"] if x.kind == TERM else F.lit(None).cast("string")
        return y.col["lang"].isNull() | (y.col["lang"] == lang)

    def _pair(self, x: Val, y: Val, f: Callable[[Column, Column], Column]) -> Val:
        return Val(BOOL, F.when(F.coalesce(self._compatible(x, y), F.lit(False)), f(plain(x), plain(y))))

    def f_contains(self, x: Val, y: Val) -> Val:
        return self._pair(x, y, lambda a, b: F.contains(a, b))

    def f_strstarts(self, x: Val, y: Val) -> Val:
        return self._pair(x, y, lambda a, b: F.startswith(a, b))

    def f_strends(self, x: Val, y: Val) -> Val:
        return self._pair(x, y, lambda a, b: F.endswith(a, b))

    def _around(self, x: Val, y: Val, after: bool) -> Val:
        a, b = plain(x), plain(y)
        at = F.locate(b, a) if isinstance(b, str) else F.call_function("locate", b, a)
        part = F.substring(a, at + F.length(b), F.length(a)) if after else F.substring(a, F.lit(1), at - 1)
        fine = F.coalesce(self._compatible(x, y), F.lit(False))
        if x.kind != TERM:
            return Val(STR, F.when(fine & (at > 0), part).when(fine & at.isNotNull(), F.lit("")))
        found = R.struct(R.LITERAL, F.when(fine & (at > 0), part), x.col["dt"], x.col["lang"])
        return Val(TERM, F.coalesce(found, F.when(fine & (at == 0), R.const(R.Literal("")))))

    def f_strbefore(self, x: Val, y: Val) -> Val:
        return self._around(x, y, False)

    def f_strafter(self, x: Val, y: Val) -> Val:
        return self._around(x, y, True)

    def f_concat(self, *xs: Val) -> Val:
        if all(x.kind == STR for x in xs):
            return Val(STR, F.concat(*[x.col for x in xs]) if xs else F.lit(""))
        text = F.concat(*[plain(x) for x in xs])
        langs = [x.col["lang"] if x.kind == TERM else F.lit(None).cast("string") for x in xs]
        common = reduce(lambda a, b: F.when(a == b, a), langs)
        return Val(TERM, R.struct(R.LITERAL, text, F.when(common.isNotNull(), R.LANG_STRING).otherwise(STRING), common))

    def f_encode_for_uri(self, x: Val) -> Val:
        if isinstance(x.constant, R.Literal):
            return Val(STR, F.lit(quote(x.constant.value, safe="-_.~")))
        out = F.url_encode(plain(x))
        for raw, safe in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            out = F.replace(out, F.lit(raw), F.lit(safe))
        return Val(STR, out)

    def _pattern(self, pattern: Val, flags: Val | None) -> Column:
        if flags is None:
            return simple(pattern)
        p, f = simple(pattern), simple(flags)
        literal = F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        p = F.when(F.contains(f, F.lit("q")), literal).otherwise(p)
        kept = F.regexp_replace(f, "[^ismx]", "")
        return F.when(f.rlike("^[ismxq]*$"), F.when(kept == "", p).otherwise(F.concat(F.lit("(?"), kept, F.lit(")"), p)))

    def f_regex(self, x: Val, pattern: Val, flags: Val | None = None) -> Val:
        return Val(BOOL, F.regexp_like(plain(x), self._pattern(pattern, flags)))

    def f_replace(self, x: Val, pattern: Val, by: Val, flags: Val | None = None) -> Val:
        return self._like(x, F.regexp_replace(plain(x), self._pattern(pattern, flags), simple(by)))

    def f_md5(self, x: Val) -> Val:
        return Val(STR, F.md5(simple(x)))

    def f_sha1(self, x: Val) -> Val:
        return Val(STR, F.sha1(simple(x)))

    def f_sha256(self, x: Val) -> Val:
        return Val(STR, F.sha2(simple(x), 256))

    def f_sha384(self, x: Val) -> Val:
        return Val(STR, F.sha2(simple(x), 384))

    def f_sha512(self, x: Val) -> Val:
        return Val(STR, F.sha2(simple(x), 512))

    def f_uuid(self) -> Val:
        return Val(IRI, F.concat(F.lit("urn:uuid:"), F.upper(F.uuid())))

    def f_struuid(self) -> Val:
        return Val(STR, F.upper(F.uuid()))

    # dates; fields are those of the literal's own zone

    def f_now(self) -> Val:
        return Val(TIME, F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz"))

    def _field(self, x: Val, native: Callable[[Column], Column], group: int) -> Val:
        if x.kind == TIME:
            return Val(INT, native(x.col).cast("bigint"))
        return Val(INT, _date_part(x, group).cast("bigint"))

    def f_year(self, x: Val) -> Val:
        return self._field(x, F.year, 1)

    def f_month(self, x: Val) -> Val:
        return self._field(x, F.month, 2)

    def f_day(self, x: Val) -> Val:
        return self._field(x, F.dayofmonth, 3)

    def f_hours(self, x: Val) -> Val:
        return self._field(x, F.hour, 4)

    def f_minutes(self, x: Val) -> Val:
        return self._field(x, F.minute, 5)

    def f_seconds(self, x: Val) -> Val:
        if x.kind == TIME:
            return Val(DEC, F.extract(F.lit("SECOND"), x.col).cast(SPARK[DEC]))
        return Val(DEC, _date_part(x, 6).try_cast(SPARK[DEC]))

    def f_tz(self, x: Val) -> Val:
        return Val(STR, F.when(x.col.isNotNull(), "Z") if x.kind == TIME else _date_part(x, 7, True))

    def f_timezone(self, x: Val) -> Val:
        zone = F.lit("Z") if x.kind == TIME else F.when(_date_part(x, 7) != "", _date_part(x, 7))
        h, m = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
        parts = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
        text = F.when((zone == "Z") | (parts == ""), "PT0S").otherwise(F.concat(F.when(F.startswith(zone, F.lit("-")), "-").otherwise(""), F.lit("PT"), parts))
        return Val(TERM, R.struct(R.LITERAL, F.when(zone.isNotNull() & x.col.isNotNull(), text), F.lit(XSD + "dayTimeDuration")))

    # quoted triples

    def f_triple(self, s: Val, p: Val, o: Val) -> Val:
        return Val(TERM, self.quoted(constant_term(s), constant_term(p), constant_term(o)))

    def f_subject(self, x: Val) -> Val:
        return Val(TERM, star.part(lift(x), 0))

    def f_predicate(self, x: Val) -> Val:
        return Val(TERM, star.part(lift(x), 1))

    def f_object(self, x: Val) -> Val:
        return Val(TERM, star.part(lift(x), 2))

    # casts

    def cast(self, to: str, x: Val) -> Val:
        """xsd:string, integer (and its kin), decimal, float, double, boolean, dateTime of a value; NULL if it has none."""
        text = F.trim(lexical(x))
        if to == "string":
            return Val(STR, lexical(x))
        n, b = number(x), x.col if x.kind == BOOL else None
        exact = _exact if x.kind in (INT, DEC, TERM) else lambda _: F.lit(None).cast(SPARK[DEC])
        if x.kind == TERM:
            b = F.when((x.col["dt"] == XSD + "boolean"), x.col["v"].isin("true", "1"))
            text = F.when(x.col["k"] == R.LITERAL, text)
        truth_number = F.when(b, 1).when(~b, 0) if b is not None else F.lit(None).cast("int")
        if XSD + to in INTEGERS:
            whole = F.when(n.isNotNull() & ~F.isnan(n), F.coalesce(F.when(exact(x) >= 0, F.floor(exact(x))).otherwise(F.ceil(exact(x))).cast("bigint"), n.try_cast("bigint")))
            got = F.coalesce(whole, truth_number.cast("bigint"), F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")))
            return Val(INT, got) if to == "integer" else Val(TERM, R.struct(R.LITERAL, got.cast("string"), F.lit(XSD + to)))
        if to == "decimal":
            got = F.coalesce(exact(x), F.when(~F.isnan(n), n).try_cast(SPARK[DEC]), truth_number.cast(SPARK[DEC]), F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), text.try_cast(SPARK[DEC])))
            return Val(DEC, got)
        if to in ("double", "float"):
            special = F.when(text == "INF", F.lit(float("inf"))).when(text == "-INF", F.lit(float("-inf"))).when(text == "NaN", F.lit(float("nan")))
            got = F.coalesce(n, truth_number.cast("double"), special, F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double")))
            return Val(FLT, got.cast("float")) if to == "float" else Val(DBL, got)
        if to == "boolean":
            got = F.coalesce(b if b is not None else F.lit(None).cast("boolean"), (n != 0) & ~F.isnan(n), F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False))
            return Val(BOOL, got)
        if to == "dateTime":
            if x.kind == TIME:
                return x
            shaped = text.rlike(r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$")
            return Val(TERM, R.struct(R.LITERAL, F.when(shaped, text), F.lit(XSD + "dateTime")))
        raise UnsupportedError(f"no cast to xsd:{to}")


def _iri(v: Val) -> Column:
    return v.col if v.kind == IRI else F.when(v.col["k"] == R.IRI_, v.col["v"]) if v.kind == TERM else F.lit(None).cast("string")


def _date_part(x: Val, group: int, empty: bool = False) -> Column:
    text = F.when(x.col["dt"] == XSD + "dateTime", x.col["v"]) if x.kind == TERM else F.lit(None).cast("string")
    shape = r"^(-?\d{4,})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d(?:\.\d+)?)(Z|[+-]\d\d:\d\d)?$"
    got = F.regexp_extract(text, shape, group)
    return F.when(text.rlike(shape), got) if empty or group == 7 else F.when(got != "", got)


def alike(a: Val, b: Val) -> tuple[Val, Val]:
    """Both as one kind."""
    return (a, b) if a.kind == b.kind else (Val(TERM, constant_term(a)), Val(TERM, constant_term(b)))


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """``+ - * /`` with the promotions integer, decimal, float, double; NULL for other operands or division of exact numbers by zero."""
    if a.kind in NUMBERS and b.kind in NUMBERS:
        kind = NUMBERS[max(NUMBERS.index(a.kind), NUMBERS.index(b.kind))]
        if op == "/" and kind == INT:
            kind = DEC
        x, y = a.col.cast(SPARK[kind]), b.col.cast(SPARK[kind])
        return Val(kind, _apply(op, x, y, kind))
    top = F.greatest(rank(a), rank(b))
    top = F.when(rank(a).isNotNull() & rank(b).isNotNull(), F.when((top == 1) & F.lit(op == "/"), 2).otherwise(top))
    whole = _apply(op, _exact(a), _exact(b), DEC)
    real = _apply(op, number(a), number(b), DBL)
    text = F.when(top == 1, whole.cast("decimal(38,0)").cast("string")).when(top == 2, text_of_number(whole, DEC)).when(top > 2, text_of_number(real, DBL))
    dt = F.when(top == 1, XSD + "integer").when(top == 2, XSD + "decimal").when(top == 3, XSD + "float").otherwise(XSD + "double")
    return Val(TERM, R.struct(R.LITERAL, text, dt))


def _apply(op: str, x: Column, y: Column, kind: str) -> Column:
    if op == "+":
        out = F.try_add(x, y)
    elif op == "-":
        out = F.try_subtract(x, y)
    elif op == "*":
        out = F.try_multiply(x, y)
    elif kind in (FLT, DBL):  # IEEE division
        signed = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
        out = F.when(y == 0, signed).otherwise(F.try_divide(x, y))
    else:
        out = F.try_divide(x, y)
    return out.try_cast(SPARK[kind])


__all__ = ["NUMERIC", "Expressions", "UnsupportedError", "alike", "arithmetic", "instant"]
