"""Column transforms over TERM columns and quads: canonical lexical forms, blank node renaming, IRI rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import terms as R
from tessera.functions import cdt
from tessera.functions.values import DBL, DEC, text_of_number
from tessera.terms import INTEGERS, XSD


def canonical(t: Column) -> Column:
    """A TERM whose numeric or boolean lexical form is canonical; an invalid form is left as it is."""
    v, dt = t["v"], t["dt"]
    whole = F.when(dt.isin(INTEGERS) & v.rlike(r"^[+-]?\d+$"), F.coalesce(v.try_cast("decimal(38,0)").cast("string"), v))
    decimal = F.when((dt == XSD + "decimal") & v.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), text_of_number(v.try_cast("decimal(38,18)"), DEC))
    number = v.try_cast("double")
    exponent = F.floor(F.log10(F.abs(number))).cast("int")
    mantissa = number / F.pow(F.lit(10.0), exponent)
    real = F.when(number == 0, "0.0E0").when(F.isnan(number) | (F.abs(number) == float("inf")), text_of_number(number, DBL)).otherwise(F.concat(F.round(mantissa, 15).cast("string"), F.lit("E"), exponent.cast("string")))
    real = F.when(dt.isin(XSD + "float", XSD + "double") & v.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), real)
    boolean = F.when(dt == XSD + "boolean", F.when(v.isin("1", "true"), "true").when(v.isin("0", "false"), "false"))
    text = F.coalesce(whole, decimal, real, boolean, v)
    return F.when(t["k"] == R.LITERAL, R.struct(R.LITERAL, text, dt, t["lang"])).otherwise(t)


def rename_blanks(t: Column, scope: Column | str) -> Column:
    """A TERM whose blank node label is prefixed by a scope, so that labels of two sources don't meet; in list and map literals too."""
    scope = F.lit(scope) if isinstance(scope, str) else scope
    t = cdt.relabelled(t, scope)
    quoted = F.regexp_replace(t["v"], F.lit(r"(?<=\s)_:(?=\w)"), F.concat(F.lit("_:"), scope))
    return F.when(t["k"] == R.BLANK, R.struct(R.BLANK, F.concat(scope, t["v"]))).when(t["k"] == R.TRIPLE, R.struct(R.TRIPLE, quoted)).otherwise(t)


def rewrite_iris(t: Column, old: str, new: str) -> Column:
    """A TERM whose IRI has one namespace in place of another."""
    moved = F.concat(F.lit(new), F.substring(t["v"], F.lit(len(old) + 1), F.length(t["v"])))
    return F.when((t["k"] == R.IRI_) & F.startswith(t["v"], F.lit(old)), R.struct(R.IRI_, moved)).otherwise(t)


def map_quads(quads: DataFrame, f) -> DataFrame:
    """Quads with a TERM transform on subjects and objects."""
    return quads.select(f(F.col("s")).alias("s"), "p", f(F.col("o")).alias("o"), "g").distinct()
