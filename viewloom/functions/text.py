"""Texts of numbers, keys and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, and written once in the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _layout(sign: Column, digits: Column, power: Column) -> Column:
    """A decimal number from its significant digits and the power of ten of the first."""
    rest = F.substring(digits, 2, 30)
    fraction = F.when(rest != "", F.concat(F.lit("."), rest)).otherwise("")
    exponent = F.abs(power).cast("string")
    scientific = F.concat(F.substring(digits, 1, 1), fraction, F.when(power < 0, "e-").otherwise("e+"), F.when(F.length(exponent) < 2, "0").otherwise(""), exponent)
    whole = F.rpad(digits, F.greatest(power + 1, F.length(digits)), F.lit("0"))
    large = F.concat(F.substring(whole, F.lit(1), power + 1), F.when(F.length(whole) > power + 1, F.concat(F.lit("."), F.substring(whole, power + 2, F.length(whole)))).otherwise(""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    return F.concat(sign, F.when((power < -4) | (power >= 6), scientific).when(power >= 0, large).otherwise(small))


def number_text(x: Column) -> Column:
    """A double in its shortest text: plain from 0.0001 to below a million, else with an exponent of two digits or more."""

    def parts(java: Column) -> Column:
        pieces = F.split(F.regexp_replace(java, "^-", ""), "[.E]")  # whole, fraction, exponent
        digits = F.concat(F.get(pieces, F.lit(0)), F.get(pieces, F.lit(1)))
        power = F.length(F.get(pieces, F.lit(0))) + F.coalesce(F.get(pieces, F.lit(2)).try_cast("int"), F.lit(0)) - 1
        sign = F.when(java.startswith("-"), "-").otherwise("")
        return F.struct(sign.alias("sign"), digits.alias("digits"), power.alias("power"))

    def text(java: Column) -> Column:
        shown = let(parts(java), lambda p: let(F.ltrim(p["digits"], F.lit("0")), lambda d: _layout(p["sign"], F.rtrim(d, F.lit("0")), p["power"] - F.length(p["digits"]) + F.length(d))))
        return F.when(java == "Infinity", "+Inf").when(java == "-Infinity", "-Inf").when(java.isin("NaN", "0.0", "-0.0"), F.replace(F.replace(java, F.lit("-0.0"), F.lit("0")), F.lit("0.0"), F.lit("0"))).otherwise(shown)

    return let(x.cast("string"), text)


def object_key(namespace: Column, name: Column) -> Column:
    """``namespace/name``, or just the name."""
    return F.concat_ws("/", F.nullif(namespace, F.lit("")), name)


def series_key(anchor: Column, labels: dict[str, Column]) -> Column:
    """``anchor|label=value|...`` with labels in order; delimiters are not escaped."""
    return F.concat_ws("|", anchor, *(F.concat(F.lit(n + "="), labels[n]) for n in sorted(labels)))


def escaped(value: Column) -> Column:
    """A label's value as metrics text writes it."""
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def metric_line(metric: str, labels: dict[str, Column], value: Column | None = None) -> Column:
    """A sample in metrics text, of constant 1 if no text of a value is given."""
    pairs = [F.concat(F.lit(n + '="'), escaped(labels[n]), F.lit('"')) for n in sorted(labels)]
    return F.concat(F.lit(metric + "{"), F.concat_ws(",", *pairs), F.lit("} 1") if value is None else F.concat(F.lit("} "), value))
