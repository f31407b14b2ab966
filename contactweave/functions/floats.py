"""Floats as the shortest text that reads back as the same number, laid out as Python
lays them out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactweave.functions.fields import once

#: Every double is told apart by 17 digits, and every number of 15 digits is kept by one.
DIGITS = (15, 16, 17)
#: Exponents from which numbers are written without one, and up to which.
PLAIN_FROM, PLAIN_BELOW = -4, 16
NORMAL_FROM = 2.0**-1022
#: Doubles in this range are whole and fit BIGINT.
WHOLE_FROM, WHOLE_BELOW = float(2**53), float(2**63 - 2**16)


def shortest(x: Column) -> Column:
    """``x`` in the form -d.ddde+dd with as few digits as lead back to it (and zeros up
    to ``DIGITS[0]``)."""
    form = lambda n: F.format_string(f"%.{n - 1}e", x)
    leads_back = lambda text: text.cast("double") == x
    # Numbers without a leading bit have fewer digits of their own.
    faint = F.when(F.abs(x) < NORMAL_FROM, _first([form(n) for n in range(1, DIGITS[-1] + 1)], leads_back))
    whole = F.abs(x).cast("bigint")
    exact = (F.abs(x) >= WHOLE_FROM) & (F.abs(x) < WHOLE_BELOW)
    return F.when(exact, once(whole, lambda v: _whole(x, v))).otherwise(F.coalesce(faint, _first([form(n) for n in DIGITS], leads_back)))


def _first(forms: list[Column], leads_back) -> Column:
    out = forms[-1]
    for form in reversed(forms[:-1]):
        out = F.when(leads_back(form), form).otherwise(out)
    return out


def _whole(x: Column, v: Column) -> Column:
    """The same for whole numbers that a BIGINT ``v`` holds and Java rounds otherwise."""
    size = F.length(v.cast("string"))

    def rounded(n: int) -> Column:
        unit = F.element_at(F.array(*(F.lit(10**k).cast("bigint") for k in range(6))), F.greatest(size - n, F.lit(0)) + 1)
        q, twice = F.call_function("div", v, unit), 2 * (v % unit)
        return (q + F.when((twice > unit) | ((twice == unit) & (q % 2 == 1)), 1).otherwise(0)) * unit

    best = _first([rounded(n) for n in DIGITS], lambda r: r.cast("double") == F.abs(x))
    text = best.cast("string")
    sign = F.when(x < 0, "-").otherwise("")
    return F.concat(sign, F.substring(text, 1, 1), F.lit("."), F.substr(text, F.lit(2)), F.lit("e+"), (F.length(text) - 1).cast("string"))


def _laid_out(form: Column) -> Column:
    sign = F.when(F.startswith(form, F.lit("-")), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(form, "e", 1), "[-.]", ""), "(?<=.)0+$", "")
    power = F.substring_index(form, "e", -1).cast("int")

    def written(p: Column) -> Column:
        d, e, s = p["d"], p["e"], p["s"]
        n = F.length(d)
        fixed = (
            F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d))
            .when(e >= n - 1, F.concat(d, F.repeat(F.lit("0"), e - n + 1), F.lit(".0")))
            .otherwise(F.concat(F.substr(d, F.lit(1), e + 1), F.lit("."), F.substr(d, e + 2)))
        )
        rest = F.substr(d, F.lit(2))
        powered = F.concat(F.substr(d, F.lit(1), F.lit(1)), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
        return F.concat(s, F.when((e >= PLAIN_FROM) & (e < PLAIN_BELOW), fixed).otherwise(powered))

    return once(F.struct(digits.alias("d"), power.alias("e"), sign.alias("s")), written)


def _as_java(x: Column) -> Column:
    """The text where Java's own has at most 15 digits and no zeros at its end, null
    elsewhere: no other text that short reads back as the same number, so it is the
    shortest one.  Java writes numbers without an exponent from 0.001 to 10**7."""
    text, size = x.cast("string"), F.abs(x)
    digits = F.substring_index(text, "E", 1)
    whole = F.endswith(digits, F.lit(".0"))
    sound = (F.length(digits) <= DIGITS[0] + 1) & (whole | ~F.endswith(digits, F.lit("0")))
    small = F.concat(F.when(whole, F.substring_index(digits, ".", 1)).otherwise(digits), F.lit("e-0"), F.substring_index(text, "-", -1))
    return F.when((size >= 1e-3) & (size < 1e7) & sound, text).when((size >= 1e-9) & (size < 1e-4) & sound, small)


def float_text(x: Column) -> Column:
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    zero = F.when(x == 0, F.when(F.startswith(x.cast("string"), F.lit("-")), "-0.0").otherwise("0.0"))
    return F.coalesce(_as_java(x), odd, zero, once(shortest(x), _laid_out))
