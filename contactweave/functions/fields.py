"""Rows that carry their line: typed columns are read off it when something asks for them,
and an operator that changes fields splices them into it, so what nobody touches is written
as it came."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The raw line of a row, and the columns that aren't fields by name.
LINE = "_line"
OWN = ("seq", "_rest", LINE)


def named(df: DataFrame) -> list[str]:
    """The columns that are fields, in the line's order."""
    return [c for c in df.columns if c not in OWN]


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, lambdas in ``body`` included."""
    return F.element_at(F.transform(F.array(value), body), 1)


def raw_field(at: int) -> Column:
    return F.get(F.split(LINE, "\t", -1), F.lit(at))


def with_fields(df: DataFrame, changes: dict[str, Callable[[Column], Column]], when: Column) -> DataFrame:
    """``df`` with fields of the line replaced ``when`` it holds: each function gets the
    line's fields as an array.  A field that the line lacks, or whose new value is null,
    stays as it is.  Typed columns are left to the caller."""
    if LINE not in df.columns:
        return df
    at = {c: i for i, c in enumerate(named(df))}

    def spliced(fields: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            out = x
            for c, new in changes.items():
                out = F.when(i == at[c], F.coalesce(new(fields), x)).otherwise(out)
            return out

        return F.array_join(F.transform(fields, one), "\t")

    return df.withColumn(LINE, F.when(when, once(F.split(LINE, "\t", -1), spliced)).otherwise(F.col(LINE)))


def with_appended(df: DataFrame, field: Column) -> DataFrame:
    """``df`` with one more field at the end of the line where ``field`` isn't null."""
    if LINE not in df.columns:
        return df
    return df.withColumn(LINE, F.when(field.isNull(), F.col(LINE)).otherwise(F.concat(F.col(LINE), F.lit("\t"), field)))


def with_only(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with the line made of these fields, empty where it lacks them."""
    if LINE not in df.columns:
        return df
    at = [named(df).index(c) for c in names]
    whole = lambda f: F.array_join(F.array(*(F.coalesce(F.get(f, F.lit(i)), F.lit("")) for i in at)), "\t")
    out = df.withColumn(LINE, once(F.split(LINE, "\t", -1), whole))
    return out.withColumn("_rest", F.array().cast("array<string>")) if "_rest" in df.columns else out
