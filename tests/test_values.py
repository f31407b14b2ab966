"""Conditions whose types a row decides, and floats as text, against Python itself."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from contactweave.functions import floats
from contactweave.functions.expr import compile_condition
from contactweave.functions.floats import float_text
from contactweave.model import PairsError, Unsupported
from contactweave.operators import basic

ROWS = [(a, b, s, t) for a in (0, 1, 7, -3) for b in (-2, 0, 3) for s in ("", "x", "7") for t in ("x", "yy")]
CONDITIONS = [
    "(a and s) == 'x'",
    "(a and s) == 0",
    "(s or a) == 7",
    "(s or a or t) != 'x'",
    "(a and s or b) in ['x', 3, 'yy']",
    "not (a and s)",
    "(a or s) and (s or b)",
    "((a and 1.5) or s) == 1.5",
    "-(a and 2) + 1 == 1",
    "(s and 3) == 3 or (t and a) * 2 == 14",
    "a ** 2 == 49",
    "str(s and a) == '7'",
    "str((a or s) == 'x') == 'True'",
    "max(a, (b and 2.5)) >= 2.5",
    "(a == 7 and s) and (b and t) == 'yy'",
]


def frame(spark):
    return spark.createDataFrame(ROWS, "a long, b long, s string, t string")


@pytest.mark.parametrize("condition", CONDITIONS)
def test_mixed_values_are_pythons(spark, condition):
    df = frame(spark)
    got = {tuple(r)[:4] for r in df.where(compile_condition(condition, df, {"a": "int", "b": "int"})).collect()}
    assert got == {r for r in ROWS if eval(condition, {}, dict(zip("abst", r)))}


def test_powers_with_a_columns_exponent(spark):
    df = spark.createDataFrame([(2, -1), (2, 3), (-3, 3), (10, -3), (1, -9), (7, 0)], "a long, b long")
    types = {"a": "int", "b": "int"}
    for condition in ("a ** b == 0.5", "a ** b < 0", "a ** b == 0.001 or a ** b == 8", "(a ** b) % 2 == 1", "str(a ** b) in ['0.5', '1', '8', '1.0']"):
        got = {tuple(r) for r in df.where(compile_condition(condition, df, types)).collect()}
        assert got == {tuple(r) for r in df.collect() if eval(condition, {}, {"a": r.a, "b": r.b})}, condition
    with pytest.raises(Exception, match="(?i)overflow"):
        df.where(compile_condition("a ** (b + 70) > 0", df, types)).collect()


def test_errors_of_mixed_values_come_from_the_rows_that_make_them(spark):
    df = frame(spark)
    types = {"a": "int", "b": "int"}
    condition = compile_condition("(a and s) < 'y'", df, types)
    assert df.where("a <> 0").where(condition).count() == 54
    with pytest.raises(Exception, match="can't be ordered"):
        df.where(condition).collect()
    with pytest.raises(PairsError):
        compile_condition("a < 'y'", df, types)
    with pytest.raises(PairsError):
        compile_condition("len(a) == 1", df, types)
    with pytest.raises(Unsupported):
        compile_condition("[1] == (a and s)", df, types)


def test_float_text_is_pythons(spark):
    rng = random.Random(7)
    values = [k / 7 for k in range(20_000)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 25) for _ in range(60_000)]
    values += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(20_000)) if x == x]
    values += [0.0, -0.0, 1.0, 1e16, 9999999999999998.0, 1e-4, 9.999e-5, 1e22, 1e23, 5e-324, 1.7976931348623157e308, 2e-3, 2.0**-44, float("inf"), float("-inf"), 123456789012345680.0, 0.1 + 0.2, 100.0, -1.5]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = df.select("x", float_text(F.col("x")).alias("t")).collect()
    wrong = [(repr(r.x), r.t) for r in got if r.t != repr(r.x)]
    assert not [w for w in wrong if float(w[0]) != float(w[1])]
    assert not wrong, (len(wrong), wrong[:5])
    assert spark.range(1).select(float_text(F.lit(float("nan")))).first()[0] == "nan"


def test_text_of_ordinary_floats_is_pythons(spark):
    """Without the slow way, where Java's text will do, and alike beside it."""
    rng = random.Random(11)
    edge = [y for x in (1e-9, 1e-4, 1e-3, 1e7, 1.0, 9.5, 0.002, 2e-05, 1e-05, 9.999e-5) for y in (x, math.nextafter(x, 0), math.nextafter(x, 1e9))]
    numbers = edge + [rng.randint(1, 10**6) / d for d in (8, 10, 1000, 1e6, 1e9, 3, 7e5) for _ in range(200)]
    numbers += [-x for x in numbers]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    got = df.select("x", float_text(F.col("x")).alias("t"), floats._as_java(F.col("x")).alias("j")).collect()
    assert [(r["x"], r["t"]) for r in got if r["t"] != repr(r["x"])] == []
    assert {r["x"] for r in got if len(repr(r["x"])) < 12 and (1e-3 <= abs(r["x"]) < 1e7 or 1e-9 <= abs(r["x"]) < 1e-4)} <= {r["x"] for r in got if r["j"] is not None}


def test_conditions_do_not_repeat_columns(spark):
    """A computed column is in the plan once, however often a condition names it."""
    df = spark.range(20).selectExpr("id AS seq", "CASE WHEN id % 977 = 5 THEN 0 ELSE id * 3 END AS pos1", "id AS pos2")
    condition = "(pos1 - pos2) // 7 % 3 == 1 or max(pos1, pos2) - min(pos1, pos2) > 30"
    kept, rest = basic.select_pairs(df, condition)
    for part, rows in ((kept, [i for i in range(20) if want(i)]), (rest, [i for i in range(20) if not want(i)])):
        assert sorted(r["seq"] for r in part.collect()) == rows
        assert part._jdf.queryExecution().optimizedPlan().toString().count("977") == 1


def want(i):
    a, b = (0 if i % 977 == 5 else i * 3), i
    return (a - b) // 7 % 3 == 1 or max(a, b) - min(a, b) > 30
