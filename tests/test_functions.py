import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.functions import draws, text
from latticeworks.functions.formula import FormulaError, Scope, compile_formula, names, parse

VALUES = {"x": 3.0, "y": -2.5}


def value(spark, formula, **lets):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in VALUES.items()))
    return df.select(compile_formula(formula, Scope({k: F.col(k) for k in VALUES}, lets)).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("= 1 + 2 * 3", 7.0),
        ("= -x * 2", -6.0),
        ("= (1 + 2) * x", 9.0),
        ("= 8 / 2 / 2", 2.0),
        ("= if(x > 2 and not y > 0, 1, 0)", 1.0),
        ("= if(x < 0, sqrt(-1), 5)", 5.0),
        ("= min(4, x, y) + max(1, 2)", -0.5),
        ("= clamp(7, hi = 5, lo = 0)", 5.0),
        ("= mix(2, 4, 0.25)", 2.5),
        ("= smoothstep(0, 4, 2)", 0.5),
        ("= floor(y)", -3.0),
        ("= sin(180) + cos(90) + sin(90)", 1.0),
        ("= tan(45)", 1.0),
        ("= pow(2, 10) + abs(-1) + exp(0)", 1026.0),
        ("= 1e-3 * 1000", 1.0),
        ("= pi", math.pi),
    ],
)
def test_formula_value(spark, formula, want):
    assert value(spark, formula) == pytest.approx(want, abs=1e-12)


def test_lets_and_names(spark):
    assert value(spark, "= a + 1", a="b * 2", b="x") == 7.0
    assert names(parse("= a.b + c * sin(d)")) == {"a.b", "c", "d"}
    with pytest.raises(FormulaError, match="formula.cycle"):
        value(spark, "= a", a="b", b="a")


@pytest.mark.parametrize(
    ("formula", "code"),
    [("=", "formula.syntax"), ("= a < b < c", "formula.syntax"), ("= 1_0", "formula.syntax"), ("= .5", "formula.syntax"), ("= a ** b", "formula.operator"), ("= a & b", "formula.operator"), ("= X", "formula.character"), ("= x = 1", "formula.operator"), ("= +1", "formula.syntax"), ("= 1e400", "formula.syntax"), ("= " + "(" * 70 + "1" + ")" * 70, "formula.too_deep"), ("= clamp(lo = 1, 2, 3)", "formula.arguments"), ("= " + "1 + " * 2000 + "1", "formula.too_long")],
)
def test_formula_breach(formula, code):
    with pytest.raises(FormulaError) as e:
        parse(formula)
    assert e.value.code == code


@pytest.mark.parametrize(("formula", "code"), [("= x and y", "formula.type"), ("= nope", "formula.unknown_name"), ("= nope(1)", "formula.unknown_function"), ("= sqrt(1, 2)", "formula.arguments"), ("= if(x, 1, 2)", "formula.type"), ("= 'a'", "formula.type")])
def test_formula_check(spark, formula, code):
    with pytest.raises(FormulaError) as e:
        value(spark, formula)
    assert e.value.code == code


@pytest.mark.parametrize("formula", ["= sqrt(y)", "= 1 / (x - 3)", "= tan(90)", "= clamp(1, 3, 2)", "= smoothstep(1, 1, 0)"])
def test_failed_operation_is_an_error(spark, formula):
    with pytest.raises(Exception, match="formula\\."):
        value(spark, formula)


def test_streams_and_draws_are_the_published_ones(spark):
    s = draws.stream(0, ["noise", "seed", "hills"])
    assert s == 0xB2257365AD2F65DB
    assert int(draws.splitmix64(0)) == 0xE220A8397B1DCDAF
    assert draws.stream(0, ["noise", "field", "height", "base"]) == 0x2B7A1CEA060EDEB6
    want = {(0, 0, 0): 0x4B53AD8575D91FE2, (1, 0, 0): 0x8A012828A633CA3F, (0, 1, 0): 0xF1B145B81005BEF1, (-1, 0, 0): 0x3A665A82041D210B, (0, 0, 1): 0x286CF8A0063C878F}
    got = spark.createDataFrame([*want], "a long, b long, c long").select("a", "b", "c", draws.draw(s, F.col("a"), F.col("b"), F.col("c")).alias("w")).collect()
    assert {(r.a, r.b, r.c): r.w % 2**64 for r in got} == want


def test_noise_is_the_published_one():
    s = draws.stream(0, ["noise", "seed", "hills"])
    at = lambda o, x, y: float(draws.gradient_noise(s, o, np.array([x]), np.array([y]))[0])
    assert [at(0, 0.5, 0.5), at(0, 0.25, 0.75), at(0, -0.5, 0.5), at(1, 0.5, 0.5), at(0, 3.0, 2.0)] == [0.375, 0.054436683654785156, -0.25, 0.0, 0.0]


def test_text(spark):
    df = spark.createDataFrame([("a_1", "1.234"), ("9 Lives!", "-0.5")], "n string, m string")
    got = df.select(text.is_id(F.col("n")), text.repaired(F.col("n")), text.millimetres(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [(True, "a_1", 1234), (False, "lives_", -500)]
    with pytest.raises(Exception, match="number.precision"):
        df.select(text.millimetres(F.lit("1.2345"))).collect()
