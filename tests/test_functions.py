import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyquill.functions import numbers, outputs, text
from tallyquill.operators import programs


def column(spark, rows, *exprs, names="a"):
    names = names.split()
    data = [r if isinstance(r, tuple) else (r,) for r in rows]
    df = spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))
    return [tuple(r) if len(exprs) > 1 else r[0] for r in df.select(*(e.alias(f"x{i}") for i, e in enumerate(exprs))).collect()]


def test_F3_answer_matching(spark):
    rows = [("$206,588", "206588"), ("1,314", "1314"), ("14.1%", "14.14%"), ("14.1%", "0.141"), ("14.1%", "14.2"), ("25,587", "A0"), ("Yes", "yes"), (None, "1")]
    got = column(spark, rows, text.is_answer_correct(F.col("a"), F.col("b")), names="a b")
    assert got == [True, False, True, False, True, False, True, False]


def test_F1_answer_phrase_stops_at_the_point(spark):
    assert column(spark, ["The answer is 14.1%", "x <answer> 7\n</answer>", " Answer: none", " plain "], text.extract_answer(F.col("a"))) == ["14", "7", "none", "plain"]


def test_F2_rounds_as_the_binary_value_says(spark):
    values = [f"{i / 100:.2f}" for i in range(0, 4000, 5)] + ["-0.04", "-14.35", "3"]
    got = column(spark, [f"{v}%" for v in values], text.normalize_answer(F.col("a")))
    assert got == [f"{float(v):.1f}%" for v in values]


def test_F2_other_spellings(spark):
    assert column(spark, ["$1,234", "$1.5", "7.0", "0.12345", "10000000.5", "Abc", "1d", " 3 "], text.normalize_answer(F.col("a"))) == ["1234.0", "1.5", "7", "0.1234", "10000000.5", "abc", "1d", "3"]


def test_C2_groups_of_three(spark):
    assert column(spark, ["$ 206588 and 1,234.5 and 12%"], numbers.numbers_in(F.col("a"))) == [[206.0, 588.0, 1234.5, 12.0]]


def test_C5_metrics(spark):
    got = column(spark, ["Net income was $3.2 billion; growth rate of 12.5% for 2,500 new employees"], F.transform(numbers.metrics_in(F.col("a")), lambda m: F.concat_ws("=", m["metric"], m["value"].cast("string"))))
    assert "net income=3.2E9" in got[0] and "growth rate (%)=0.125" in got[0] and "new employees=2500.0" in got[0]


def test_C6_units_are_looked_for_behind_the_match():
    found = numbers.number_details(pd.Series(["about 5 more and $3 plus 7% or 1,000", None, "no"]))
    assert [len(x) for x in found] == [4, 0, 0]
    found = found[0]
    assert [f["value"] for f in found] == [5.0, 3.0, 7.0, 1000.0]
    assert found[1]["is_currency"] and not found[2]["is_percentage"]


def test_F18_cells(spark):
    assert column(spark, ["1,234", "12%", "const_100", "const_m1", "x", "-3.5"], numbers.cell_number(F.col("a"))) == [1234.0, 0.12, 100.0, -1.0, None, -3.5]


TAGS = "<begin_of_program>\n{}\n<end_of_program>\n\n<begin_of_answer>\n{}\n<end_of_answer>"


@pytest.mark.parametrize(
    ("program", "tokens"),
    [
        ("subtract( 5829 5735 ) EOF", ["subtract(", "5829", "5735", ")", "EOF"]),
        ("divide( 8.1 56.0 ) EOF", ["divide(", "8.1", "56.0", ")", "EOF"]),
        ("add ( 320 177 ) EOF", ["add(", "320", "177", ")", "EOF"]),
        ("divide( add( add( 55.9 59.4 ) 62.8 ) 3 ) EOF", ["divide(", "add", "(", "add", "(", "55.9", "59.4", ")", "62.8", ")", "3", ")", "EOF"]),
    ],
)
def test_P6_goldens(program, tokens):
    assert outputs.program_tokens(TAGS.format(program, "1")) == tokens


def test_P6_rescues():
    assert outputs.program_tokens("320 - 177") == ["add(", "320", "177", ")", "EOF"]  # the sign is never captured
    assert outputs.program_tokens("320 minus 177") == ["subtract(", "320", "177", ")", "EOF"]
    assert outputs.program_tokens("x Multiply(3, 4)") == ["multiply(", "3", "4", ")", "EOF"]
    assert outputs.formatted_prediction("  ") == ["EOF"]
    assert outputs.program_tokens(TAGS.format("the sum: add 3 and 4", "7")) == ["add(", "3", "4", ")", "EOF"]


def test_F10_python_and_column_agree(spark):
    samples = [TAGS.format("x", "94"), TAGS.format("x", "14.5%"), "The result is 59.37 now", "so = 5", "costs $3", "add(1, 2) = 3", "nothing", "and 4 5", TAGS.format("and", "and 7 8"), TAGS.format("a", "and"), "<|im_start|>assistant\nvalue: 6<|im_end|>"]
    assert column(spark, samples, text.robust_answer(F.col("a"))) == [outputs.answer_of(s) for s in samples]


def test_F12_python_and_column_agree(spark):
    samples = [TAGS.format("add( 1 2 ) EOF", "3"), TAGS.format("and", "3 EOF"), TAGS.format("x", "3"), "EOF", TAGS.format("EOF", "the")]
    assert column(spark, samples, text.is_valid_output(F.col("a"))) == [outputs.looks_valid(s) for s in samples] == [True, False, False, False, False]


def test_F13_bare_integers_are_refused(spark):
    samples = [TAGS.format("subtract( 5829 5735 ) EOF", "94"), TAGS.format("divide( 8.1 56.0 ) EOF", "14.5%"), TAGS.format("add( #0 1 )", "a b"), TAGS.format("add( #0 1 )", "$1,000")]
    assert column(spark, samples, text.validate_format(F.col("a"))) == [False, True, False, True]


def test_F8_F14_blocks():
    assert outputs.clean("system: add( 3 4 ) so the result is 7") == TAGS.format("add( 3 4 ) EOF", "7")
    assert outputs.clean("subtract( 5 3 )") == TAGS.format("subtract( 5 3 ) EOF", "5")
    assert outputs.rescue("we get 3 + 4 = 7", "llama-3.3") == TAGS.format("add( 3 4 ) EOF", "7")
    assert outputs.rescue("divide( 9 3 )") == TAGS.format("divide( 9 3 ) EOF", "3.0")
    assert outputs.rescue("nothing") == "nothing"


def evaluated(spark, *programs_):
    df = spark.createDataFrame([(p.split(),) for p in programs_], "p array<string>")
    return [tuple(r[0]) for r in df.select(programs.rounded(programs.evaluate(F.col("p")))).collect()]


def test_P2_goldens(spark):
    assert evaluated(
        spark, "206588 EOF", "subtract( 206588 181001 ) EOF", "subtract( 206588 181001 ) divide( #0 181001 ) EOF", "subtract( 1314 1194 ) divide( #0 1194 ) EOF", "greater( 5 3 ) EOF",
        "divide( 1 0 ) EOF", "subtract( 5 3 ) divide( #0 0 ) EOF", "foo( 1 2 ) EOF", "exp( 2 3 ) EOF", "add( x 2 ) EOF", "add( 1 2 ) junk( EOF",
    ) == [
        (0, 206588.0, None), (0, 25587.0, None), (0, 0.14136, None), (0, 0.1005, None), (0, None, "yes"), (1, None, "n/a"), (1, 2.0, None), (1, None, "n/a"), (0, 8.0, None),
        (1, None, "n/a"), (1, None, "n/a"),
    ]


def test_P3_P5_P7(spark):
    df = spark.createDataFrame([("subtract(206588, 181001), divide(#0, 181001)",), ("none",)], "p string")
    tokens = [r[0] for r in df.select(programs.training_tokens(F.col("p"))).collect()]
    assert " ".join(tokens[0]) == "subtract( 206588 181001 )  divide( #0 181001 ) EOF" and tokens[1] == ["EOF"]
    assert df.select(programs.tokenize(F.col("p"))).first()[0] == ["subtract(", "206588", "181001", ")", "divide(", "#0", "181001", ")", "EOF"]
    nested = spark.createDataFrame([("divide( 72 multiply( 6 210 ) )".split(),), (") )".split(),)], "p array<string>").select(programs.flatten(F.col("p"))).collect()
    assert nested[0][0] == "multiply( 6 210 ) divide( 72 #0 )".split() and nested[1][0] == []


def test_P4():
    same = lambda a, b: programs.programs_equal(a.split(), b.split())
    assert same("add( 1 2 ) EOF", "add( 2 1 ) EOF") and not same("subtract( 1 2 ) EOF", "subtract( 2 1 ) EOF")
    assert same("add( 1 2 ) divide( #0 3 ) EOF", "divide( 1 3 ) divide( 2 3 ) add( #0 #1 ) EOF")
    assert not same("add( 1 2 ) EOF", "add( 1 3 ) EOF") and not same("add( 1 2 ) EOF", "add( #0 2 ) EOF")
    assert same("table_max( row none ) EOF", "table_max( row none ) EOF") and same("7 EOF", "7 EOF") and not same("7 EOF", "8 EOF")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["add", "subtract", "multiply", "divide"]), st.integers(1, 9), st.integers(1, 9)), min_size=1, max_size=4))
def test_P4_equal_programs_have_equal_values(steps):
    tokens = [t for op, a, b in steps for t in (f"{op}(", str(a), str(b), ")")] + ["EOF"]
    assert programs.programs_equal(tokens, tokens)
