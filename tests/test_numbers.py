import random
import time

import pandas as pd

from tallyquill.functions import numbers
from tallyquill.functions.numbers import ANY_NUMBER, NUMBER_ROW, number_arrays


def test_C6_spans_are_those_of_the_pattern():
    pick = random.Random(3)
    tokens = ["$", "USD", "US", "1", "23", ",", ".", "%", " ", "\n", "million", "thousand", "m", "k", "x", "é", "٣", "2,500", "1.5", " "]
    for _ in range(5000):
        text = "".join(pick.choices(tokens, k=pick.randint(0, 20)))
        assert list(numbers._spans(text)) == [(m.start(), m.end(), m[1]) for m in ANY_NUMBER.finditer(text)], text


def test_C6_numbers_of_a_batch_are_an_arrow_array():
    found = number_arrays(["about 5 more, $3 and 7%%", None, ",", "", "1,000"])
    assert found.type.value_type.names == NUMBER_ROW.elementType.names and list(map(len, found.to_pylist())) == [3, 0, 0, 0, 1]
    assert [(x["value"], x["is_currency"], x["is_percentage"], x["position"]) for x in found.to_pylist()[0]] == [(5.0, False, False, 5), (3.0, True, False, 14), (0.07, False, True, 20)]
    assert number_arrays([]).to_pylist() == [] and number_arrays([None]).to_pylist() == [[]]


def test_C6_long_blanks_take_linear_time():
    began = time.process_time()
    assert len(numbers.number_details(pd.Series(["5" + " " * 200_000 + "x"]))[0]) == 1
    assert len(numbers.number_details(pd.Series(["x" + " " * 200_000 + "x 5"]))[0]) == 1
    assert time.process_time() - began < 5


def test_C6_texts_of_a_query_are_made_behind_its_sort(spark, tiny):
    from tallyquill.plans import catalogue

    plan = catalogue.QUERIES["number_units"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "paid $" in plan and "paid $" not in plan[plan.index("Window") :]


def test_C5_texts_without_a_pattern_s_words_are_passed_over_only_then():
    assert dict(numbers.metrics_of("Net INCOME was $3 million; growth rate of 12.5%")) == {"net income": 3e6, "growth rate (%)": 0.125}
    assert dict(numbers.metrics_of("gross ſaleſ of 5"))["gross ſaleſ"] == 5.0  # a long s is an s to the pattern
    words = {"revenue": 1, "rate": 2, "stores": 3}
    pick = random.Random(4)
    for _ in range(2000):
        text = " ".join(pick.choices([*words, "in", "Rate", "5", "6%", "$7", "k", "ſtoreſ", ";", "8 stores", "sales of 9 m"], k=pick.randint(0, 9)))
        letters = [(m.start(), m.end()) for m in numbers._LETTERS.finditer(text)]
        want = {}
        for pattern, stretches, name, value, suffix in ((numbers._AMOUNT, letters, 1, 2, ""), (numbers._PERCENT, letters, 1, 2, " (%)"), (numbers._COUNT, [m.span() for m in numbers._DIGITS.finditer(text)], 2, 1, "")):
            for m in numbers._found(pattern, stretches, text):
                unit = next(x for u, x in numbers.UNITS if u in m[3].lower()) if pattern is numbers._AMOUNT and m[3] else 1.0
                want[m[name].strip().lower() + suffix] = float(m[value].replace(",", "")) * unit / (100 if suffix else 1)
        assert dict(numbers.metrics_of(text)) == want, text


def test_R17_numbers_that_nobody_reads_are_not_extracted(spark, tiny):
    from tallyquill.functions.text import query_analysis
    from tallyquill.operators import engine
    from tallyquill.plans import catalogue
    from pyspark.sql import functions as F

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    nodes = spark.createDataFrame([(1, 2, "b", "s", False, "net revenue of $4 million"), (1, 1, "a", "s", False, "net revenue was 2 million and 7%"), (1, 3, "t", "u", True, "| a | b |\n|---|---|\n| 1 | 2 |")], "query_id int, place int, node_id string, source string, is_table boolean, content string")
    asked = spark.createDataFrame([(1, "q", "financial_metrics: ['net revenue']"), (2, "none", "")], "query_id int, query string, a string").select("query_id", "query", query_analysis(F.col("a")).alias("analysis"))
    out = engine.numeric_operations(nodes, asked)
    got = {r["query_id"]: r for r in out.collect()}
    assert [(m["metric"], m["value"], m["source"], m["node_id"]) for m in got[1]["extracted_metrics"]] == [("net revenue", 2e6, "s", "a"), ("net revenue", 4e6, "s", "b")]
    assert [(n["node_id"], n["value"]) for n in got[1]["extracted_numbers"]][:2] == [("a", 2.0), ("a", 7.0)] and [t["node_id"] for t in got[1]["tables"]] == ["t"]
    assert got[1]["computed"] == {"net revenue_mean": 3e6, "net revenue_median": 3e6, "net revenue_min": 2e6, "net revenue_max": 4e6} and got[2]["extracted_metrics"] == got[2]["tables"] == []
    assert plan(out).count("ArrowEvalPython") == 1 and plan(out).count("found(content") == 2
    assert plan(out.select("query_id", "computed")).count("found(content") == 1
    whole = catalogue.QUERIES["numeric_operations"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert whole.count("Exchange") <= 4
