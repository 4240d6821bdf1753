"""Scores and profiles of predictions; metric statistics."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyquill.functions.numbers import metrics_of
from tallyquill.functions.text import strip, to_double, training_answer, validate_format
from tallyquill.store import once


def similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def answer_match(pred: Column, label: Column, tolerance: float = 0.01, similar: Column | None = None) -> Column:
    """A10: (num, str) structs as ``training_answer`` gives them. Numbers by tolerance; texts equal, one in the other, or similar."""
    number = lambda s: to_double(F.regexp_replace(s, r"[^\d.-]", ""))
    p = F.coalesce(pred["num"], F.when(label["num"].isNotNull(), number(pred["str"])))
    g = F.coalesce(label["num"], F.when(pred["num"].isNotNull(), number(label["str"])))
    a, b = F.lower(strip(pred["str"])), F.lower(strip(label["str"]))
    texts = (a == b) | b.contains(a) | a.contains(b)
    if similar is not None:
        texts = texts | (similar > 0.8)
    near = F.abs(p - g) <= tolerance * F.greatest(F.lit(1.0), F.abs(g))
    return F.coalesce(F.when(p.isNotNull() & g.isNotNull(), near).when(pred["num"].isNull() & label["num"].isNull(), texts), F.lit(False))


def with_matches(df: DataFrame, pred: str = "pred", label: str = "label", fuzzy: bool = True) -> DataFrame:
    """Adds pred_ans, label_ans, answer_match and program_match; similarity is computed for the rows that nothing else decides."""
    df = df.withColumns({"pred_ans": training_answer(F.col(pred)), "label_ans": training_answer(F.col(label))})
    sure = answer_match(F.col("pred_ans"), F.col("label_ans"))
    if fuzzy:
        df = df.withColumn("__sure", sure)
        rest = ~F.col("__sure") & F.col("pred_ans.num").isNull() & F.col("label_ans.num").isNull()
        ratio = similarity(F.when(rest, F.lower(strip(F.col("pred_ans.str")))), F.when(rest, F.lower(strip(F.col("label_ans.str")))))
        df = df.withColumn("answer_match", F.col("__sure") | F.coalesce(ratio > 0.8, F.lit(False))).drop("__sure")
    else:
        df = df.withColumn("answer_match", sure)
    return df.withColumn("program_match", program_words(F.col(pred)) == program_words(F.col(label)))


def program_words(c: Column) -> Column:
    """the words of the program's tag; EOF where there is no tag."""
    tag = r"(?s)<begin_of_program>\s*(.*?)\s*<end_of_program>"
    words = F.filter(F.split(F.regexp_extract(c, tag, 1), r"\s+"), lambda t: t != "")
    return F.when(F.coalesce(c, F.lit("")).rlike(tag), words).otherwise(F.array(F.lit("EOF")))


def match_rates(df: DataFrame) -> DataFrame:
    """Percentages of program and answer matches."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return df.agg((F.count_if("program_match") / n * 100).alias("program_match"), (F.count_if("answer_match") / n * 100).alias("answer_match"))


def profile(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Counts of predictions by kind, and their percentages; blank ones count as empty only."""
    p, g = training_answer(F.col(pred)), training_answer(F.col(label))
    blank = ~F.coalesce(F.col(pred), F.lit("")).rlike(r"\S")
    count = lambda c: F.count_if(~blank & F.coalesce(c, F.lit(False)))
    counts = df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.lit(0).cast("long").alias("program_token_matches"),
        count(p["num"].isNotNull()).alias("numerical_answers"),
        count(p["num"].isNull() & (p["str"] != "")).alias("string_answers"),
        count(p["num"].isNotNull() != g["num"].isNotNull()).alias("answer_type_mismatches"),
        F.count_if(blank).alias("empty_predictions"),
        count(F.col(pred) == F.col(label)).alias("exact_matches"),
        count(validate_format(F.col(pred))).alias("format_valid"),
    )
    total = F.greatest(F.col("total_samples"), F.lit(1))
    return counts.select("*", *((F.col(c) / total * 100).alias(f"{c}_pct") for c in counts.columns))


def metric_values(nodes: DataFrame, id_col: str = "node_id", text_col: str = "content") -> DataFrame:
    """(node_id, metric, value); in a node the last value of a metric counts.

    A row's metrics are settled in the row, so nothing is shuffled.
    """
    rows = nodes.select(F.col(id_col).alias("node_id"), F.col(text_col).alias("content"))
    schema = T.StructType([rows.schema["node_id"], T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])

    def read(batches):
        for b in batches:
            found = [metrics_of(t) for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            metric, value = zip(*(m for f in found for m in f), strict=True) if len(at) else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(metric, pa.string()), pa.array(value, pa.float64())], schema.names)

    return rows.mapInArrow(read, schema)


#: Bits of a value's key that a round of ``medians`` settles, and ways into which the values of a bucket are dealt.
STEP, WAYS = 16, 32


def order_key(value: Column) -> Column:
    """A whole number in the order of doubles: their bits, turned round below zero."""

    @F.pandas_udf("long")
    def run(v: pd.Series) -> pd.Series:
        bits = v.to_numpy(np.float64).view(np.int64)
        return pd.Series(np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits))

    return run(value)


def medians(counted: DataFrame, by: str = "metric") -> DataFrame:
    """The exact median of each metric from (metric, value, n), the value's count: (metric, median).

    Values are looked at as 64-bit keys in their order. A histogram by the first 16 bits, of at most 65,536
    buckets a metric, tells in which bucket the middle rank lies; only the values in it are counted by the next
    16 bits, and so on. So no task holds a metric's values, however many it has: they are counted where they are,
    and the buckets of one round meet alone. An even number of values has two middle ranks, which may go separate ways.
    """
    keyed = once(counted.select(by, "value", "n", order_key(F.col("value")).alias("key")).withColumn("way", F.pmod(F.xxhash64("key"), F.lit(WAYS)).cast("int")), "keyed")
    n = keyed.groupBy(by).agg(F.sum("n").alias("n"))
    rank = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))))
    wanted = n.select(by, rank.alias("rank")).withColumn("prefix", F.lit(None).cast("long"))
    for left in range(64 - STEP, -1, -STEP):
        rows = keyed
        if left < 64 - STEP:
            every = wanted.select(by, "prefix").distinct().withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
            rows = keyed.withColumn("prefix", F.shiftright("key", left + STEP)).join(every, [by, "prefix", "way"])
        else:
            rows = keyed.withColumn("prefix", F.lit(None).cast("long"))
        buckets = rows.groupBy(by, "prefix", F.shiftright("key", left).alias("bucket")).agg(F.sum("n").alias("n"), F.min("value").alias("value"))
        upto = F.sum("n").over(Window.partitionBy(by, "prefix").orderBy("bucket"))
        buckets = buckets.withColumn("upto", upto)
        within = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
        met = wanted.select(by, "rank", "prefix").alias("w").join(buckets.alias("b"), (F.col(f"w.{by}") == F.col(f"b.{by}")) & F.col("w.prefix").eqNullSafe(F.col("b.prefix"))).where(within)
        wanted = once(met.select(F.col(f"w.{by}").alias(by), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.col("bucket").alias("prefix"), "value"), "middle")
    return wanted.groupBy(by).agg(F.avg("value").alias("median"))


def metric_stats(values: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Mean, median, min and max by metric, of the wanted metrics where these are given.

    Equal values are counted first; sums are taken where the values are, and ``medians`` finds the middle.
    """
    if wanted is not None:
        values = values.join(wanted.select("metric").distinct(), "metric", "left_semi")
    counted = once(values.where(F.col("value").isNotNull()).groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n")), "counted")
    n = F.sum("n")
    sums = counted.groupBy("metric").agg((F.sum(F.col("value") * F.col("n")) / n).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), n.alias("n"))
    return sums.join(medians(counted), "metric").select("metric", "mean", "median", "min", "max", "n")
