"""Dialogue evaluation: turns, history, providers, accuracy."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyquill.functions.text import extract_answer, is_answer_correct
from tallyquill.store import once


def turns_of(dialogues: DataFrame, questions: str, answers: str, id_col: str = "id") -> DataFrame:
    """Parallel arrays as turns (id, turn, question, gold), cut to the shorter array."""
    n = F.least(F.size(questions), F.size(answers))
    zipped = F.slice(F.arrays_zip(F.col(questions).alias("question"), F.col(answers).alias("gold")), 1, F.greatest(n, F.lit(0)))
    return dialogues.select(F.col(id_col).alias("id"), F.posexplode(zipped).alias("turn", "t")).select("id", "turn", "t.question", F.col("t.gold").cast("string").alias("gold"))


def paired_turns(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text): each user turn with the assistant turn right after it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    m = messages.withColumns({"next_role": F.lead("role").over(order), "reply": F.lead("text").over(order)})
    asked = m.where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    return asked.select(F.col("conv_id").alias("id"), "turn", F.col("text").alias("question"), "reply")


def with_history(turns: DataFrame, question: str = "question", predicted: str = "predicted") -> DataFrame:
    """All earlier (question, predicted) pairs of the dialogue."""
    earlier = Window.partitionBy("id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("history", F.collect_list(F.struct(F.col(question).alias("question"), F.col(predicted).alias("predicted"))).over(earlier))


def previous_question(question: str = "question") -> Column:
    """W2."""
    return F.lag(question).over(Window.partitionBy("id").orderBy("turn"))


#: The mock's rules, in order: words of the question, words of the one before, answer.
MOCK_RULES = (
    (("cash", "operating activities", "2009"), (), "$206,588"),
    (("cash", "operating activities", "2008"), (), "$181,001"),
    (("difference",), ("cash",), "25,587"),
    (("percentage",), ("difference",), "14.1%"),
    (("operating income", "2011"), (), "1,314"),
    (("operating income", "2010"), (), "1,194"),
    (("difference",), ("operating income",), "120"),
    (("percentage increase",), ("operating income",), "10.1%"),
)


def mock_response(question: Column, before: Column) -> Column:
    """Rules over the question and the one before; the first that fits answers."""
    said = F.lit("Unable to find answer in context")
    for words, earlier, answer in reversed(MOCK_RULES):
        fits = F.lit(True)
        for w in words:
            fits = fits & F.lower(question).contains(w)
        for w in earlier:
            fits = fits & F.coalesce(F.lower(before).contains(w), F.lit(False))
        said = F.when(fits, F.lit(answer)).otherwise(said)
    return F.concat(F.lit("<answer>"), said, F.lit("</answer>"))


def mock_answers(turns: DataFrame) -> DataFrame:
    """The mock provider: it needs the question before only, so it is a window expression."""
    asked = turns.withColumn("__before", previous_question())
    return asked.withColumn("predicted", extract_answer(mock_response(F.col("question"), F.col("__before")))).drop("__before")


def provider_answers(turns: DataFrame, answer: Callable[[str, str, list], str], history_col: str | None = None) -> DataFrame:
    """A provider that sees its own earlier answers: sequential within a dialogue, parallel over dialogues.

    ``answer(question, context, history)`` is the user's; ``turns`` has id, turn, question, context, and in
    ``history_col``, if it is given, what each dialogue's history begins with.
    """
    schema = T.StructType([*turns.schema.fields, T.StructField("predicted", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, history, out = pdf.sort_values("turn"), [], []
        if history_col:
            history = [(h["question"], h["predicted"]) for h in pdf[history_col].iloc[0]]
        for row in pdf.itertuples():
            said = answer(row.question, row.context, list(history))
            history.append((row.question, said))
            out.append(said)
        return pdf.assign(predicted=out)

    return turns.groupBy("id").applyInPandas(run, schema)


#: Dialogues that a round has to have for being worth one.
FEW = 16


def provider_rounds(turns: DataFrame, answer_all: Callable[[list[tuple[str, str, list]]], list[str]], few: int = FEW) -> DataFrame:
    """``provider_answers`` in rounds: first the first turn of all dialogues, then the second of all that have one, and so on.

    A round is a batch for the provider: ``answer_all`` gets (question, context, history) of all turns in
    an Arrow batch and gives their answers. What it said is written once a round; the next one reads the histories from
    there, so no round is asked again, and a lost executor costs the round it was in. There are as many rounds as
    turns that ``few`` dialogues or more have; the last turns of the few longest dialogues go on one by one,
    each dialogue for itself.
    """
    place = F.row_number().over(Window.partitionBy("id").orderBy("turn"))
    data = turns.columns
    numbered = once(turns.withColumn("__round", place), "turns")
    counts = numbered.groupBy("__round").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= few)
    rounds = counts.agg(F.max("__round").alias("last")).first()["last"] or 0
    turn = "array<struct<question:string,predicted:string>>"
    before = numbered.select(F.col("id").alias("__id")).distinct().withColumn("__history", F.array().cast(turn))
    same = F.col("id").eqNullSafe(F.col("__id"))
    done = []
    for r in range(1, rounds + 1):
        now = numbered.where(F.col("__round") == r).drop("__round").join(before, same).select(*data, "__history")
        said = once(now.mapInArrow(_asker(answer_all, data.index("question"), data.index("context"), len(data)), T.StructType([*now.schema.fields, T.StructField("predicted", T.StringType())])), "round")
        done.append(said.select(*data, "predicted"))
        before = said.select(F.col("id").alias("__id"), F.concat("__history", F.array(F.struct("question", "predicted"))).cast(turn).alias("__history"))
    rest = numbered.where(F.col("__round") > rounds).drop("__round").join(before, same).select(*data, "__history")
    one = lambda question, context, history: answer_all([(question, context, history)])[0]
    out = provider_answers(rest, one, "__history").select(*data, "predicted")
    for said in done:
        out = out.union(said)
    return out


def _asker(answer_all, question: int, context: int, history: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                held = [[(h["question"], h["predicted"]) for h in hs] for hs in b.column(history).to_pylist()]
                said = answer_all(list(zip(b.column(question).to_pylist(), b.column(context).to_pylist(), held, strict=True)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], [*b.schema.names, "predicted"])

    return run


def judged(turns: DataFrame, tolerance: float = 0.01) -> DataFrame:
    return turns.withColumn("is_correct", is_answer_correct(F.col("predicted"), F.col("gold"), tolerance))


def per_dialogue(judged_turns: DataFrame) -> DataFrame:
    """A1, A4: per dialogue counts, accuracy, and whether the first and the last turn are right."""
    right = F.col("is_correct").cast("int")
    n = judged_turns.groupBy("id").agg(
        F.sum(right).cast("long").alias("correct_count"),
        F.count(F.lit(1)).alias("total_turns"),
        F.min_by(right, "turn").alias("first_correct"),
        F.max_by(right, "turn").alias("last_correct"),
    )
    return n.withColumn("accuracy", F.coalesce(F.try_divide("correct_count", "total_turns"), F.lit(0.0)))


def corpus_metrics(dialogues: DataFrame) -> DataFrame:
    """A2-A4 over ``per_dialogue`` rows (dialogues without turns count in every mean)."""
    zero = lambda c: F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(0)).cast("double")), F.lit(0.0))
    return dialogues.agg(
        F.coalesce(F.try_divide(F.sum("correct_count"), F.sum("total_turns")), F.lit(0.0)).alias("overall_accuracy"),
        zero("accuracy").alias("avg_example_accuracy"),
        zero("first_correct").alias("first_turn_accuracy"),
        zero("last_correct").alias("last_turn_accuracy"),
        F.coalesce(F.sum("correct_count"), F.lit(0)).alias("total_correct"),
        F.coalesce(F.sum("total_turns"), F.lit(0)).alias("total_turns"),
        F.count(F.lit(1)).alias("examples_evaluated"),
    )
