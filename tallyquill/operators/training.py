"""Training data: conversations, masks, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyquill.functions.outputs import block as tagged_text
from tallyquill.functions.text import CONTEXT_OPENING, canonical_answer, let, tagged
from tallyquill.functions.tokenizers import Tokenizer, tokenized
from tallyquill.operators.programs import ARITHMETIC, tokens_text, training_tokens


def conversations(turns: DataFrame, system: str = "", is_test: bool = False) -> DataFrame:
    """Turns (id, turn, question, program, answer, context) -> (id, system, conversations).

    The first question carries the context. Every turn gets a human and an assistant message; in
    test data turns without an answer get the human one only. Dialogues of fewer than two messages
    (one in test data) are left out.
    """
    first = F.row_number().over(Window.partitionBy("id").orderBy("turn")) == 1
    opening = F.concat(F.lit(CONTEXT_OPENING), F.col("context"), F.lit("\n\n"), F.col("question"))
    human = F.struct(F.lit("human").alias("role"), F.when(first, opening).otherwise(F.col("question")).alias("content"))
    reply = tagged(tokens_text(training_tokens(F.coalesce("program", F.lit("")))), canonical_answer(F.coalesce(F.col("answer").cast("string"), F.lit("N/A"))))
    assistant = F.struct(F.lit("assistant").alias("role"), reply.alias("content"))
    both = F.array(human, assistant)
    messages = F.when(F.col("answer").isNull(), F.array(human)).otherwise(both) if is_test else both
    rows = turns.where(F.col("question").isNotNull()).withColumn("ms", messages)
    built = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "ms"))).alias("all"))
    built = built.select("id", F.lit(system).alias("system"), F.flatten(F.transform("all", lambda t: t["ms"])).alias("conversations"))
    return built.where(F.size("conversations") >= (1 if is_test else 2))


def with_splits(**parts: DataFrame) -> DataFrame:
    """D3: one table of several splits."""
    out = None
    for name, df in parts.items():
        part = df.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    """Cut or filled to a length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def marker_at(ids: Column, marker: Column) -> Column:
    """The first place (from 0) where the marker begins, null if nowhere.

    Ids and marker are compared as text between separators, which one compiled search does.
    """
    said = lambda a: F.concat(F.lit(","), F.array_join(F.transform(a, lambda x: x.cast("string")), ",", "null"), F.lit(","))
    place = F.instr(said(ids), said(marker))
    before = F.substring(said(ids), F.lit(1), place)
    return F.when(place > 0, F.length(before) - F.length(F.replace(before, F.lit(","))) - 1)


def response_labels(ids: Column, marker: Column, masked: int = -100) -> Column:
    """The ids from the first marker on, all before (without a marker: all) masked."""
    at = F.coalesce(marker_at(ids, marker), F.size(ids))
    return let(at, lambda begin: F.transform(ids, lambda x, i: F.when(i >= begin, x).otherwise(F.lit(masked))))  # sought once, not once an id


def response_at(text: Column, instruction: str, response: str) -> Column:
    """The code point (from 0) of the first response marker behind the first instruction marker, null without either."""
    begun = F.instr(text, instruction)
    found = F.when(begun > 0, F.call_function("locate", F.lit(response), text, (begun + len(instruction)).cast("int")))
    return F.when(found > 0, found - 1)


def text_labels(text: Column, tokens: Column, instruction: str, response: str, masked: int = -100) -> Column:
    """The ids from the response marker on, as it is found in the text; all before masked.

    ``tokens`` has ids, starts and ends. The first token that ends behind the marker's beginning is the first one
    that counts, so a token that holds the end of the instruction and the marker's beginning does. Null where
    the text has no instruction marker, or no response marker behind it: such a row stays as it is.
    """
    at = response_at(text, instruction, response)
    before = let(at, lambda a: F.size(F.filter(tokens["ends"], lambda e: e <= a)))  # ends ascend
    labels = let(before, lambda n: F.transform(tokens["ids"], lambda x, i: F.when(i >= n, x).otherwise(F.lit(masked))))
    return F.when(at.isNotNull(), labels)


def attention(ids: Column, length: int) -> Column:
    """Ones for the ids that are left of a length, zeros for what fills it up."""
    n = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def training_rows(rows: DataFrame, tokenizer: Tokenizer, length: int, text_col: str = "text", pad: int = 0, markers: tuple[str, str] | None = None, masked: int = -100) -> DataFrame:
    """Adds ``input_ids`` and ``attention_mask`` of a length, and ``labels`` where ``markers`` gives those of instruction and response.

    Texts are encoded once and whole, in Arrow batches; of their tokens those within the length leave the workers, as no
    later one is in a result. Filling and masking are columns. A row whose markers aren't found has null labels and is
    otherwise like the others. Null text has nulls throughout.
    """
    out = rows.withColumn("__t", tokenized(F.col(text_col), tokenizer, length))
    ids = F.col("__t.ids")
    added = {"input_ids": padded(ids, length, pad), "attention_mask": F.when(ids.isNotNull(), attention(ids, length))}
    if markers:
        added["labels"] = padded(text_labels(F.col(text_col), F.col("__t"), *markers, masked=masked), length, masked)
    return out.withColumns(added).drop("__t")


def safe_ids(ids: Column, vocabulary: int) -> Column:
    """No negative ids or nulls; too large ones become the last id."""
    return F.transform(F.filter(ids, lambda x: x.isNotNull() & (x >= 0)), lambda x: F.least(x, F.lit(vocabulary - 1)))


def argmax(scores: Column) -> Column:
    """The first place of the largest score."""
    return F.array_position(scores, F.array_max(scores)) - 1


def unmasked(labels: Column, masked: int = -100) -> Column:
    """The labels that count."""
    return F.filter(labels, lambda x: x != masked)


def same_length(ids: Column, mask: Column) -> Column:
    """Both cut to the shorter one."""
    n = F.least(F.size(ids), F.size(mask))
    return F.struct(F.slice(ids, 1, n).alias("ids"), F.slice(mask, 1, n).alias("mask"))


def markers_in_order(text: Column, *markers: str) -> Column:
    """Whether all markers are there, each after the one before."""
    places = [F.instr(text, m) for m in markers]
    ok = places[0] > 0
    for a, b in zip(places, places[1:], strict=False):
        ok = ok & (b > a)
    return ok


def split_of(id_col: Column, percent: int, seed: int = 0) -> Column:
    """O3: "eval" for about ``percent`` of the ids, the same ones on every run and in every engine that has MD5."""
    digest = F.md5(F.concat_ws(":", id_col.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.when(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 < percent, "eval").otherwise("train")


def calling_rules(operations: tuple[str, ...] = ARITHMETIC[:4]) -> str:
    """The system prompt of the function-calling variant: the tags to answer in, and the tools with an example each."""
    listed = "\n".join(f"- {op}: {op}( number1 number2 ) EOF" for op in operations)
    shape = tagged_text("operation( number1 number2 ) EOF", "number")
    return f"You decide which tools answer a question on financial data. These are the tools:\n{listed}\n\nAnswer in this form and with nothing else:\n{shape}\n\n#0, #1 and so on stand for the results of earlier calls. Every program ends with EOF.\n"


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """O3: at most ``n`` rows, the first ones of a total order, as a limit on training examples."""
    return df.orderBy(*order).limit(n)
