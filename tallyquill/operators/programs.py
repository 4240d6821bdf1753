"""Arithmetic programs: tokens, evaluation, nesting, equality."""

from __future__ import annotations

import random
from functools import cache, lru_cache
from hashlib import shake_128

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyquill.functions.numbers import number_of, numbers_of, row_numbers

#: P1's operations.
ARITHMETIC = ("add", "subtract", "multiply", "divide", "exp", "greater")
TABLE_OPS = ("table_max", "table_min", "table_sum", "table_average")


def tokenize(program: Column) -> Column:
    """P5: ``"op(a, b), op(#0, c)"`` -> ``["op(", "a", "b", ")", ..., "EOF"]``."""
    found = F.regexp_extract_all(F.replace(program, F.lit(", "), F.lit(",")), F.lit(r"[^(),]*\(|[^(),]+|\)"), 0)
    return F.concat(F.filter(found, lambda t: t != ""), F.array(F.lit("EOF")))


def training_tokens(program: Column) -> Column:
    """Tokens as the training format has them: a later operation keeps the space before it; none is EOF."""
    found = F.regexp_extract_all(program, F.lit(r"[^(),]*\(|[^(),]+|\)"), 0)
    trimmed = F.transform(found, lambda t: F.when(t.endswith("("), t).otherwise(F.regexp_replace(t, r"^\s+|\s+$", "")))
    return F.when(F.coalesce(F.lower(program), F.lit("")).isin("", "none"), F.array(F.lit("EOF"))).otherwise(F.concat(trimmed, F.array(F.lit("EOF"))))


def tokens_text(tokens: Column) -> Column:
    """P8."""
    return F.array_join(tokens, " ")


def _result(op: str, a: float | None, b: float | None, row: list[float] | None) -> float | str | None:
    """What a step gives: a number, yes or no, or None where it has no result."""
    if op in TABLE_OPS:
        if not row:
            return 0.0 if row is not None and op == "table_sum" else None
        return {"table_max": max, "table_min": min, "table_sum": sum}.get(op, lambda r: sum(r) / len(r))(row)
    if a is None or b is None:
        return None
    if op == "greater":
        return "yes" if a > b else "no"
    try:
        got = {"add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b, "divide": lambda: a / b, "exp": lambda: a**b}[op]()
    except (KeyError, ZeroDivisionError, OverflowError):
        return None
    return got if isinstance(got, float) else None


def run_program(tokens: list[str], table: dict[str, list[str]] | None = None) -> tuple[int, float | None, str | None]:
    """P2 for Python callers: (invalid, num, str), not rounded."""
    body = tokens[:-1]
    if len(body) == 1:
        v = number_of(body[0])
        return (1, None, "n/a") if v is None else (0, v, None)
    ops, closing = [t.replace("(", "") for t in body[::4]], body[3::4]
    if any(op not in ARITHMETIC and op not in TABLE_OPS and op != "none" for op in ops) or any(t != ")" for t in closing):
        return 1, None, "n/a"
    got: list[float | str] = []
    for op, first, second in zip(ops, (t.strip(" ") for t in body[1::4]), (t.strip(" ") for t in body[2::4]), strict=False):
        if len(got) == len(closing):
            break  # tokens after the last ")" don't count
        row = numbers_of(table[first]) if table and op in TABLE_OPS and first in table else None
        value = _result(op, _argument(first, got), _argument(second, got), row)
        if value is None:
            break
        got.append(value)
    failed = len(got) < len(closing) or ")" in body[len(closing) * 4 :]
    last = got[-1] if got else None
    if isinstance(last, float):
        return int(failed), last, None
    return int(failed), None, last or "n/a"


def _argument(said: str, got: list) -> float | None:
    """A literal's number, or for ``#n`` the number that step n gave."""
    if "#" not in said:
        return number_of(said)
    n = said.replace("#", "")
    value = got[int(n)] if n.isdigit() and int(n) < len(got) else None
    return value if isinstance(value, float) else None


RESULT = T.StructType([T.StructField("invalid", T.IntegerType()), T.StructField("num", T.DoubleType()), T.StructField("str", T.StringType())])


def evaluate(tokens: Column, table: Column | None = None) -> Column:
    """(invalid, num, str) of a flat program.

    The last token goes unseen. One token left is a number. Else every fourth token has to be an
    operation and every fourth after it ")"; steps run in order, ``#n`` being an earlier result. At
    a fault the last good value stays, with ``invalid`` set. ``table`` maps row names to cells.

    A fold of SQL functions over the steps isn't compiled; a plain loop in Arrow batches is six times as fast.
    """

    @F.pandas_udf(RESULT)
    def ran(programs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None) if p is None else run_program(list(p)) for p in programs], columns=RESULT.names)

    @F.pandas_udf(RESULT)
    def ran_on(programs: pd.Series, tables: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None) if p is None else run_program(list(p), None if t is None else dict(t)) for p, t in zip(programs, tables, strict=True)], columns=RESULT.names)

    return ran(tokens) if table is None else ran_on(tokens, table)


def rounded(result: Column) -> Column:
    """The result with its number rounded to five decimals."""
    return F.struct(result["invalid"].alias("invalid"), F.round(result["num"], 5).alias("num"), result["str"].alias("str"))


def flatten(tokens: Column) -> Column:
    """A nested program as steps, by a stack: ")" pops three tokens, which become a step and leave its ``#n``."""
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def step(acc: Column, t: Column) -> Column:
        size = F.size(acc["stack"])
        close, short = (t == ")") & ~acc["over"], size < 3
        rest = F.slice(acc["stack"], 1, F.greatest(size - 3, F.lit(0)))
        taken = F.slice(acc["stack"], F.greatest(size - 2, F.lit(1)), 3)
        return F.struct(
            F.when(close & ~short, F.concat(rest, F.array(F.concat(F.lit("#"), acc["n"].cast("string"))))).when(acc["over"] | close, acc["stack"]).otherwise(F.concat(acc["stack"], F.array(t))).alias("stack"),
            F.when(close & ~short, F.concat(acc["out"], taken, F.array(F.lit(")")))).otherwise(acc["out"]).alias("out"),
            F.when(close & ~short, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            (acc["over"] | (close & short)).alias("over"),
        )

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def _parsed(tokens: list[str]) -> list[tuple[str, str, str]] | None:
    body = tokens[:-1]
    if len(body) % 4 or not body:
        return None
    steps = []
    for i in range(0, len(body), 4):
        op, a, b, close = body[i : i + 4]
        if op.strip("(") not in (*ARITHMETIC, *TABLE_OPS, "none") or close != ")" or "(" in a + b:
            return None
        steps.append((op.strip("("), a.strip(), b.strip()))
    return steps


#: Bits that a prime has beyond the steps of a program; two expressions that differ are taken as equal with a chance of 1 in 2 to this power.
SPARE_BITS = 128


@cache
def _prime(bits: int) -> int:
    """A prime of this many bits, chosen at random once for all."""
    choose = random.Random(bits)
    small = [p for p in range(3, 2000, 2) if all(p % q for q in range(3, int(p**0.5) + 1, 2))]
    while True:
        n = choose.getrandbits(bits) | 1 << (bits - 1) | 1
        if all(n % p for p in small) and all(pow(base, n - 1, n) == 1 for base in (2, 3, 5, 7, 11)):
            return n


def _modulus(steps: int) -> int:
    """A prime above 2 to the power of ``steps`` + ``SPARE_BITS``, the next of the sizes that double from 256 bits on."""
    bits = 256
    while bits < steps + SPARE_BITS and bits < 2048:
        bits *= 2
    if bits >= steps + SPARE_BITS:
        return _prime(bits)
    return 2 ** next((e for e in MERSENNE if e >= steps + SPARE_BITS), MERSENNE[-1]) - 1


#: Exponents of Mersenne primes, for longer programs.
MERSENNE = (2203, 4423, 9689, 11213, 19937, 21701, 44497, 86243)


@lru_cache(1 << 16)
def _point(name: tuple, p: int) -> int:
    """The value of an operand, the same in all programs."""
    return int.from_bytes(shake_128(repr(name).encode()).digest(p.bit_length() // 8 + 16), "big") % p


def _at_point(steps: list, p: int) -> int | None:
    """What the last step stands for, as a function of the operands, at a random point modulo ``p``; None if it has no meaning.

    An operand's value is a hash of its name, so it is the same in all programs. Sums, products and
    quotients are those of the field; a table step, a power or a comparison is an operand of its own, named by what it
    is made of. Only the steps that the last one needs count.
    """
    point = lambda *name: _point(name, p)
    value: dict[int, int] = {}
    todo, entered = [len(steps) - 1], set()
    while todo:
        i = todo[-1]
        op, a, b = steps[i]
        if i in value:
            todo.pop()
            continue
        if op in TABLE_OPS:
            value[i] = point(op, a, b)
            continue
        needs = [int(x.replace("#", "")) if "#" in x else None for x in (a, b)]
        if any(n is not None and not 0 <= n < len(steps) for n in needs):
            return None
        open_ = [n for n in needs if n is not None and n not in value]
        if open_:
            if i in entered:
                return None  # steps that need each other
            entered.add(i)
            todo += open_
            continue
        x, y = (point(s) if n is None else value[n] for s, n in zip((a, b), needs, strict=True))
        if op == "divide" and not y:
            return None
        if op == "add":
            value[i] = (x + y) % p
        elif op == "subtract":
            value[i] = (x - y) % p
        elif op == "multiply":
            value[i] = x * y % p
        else:
            value[i] = x * pow(y, -1, p) % p if op == "divide" else point(op, x, y)
    return value[len(steps) - 1]


def programs_equal(gold: list[str], pred: list[str]) -> bool:
    """Whether two programs mean the same expression of the gold program's operands.

    The prediction may use no other operands or table steps, and refer only to steps before. Two quotients
    of polynomials are the same if they agree at a random point modulo a random prime: a program of n steps has
    a degree of at most 2^n, so two that differ agree with a chance below 2^-``SPARE_BITS``. This takes a step's
    time a step, where multiplying out doubles with each squaring. Powers and comparisons count as symbols of
    what they are made of.
    """
    gold, pred = list(gold), list(pred)
    if len(gold) == 2:
        return len(pred) == 2 and gold[0] == pred[0]
    a, b = _parsed(gold), _parsed(pred)
    if not a or not b:
        return False
    operands = {x for op, p, q in a if op not in TABLE_OPS for x in (p, q) if "#" not in x}
    tables = {s for s in a if s[0] in TABLE_OPS}
    for i, (op, p, q) in enumerate(b):
        if op in TABLE_OPS:
            if (op, p, q) not in tables:
                return False
            continue
        for x in (p, q):
            if "#" in x:
                if not x.strip("#").isdigit() or int(x.strip("#")) >= i:
                    return False
            elif x not in operands:
                return False
    p = _modulus(max(len(a), len(b)))
    try:
        meant = _at_point(a, p)
        return meant is not None and meant == _at_point(b, p)
    except ValueError:  # a reference that is no number
        return False


def equal(gold: Column, pred: Column) -> Column:
    """P4 as a column."""

    @F.pandas_udf(T.BooleanType())
    def same(g: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and programs_equal(x, y) for x, y in zip(g, p, strict=True)])

    return same(gold, pred)


def scores(df: DataFrame, gold: str = "gold", pred: str = "pred", answer: str = "exe_ans", table: str | None = None) -> DataFrame:
    """P10: per row whether the result and the program are right; ``sound`` is false where equal programs differ in value."""
    out = df.withColumn("__r", rounded(evaluate(F.col(pred), F.col(table) if table else None)))
    number, said = F.col("__r.num") == F.round(F.col(answer).try_cast("double"), 5), F.col("__r.str") == F.col(answer).cast("string")
    valid = F.col("__r.invalid") == 0
    out = out.withColumns({"invalid": F.col("__r.invalid"), "result_right": F.coalesce(number, said, F.lit(False)), "exe_right": valid & F.coalesce(number, said, F.lit(False)), "prog_right": valid & equal(F.col(gold), F.col(pred))}).drop("__r")
    return out.withColumn("sound", ~F.col("prog_right") | F.col("exe_right"))


def with_gold(predictions: DataFrame, gold: DataFrame, key: str = "id") -> DataFrame:
    """Predictions with the gold row of their id; an id twice in ``gold``, or missing there, fails the query.

    Both are checked where the rows meet: gold rows are counted by id in the join's own partitioning,
    and predictions that find none raise.
    """
    data = [c for c in gold.columns if c != key]
    once = gold.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *(F.first(c).alias(c) for c in data))
    met = predictions.join(once, key, "left")
    said = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    fine = F.when(F.col("__n").isNull(), said("no gold row for id")).when(F.col("__n") > 1, said("several gold rows for id")).otherwise(F.lit(True)).cast("boolean")
    return met.where(fine).drop("__n")


def nested_scores(df: DataFrame, gold: str = "gold", pred: str = "pred", **options) -> DataFrame:
    """P10 for nested programs: both are made flat first; a prediction's EOF is dropped if it is there, gold's always."""
    body = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    closed = lambda c: F.concat(flatten(c), F.array(F.lit("EOF")))
    said = F.when(F.element_at(pred, -1) == "EOF", body(F.col(pred))).otherwise(F.col(pred))
    return scores(df.withColumns({pred: closed(said), gold: closed(body(F.col(gold)))}), gold, pred, **options)


def accuracies(scored: DataFrame) -> DataFrame:
    """The shares of right results and of right programs among all predictions, and how many equal programs differ in value."""
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return scored.agg(F.count(F.lit(1)).alias("n"), share("exe_right").alias("exe_acc"), share("prog_right").alias("prog_acc"), F.count_if(~F.col("sound")).alias("unsound"))


def table_stats(cells: Column) -> Column:
    """Max, min, sum and average of a row of cells, null if a cell is no number."""
    v = row_numbers(cells)
    total = F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    return F.struct(F.array_max(v).alias("max"), F.array_min(v).alias("min"), total.alias("sum"), (total / F.when(F.size(v) > 0, F.size(v))).alias("average"))
