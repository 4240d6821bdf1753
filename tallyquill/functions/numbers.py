"""Numbers in text: extraction, units, table cells."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyquill.functions.text import let

#: The pattern of a number, and those of named metrics.
NUMBER_PATTERN = r"(?:\$\s*)?(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)(?:\s*%)?"
AMOUNT = r"(?i)([a-z\s]+(?:revenue|income|profit|loss|sales|earnings|assets|liabilities|equity|margin|ratio|expense|cost|dividend|yield|return|growth))(?:\s*(?:was|of|:|is|at|reached))?\s*(?:\$|USD)?\s*([\d,]+\.?\d*)\s*(million|billion|thousand|m|b|k)?"
PERCENT = r"(?i)([a-z\s]+(?:rate|margin|percentage|ratio|growth|yield|return|increase|decrease))(?:\s*(?:was|of|:|is|at|reached))?\s*([\d,]+\.?\d*)\s*%"
COUNT = r"(?i)([\d,]+\.?\d*)\s+([a-z\s]+(?:employees|customers|stores|units|years|months|days|ratio|index|score|rating))"
ANY_NUMBER = re.compile(r"(?:(?:\$|USD)?\s*([\d,]+\.?\d*)\s*(?:million|billion|thousand|m|b|k|%)?)")
UNITS = (("billion", 1e9), ("million", 1e6), ("thousand", 1e3), ("b", 1e9), ("m", 1e6), ("k", 1e3))


def numbers_in(text: Column) -> Column:
    """The numbers of a text; the first alternative takes three digits of a run without commas."""
    found = F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), 1)
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def unit_factor(unit: Column) -> Column:
    """C7."""
    u = F.lower(unit)
    return F.when(u.contains("billion") | (u == "b"), 1e9).when(u.contains("million") | (u == "m"), 1e6).when(u.contains("thousand") | (u == "k"), 1e3).otherwise(1.0)


#: The patterns above as they are applied to one stretch of letters, or one number, at a time.
_AMOUNT, _PERCENT, _COUNT = (re.compile(p) for p in (AMOUNT, PERCENT, COUNT))
#: One of these words is in a text that a pattern matches.
_AMOUNT_WORDS, _PERCENT_WORDS, _COUNT_WORDS = (max(re.findall(r"\(\?:([a-z|]+)\)", p), key=len).split("|") for p in (AMOUNT, PERCENT, COUNT))
_LETTERS, _DIGITS = re.compile(r"[a-z\s]+", re.I), re.compile(r"[\d,]+")


def _found(pattern: re.Pattern, stretches: list[tuple[int, int]], text: str):
    """All matches of a pattern that begins with a stretch of letters or of digits, in linear time.

    If it matches from some place in a stretch of letters it does from the first one, so one try a
    stretch is enough.
    """
    done = 0
    for start, end in stretches:
        at = start if start > done else done
        if at < end and (m := pattern.match(text, at)):
            done = m.end()
            yield m


def metrics_of(text: str | None) -> list[tuple[str, float]]:
    """C5 for Python callers: (metric, value), amounts, then percentages (as shares), then counts; the last value of a name counts."""
    out: dict[str, float] = {}
    if not text or not (digits := [m.span() for m in _DIGITS.finditer(text)]):
        return []
    low = text.lower() if text.isascii() else None  # other letters fold in other ways
    asked = lambda words: low is None or any(w in low for w in words)
    amounts, percents = asked(_AMOUNT_WORDS), "%" in text and asked(_PERCENT_WORDS)
    ended = text + " "  # stretches of letters that a number can follow
    letters = [(m.start(), e) for m in _LETTERS.finditer(text) if (c := ended[e := m.end()]) in ":$," or c.isdigit()] if amounts or percents else []
    for pattern, stretches, name, value, suffix in ((_AMOUNT, letters if amounts else [], 1, 2, ""), (_PERCENT, letters if percents else [], 1, 2, " (%)"), (_COUNT, digits if asked(_COUNT_WORDS) else [], 2, 1, "")):
        for m in _found(pattern, stretches, text):
            try:
                number = float(m[value].replace(",", ""))
            except ValueError:
                continue
            if suffix:
                number /= 100
            elif pattern is _AMOUNT and m[3]:
                number *= next(x for unit, x in UNITS if unit in m[3].lower())
            out[m[name].strip().lower() + suffix] = number
    return list(out.items())


METRIC_ROW = T.ArrayType(T.StructType([T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())]))


def metrics_in(text: Column) -> Column:
    """An array of (metric, value) per text. Matches that may not overlap need the match's end, so this runs in Arrow batches."""

    @F.arrow_udf(METRIC_ROW)
    def found(texts: pa.Array) -> pa.Array:
        told = [metrics_of(t) for t in texts.to_pylist()]
        parts = [pa.array([x[i] for some in told for x in some], t) for i, t in enumerate((pa.string(), pa.float64()))]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, told)]), pa.int32()), pa.StructArray.from_arrays(parts, METRIC_ROW.elementType.names))

    return found(text)


NUMBER_ROW = T.ArrayType(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("is_currency", T.BooleanType()), T.StructField("is_percentage", T.BooleanType()), T.StructField("context", T.StringType()), T.StructField("position", T.IntegerType())]))
#: How far around a match its context reaches, and how far behind it a unit counts.
AROUND, UNIT_REACH = 30, 10
#: Fixed value: ``ANY_NUMBER`` from its digits on, which a search finds by their first character.
_FROM_DIGITS = re.compile(r"([\d,][\d,]*\.?\d*)\s*(?:million|billion|thousand|m|b|k|%)?")


def _spans(text: str):
    """(start, end, digits) of the matches of ``ANY_NUMBER``, in linear time.

    What may stand before the digits has none in it, so a match is found by its first digit and reaches back over blanks
    and a sign, at most to the end of the match before.
    """
    done = 0
    for m in _FROM_DIGITS.finditer(text):
        gap = text[done : m.start()].rstrip()
        start = done + len(gap) - (1 if gap.endswith("$") else 3 if gap.endswith("USD") else 0)
        done = m.end()
        yield start, done, m[1]


def _factor(behind: str) -> float:
    for unit, factor in UNITS:
        if unit in behind:
            return factor
    return 1.0


def number_arrays(texts: list[str | None]) -> pa.ListArray:
    """All numbers of each text, with their context, place, unit and signs, as an Arrow array.

    Each property is a function of the two ends of a match: the unit is sought in what the match
    left over, where the words come before the letters; a percent sign counts right behind it, a
    dollar sign inside it or beside it.
    """
    digits, factors, currency, percentage, contexts, places, rows = [], [], [], [], [], [], []
    for row, text in enumerate(texts):
        if not text:
            continue
        for start, end, number in _spans(text):
            behind = text[end : end + UNIT_REACH]
            digits.append(number.replace(",", ""))
            factors.append(_factor(behind))
            percentage.append(behind.startswith("%"))
            currency.append("$" in text[max(start - 1, 0) : end + 1])
            contexts.append(text[max(start - AROUND, 0) : end + AROUND].strip())
            places.append(start)
            rows.append(row)
    values = pd.to_numeric(pd.Series(digits, dtype=object), errors="coerce").to_numpy(np.float64)
    read = ~np.isnan(values)
    percent = np.array(percentage, bool)
    values = values * (np.array(factors, np.float64) / np.where(percent, 100.0, 1.0))
    parts = [pa.array(values), pa.array(currency, pa.bool_()), pa.array(percent), pa.array(contexts, pa.string()), pa.array(places, pa.int32())]
    found = pa.StructArray.from_arrays(parts, NUMBER_ROW.elementType.names)
    if not read.all():
        found = found.filter(pa.array(read))
    counts = np.bincount(np.array(rows, np.int64)[read], minlength=len(texts))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), found)


def number_details(texts: pd.Series) -> pd.Series:
    """``number_arrays`` for Python callers."""
    return pd.Series(number_arrays([t or None for t in texts]).to_pylist(), dtype=object)


def all_numbers(text: Column) -> Column:
    """C6; needs match offsets, which SQL functions don't give."""

    @F.arrow_udf(NUMBER_ROW)
    def found(texts: pa.Array) -> pa.Array:
        return number_arrays(texts.to_pylist())

    return found(text)


def cell_number(c: Column) -> Column:
    """the number of a cell or constant: commas dropped, percentages as shares, ``const_5``, ``const_m1``."""
    literal = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

    def read(plain: Column) -> Column:
        body, const = F.replace(plain, F.lit("%"), F.lit("")), F.replace(plain, F.lit("const_"), F.lit(""))
        return (
            F.when(plain.rlike(literal), F.trim(plain).try_cast("double"))
            .when(plain.contains("%") & body.rlike(literal), F.trim(body).try_cast("double") / 100.0)
            .when(plain.contains("const") & (const == "m1"), F.lit(-1.0))
            .when(plain.contains("const") & const.rlike(literal), const.try_cast("double"))
        )

    return let(F.replace(c, F.lit(","), F.lit("")), read)


def row_numbers(cells: Column) -> Column:
    """the numbers of a table row, null if any cell has none."""
    values = F.transform(cells, lambda c: cell_number(F.trim(F.substring_index(F.trim(F.replace(c, F.lit("$"), F.lit(""))), "(", 1))))
    return F.when(~F.exists(values, lambda v: v.isNull()), values)


_PLAIN = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", re.A)


def number_of(cell: str) -> float | None:
    """F18 for Python callers."""
    plain = cell.replace(",", "")
    if _PLAIN.fullmatch(plain):
        return float(plain)
    if "%" in plain and _PLAIN.fullmatch(share := plain.replace("%", "")):
        return float(share) / 100
    if "const" in plain:
        const = plain.replace("const_", "")
        return -1.0 if const == "m1" else float(const) if _PLAIN.fullmatch(const) else None
    return None


def numbers_of(cells: list[str]) -> list[float] | None:
    """F19 for Python callers."""
    out = [number_of(c.replace("$", "").strip(" ").split("(")[0].strip(" ")) for c in cells]
    return None if None in out else out
