"""Tables inside texts: islands of pipe lines, parsing, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyquill.functions.markup import rows_of
from tallyquill.functions.text import let, strip


PART = "array<struct<first_line:int,n_lines:int,is_table:boolean,content:string>>"


def islands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_pipes: int = 2) -> DataFrame:
    """(doc_id, parts): runs of lines with, or without, enough pipes, in order, as an array of (first_line, n_lines, is_table, content).

    All in the document's own row: no line is exploded, and nothing is shuffled.
    """
    def runs(ls: Column) -> Column:
        return let(F.transform(ls, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"))) >= min_pipes), lambda fs: let(begins(fs), lambda at: cut(ls, fs, at)))

    def begins(fs: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(fs) - 1), lambda i: (i == 0) | (F.get(fs, i) != F.get(fs, i - 1)))

    def cut(ls: Column, fs: Column, at: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            return F.struct(a.alias("first_line"), (b - a).alias("n_lines"), F.get(fs, a).alias("is_table"), F.array_join(F.slice(ls, a + 1, b - a), "\n").alias("content"))

        return F.zip_with(at, F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(ls))), part).cast(PART)

    # each array is bound once: a column of an inner select would be computed again for every element
    return docs.select(F.col(id_col).alias("doc_id"), let(F.split(F.col(text_col), "\n"), runs).alias("parts"))


def extract_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_pipes: int = 2) -> DataFrame:
    """A row per table: doc_id, table_no (from 0), first_line, n_lines, content."""
    some = docs.where(F.col(text_col).contains("|")) if min_pipes > 0 else docs
    tables = islands(some, id_col, text_col, min_pipes).select("doc_id", F.posexplode(F.filter("parts", lambda p: p["is_table"])).alias("table_no", "t"))
    return tables.select("doc_id", "table_no", "t.first_line", F.col("t.n_lines").cast("long").alias("n_lines"), "t.content")


def split_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_pipes: int = 2) -> DataFrame:
    """Text and table chunks in order; blank text islands take no number."""
    content = lambda p: F.struct(p["is_table"].alias("is_table"), F.when(p["is_table"], p["content"]).otherwise(strip(p["content"])).alias("content"))
    kept = F.filter(F.transform("parts", content), lambda p: p["is_table"] | (p["content"] != ""))
    found = islands(docs, id_col, text_col, min_pipes).select("doc_id", kept.alias("parts"))
    parts = found.select("doc_id", F.exists("parts", lambda p: p["is_table"]).alias("has_table"), F.posexplode("parts").alias("n", "p"))
    kind = F.when(F.col("p.is_table"), "table").otherwise("text")
    name = F.when(F.col("has_table"), F.concat_ws("_", F.col("doc_id").cast("string"), kind, F.col("n").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    return parts.select("doc_id", name.alias("chunk_id"), kind.alias("type"), F.col("n").alias("chunk_no"), "p.content")


def parse_pipe_table(content: Column) -> Column:
    """(header, rows) of a pipe table; null where the widths don't fit.

    A line of dashes and pipes is the rule; it goes, and makes the line above it the header only
    where it is the second line. One empty cell at either end is an outer pipe's. A row wider than
    the header fails, as do rows that are all narrower; a single narrower one is filled with nulls.
    """
    lines = F.filter(F.transform(F.split(content, "\n"), strip), lambda x: x != "")
    first_rule = F.array_position(F.transform(lines, lambda x: F.replace(x, F.lit(" "), F.lit("")).rlike(r"^[-|]+$")), True)
    body = F.when(first_rule > 0, F.filter(lines, lambda x, i: i != first_rule - 1)).otherwise(lines)

    def cells(line: Column) -> Column:
        c = F.transform(F.split(line, r"\|"), strip)
        c = F.when((F.size(c) > 0) & (c[0] == ""), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c)
        return F.when((F.size(c) > 0) & (F.element_at(c, -1) == ""), F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c)

    rows = F.transform(body, cells)
    headed = (first_rule == 2) & (F.size(rows) > 1)
    header = F.when(headed, rows[0])
    data = F.when(headed, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    width = F.size(header)
    widest = F.array_max(F.transform(data, F.size))
    filled = F.transform(data, lambda r: F.concat(r, F.array_repeat(F.lit(None).cast("string"), F.greatest(F.coalesce(width, widest) - F.size(r), F.lit(0)))))
    table = F.struct(header.alias("header"), filled.alias("rows"))
    return F.when(~headed, table).when(widest == width, table)


def table_data(content: Column) -> Column:
    """T5: (header, rows, numeric, numbers): all rules dropped; the first line is a header where the second has more numbers.

    ``$``, ``,`` and ``%`` go from all cells. In a column whose cells are all numbers then, ``numeric``
    is true and ``numbers`` has them; in others it has null.
    """
    lines = F.filter(F.transform(F.split(content, "\n"), strip), lambda x: (x != "") & ~F.replace(x, F.lit(" "), F.lit("")).rlike(r"^[-|]+$"))
    rows = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), strip))
    count = lambda r: F.size(F.filter(r, lambda c: c.rlike(r"^\d+\.?\d*$")))
    headed = (F.size(rows) > 1) & (count(F.get(rows, F.lit(0))) < count(F.get(rows, F.lit(1))))
    header = F.when(headed, F.get(rows, F.lit(0)))
    data = F.when(headed, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    width = F.coalesce(F.array_max(F.transform(data, F.size)), F.lit(0))
    bare = F.transform(data, lambda r: F.transform(r, lambda c: F.regexp_replace(c, "[$,%]", "")))
    is_number = lambda c: F.coalesce(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"), F.lit(False))
    columns = F.when(width > 0, F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda i: F.transform(bare, lambda r: F.get(r, i)))).otherwise(F.array().cast("array<array<string>>"))
    numeric = F.transform(columns, lambda c: F.forall(c, is_number))
    numbers = F.transform(columns, lambda c: F.when(F.forall(c, is_number), F.transform(c, lambda x: F.trim(x).try_cast("double"))))
    return F.struct(header.alias("header"), bare.alias("rows"), numeric.alias("numeric"), numbers.alias("numbers"))


def format_table(rows: Column) -> Column:
    """An array of rows as aligned text with a rule of dashes below the first row."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(strip(c), F.lit(""))))
    width = F.coalesce(F.array_max(F.transform(clean, F.size)), F.lit(0))
    places = F.when(width > 0, F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    cell = lambda r, i: F.coalesce(F.get(r, i), F.lit(""))
    widths = F.transform(places, lambda i: F.array_max(F.transform(clean, lambda r: F.length(cell(r, i)))))
    line = lambda r: F.array_join(F.transform(places, lambda i: F.rpad(cell(r, i), F.get(widths, i), " ")), " | ")
    rule = F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w)), "-|-")
    lines = F.transform(clean, line)
    text = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
    return F.when(rows.isNull() | (F.size(rows) == 0), "No table data found.").when(width == 0, "No valid table data found.").otherwise(text)


def format_html_table(html: Column) -> Column:
    """The rows of a page's tables, from a parser's events; empty cells are dashes."""
    return let(rows_of(F.replace(html, F.lit("<td></td>"), F.lit("<td>-</td>"))), format_table)


def table_text(annotated: Column, html: Column, table: Column, original: Column) -> Column:
    """The annotation's table where there is an annotation, though it may say that there is none; else the fields."""
    direct = F.when(F.size(table) > 0, format_table(table)).when(F.size(original) > 0, format_table(original)).otherwise("")
    return F.when(annotated, format_html_table(F.coalesce(html, F.lit("")))).otherwise(direct)


def context_text(pre: Column, table: Column, post: Column) -> Column:
    """T10."""
    return F.concat(F.coalesce(pre, F.lit("")), F.lit("\n\n"), F.coalesce(table, F.lit("")), F.lit("\n\n"), F.coalesce(post, F.lit("")))
