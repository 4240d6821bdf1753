"""Events of markup, in time in proportion to it, and the tables in it."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']*)))?""")
_BEGUN = re.compile(r"<[a-zA-Z/!?]")


class Events(HTMLParser):
    """The standard parser, without its searches for an end that isn't there, which it begins anew at each tag.

    From the first tag on whose quotes never close, a tag ends at the next ">", whatever its quotes say, and
    from the first comment on that never ends, a comment does. Behind the last ">" no markup is
    complete, so what begins there ends the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.quotes_hold = self.comments_end = True

    def read(self, html: str) -> None:
        cut = html.rfind(">") + 1
        rest = html[cut:]
        begun = _BEGUN.search(rest)
        self.rawdata = html[:cut] + (rest[: begun.start()] if begun else rest)
        self.close()

    def parse_starttag(self, i: int) -> int:
        if self.quotes_hold:
            end = super().parse_starttag(i)
            if end >= 0:
                return end
            self.quotes_hold = False
        end = self.rawdata.find(">", i) + 1
        name = _TAG.match(self.rawdata, i + 1)
        tag = name[0].lower()
        self.handle_starttag(tag, [(m[1].lower(), m[2] or m[3] or m[4]) for m in _ATTRIBUTE.finditer(self.rawdata, name.end(), max(name.end(), end - 1))])
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)
        return end

    def parse_comment(self, i: int, report: bool = True) -> int:
        if self.comments_end:
            end = super().parse_comment(i, report)
            if end >= 0:
                return end
            self.comments_end = False
        return self.rawdata.find(">", i) + 1

    def parse_html_declaration(self, i: int) -> int:
        """Marked sections are comments up to their ">", as in browsers."""
        return self.rawdata.find(">", i) + 1 if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)


#: Elements whose text is no text of a page, and parts of a table that end a row.
SILENT, GROUPS = frozenset(("script", "style", "template")), frozenset(("thead", "tbody", "tfoot", "caption"))


class Tables(Events):
    """The rows of the tables of a page, in the order in which they begin.

    A cell ends at its end tag, at the next cell or row of its table, or with the table, whichever is first. A row
    has the cells of the tables inside it too, and a cell the text of these, which have their own rows besides.
    Cells outside a row aren't any.
    """

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[list[str]]] = []
        self.open: list[list] = [[None, None]]  # by table: the row and the cell that are open
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        here = self.open[-1]
        if tag in SILENT:
            self.silent += 1
        elif tag == "table":
            self.open.append([None, None])
        elif tag in GROUPS:
            here[:] = [None, None]
        elif tag == "tr":
            here[:] = [[], None]
            self.rows.append(here[0])
        elif tag in ("td", "th") and here[0] is not None:
            here[1] = []
            for row, _ in self.open:
                if row is not None:
                    row.append(here[1])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        here = self.open[-1]
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "table" and len(self.open) > 1:
            self.open.pop()
        elif tag == "tr" or tag in GROUPS:
            here[:] = [None, None]
        elif tag in ("td", "th"):
            here[1] = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            for _, cell in self.open:
                if cell is not None:
                    cell.append(data)


def table_rows(html: str | None) -> list[list[str]]:
    """The cells of each row that has any, stripped; a first cell of digits alone numbers the row and isn't one."""
    tables = Tables()
    tables.read(html or "")
    out = []
    for row in tables.rows:
        cells = ["".join(c).strip() for c in row]
        if cells:
            out.append(cells[1:] if cells[0].isdigit() else cells)
    return out


def rows_of(html: Column) -> Column:
    """``table_rows`` as a column, in Arrow batches."""

    @F.pandas_udf("array<array<string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(table_rows)

    return run(html)
