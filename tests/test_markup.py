"""Tables of pages against a plain tree of their elements."""

import random
import time

import pytest

from tallyquill.functions import markup


def tree_rows(table, out):
    """Rows of nested tables written as lists: a table is a list of rows, a row of cells, a cell of strings and tables."""
    def text(cell):
        return "".join(x if isinstance(x, str) else "".join(text(c) for row in x for c in row) for x in cell)

    def cells(row):
        for cell in row:
            yield text(cell).strip()
            for x in cell:
                if not isinstance(x, str):
                    for inner in x:
                        yield from cells(inner)

    for row in table:
        found = list(cells(row))
        if found:
            out.append(found[1:] if found[0].isdigit() else found)
        for cell in row:
            for x in cell:
                if not isinstance(x, str):
                    tree_rows(x, out)
    return out


SAID = [("a", "a"), (" b ", " b "), ("&amp;", "&"), ("&#8212;", "—"), ("&eacute;", "é"), ("&nbsp;", "\xa0"), ("<b>x</b>", "x"), ("<!-- no -->", ""), ("<script>if (a<b) '<td>'</script>", ""), ("<br/>", ""), ("12", "12"), ("", ""), ("&lt;td&gt;", "<td>")]


def written(rng, depth=0):
    """A random table, as markup with cells closed or not, and as lists."""
    html, tree = rng.choice(["<table>", '<TABLE class="x > y">']), []
    for _ in range(rng.randint(0, 3)):
        html += rng.choice(["<tr>", "<tbody><tr>"])
        row = []
        for _ in range(rng.randint(0, 3)):
            tag = rng.choice(["td", "th", "TD"])
            html += f"<{tag} a='1'>"
            cell = []
            for _ in range(rng.randint(0, 3)):
                if depth < 2 and rng.random() < 0.2:
                    said, inner = written(rng, depth + 1)
                    html += said
                    cell.append(inner)
                else:
                    said, meant = rng.choice(SAID)
                    html += said
                    cell.append(meant)
            html += rng.choice(["", f"</{tag}>"])
            row.append(cell)
        html += rng.choice(["", "</tr>"])
        tree.append(row)
    return html + "</table>", tree


def test_T7_tables_equal_a_plain_tree():
    rng = random.Random(12)
    for _ in range(3000):
        html, tree = written(rng)
        assert markup.table_rows(f"<p>x</p>{html} y") == tree_rows(tree, []), html


def test_T7_odd_pages():
    assert markup.table_rows(None) == [] == markup.table_rows("") == markup.table_rows("<table><td>no row</td></table>") == markup.table_rows("plain")
    assert markup.table_rows("<tr><td>without a table") == [["without a table"]]
    assert markup.table_rows("<table><tr><td>1</td><td>one</td></tr><tr><td>7</td></tr></table>") == [["one"], []]
    assert markup.table_rows("<table><caption>c</caption><tr><th>h</th></tr></table> <td>x</td>") == [["h"]]


@pytest.mark.parametrize("part", ["<tr><td>", "<tr", '<td a="', "<!--", "</td", "<td>x", "</table>", "<a '"])
def test_T7_time_is_in_proportion(part):
    page = "<table><tr><td>x</td></tr>" + part * (500_000 // len(part)) + ">"
    began = time.time()
    assert markup.table_rows(page)[0] == ["x"]
    assert time.time() - began < 8
