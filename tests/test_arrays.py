"""JSON arrays in splits."""

import json
import random

import pytest

from tallyquill.sources import arrays, readers

SCHEMA = "id INT, text STRING, more ARRAY<STRUCT<a:STRING>>, inner STRUCT<b:STRING, c:ARRAY<INT>>"
TEXTS = ["", "plain", 'quote " and \\ back', "brace } { ] [", "}}}", '\\"}', "newline\n\t", "ünïcode 東京 🙂", "x" * 500, "\\\\", '{"id": 1}', "},{", "é}" * 40]


def items(rng, n):
    return [{"id": i, "text": rng.choice(TEXTS), "more": [{"a": rng.choice(TEXTS)} for _ in range(rng.randint(0, 3))], "inner": {"b": rng.choice(TEXTS), "c": [1, 2]}} for i in range(n)]


def shown(rows):
    return [(r["seq"], r["id"], r["text"], [x["a"] for x in r["more"]], r["inner"]["b"]) for r in sorted(rows, key=lambda r: r["seq"])]


@pytest.mark.parametrize(("size", "style"), [(99, {"ensure_ascii": False}), (997, {}), (997, {"indent": 2}), (1 << 20, {"separators": (",", ":"), "ensure_ascii": False})])
def test_S1_any_split_gives_all_objects_in_order(spark, tmp_path, size, style):
    rng = random.Random(size)
    told = items(rng, 20 if size < 100 else 60)
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps(told if name == "a" else told[:7], **style), encoding="utf-8")
    (tmp_path / "empty.json").write_text("[ ]\n")
    (tmp_path / "one.json").write_text(json.dumps(told[5], **style) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        n_splits = arrays.pieces(spark, str(tmp_path)).select("file", "start").distinct().count()
        rows = readers.read_numbered(spark, str(tmp_path), SCHEMA).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert n_splits > 20 or size > 100
    by_file = {name: [r for r in rows if r["__file"].endswith(f"/{name}.json")] for name in ("a", "b", "one", "empty")}
    want = [(i, t["id"], t["text"], [x["a"] for x in t["more"]], t["inner"]["b"]) for i, t in enumerate(told)]
    assert shown(by_file["a"]) == want and shown(by_file["b"]) == want[:7] and not by_file["empty"]
    assert shown(by_file["one"]) == [(0, *want[5][1:])] and len(rows) == len(told) + 8


@pytest.mark.parametrize("torn", ['[{"id": 1}, {"id": 2', '[{"id": 1}', '[{"id": 1}, {"id": "', "{", '[{"id": 1}}]', '{"id": 1', '[{"id": 1}, 7]', '[[{"id": 1}]]', "no json", '[{"id": "x{"}, {"id": [}]'])
def test_S1_torn_files_fail(spark, tmp_path, torn):
    (tmp_path / "a.json").write_text(torn)
    with pytest.raises(Exception):  # noqa: B017
        readers.read_array(spark, str(tmp_path / "a.json"), "id INT").collect()


def test_S1_states_by_hypothesis():
    """The places of quotes and brackets equal those found one character after another."""
    import numpy as np

    rng = random.Random(7)
    for _ in range(2000):
        text = "".join(rng.choice('ab"\\{}[] ') for _ in range(rng.randint(0, 30)))
        for inside in (False, True):
            state, places, escaped = inside, [], False
            for i, c in enumerate(text):
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    state = not state
                elif c in "{}[]" and not state:
                    places.append(i)
                if escaped and i + 1 < len(text) and text[i + 1] in "{}[]" and not state:
                    places.append(i + 1)  # outside strings a backslash escapes no bracket
            got = arrays.brackets_in(np.frombuffer(text.encode(), np.uint8), inside)
            assert sorted(set(places)) == got[0].tolist() and state == got[2], text


def test_arrays_that_are_written_are_read(spark, tmp_path):
    from tallyquill.sources import writers

    rows = [(i, rng_text) for i, rng_text in enumerate(TEXTS * 3)]
    df = spark.createDataFrame([*rows, (99, None)], "id int, text string").repartition(5)
    for n, some in (("many", df), ("none", df.limit(0))):
        writers.write_arrays(some, str(tmp_path / n))
        for p in (tmp_path / n).glob("part-*"):
            assert not p.read_text() or isinstance(json.loads(p.read_text()), list)  # a table known to be empty writes an empty file
    assert sorted((r["id"], r["text"]) for r in readers.read_array(spark, str(tmp_path / "many"), "id int, text string").collect() if r["id"] != 99) == rows
    assert readers.read_array(spark, str(tmp_path / "none"), "id int, text string").count() == 0
