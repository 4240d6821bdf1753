import json
import random
import re
import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyquill.functions import numbers, text
from tallyquill.operators import chunks, dialogue, predictions, programs, retrieval, tables, training
from tallyquill.sources import readers, writers
from tallyquill.streaming import ingest


def test_T2_quirks(spark):
    rows = ["| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |", "| a | b |\n|---|---|\n| 1 | 2 | 3 |", "| a | b |\n|---|---|\n| 1 |", "| x | y |\n| 1 | 2 |", " | b\n---|---\nr | 2"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "c string").select(tables.parse_pipe_table(F.col("c"))).collect()]
    assert (got[0]["header"], got[0]["rows"]) == (["a", "b"], [["1", "2"], ["3", None]])
    assert got[1] is None and got[2] is None and got[3]["header"] is None and got[4] is None


def test_T6_sentinels(spark):
    df = spark.createDataFrame([([],), ([[]],), ([["a", None], ["long", "b", "c"]],)], "r array<array<string>>")
    got = [r[0] for r in df.select(tables.format_table(F.col("r"))).collect()]
    assert got == ["No table data found.", "No valid table data found.", "a    |   |  \n-----|---|--\n".replace("-----|---|--", "----" + "-|-" + "-" + "-|-" + "-") + "long | b | c"]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.lists(st.text("abc1 ", min_size=1, max_size=5).filter(str.strip), min_size=2, max_size=2), min_size=2, max_size=4))
def test_format_then_parse(spark, rows):
    df = spark.createDataFrame([(rows,)], "r array<array<string>>")
    back = df.select(tables.parse_pipe_table(tables.format_table(F.col("r"))).alias("p")).first()["p"]
    want = [[c.strip() for c in r] for r in rows]
    assert [back["header"], *back["rows"]] == want


def test_T9_annotation_wins_though_it_has_no_table(spark):
    df = spark.createDataFrame([(True, "", [["x"]], [["y"]]), (False, None, [], [["y"]])], "m boolean, h string, t array<array<string>>, o array<array<string>>")
    got = [r[0] for r in df.select(tables.table_text(F.col("m"), F.col("h"), F.col("t"), F.col("o"))).collect()]
    assert got[0] == "No table data found." and got[1].startswith("y")


def test_C1_chunks_keep_all_sentences(spark):
    said = " ".join(f"word{i} is here." for i in range(40))
    got = chunks.sentence_chunks(spark.createDataFrame([(1, said), (2, "")], "doc_id long, text string"), size=12, overlap=3).orderBy("chunk_no").collect()
    assert all(r["n_words"] <= 12 for r in got) and {w for r in got for w in r["content"].split()} == set(said.split())
    assert got[1]["content"].split()[:3] == got[0]["content"].split()[-3:]


def test_C1_equals_a_plain_packing(spark):
    """Each chunk is the longest run of sentences that fits, after the overlap of the one before."""
    r = random.Random(6)
    for _ in range(300):
        sentences = [" ".join("w" * r.randint(1, 3) for _ in range(r.randint(1, 9))) + r.choice(".!?") for _ in range(r.randint(0, 20))]
        size, overlap = r.randint(5, 15), r.randint(0, 6)
        count = lambda some: sum(len(s.split()) for s in some)
        want, start, end = [], 0, 0
        while end < len(sentences):
            stop = end + 1
            while stop < len(sentences) and count(sentences[start : stop + 1]) <= size:
                stop += 1
            want.append((count(sentences[start:stop]), " ".join(sentences[start:stop])))
            if stop == len(sentences):
                break
            back = next(b for b in range(start + 1, stop + 1) if count(sentences[b:stop]) <= overlap)
            start, end = (back if count(sentences[back : stop + 1]) <= size else stop), stop
        assert chunks.packed_sentences(" ".join(sentences), size, overlap) == want
    df = spark.createDataFrame([(1, None), (2, "  "), (3, "A b. " * 20_000)], "doc_id long, text string")
    assert {x["doc_id"] for x in chunks.sentence_chunks(df).collect()} == {3}


def test_C4_overwritten_edges(spark):
    nodes = spark.createDataFrame([(1, i, f"n{i}") for i in range(3)] + [(2, 0, "m")], "doc_id long, chunk_no int, node_id string")
    got = {(r["source"], r["target"], r["distance"]) for r in chunks.node_edges(nodes).collect()}
    assert got == {("n0", "n2", 2), ("n1", "n2", 1), ("n2", "n1", 1)}


def test_E1_sample_dialogues(spark):
    gold = [["A0", "181001", "A0", "14.1%"]]
    df = spark.createDataFrame([("a", ["what was the cash from operating activities in 2009?", "and in 2008?", "the difference?", "percentage?"], ["206588", "181001", "25587", "14.14%", "extra"])], "id string, q array<string>, g array<string>")
    turns = dialogue.turns_of(df, "q", "g")
    judged = dialogue.judged(dialogue.mock_answers(turns))
    assert [r["is_correct"] for r in judged.orderBy("turn").collect()] == [True, False, False, True]
    m = dialogue.corpus_metrics(dialogue.per_dialogue(judged)).first()
    assert (m["overall_accuracy"], m["first_turn_accuracy"], m["last_turn_accuracy"], len(gold)) == (0.5, 1.0, 1.0, 1)
    history = dialogue.with_history(dialogue.mock_answers(turns)).orderBy("turn").collect()
    assert [len(r["history"]) for r in history] == [0, 1, 2, 3]


def test_provider_sees_its_own_answers(spark):
    turns = spark.createDataFrame([("a", 1, "q1", ""), ("a", 0, "q0", ""), ("b", 0, "q", "")], "id string, turn int, question string, context string")
    got = dialogue.provider_answers(turns, lambda q, c, h: q + "".join(x[1] for x in h)).orderBy("id", "turn").collect()
    assert [r["predicted"] for r in got] == ["q0", "q1q0", "q"]


def test_rounds_equal_one_dialogue_after_another(spark):
    """Each round asks the provider about all dialogues that have a turn left; the last turns of few go on alone."""
    r = random.Random(5)
    rows = [(i if i else None, t, f"q{i}.{t}", "c") for i in range(40) for t in r.sample(range(100), 1 + i % 9)] + [(99, t, f"long{t}", "c") for t in range(30)]
    turns = spark.createDataFrame(rows, "id int, turn int, question string, context string").repartition(3)
    asked = spark.sparkContext.accumulator(0)
    one = lambda q, c, h: f"{q}{c}<{len(h)}:{h[-1][1][:9] if h else ''}>"

    def answer_all(some):
        asked.add(1)
        return [one(q, c, h) for q, c, h in some]

    want = sorted(map(str, dialogue.provider_answers(turns, one).collect()))
    got = dialogue.provider_rounds(turns, answer_all, few=5)
    assert sorted(map(str, got.collect())) == want
    rounds = 9
    alone = 30 - rounds
    assert rounds <= asked.value <= rounds * 4 + alone  # not a call a turn, of which there are 230
    assert dialogue.provider_rounds(turns.limit(0), answer_all).count() == 0


def test_A10_types(spark):
    tag = lambda x: f"<begin_of_answer>{x}<end_of_answer>"
    rows = [(tag("5"), tag("5.04")), (tag("about 5"), tag("5")), (tag("yes"), tag("Yes it is")), (tag("colour"), tag("color")), (tag("abc"), tag("xyz"))]
    df = predictions.with_matches(spark.createDataFrame(rows, "pred string, label string"))
    assert [r["answer_match"] for r in df.collect()] == [True, True, True, True, False]


def test_R4_ties_and_quota(spark):
    v = [[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [1.0, 1.0]]
    nodes = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "node_id long, vec array<double>")
    got = retrieval.vector_topk(spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vec array<double>"), nodes, 3).orderBy("seq").collect()
    assert [r["node_id"] for r in got] == [0, 1, 3]


def test_D6_without_marker_all_is_masked(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([1],), ([2, 3, 2, 3],)], "ids array<int>")
    assert [r[0] for r in df.select(training.response_labels(F.col("ids"), F.array(F.lit(2), F.lit(3)))).collect()] == [[-100, 2, 3, 4], [-100], [2, 3, 2, 3]]
    assert [r[0] for r in df.select(training.split_of(F.col("ids"), 100)).collect()] == ["eval"] * 3
    text_ = spark.createDataFrame([("a b c",), ("c b a",)], "t string")
    assert [r[0] for r in text_.select(training.markers_in_order(F.col("t"), "a", "b", "c")).collect()] == [True, False]


@pytest.mark.parametrize("name", sorted(text.TEMPLATES))
def test_F27_templates(spark, name):
    df = spark.createDataFrame([([("system", "s"), ("user", "u"), ("assistant", "7"), ("tool", "t")],)], "m array<struct<role:string,content:string>>")
    said = df.select(text.render(text.inject_answer_tags(F.col("m")), name)).first()[0]
    assert "s" in said and "<begin_of_answer>\n7\n<end_of_answer>" in said and said.startswith(text.TEMPLATES[name][0])


def test_sources_and_sinks(spark, tmp_path):
    items = [{"id": "a", "content": "old", "metadata": {"source": "s", "filename": "f"}}, {"id": "a", "content": "new", "metadata": {"source": "s", "filename": "f"}}]
    (tmp_path / "k.json").write_text(json.dumps(items))
    assert [r["content"] for r in readers.read_knowledge(spark, str(tmp_path / "k.json")).collect()] == ["new"]
    both = [{"pre_text": ["p"], "post_text": ["q"], "table_ori": [["a", "b"]], "annotation": {"amt_pre_text": "no"}, "qa": {"question": "why?"}}, {"id": "z", "context": "c", "question": "who?"}]
    (tmp_path / "d.json").write_text(json.dumps(both))
    got = readers.inference_examples(readers.read_dialogues(spark, str(tmp_path / "d.json"))).orderBy("id").collect()
    assert got[0]["id"] == "example_0" and got[0]["context"].startswith("p\n\na | b") and got[1]["context"] == "c"
    (tmp_path / "p.json").write_text(json.dumps([{"id": "x", "output": "o"}, {"prediction": "p"}, {}]))
    assert {(r["id"], r["output"]) for r in readers.read_predictions(spark, str(tmp_path / "p.json")).collect()} == {("x", "o"), ("example_1", "p"), ("example_2", "")}
    nodes = spark.createDataFrame([("n", True, [1.0]), ("m", False, [2.0])], "node_id string, is_table boolean, vec array<double>")
    stored = readers.read_collections(spark, str(tmp_path / "c"), lambda: nodes)
    assert readers.collection(stored, "table").count() == 1 and readers.exists(spark, str(tmp_path / "c"))
    docs = spark.createDataFrame([("i", "f", " pre", "", "post")], "id string, filename string, pre string, table string, post string")
    writers.write_json(writers.knowledge_rows(docs), str(tmp_path / "k"))
    assert spark.read.json(str(tmp_path / "k")).first()["content"] == "pre\n\n\n\npost"
    writers.write_markdown(docs, str(tmp_path / "m"))
    assert "## Table" not in spark.read.option("wholetext", True).text(str(tmp_path / "m")).first()[0]
    writers.write_splits(training.with_splits(train=docs, test=docs), str(tmp_path / "s"))
    assert readers.read_split(spark, str(tmp_path / "s")).count() == 1 and readers.read_split(spark, str(tmp_path / "s"), "validation").count() == 1
    assert writers.inspect(docs)["first"]["id"] == "i"
    results = spark.createDataFrame([("b", 1.0), ("a", 0.5), ("c", 0.0)], "example_id string, accuracy double").repartition(3)
    writers.evaluation_json(spark.createDataFrame([(0.5, 3)], "overall_accuracy double, examples_evaluated long"), results, str(tmp_path / "e"))
    (part,) = (tmp_path / "e").glob("part-*")
    assert json.loads(part.read_text()) == {"metrics": {"overall_accuracy": 0.5, "examples_evaluated": 3}, "example_results": [{"example_id": x, "accuracy": y} for x, y in (("a", 0.5), ("b", 1.0), ("c", 0.0))]}


def test_J2_fails_on_ids_that_are_missing_or_twice_there(spark):
    gold = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 4)], "id string, g int")
    pred = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert sorted(map(tuple, programs.with_gold(pred("a", "b", "a"), gold).select("id", "g").collect())) == [("a", 1), ("a", 1), ("b", 2)]
    for wrong in ("c", "x", None):
        with pytest.raises(Exception, match="gold row"):
            programs.with_gold(pred("a", wrong), gold).collect()


def test_P10_answers_may_be_words(spark):
    rows = [("greater( 5 3 ) EOF", "yes"), ("greater( 3 5 ) EOF", "yes"), ("add( 1 2 ) EOF", "3.0"), ("add( 1 2 EOF", "3.0")]
    df = spark.createDataFrame([(p.split(), p.split(), a) for p, a in rows], "gold array<string>, pred array<string>, exe_ans string")
    got = programs.scores(df).select("exe_right", "prog_right", "sound").collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, True, False), (True, True, True), (False, False, True)]
    assert tuple(programs.accuracies(programs.scores(df)).first()) == (4, 0.5, 0.75, 1)


def test_R4_modes_parts_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    monkeypatch.setattr(retrieval, "GROUP", 2)
    r = np.random.RandomState(2)
    x = r.normal(size=(40, 5)).round(1)
    nodes = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)] + [(100, None, 0), (101, [0.0] * 5, 1), (102, [1.0, 2.0], 2)]
    queries = spark.createDataFrame([(f"q{i}", [float(c) for c in x[i]]) for i in range(7)], "query_id string, vec array<double>").repartition(2)
    got = retrieval.vector_topk(queries, spark.createDataFrame(nodes, "node_id long, vec array<double>, kind int").repartition(3), 4, "exp_neg_l2sq", by=F.col("kind")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(7):
        for kind in range(3):
            best = sorted((-round(float(np.exp(2 * unit[q] @ unit[i] - 2)), 9), i) for i in range(40) if i % 3 == kind)[:4]
            assert [(-round(g["score"], 9), g["node_id"]) for g in sorted((g for g in got if g["query_id"] == f"q{q}" and g["part"] == kind), key=lambda g: g["seq"])] == best


def test_T1_without_tables_or_text(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no | table"), (4, "a|b|c\nx\n\n|d|\ne|f|"), (5, "\n\n")], "doc_id long, text string")
    assert [tuple(r) for r in tables.extract_tables(df).orderBy("first_line").collect()] == [(4, 0, 0, 1, "a|b|c"), (4, 1, 3, 2, "|d|\ne|f|")]
    assert [tuple(r) for r in tables.split_document(df).orderBy("doc_id", "chunk_no").collect()] == [(3, "3", "text", 0, "no | table"), (4, "4_table_0", "table", 0, "a|b|c"), (4, "4_text_1", "text", 1, "x"), (4, "4_table_2", "table", 2, "|d|\ne|f|")]


def test_C5_linear_and_alike(spark):
    """One try a stretch finds what the patterns find over the whole text, and long prose takes no time."""
    r = random.Random(4)
    parts = ["revenue", "growth", "rate", "net income", " ", " was ", ": ", "$", "5", "1,200.5", "%", " million", " m", ".", "stores", " years", "the ", "\n", "1.2.3", ",", "k"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        want = {}
        for pattern, name, value, suffix in ((numbers.AMOUNT, 1, 2, ""), (numbers.PERCENT, 1, 2, " (%)"), (numbers.COUNT, 2, 1, "")):
            for m in re.finditer(pattern, t):
                try:
                    v = float(m[value].replace(",", ""))
                except ValueError:
                    continue
                unit = (m[3] or "").lower() if pattern is numbers.AMOUNT else ""
                want[m[name].strip().lower() + suffix] = v / 100 if suffix else v * (next(x for u, x in numbers.UNITS if u in unit) if unit else 1)
        assert dict(numbers.metrics_of(t)) == want, t
    began = time.time()
    assert numbers.metrics_of("the growth of words " * 20_000) == [] and numbers.metrics_of(None) == []
    assert time.time() - began < 5


def test_streaming_matches_batch(spark, tiny, tmp_path):
    batch = spark.read.parquet(f"{tiny}/documents.parquet")
    batch.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = ingest.chunked(ingest.stream_documents(spark, str(tmp_path / "in"), batch.schema).select("doc_id", "text"))
    ingest.run_once(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == ingest.chunked(batch.select("doc_id", "text")).count()
