"""Tools, sub-questions and whole answers; the stored index."""

import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyquill.operators import engine, index, retrieval, terms


def node_rows(spark, n=40, seed=1):
    rng = np.random.default_rng(seed)
    words = ["revenue", "growth", "table", "cash", "margin", "flow", "net", "zebra", "quick", "lazy"]
    rows = [(i, f"{' '.join(rng.choice(words, 5))} {i}" + (" | 7" if i % 3 == 0 else ""), i % 3 == 0) for i in range(n)]
    df = spark.createDataFrame(rows, "node_id long, content string, is_table boolean")
    return rows, retrieval.embedded(df, "content").withColumns({"has_numbers": F.col("node_id") % 2 == 0, "source": F.lit("s")})


def letters(text):
    v = np.array([text.lower().count(c) for c in retrieval.LETTERS], float)
    return v / np.sqrt(v @ v)


def test_R16_all_tools_are_reached(spark):
    asked = spark.createDataFrame([(1, "how much is it?"), (2, "who is it?"), (3, "what lies behind it?")], "query_id int, question string")
    got = {r["query_id"]: r["tool"] for r in engine.with_tool(asked).collect()}
    assert got == {1: "table_search", 2: "text_search", 3: "text_search"}
    choose = lambda p: F.when(p.endswith("behind it?"), "use context_search, not text_search").when(p.contains("Useful for searching through tables"), "none of them").otherwise("table_search")
    assert {r["query_id"]: r["tool"] for r in engine.with_tool(asked, choose).collect()} == got | {3: "context_search"}
    assert {tuple(r) for r in engine.tools(spark).collect()} == set(engine.TOOLS)


def test_R15_contexts_are_the_nearest_of_each_tools_collection(spark):
    rows, nodes = node_rows(spark)
    asked = [(7, 0, "cash of zebra", "text_search"), (7, 1, "cash of zebra", "table_search"), (7, 2, "cash of zebra", "context_search"), (8, 0, "net margin", "table_search"), (8, 1, "123", "text_search")]
    found = engine.tool_search(nodes, retrieval.letter_counts, 3)(spark.createDataFrame(asked, "query_id int, no int, question string, tool string"))
    got = {(r["query_id"], r["no"]): r["context"] for r in found.collect()}
    for query, no, question, tool in asked[:4]:
        near = sorted((-round(float(letters(question) @ letters(c)), 9), i, c) for i, c, tab in rows if tool == "context_search" or tab == (tool == "table_search"))[:3]
        assert got[query, no] == "\n\n".join(c for _, _, c in near), (query, no)
    assert got[8, 1] == "" and len(got) == 5
    none = engine.tool_search(nodes.where("is_table"), retrieval.letter_counts, 3)(spark.createDataFrame(asked[:1], "query_id int, no int, question string, tool string"))
    assert none.first()["context"] == ""


def counting(spark, answer):
    asked = spark.sparkContext.accumulator(0)

    def one(prompt):
        asked.add(1)
        return answer(prompt)

    return asked, engine.python_provider(one)


def test_whole_answers_search_once_and_ask_once(spark, monkeypatch):
    rows, nodes = node_rows(spark)
    searches = []
    monkeypatch.setattr(engine, "vector_topk", lambda *a, **b: searches.append(1) or retrieval.vector_topk(*a, **b))
    queries = spark.createDataFrame([(1, "the total growth of cash"), (2, "who is lazy"), (3, "compare margins"), (4, "123")], "query_id int, query string")
    rewrite_n, rewrite = counting(spark, lambda p: p.replace(engine.REWRITE, ""))
    expand_n, expand = counting(spark, lambda p: "1. net flow\n2. quick zebra")
    analyse_n, analyse = counting(spark, lambda p: "true\ntime_periods: [2008, 2009]" if "growth" in p else "no")
    respond_n, respond = counting(spark, lambda p: f"{p.count('|')} of {len(p)}")
    out = engine.answer_questions(queries, nodes, engine.vector_search(nodes, retrieval.letter_counts), respond, rewrite, expand, analyse, least=0.3)
    got = {r["query_id"]: r for r in out.collect()}
    assert searches == [1] and (rewrite_n.value, expand_n.value, analyse_n.value) == (4, 4, 4) and respond_n.value == 5
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 0
    assert {q for q in got if got[q]["numeric"]} == {1} and got[1]["numeric_response"] and got[2]["numeric_response"] is None
    tables_first = [i for i in got[1]["nodes"] if i % 3 == 0 or i % 2 == 0]
    assert got[1]["nodes"][: len(tables_first)] == tables_first and got[1]["steps"] == ["Time period comparison requested: 2008, 2009"]
    assert 3 <= len(got[2]["nodes"]) <= 7 and len(set(got[2]["nodes"])) == len(got[2]["nodes"])
    text = {i: c for i, c, _ in rows}
    context = "\n\n".join(text[i] for i in got[2]["nodes"])
    assert got[2]["response"] == f"{context.count('|')} of {len(context) + 2 + len('who is lazy')}"
    assert engine.answer_questions(queries.limit(0), nodes, engine.vector_search(nodes, retrieval.letter_counts), respond).count() == 0
    assert engine.answer_questions(queries, nodes.limit(0), engine.vector_search(nodes.limit(0), retrieval.letter_counts), respond).select("nodes").distinct().collect() == [([],)]


def vectors(spark, n, dim, clusters, spread, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((clusters, dim))
    x = centers[np.arange(n) % clusters] + spread * rng.standard_normal((n, dim))
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)]
    rows += [(n + 1, rows[0][1], 0), (n + 2, rows[0][1], 2), (n + 3, None, 0), (n + 4, [0.0] * dim, 0), (n + 5, [1.0, 2.0], 1), (n + 6, [2.0, 1.0], 1), (n + 7, [float("nan")] * dim, 1)]
    return spark.createDataFrame(rows, "node_id long, vec array<double>, collection int")


def hits(df):
    return sorted((r["query_id"], r["seq"], r["node_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_S8_stored_search_is_exact(spark, tmp_path, spread):
    nodes = vectors(spark, 1500, 16, 30, spread)
    store = index.load_or_build(nodes, str(tmp_path), block=40)
    queries = nodes.where("node_id % 40 = 0 or node_id > 1500").select(F.col("node_id").alias("query_id"), "vec")
    want = retrieval.vector_topk(queries, nodes, 5)
    assert hits(index.search(store, queries, 5)) == hits(want)
    asked = F.when(F.col("query_id") % 2 == 0, F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(2)))
    want = retrieval.vector_topk(queries, nodes, 5, by=F.col("collection"), asked=asked)
    assert hits(index.search(store, queries, 5, asked)) == hits(want)
    assert index.search(store, queries.limit(0), 5).count() == 0


def test_S8_blocks_of_clustered_vectors_are_passed_over(spark, tmp_path):
    nodes = vectors(spark, 3000, 16, 30, 0.05)
    store = index.build(nodes.withColumn("collection", F.lit(0)), str(tmp_path), block=50)
    q = index._units(nodes.where("node_id % 100 = 0").select(F.col("node_id").alias("query_id"), "vec"), "query_id").withColumns({"asked": F.array(F.lit(0)), "least": F.lit(0.98)})
    n_blocks, n_queries = store.blocks.where("dim = 16").count(), q.count()
    assert index.probes(store, q).count() < 0.15 * n_blocks * n_queries and n_blocks >= 60
    assert index.probes(store, q.withColumn("least", F.lit(-2.0))).count() == n_blocks * n_queries


def test_S8_a_sweep_holds_k_a_query_and_way(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "WAYS", 3)
    nodes = vectors(spark, 2000, 16, 2000, 1.0).withColumn("collection", F.lit(0))
    nodes = nodes.union(nodes.where("node_id < 60").crossJoin(spark.range(20)).select((F.col("node_id") + 10_000 * (F.col("id") + 1)).alias("node_id"), "vec", "collection"))  # ties
    store = index.build(nodes, str(tmp_path), block=20)
    queries = nodes.where("node_id < 400 or node_id > 1990").select(F.col("node_id").alias("query_id"), "vec")
    want = hits(retrieval.vector_topk(queries, nodes, 5))
    for held in (1 << 24, 3000):  # one group of queries, and several
        monkeypatch.setattr(index, "HELD", held)
        assert hits(index.search(store, queries, 5)) == want
    q = index._units(queries, "query_id").withColumns({"asked": F.array(F.lit(0)), "least": F.lit(-2.0)})
    swept = index._swept(store, q, 5)
    assert swept.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 3 * 5
    assert sorted(r["block"] for r in index.probes(store, q.where("size(v) = 16"), by_query=False).collect()) == sorted(r["block"] for r in store.blocks.where("dim = 16").select("block").collect())


def test_R4_lengths_of_vectors_are_computed_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(retrieval.unit(F.col("v"))).collect()] == [[0.6, 0.8], [None, None], [], None]
    plan = df.select(retrieval.unit(F.col("v")).alias("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.index("transform(array(") >= 0


def test_S8_torn_store_is_rebuilt(spark, tmp_path):
    nodes, path = vectors(spark, 200, 8, 4, 0.2), str(tmp_path)
    assert index.load(spark, path) is None
    index.build(nodes, path, 20)
    manifest = tmp_path / "manifest"
    said = json.loads("".join(p.read_text() for p in manifest.glob("part-*")))
    assert index.load(spark, path).blocks.count() == said["blocks"] and said["rows"] == 204
    part = max((tmp_path / said["data"]).glob("part-*.parquet"), key=lambda p: p.stat().st_size)
    part.unlink()
    assert index.load(spark, path) is None
    again = index.load_or_build(nodes, path, block=20)
    assert again.blocks.agg(F.sum("n")).first()[0] == 204 and index.load(spark, path) is not None
    shutil.rmtree(manifest)
    assert index.load(spark, path) is None
    empty = index.load_or_build(nodes.limit(0), str(tmp_path / "none"))
    assert empty.blocks.count() == 0 and index.search(empty, nodes.select(F.col("node_id").alias("query_id"), "vec"), 3).count() == 0


def test_R2_terms_equal_a_plain_product(spark, monkeypatch):
    monkeypatch.setattr(terms, "BUCKETS", 50)
    rng = np.random.default_rng(2)
    said = lambda n: " ".join(f"{'W' if i % 3 else 'w'}{int(x)}" for i, x in enumerate(rng.zipf(1.4, n) % 60))
    rows = [(i, said(int(rng.integers(1, 30))), i % 4 == 0) for i in range(300)] + [(900, None, False), (901, "", True), (902, " \n", False)]
    df = spark.createDataFrame(rows, "node_id long, content string, is_table boolean").repartition(3)
    weights = terms.fit(df, "content", 50)
    counts = {i: [[terms.bucket_of(w, 50) for w in (c or "").lower().split()].count(b) for b in range(50)] for i, c, _ in rows}
    have = np.array([[n > 0 for n in c] for c in counts.values()]).sum(axis=0)
    assert np.allclose(weights.weight, np.log((1 + len(rows)) / (1 + have)))
    vector = lambda text: (v := np.array([[terms.bucket_of(w, 50) for w in text.lower().split()].count(b) for b in range(50)]) * weights.weight) / max(1e-300, np.sqrt(v @ v))
    asked = [(i, said(4)) for i in range(30)] + [(77, ""), (78, "unheard")]
    found = terms.term_search(weights, df)(spark.createDataFrame(asked, "query_id int, query string"), 4)
    got = sorted((r["query_id"], r["part"], r["seq"], r["node_id"], round(r["score"], 9)) for r in found.collect())
    want = []
    for q, text in asked:
        for part in (0, 1):
            near = sorted((-round(float(vector(text) @ vector(c or "")), 9), i) for i, c, tab in rows if tab == bool(part))
            want += [(q, part, n, i, -s) for n, (s, i) in enumerate([x for x in near if x[0] < 0][:4], 1)]
    assert [x[:4] for x in got] == [x[:4] for x in want] and np.allclose([x[4] for x in got], [x[4] for x in want])


def test_engine_searches_a_stored_index(spark, tmp_path):
    rows, nodes = node_rows(spark, 120)
    store = index.load_or_build(nodes.select("node_id", "vec", F.col("is_table").cast("int").alias("collection")), str(tmp_path), block=10)
    asked = spark.createDataFrame([("a", "cash of zebra"), ("b", "net margin"), ("c", "123"), ("d", "lazy quick flow")], "query_id string, query string")
    shown = lambda df: sorted((r["query_id"], r["part"], r["seq"], r["node_id"], round(r["score"], 9)) for r in df.collect())
    want = shown(engine.vector_search(nodes, retrieval.letter_counts)(asked, 4))
    assert shown(engine.index_search(store, retrieval.letter_counts)(asked, 4)) == want and len(want) == 24
    questions = spark.createDataFrame([(1, "cash of zebra", "text_search"), (2, "cash of zebra", "table_search"), (3, "net flow", "context_search")], "query_id int, question string, tool string")
    found = lambda **more: sorted((r["query_id"], r["context"]) for r in engine.tool_search(nodes, retrieval.letter_counts, 3, **more)(questions).collect())
    assert found(store=store) == found()
