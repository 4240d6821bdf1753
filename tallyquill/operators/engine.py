"""Question answering over retrieved nodes: variants of queries, sub-questions, numeric composites, generation.

A provider stands for a language model: a function from a column of prompts to a column of responses,
be it an expression or ``python_provider`` around a callable. All steps are columns or equi-joins by
query, so questions run in parallel and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyquill.functions.numbers import all_numbers, metrics_in
from tallyquill.functions.text import asks_for_numbers, clean_output, instruct_prompt, let, numbered_list, program_and_answer, query_analysis, route, strip
from tallyquill.operators import index
from tallyquill.operators.index import Store
from tallyquill.operators.retrieval import collection_hits, merge_hits, numeric_first, retrieve, vector_topk
from tallyquill.operators.tables import table_data
from tallyquill.store import once

Provider = Callable[[Column], Column]

#: The tools of the sub-question engine, the collections that they search, what they are for.
TOOLS = (
    ("text_search", "text", "Useful for searching through textual financial information, narratives, and descriptions."),
    ("table_search", "table", "Useful for searching through tables with financial data, metrics, and numerical information."),
    ("context_search", "context", "Useful for finding broader context and background information about financial data."),
)
CHOOSE = "Choose the tool that answers the question; its name is enough.\n"
ANALYSE = "Say whether this question needs a computation, and list values_to_extract, operations, time_periods and financial_metrics: "
REWRITE, EXPAND, SPLIT = "Rewrite this question for a search: ", "Give other questions that ask the same, as a numbered list: ", "Split this question into simpler ones, as a numbered list: "


def python_provider(answer: Callable[[str], str]) -> Provider:
    """A provider that calls a Python function for each prompt, in Arrow batches."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(answer, na_action="ignore")

    return run


def tools(spark: SparkSession) -> DataFrame:
    """The registry of tools."""
    return spark.createDataFrame(TOOLS, "tool string, collection string, description string")


def tool_prompt(question: Column) -> Column:
    """A question with the tools that there are for it."""
    listed = "".join(f"{tool}: {what}\n" for tool, _, what in TOOLS)
    return F.concat(F.lit(CHOOSE + listed + "\nQuestion: "), question)


def with_tool(questions: DataFrame, choose: Provider | None = None) -> DataFrame:
    """Adds the tool that a question goes to: the first that the provider's response names, else by ``route``."""
    routed = F.when(route(F.col("question")) == "table", "table_search").otherwise("text_search")
    if choose is None:
        return questions.withColumn("tool", routed)
    named = F.nullif(F.regexp_extract(choose(tool_prompt(F.col("question"))), "|".join(tool for tool, _, _ in TOOLS), 0), F.lit(""))
    return questions.withColumn("tool", F.coalesce(named, routed))


def searched_by(tool: Column) -> Column:
    """The parts of the nodes, 0 texts and 1 tables, that a tool's collection holds; the context collection holds both."""
    said = F.array(F.lit(0), F.lit(1))
    for name, collection, _ in TOOLS:
        if collection != "context":
            said = F.when(tool == name, F.array(F.lit(int(collection == "table")))).otherwise(said)
    return said


def tool_search(nodes: DataFrame, embed: Callable[[Column], Column], k: int = 5, store: Store | None = None) -> Callable[[DataFrame], DataFrame]:
    """A way to ``find`` contexts: the k nodes of its tool's collection nearest to a question, best first.

    ``nodes`` has node_id, is_table, vec, content. Questions (question, tool, and any columns that tell them
    apart) of all tools go into one search, each asking for its collection; hits come back to their question in
    order. A question whose collection is empty has an empty context. With ``store``, the search is of an index of the
    nodes' vectors, and nodes need none.
    """

    def find(questions: DataFrame) -> DataFrame:
        marked = once(questions.withColumn("__key", F.monotonically_increasing_id()), "questions")
        asked, parts = marked.select(F.col("__key").alias("query_id"), embed(F.col("question")).alias("vec"), "tool"), searched_by(F.col("tool"))
        hits = vector_topk(asked, nodes, k, by=F.col("is_table").cast("int"), asked=parts) if store is None else index.search(store, asked, k, parts)
        return with_context(marked, hits.withColumnRenamed("query_id", "__key"), nodes, "__key").drop("__key")

    return find


def with_context(questions: DataFrame, hits: DataFrame, nodes: DataFrame, key: str = "query_id") -> DataFrame:
    """Adds ``context``: the contents of a question's hits (key, node_id, seq), in their order, blank lines between."""
    held = hits.join(nodes.select("node_id", "content"), "node_id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "node_id", "content"))).alias("held"))
    said = held.select(key, F.array_join(F.transform("held", lambda h: F.coalesce(h["content"], F.lit(""))), "\n\n").alias("context"))
    return questions.join(said, key, "left").withColumn("context", F.coalesce("context", F.lit("")))


def rewritten(queries: DataFrame, provider: Provider) -> DataFrame:
    """Queries (query_id, query, ...) in the provider's words; the query as it was is ``original``."""
    return queries.withColumn("original", F.col("query")).withColumn("query", strip(provider(F.concat(F.lit(REWRITE), F.col("query")))))


def expanded(queries: DataFrame, provider: Provider) -> DataFrame:
    """(query_id, variant from 0, query), a row per variant that the provider lists."""
    listed = numbered_list(provider(F.concat(F.lit(EXPAND), F.col("query"))))
    return queries.select("query_id", F.posexplode(listed).alias("variant", "query"))


def with_sub_questions(queries: DataFrame, provider: Provider) -> DataFrame:
    """Adds ``sub_questions``, those that the provider lists."""
    return queries.withColumn("sub_questions", numbered_list(provider(F.concat(F.lit(SPLIT), F.col("query")))))


#: From questions (query_id, query) and k to hits (query_id, node_id, score, part, seq), k of part 0, texts, and of 1, tables.
Search = Callable[[DataFrame, int], DataFrame]


def vector_search(nodes: DataFrame, embed: Callable[[Column], Column]) -> Search:
    """A search by the vectors of nodes (node_id, is_table, vec)."""
    return lambda asked, k: vector_topk(asked.select("query_id", embed(F.col("query")).alias("vec")), nodes, k, by=F.col("is_table").cast("int"))


def index_search(store: Store, embed: Callable[[Column], Column]) -> Search:
    """A search of a stored index whose collections are 0, texts, and 1, tables: what ``vector_search`` finds, from the blocks that can hold it."""

    def find(asked: DataFrame, k: int) -> DataFrame:
        both = asked.select("query_id", embed(F.col("query")).alias("vec"), F.explode(F.array(F.lit(0), F.lit(1))).alias("part"))
        both = once(both.withColumn("__key", F.monotonically_increasing_id()), "asked")
        hits = index.search(store, both.select(F.col("__key").alias("query_id"), "vec", "part"), k, F.array("part")).withColumnRenamed("query_id", "__key")
        return hits.join(both.select("__key", "query_id", "part"), "__key").drop("__key")

    return find


def multi_query_search(queries: DataFrame, variants: DataFrame | None, search: Search, k: int = 5) -> DataFrame:
    """One search for queries and their variants: (query_id, variant, node_id, score, part, seq). Each has its k best texts (part 0) and tables (1); the query as it is
    is variant -1.
    """
    asked = queries.select("query_id", F.lit(-1).alias("variant"), "query")
    if variants is not None:
        asked = asked.union(variants.select("query_id", "variant", "query"))
    asked = asked.withColumn("key", F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant").cast("string")))
    found = search(asked.select(F.col("key").alias("query_id"), "query"), k)
    return found.withColumnRenamed("query_id", "key").join(asked.select("key", F.col("query_id"), "variant"), "key").drop("key")


def in_order_seen(found: DataFrame, k: int = 5) -> DataFrame:
    """Hits of ``multi_query_search``, one row a node: its best score, in the order in which the nodes
    were first seen, the query's texts, its tables, then variant by variant."""
    place = (F.col("variant") + 1) * 2 * k + F.col("part") * k + F.col("seq")
    return merge_hits(found.where(F.col("seq") <= k).select("query_id", "node_id", "score", place.alias("seq")))


def multi_query_hits(queries: DataFrame, variants: DataFrame, search: Search, k: int = 5) -> DataFrame:
    """Hits of a query's text and table search and of those of its variants, one row a node."""
    return in_order_seen(once(multi_query_search(queries, variants, search, k), "hits"), k)


def answered(questions: DataFrame, find: Callable[[DataFrame], DataFrame], respond: Provider) -> DataFrame:
    """Adds ``response``: the provider's, given the ``context`` that ``find`` adds, and the question."""
    return find(questions).withColumn("response", respond(F.concat(F.coalesce("context", F.lit("")), F.lit("\n\n"), F.col("question")))).drop("context")


def sub_question_engine(queries: DataFrame, split: Provider, find: Callable[[DataFrame], DataFrame], respond: Provider, choose: Provider | None = None) -> DataFrame:
    """Queries (query_id, query) -> query_id, response, sub_questions (question, response).

    With at most one sub-question a query is answered directly. Else each sub-question goes to its
    tool, and the last response is to the query with all questions and answers before it. Questions of
    both sorts are found and answered together; what the provider splits a query into, and answers, is written
    once.
    """
    listed = with_sub_questions(queries.select("query_id", "query"), split)
    whole = F.array(F.struct(F.lit(-1).alias("no"), F.col("query").alias("question")))
    parts = F.transform("sub_questions", lambda q, i: F.struct(i.alias("no"), q.alias("question")))
    asked = listed.select("query_id", "query", F.explode(F.when(F.size("sub_questions") > 1, parts).otherwise(whole)).alias("q")).select("query_id", "query", "q.no", "q.question")
    said = once(answered(with_tool(asked, choose), find, respond).select("query_id", "query", "no", "question", "response"), "answers")
    kind = "array<struct<question:string,response:string>>"
    direct = said.where("no < 0").select("query_id", "response", F.array().cast(kind).alias("sub_questions"))
    held = said.where("no >= 0").groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("no", "question", "response"))).alias("parts"))
    told = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("Question "), (p["no"] + 1).cast("string"), F.lit(": "), p["question"], F.lit("\nAnswer "), (p["no"] + 1).cast("string"), F.lit(": "), p["response"], F.lit("\n\n"))), "")
    final = F.concat(F.lit("Based on the following information:\n\n"), told, F.lit("Please answer the original question: "), F.col("query"))
    return direct.union(held.select("query_id", respond(final).alias("response"), F.transform("parts", lambda p: F.struct(p["question"].alias("question"), p["response"].alias("response"))).cast(kind).alias("sub_questions")))


def numeric_nodes(hits: DataFrame, k: int = 10) -> DataFrame:
    """The ten nearest texts and the ten nearest tables of a query, from one search by ``is_table``; a node may come twice."""
    texts, tabs, _ = collection_hits(hits, k)
    return texts.withColumn("place", F.col("seq")).union(tabs.withColumn("place", F.col("seq") + k))


def numeric_operations(nodes: DataFrame, analyses: DataFrame, provider: Provider | None = None) -> DataFrame:
    """Per query what its nodes hold in numbers, and statistics of the metrics asked for.

    ``nodes`` (query_id, place, node_id, source, is_table, content) are few a query, the hits of a
    search; ``analyses`` has query_id, query and an analysis as ``query_analysis`` gives it. Returns
    query_id, extracted_metrics, extracted_numbers, tables, computed (name to value: mean, median, min
    and max of each metric asked for that was found), steps, and the provider's response to all that
    where the analysis asks for a computation.
    """
    read = nodes.withColumns({"metrics": metrics_in(F.col("content")), "numbers": all_numbers(F.col("content")), "table": F.when(F.col("is_table"), table_data(F.col("content")))})
    kinds = ("metrics", "numbers", "table")  # a list each, so that what nobody reads is neither extracted nor shuffled
    held = read.groupBy("query_id").agg(*(F.array_sort(F.collect_list(F.struct("place", "node_id", "source", c))).alias(f"held_{c}") for c in kinds))
    flat = lambda c, *fields: F.flatten(F.transform(f"held_{c}", lambda h: F.transform(h[c], lambda x: F.struct(*((h if f in ("node_id", "source") else x)[f].alias(f) for f in fields)))))
    tabs = F.transform(F.filter("held_table", lambda h: h["table"].isNotNull() & (F.size(h["table"]["rows"]) > 0)), lambda h: F.struct(h["node_id"].alias("node_id"), h["source"].alias("source"), h["table"].alias("data")))
    out = analyses.join(held, "query_id", "left").withColumns({f"held_{c}": F.coalesce(f"held_{c}", F.array().cast(held.schema[f"held_{c}"].dataType)) for c in kinds})
    numbers = flat("numbers", "node_id", "source", "value", "is_currency", "is_percentage", "context", "position")
    out = out.withColumns({"extracted_metrics": flat("metrics", "metric", "value", "source", "node_id"), "extracted_numbers": numbers, "tables": tabs}).drop(*(f"held_{c}" for c in kinds))
    values = lambda name: F.array_sort(F.transform(F.filter("extracted_metrics", lambda x: x["metric"] == name), lambda x: x["value"]))
    wanted = F.filter(F.array_distinct(F.coalesce("analysis.financial_metrics", F.array().cast("array<string>"))), lambda w: F.coalesce(F.exists("extracted_metrics", lambda x: x["metric"] == w), F.lit(False)))
    out = out.withColumn("__wanted", wanted)
    wanted = F.col("__wanted")

    def statistics(w: Column) -> Column:
        entry = lambda kind, x: F.struct(F.concat(w, F.lit(f"_{kind}")).alias("key"), x.alias("value"))

        def entries(v: Column) -> Column:
            n = F.size(v)
            middle = (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2
            return F.array(entry("mean", F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n), entry("median", middle), entry("min", F.get(v, F.lit(0))), entry("max", F.element_at(v, -1)))

        return let(values(w), entries)  # sorted once

    periods = F.coalesce("analysis.time_periods", F.array().cast("array<string>"))
    compared = F.when(F.size(periods) >= 2, F.array(F.concat(F.lit("Time period comparison requested: "), F.array_join(periods, ", ")))).otherwise(F.array().cast("array<string>"))
    steps = F.concat(F.transform(wanted, lambda w: F.concat(F.lit("Calculated statistics for "), w)), compared)
    out = out.withColumns({"computed": F.map_from_entries(F.flatten(F.transform(wanted, statistics))), "steps": steps})
    metrics_said = F.array_join(F.transform("extracted_metrics", lambda x: F.concat(F.lit("- "), x["metric"], F.lit(": "), x["value"].cast("string"))), "\n")
    tables_said = F.array_join(F.transform("tables", lambda t: F.array_join(F.transform(t["data"]["rows"], lambda r: F.array_join(r, " | ", "")), "\n")), "\n\n")
    asked = F.concat(F.lit("Extracted metrics:\n"), metrics_said, F.lit("\n\nExtracted tables:\n"), tables_said, F.lit("\n\n"), F.col("query"))
    response = F.when(F.col("analysis.needs_numerical_computation"), strip(provider(asked))) if provider else F.lit(None).cast("string")
    return out.select("query_id", "extracted_metrics", "extracted_numbers", "tables", "computed", "steps", response.alias("response"))


def answer_questions(
    queries: DataFrame, nodes: DataFrame, search: Search, respond: Provider, rewrite: Provider | None = None, expand: Provider | None = None,
    analyse: Provider | None = None, k: int = 5, wide: int = 10, least: float = 0.7, n: int = 3,
) -> DataFrame:
    """From questions (query_id, query) to responses, over nodes (node_id, is_table, has_numbers, source, content).

    A question is rewritten and given variants (R14), and all of these are searched at once (R5). What they
    find is merged, cut off and topped up with tables and contexts (R6-R10). A question that asks for numbers (F24),
    and of which the analysis says that it needs a computation, has its numeric nodes first, filled up with tables
    (R12), and statistics and a computed response from its nearest texts and tables (R17). The others go by the nodes as
    they were retrieved; both sorts are answered together, given their context.

    What a provider says and what the search finds is written once each, and read by all steps that
    need it: the plan of the rest has no search and asks no provider twice. Returns query_id, searched (the query as
    it was searched), numeric, nodes (in order), response, computed, steps, numeric_response.
    """
    asked = queries.select("query_id", "query")
    asked = rewritten(asked, rewrite) if rewrite else asked.withColumn("original", F.col("query"))
    said = analyse(F.concat(F.lit(ANALYSE), F.col("original"))) if analyse else F.lit("")
    asked = asked.withColumn("analysis", query_analysis(said))
    asked = once(asked.withColumn("numeric", asks_for_numbers(F.col("original")) & F.col("analysis.needs_numerical_computation")), "questions")
    variants = once(expanded(asked, expand), "variants") if expand else None
    found = once(multi_query_search(asked, variants, search, max(k, wide)), "hits")

    own = found.where("variant < 0").drop("variant")
    texts, tables, contexts = collection_hits(own, k)
    final = retrieve(texts, tables, contexts, least, n, unique=in_order_seen(found, k))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.element_at(F.create_map(F.lit("kept"), F.lit(0), F.lit("table"), F.lit(1), F.lit("context"), F.lit(2)), F.col("part")), "seq", "node_id"))
    final = once(final.withColumn("seq", place).select("query_id", "node_id", F.col("seq").cast("long").alias("seq")), "retrieved")

    kind = asked.select("query_id", "numeric")
    facts = nodes.select("node_id", (F.col("is_table") | F.col("has_numbers")).alias("numeric"))
    focused = numeric_first(final.join(kind.where("numeric").select("query_id"), "query_id").join(facts, "node_id"), collection_hits(own, wide)[1].join(kind.where("numeric").select("query_id"), "query_id"))
    plain = final.join(kind.where("numeric"), "query_id", "left_anti")
    ordered = once(plain.union(focused.select("query_id", "node_id", "rank")), "ordered")

    responses = with_context(asked, ordered, nodes)
    responses = responses.withColumn("response", respond(F.concat("context", F.lit("\n\n"), "original"))).select("query_id", F.col("query").alias("searched"), "numeric", "response")
    held = ordered.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "node_id"))), lambda h: h["node_id"]).alias("nodes"))

    counted = asked.where("numeric")
    near = numeric_nodes(own.join(counted.select("query_id"), "query_id"), wide).join(nodes.select("node_id", "source", "is_table", "content"), "node_id")
    computed = numeric_operations(near, counted.select("query_id", F.col("original").alias("query"), "analysis"), respond).select("query_id", "computed", "steps", F.col("response").alias("numeric_response"))
    return responses.join(held, "query_id", "left").join(computed, "query_id", "left").select("query_id", "searched", "numeric", F.coalesce("nodes", F.array().cast(held.schema["nodes"].dataType)).alias("nodes"), "response", "computed", "steps", "numeric_response")


def generated(questions: DataFrame, provider: Provider, rules: str) -> DataFrame:
    """Questions (question, context, ...) with the program and answer that a text generator gives.

    A generator repeats its prompt; what follows is cleaned, and program and answer are read from that.
    """
    prompt = instruct_prompt(F.col("question"), F.col("context"), rules)
    out = questions.withColumn("__prompt", prompt).withColumn("__out", provider(F.col("__prompt")))
    raw = F.substring("__out", F.length("__prompt") + 1, F.length("__out"))
    out = out.withColumn("raw_output", raw).withColumn("cleaned_output", clean_output(F.col("raw_output")))
    result = program_and_answer(F.col("cleaned_output"))
    return out.withColumns({"program": result["program"], "answer": result["answer"]}).drop("__prompt", "__out")
