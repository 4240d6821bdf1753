"""Vector and keyword retrieval: exact scores, top-k, merges, quotas."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyquill.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector in double precision, scaled to length 1; computed once a row, not once a pair. One of zeros becomes one of nulls."""
    norm = F.nullif(F.sqrt(dot(v, v)), F.lit(0.0))
    return let(norm, lambda n: F.transform(v, lambda x: x.cast("double") / n))


#: Letters that the stand-in embedding counts.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(text: Column) -> Column:
    """A stand-in embedding without a model: how often each letter comes."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*((F.length(low) - F.length(F.replace(low, F.lit(c)))).cast("double") for c in LETTERS))


def embedded(df: DataFrame, text_col: str, embed: Callable[[Column], Column] = letter_counts, to: str = "vec") -> DataFrame:
    """R2: adds the vector of a text. ``embed`` is any function of columns, a vectorised Python function of a model included."""
    return df.withColumn(to, embed(F.col(text_col)))


#: Vectors in a block; queries in a group, and nodes in a way, at most on average.
BLOCK, GROUP, WAY = 2048, 8192, 65_536


def _blocks(df: DataFrame, part: Column) -> DataFrame:
    """(id, v) -> blocks of vectors of one length and part: (dim, part, ids, x), ids ascending."""
    kind = df.schema["id"].dataType
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("x", T.BinaryType())])

    def pack(batches):
        for b in batches:
            sizes = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            parts = b.column(0).to_numpy(zero_copy_only=False)
            for dim, at in sorted(set(zip(sizes.tolist(), parts.tolist(), strict=True))):
                rows = b.take(pa.array(np.flatnonzero((sizes == dim) & (parts == at))))
                rows = rows.take(pc.sort_indices(rows.column(1)))
                x = rows.column(2).flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
                ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([at], pa.int32()), ids, pa.array([x], pa.binary())], schema.names)

    def cut(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                yield from pack([b.slice(lo, BLOCK)])

    return df.select(part.cast("int").alias("part"), "id", "v").mapInArrow(cut, schema)


def vector_topk(queries: DataFrame, nodes: DataFrame, k: int = 5, mode: str = "cosine", by: Column | None = None, asked: Column | None = None) -> DataFrame:
    """Queries (query_id, vec) x nodes (node_id, vec) -> query_id, node_id, score, seq (from 1).

    ``mode`` is ``cosine``, or ``exp_neg_l2sq``: exp of minus the squared distance of unit vectors.
    With ``by``, a whole number of the nodes, each query has its k best of every value (column ``part``).
    With ``asked`` too, an array of such numbers, a query has its k best of the nodes of these values
    together, so queries to several collections share a search; a block meets only queries that ask for it.

    Blocks of unit vectors meet in an equi-join by group of queries and way of nodes, both in
    proportion to the rows, so no side needs to be small. A task multiplies two blocks as matrices
    and keeps k rows a query; the last ranking is of those. Scores are compared to nine decimals,
    ties going to the smaller node; null vectors, and vectors of another length, are never hits.
    """
    every_part = by is None or asked is None
    q = queries.where(F.col("vec").isNotNull()).select(F.col("query_id").alias("id"), unit(F.col("vec")).alias("v"), (F.array(F.lit(0)) if every_part else F.array_distinct(asked)).alias("asked"))
    n = nodes.where(F.col("vec").isNotNull()).select(F.col("node_id").alias("id"), unit(F.col("vec")).alias("v"), (by if by is not None else F.lit(0)).alias("by"))
    n_groups, n_ways = max(1, -(-q.count() // GROUP)), max(16, -(-n.count() // WAY))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # a pack holds the queries of one group that ask for one part
    q = q.select("id", "v", F.explode("asked").alias("to")).withColumn("deal", F.col("to").cast("int") * n_groups + deal("id", n_groups).cast("int"))
    left = _blocks(q, F.col("deal")).select("dim", F.pmod("part", F.lit(n_groups)).alias("group"), F.floor(F.col("part") / n_groups).cast("int").alias("to"), every(n_ways).alias("way"), F.col("ids").alias("q_ids"), F.col("x").alias("q"))
    right = _blocks(n, F.col("by")).select("dim", every(n_groups).alias("group"), deal("x", n_ways).cast("int").alias("way"), "part", "ids", "x")
    schema = T.StructType([T.StructField("query_id", q.schema["id"].dataType), T.StructField("node_id", n.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("place", T.DoubleType()), T.StructField("part", T.IntegerType())])

    def multiply(batches):
        for b in batches:
            for r in range(b.num_rows):
                dim, part = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                a, x = (np.frombuffer(b.column(c)[r].as_py(), "<f8") for c in (2, 4))
                q_ids, ids = b.column(3)[r].values, b.column(5)[r].values
                s = a.reshape(len(q_ids), dim) @ x.reshape(len(ids), dim).T
                s = s if mode == "cosine" else np.exp(2 * s - 2)
                s = np.where(np.isnan(s), -np.inf, s)
                place = np.round(s, 9)
                least = -np.partition(-place, min(k, place.shape[1]) - 1, axis=1)[:, min(k, place.shape[1]) - 1]
                i, j = np.nonzero(place >= least[:, None])
                order = np.lexsort((j, -place[i, j], i))
                i, j = i[order], j[order]
                first = np.searchsorted(i, i)
                some = np.flatnonzero((np.arange(len(i)) - first < k) & np.isfinite(place[i, j]))
                i, j = i[some], j[some]
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(s[i, j]), pa.array(place[i, j]), pa.array(np.full(len(i), part, np.int32))], schema.names)

    if every_part:
        left, keys = left.drop("to"), ["dim", "group", "way"]
    else:
        right, keys = right.withColumn("to", F.col("part")), ["dim", "group", "way", "to"]
    met = left.join(right, keys).select("dim", "part", "q", "q_ids", "x", "ids").mapInArrow(multiply, schema)
    best = Window.partitionBy("query_id", *(["part"] if by is not None and asked is None else [])).orderBy(F.col("place").desc(), "node_id")
    ranked = met.withColumn("seq", F.row_number().over(best)).where(F.col("seq") <= k)
    return ranked.select("query_id", "node_id", "score", *(["part"] if by is not None else []), "seq")


def collection_hits(hits: DataFrame, k: int) -> list[DataFrame]:
    """The k best of the text, the table and the context collection, from one search by ``is_table`` (part 0 and 1).

    The best of all nodes are among the best of both kinds.
    """
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "node_id")
    both = hits.withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= k).drop("part")
    return [*(hits.where((F.col("part") == part) & (F.col("seq") <= k)).drop("part") for part in (0, 1)), both]


def merge_hits(hits: DataFrame) -> DataFrame:
    """Hits (query_id, node_id, score, seq) of several searches: the best score a node, in the order first seen."""
    return hits.groupBy("query_id", "node_id").agg(F.max("score").alias("score"), F.min("seq").alias("seq"))


def _first(hits: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("seq", "node_id")
    return hits.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def cutoff(hits: DataFrame, least: float = 0.7, n: int = 3) -> DataFrame:
    """The first n, in the order seen, of those with a score of at least ``least``."""
    return _first(hits.where(F.col("score") >= least), n)


def top_up(kept: DataFrame, extra: DataFrame, n: int = 2, unless: DataFrame | None = None) -> DataFrame:
    """Up to n more hits that aren't among ``unless`` (``kept``)."""
    return _first(extra.join((kept if unless is None else unless).select("query_id", "node_id"), ["query_id", "node_id"], "left_anti"), n)


def retrieve(text_hits: DataFrame, table_hits: DataFrame, context_hits: DataFrame, least: float = 0.7, n: int = 3, more: int = 2, unique: DataFrame | None = None) -> DataFrame:
    """Kept, extra table and extra context hits with their part, counted by ``envelope``; ``seq`` is the order within a part.

    ``unique`` has the merged hits, where there are more searches than the texts' and the tables'.
    """
    unique = merge_hits(text_hits.unionByName(table_hits)) if unique is None else unique
    kept = cutoff(unique, least, n)
    tables = top_up(kept, table_hits, more)
    contexts = top_up(kept, context_hits, more, unless=unique)
    label = lambda df, part: df.select("query_id", "node_id", "score", F.lit(part).alias("part"), F.col("seq").cast("long").alias("seq"))
    return label(kept, "kept").union(label(tables, "table")).union(label(contexts, "context"))


def envelope(hits: DataFrame) -> DataFrame:
    n = lambda part: F.count_if(F.col("part") == part).alias(f"n_{part}")
    return hits.groupBy("query_id").agg(n("kept"), n("table"), n("context"), F.count(F.lit(1)).alias("n_all"), F.max("score").alias("best"))


def keyword_hits(candidates: DataFrame, kept: DataFrame, n: int = 3) -> DataFrame:
    """Candidates (query_id, node_id, seq, content, keywords) that hold a keyword and aren't kept."""
    holds = F.exists("keywords", lambda w: F.lower("content").contains(w))
    return _first(candidates.where(holds).join(kept.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti"), n)


def numeric_first(hits: DataFrame, table_hits: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """Hits (query_id, node_id, seq, numeric), numeric ones first, as query_id, node_id, rank.

    Where fewer than ``least`` are numeric, tables that aren't among these follow them until there are
    ``most``; the others come last. Tables are numeric, so none comes twice.
    """
    n = hits.groupBy("query_id").agg(F.count_if("numeric").alias("n_numeric"))
    fresh = table_hits.join(hits.where("numeric").select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").join(n.where(F.col("n_numeric") < least), "query_id")
    by_seq = Window.partitionBy("query_id").orderBy("seq", "node_id")
    extra = fresh.withColumn("__n", F.row_number().over(by_seq)).where(F.col("__n") <= most - F.col("n_numeric"))
    placed = hits.select("query_id", "node_id", F.when(F.col("numeric"), 0).otherwise(2).alias("__part"), F.col("seq").cast("long").alias("seq")).union(extra.select("query_id", "node_id", F.lit(1), F.col("seq").cast("long")))
    order = Window.partitionBy("query_id").orderBy("__part", "seq", "node_id")
    return placed.select("query_id", "node_id", F.row_number().over(order).cast("long").alias("rank"))


def lookup(queries: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The text of each query's document, '' where there is none."""
    found = docs.select(key, F.col(text).alias("context"))
    return queries.join(found, key, "left").withColumn("context", F.coalesce("context", F.lit("")))
