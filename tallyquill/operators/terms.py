"""An embedding of texts by their words: hashed terms, weighted by how few texts have them, as sparse rows."""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyquill.shipping import ship

#: Numbers that terms are hashed to; terms of one number count as one.
BUCKETS = 1 << 18
#: Rows of a block, queries of a pack; queries in a group and rows in a way, at most on average.
BLOCK, PACK, GROUP, WAY = 2048, 512, 8192, 65_536


def bucket_of(term: str, buckets: int = BUCKETS) -> int:
    """The first 32 bits of the term's MD5, modulo ``buckets``: SQL can tell it too."""
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % buckets


def terms_in(text: str | None, buckets: int, known: dict[str, int]) -> Counter:
    """How often each number occurs among the lower-cased words of a text; ``known`` keeps those of a batch."""
    out: Counter = Counter()
    for word, n in Counter((text or "").lower().split()).items():
        if word not in known:
            known[word] = bucket_of(word, buckets)
        out[known[word]] += n
    return out


@dataclass
class Weights:
    """What a term weighs, fitted on a corpus: log((1 + texts) / (1 + texts that have it)). One number a bucket."""

    weight: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.weight)


def fit(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> Weights:
    """The weights over all texts. A task counts its texts by bucket; at most ``buckets`` counts come to the driver."""
    ship(docs.sparkSession)

    def count(batches):
        seen = np.zeros(buckets + 1, np.int64)
        for b in batches:
            known: dict[str, int] = {}
            for text in b.column(0).to_pylist():
                seen[list(terms_in(text, buckets, known))] += 1
            seen[buckets] += b.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(buckets + 1)
    for r in counts:
        n[r["bucket"]] = r["n"]
    return Weights(np.log((1 + n[buckets]) / (1 + n[:buckets])))


def embedded(df: DataFrame, weights: Weights, text_col: str = "text") -> DataFrame:
    """R2: adds ``terms``, the numbers of a text's terms in order, and ``weights``, count times weight over the vector's length.

    Terms that all texts have weigh nothing and are left out, so a text of none but these, like an empty or
    null one, has an empty vector.
    """
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            known: dict[str, int] = {}
            ids, values, sizes = [np.empty(0, np.int32)], [np.empty(0)], []
            for text in b.column(at).cast(pa.string()).to_pylist():
                found = sorted(terms_in(text, weights.buckets, known).items())
                k = np.array([i for i, _ in found], np.int32)
                w = np.array([n for _, n in found], float) * weights.weight[k]
                k, w = k[w > 0], w[w > 0]
                ids.append(k)
                values.append(w / np.sqrt((w * w).sum()) if len(w) else w)
                sizes.append(len(k))
            cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(ids))), pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(values)))], schema.names)

    return df.mapInArrow(run, schema)


def _packs(df: DataFrame, kind: T.DataType, size: int, by_term: bool) -> DataFrame:
    """(deal, id, terms, weights), packed by ``deal``: (deal, ids, rows, terms, weights); a block's entries are in the order of their terms."""
    schema = T.StructType([T.StructField("deal", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in ("rows", "terms", "weights"))])

    def pack(batches):
        for b in batches:
            deals = b.column(0).to_numpy()
            for deal in np.unique(deals).tolist():
                mine = b.take(pa.array(np.flatnonzero(deals == deal)))
                mine = mine.take(pc.sort_indices(mine.column(1)))
                for lo in range(0, mine.num_rows, size):
                    part = mine.slice(lo, size)
                    sizes = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                    rows = np.repeat(np.arange(part.num_rows, dtype=np.int32), sizes)
                    terms, values = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
                    if by_term:
                        order = np.argsort(terms, kind="stable")
                        rows, terms, values = rows[order], terms[order], values[order]
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(1))
                    yield pa.RecordBatch.from_arrays([pa.array([deal], pa.int32()), ids, *(pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((rows, "<i4"), (terms, "<i4"), (values, "<f8")))], schema.names)

    return df.mapInArrow(pack, schema)


def sparse_topk(queries: DataFrame, nodes: DataFrame, k: int = 5, by: Column | None = None) -> DataFrame:
    """R4 over sparse rows: queries (query_id, terms, weights) x nodes (node_id, terms, weights) -> query_id, node_id, score, seq.

    With ``by``, a whole number of the nodes, each query has its k best of every value (column ``part``). Blocks of
    nodes, their entries sorted by term, and packs of queries meet in an equi-join by way and group, as in
    ``vector_topk``; a query adds up the entries of its own terms and no others, so what it costs is how often its terms
    occur, not how many there are. Scores are compared to nine decimals, ties going to the smaller node; rows that
    share no term with a query are no hits.
    """
    q = queries.where(F.size("terms") > 0).select(F.col("query_id").alias("id"), "terms", "weights")
    n = nodes.where(F.size("terms") > 0).select(F.col("node_id").alias("id"), "terms", "weights", (by if by is not None else F.lit(0)).cast("int").alias("by"))
    n_groups, n_ways = max(1, -(-q.count() // GROUP)), max(16, -(-n.count() // WAY))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    left = _packs(q.select(dealt(n_groups).alias("deal"), "id", "terms", "weights"), q.schema["id"].dataType, PACK, False).select(F.col("deal").alias("group"), every(n_ways).alias("way"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("terms").alias("q_terms"), F.col("weights").alias("q_weights"))
    right = _packs(n.select((F.col("by") * n_ways + dealt(n_ways)).alias("deal"), "id", "terms", "weights"), n.schema["id"].dataType, BLOCK, True)
    right = right.select(F.pmod("deal", F.lit(n_ways)).alias("way"), F.floor(F.col("deal") / n_ways).cast("int").alias("part"), every(n_groups).alias("group"), "ids", "rows", "terms", "weights")
    schema = T.StructType([T.StructField("query_id", q.schema["id"].dataType), T.StructField("node_id", n.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("place", T.DoubleType()), T.StructField("part", T.IntegerType())])

    def multiply(batches):
        for b in batches:
            for r in range(b.num_rows):
                part, q_ids, ids = b.column(0)[r].as_py(), b.column(1)[r].values, b.column(5)[r].values
                q_rows, q_terms, rows, terms = (np.frombuffer(b.column(c)[r].as_py(), "<i4") for c in (2, 3, 6, 7))
                q_weights, weights = (np.frombuffer(b.column(c)[r].as_py(), "<f8") for c in (4, 8))
                first, last = np.searchsorted(terms, q_terms, "left"), np.searchsorted(terms, q_terms, "right")
                cuts = np.searchsorted(q_rows, np.arange(len(q_ids) + 1))
                found_q, found_n, found_s = [], [], []
                for i in range(len(q_ids)):
                    a, z = cuts[i], cuts[i + 1]
                    size = (last - first)[a:z]
                    if not size.sum():
                        continue
                    entry = np.repeat(first[a:z] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    s = np.bincount(rows[entry], weights[entry] * np.repeat(q_weights[a:z], size), len(ids))
                    met = np.flatnonzero(s > 0)
                    best = met[np.lexsort((met, -np.round(s[met], 9)))[:k]]
                    found_q += [i] * len(best)
                    found_n += best.tolist()
                    found_s += s[best].tolist()
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(found_q, pa.int32())), ids.take(pa.array(found_n, pa.int32())), pa.array(found_s, pa.float64()), pa.array(np.round(np.array(found_s, float), 9)), pa.array([part] * len(found_q), pa.int32())], schema.names)

    met = left.join(right, ["group", "way"]).select("part", "q_ids", "q_rows", "q_terms", "q_weights", "ids", "rows", "terms", "weights").mapInArrow(multiply, schema)
    best = Window.partitionBy("query_id", *(["part"] if by is not None else [])).orderBy(F.col("place").desc(), "node_id")
    ranked = met.withColumn("seq", F.row_number().over(best)).where(F.col("seq") <= k)
    return ranked.select("query_id", "node_id", "score", *(["part"] if by is not None else []), "seq")


def term_search(weights: Weights, nodes: DataFrame, text_col: str = "content"):
    """A search for ``engine``: questions (query_id, query) to their k best texts and tables among nodes (node_id, is_table, ``text_col``)."""
    rows = embedded(nodes.select("node_id", "is_table", F.col(text_col).alias("text")), weights)

    def search(asked: DataFrame, k: int) -> DataFrame:
        told = embedded(asked.select("query_id", "query"), weights, "query")
        return sparse_topk(told, rows, k, by=F.col("is_table").cast("int"))

    return search
