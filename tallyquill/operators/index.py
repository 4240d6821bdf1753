"""A stored vector index: packed blocks of near vectors, each with its center and radius, searched exactly."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyquill.operators.retrieval import unit
from tallyquill.shipping import ship
from tallyquill.store import once

#: Vectors of a block, vectors of a cell that one task packs, cells at most, components of the sample that they are fitted on.
BLOCK, PART, MOST_CELLS, SAMPLE = 512, 32_768, 4096, 1 << 22
#: Queries, or heads of blocks, that meet as one; blocks that a query reads first.
PACK, FIRST = 2048, 2
#: Ways of the blocks in a sweep, components of the queries that a task of it holds.
WAYS, HELD = 32, 1 << 24
#: What rounding may do to a cosine, scores being compared to nine decimals.
SLACK = 2e-9


def fitted_cells(units: np.ndarray, n: int, block: int) -> np.ndarray:
    """Centers of about ``n`` / ``block`` cells, by spherical k-means on a sample of unit vectors."""
    rng = np.random.default_rng(0)
    count = int(min(max(1, n // block), MOST_CELLS, max(1, len(units) // 4)))
    centers = units[np.sort(rng.choice(len(units), count, replace=False))]
    for _ in range(6):
        at = nearest(units, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, units)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centers)
    return centers


def nearest(units: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *((units[i : i + PACK] @ centers.T).argmax(axis=1) for i in range(0, len(units), PACK))])


def _matrices(ids: pa.Array, vectors: pa.ListArray):
    """(dim, ids, matrix) for each length of vectors in a batch."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        at = pa.array(np.flatnonzero(sizes == dim))
        yield dim, at, ids.take(at), vectors.take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)


@dataclass
class Store:
    """An index as it is stored: ``blocks`` has block, dim, collection, n, ids, x, center, radius."""

    blocks: DataFrame

    def heads(self) -> DataFrame:
        """What tells whether a block has to be read; the packed vectors stay unread."""
        return self.blocks.select("block", "dim", "collection", "center", "radius")


def _units(df: DataFrame, key: str, *more: Column) -> DataFrame:
    """(id, v, ...): unit vectors; null ones, ones of zeros and those with parts that aren't finite take no part."""
    rows = df.where(F.col("vec").isNotNull()).select(F.col(key).alias("id"), unit(F.col("vec")).alias("v"), *more)
    return rows.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def build(nodes: DataFrame, path: str, block: int = BLOCK) -> Store:
    """Stores nodes (node_id, vec, collection, a whole number) as an index under ``path``.

    Vectors go to the nearest of the cells, which are fitted on a sample, and are packed by cell and
    collection; a cell of very many is packed by several tasks. The manifest is written last and names the
    folder of the blocks and how many there are: without it, or with other blocks than it says, nothing is loaded.
    """
    spark = nodes.sparkSession
    ship(spark)
    rows = _units(nodes, "node_id", F.col("collection").cast("int").alias("collection"))
    sizes = {r["dim"]: r["n"] for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    cells: dict[int, np.ndarray] = {}
    if sizes:
        share = F.create_map(*[F.lit(x) for dim, n in sizes.items() for x in (dim, min(1.0, max(256, SAMPLE // dim) / n))])
        sample = rows.where(F.rand(5) < F.element_at(share, F.size("v"))).select("id", "v").limit(sum(2 * max(256, SAMPLE // dim) for dim in sizes)).toArrow().combine_chunks()
        if sample.num_rows:
            cells = {dim: fitted_cells(x, sizes[dim], block) for dim, _, _, x in _matrices(sample["id"].combine_chunks(), sample["v"].combine_chunks())}

    def deal(batches):
        for b in batches:
            dims, at = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)
            for dim, place, _, x in _matrices(b.column(0), b.column(1)):
                dims[place] = dim
                if dim in cells:
                    at[place] = nearest(x, cells[dim])
            yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(at), b.column(2), b.column(0), b.column(1)], ["dim", "cell", "collection", "id", "v"])

    kind = rows.schema["id"].dataType
    whole = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("collection", T.IntegerType()), T.StructField("id", kind), T.StructField("v", T.ArrayType(T.DoubleType()))])
    dealt = once(rows.select("id", "v", "collection").mapInArrow(deal, whole), "cells")
    parts = dealt.groupBy("dim", "cell", "collection").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))  # a row a cell and collection
    keys = ["dim", "collection", "cell", "part"]
    sorted_ = dealt.join(F.broadcast(parts), ["dim", "cell", "collection"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    sorted_ = sorted_.select(*keys, "id", "v").repartition(*keys).sortWithinPartitions(*keys, "id")
    schema = T.StructType([
        T.StructField("block", T.StringType()), T.StructField("dim", T.IntegerType()), T.StructField("collection", T.IntegerType()), T.StructField("n", T.IntegerType()),
        T.StructField("ids", T.ArrayType(kind)), T.StructField("x", T.BinaryType()), T.StructField("center", T.ArrayType(T.DoubleType())), T.StructField("radius", T.DoubleType()),
    ])

    def pack(batches):
        key, ids, held, number = None, [], [], 0

        def flush():
            x = np.concatenate(held)
            names = pa.chunked_array(ids).combine_chunks()
            center = x.sum(axis=0)
            size = float(np.sqrt(center @ center))
            center = center / size if size > 1e-9 else x[0]
            radius = float(np.arccos(np.clip((x @ center).min(), -1, 1)))
            row = [f"{'-'.join(map(str, key))}-{number}", key[0], key[1], len(x), None, x.astype("<f8").tobytes(), center.tolist(), radius]
            ids.clear(), held.clear()
            arrays = [pa.array([v]) for v in row]
            arrays[1:4] = [pa.array([v], pa.int32()) for v in row[1:4]]
            arrays[4] = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            arrays[5], arrays[6] = pa.array([row[5]], pa.binary()), pa.array([row[6]], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for b in batches:
            where = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1, [len(where)]]).tolist()
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                now = tuple(where[lo].tolist())
                if now != key:
                    if held:
                        yield flush()
                    key, number = now, 0
                x = b.column(5).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, now[0])
                at = 0
                while at < hi - lo:
                    n = min(hi - lo - at, block - sum(map(len, held)))
                    ids.append(b.column(4).slice(lo + at, n))
                    held.append(x[at : at + n])
                    at += n
                    if sum(map(len, held)) == block:
                        yield flush()
                        number += 1
        if held:
            yield flush()

    data = f"blocks-{uuid.uuid4().hex}"
    sorted_.mapInArrow(pack, schema).write.parquet(f"{path}/{data}")
    got = spark.read.parquet(f"{path}/{data}").agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    said = json.dumps({"data": data, "blocks": got["blocks"], "rows": got["rows"]})
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return Store(spark.read.parquet(f"{path}/{data}"))


def load(spark: SparkSession, path: str) -> Store | None:
    """The index under ``path``; None where there is none, or a torn one."""
    ship(spark)
    try:
        said = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))
        blocks = spark.read.parquet(f"{path}/{said['data']}")
        got = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    except (AnalysisException, ValueError, KeyError):
        return None
    return Store(blocks) if (got["blocks"], got["rows"]) == (said["blocks"], said["rows"]) else None


def load_or_build(nodes: DataFrame, path: str, rebuild: bool = False, block: int = BLOCK) -> Store:
    """What is stored; built if it isn't there, is torn, or ``rebuild`` asks for it."""
    found = None if rebuild else load(nodes.sparkSession, path)
    return found or build(nodes, path, block)


def _packed(df: DataFrame, kind: T.DataType, n_ways: int) -> DataFrame:
    """(id, v, facts: two numbers, to) -> packs of one length, collection and way: (dim, to, way, ids, x, facts)."""
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("to", T.IntegerType()), T.StructField("way", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("x", T.BinaryType()), T.StructField("facts", T.BinaryType())])
    dealt = df.select(F.size("v").alias("dim"), "to", F.pmod(F.xxhash64("id"), F.lit(n_ways)).cast("int").alias("way"), "id", "v", "facts").repartition("dim", "to", "way").sortWithinPartitions("dim", "to", "way", "id")

    def pack(batches):
        for b in batches:
            where = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1, [len(where)]]).tolist()
            for a, z in zip(cuts, cuts[1:], strict=False):
                for lo in range(a, z, PACK):
                    n = min(z - lo, PACK)
                    x, facts = (b.column(c).slice(lo, n).flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes() for c in (4, 5))
                    ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.column(3).slice(lo, n))
                    yield pa.RecordBatch.from_arrays([*(pa.array([int(w)], pa.int32()) for w in where[lo]), ids, pa.array([x], pa.binary()), pa.array([facts], pa.binary())], schema.names)

    return dealt.mapInArrow(pack, schema)


def _ways(n: int) -> int:
    return max(1, -(-n // (4 * PACK)))


def _bound(q: np.ndarray, centers: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The largest cosines that queries can have with vectors of blocks."""
    return np.cos(np.maximum(np.arccos(np.clip(q @ centers.T, -1, 1)) - radius, 0)) + SLACK


def probes(store: Store, queries: DataFrame, first: int | None = None, by_query: bool = True) -> DataFrame:
    """Which blocks queries (id, v, asked, least) have to read: (query_id, block), or without ``by_query`` those that any reads: (block).

    The cosine of a query with a vector of a block is at most that of their angle to its center less the
    radius. With ``first``, the blocks of the largest bound, so many a query; else all whose bound reaches
    ``least``. Heads of blocks meet packs of queries in an equi-join by ways of both, like vectors in a search by
    brute force, but a head stands for a whole block.
    """
    kind = queries.schema["id"].dataType
    heads = store.heads().select(F.col("block").alias("id"), F.col("center").alias("v"), F.col("collection").alias("to"), F.array("radius", F.lit(0.0)).alias("facts"))
    asked = queries.select("id", "v", F.explode("asked").alias("to"), F.array("least", F.lit(0.0)).alias("facts"))
    q_ways, h_ways = _ways(queries.count()), _ways(heads.count())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _packed(asked, kind, q_ways).select("dim", "to", F.col("way").alias("q_way"), every(h_ways).alias("way"), F.col("ids").alias("q_ids"), F.col("x").alias("q"), F.col("facts").alias("q_facts"))
    right = _packed(heads, T.StringType(), h_ways).select("dim", "to", "way", every(q_ways).alias("q_way"), "ids", "x", "facts")
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("block", T.StringType()), T.StructField("bound", T.DoubleType())][0 if by_query else 1 : 3 if by_query else 2])

    def bound(batches):
        for b in batches:
            for r in range(b.num_rows):
                dim, (q_ids, ids) = b.column(0)[r].as_py(), (b.column(c)[r].values for c in (1, 4))
                q, least, x, radius = (np.frombuffer(b.column(c)[r].as_py(), "<f8").reshape(-1, w) for c, w in ((2, dim), (3, 2), (5, dim), (6, 2)))
                most = _bound(q, x, radius[:, 0])
                if not by_query:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.flatnonzero((most >= least[:, :1]).any(axis=0))))], schema.names)
                    continue
                if first is None:
                    i, j = np.nonzero(most >= least[:, :1])
                else:
                    n = min(first, len(ids))
                    j = np.argpartition(-most, n - 1, axis=1)[:, :n]
                    i, j = np.repeat(np.arange(len(q_ids)), n), j.ravel()
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(most[i, j])], schema.names)

    met = left.join(right, ["dim", "to", "q_way", "way"]).select("dim", "q_ids", "q", "q_facts", "ids", "x", "facts").mapInArrow(bound, schema)
    if not by_query:
        return met.distinct()
    if first is not None:
        order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
        met = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first)
    return met.select("query_id", "block")


def _read(store: Store, wanted: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query among the vectors of the blocks that it reads."""
    kind, id_kind = queries.schema["id"].dataType, store.blocks.schema["ids"].dataType.elementType
    asked = wanted.join(queries.select(F.col("id").alias("query_id"), "v", "least"), "query_id").withColumn("pack", F.pmod(F.xxhash64("query_id"), F.lit(_ways(queries.count()))).cast("int"))
    packs = asked.groupBy("block", "pack").agg(F.collect_list(F.struct("query_id", "v", "least")).alias("asked"))  # a pack holds at most some 8,000 queries
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("node_id", id_kind), T.StructField("score", T.DoubleType())])

    def multiply(batches):
        for b in batches:
            for r in range(b.num_rows):
                held, ids = b.column(0)[r].values, b.column(1)[r].values
                x = np.frombuffer(b.column(2)[r].as_py(), "<f8").reshape(len(ids), -1)
                q = held.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(held), x.shape[1])
                s = q @ x.T
                place = np.round(s, 9)
                n = min(k, place.shape[1])
                least = np.maximum(-np.partition(-place, n - 1, axis=1)[:, n - 1], held.field("least").to_numpy(zero_copy_only=False) - SLACK)
                i, j = np.nonzero(place >= least[:, None])
                yield pa.RecordBatch.from_arrays([held.field("query_id").take(pa.array(i)), ids.take(pa.array(j)), pa.array(s[i, j])], schema.names)

    return packs.join(store.blocks.select("block", "ids", "x"), "block").select("asked", "ids", "x").mapInArrow(multiply, schema)


class _Kept:
    """The k best of a pack of queries among the vectors of the blocks seen so far."""

    def __init__(self, ids: pa.Array, q: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.q, self.least, self.k = ids, q, least.copy(), k
        self.rows, self.scores, self.nodes, self.n = [], [], [], 0

    def meet(self, ids: pa.Array, x: np.ndarray, center: np.ndarray, radius: float) -> None:
        """Takes in a block, for the queries whose kth score it can reach."""
        some = np.flatnonzero(_bound(self.q, center[None, :], np.array([radius]))[:, 0] >= self.least)
        if not len(some):
            return
        s, least = self.q[some] @ x.T, self.least[some]
        i, j = np.nonzero(s >= (least - SLACK)[:, None])
        if len(i) > 4 * self.k * len(some):  # few are known yet: no more than the k best, and what ties with them
            place, n = np.round(s, 9), min(self.k, s.shape[1])
            i, j = np.nonzero(place >= np.maximum(-np.partition(-place, n - 1, axis=1)[:, n - 1], least - SLACK)[:, None])
        if len(i):
            self.rows.append(some[i]), self.scores.append(s[i, j]), self.nodes.append(ids.take(pa.array(j)))
            self.n += len(i)
        if self.n > 8 * self.k * len(self.q):
            self.settle()

    def settle(self) -> None:
        """Keeps k a query, ties going to the smaller node."""
        if not self.n:
            return
        rows, scores, nodes = np.concatenate(self.rows), np.concatenate(self.scores), pa.chunked_array(self.nodes).combine_chunks()
        place = np.round(scores, 9)
        order = pc.sort_indices(pa.table({"row": rows, "place": place, "id": nodes}), sort_keys=[("row", "ascending"), ("place", "descending"), ("id", "ascending")], null_placement="at_start").to_numpy()
        at = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
        last = order[at == self.k - 1]
        self.least[rows[last]] = np.maximum(self.least[rows[last]], place[last])
        order = order[at < self.k]
        self.rows, self.scores, self.nodes, self.n = [rows[order]], [scores[order]], [nodes.take(pa.array(order))], len(order)

    def hits(self, names: list[str]) -> pa.RecordBatch | None:
        self.settle()
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(self.rows[0])), self.nodes[0], pa.array(self.scores[0])], names) if self.n else None


def _swept(store: Store, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query (id, v, asked, least) in every way of the blocks, of those that reach ``least``.

    Blocks that some query has to read are dealt to ``WAYS`` ways, and each way's task first reads the packs of the queries,
    which it holds, then its blocks one by one. So a block is shuffled once a group of queries, a query once a way, and neither
    once a pair. Queries are in one group up to ``HELD`` components, which is what a task holds.
    """
    kind, id_kind = queries.schema["id"].dataType, store.blocks.schema["ids"].dataType.elementType
    asked = queries.select("id", "v", F.explode("asked").alias("to"), F.array("least", F.lit(0.0)).alias("facts"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("components")).first()
    groups = max(1, -(-size["components"] // HELD))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda t: F.lit(None).cast(t)
    keys = ["dim", "to", "group", "way"]
    packs = _packed(asked, kind, groups * _ways(size["n"])).select("dim", "to", F.pmod("way", F.lit(groups)).alias("group"), every(WAYS).alias("way"), F.lit(0).alias("side"), F.col("ids").alias("q_ids"), none(T.ArrayType(id_kind)).alias("ids"), "x", "facts", none("array<double>").alias("center"), none("double").alias("radius"))
    wanted = store.blocks.join(probes(store, queries, by_query=False), "block", "left_semi")
    blocks = wanted.select("dim", F.col("collection").alias("to"), every(groups).alias("group"), F.pmod(F.xxhash64("block"), F.lit(WAYS)).cast("int").alias("way"), F.lit(1).alias("side"), none(T.ArrayType(kind)).alias("q_ids"), "ids", "x", none("binary").alias("facts"), "center", "radius")
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("node_id", id_kind), T.StructField("score", T.DoubleType())])

    def sweep(batches):
        key, held = None, []
        for b in batches:
            for r in range(b.num_rows):
                now = tuple(b.column(i)[r].as_py() for i in range(4))
                if now != key:
                    yield from filter(None, (p.hits(schema.names) for p in held))
                    key, held = now, []
                x = np.frombuffer(b.column(7)[r].as_py(), "<f8").reshape(-1, now[0])
                if b.column(4)[r].as_py() == 0:
                    held.append(_Kept(pa.concat_arrays([b.column(5)[r].values]), x, np.frombuffer(b.column(8)[r].as_py(), "<f8").reshape(-1, 2)[:, 0], k))
                else:
                    center, radius = b.column(9)[r].values.to_numpy(zero_copy_only=False), b.column(10)[r].as_py()
                    for p in held:
                        p.meet(b.column(6)[r].values, x, center, radius)
        yield from filter(None, (p.hits(schema.names) for p in held))

    return packs.unionByName(blocks).repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(sweep, schema)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "node_id")
    return hits.withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= k)


def search(store: Store, queries: DataFrame, k: int = 5, asked: Column | None = None) -> DataFrame:
    """R4 on a stored index: queries (query_id, vec) -> query_id, node_id, score, seq, exactly as ``vector_topk`` gives them.

    ``asked``, an array of collections, tells which ones a query is for (all, by default). A query reads the
    ``FIRST`` blocks of the largest bound. Its kth score there is what a block has to be able to reach to be read
    in the second round, a sweep over the blocks; near vectors being packed together, most blocks of clustered vectors
    can't. Query ids have to be different.
    """
    if asked is None:
        all_ = [r["collection"] for r in store.heads().select("collection").distinct().collect()]  # as many as there are collections
        asked = F.array(*map(F.lit, all_)) if all_ else F.array().cast("array<int>")
    q = once(_units(queries, "query_id", F.array_distinct(asked.cast("array<int>")).alias("asked")).withColumn("least", F.lit(-2.0)), "asked")
    near = _best(_read(store, probes(store, q, FIRST), q, k), k)
    least = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.round(F.min("score"), 9)).alias("found"))
    known = once(q.drop("least").join(least, "id", "left").withColumn("least", F.coalesce("found", F.lit(-2.0))).drop("found"), "asked")
    return _best(_swept(store, known, k), k).select("query_id", "node_id", "score", "seq")
