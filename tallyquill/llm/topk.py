"""Exact top-k search by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyquill.shipping import ship

#: Vectors in a block of candidates, queries in one of theirs, and queries that meet a copy of a candidate, on average.
BLOCK, PIECE, QUERIES = 4096, 1024, 16_384
#: Depth to which the lists are read in the first round; it doubles from round to round.
FIRST_DEPTH = 32
#: Ways into which the candidates are dealt, at least, and how many candidates a way has at most on average.
WAYS, WAY = 48, 262_144
LARGEST = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether the vector and all its components are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(v: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of doubles as 64-bit integers or, where one doesn't fit 62 bits, as Python's."""
    if not len(v) or np.abs(v).max() * float(scale) < 2.0**62:
        return np.floor(v * float(scale)).astype(np.int64)
    out = np.empty(len(v), object)
    out[:] = [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in v.tolist()]
    return out


def sort_key(score: int) -> bytes:
    """Bytes in the order of exact scores: sign and length, then the digits of this length."""
    n = (score.bit_length() + 7) // 8
    head, body = (0x8000 + n, score) if score >= 0 else (0x7FFF - n, score + (1 << (8 * n)))
    return head.to_bytes(2, "big") + body.to_bytes(n, "big")


def nearest_long(score: int) -> int:
    return max(-LARGEST - 1, min(LARGEST, score))


class Lists:
    """A block of vectors with its per-dimension lists, sorted by component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()  # ascending, one row a dimension
        self.columns = x.T.copy()

    def search(self, q: np.ndarray, own: int, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best k of (scores, ids) and this block, ``own`` left out; best first.

        Round by round the lists are read deeper, from the end that makes the product with the
        query's component largest. Vectors met for the first time are scored in full. What no list
        has shown yet scores at most the sum of the products at the current depth, so the search ends
        once that bound is below the kth score (at equality a smaller id could still win).
        """
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = self.ids == own
        left = n - int(seen.sum())
        depth, step = 0, FIRST_DEPTH
        while left:
            end = min(n, depth + step)
            met = np.concatenate([self.order[up, n - end : n - depth].ravel(), self.order[down, depth:end].ravel()])
            if not len(met):  # all components of the query are zero: every product is
                end, met = n, np.arange(n)
            fresh = np.zeros(n, bool)
            fresh[met] = True
            fresh &= ~seen
            new = np.flatnonzero(fresh)
            if len(new):
                seen |= fresh
                left -= len(new)
                got = self.x[new] @ q
                if len(scores) >= k:
                    good = got >= scores[-1]
                    new, got = new[good], got[good]
                if len(new):
                    scores, ids = np.concatenate([scores, got]), np.concatenate([ids, self.ids[new]])
                    if scores.dtype == object:
                        best = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
                    else:
                        best = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[best], ids[best]
            bound = self.columns[up, self.order[up, n - end]] @ q[up] + self.columns[down, self.order[down, end - 1]] @ q[down]
            if end == n or len(scores) >= k and bound < scores[-1]:
                break
            depth, step = end, step * 2
        return scores, ids


def _packer(scale: int, size: int):
    """Rows (part, id, vector) as blocks of vectors of one length and part: (dim, part, kind, ids, components).

    ``kind`` is the type of the components; those beyond 62 bits are in blocks of their own, as decimal text.
    """
    schema = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("x", pa.binary())])

    def pack(batches):
        held: dict[tuple, tuple[list, list]] = {}

        def flush(key):
            ids, rows = held.pop(key)
            kind, x = "text", b""
            if key[2]:
                x = " ".join(str(c) for r in rows for c in r).encode()
            else:
                many = np.stack(rows)
                most = int(np.abs(many).max(initial=0))
                kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
                x = many.astype(kind).tobytes()
            return pa.RecordBatch.from_pylist([{"dim": key[0], "part": key[1], "kind": kind, "ids": np.array(ids, "<i8").tobytes(), "x": x}], schema)

        for b in batches:
            lists = b.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            for n, (part, i) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                v = whole(values[cuts[n] : cuts[n + 1]], scale)
                key = len(v), part, v.dtype == object
                ids, rows = held.setdefault(key, ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    yield flush(key)
        for key in list(held):
            yield flush(key)

    return pack, "dim int, part int, kind string, ids binary, x binary"


def _unpacked(dim: int, kind: str, ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    if kind == "text":
        out = np.empty(len(ids) // 8 * dim, object)
        out[:] = [int(c) for c in x.split()]
    else:
        out = np.frombuffer(x, kind).astype(np.int64)
    return np.frombuffer(ids, "<i8"), out.reshape(len(ids) // 8, dim)


def _reach(x: np.ndarray) -> int:
    return max((abs(int(c)) for c in (x.max(initial=0), x.min(initial=0))), default=0)


#: Types for scores, the faster ones first.
TYPES = [np.dtype(np.float64), np.dtype(np.int64), np.dtype(object)]


def _type_for(a: int, b: int, dim: int) -> np.dtype:
    """The fastest type in which inner products of components up to ``a`` and ``b`` are exact."""
    most = a * b * max(1, dim)
    return TYPES[0 if most < 1 << 52 else 1 if most < 1 << 62 else 2]


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest integer inner product for each query.

    Components x become ``floor(scale * x)``, exactly, whatever their size. Returns ``query_id``,
    ``rank`` (from 1), ``vec_id`` and ``score``; ties go to the smaller id. A query's own id is no
    candidate for it. A score beyond 64 bits is returned as the nearest long; ranks go by the exact
    scores.

    Candidates, in blocks of 4,096, are dealt to ways (48, or more so that a way has about 262,144),
    and queries to groups of about 16,384. A way and a group meet in an equi-join, and the threshold
    algorithm runs on each pair of their blocks, carrying a query's best k from block to block; k rows
    a query and way are left for the last ranking. So a candidate is copied once per 16,384 queries
    and a query once per 262,144 candidates: where all pairs have to be ruled out, as on random
    vectors, work grows with the square, but the rows moved are a ten-thousandth of the pairs.

    Vectors that are null, or hold a null or non-finite component, take no part, nor do rows
    with a null id. Vectors of another length than the query's are no candidates. Repeated query
    rows count as one query, the one with the smallest vector; repeated candidate rows are each a
    candidate. A query without candidates has no rows, as has an empty table. Other columns are not
    read.
    """
    ship(vectors.sparkSession)
    of = lambda df: df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows, asked = of(vectors), of(queries).groupBy("id").agg(F.min("v").alias("v"))
    n_asked = asked.count()
    n_groups, n_ways = max(1, -(-n_asked // QUERIES)), max(WAYS, -(-rows.count() // WAY))
    n_pieces = max(1, -(-n_asked // PIECE))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pack, schema = _packer(scale, BLOCK)
    pieces = asked.select(dealt("id", n_pieces).alias("part"), "id", "v").repartition("part").mapInArrow(_packer(scale, 2 * PIECE)[0], schema)
    pieces = pieces.select("dim", F.pmod("part", F.lit(n_groups)).alias("group"), every(n_ways).alias("way"), F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("x").alias("q"))
    blocks = rows.select(F.lit(0).alias("part"), "id", "v").mapInArrow(pack, schema)
    blocks = blocks.select("dim", every(n_groups).alias("group"), dealt("ids", n_ways).alias("way"), "kind", "ids", "x")
    pairs = blocks.join(pieces, ["dim", "group", "way"])

    def search(batches):
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        at = None

        def flush():
            found = [(q, nearest_long(int(s)), i, sort_key(int(s))) for q, (ss, ii) in state.items() for s, i in zip(ss.tolist(), ii.tolist(), strict=True)]
            state.clear()
            columns = zip(*found, strict=True) if found else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["query_id", "score", "vec_id", "key"])

        last, x, lists = None, None, {}
        for b in batches:
            for row in b.to_pylist():
                if at is not None and at != (row["dim"], row["group"]):
                    yield flush()
                at = row["dim"], row["group"]
                if last != row["ids"]:
                    last, (ids, x), lists = row["ids"], _unpacked(row["dim"], row["kind"], row["ids"], row["x"]), {}
                q_ids, qs = _unpacked(row["dim"], row["q_kind"], row["q_ids"], row["q"])
                least = _type_for(_reach(x), _reach(qs), row["dim"])
                for q_id, q in zip(q_ids.tolist(), qs, strict=True):
                    scores, best = state.get(q_id, (np.empty(0, least), np.empty(0, np.int64)))
                    kind = TYPES[max(TYPES.index(scores.dtype), TYPES.index(least))]
                    if kind not in lists:
                        lists[kind] = Lists(ids, x.astype(kind))
                    if scores.dtype != kind:
                        scores = np.array([int(s) for s in scores.tolist()], kind)
                    scores, best = lists[kind].search(q.astype(kind), q_id, k, scores, best)
                    if len(best):
                        state[q_id] = scores, best
        yield flush()

    best = pairs.select("dim", "group", "kind", "ids", "x", "q_kind", "q_ids", "q").mapInArrow(search, "query_id long, score long, vec_id long, key binary")
    by_score = Window.partitionBy("query_id").orderBy(F.col("key").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
