"""Approximate nearest neighbours: candidates in probed lists are given up early, from some rotated dimensions."""

from __future__ import annotations

from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyquill.llm.common import written
from tallyquill.llm.topk import usable
from tallyquill.shipping import ship

#: Components of the sample on which the lists are fitted, at most about.
SAMPLE = 1 << 22
#: Rows of a list on average, lists at most, and rows of a list that are searched by one task.
LIST, MOST_LISTS, PART = 1024, 4096, 8192
#: Bytes of a block's vectors, queries in a pack on average, queries that a task keeps in mind.
BLOCK_BYTES, PACK, KEPT = 1 << 20, 1024, 65_536
#: Dimensions that are read at once, and how sure a test has to be that a candidate is too far.
COLUMNS, SURE = 16, 2.1
#: Expected number of better candidates in the lists that a query doesn't probe.
MISSED = 0.05
#: Rounding of single-precision squared distances between unit vectors.
SLACK = 1e-5


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1, so that squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def units(x: np.ndarray) -> np.ndarray:
    y = scaled(x)
    return y / np.sqrt((y * y).sum(axis=1))[:, None]


def upper_tail(z: np.ndarray) -> np.ndarray:
    """Probability that a standard normal variable exceeds ``z``."""
    return 0.5 * (1 - np.vectorize(erf, otypes=[float])(z / np.sqrt(2)))


class Space:
    """The rotation and the lists of vectors of one length."""

    def __init__(self, sample: np.ndarray, n: int, seed: int = 0) -> None:
        """Spherical k-means on the unit vectors ``sample`` of ``n``."""
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.turn = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        lists = int(min(max(1, -(-n // LIST)), MOST_LISTS, max(1, len(sample) // 16)))
        self.centers = sample[np.sort(rng.choice(len(sample), lists, replace=False))]
        for _ in range(8):
            at = self.nearest(sample)[0]
            sums = np.zeros_like(self.centers)
            np.add.at(sums, at, sample)
            size = np.sqrt((sums * sums).sum(axis=1))
            self.centers = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], self.centers)
        at, along = self.nearest(sample)
        beside = sample - along[:, None] * self.centers[at]
        spread = np.linalg.eigvalsh(beside.T @ beside / len(sample)).clip(0)
        #: Dimensions in which vectors really differ from their list's center.
        self.freedom = max(1.0, float(spread.sum() ** 2 / max((spread**2).sum(), 1e-300))) if spread.sum() > 1e-12 else float(self.dim)
        self.rows, self.mean, self.var = np.zeros(lists, np.int64), np.zeros(lists), np.zeros(lists)

    def nearest(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each unit vector its list, and its cosine with the list's center."""
        at, along = np.empty(len(u), np.int64), np.empty(len(u))
        for lo in range(0, len(u), 4096):
            cosines = u[lo : lo + 4096] @ self.centers.T
            at[lo : lo + 4096] = best = cosines.argmax(axis=1)
            along[lo : lo + 4096] = cosines[np.arange(len(best)), best]
        return at, along

    def first_lists(self, cosines: np.ndarray, k: int) -> np.ndarray:
        """The nearest lists, two at least and as many as hold four times ``k`` rows."""
        order = np.argsort(-cosines, kind="stable")
        order = order[self.rows[order] > 0]
        enough = int(np.searchsorted(np.cumsum(self.rows[order]), 4 * k)) + 1
        return order[: max(2, enough)]

    def lists_for(self, cosines: np.ndarray, least: float, k: int) -> np.ndarray:
        """Further lists to probe for a query whose kth best score so far is ``least``.

        A vector of a list has the cosine s·p + sqrt(1 - s²)·sqrt(1 - p²)·z with the query, where s and p are
        the cosines of both with the center, and z that of what they have beside it, about normal with
        variance 1 / freedom. This gives the number of better vectors to expect in each list. Lists are
        probed, those that promise most first, until the rest promises less than ``MISSED`` together.
        """
        beside = (1 - cosines**2).clip(0) * (1 - self.mean**2 - self.var).clip(0) / self.freedom
        sigma = np.sqrt(cosines**2 * self.var + beside) + 1e-6
        hope = self.rows * upper_tail((least - cosines * self.mean) / sigma)
        hope[self.first_lists(cosines, k)] = 0
        order = np.argsort(hope, kind="stable")
        return order[np.cumsum(hope[order]) > MISSED]


def scan(turned: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Which columns of ``turned`` may be within the squared distance ``most`` of ``q``.

    Dimensions are read ``COLUMNS`` at a time. After d of them a rotated difference has about d / D of its
    squared length, so a candidate is given up where its part exceeds what the test at level ``SURE`` allows
    for one as near as ``most``; the rest of its dimensions isn't read.
    """
    dim = len(q)
    left, part = np.arange(turned.shape[1]), np.zeros(turned.shape[1], np.float32)
    for lo in range(0, dim, COLUMNS):
        hi = min(dim, lo + COLUMNS)
        block = turned[lo:hi] if len(left) == turned.shape[1] else turned[lo:hi, left]
        d = block - q[lo:hi, None]
        part = part + np.einsum("ij,ij->j", d, d)
        if most < 4:
            near = part <= SLACK + (most if hi == dim else most * hi / dim * (1 + SURE / hi**0.5) ** 2)
            left, part = left[near], part[near]
            if not len(left):
                break
    return left


def _vectors(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components of a list column, and where each row's begin and end."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False), end - size, end


def _by_length(column: pa.ListArray):
    """(dim, places, vectors) for each length that occurs."""
    values, begin, end = _vectors(column)
    size = end - begin
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        yield dim, at, values[(begin[at, None] + np.arange(dim)).ravel()].reshape(len(at), dim)


def _stored(x: np.ndarray) -> tuple[str, bytes]:
    """Components in the smallest float type that holds them exactly."""
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    return ("<f4", small.tobytes()) if np.array_equal(small, x) else ("<f8", x.astype("<f8").tobytes())


def one_a_row(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part; of rows that share an id the smallest vector."""
    v = F.col(vector_col)
    fit = usable(v) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    return df.where(fit).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def fit_spaces(rows: DataFrame) -> dict[int, Space]:
    """A space for each length of vectors, fitted on a sample of about ``SAMPLE`` components."""
    sizes = {r["dim"]: r["n"] for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {dim: min(1.0, max(256, SAMPLE // dim) / n) for dim, n in sizes.items()}
    if not sizes:
        return {}
    chance = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.size("v"))
    most = sum(2 * max(256, SAMPLE // dim) for dim in sizes)
    got = rows.where(F.rand(13) < chance).select("v").limit(most).toArrow()["v"].combine_chunks()
    found = {dim: x for dim, _, x in _by_length(got)} if len(got) else {}
    return {dim: Space(units(found[dim]) if dim in found else np.eye(1, dim), n) for dim, n in sizes.items()}


def _tops(found: DataFrame, k: int, by: str, last: str = "vec_id") -> DataFrame:
    """The best ``k`` rows of each ``by``, with their rank."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), last)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found by cosine for each query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    Every row is dealt to the list of its nearest center; the centers come from k-means on a sample. A query
    searches its nearest lists first. What it finds there tells, by the lists' statistics over all rows, in
    which others better rows are to be expected; these are searched until what is left promises less than
    ``MISSED`` rows. So a query into a cluster probes few lists, and one without near neighbours most. Inside a
    list, vectors are stored rotated, in blocks of columns, and given up as ``scan`` tells; those not given up
    are scored in double precision on the original components. The lists searched, and rows beyond the test's
    level, are all that is approximate.

    Equal vectors tie, so of more than k + 1 of them only those of smallest id can be a neighbour, and equal
    queries are searched once; both hold however many there are. A list is searched in parts of about
    ``PART`` rows, each by tasks of its own.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows with a null
    id. Rows that share an id count as one, that of the smallest vector. Vectors of another length than
    the query's are no candidates, nor is its own id. Ties go to the smaller id. A query without candidates has no
    rows, as has an empty table. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = one_a_row(vectors, id_col, vector_col)
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    rows = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).select("id", "v")
    spaces = fit_spaces(vectors.where(usable(F.col(vector_col)) & F.exists(vector_col, lambda x: x != 0)).select(F.col(vector_col).cast("array<double>").alias("v")))
    if not spaces:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def deal(batches):
        for b in batches:
            dims, lists, along = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for dim, at, x in _by_length(b.column(1)):
                dims[at] = dim
                lists[at], along[at] = spaces[dim].nearest(units(x))
            yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(lists), pa.array(along), b.column(0), b.column(1)], ["dim", "list", "along", "id", "v"])

    dealt = written(rows.mapInArrow(deal, "dim int, list int, along double, id long, v array<double>"), "lists")
    told = dealt.groupBy("dim", "list").agg(F.count(F.lit(1)).alias("n"), F.avg("along").alias("mean"), F.var_pop("along").alias("var")).collect()
    for r in told:
        space = spaces[r["dim"]]
        space.rows[r["list"]], space.mean[r["list"]], space.var[r["list"]] = r["n"], r["mean"], r["var"]
    parts = spark.createDataFrame([(r["dim"], r["list"], -(-r["n"] // PART)) for r in told], "dim int, list int, parts int")  # a row a list

    blocks = dealt.join(F.broadcast(parts), ["dim", "list"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = blocks.repartition("dim", "list", "part").sortWithinPartitions("dim", "list", "part", "id").select("dim", "list", "part", "id", "v")
    blocks = written(blocks.mapInArrow(lambda batches: _blocks(batches, spaces), "dim int, list int, part int, ids binary, turned binary, kind string, x binary"), "blocks")

    asked = one_a_row(queries, id_col, vector_col)
    once = written(asked.groupBy("v").agg(F.min("id").alias("rep")).withColumn("least", F.lit(-2.0)), "queries")
    members = asked.join(once, "v").select("rep", F.col("id").alias("query_id"))
    n_packs = max(1, -(-once.count() // PACK))

    def search(wanted: DataFrame, first: bool) -> DataFrame:
        probes = wanted.mapInArrow(lambda batches: _probes(batches, spaces, k + 1, first), "dim int, list int, rep long, least double, v array<double>")
        probes = probes.withColumn("pack", F.pmod(F.xxhash64("rep"), F.lit(n_packs)).cast("int"))
        packs = probes.repartition("dim", "list", "pack").sortWithinPartitions("dim", "list", "pack").mapInArrow(_packs, "dim int, list int, reps binary, least binary, q binary")
        packs = packs.join(F.broadcast(parts), ["dim", "list"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = blocks.join(packs, ["dim", "list", "part"]).select("dim", "ids", "turned", "kind", "x", "reps", "least", "q")
        return _tops(met.mapInArrow(lambda batches: _search(batches, spaces, k + 1), "rep long, vec_id long, score double"), k + 1, "rep").select("rep", "vec_id", "score")

    near = written(search(once.select("rep", "least", "v"), True), "found")
    least = near.groupBy("rep").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).otherwise(-2.0).alias("least"))
    further = search(once.drop("least").join(least, "rep", "left").select("rep", F.coalesce("least", F.lit(-2.0)).alias("least"), "v"), False)
    best = written(_tops(near.unionByName(further), k + 1, "rep").select("rep", "vec_id", "score"), "found")
    own = members.join(best, "rep").where(F.col("vec_id") != F.col("query_id"))
    return _tops(own, k, "query_id").select("query_id", "rank", "vec_id", "score")


def _blocks(batches, spaces: dict[int, Space]):
    """Rows sorted by list and part -> blocks of one list and part: ids, rotated unit vectors by column, original components."""
    names, key, ids, held = ["dim", "list", "part", "ids", "turned", "kind", "x"], None, [], []

    def flush():
        x = np.concatenate(held)
        kind, stored = _stored(x)
        turned = np.ascontiguousarray((units(x) @ spaces[key[0]].turn).T.astype("<f4"))
        values = [[v] for v in (*key, np.concatenate(ids).astype("<i8").tobytes(), turned.tobytes(), kind, stored)]
        ids.clear(), held.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (*[pa.int32()] * 3, pa.binary(), pa.binary(), pa.string(), pa.binary()), strict=True)], names)

    for b in batches:
        where = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
        number, (values, begin, end) = b.column(3).to_numpy(), _vectors(b.column(4))
        cuts = np.concatenate([[0], np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1, [len(where)]]).tolist()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            now = tuple(where[lo].tolist())
            if held and now != key:
                yield flush()
            key, size = now, max(1, BLOCK_BYTES // (8 * now[0]))
            while lo < hi:
                n = min(hi - lo, size - sum(map(len, held)))
                ids.append(number[lo : lo + n])
                held.append(values[begin[lo] : end[lo + n - 1]].reshape(n, now[0]))
                lo += n
                if sum(map(len, held)) == size:
                    yield flush()
    if held:
        yield flush()


def _probes(batches, spaces: dict[int, Space], k: int, first: bool):
    """Queries (rep, least, v) -> a row for each list that is to be searched."""
    for b in batches:
        reps, least = b.column(0), b.column(1).to_numpy()
        for dim, at, x in _by_length(b.column(2)):
            if dim not in spaces:
                continue
            space = spaces[dim]
            cosines = (units(x) @ space.centers.T).clip(-1, 1)
            for i, c in zip(at.tolist(), cosines, strict=True):
                lists = space.first_lists(c, k) if first else space.lists_for(c, least[i], k)
                if len(lists):
                    row = pa.array(np.full(len(lists), i))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lists), dim, np.int32)), pa.array(lists.astype(np.int32)), reps.take(row), b.column(1).take(row), b.column(2).take(row)], ["dim", "list", "rep", "least", "v"])


def _packs(batches):
    """Queries sorted by list -> packs of queries of one list."""
    names, kinds = ["dim", "list", "reps", "least", "q"], (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    for b in batches:
        where = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
        reps, least, (values, begin, end) = b.column(2).to_numpy(), b.column(3).to_numpy(), _vectors(b.column(4))
        cuts = np.concatenate([[0], np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1, [len(where)]]).tolist()
        out = [(*where[lo].tolist(), reps[lo:hi].tobytes(), least[lo:hi].tobytes(), values[begin[lo] : end[hi - 1]].astype("<f8").tobytes()) for lo, hi in zip(cuts, cuts[1:], strict=False) if lo < hi]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], names)


def _search(batches, spaces: dict[int, Space], k: int):
    """Blocks met by packs -> the best ``k`` of each query that a task has seen: (rep, vec_id, score)."""
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def flush():
        rows = [(q, i, s) for q, (ss, ii) in best.items() for s, i in zip(ss.tolist(), ii.tolist(), strict=True)]
        best.clear()
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["rep", "vec_id", "score"])

    last = None
    for b in batches:
        for row in b.to_pylist():
            dim = row["dim"]
            if last is None or last[0] != row["ids"]:
                ids = np.frombuffer(row["ids"], "<i8")
                x = scaled(np.frombuffer(row["x"], row["kind"]).astype(np.float64).reshape(len(ids), dim))
                last = row["ids"], ids, np.frombuffer(row["turned"], "<f4").reshape(dim, len(ids)), x, np.sqrt((x * x).sum(axis=1))
            _, ids, turned, x, size = last
            asked = scaled(np.frombuffer(row["q"], "<f8").reshape(-1, dim))
            length = np.sqrt((asked * asked).sum(axis=1))
            rotated = (asked / length[:, None] @ spaces[dim].turn).astype(np.float32)
            for n, (rep, least) in enumerate(zip(np.frombuffer(row["reps"], "<i8").tolist(), np.frombuffer(row["least"], "<f8").tolist(), strict=True)):
                scores, found = best.get(rep, (np.empty(0), np.empty(0, np.int64)))
                if len(scores) == k:
                    least = max(least, float(scores[-1]))
                left = scan(turned, rotated[n], 2 - 2 * least)
                if not len(left):
                    continue
                got = (x[left] * asked[n]).sum(axis=1) / (size[left] * length[n])
                good = got >= least
                got, new = np.concatenate([scores, got[good]]), np.concatenate([found, ids[left[good]]])
                order = np.lexsort((new, -got))[:k]
                best[rep] = got[order], new[order]
            if len(best) > KEPT:
                yield flush()
    yield flush()


def op13_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
