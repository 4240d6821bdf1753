"""Near-duplicate detection: MinHash bands, odd sketches, full sets."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyquill.llm.common import keep_only, scratch, text_of, told_apart, unwritten, written
from tallyquill.llm.components import components
from tallyquill.shipping import ship

WORDS = 5
#: Documents link where 100 * intersection >= least * union; the least of op8's contract.
LEAST = 85
#: MinHash values of a band.
ROWS = 5
#: MinHash samples folded into a sketch, and its bits.
SAMPLES, BITS = 256, 512
LONGS = BITS // 64
#: Classes on one side of a block in which a bucket is searched in full.
BLOCK = 256
#: Words of which a Python worker keeps the hash.
MOST_KNOWN = 100_000
_M1, _M2, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


_places = np.arange(1, SAMPLES + 1, dtype=np.uint64)
#: Odd multipliers and addends of the hash functions.
_A = (mixed(_places * _B) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_C = (mixed(_places * _M1) >> np.uint64(32)).astype(np.uint32)


def bands_for(least: int, miss: float = 1e-6) -> int:
    """Bands of which a pair at the limit shares none with probability ``miss`` at most: 24 for 85, 35 for 80."""
    n = 1 if least == 100 else math.ceil(math.log(miss) / math.log(1 - (least / 100) ** ROWS))
    if n * ROWS > SAMPLES:
        raise ValueError(f"a similarity of {least} % needs more than {SAMPLES} MinHash samples")
    return n


def most_odd(least: int = LEAST, miss: float = 1e-7) -> int:
    """Bits in which the sketches of a pair at the limit differ at most, but for one pair in 1/``miss``.

    The number of samples that differ is binomial; each flips two bits of the XOR, bits flipped
    twice falling back. Both spreads are taken at the normal approximation's quantile.
    """
    quantile = 5.2 if miss >= 1e-7 else 6.0
    p = 1 - least / 100
    differ = SAMPLES * p + quantile * (SAMPLES * p * (1 - p)) ** 0.5
    odd = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * differ))
    return int(odd + quantile * (odd * (1 - odd / (BITS / 2)) / 4 + 1) ** 0.5)


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MOST_KNOWN:
            self[word] = h
        return h


_words = _Hashes()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles.

    A-Z is lower-cased and words end at ASCII white space, which is just what bytes do. Fewer words
    form one shingle; no words, none.
    """
    keep_only("near_dedup", _words.clear)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    size = min(n, WORDS)
    x = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        x = x * _B + h[i : n - size + 1 + i]
    return np.unique(mixed(x))


def signature(s: np.ndarray, bands: int) -> tuple[bytes, bytes]:
    """Band keys (``bands`` longs) and the odd sketch (8 longs) of a set."""
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    h = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 512):
        part = h[i : i + 512, None] * _A + _C
        np.minimum(low, part.min(axis=0), out=low)
    values = mixed(low.astype(np.uint64) + (_places << np.uint64(32)))
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = mixed(keys * _B + values[r : bands * ROWS : ROWS])
    odd = np.bincount((values >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return keys.tobytes(), np.packbits(odd.astype(np.uint8)).tobytes()


def signatures(docs: DataFrame, n_bands: int) -> DataFrame:
    """(doc_id, text) -> doc_id, n, two fingerprints of the set, band keys, sketch as longs."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("n", "fp1", "fp2")), T.StructField("bands", T.BinaryType()), *(T.StructField(f"s{i}", T.LongType()) for i in range(LONGS))])

    def run(batches):
        for b in batches:
            n, fp, bands, sketches = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text)
                n.append(len(s))
                with np.errstate(over="ignore"):
                    fp.append((int(s.sum(dtype=np.uint64)), int(mixed(s ^ _B).sum(dtype=np.uint64))))
                x, y = signature(s, n_bands) if len(s) else (b"", bytes(BITS // 8))
                bands.append(x)
                sketches.append(y)
            marks = np.frombuffer(b"".join(sketches), "<i8").reshape(-1, LONGS)
            prints = np.array(fp, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(np.ascontiguousarray(prints[:, i])) for i in (0, 1)), pa.array(bands, pa.binary()), *(pa.array(np.ascontiguousarray(marks[:, i])) for i in range(LONGS))], schema.names)

    return docs.mapInArrow(run, schema)


def full_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id and the sorted hashes of its set, packed."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("set", T.BinaryType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], schema.names)

    return docs.mapInArrow(run, schema)


def band_keys(reps: DataFrame, n_bands: int) -> DataFrame:
    """(rep, bands, ...) -> a row (key, rep) per band."""
    schema = T.StructType([T.StructField("key", T.LongType()), reps.schema["rep"]])

    def run(batches):
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), n_bands)))], schema.names)

    return reps.select("rep", "bands").mapInArrow(run, schema)


def alike(left: str, right: str, least: int) -> Column:
    """Whether two sets can be linked, by their sizes and sketches."""
    a, b = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    odd = sum((F.bit_count(a(f"s{i}").bitwiseXOR(b(f"s{i}"))) for i in range(1, LONGS)), F.bit_count(a("s0").bitwiseXOR(b("s0"))))
    return (F.least(a("n"), b("n")) * 100 >= F.greatest(a("n"), b("n")) * least) & (odd <= most_odd(least))


def confirmed(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose full sets are near enough.

    The set of b travels once a pair, that of a once a pair's salt: a document of very many pairs
    has its partners dealt over salts.
    """
    salt = F.pmod(F.xxhash64("b"), F.lit(32)).cast("int")
    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b").withColumn("salt", salt)
    heads = pairs.select("a", salt.alias("salt")).distinct()
    with_a = heads.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
    met = with_b.join(with_a, ["a", "salt"]).select("a", "b", "set_a", "set_b")

    def run(batches):
        for b in batches:
            keep = []
            last, x = None, None
            for i, (sa, sb) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                raw = sa.as_buffer()
                if last is None or not raw.equals(last):
                    last, x = raw, np.frombuffer(raw, np.uint64)
                if near_enough(x, np.frombuffer(sb.as_buffer(), np.uint64), least):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).take(pa.array(keep, pa.int64()))

    return met.mapInArrow(run, T.StructType([pairs.schema["a"], pairs.schema["b"]]))


def block_rows(placed: DataFrame, sketch: DataFrame) -> DataFrame:
    """Members of mixed buckets (key, rep, label) dealt to blocks: side 0 holds some classes outside the
    bucket's largest component, side 1 some classes of the whole bucket; every pair of these meets in one block."""
    share = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    sizes = share.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all"))
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = written(sizes.select("key", F.col("top.label").alias("major"), parts(F.col("all") - F.col("top.m")).alias("nl"), parts(F.col("all")).alias("nr")), "bucket-sizes")
    rows = placed.join(sizes, "key").join(sketch, "rep")
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = ["rep", "label", "n", *(f"s{i}" for i in range(LONGS))]
    left = rows.where("label <> major").select("key", dealt("nl").alias("cl"), every("nr").alias("cr"), F.lit(0).alias("side"), *data)
    right = rows.select("key", every("nl").alias("cl"), dealt("nr").alias("cr"), F.lit(1).alias("side"), *data)
    return left.union(right)


def searched(rows: DataFrame, search, schema: T.StructType | None = None) -> DataFrame:
    """Applies ``search`` to each block of rows (a pyarrow table), the blocks streaming through sorted partitions."""
    at = ["key", "cl", "cr"]

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            ids = np.stack([t.column(c).to_numpy() for c in at])
            cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            start = 0
            for cut in cuts.tolist():
                yield from search(t.slice(start, cut - start))
                start = cut
            rest = t.slice(start)
        if rest is not None and rest.num_rows:
            yield from search(rest)

    return rows.repartition(*at).sortWithinPartitions(*at).mapInArrow(run, schema or rows.schema)


def _possible(t: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of side 0 and of side 1, which of these can link, and in how many bits they differ."""
    side = t.column("side").to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    marks = np.stack([t.column(f"s{i}").to_numpy() for i in range(LONGS)]).view(np.uint64)
    label, n = t.column("label").to_numpy(), t.column("n").to_numpy()
    odd = np.zeros((len(left), len(right)), np.int32)
    for m in marks:
        odd += np.bitwise_count(m[left][:, None] ^ m[right][None, :])
    nl, nr = n[left][:, None], n[right][None, :]
    can = (label[left][:, None] != label[right][None, :]) & (odd <= most_odd(least)) & (np.minimum(nl, nr) * 100 >= np.maximum(nl, nr) * least)
    return left, right, can, odd


def screened(t: pa.Table, least: int):
    """The rows of a block that have a possible partner."""
    left, right, can, _ = _possible(t, least)
    keep = np.concatenate([left[can.any(axis=1)], right[can.any(axis=0)]])
    if len(keep):
        yield from t.take(pa.array(keep)).to_batches()


def linked(t: pa.Table, least: int):
    """Confirmed links of a block; a pair whose ends a link of this block connects already is passed over."""
    left, right, can, odd = _possible(t, least)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
    label, rep = t.column("label").to_pylist(), t.column("rep").to_pylist()
    root: dict = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    found = []
    i, j = np.nonzero(can)
    for k in np.argsort(odd[i, j], kind="stable").tolist():
        p, q = int(left[i[k]]), int(right[j[k]])
        a, b = find(label[p]), find(label[q])
        if a != b and near_enough(sets[p], sets[q], least):
            root[a] = b
            found.append((min(rep[p], rep[q]), max(rep[p], rep[q])))
    if found:
        kind = t.schema.field("rep").type
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], kind) for c in (0, 1)], ["a", "b"])


def near_enough(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    """Whether two sorted sets link."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return both * 100 >= (len(x) + len(y) - both) * least


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` and ``kept``.

    Documents link at a Jaccard similarity of ``least`` percent, and ``component_id`` is the smallest
    id of all documents that links lead to; ``kept`` is whether the id is its component's. See
    ``row_components`` for the search.

    Null, empty and blank texts have no shingles and link with nothing. Each row is a document: rows
    that share an id, whether their texts differ or not, take part with a text each, and rows of a
    null id take part like others, the null losing to any id. An empty table gives no rows. Other
    columns are not read.
    """
    ship(docs.sparkSession)
    rows, by_id = told_apart(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), "id", "doc_id")
    found = row_components(rows.select("doc_id", "text"), least)
    if not by_id:
        found = found.join(rows.select("doc_id", "id"), "doc_id")
        smallest = found.groupBy("component").agg(F.min("id").alias("component_id"))
        found = found.join(smallest, "component")
    else:
        found = found.withColumns({"id": F.col("doc_id").cast(rows.schema["id"].dataType), "component_id": F.col("component").cast(rows.schema["id"].dataType)})
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def row_components(base: DataFrame, least: int) -> DataFrame:
    """(doc_id, text), the ids being longs, there and different -> doc_id, n (size of its set), component.

    The number of bands, the size filter, the bound on sketches and the last comparison follow ``least``.

    1. Documents of equal sets (size and two 64-bit fingerprints) form a class; the smallest id
       stands for it from here on.
    2. MinHash band keys put classes into buckets. Each class is paired with the smallest and the
       largest id of each of its buckets, so a bucket of any size makes pairs in proportion to it.
    3. A pair goes on if its sizes allow a link and its odd sketches (parity bitmaps of 256 MinHash
       samples) differ in few enough bits; the bound loses one true link in ten million.
    4. Links are confirmed on full sets, and components taken.
    5. Buckets that still hold several components are searched in full: every class outside the
       bucket's largest component meets the classes of other components, under the same conditions.
       A bucket is cut into blocks of bounded size for that; a block keeps the classes with a possible
       partner, then, given the sets of these, emits a link only where its ends aren't connected yet.
       So no connection within a bucket is lost, whatever its size, and no pairs are listed.
    """
    with scratch(base.sparkSession) as keep:
        n_bands = bands_for(least)
        signed = written(signatures(base, n_bands), "signatures")
        group = ["n", "fp1", "fp2"]
        marks = [f"s{i}" for i in range(LONGS)]
        first = [F.first(c).alias(c) for c in ("bands", *marks)]
        reps = written(signed.where("n > 0").groupBy(*group).agg(F.min("doc_id").alias("rep"), *first), "classes")
        sketch = reps.select("rep", "n", *marks)
        keys = band_keys(reps, n_bands)
        ends = written(keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high"), "bucket-ends")
        buckets = written(keys.join(ends, "key"), "buckets")  # a hot key is a skewed join, which adaptive execution splits

        def sets_of(some: DataFrame) -> DataFrame:
            ids = some.select(F.col("a").alias("doc_id")).union(some.select("b")).distinct()
            # at every size the same way, since the ids of the candidates grow with the input
            return written(full_sets(base.join(ids.hint("merge"), "doc_id", "left_semi")), "sets")

        star = buckets.select(F.col("low").alias("a"), F.col("rep").alias("b")).union(buckets.select("rep", "high")).where("a <> b").distinct()
        pairs = written(_alike_pairs(star, sketch, least), "pairs")
        sets = sets_of(pairs)
        links = written(confirmed(pairs, sets, least), "confirmed")
        unwritten(ends, sets, pairs)
        labels = components(links)

        label = F.coalesce("label", "rep")
        placed = buckets.select("key", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("key", "rep", label.alias("label"))
        mixed_up = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        # the keys are written first: in a stage that also groups by key a hot key's join couldn't be split
        placed = written(placed.join(written(mixed_up, "mixed-keys"), "key"), "mixed")
        unwritten(buckets)
        if not placed.isEmpty():
            rows = written(searched(block_rows(placed, sketch), partial(screened, least=least)), "near-rows")
            if not rows.isEmpty():
                sets = sets_of(rows.select(F.col("rep").alias("a"), F.col("rep").alias("b"))).select(F.col("doc_id").alias("rep"), "set")
                pair = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
                found = written(searched(rows.join(sets, "rep").select(*rows.columns, "set"), partial(linked, least=least), pair).distinct(), "confirmed")
                if not found.isEmpty():
                    labels = components(links.union(found))
        keep += [signed, reps, labels]
    members = signed.select("doc_id", *group).join(reps.select(*group, "rep"), group, "left")
    whole = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    return whole.select("doc_id", "n", F.coalesce("label", "rep", "doc_id").alias("component"))


def _alike_pairs(pairs: DataFrame, sketch: DataFrame, least: int) -> DataFrame:
    left, right = (sketch.select(F.col("rep").alias(c), F.struct("n", *(f"s{i}" for i in range(LONGS))).alias(f"of_{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").where(alike("of_a", "of_b", least)).select("a", "b")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns.

    Rows count, not ids, as in ``near_duplicates``: a text that is like no other keeps its row
    though another row has its id. The row with the smallest id stays or, where ids repeat or are
    missing, the row that was read first. Null, empty and blank texts all stay. An empty table gives
    no rows.
    """
    ship(docs.sparkSession)
    rows, _ = told_apart(docs, id_col, "__row")
    found = row_components(rows.select(F.col("__row").alias("doc_id"), text_of(text_col).alias("text")), least)
    gone = written(found.where("component <> doc_id").select(F.col("doc_id").alias("__row")), "copies")  # of known size: broadcast if small, else a shuffled join
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM w UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c ON c.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
