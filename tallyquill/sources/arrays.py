"""JSON arrays read by many tasks: a file is cut anywhere, and each cut's place in the array found first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyquill.shipping import ship

QUOTE, BACKSLASH, OPEN, CLOSE, OPEN_ARRAY, CLOSE_ARRAY = b'"\\{}[]'
#: What may stand between the objects of an array.
BETWEEN = frozenset(b" \t\r\n,[]")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of the files in rows that end before a closing brace, with the split that Spark reads them in: (file, start, value, size of the file).

    Spark's own reader cuts files into splits, also on stores that nothing else reads; rows never cross one.
    """
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"), F.col("_metadata.file_size").alias("size"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
    """(file, start, bytes), in order, a run of rows of one split at a time; the braces that rows end at are put back."""
    for b in batches:
        files, starts, values = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2)
        lo = 0
        for i in range(1, b.num_rows + 1):
            if i == b.num_rows or starts[i] != starts[lo] or files[i] != files[lo]:
                yield files[lo], int(starts[lo]), np.frombuffer(b"".join(x for v in values.slice(lo, i - lo) for x in (v.as_py(), b"}")), np.uint8)
                lo = i


def quotes_in(text: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that no backslash escapes."""
    quotes = np.flatnonzero(text == QUOTE)
    if not len(quotes):
        return quotes
    at = np.arange(len(text))
    last = np.maximum.accumulate(np.where(text == BACKSLASH, -1, at))  # of each place the last byte up to it that is no backslash
    before = np.where(quotes > 0, last[quotes - 1], -1)
    return quotes[(quotes - 1 - before) % 2 == 0]


def brackets_in(text: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the brackets outside strings, 1 for one that opens and -1 for one that closes, and whether a string is open at the end."""
    quotes = quotes_in(text)
    places = np.flatnonzero((text == OPEN) | (text == CLOSE) | (text == OPEN_ARRAY) | (text == CLOSE_ARRAY))
    within = (np.searchsorted(quotes, places) + inside) % 2 == 1
    places = places[~within]
    step = np.where((text[places] == OPEN) | (text[places] == OPEN_ARRAY), 1, -1)
    return places, step, bool((len(quotes) + inside) % 2)


@dataclass
class Cut:
    """What a split does, for a string closed and for one open at its beginning: the state at its end, and how
    often a brace closes to each depth, counted from the depth at its beginning."""

    ends: list[bool] = field(default_factory=lambda: [False, True])
    depth: list[int] = field(default_factory=lambda: [0, 0])
    closed: list[dict[int, int]] = field(default_factory=lambda: [{}, {}])
    first: int = 0  # its first byte that is no white space
    n: int = 0  # its bytes

    def add(self, text: np.ndarray) -> None:
        if not self.first:
            there = np.flatnonzero(~np.isin(text, list(b" \t\r\n\xef\xbb\xbf")))
            self.first = int(text[there[0]]) if len(there) else 0
        self.n += len(text)
        for h in (0, 1):
            places, step, self.ends[h] = brackets_in(text, self.ends[h])
            depth = self.depth[h] + np.cumsum(step)
            for d, n in zip(*np.unique(depth[text[places] == CLOSE], return_counts=True), strict=True):
                self.closed[h][int(d)] = self.closed[h].get(int(d), 0) + int(n)
            self.depth[h] += int(step.sum())


CUT = "file string, start long, ends array<boolean>, depth array<long>, closed array<map<long,long>>, first int, n long, size long"


def _cuts(batches):
    """A row for each split that a task reads."""
    found: dict[tuple[str, int], Cut] = {}
    sizes: dict[str, int] = {}

    def noted():
        for b in batches:
            sizes.update(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True))
            yield b

    for file, start, text in _runs(noted()):
        found.setdefault((file, start), Cut()).add(text)
    kinds = [pa.string(), pa.int64(), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.map_(pa.int64(), pa.int64())), pa.int32(), pa.int64(), pa.int64()]
    columns = zip(*((f, s, c.ends, c.depth, [list(m.items()) for m in c.closed], c.first, c.n, sizes[f]) for (f, s), c in found.items()), strict=True) if found else [()] * 8
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "start", "ends", "depth", "closed", "first", "n", "size"])


#: State at a split's beginning: in a string, depth, objects that have ended before, depth at which the file's objects lie.
State = tuple[bool, int, int, int]


def states(cuts: list, strict: bool = True) -> dict[tuple[str, int], State]:
    """The state at the beginning of each split, going through a file's splits in order.

    A file whose last byte is no brace got one at its end that isn't there (its bytes tell, but for the three of a
    byte order mark, which are skipped), so there a whole array ends one below where it began. A file that ends
    elsewhere is torn; with ``strict`` that is an error.
    """
    out: dict[tuple[str, int], State] = {}
    by_file: dict[str, list] = {}
    for c in cuts:
        by_file.setdefault(c["file"], []).append(c)
    for file, some in by_file.items():
        some.sort(key=lambda c: c["start"])
        base = 0 if some[0]["first"] == OPEN else 1
        inside, depth, seq = False, 0, 0
        for c in some:
            out[file, c["start"]] = inside, depth, seq, base
            seq += c["closed"][inside].get(base - depth, 0)
            inside, depth = c["ends"][inside], depth + c["depth"][inside]
        added = sum(c["n"] for c in some) - some[0]["size"] in (1, -2)
        if strict and (inside or depth != -added or some[0]["first"] not in (OPEN, OPEN_ARRAY)):
            raise ValueError(f"{file} is no whole JSON array")
    return out


PART = "file string, seq long, start long, whole boolean, value string"


def _objects(batches, known: dict[tuple[str, int], State], strict: bool):
    """The objects of the splits that a task reads; of one that goes on in another split, the part in this one."""
    schema = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("start", pa.int64()), ("whole", pa.bool_()), ("value", pa.string())])
    at, held, begun = None, b"", False  # the split; of an object that isn't closed yet what there is, and whether it began in a split before
    inside, depth, seq, base = False, 0, 0, 1

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def between(file: str, said: bytes) -> None:
        if strict and not BETWEEN.issuperset(said.removeprefix(b"\xef\xbb\xbf")):
            raise ValueError(f"{file} holds other things than objects")

    for file, start, text in _runs(batches):
        out = []
        if at != (file, start):
            out += [(at[0], seq, at[1], False, held.decode())] if held else []
            inside, depth, seq, base = known[file, start]
            at, held, begun = (file, start), b"", depth > base
        places, step, after = brackets_in(text, inside)
        depths = depth + np.cumsum(step)
        opens = places[(text[places] == OPEN) & (step > 0) & (depths == base + 1)]
        closes = places[(text[places] == CLOSE) & (step < 0) & (depths == base)]
        raw = text.tobytes()
        lo, i = 0, 0
        if depth > base or held:  # inside an object
            if not len(closes):
                held, lo = held + raw, len(raw)
            else:
                end = int(closes[0]) + 1
                out.append((file, seq, start, not begun, (held + raw[:end]).decode()))
                held, begun, lo, i, seq = b"", False, end, 1, seq + 1
        for first in opens.tolist():
            if first < lo:
                continue
            between(file, raw[lo:first])
            if i < len(closes):
                end = int(closes[i]) + 1
                out.append((file, seq, start, True, raw[first:end].decode()))
                lo, i, seq = end, i + 1, seq + 1
            else:
                held, lo = raw[first:], len(raw)
                break
        if not held:
            between(file, raw[lo:].removesuffix(b"}"))
        inside, depth = after, depth + int(step.sum())
        yield rows(out)
    if at and held:
        yield rows([(at[0], seq, at[1], False, held.decode())])


def read_objects(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """The objects of JSON arrays, a file each: ``item``, ``__file``, and ``seq``, their place in the file from 0.

    Two passes read the files in splits. The first finds, for each split, what it does to a string that is open
    or closed, and to the depth of brackets; gone through in order, a row a split, this gives the state at each
    split's beginning and how many objects end before it. The second cuts out the objects, of which those that lie in
    several splits are put together by their number. A file of one object counts as one of an array of it. With
    mode FAILFAST, a file that isn't a whole array of objects fails, and so does an object that isn't of the
    schema.
    """
    ship(spark)
    rows = pieces(spark, path)
    strict = mode == "FAILFAST"
    known = states(rows.mapInArrow(_cuts, CUT).collect(), strict)  # a row a split
    parts = rows.mapInArrow(lambda batches: _objects(batches, known, strict), PART)
    torn = parts.where("not whole").groupBy("file", "seq").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
    torn = torn.select("file", "seq", F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"))
    whole = parts.where("whole").select("file", "seq", "value").union(torn)
    return whole.select(F.from_json("value", schema, {"mode": mode}).alias("item"), F.col("file").alias("__file"), "seq")
