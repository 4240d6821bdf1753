"""Token counts by prefix dynamic programming."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyquill.llm.common import keep_only, text_of
from tallyquill.llm.pieces import SPACE, Grown, Vocabulary, batches_of, n_bytes
from tallyquill.shipping import ship

#: Bytes of the prefix counts of chunks, and pairs of pieces, that a Python worker keeps.
MOST_BYTES, MOST_PAIRS = 120 << 20, 2_000_000
#: Chunks above this length are gone through one by one.
LONG = 64
CHUNK = re.compile(" +[^ ]*")


def model_path(path: str | None = None) -> str:
    """The model file; by default the one that the public tokenizers hold, wherever this process runs."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixCounts:
    """Exact token counts of every prefix of a text.

    No piece of the vocabulary has a space mark after another character, so no merge crosses the
    place where a run of spaces begins. A text therefore falls into chunks, a run of spaces with the
    characters up to the next, and the count of a prefix is the count at the start of its last chunk
    plus that of the chunk's prefix: a recurrence over chunks. Inside a chunk a second recurrence goes
    by character: the last piece of the encoding of a prefix is the one piece that the encoder leaves
    apart from the last piece of what stands before it. The counts of all prefixes of a chunk are kept
    by chunk, so that the table of a text is put together from those of its chunks.
    """

    def __init__(self, path: str | None = None) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_path(path))
        place = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        names = [sp.id_to_piece(i) for i in place]
        self.rank = {p: sp.get_score(i) for i, p in zip(place, names, strict=True)}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece of this vocabulary has a space inside; chunks would not be independent")
        self.voc = Vocabulary([p.replace(SPACE, " ") for p in names], place)
        self.longest = self.voc.longest
        self.apart: dict[int, bool] = {}
        self.known: dict[str, int] = {}
        self.counts, self.first, self.size = Grown(np.int32), Grown(np.int64), Grown(np.int64)
        self.kept = (0, 0)

    @staticmethod
    def chunks(text: str) -> list[str]:
        """What the encoder sees (a space is put in front), cut where runs of spaces begin.

        The first space of each chunk is left out, so a chunk is also what gives its pieces when
        encoded alone; only the chunk of one space, "" here, has to be told by hand.
        """
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " ":
            return [c[1:] for c in CHUNK.findall(" " + text)]
        return text.split(" ")

    def stays(self, before: int, piece: int) -> bool:
        """Whether the encoder, given the characters of these pieces alone, ends with these pieces; -1 before stands for nothing."""
        key = (before + 1) * (len(self.rank) + 1) + piece
        found = self.apart.get(key)
        if found is None:
            pieces = [self.voc.pieces[i].replace(" ", SPACE) for i in (before, piece) if i >= 0]
            parts = list("".join(pieces))
            while len(parts) > 1:
                best, at = max((self.rank.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == float("-inf"):
                    break
                parts[-at : 2 - at] = ["".join(parts[-at : 2 - at])]
            found = parts == pieces
            if len(self.apart) >= MOST_PAIRS:
                self.apart.clear()
            self.apart[key] = found
        return found

    def prefix_counts(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of the prefixes of some chunks, each with its space in front, from one character on; and their numbers.

        Chunk by chunk for long ones; short ones take their steps by character together.
        """
        lengths, base, codes, piece = self.voc.pieces_in([" " + c for c in chunks])
        lone = piece[:, 0] < 0
        lone[base[1:] - 1] = False  # the ends
        piece[lone, 0] = -2  # told by its bytes; nothing merges with it
        counts, last = np.zeros(len(piece), np.int32), np.full(len(piece), -1, np.int32)  # before each row's character
        short = np.flatnonzero(lengths <= LONG)
        for end in range(1, int(lengths[short].max(initial=0)) + 1):
            short = short[lengths[short] >= end]
            rows = base[short] + end
            todo = np.arange(len(rows))
            for length in range(min(end, self.longest), 0, -1):
                start = rows[todo] - length
                p = piece[start, length - 1]
                at = np.flatnonzero(p != -1)
                if not len(at):
                    continue
                p, start, at = p[at], start[at], todo[at]
                if length == 1:
                    fits = p == -2
                    counts[rows[at[fits]]] = counts[start[fits]] + n_bytes(codes[start[fits]])
                    told = at[fits]
                    p, start, at = p[~fits], start[~fits], at[~fits]
                else:
                    told = at[:0]
                pairs, inverse = np.unique((last[start].astype(np.int64) + 1) * (len(self.rank) + 1) + p, return_inverse=True)
                good = list(map(self.apart.get, pairs.tolist()))
                if None in good:
                    good = [self.stays(key // (len(self.rank) + 1) - 1, key % (len(self.rank) + 1)) if g is None else g for key, g in zip(pairs.tolist(), good, strict=True)]
                fits = np.array(good, bool)[inverse]
                counts[rows[at[fits]]] = counts[start[fits]] + 1
                last[rows[at[fits]]] = p[fits]
                todo = np.setdiff1d(todo, np.concatenate([told, at[fits]]), assume_unique=True)
                if not len(todo):
                    break
        for i in np.flatnonzero(lengths > LONG).tolist():
            self.go_through(int(base[i]), int(lengths[i]), codes, piece, counts, last)
        inner = np.ones(len(piece), bool)
        inner[base[:-1]] = False
        return counts[inner], lengths

    def go_through(self, base: int, n: int, codes: np.ndarray, piece: np.ndarray, counts: np.ndarray, last: np.ndarray) -> None:
        """The recurrence over the characters of one chunk."""
        ways = [[(j + 1, p) for j, p in enumerate(r) if p != -1] for r in piece[base : base + n].tolist()]
        into: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]  # by end: where pieces begin, and which
        for start, some in enumerate(ways):
            for length, p in some:
                into[start + length].append((start, p))
        count, before = [0] * (n + 1), [-1] * (n + 1)
        for end in range(1, n + 1):
            for start, p in into[end]:
                if p == -2:
                    count[end] = count[start] + int(n_bytes(codes[base + start]))
                    break
                if self.stays(before[start], p):
                    count[end], before[end] = count[start] + 1, p
                    break
        counts[base : base + n + 1] = count

    def place_of(self, chunks: list[str]) -> np.ndarray:
        """Where the prefix counts of distinct chunks are, those of new chunks being added.

        A worker keeps them from batch to batch, up to ``MOST_BYTES``; what comes then stays for one batch.
        """
        for part in (self.first, self.size):
            part.n = self.kept[0]
        self.counts.n = self.kept[1]
        found = list(map(self.known.get, chunks))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            n = self.first.n
            counts, sizes = self.prefix_counts([chunks[i] for i in new])
            self.first.add(self.counts.n + np.cumsum(sizes) - sizes)
            self.size.add(sizes)
            self.counts.add(counts)
            for j, i in enumerate(new, n):
                found[i] = j
            if self.counts.n * 4 + 116 * len(self.known) < MOST_BYTES:
                self.known.update((chunks[i], found[i]) for i in new)
                self.kept = self.first.n, self.counts.n
        return np.array(found, np.int64)

    def tables(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the token counts of its prefixes of 0, 1, 2 ... code points."""
        kind, kinds, sizes = split_chunks(self, texts)
        if not len(kind):
            return [np.zeros(1, np.int32) for _ in texts]
        kind = PrefixCounts.place_of(self, kinds)[kind]
        first, size = self.first.a[kind], self.size.a[kind]
        upto = np.cumsum(size)
        inside = self.counts.a[np.repeat(first - (upto - size), size) + np.arange(int(upto[-1]))]
        last = self.counts.a[first + size - 1].astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        before = np.concatenate([[0], np.cumsum(last)])
        begin = before[:-1] - np.repeat(before[cuts[:-1]], sizes)
        inside += np.repeat(begin, size).astype(np.int32)
        ends = np.concatenate([[0], upto])[cuts].tolist()
        out = []
        for a, b in zip(ends, ends[1:], strict=False):
            table = inside[a:b] if b > a else np.zeros(1, np.int32)
            table[0] = 0  # the space put in front is no character of the text
            out.append(table)
        return out

    def count(self, text: str) -> int:
        return int(self.tables([text])[0][-1])

    def at(self, text: str, n_chars: int) -> int:
        """Tokens of the text's first ``n_chars`` code points."""
        return int(self.tables([text])[0][n_chars])

    def truncate(self, text: str, budget: int) -> int:
        """Length of the longest prefix with at most ``budget`` tokens."""
        return longest_within(self.tables([text])[0], budget)


def longest_within(table: np.ndarray, budget: int) -> int:
    """The most code points of which the prefix has at most ``budget`` tokens; longer prefixes may have fewer."""
    fits = np.flatnonzero(table <= budget)
    return int(fits[-1]) if len(fits) else 0


#: The step that stands for a wider one, which follows in four bytes.
WIDE = -128


def packed(table: np.ndarray) -> bytes:
    """A table as it is stored: what each code point adds, a signed byte each, or five where that is too small."""
    steps = np.diff(table)
    wide = np.flatnonzero((steps > 127) | (steps <= WIDE))
    if not len(wide):
        return steps.astype(np.int8).tobytes()
    size = np.ones(len(steps), np.int64)
    size[wide] = 5
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.int8)
    out[at] = np.where(size == 1, steps, WIDE).astype(np.int8)
    out[at[wide][:, None] + np.arange(1, 5)] = steps[wide].astype("<i4").view(np.int8).reshape(-1, 4)
    return out.tobytes()


def steps_of(stored: bytes) -> np.ndarray:
    """What each code point adds."""
    steps = np.frombuffer(stored, np.int8)
    if not (steps == WIDE).any():
        return steps
    out, at = [], 0
    while at < len(steps):
        wide = steps[at] == WIDE
        out.append(int.from_bytes(stored[at + 1 : at + 5], "little", signed=True) if wide else int(steps[at]))
        at += 5 if wide else 1
    return np.array(out, np.int64)


def unpacked(stored: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(steps_of(stored), dtype=np.int64)])


def tokens_at(stored: Column, n_chars: Column) -> Column:
    """Tokens of a text's first ``n_chars`` code points (all, if it has fewer), from its stored table alone."""

    @F.pandas_udf("long")
    def at(tables: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or pd.isna(k) else int(steps_of(t)[: max(0, int(k))].sum(dtype=np.int64)) for t, k in zip(tables, n, strict=True)], dtype="Int64")

    return at(stored, n_chars)


def chars_within(stored: Column, budget: Column) -> Column:
    """Code points of a text's longest prefix of at most ``budget`` tokens, from its stored table alone."""

    @F.pandas_udf("long")
    def within(tables: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or pd.isna(k) else longest_within(unpacked(t), int(k)) for t, k in zip(tables, most, strict=True)], dtype="Int64")

    return within(stored, budget)


def split_chunks(c: PrefixCounts, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The chunks of some texts: which of the distinct ones each is, these, and how many each text has."""
    odd = [i for i, t in enumerate(texts) if not t or t[0] == " " or "  " in t or SPACE in t]
    plain = set(odd) ^ set(range(len(texts)))
    at = sorted(plain)
    parts = pc.split_pattern(pa.array([texts[i] for i in at], pa.large_string()), " ")
    told = [c.chunks(texts[i]) for i in odd]
    values = pa.concat_arrays([parts.flatten(), pa.array([x for ch in told for x in ch], pa.large_string())]).dictionary_encode()
    kind = values.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.zeros(len(texts), np.int64)
    sizes[at] = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    sizes[odd] = [len(x) for x in told]
    if odd:  # back into the order of the texts
        order = at + odd
        begin = np.zeros(len(texts), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        kind = kind[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(kind))]
    return kind, values.dictionary.to_pylist(), sizes


_counters: dict[str | None, PrefixCounts] = {}


def counter(path: str | None = None) -> PrefixCounts:
    """The one of this process."""
    keep_only("token_counts", _counters.clear)
    if path not in _counters:
        _counters[path] = PrefixCounts(path)
    return _counters[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, path: str | None = None) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_tokens``, ``over_limit``, ``keep_chars`` and ``prefix_steps``.

    ``prefix_steps`` stores the exact token count of every prefix, as the tokens that each code point
    adds, a signed byte each (five where that is too small); the other columns are read from this table, and ``tokens_at`` and
    ``chars_within`` answer further questions from it, without encoding again. ``keep_chars`` is the
    length of the longest prefix of at most ``limit`` tokens.

    Null text counts as empty, which has no tokens. Rows are independent, so ties and repeated rows
    need no rule. An empty table gives no rows. Other columns are not read. A worker keeps counts of
    chunks up to ``MOST_BYTES``, and beside that what ``BATCH_CHARS`` code points, or one longer text,
    need: some 200 bytes a code point, however the text is made up.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], *(T.StructField(n, k) for n, k in (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()), ("keep_chars", T.LongType()), ("prefix_steps", T.BinaryType())))])

    def run(batches):
        c = counter(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in batches_of(texts):
                tables = c.tables(texts[lo:hi])
                n = [int(t[-1]) for t in tables]
                keep = [len(t) - 1 if k <= limit else longest_within(t, limit) for t, k in zip(tables, n, strict=True)]
                out = [b.column(0).slice(lo, hi - lo), pa.array(sizes[lo:hi]), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(keep, pa.int64()), pa.array(map(packed, tables), pa.binary())]
                yield pa.RecordBatch.from_arrays(out, schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
