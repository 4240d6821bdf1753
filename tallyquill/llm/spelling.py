"""Spelling variants: words one edit apart, found by integer keys of their deletions."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyquill.llm.common import UPPER, text_of, unwritten, written
from tallyquill.shipping import ship

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(UPPER, UPPER.lower())
#: A run loses a code point where this divides its hash.
TYPO = 199
#: Words that a worker counts before it passes them on, letters that it adds up meanwhile, runs of a text taken at once.
HELD, LETTERS, RUNS = 200_000, 1 << 26, 1 << 20
#: Code points up to which a deletion is told by its letters, beyond that by ``CHECKS`` hashes of 31 bits.
SPELT, CHECKS = 512, 8
#: The keys' top bits by which they are dealt, letters of the words whose keys are made at once, keys of a long word.
RADIX, KEYED, ROWS = 16, 1 << 18, 1 << 14
PRIME = (1 << 31) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers scattered over all 64-bit integers, one to one."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
BACK = pow(BASE, -1, 1 << 64)
#: Base and multiplier of the letters, for each of the hashes by which long deletions are told apart.
BASES = [(48271 * k + 16807, 69621 * k + 630360016) for k in range(1, CHECKS + 1)]


def deletion_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length (a row of code points each): keys of all deletions, and the words' own keys.

    A prefix hash sums letter times base to the place, modulo 2^64. What stands behind a deleted letter moves
    one place forward, so a deletion's hash is the prefix before it plus the suffix behind it over the base.
    """
    m, n = codes.shape
    with np.errstate(over="ignore"):
        powers = np.full(n, BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        upto = np.zeros((m, n + 1), np.uint64)
        np.cumsum(mixed(codes + np.uint64(1)) * powers, axis=1, out=upto[:, 1:])
        own = upto[:, -1]
        return mixed(upto[:, :-1] + (own[:, None] - upto[:, 1:]) * np.uint64(BACK)).view(np.int64), mixed(own).view(np.int64)


def deletion_checks(codes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The same by ``CHECKS`` prefix hashes modulo a prime, for one long word: a row of bytes for each deletion, and its own."""
    n, parts, own = len(codes), [], []
    for base, factor in BASES:
        powers = np.ones(n, np.int64)
        known = 1
        while known < n:  # doubling: what is known, times the power behind it
            step = pow(base, known, PRIME)
            powers[known : 2 * known] = powers[: min(known, n - known)] * step % PRIME
            known *= 2
        upto = np.concatenate([[0], np.cumsum((codes.astype(np.int64) + 1) * factor % PRIME * powers % PRIME) % PRIME])
        back = pow(base, -1, PRIME)
        parts.append((upto[:-1] + (upto[-1] - upto[1:]) % PRIME * back) % PRIME)
        own.append(int(upto[-1]))
    return np.stack(parts, axis=1).astype("<u4"), np.array(own, "<u4").tobytes()


def typed(word: str, start: int) -> str:
    """The lower-cased run, with one code point less where ``TYPO`` divides the hash that goes on from ``start``."""
    word = word.translate(LOWER) if not word.isascii() else word.lower()
    h = zlib.crc32(word.encode(), start)
    if h % TYPO:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5) -> DataFrame:
    """Words of at least ``shortest`` code points that occur ``least`` times or more: ``word``, ``n``."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_of(text_col).alias("text"))

    def run(batches):
        held: dict[str, int] = {}
        letters = 0

        def flush():
            nonlocal letters
            letters = 0
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                start, runs = zlib.crc32(f"{i}:".encode()), RUN.finditer(text.as_py())
                while some := list(islice(runs, RUNS)):
                    for word, n in Counter(m[0] for m in some).items():
                        word = typed(word, start)
                        if len(word) >= shortest:
                            held[word] = held.get(word, 0) + n
                            letters += len(word)
                    if len(held) >= HELD or letters >= LETTERS:
                        yield flush()
        yield flush()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _keyed(batches, spelt: int):
    """Words (name, word, n) as rows of their deletions and of themselves, a row a key."""
    schema = pa.schema([("key", pa.int64()), ("at", pa.int32()), ("first", pa.bool_()), ("name", pa.string()), ("word", pa.string()), ("check", pa.binary()), ("n", pa.int64())])

    def of(names, words, counts):
        """Rows of words of one length; ``at`` is the deleted place, -1 for a word itself."""
        m, n = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(m, n)
        keys, own = deletion_keys(codes)
        first = np.ones((m, n + 1), bool)  # deleting any letter of a run gives the same; the first stands for it
        first[:, 1:n] = codes[:, 1:] != codes[:, :-1]
        key = np.concatenate([keys, own[:, None]], axis=1).ravel()
        at = np.tile(np.append(np.arange(n), -1), m).astype(np.int32)
        row, many = np.repeat(np.arange(m), n + 1), np.repeat(counts, n + 1)
        first = first.ravel()
        if n <= spelt:
            names, words = pa.array(names, pa.string()).take(pa.array(row)), pa.array(words, pa.string()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(at), pa.array(first), names, words, pa.nulls(len(row), pa.binary()), pa.array(many)], schema=schema)
            return
        told, itself = deletion_checks(codes[0])  # one word; its own row is told by hashes, its deletions too unless they are short enough
        by_letters = n - 1 <= spelt
        for lo in range(0, n + 1, ROWS):
            hi = min(n + 1, lo + ROWS)
            check = [None if by_letters else x.tobytes() for x in told[lo:hi]] + [itself] * (hi > n)
            word = [words[0] if by_letters else None] * (min(n, hi) - lo) + [None] * (hi > n)
            yield pa.RecordBatch.from_arrays([pa.array(key[lo:hi]), pa.array(at[lo:hi]), pa.array(first[lo:hi]), pa.array(names * (hi - lo), pa.string()), pa.array(word, pa.string()), pa.array(check, pa.binary()), pa.array(many[lo:hi])], schema=schema)

    for b in batches:
        sizes = pc.utf8_length(b.column(1)).to_numpy(zero_copy_only=False)
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for same in np.split(order, cuts) if len(order) else []:
            n = int(sizes[same[0]])
            step = 1 if n > spelt else max(1, KEYED // (n * (n + 1)))
            for lo in range(0, len(same), step):
                some = pa.array(same[lo : lo + step])
                yield from of(b.column(0).take(some).to_pylist(), b.column(1).take(some).to_pylist(), b.column(2).take(some).to_numpy())


def best_two(members: list[tuple[str, int]]) -> tuple[tuple[str, int], tuple[str, int] | None]:
    """The members of largest count, ties by name, first and second."""
    ranked = sorted(members, key=lambda x: (-x[1], x[0]))[:2]
    return ranked[0], ranked[1] if len(ranked) > 1 else None


def _near(batches):
    """Rows in the order of their keys -> for each word and key: how many near words meet there, and the best of them."""
    schema = pa.schema([("name", pa.string()), ("near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])

    def bucket(rows: list[tuple]) -> list[tuple]:
        """Rows of one key (at, first, name, word, check, n): those that spell the same meet, whatever the key."""
        told: dict[str | bytes, list[tuple]] = {}
        for at, first, name, word, check, n in rows:
            told.setdefault(check if check is not None else word if at < 0 else word[:at] + word[at + 1 :], []).append((at, first, name, n))
        out = []
        for same in told.values():
            owner, longer, by_place = None, [], {}
            for at, first, name, n in same:
                if at < 0:
                    owner = name, n
                else:
                    by_place.setdefault(at, []).append((name, n))
                    if first:
                        longer.append((name, n))
            for members in by_place.values():  # the same letters but for this place: replaced
                if len(members) > 1:
                    best, second = best_two(members)
                    out.extend((name, len(members) - 1, *(second if name == best[0] else best)) for name, _ in members)
            if owner and longer:  # a letter less or more
                out.append((owner[0], len(longer), *best_two(longer)[0]))
                out.extend((name, 1, *owner) for name, _ in longer)
        return out

    left = None
    for b in batches:
        table = pa.Table.from_batches([b] if left is None else [left, b]).combine_chunks()
        key = table["key"].to_numpy()
        if not len(key):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        left = table.slice(int(cuts[-1])).combine_chunks().to_batches()[0]
        yield _met(table, cuts[:-1], cuts[1:], bucket, schema)
    if left is not None:
        yield _met(pa.Table.from_batches([left]), np.array([0]), np.array([left.num_rows]), bucket, schema)


def _met(table: pa.Table, begin: np.ndarray, end: np.ndarray, bucket, schema: pa.Schema) -> pa.RecordBatch:
    """What the keys with several rows give."""
    many = end - begin > 1
    begin, size = begin[many], (end - begin)[many]
    rows = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    some = table.take(pa.array(rows))
    found = list(zip(*(some[c].to_pylist() for c in ("at", "first", "name", "word", "check", "n")), strict=True))
    out, lo = [], 0
    for n in size.tolist():
        out.extend(bucket(found[lo : lo + n]))
        lo += n
    columns = zip(*out, strict=True) if out else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def variants(words: DataFrame, ratio: int = 5, spelt: int = SPELT) -> DataFrame:
    """Words with their ``form``, ``root``, ``n_near`` and ``form_n``; ``words`` has ``word``, all different, and ``n``.

    Every word gives a key for each deletion of a letter, and one for itself: polynomial hashes of prefix
    and suffix, for all words of a length at once. Rows are dealt by the keys' top bits and sorted by key, so
    words that share a deletion stand side by side; the strings decide whether they do. Two words whose
    deletions at the same place are alike differ by one replaced letter, a word and a deletion of another
    that is alike by an inserted one, and each such pair meets under one key and place alone. So near words are
    counted, and the best found, key by key, without listing pairs: a key has at most as many rows as letters
    can stand in one place, times the places.

    A deletion of more than ``spelt`` letters is told by eight hashes of 31 bits, as letters would take room in
    the square of the word's length; words that long go by a name in the same order.
    """
    spark = words.sparkSession
    ship(spark)
    short = F.length("word") <= spelt
    long = words.where(~short).orderBy("word").withColumn("order", F.monotonically_increasing_id())
    long = written(long.select(F.concat(F.substring("word", 1, spelt), F.lit("#"), F.lpad(F.col("order").cast("string"), 19, "0")).alias("name"), "word", "n"), "long-words")
    named = words.where(short).select(F.col("word").alias("name"), "word", "n")
    any_long = not long.isEmpty()
    if any_long:
        named = named.unionByName(long)
    rows = named.mapInArrow(lambda batches: _keyed(batches, spelt), "key long, at int, first boolean, name string, word string, check binary, n long")
    dealt = rows.withColumn("digit", F.shiftrightunsigned("key", 64 - RADIX)).repartition("digit").drop("digit").sortWithinPartitions("key")
    near = dealt.mapInArrow(_near, "name string, near long, best string, best_n long")
    best = near.groupBy("name").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("order"), "best")).alias("top"))
    is_form = -F.col("top.order") >= F.col("n") * ratio
    out = named.join(best, "name", "left").select(
        "name", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("top.best")).alias("form"), F.when(is_form, -F.col("top.order")).alias("form_n")
    )
    out = written(out, "variants")
    roots = _roots(out.where(F.col("form").isNotNull()).select("name", F.col("form").alias("root")))
    out = out.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    if any_long:
        for c in ("form", "root"):
            whole = long.select(F.col("name").alias(c), F.col("word").alias("whole"))
            out = out.join(whole, c, "left").withColumn(c, F.coalesce("whole", c)).drop("whole")
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """The end of the chain of each word with a form; counts grow along it, so it ends. Each round doubles the steps."""
    now = written(links, "roots")
    while True:
        then = now.select(F.col("name").alias("root"), F.col("root").alias("further"))
        more = written(now.join(then, "root", "left").select("name", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        unwritten(now)
        if more.where("moved").isEmpty():
            return more.select("name", "root")
        now = more.select("name", "root")
        now.__dict__["written_at"] = more.__dict__["written_at"]


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5, ratio: int = 5) -> DataFrame:
    """The words of the documents with their spelling variants: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased), of which one in 199 occurrences by
    the hash of id and run loses a code point; those of at least ``shortest`` code points and ``least`` occurrences
    count. Two are near if one inserted, deleted or replaced code point makes one the other. ``form`` is the near
    word of largest ``n``, ties going to the smallest in code-point order, if it has ``ratio`` times the word's ``n``;
    ``root`` is where forms lead.

    Null text has no words, a null id counts as an empty one. Repeated rows count each. An empty table gives
    no rows, as do texts without letters. Texts and words of any length are taken whole. Other columns are not
    read.
    """
    ship(docs.sparkSession)
    return variants(written(word_counts(docs, id_col, text_col, shortest, least), "words"), ratio)


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
