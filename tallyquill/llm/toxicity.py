"""Toxicity scores of restored text: noisy-channel decoding, then a linear model."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyquill.llm.common import keep_only, text_of, written
from tallyquill.shipping import ship

#: Labelled rows that the regression is fitted on at most.
MOST_ROWS = 20_000
#: Letters that the trigram model tells apart, at most: those of most features. All others are one letter to it, ``OTHER``.
ALPHABET = 128
OTHER = "\ua78f"
#: Log likelihood ratio below which a feature may be chance, there being very many.
LEAST_RATIO = 7.0
LEAST_SCORE = 0.3
#: A word's features are its beginnings of these lengths.
PREFIXES = range(3, 9)
#: A beginning counts again where it comes so often at least, and in so large a share of the words.
LEVELS = ((2, 1 / 400), (2, 1 / 150), (3, 1 / 150), (3, 1 / 60))
#: Tokens of which a Python worker keeps the features.
MOST_KNOWN = 150_000
#: Tokens that a task counts before it turns them into trigrams, and trigrams before it passes them on.
MOST_COUNTED, MOST_GRAMS = 200_000, 500_000

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "¡": "i", "£": "l", "*": "aeiou"}
#: Costs of the channel, as negative logarithms: a sign for a letter, noise between letters, a letter repeated, a sign that means itself, a space left out.
SIGN, NOISE, AGAIN, ITSELF, GAP = 1.0, 2.5, 0.4, 3.0, 6.0
UNSEEN = 12.0
_REPEATED = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1+", re.S)
_CORE = re.compile(r"^[^\w@$!|+(€¡£*]+|[\W_]+$")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+€*])(?:[ .\-_*·]{1,3}(?:[^\W_]|[@$!|+€])){2,}(?![^\s.,;:!?])")


@dataclass
class Language:
    """A character trigram model, "^" and "$" standing for a word's ends, ``OTHER`` for letters outside the alphabet."""

    counts: dict[str, int]
    alphabet: frozenset[str] | None = None  # None: all letters
    totals: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for g, n in self.counts.items():
            self.totals[g[:-1]] = self.totals.get(g[:-1], 0) + n

    def cost(self, before: str, c: str) -> float:
        n = self.counts.get(before + c)
        return UNSEEN if not n else -math.log(n / self.totals[before])

    def restore(self, token: str, spaced: bool = False) -> str:
        """The likeliest clear text of an obfuscated token, by Viterbi decoding.

        The lattice has a column per character: a letter is itself or, right after the same letter,
        nothing; a sign is a letter that it may stand for, itself, or nothing. Letters that stood
        apart may begin a new word. States are the last two characters restored.
        """
        if self.alphabet is not None:
            token = "".join([c if c in self.alphabet or not c.isalpha() else OTHER for c in token])
        best: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
        last = ""
        for c in token:
            ways: list[tuple[str, float]] = []
            if c.isalpha():
                ways.append((c, 0.0))
                if c == last:
                    ways.append(("", AGAIN))
            else:
                ways += [(x, SIGN) for x in LEET.get(c, "")]
                ways += [("", AGAIN if c == last else NOISE), (c, ITSELF)]
            new: dict[str, tuple[float, tuple | None]] = {}
            for state, (cost, path) in best.items():
                for said, price in ways:
                    if not said:
                        options = [(state, cost + price, path)]
                    else:
                        options = [(state[1] + said, cost + price + self.cost(state, said), (path, said))]
                        if spaced and state[1] != "^":
                            end = cost + self.cost(state, "$") + GAP
                            options.append(("^" + said, end + price + self.cost("^^", said), (path, " " + said)))
                    for to, total, way in options:
                        if to not in new or total < new[to][0]:
                            new[to] = total, way
            best, last = new, c
        total, path = min(((cost + self.cost(s, "$"), p) for s, (cost, p) in best.items()), key=lambda x: x[0])
        out = []
        while path:
            path, said = path
            out.append(said)
        return "".join(reversed(out))


def clear_words(token: str, language: Language | None) -> list[str]:
    """The words that a lower-cased token stands for.

    Letters alone stand for themselves and, if one is doubled, for what the lattice restores too.
    """
    if token.isalpha() and not _REPEATED.search(token):
        return [token]
    core = _CORE.sub("", token)
    if not any(c.isalpha() for c in core):
        return []
    plain = re.findall(r"[^\W\d_]+", core)
    if core.isalpha() and not _REPEATED.search(core):
        return plain
    return [*plain, *([language.restore(core)] if language else [])]


def spaced_words(text: str, language: Language | None) -> list[str]:
    """Words spelled with gaps between their letters."""
    if not language:
        return []
    return [w for m in _SPACED.finditer(text) for w in language.restore(re.sub(r"[ .\-_*·]+", "", m[0]), spaced=True).split()]


def levelled(counts: dict[str, int], n_tokens: int) -> set[str]:
    """The beginnings, and beginning and level where they are frequent."""
    out = set(counts)
    for k, n in counts.items():
        if n > 1:
            out.update(f"{k}#{i}" for i, (least, share) in enumerate(LEVELS) if n >= least and n >= share * n_tokens)
    return out


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    language: Language | None
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


class Reader:
    """Finds the chosen features in texts."""

    def __init__(self, chosen: dict | set, language: Language | None) -> None:
        self.chosen, self.language = chosen, language
        self.bases = {k.partition("#")[0] for k in chosen}
        self.known: dict[str, tuple[str, ...]] = {}
        self.plain: set[str] = set()  # tokens known to have no feature, which most have
        self.single = {_RUN.sub(r"\1", k) for k in self.bases}
        self.lengths = sorted({len(k) for k in self.single})

    def hopeless(self, token: str) -> bool:
        """Whether letters alone can't be restored to a word with a feature: with each letter's repeats made
        one, a word begins like its token, and no feature begins so."""
        core = _CORE.sub("", token)
        if not core.isalpha():
            return False
        single = _RUN.sub(r"\1", core)
        return not any(single[:n] in self.single for n in self.lengths)

    def of_token(self, token: str) -> tuple[str, ...]:
        words = () if self.hopeless(token) else clear_words(token, self.language)
        found = tuple({w[:n] for w in words for n in PREFIXES if len(w) >= n and w[:n] in self.bases})
        if len(self.known) + len(self.plain) < MOST_KNOWN:
            if found:
                self.known[token] = found
            else:
                self.plain.add(token)
        return found

    def features(self, text: str) -> set[str]:
        text = text.lower()
        tokens = text.split()
        known, counts = self.known, {}
        said = Counter(tokens)
        for t in said.keys() - self.plain:
            for k in known.get(t) or self.of_token(t):
                counts[k] = counts.get(k, 0) + said[t]
        for w in spaced_words(text, self.language):
            for k in {w[:n] for n in PREFIXES if len(w) >= n and w[:n] in self.bases}:
                counts[k] = counts.get(k, 0) + 1
        return {k for k in levelled(counts, len(tokens)) if k in self.chosen} if counts else set()


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def logistic(rows: list[np.ndarray], y: np.ndarray, n: int, penalty: float = 0.2, rounds: int = 500) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic regression over sets of features, by Adam's steps on all rows."""
    sizes = np.array([len(r) for r in rows])
    cols = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    at = np.repeat(np.arange(len(rows)), sizes)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)  # the last one is the bias
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(w[n] + np.bincount(at, w[cols], len(rows)), -50, 50)))
        e = (p - y) / len(rows)
        grad = np.append(np.bincount(cols, e[at], n) + penalty / len(rows) * w[:n], e.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (1 - i / (rounds + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    return float(w[n]), w[:n]


def alphabet_of(features: list[str], most: int = ALPHABET) -> frozenset[str]:
    """The letters of most features, ties by code point, and those that signs may stand for."""
    seen = Counter(c for k in features for c in set(k.partition("#")[0]))
    return frozenset(sorted(seen, key=lambda c: (-seen[c], c))[:most]) | frozenset("".join(LEET.values()))


def language_of(docs: DataFrame, alphabet: frozenset[str] | None = None, text_col: str = "text", most_counted: int = MOST_COUNTED) -> Language:
    """The trigrams of the words of all documents, a token of them counting once a document.

    Each task counts its tokens and gives the trigrams of their words, in which letters outside the alphabet
    are ``OTHER``; the sums come to the driver. They are at most as many as the alphabet's letters and four
    more, to the third power, however many documents and scripts there are: a restored word that holds
    ``OTHER`` has no feature anyway, so it needn't be told which letter that is.
    """

    def count(batches):
        seen: Counter = Counter()
        grams: Counter = Counter()

        def spell():
            for t, n in seen.items():
                for w in clear_words(t, None):
                    if len(w) > 1:
                        spelled = "^^" + w + "$"
                        for i in range(len(spelled) - 2):
                            grams[spelled[i : i + 3]] += n
            seen.clear()

        def folded():
            known = {} if alphabet is None else {ord(c): OTHER for c in set("".join(grams)) - alphabet - {"^", "$"}}
            out: Counter = Counter()
            for g, n in grams.items():
                out[g.translate(known)] += n
            grams.clear()
            out = list(out.items())
            for i in range(0, len(out), 50_000):
                key, n = zip(*out[i : i + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n, pa.int64())], ["key", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(set(text.lower().split()))
                if len(seen) > most_counted:
                    spell()
            if len(grams) > MOST_GRAMS:
                yield from folded()
        spell()
        yield from folded()

    counts = docs.select(text_of(text_col).alias("text")).mapInArrow(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return Language({r["key"]: r["n"] for r in counts.collect()}, alphabet)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS) -> Model:
    """A model fitted on at most ``most_rows`` labelled rows that are not held out.

    The ids are those with the smallest hash; of rows that share one the smallest text teaches. Their
    beginnings of words are counted by label in the executors; all with a likelihood ratio of ``LEAST_RATIO``
    are features. These, and which rows have them, come to the driver, bounded by what ``most_rows``
    documents hold. The trigram model that restores words is counted over all of ``docs``, for the letters of
    the features (``language_of``), so its size is bounded too. Labels that are null, and documents without a label, teach nothing. With no
    positive or no negative label the score is the same for all texts.
    """
    spark = docs.sparkSession
    ship(spark)
    taught = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    taught = taught.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    taught = taught.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    sample = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(taught), "id")
    sample = sample.groupBy("id", "y").agg(F.min("text").alias("text")).select("text", "y")
    sample = written(sample, "taught")

    def count(batches):
        tally: dict[int, Counter] = {0: Counter(), 1: Counter()}
        rows = [0, 0]
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = text.lower().split()
                words = Counter(w for t in tokens for w in clear_words(t, None))
                begun: dict[str, int] = {}
                for w, n in words.items():
                    for k in PREFIXES[: max(0, len(w) - 2)]:
                        begun[w[:k]] = begun.get(w[:k], 0) + n
                tally[y > 0].update(levelled(begun, len(tokens)))
                rows[y > 0] += 1
        keys = list(tally[0].keys() | tally[1].keys())
        out = [("f", k, tally[1][k], tally[0][k]) for k in keys] + [("n", "", rows[1], rows[0])]
        for i in range(0, len(out), 50_000):
            kind, key, pos, neg = zip(*out[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(pos, pa.int64()), pa.array(neg, pa.int64())], ["kind", "key", "pos", "neg"])

    counts = sample.mapInArrow(count, "kind string, key string, pos long, neg long").groupBy("kind", "key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = written(counts, "counts")
    totals = counts.where("kind = 'n'").first()
    pos, neg = (int(totals["pos"]), int(totals["neg"])) if totals else (0, 0)
    if not pos or not neg:
        rate = min(max((pos + 0.5) / (pos + neg + 1) if pos else 0.0, 1e-6), 1 - 1e-6)
        return Model(math.log(rate / (1 - rate)), {}, None)
    part = lambda n, m: F.when(n > 0, n * F.log(n / m)).otherwise(0.0)
    seen, share = F.col("pos") + F.col("neg"), pos / (pos + neg)
    ratio = part(F.col("pos").cast("double"), seen * share) + part(F.col("neg").cast("double"), seen * (1 - share))
    chosen = counts.where((F.col("kind") == "f") & (F.col("pos") >= 2) & (F.col("pos") > seen * share) & (ratio >= LEAST_RATIO)).select("key").orderBy("key").collect()
    names = [r["key"] for r in chosen]
    language = language_of(docs, alphabet_of(names), text_col)
    shared = spark.sparkContext.broadcast((set(names), language))

    def read(batches):
        reader = Reader(*shared.value)
        for b in batches:
            found = [sorted(reader.features(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), b.column(1)], ["found", "y"])

    rows = sample.mapInArrow(read, "found array<string>, y int").groupBy("found", "y").count().collect()  # at most ``most_rows``
    place = {k: i for i, k in enumerate(names)}
    rows.sort(key=lambda r: (r["found"], r["y"]))
    sets = [np.array([place[k] for k in r["found"]], np.int64) for r in rows for _ in range(r["count"])]
    bias, w = logistic(sets, np.array([float(r["y"]) for r in rows for _ in range(r["count"])]), len(names))
    return Model(bias, {k: float(x) for k, x in zip(names, w, strict=True) if x}, language)


_readers: dict[str, Reader] = {}


def _scored(model_at, texts: list[str]) -> np.ndarray:
    """Scores of texts under the broadcast model; the reader of the last model is kept by the process."""
    keep_only("toxicity", _readers.clear)
    m = model_at.value
    if m.key not in _readers:
        _readers.clear()
        _readers[m.key] = Reader(m.weights, m.language)
    reader = _readers[m.key]
    sums = [m.bias + math.fsum(m.weights[f] for f in reader.features(t)) for t in texts]
    return 1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -500, 500)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """One row per input row: id, ``held_out``, ``score`` (0 to 1) and ``predicted``.

    Whole texts are lower-cased, restored and scored by the features in them. Nothing but the text
    enters a score. Null text counts as empty and, like any text without a known feature, gets the
    score of the model's bias. Rows are independent, so ties and repeated rows need no rule; a null
    id is not held out. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), text_of(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = _scored(shared, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= least).astype(np.int32))], schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, with all their columns; no shuffle."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = _scored(shared, [t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(s < least))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
