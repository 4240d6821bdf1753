"""Tokenizers as providers: ids of texts, and where in the text each stands."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids of a text, and the code points at which each begins and ends.
Encoded = tuple[list[int], list[int], list[int]]
#: Code points of the texts that are encoded together; a longer text is encoded alone.
TOGETHER = 1 << 17
TOKENS = T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "starts", "ends")])


@dataclass(frozen=True)
class Tokenizer:
    """``encode`` takes a batch of texts; it runs in the workers, which load what it needs."""

    encode: Callable[[list[str]], Iterable[Encoded]]

    def encoded(self, texts: list[str]) -> Iterable[Encoded]:
        """Text by text, so many together as have ``TOGETHER`` code points: ids take many times a text's memory."""
        some, size = [], 0
        for text in texts:
            if some and size + len(text) > TOGETHER:
                yield from self.encode(some)
                some, size = [], 0
            some.append(text)
            size += len(text)
        if some:
            yield from self.encode(some)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids, _, _ in self.encoded(texts)]


def plain(vocabulary: int = 32_000, piece: int = 4) -> Tokenizer:
    """A tokenizer without a file: pieces of at most ``piece`` code points of what stands between ASCII white space.

    A piece's id is made of its length and its first and last code point, so that SQL can give it too.
    """
    pieces = re.compile(r"[^\x20\x09-\x0D]{1,%d}" % piece)

    def encode(texts: list[str]) -> Iterable[Encoded]:
        for text in texts:
            starts, ends = [], []
            for m in pieces.finditer(text):
                a, b = m.span()
                starts.append(a)
                ends.append(b)
            yield [((b - a) * 131 + ord(text[a]) * 7 + ord(text[b - 1])) % vocabulary for a, b in zip(starts, ends, strict=True)], starts, ends

    return Tokenizer(encode)


def from_file(path: str, pattern: str | None = None) -> Tokenizer:
    """The tokenizer of a vocabulary file, by its ending: ``.json``, ``.model`` or ``.tiktoken`` (which needs the ``pattern`` of its words).

    The file is read by the workers, so its path has to lead to it there. No special tokens are added, and
    their strings in a text are ordinary text.
    """

    def encode(texts: list[str]) -> Iterable[Encoded]:
        return _loaded(path, pattern)(texts)

    return Tokenizer(encode)


@cache
def _loaded(path: str, pattern: str | None) -> Callable[[list[str]], Iterable[Encoded]]:
    """Once a process and file."""
    if path.endswith(".json"):
        import tokenizers

        t = tokenizers.Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [(e.ids, [a for a, _ in e.offsets], [b for _, b in e.offsets]) for e in t.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [(e["ids"], [a for a, _ in e["offsets"]], [b for _, b in e["offsets"]]) for e in p.encode(texts, return_type="offset_mapping", num_threads=1)]
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(texts: list[str]) -> Iterable[Encoded]:
            for text in texts:
                ids = e.encode_ordinary(text)
                starts = e.decode_with_offsets(ids)[1]
                yield ids, starts, [*starts[1:], len(text)][: len(ids)]

        return encode
    raise ValueError(f"no tokenizer is known for {path}")


def token_arrays(texts: list[str | None], tokenizer: Tokenizer, most: int | None = None) -> pa.StructArray:
    """(ids, starts, ends) of texts as an Arrow array, of each text's first ``most`` tokens; nulls for null text."""
    told = tokenizer.encoded([t for t in texts if t is not None])
    held, sizes = [[np.empty(0, np.int32)] for _ in TOKENS], []
    for text in texts:
        now = ([], [], []) if text is None else next(told)
        sizes.append(len(now[0]) if most is None else min(len(now[0]), most))
        for parts, x in zip(held, now, strict=True):
            parts.append(np.array(x[:most], np.int32))
    at, missing = pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array([t is None for t in texts], pa.bool_())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts)), mask=missing) for parts in held], TOKENS.names)


def tokenized(text: Column, tokenizer: Tokenizer, most: int | None = None) -> Column:
    """(ids, starts, ends) of a text, in Arrow batches; null text has none. With ``most``, the whole text is encoded and its first tokens are given."""

    @F.arrow_udf(TOKENS)
    def run(texts: pa.Array) -> pa.Array:
        return token_arrays(texts.to_pylist(), tokenizer, most)

    return run(text)
