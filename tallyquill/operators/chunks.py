"""Chunking, number annotation and node edges."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyquill.functions.numbers import numbers_in
from tallyquill.functions.tokenizers import Tokenizer


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows of words: doc_id, chunk_no, n_words, content."""
    step = size - overlap
    words = words_of(F.col(text_col))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.greatest(F.size("w") - overlap - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    parts = docs.select(F.col(id_col).alias("doc_id"), words.alias("w")).select("doc_id", F.posexplode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("chunk_no", "part"))
    return parts.select("doc_id", "chunk_no", F.size("part").alias("n_words"), F.array_join("part", " ").alias("content"))


_SENTENCE, _WORD = re.compile(r"(?<=[.!?])\s+"), re.compile(r"\S+")


def words_in(sentences: list[str]) -> list[int]:
    return [len(_WORD.findall(s)) for s in sentences]


def packed(sentences: list[str], lengths: list[int], size: int, overlap: int) -> list[tuple[int, str]]:
    """The chunks of a text's sentences with their lengths, in one pass."""
    out: list[tuple[int, str]] = []
    now: list[tuple[str, int]] = []
    n = 0

    def close() -> None:
        out.append((n, " ".join(s for s, _ in now)))

    for s, long in zip(sentences, lengths, strict=True):
        if now and n + long > size:
            close()
            first, kept = len(now), 0
            while first > 1 and kept + now[first - 1][1] <= overlap:
                first -= 1
                kept += now[first][1]
            now, n = (now[first:], kept) if kept + long <= size else ([], 0)
        now.append((s, long))
        n += long
    if now:
        close()
    return out


def sentences_of(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s.strip(" ")]


def packed_sentences(text: str | None, size: int, overlap: int) -> list[tuple[int, str]]:
    """The chunks of a text with their numbers of words."""
    told = sentences_of(text)
    return packed(told, words_in(told), size, overlap)


def sentence_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 512, overlap: int = 50, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Whole sentences packed greedily into chunks of at most ``size`` tokens (``n_tokens``), or words without a tokenizer (``n_words``).

    A chunk begins with those last sentences of the one before that have at most ``overlap`` of them.
    A sentence longer than ``size`` is a chunk of its own. A sentence is encoded once a batch, however often it
    stands there and however many chunks it is in, so a chunk's length is the sum of its sentences'. Time is in
    proportion to the text; the packing depends on all that was packed before, so it runs in Arrow batches.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = "n_tokens" if tokenizer else "n_words"
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, k) for c, k in (("chunk_no", T.IntegerType()), (counted, T.IntegerType()), ("content", T.StringType())))])

    def pack(batches):
        for b in batches:
            told = [sentences_of(t) for t in b.column(1).to_pylist()]
            distinct = list(dict.fromkeys(s for some in told for s in some))
            length = dict(zip(distinct, tokenizer.lengths(distinct) if tokenizer else words_in(distinct), strict=True))
            found = [packed(some, [length[s] for s in some], size, overlap) for some in told]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = [(i, *c) for f in found for i, c in enumerate(f)]
            columns = zip(*flat, strict=True) if flat else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.string()), strict=True))], schema.names)

    parts = rows.mapInArrow(pack, schema)
    return parts.select("doc_id", "chunk_no", F.concat_ws("_", F.col("doc_id").cast("string"), F.lit("text_chunk"), F.col("chunk_no").cast("string")).alias("node_id"), counted, "content")


def annotate(nodes: DataFrame, text_col: str = "content", most: int = 10) -> DataFrame:
    """contains_numbers, number_count (of all) and numbers (the first ten)."""
    found = numbers_in(F.col(text_col))
    return nodes.withColumn("__found", found).withColumns({"contains_numbers": F.size("__found") > 0, "number_count": F.size("__found"), "numbers": F.slice("__found", 1, most)}).drop("__found")


def node_edges(nodes: DataFrame, doc_col: str = "doc_id", order_col: str = "chunk_no", id_col: str = "node_id") -> DataFrame:
    """C4: each node's NEXT points at the last node of its document, the last one's at the one before; a lone node has none."""
    doc = Window.partitionBy(doc_col)
    order = doc.orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = nodes.withColumns({"__at": F.row_number().over(doc.orderBy(order_col)) - 1, "__n": F.count(F.lit(1)).over(doc), "__last": F.last(id_col).over(order), "__second": F.lag(id_col).over(doc.orderBy(order_col))})
    is_last = F.col("__at") == F.col("__n") - 1
    target = F.when(is_last, F.col("__second")).otherwise(F.col("__last"))
    distance = F.when(is_last, F.lit(1)).otherwise(F.col("__n") - 1 - F.col("__at"))
    return n.where("__n > 1").select(F.col(doc_col), F.col(id_col).alias("source"), target.alias("target"), distance.cast("long").alias("distance"))
