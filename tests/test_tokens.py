"""Tokenizers as providers, training rows and chunks counted in tokens."""

import random

import pytest
from pyspark.sql import functions as F

from tallyquill.functions import tokenizers
from tallyquill.operators import chunks, training

TEXTS = ["", "a", "Hello world, it's 12.5 %!", "two  spaces\n\ttabs", "naïve Ünïcode – 東京 🙂 x", "<s> </s> <|endoftext|>", "é" * 50]


def files():
    p = pytest.importorskip("public_tokenizers")
    return [tokenizers.from_file(p.path("byte_bpe_50k.json")), tokenizers.from_file(p.path("piece_bpe_32k.model")), tokenizers.from_file(p.path("byte_bpe_50k.tiktoken"), p.PATTERN)]


def test_offsets_cover_the_text():
    for t in [tokenizers.plain(), *files()]:
        for text, (ids, starts, ends) in zip(TEXTS, t.encode(TEXTS), strict=True):
            assert len(ids) == len(starts) == len(ends) and all(0 <= a <= b <= len(text) for a, b in zip(starts, ends, strict=True)), text
            assert list(ends) == sorted(ends)
            seen = {i for a, b in zip(starts, ends, strict=True) for i in range(a, b)}
            assert all(c.isspace() or i in seen for i, c in enumerate(text)), text


def test_tokenized_column_keeps_nulls(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, text string").repartition(2)
    for t in [tokenizers.plain(), *files()]:
        got = {r["i"]: r["t"] for r in df.select("i", tokenizers.tokenized(F.col("text"), t).alias("t")).collect()}
        assert got[len(TEXTS)]["ids"] is None and [got[i]["ids"] for i in range(len(TEXTS))] == [list(x[0]) for x in t.encode(TEXTS)]
    with pytest.raises(ValueError, match="no tokenizer"):
        tokenizers.from_file("x.bin").lengths(["a"])


def test_D6_text_masks(spark):
    ask, say = "<ask>", "<say>"
    texts = ["<ask> one two <say> three four", "<say> early <ask> one <say> late", "<say> one", "<ask> one", "x<ask>one<say>two", None, "", "<ask><say>", "<ask> a <say> b <say> c", "é é <ask> é <say> ü"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for t in [tokenizers.plain(), *files()]:
        got = {r["i"]: r for r in training.training_rows(df, t, 40, markers=(ask, say), pad=9).collect()}
        for i, text in enumerate(texts):
            if text is None:
                assert got[i]["input_ids"] is None and got[i]["attention_mask"] is None and got[i]["labels"] is None
                continue
            ids, _, ends = next(iter(t.encode([text])))
            n = len(ids)
            assert got[i]["input_ids"] == [*ids, *[9] * 40][:40] and got[i]["attention_mask"] == [1] * n + [0] * (40 - n)
            begun = text.find(ask)
            at = text.find(say, begun + len(ask)) if begun >= 0 else -1
            if at < 0:
                assert got[i]["labels"] is None, text
            else:
                assert got[i]["labels"] == [x if e > at else -100 for x, e in zip(ids, ends, strict=True)] + [-100] * (40 - n), text
    cut = training.training_rows(df, tokenizers.plain(), 3, markers=(ask, say)).where("i = 0").first()
    assert len(cut["input_ids"]) == len(cut["labels"]) == 3 and cut["attention_mask"] == [1, 1, 1]


def test_memory_of_encoding_is_bounded():
    import tracemalloc

    texts = ["some words of a text " * 50] * 8000  # 8 million code points, 2.4 million tokens
    tracemalloc.start()
    got = tokenizers.token_arrays(texts, tokenizers.plain(), 64)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6 and got.to_pylist()[7999]["ids"] == next(iter(tokenizers.plain().encode(texts[:1])))[0][:64]
    assert tokenizers.plain().lengths(texts[:2]) == [300, 300]


def test_tokens_behind_the_length_change_nothing(spark):
    df = spark.createDataFrame([(i, "x " * i + "<ask> one <say> two " + "y " * 40) for i in range(30)] + [(99, None)], "i int, text string")
    for t in [tokenizers.plain(), *files()]:
        whole, cut = ({r["i"]: r for r in training.training_rows(df, t, n, markers=("<ask>", "<say>")).collect()} for n in (200, 16))
        for i, r in whole.items():
            assert all(cut[i][c] == (r[c] and r[c][:16]) for c in ("input_ids", "attention_mask", "labels")), i
    assert [len(r["t"]["ids"]) for r in df.where("i < 3").orderBy("i").select(tokenizers.tokenized(F.col("text"), tokenizers.plain(), 2).alias("t")).collect()] == [2, 2, 2]


def test_C1_chunks_hold_their_bounds_in_tokens(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 60))) + rng.choice(".!?") for _ in range(rng.randint(1, 60))) for _ in range(15)] + [None, "", "one sentence only"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    for t in [tokenizers.plain(), files()[1]]:
        by_doc = {}
        for r in sorted(chunks.sentence_chunks(df, size=40, overlap=12, tokenizer=t).collect(), key=lambda r: (r["doc_id"], r["chunk_no"])):
            by_doc.setdefault(r["doc_id"], []).append(r)
        assert set(by_doc) == {i for i, x in enumerate(texts) if x}
        for i, found in by_doc.items():
            told = chunks.sentences_of(texts[i])
            lengths = t.lengths(told)
            at, before = 0, []  # the first sentence of the next chunk that isn't in the one before
            for r in found:
                n = next(n for n in range(len(before) + 1) if r["content"].startswith(" ".join([*before[n:], told[at]])))
                kept = before[n:]
                size, new = sum(t.lengths(kept)), []
                while at < len(told) and (not new or size + lengths[at] <= 40):
                    size += lengths[at]
                    new.append(told[at])
                    at += 1
                assert r["content"] == " ".join([*kept, *new]) and r["n_tokens"] == size
                assert sum(t.lengths(kept)) <= 12 and (size <= 40 or len(new) == 1 and not kept)
                before = [*kept, *new]
            assert at == len(told)


def test_C1_a_sentence_is_encoded_once_a_batch():
    seen = []
    t = tokenizers.Tokenizer(lambda texts: seen.extend(texts) or tokenizers.plain().encode(texts))
    assert t.lengths(["ab", "abcdef"]) == [1, 2] and seen == ["ab", "abcdef"]
