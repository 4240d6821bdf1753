"""The pipeline and each of its stages against plain versions."""

import itertools
import re
from collections import Counter
from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tallyquill.llm import common, mixing, subword, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n ", None, "a", None), (4, "Same text here", "en", "b", 14), (5, "same TEXT here", "en", "b", 14), (5, "same TEXT here", "en", "b", 14),
    (6, "lorem ipsum dolor " * 3000, "de", "a", 1), (7, "lorem ipsum dolor " * 3000 + "x", "de", "c", 1), (8, "one text of its own", "fr", "c", 1), (8, "another text of its own", "fr", "c", 1),
    (None, "nobody knows whose text this is", "fr", "c", 1),
]


def lower(t):
    return (t or "").translate(str.maketrans(common.UPPER, common.UPPER.lower()))


def without_toxic(rows, model):
    reader = toxicity.Reader(model.weights, model.language)
    return [r for r in rows if model.bias + sum(model.weights[f] for f in reader.features(r[1] or "")) < -0.8472978603872037]  # a score below 0.3


def without_copies(rows):
    best = {}
    for r in rows:
        k = lower(r[1])
        if k not in best or (best[k][0] is None, -(best[k][0] or 0)) > (r[0] is None, -(r[0] or 0)):
            best[k] = r
    return list(best.values())


def without_near_copies(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(r[1]))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if label[a] != label[b] and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b])) > 0 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            label = [label[a] if x == label[b] else x for x in label]
    groups = {}
    for r, x in zip(rows, label, strict=True):
        groups.setdefault(x, []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]


def mixed(rows):
    import duckdb
    import pyarrow as pa

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string())}))
    times = {i: taken // size for i, taken, size in con.execute(f"SELECT doc_id, taken, size FROM ({mixing.ORACLE})").fetchall() if size}
    return [r for r in rows for _ in range(times.get(r[0], 0) if re.search(r"[^\x20\x09-\x0D]", r[1] or "") else 0)]


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def same(got, want):
    assert Counter(got) == Counter(want)


@pytest.fixture(scope="module", params=["tiny", "edges", "none"])
def docs(request, spark, tiny):
    if request.param == "tiny":
        return spark.read.parquet(f"{tiny}/documents.parquet")
    df = spark.createDataFrame(EDGES if request.param == "edges" else [], SCHEMA)
    return df.repartition(3) if request.param == "edges" else df


def test_each_stage_equals_its_plain_version(spark, docs, tiny):
    rows = plain(docs)
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    got = corpus_pipeline.reject_toxic(spark, docs, tiny)
    assert got.schema == docs.schema
    same(plain(got), without_toxic(rows, toxicity.fit(docs, labels)))
    got = corpus_pipeline.reject_copies(spark, docs, tiny)
    assert got.columns == docs.columns
    same([(r[0], lower(r[1])) for r in plain(got)], [(r[0], lower(r[1])) for r in without_copies(rows)])
    got = corpus_pipeline.reject_near_copies(spark, docs, tiny)
    assert got.columns == docs.columns
    if len({r[0] for r in rows}) == len(rows):
        same(plain(got), without_near_copies(rows))
    else:  # of equal rows any may stay
        same([lower(r[1])[:20] for r in plain(got)], [lower(r[1])[:20] for r in without_near_copies(rows)])
    once = docs.dropDuplicates(["doc_id"])
    got = corpus_pipeline.mix_sources(spark, once, tiny)
    assert got.columns == docs.columns
    same(plain(got), mixed(plain(once)))


def test_last_stage_equals_the_library(spark, docs, tiny):
    sp = subword.codec().sp
    out = corpus_pipeline.encode(spark, docs, tiny)
    same([(r["doc_id"], tuple(r["ids"]), r["lang"], r["source"], r["round_trip"]) for r in out.collect()], [(i, tuple(sp.encode(t or "")), lang, source, True) for i, t, lang, source, _ in plain(docs)])


def test_whole_pipeline_equals_plain_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{tiny}/labels.parquet"))
    rows = mixed(without_near_copies(without_copies(without_toxic(plain(docs), model))))
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    got = corpus_pipeline.run(spark, tiny)
    sp = subword.codec().sp
    same([(r["doc_id"], tuple(r["ids"]), r["source"]) for r in got.collect()], [(i, tuple(sp.encode(t or "")), source) for i, t, _, source, _ in rows])
    assert [p.name.split("-")[1] for p in set(folder.iterdir()) - before] == ["sentencepiece"]  # the rest is cleared away


def test_stages_are_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "mixing", "sentencepiece"]
