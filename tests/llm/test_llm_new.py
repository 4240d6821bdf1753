"""Spelling variants, filter audit and nearest neighbours against brute force."""

import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyquill.llm import ann, filter_audit, registry, spelling

LETTERS = "abcdefghijklmnopqrstuvwxyzÀÉéÿ"


def runs_by_brute_force(docs):
    """Counts of the words, a character at a time."""
    counts = Counter()
    for i, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
                run = ""
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def variants_by_brute_force(counts):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
        out[w] = n, len(others), form[w] and counts[form[w]]
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = form[w], root, *out[w]
    return out


def spelt(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def edited(rng, w):
    i = rng.randrange(len(w))
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(LETTERS) + w[i + 1 :], w[:i] + rng.choice(LETTERS) + w[i:], w[:i] + w[i] + w[i:]])


@pytest.mark.parametrize("letters", [512, 7])
def test_variants_equal_brute_force(spark, letters):
    """Also where words of 8 letters count as long ones, which are told by hashes."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(6, 10))) for _ in range(60)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa"}
    for _ in range(2):
        words |= {edited(rng, w) for w in sorted(words)}
    counts = {w: rng.choice([5, 6, 7, 30, 31, 160, 900, 5000]) for w in words if len(w) >= 6}
    want = variants_by_brute_force(counts)
    assert sum(x[0] is not None and x[1] != x[0] for x in want.values()) > 3
    assert spelt(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), spelt=letters)) == want


def test_words_equal_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = runs_by_brute_force([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == want and len(want) > 500


def test_op11_equals_brute_force(spark, tiny):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    counts = runs_by_brute_force(docs)
    got = spelt(registry.QUERIES["op11_spelling_variants"](spark, tiny))
    assert set(got) == set(counts)
    some = dict(sorted(counts.items(), key=lambda x: zlib.crc32(x[0].encode()))[:150])
    near = lambda w: [v for v in counts if abs(len(v) - len(w)) < 2 and any(w[:i] + w[i + d :] == v[:i] + v[i + e :] for d, e in ((1, 1), (0, 1), (1, 0)) for i in range(max(len(w), len(v))) if len(w) - d == len(v) - e) and v != w]
    for w, n in some.items():
        others = near(w)
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        best = best if best and counts[best] >= 5 * n else None
        assert (got[w][0], got[w][2], got[w][3], got[w][4]) == (best, n, len(others), best and counts[best]), w


def test_variants_of_edge_rows(spark):
    long = "".join(random.Random(1).choice(LETTERS[:26]) for _ in range(3000))
    almost, fewer, edge = long[:1500] + "é" + long[1501:], long[:700] + long[701:], long[:513]
    rows = [(i, t, "en", 1) for i in (1, 2, 3, 4, 5, None) for t in (long, f"{almost} {almost}, {almost};{almost}-{almost} {almost}", fewer, edge, edge[:-1], None, "", "ÉCLAIRS éclairs ECLAIRS")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    want = variants_by_brute_force(runs_by_brute_force([r[:2] for r in rows]))
    assert {len(w) for w in want} >= {3000, 2999, 513, 512, 7} and any(x[0] == almost for x in want.values())
    assert spelt(spelling.spelling_variants(docs)) == want
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def orders_by_brute_force(docs, labels):
    """Each order's filters, one after another, on each document."""
    fails = {}
    for k, (i, text, _) in enumerate(docs):
        text = text or ""
        words = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ")
        words = [w for w in words if w]
        fails[k] = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    out, shapley = {}, Counter()
    for part in {p or "" for _, _, p in docs}:
        own = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = set(own)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if fails[k][f]}
                left -= gone
                shapley[part, f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(fails[k][f] for k in own) - len(gone), sum([x for x in "ABCDE" if fails[k][x]] == [f] for k in own),
                    sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone),
                ]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ["", None, "short", "SHOUT " * 60, " ".join(f"w{i}" for i in range(70)), " ".join(f"w{i}" for i in range(70)) + " 50% #1", "again " * 80, "Once\x0band\ttwice " * 30, "x y " * 50, "é" * 20_000, " ".join(f"W{i}" for i in range(90))]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "a", "b"])) for _ in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [None, *range(30), 3, 4]]
    frame = spark.createDataFrame([(*d, 1, 2, 3, "x") for d in docs], "doc_id long, text string, source string, n int, mask int, id int, part string")
    told = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, n int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(frame, told).collect()}
    assert got == orders_by_brute_force(docs, labels) and any(sum(v) for v in got.values())
    assert filter_audit.audit(frame.limit(0), told).count() == 0
    assert filter_audit.audit(frame, told.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_removal_polynomial_is_exact():
    rng = random.Random(2)
    counts = [rng.randrange(1 << 60) for _ in range(32)]
    p = filter_audit.Removal(counts)
    for chosen in range(32):
        assert p.corner(chosen) == sum(n for m, n in enumerate(counts) if m & chosen)
    assert sum(p.shapley(b) for b in filter_audit.BIT.values()) == p.corner(31)
    assert np.prod([p.shapley(b).denominator <= 60 for b in filter_audit.BIT.values()])


def neighbours_by_brute_force(rows, queries, k):
    """By id the ids and scores of the nearest, over rows (id, vector) of which ids may repeat."""
    usable, out = {}, {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = min(usable.get(i, v), v)
    for q in {i for i, _ in queries} & set(usable):
        a = np.array(usable[q], float)
        a /= abs(a).max()
        near = []
        for i, v in usable.items():
            if i != q and len(v) == len(a):
                b = np.array(v, float)
                b /= abs(b).max()
                near.append((-float(a @ b) / float(np.sqrt(a @ a) * np.sqrt(b @ b)), i))
        out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return {q: x for q, x in out.items() if x}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def vector_rows(n, dim, seed, clusters):
    """Half in tight clusters of their own sizes, half anywhere."""
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((clusters, dim))
    near = centers[(rng.random(n // 2) ** 3 * clusters).astype(int)] + 0.15 * rng.standard_normal((n // 2, dim))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(np.concatenate([near, rng.standard_normal((n - n // 2, dim))]))]


@pytest.mark.parametrize(("dim", "lists"), [(64, 100), (24, 60), (3, 50)])
def test_neighbours_are_found(spark, monkeypatch, dim, lists):
    monkeypatch.setattr(ann, "LIST", lists)
    rows = vector_rows(3000, dim, dim, 20)
    asked = [r for r in rows if r[0] % 25 == 0]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = found(ann.nearest(frame, frame.where("vec_id % 25 = 0"))), neighbours_by_brute_force(rows, asked, 5)
    assert recall(got, want) >= 0.95
    scores = {(q, i): s for q, x in neighbours_by_brute_force(rows, asked, 3000).items() for i, s in x}
    assert all(abs(s - scores[q, i]) < 1e-12 for q, x in got.items() for i, s in x)


def test_clustered_queries_probe_few_lists():
    rows = np.array([v for _, v in vector_rows(8000, 32, 1, 40)])
    u = ann.units(rows)
    space = ann.Space(u, len(u) * ann.LIST // 100)
    at, along = space.nearest(u)
    for i in range(len(space.rows)):
        own = along[at == i]
        space.rows[i], space.mean[i], space.var[i] = len(own), own.mean() if len(own) else 0, own.var() if len(own) else 0
    probed = {"near": [], "far": []}
    for kind, asked in (("near", u[:4000:100]), ("far", u[4000::100])):
        for q in asked:
            cosines = space.centers @ q
            first = space.first_lists(cosines, 6)
            least = np.sort(u[np.isin(at, first)] @ q)[-6]
            probed[kind].append(len(first) + len(space.lists_for(cosines, least, 6)))
    assert np.mean(probed["near"]) < 0.25 * len(space.rows) < np.mean(probed["far"])


def test_early_tests_keep_what_is_near():
    rng = np.random.default_rng(4)
    q = ann.units(rng.standard_normal((1, 128)))[0]
    x = ann.units(q + np.linspace(0.02, 0.4, 4000)[:, None] * rng.standard_normal((4000, 128)))
    turn = np.linalg.qr(rng.standard_normal((128, 128)))[0]
    distance = ((x - q) ** 2).sum(axis=1)
    most = float(np.sort(distance)[200])
    left = set(ann.scan((x @ turn).T.astype(np.float32), (q @ turn).astype(np.float32), most).tolist())
    near = set(np.flatnonzero(distance <= most).tolist())
    assert len(near & left) >= 0.99 * len(near) and len(left) <= len(near) + 5


def test_neighbours_of_edge_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(50, rows[0][1]), (50, [9.0] * 8), (200, None), (201, []), (202, [0.0] * 8), (203, [1.0, None]), (204, [float("nan"), 1.0]), (205, [float("inf")] * 8), (None, [1.0] * 8), (206, [1.0, 2.0]), (207, [1.0, 2.0]), (208, [2.0**660] * 8), (209, [2.0**-990] * 8), (210, [-3.0]), (211, rows[3][1]), (212, [4 * x for x in rows[3][1]])]
    frame = spark.createDataFrame([(i, v, 1, 2, "x", [1]) for i, v in rows], "vec_id long, embedding array<double>, list int, dim int, v string, id array<int>")
    got = found(ann.nearest(frame, frame))
    want = neighbours_by_brute_force(rows, rows, 5)
    assert set(got) == set(want) and 210 not in got and [i for i, _ in got[100]] == [i for i, _ in want[100]] == [0, 50, 101, 102, 103] and [i for i, _ in got[206]] == [207]
    for q, x in want.items():
        assert [round(s, 9) for _, s in got[q]] == [round(s, 9) for _, s in x], q
        exact = [i for i, s in x if abs(s - 1) > 1e-9]
        assert [i for i, s in got[q] if abs(s - 1) > 1e-9] == exact, q
    assert found(ann.nearest(frame, frame.limit(0))) == {} and found(ann.nearest(frame.limit(0), frame)) == {}


def test_op13_recall(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = found(registry.QUERIES["op13_nearest"](spark, small))
    assert recall(got, neighbours_by_brute_force(rows, [r for r in rows if r[0] % 50 == 0], 5)) >= 0.95
