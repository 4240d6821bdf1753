"""Filter interaction audit: what each of five filters removes in every order, by its multilinear extension."""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyquill.llm.common import WORD, text_of
from tallyquill.shipping import ship

FILTERS = "ABCDE"
#: Bit of a filter in a mask of the filters that a document fails.
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
ALL = (1 << len(FILTERS)) - 1
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SPACES = r"[\x20\x09-\x0D]+"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class Removal:
    """The rows removed when filter i takes part with probability x_i, as a polynomial linear in each x_i.

    A row that fails the set M goes unless all of M stay away, 1 - prod(1 - x_i for i in M). Multiplied out,
    the product over a set S has the coefficient (-1)^(|S| + 1) times the rows whose mask holds all of S.
    """

    def __init__(self, counts: list[int]) -> None:
        """``counts``: rows by mask."""
        holds = list(counts)
        for bit in BIT.values():
            for s in range(len(holds)):
                if not s & bit:
                    holds[s] += holds[s | bit]
        self.rows = holds[0]
        self.terms = {s: holds[s] if s.bit_count() % 2 else -holds[s] for s in range(1, len(holds))}

    def corner(self, chosen: int) -> int:
        """Rows removed when the filters in ``chosen`` take part and the others don't."""
        return sum(c for s, c in self.terms.items() if s & chosen == s)

    def derivative(self, bit: int) -> dict[int, int]:
        """Terms of the partial derivative by the filter's probability."""
        return {s ^ bit: c for s, c in self.terms.items() if s & bit}

    def shapley(self, bit: int) -> Fraction:
        """The partial derivative along x = (t, ..., t), integrated over t from 0 to 1."""
        return sum((c * Fraction(1, s.bit_count() + 1) for s, c in self.derivative(bit).items()), Fraction(0))


def orders_of(part: str, counts: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """The rows of one part: a tuple as in ``SCHEMA`` for each order and step."""
    rows, fine, bad = Removal(counts), Removal(good), Removal(toxic)
    gone, gone_good, gone_toxic = ([p.corner(s) for s in range(ALL + 1)] for p in (rows, fine, bad))
    total = {bit: int(rows.shapley(bit) * factorial(len(FILTERS))) for bit in BIT.values()}
    out = []
    for order in ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            bit = BIT[name]
            after = before | bit
            removed = gone[after] - gone[before]
            out.append((part, order, step, rows.rows - gone[after], removed, gone[bit] - removed, gone[ALL] - gone[ALL ^ bit], gone_good[after] - gone_good[before], gone_toxic[after] - gone_toxic[before], total[bit]))
            before = after
    return out


def text_mask(text: Column) -> Column:
    """The filters A to D that a text fails."""
    words = F.array_remove(F.split(text, SPACES), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = {"A": n < 50, "B": F.size(F.array_distinct(words)) * 100 < n * 65, "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 5, "D": text.rlike("[#$%&*|]")}
    return sum((F.when(test, F.lit(BIT[name])).otherwise(F.lit(0)) for name, test in fails.items()), F.lit(0)).cast("int")


def fail_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Documents by ``part`` and the ``mask`` of the filters that they fail: ``n``, ``good``, ``toxic``.

    Texts become a digest and a mask where they are read. Copies of a text are counted by part and label
    before they meet, so the rows that meet under a digest are as many as its parts and labels, however
    many copies there are; these tell the smallest id of the text.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    # rows without an id meet no label; a number of their own keeps them from meeting in one task
    rows = rows.withColumn("deal", F.when(F.col("id").isNull(), (F.rand(7) * (1 << 30)).cast("long")).otherwise(F.xxhash64("id")))
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    told = told.withColumn("deal", F.xxhash64("id"))
    known = rows.join(told, ["id", "deal"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    group = ["digest", "mask", "part", "good", "toxic"]
    by_id = known.groupBy(*group, "id", "deal").agg(F.count(F.lit(1)).alias("n"))
    of_id = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    by_text = by_id.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), F.min(of_id).alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    stays = F.col("no_id") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    parts = by_text.withColumn("first", first).withColumn("stays", stays)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("stays").alias("n")), F.struct((F.col("mask") + BIT["E"]).alias("mask"), (F.col("n") - F.col("stays")).alias("n"))))
    masks = parts.select("part", "good", "toxic", split.alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return masks.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """For each part, order of the filters A to E and step: what the step's filter keeps and removes.

    A: under 50 words; B: fewer than 65 % distinct words; C: more than 5 % capitals A-Z; D: any of ``#$%&*|``;
    E: the text is that of a smaller id, in any part. ``kept`` and ``removed`` are of this step, ``redundant``
    fail its filter but went before, ``unique_fails`` fail no other, ``good_lost`` and ``toxic_lost`` are
    those of ``removed`` with ``quality`` and ``toxic`` 1, ``shapley`` is what its filter removes summed over
    all 120 orders. All come from the polynomials of ``Removal``, built from the counts of 32 masks.

    Null text counts as empty (it fails A alone), a null part as the empty string. A row without an id
    neither fails E nor makes others fail it, and has no labels; rows that repeat an id with its text count
    each, and none of them makes the other fail. Where an id has several labels any 1 counts; null labels
    count as 0. An empty table gives no rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    masks = fail_masks(docs, labels, id_col, text_col, part_col)
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                counts, good, toxic = ([0] * (ALL + 1) for _ in range(3))
                for m in row["masks"]:
                    counts[m["mask"]], good[m["mask"]], toxic[m["mask"]] = m["n"], m["good"], m["toxic"]
                columns = list(zip(*orders_of(row["part"], counts, good, toxic), strict=True))
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return parts.mapInArrow(run, SCHEMA)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM t LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, bits FROM o),
p AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before FROM s),
r AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & before = 0) AS removed,
    sum(n) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & bit > 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0) AS toxic_lost
  FROM m, p GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r
"""
