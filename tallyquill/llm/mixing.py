"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyquill.llm.common import WORD, text_of, written

#: Bits of the row's 60-bit hash at the first and at the second level of the histogram.
BITS = 10
#: Ways into which the rows of one source are dealt when they meet their threshold.
SALTS = 64
MOST_TIMES = 3


def row_hash(col: Column) -> Column:
    """60 bits of the id's SHA-256, the same in every run and engine."""
    digest = F.sha2(F.coalesce(col.cast("string"), F.lit("")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_times: int = MOST_TIMES) -> DataFrame:
    """``sizes`` has a row per source (skey, source, source_size); adds ``target``.

    Sources in code-point order, null last, weigh ``weights`` over and over. The target is
    ``level * weight``, or ``most_times`` the source's size where that is less; the level makes the
    targets add up to all sizes. It follows in one pass over the sources in the order in which they
    reach their cap: the first one not capped at the level left by those before it sets the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", w.cast("long"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most_times))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left.cast("double") / weight_left).withColumn("rank", F.row_number().over(by_cap))
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("rank"))
    s = s.withColumn("first_free", F.min(free).over(everything))
    level = F.max(F.when(F.col("rank") == F.col("first_free"), F.col("level"))).over(everything)
    return s.withColumn("target", F.least(level * F.col("weight"), F.col("cap").cast("double"))).select("skey", "source_size", "target")


def boundary(hist: DataFrame, budget: DataFrame, bucket: str) -> DataFrame:
    """For each source the bucket in which its budget runs out, and what is left for that bucket."""
    upto = Window.partitionBy("skey").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("upto", F.sum("words").over(upto)).join(budget, "skey")
    over = cum.where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget")))
    return over.select("skey", F.col(bucket), (F.col("budget") - (F.col("upto") - F.col("words"))).alias("left"))


def source_key(source_col: str) -> Column:
    """A key for the source that isn't null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))


def thresholds(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The sized rows (doc_id, skey, size, h), and the plan: by source and salt what it takes."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        source_key(source_col).alias("skey"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        row_hash(F.col(id_col)).alias("h"),
    )
    sized = written(sized, "mix-sizes")
    first, second = F.shiftright("h", 60 - BITS).alias("b1"), F.shiftright("h", 60 - 2 * BITS).alias("b2")
    sizes = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = written(targets.withColumn("times", whole).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")), "mix-targets")

    hist1 = sized.groupBy("skey", first).agg(F.sum("size").alias("words"))
    edge1 = boundary(hist1, targets.select("skey", "budget"), "b1")
    inside = sized.select("skey", first, second, "h", "size").join(edge1, ["skey", "b1"])
    inside = written(inside.select("skey", "b2", "h", "size", "left"), "mix-boundary")
    hist2 = inside.groupBy("skey", "b2").agg(F.sum("size").alias("words"))
    edge2 = boundary(hist2, inside.select("skey", F.col("left").alias("budget")).distinct(), "b2")
    last = inside.drop("left").join(edge2, ["skey", "b2"]).groupBy("skey", "b2", "left", "h").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("skey").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("upto", F.sum("words").over(upto))
    within = 2 * F.col("upto") - F.col("words") <= 2 * F.col("left")
    cut = last.groupBy("skey", "b2").agg(F.max(F.when(within, F.col("h"))).alias("h"))
    cut = cut.select("skey", F.coalesce(F.col("h"), F.shiftleft("b2", 60 - 2 * BITS) - 1).alias("cut"))

    # a source may hold any share of the rows: its few numbers go to every one of SALTS ways
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return sized, written(targets.join(cut, "skey", "left").select("*", salts), "mix-plan")


def times_taken() -> Column:
    once_more = F.when((F.col("budget") > 0) & (F.col("h") <= F.coalesce("cut", F.lit((1 << 60) - 1))), 1).otherwise(0)
    return F.col("times") + once_more


def salt_of(h: Column) -> Column:
    return F.pmod(h, F.lit(SALTS)).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per input row: id, ``size`` (words), ``source_size``, ``target`` and ``taken``.

    A source takes all its rows ``floor(target / source_size)`` times, and once more the rows whose
    hash is below a threshold. A histogram of words by source and the hash's first bits shows the
    bucket in which the rest of the budget runs out; only that bucket is counted again by the next
    bits, and the rows of the one bucket left set the threshold, at the row whose inclusion comes
    nearer the budget. Nothing is sorted but bucket sums and the rows of that last bucket. Thresholds
    for smaller budgets are smaller, so their mixes are subsets.

    Null text has size 0 and null source is a source of its own, the last. Rows that share an id
    share its hash and are taken alike. With no words at all nothing is taken; an empty table gives
    no rows. Other columns are not read.
    """
    sized, plan = thresholds(docs, id_col, source_col, text_col, weights)
    return sized.withColumn("salt", salt_of(F.col("h"))).join(plan, ["skey", "salt"]).select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("size") * times_taken()).alias("taken")
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows that the mix takes, each as often as it is taken, with the columns of ``docs``.

    Rows without words add nothing to a mix and are left out.
    """
    _, plan = thresholds(docs, id_col, source_col, text_col, weights)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), source_key(source_col).alias("skey"), row_hash(F.col(id_col)).alias("h"))
    rows = rows.withColumn("salt", salt_of(F.col("h"))).join(plan, ["skey", "salt"])
    worded = F.coalesce(F.col(f"doc.{text_col}").cast("string"), F.lit("")).rlike(WORD)
    copies = rows.where(worded & (times_taken() > 0)).select("doc", F.explode(F.sequence(F.lit(1), times_taken().cast("int"))))
    return copies.select("doc.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source),
w AS (SELECT *, ((place - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM s),
r AS (
  SELECT *, row_number() OVER by_cap AS rnk,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (by_cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (by_cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM w WINDOW by_cap AS (ORDER BY cap::DOUBLE / weight, place)),
t AS (
  SELECT source, source_size,
         least((SELECT arg_min(level, rnk) FROM r WHERE level * weight <= cap) * weight, cap::DOUBLE) AS target FROM r),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.h,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS times,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS words
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (times + CASE WHEN target - times * source_size > 0
                              AND 2 * upto - words <= 2 * (target - times * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
