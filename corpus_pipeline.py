"""A corpus pipeline of five stages, each applying one operator to all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyquill.llm import common, exact_dedup, mixing, near_dedup, subword, toxicity

#: The model of the first stage can't be told in SQL; the tests compare with plain versions instead.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones, calls toxic go.

    Null and empty texts are scored like texts without a feature. Repeated rows are each scored, alike; a
    repeated id teaches once. Without labels nothing goes that the model's rate alone doesn't reject; an empty
    table stays empty. All columns stay, whatever their names.
    """
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def reject_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays.

    A null text equals an empty one. Of rows that share text and id one stays; a null id loses to any
    other. An empty table stays empty; columns stay.
    """
    return exact_dedup.drop_copies(docs)


def reject_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their five-word shingles the one with the smallest id stays.

    Texts without words, null ones among them, are linked with nothing and stay. Where ids repeat or are
    missing, rows count and the one that was read first stays. An empty table stays empty; columns stay.
    """
    return near_dedup.drop_near_copies(docs, least=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights: documents above the threshold go, others may repeat.

    A null source is a source of its own, the last one. Null and empty texts have no words and take nothing.
    Rows that share an id share its hash and are taken alike, so ties need no rule. An empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and of its top two sampled segmentations, and whether all decode to the text.

    Null and empty texts have no tokens and no samples. Draws depend on id and text, so repeated rows share
    theirs, and a null id is a seed like others. An empty table gives no rows.
    """
    return subword.segment(docs, keep=("lang", "source"), most_bytes=32 << 20)  # the stages before have filled the executors' heaps


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", reject_copies),
    ("minhash_near_dedup", reject_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each one's rows written as Parquet and read again.

    What a stage writes on its way, and the rows that it read, are deleted once its own are written.
    """
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.scratch(spark) as keep:
            kept = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(kept)
        common.unwritten(docs)
        docs = kept
    return docs
