"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage takes all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.llm import bpe, curriculum, exact_dedup, near_copies, toxicity
from kvstrata.llm.common import made, scratch, settled, spread_join, sweep, table, without, written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't find toxic; it is fitted on a sample of those with labels.

    Null and empty texts are not toxic, long ones are judged whole; repeated rows are judged alike. Without labels of
    both classes all stay.
    """
    judged = toxicity.judge(docs, docs, table(spark, sf_dir, "labels"))
    return judged.where(~F.col("is_toxic")).select(*[F.col(f"`{c}`") for c in docs.columns])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the document with the largest doc_id, null being the smallest."""
    return exact_dedup.survivors(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id; those without an id come last.

    Null and empty texts are one group; rows that are equal in doc_id and text all stay, or all go. Of the tables made on
    the way the names of the rows that go are left, as the texts of near_copies would lie there beside what later stages move.
    """
    before = made()
    rows = settled(near_copies.groups(docs), "near", before)
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag")
    stays = written(rows.groupBy("root").agg(F.min(name).alias("stays"), F.count("*").alias("rows")).where("rows > 1"), "stays")
    gone = spread_join(rows, stays, ["root"], "rows", rows.count()).where(~name.eqNullSafe(F.col("stays"))).select("doc_id", "tag")
    return without(docs, settled(gone, "gone", before))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each pass, in the order of training; none without words.

    A null source is a source like others, the last. Rows of equal doc_id, text and source share their passes out.
    """
    return curriculum.drawn(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix; a null or empty text has no tokens."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("simhash_near_dedup", unlike),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: SQL can't express the classifier chain, SimHash over BK-trees or BPE; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the last one's rows. What a stage leaves behind is deleted once its output is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = made()
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        sweep(spark, before, path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
