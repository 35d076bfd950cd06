"""A corpus from ``documents``: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkruns.llm.common import materialize
from sparkruns.llm.exact_dedup import drop_exact_duplicates
from sparkruns.llm.ngram_join import drop_similar
from sparkruns.llm.packing import packed_sequences
from sparkruns.llm.suffix_dedup import trim_repeats
from sparkruns.llm.toxicity import drop_toxic, fit_toxicity

#: Shortest passage in bytes that is cut where it repeats: 51 words of one letter and the 50 spaces between them.
PASSAGE_BYTES = 101
#: Chunks of text that a worker of the last stage remembers, and bytes of text that it encodes at once: executors still
#: hold memory of the stages before.
MEMO = 200_000
BLOCK = 1 << 19


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; the model learns outside the held-out fold.

    Null and empty texts score by the bias alone and very long ones whole; repeated rows share a score, so they stay or
    go together; a score equal to the threshold goes; without labels nothing is learnt and all stay; an empty table stays
    empty; other columns, whatever their names, are handed through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, fit_toxicity(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest identifier stays.

    Null and empty texts are copies of each other; very long ones are compared whole; a null identifier loses; of rows
    that repeat identifier and text one stays; an empty table stays empty; other columns, whatever their names, are
    handed through.
    """
    return drop_exact_duplicates(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles the smallest identifier stays.

    Texts without words are linked with nothing and stay; very long ones count whole; a null identifier counts as the
    smallest; rows that repeat the identifier of the row that stays are the same document and stay with it; an empty
    table stays empty; other columns, whatever their names, are handed through.
    """
    return drop_similar(docs, size=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that also start in a document with a smaller identifier; documents stay, if only as empty texts.

    Null and short texts are unchanged; very long ones are judged whole; a null identifier counts as the smallest; rows
    with one identifier take nothing from each other; an empty table stays empty; ``n_chars``, where there is one, is
    counted anew, and other columns, whatever their names, are handed through.
    """
    trimmed = trim_repeats(docs, min_bytes=PASSAGE_BYTES)
    if "n_chars" not in docs.columns:
        return trimmed
    return trimmed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 2048 tokens, of which 1792 bear loss, and 16 segments.

    Null and empty texts are packed as the end id alone; very long ones take many pieces; repeated rows are packed each;
    of pieces with equal gains any one goes first, the same in each run over the same partitions; an empty table gives no pieces; other columns are not read.
    """
    packed = packed_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), memo=MEMO, block=BLOCK)
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: No stage but the exact deduplication can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
