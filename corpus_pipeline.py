"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; its output is written
as Parquet and read again as the next stage's documents. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vframe.llm import exact_dedup, mixing, packing, simhash_dedup, toxicity
from vframe.llm.common import mark, sweep, table, written
from vframe.llm.queries import TOKENIZER


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_dedup.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sources interleaved to weights that temper their sizes; the packing stage restores this order."""
    return mixing.in_mixed_order(docs, mixing.tempered(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, which follow the mix.

    Spark deals the files of the stage before to tasks by size, so the mix is worked out again here:
    it follows from the rows alone.
    """
    return packing.pack(mixing.in_mixed_order(docs, mixing.tempered(docs)).select("doc_id", "text"), *TOKENIZER)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: Viterbi decoding, fingerprints, connected components and byte-pair encoding have no SQL form;
#: tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    since = mark()
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
            sweep(since, docs)
    return docs
