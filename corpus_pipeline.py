"""From documents to packed training sequences, one operator a stage.

run() writes what each stage returns to the shared folder and reads it again as the next stage's documents. A stage
keeps the columns of documents, all but the last. ORACLE_SQL is None: character models, SimHash and packing aren't
expressible in SQL; tests hold run() against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontamination, language, packing, pii, simhash
from larkspur.llm.shared import documents, forget, keep


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language model rejects: null, empty and letterless texts, and texts too far from every language.

    Each row is judged by its text alone, so ties and repeated rows share their fate and rows without a doc_id are judged
    like any other. A very long text is read whole. Columns pass as they are, whatever their names; an empty table stays empty.
    """
    return language.without_rejected(docs, language.train(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group of linked fingerprints.

    Null and empty texts are alike. Of rows that repeat whole, or tie for the smallest doc_id of their group, one stays;
    of a group whose rows all lack a doc_id, one stays. Columns pass as they are; an empty table stays empty.
    """
    return simhash.one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, wherever in the text.

    Each row is judged by its text alone: null and empty texts stay, repeated rows share their fate, rows without a doc_id
    are judged like any other. Columns pass as they are; an empty table stays empty, an empty benchmark drops nothing.
    """
    return decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the name of its kind in place of each span of personal data; n_chars follows.

    Every row stays, also without a doc_id or repeated; null texts stay null, empty ones empty. Overlapping spans become
    one, named for the first. Other columns pass as they are; an empty table stays empty.
    """
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences and places.

    A null or empty text is its end id alone. Rows without a doc_id and repeated rows are packed each; ties among pieces of
    one length are free to go anywhere. A very long text is cut into pieces; an empty table gives no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_redaction", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
        forget(before)
        before = docs
    return docs
