"""The corpus pipeline: language, near-duplicates, benchmark passages, secrets, packing.

Edge cases, for every stage: an empty table gives an empty one. Extra columns, whatever their names, are passed on by all
stages but the last. Repeated rows are rows of their own, of which near-duplicates keep one; a null doc_id is a document
like any other. Texts of any length are taken whole. Null and letterless texts have no language and go in the first stage;
should one come to a later stage, it is an empty text there (and stays null while secrets are masked).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ebbtide.core import checkpointed, table
from ebbtide.llm import decontaminate, language_id, packing, secret_scan, simhash


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: their bits a character under the best model are within its calibrated limit."""
    return language_id.keep_identified(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id (null last), then the first row."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: fewer than a twentieth of their words are in one. An empty benchmark keeps all."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; overlapping ones as one."""
    return secret_scan.mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids, packed into sequences; ties of length go by doc_id and start."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("language", identified), ("near duplicates", deduplicated), ("decontamination", decontaminated), ("secrets", masked), ("packing", packed)]

#: Language models, fingerprints, masks and token ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
