"""Cleaning, mixing and packing of ``documents``: each stage is written as Parquet and read again as the next one's input.

All stages but the last return the columns of documents. Their decisions: toxic documents go; near and equal lines go
but for the first of each, and with them documents that have no other line; of near-equal documents that of the least
id stays; documents are sampled so that source, language and topic come to their target shares; what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.llm import lines, mixing, packing, simhash, toxicity
from atlasmill.llm.queries import MIX, MIX_KEEP, MIX_SWEEPS, table, tokenizer_path
from atlasmill.llm.shared import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 by a model of all labelled ones; texts without features have the labels' rate."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows the text. One that had text and lost every line goes."""
    less = lines.deduplicate(docs)
    kept = less.where(~((F.col("n_removed") > 0) & (F.trim("text") == "")))
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word fingerprints are linked at 4 or fewer bits, that of the least id.

    A null text counts as empty, and texts without words are linked with each other; of equal ids and prints one row stays.
    An empty table stays one.
    """
    return simhash.keep_first(docs, shingle_words=5, radius=4)


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents by source, language and topic.

    Source and language that are null or not named share a value of their own; a null text has no tokens. The draw goes by
    the id's hash, so repeated ids go or stay together. An empty table stays one.
    """
    return mixing.mix(docs, MIX, MIX_KEEP, MIX_SWEEPS).where("mix_kept").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places; a null text is empty, of one closing token. An empty table gives no rows."""
    return packing.pack(stored(packing.pieces(docs, tokenizer_path(), capacity=2048), "pieces"), capacity=2048)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_near_lines), ("simhash near-dedup", drop_near_documents), ("mix to targets", sample_mix), ("best-fit packing", pack_sequences)]

#: SQL can't express the classifier, the signatures or the packing; a test holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
