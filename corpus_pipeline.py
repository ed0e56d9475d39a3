"""The corpus pipeline: quality rules, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of documents. Its result is written
before the next stage is called, which therefore first removes the tables that the stages before it left in the shared folder.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any name. A null or empty text fails the quality
rules, so it does not reach the later stages; those take it all the same: it is not toxic, no near duplicate, has no personal data, and packs as its end id alone. Rows
without doc_id are judged like others; the join keeps each of them, and one of the rows that share a doc_id. Ties go to the least doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import packing, private_data, quality_rules, shingle_join, toxicity
from loomgraph.llm.common import Stored, documents


_left: list[Stored] = []


def _scratch(spark: SparkSession) -> Stored:
    """For a stage's own tables; those of stages whose results are written go."""
    while _left:
        old = _left.pop()
        if old.spark is spark:
            old.drop(*list(old.paths))
    _left.append(Stored(spark))
    return _left[-1]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the current policy of the quality rules rejects."""
    return quality_rules.accepted(docs, _scratch(spark))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents with a toxicity of 0.5 or more, by a model of this stage's own documents."""
    _scratch(spark)
    return toxicity.clean_rows(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each component of near duplicates."""
    return shingle_join.one_of_each(docs, _scratch(spark))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and disclosing terms in the texts."""
    clean = private_data.sanitise(docs, _scratch(spark))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences: one row per piece."""
    _scratch(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", reject_low_quality),
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_each),
    ("personal_data", sanitise),
    ("packing", pack),
]

#: SQL can express neither the toxicity model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again; the last one's rows."""
    docs, stored = documents(spark, sf_dir), Stored(spark)
    for name, stage in STAGES[:-1]:
        docs = stored.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
