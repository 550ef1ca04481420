"""From raw documents to token ids, in five stages.

Each stage is (name, function), and a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of documents.  Between
stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from varigrid.llm.common import stored, table
from varigrid.llm.decontaminate import without_benchmark
from varigrid.llm.jaccard import one_of_each_group
from varigrid.llm.language import with_a_language
from varigrid.llm.mixing import mixed
from varigrid.llm.queries import END_ID, MIX_SEED, TOKENIZER
from varigrid.llm.tokenstore import token_store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter (null and empty texts too) and those of no language go.

    Repeated rows and null ids stay as they are; an empty table, or one without a label, loses texts without a letter alone.
    """
    return with_a_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles, the one of the smallest id.

    Texts without a word stay, rows that repeat both id and text stay together, and null ids go where their group has an id.
    """
    return one_of_each_group(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and rows are told apart by id and text."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal shares, as many documents as before, shuffled; a null source is one, and null ids draw as one id."""
    return mixed(docs, seed=MIX_SEED).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's documents, as read back; a null text is the end id alone, and repeated ids are documents of their own."""
    return token_store(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: The stages need Python operators, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
