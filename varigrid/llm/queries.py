"""The corpus operators' queries and, where SQL expresses them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.llm.collocations import collocations, collocations_sql
from varigrid.llm.common import shared_dir, table
from varigrid.llm.decontaminate import contamination
from varigrid.llm.fingerprint import fingerprints
from varigrid.llm.jaccard import jaccard_components
from varigrid.llm.language import language_id
from varigrid.llm.mixing import mixed, rates_sql
from varigrid.llm.personal import personal_data
from varigrid.llm.secrets import secrets
from varigrid.llm.shards import sharded
from varigrid.llm.tokenstore import token_store
from varigrid.llm.toxicity import toxicity
from varigrid.llm.treaps import ranked, ranked_sql
from varigrid.llm.webtext import main_text

#: The tokenizer of the token store and the id that closes a document.
TOKENIZER, END_ID = "word_bpe_49k.json", 2
MIX_SEED = 1


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its set's size, component and number of links; a null text or one without words has an empty set and no link, repeated rows are one class, an empty table gives no rows."""
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its likeliest language; ``und`` for a null text or one without letters, ties go to the first name, repeated rows repeat their result, an empty table gives no rows."""
    found = language_id(table(spark, sf_dir, "documents"))
    shares = F.array_sort(F.transform(F.map_entries("langs"), lambda e: F.format_string("%s:%.3f", e["key"], e["value"])))
    return found.withColumn("langs", F.array_join(shares, ","))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its base secrets and all spans; a null or empty text has none, repeated rows repeat their result, an empty table gives no rows."""
    return secrets(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the compacted table gives them back."""
    rows = sharded(table(spark, sf_dir, "documents"), shared_dir(spark)).read()
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document a score learned from labels that aren't held out; empty and null texts get the bias, without labels of both classes all get 0.5, an empty table gives no rows."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the benchmark items that it holds; null and empty texts hold none, rows are told apart by id and text, an empty table on either side gives no item."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its place, length and checksum as read back from the id files; a null text is the end id alone, repeated ids are documents of their own, an empty table gives no rows."""
    return token_store(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page its main text; a null or empty page has an empty one, repeated rows repeat it, a null url belongs to the empty host, an empty table gives no rows."""
    return main_text(table(spark, sf_dir, "pages"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in equal shares, as many documents as there are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs, seed=MIX_SEED).withColumnRenamed("_copy", "copy").select("doc_id", "source", "copy", "text")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its digest, that of its edited text and their likeness; a null text is empty, a lone row is its own next one, an empty table gives no rows."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 phrases of 2 or 3 words with the best weakest cut; a null text has no words, an empty table no rows."""
    return collocations(table(spark, sf_dir, "documents"), max_n=3, least=10, share=50, top=2000)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item; a text without a term is never found, repeated rows are ranked one by one."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of each document; a null text has none, repeated rows repeat their result."""
    return personal_data(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_language_id": op2_language_id,
        "op3_secret_scan": op3_secret_scan,
        "op4_sharding": op4_sharding,
        "op5_toxicity": op5_toxicity,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_token_store": op7_token_store,
        "op8_html_extraction": op8_html_extraction,
        "op9_source_mixing": op9_source_mixing,
        "op10_fingerprints": op10_fingerprints,
        "op11_collocations": op11_collocations,
        "op12_ranked_search": op12_ranked_search,
        "op13_personal_data": op13_personal_data,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
        "op9_source_mixing": rates_sql(MIX_SEED),
        "op11_collocations": collocations_sql(),
        "op12_ranked_search": ranked_sql(),
    }
