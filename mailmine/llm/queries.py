"""Named queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailmine.llm import sql
from mailmine.llm.decontaminate import find_contamination
from mailmine.llm.html_extract import extract_pages
from mailmine.llm.near_dedup import NearParams, find_near_duplicates
from mailmine.llm.pieces import encode_documents
from mailmine.llm.quality_model import fit_quality, score_quality
from mailmine.llm.quality_rules import clean_by_rules
from mailmine.llm.resampling import resample
from mailmine.llm.secrets import scan_secrets
from mailmine.llm.spelling import group_spellings
from mailmine.llm.substring_dedup import dedup_substrings
from mailmine.llm.suffix_dedup import dedup_suffixes
from mailmine.llm.token_counts import count_tokens
from mailmine.llm.url_filters import filter_urls, host_of, lookup_keys

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_substring_dedup", sql.SUBSTRINGS)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op2_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False).drop("ids")


@query("op3_minhash_near_dedup", sql.NEAR)
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_near_duplicates(table(spark, sf_dir, "documents"), NearParams(shingle=4))


@query("op4_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_quality(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_decontamination", sql.CONTAMINATION)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op6_suffix_dedup", sql.SUFFIXES)
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op7_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("redacted")


@query("op8_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def _number(text, digits: int):
    """A number from the md5 of a text, the same in Spark and in the SQL of the check."""

    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def url_list_changes(pages: DataFrame) -> DataFrame:
    """Dated list changes over every domain and directory of the pages: times and kinds follow from the entry's digest."""

    entries = pages.select(F.explode(lookup_keys(host_of(F.col("url")), F.col("url"))).alias("entry")).distinct()
    number = _number(F.col("entry"), 8)
    steps = F.explode(F.sequence(F.lit(0), (number % 4).cast("int")))
    changes = entries.select("entry", number.alias("number"), steps.alias("step"))
    seconds = F.lit(1704067200) + F.pmod(F.col("number"), F.lit(100)) * 86400 + F.col("step") * 60 * 86400
    return changes.select("entry", F.timestamp_seconds(seconds).alias("at"), (F.pmod(F.floor(F.col("number") / 16) + F.col("step"), F.lit(2)) == 0).alias("listed"))


@query("op9_url_filters", sql.URLS)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    minute = F.pmod(F.col("page_id") * 7919, F.lit(525600))
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + minute * 60))
    found = filter_urls(captures, url_list_changes(pages))
    return found.withColumns({"fetched_at": F.unix_seconds("fetched_at"), "listed_at": F.unix_seconds("listed_at")})


@query("op10_quality_rules", sql.RULES)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clean_by_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op11_html_extraction", sql.PAGES)
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op12_importance_resampling", sql.RESAMPLE)
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_spelling_variants", sql.SPELLINGS)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))
