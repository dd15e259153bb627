"""A training corpus from raw documents, in stages that each write their result for the next one.

Quality classifier, near-duplicates, benchmark decontamination, secrets, pieces. The first four
return the columns of documents: rejected documents, all but one of a group of near copies and
contaminated documents go; in what stays, secrets are replaced by marks. The last one returns
the piece ids. A stage reads all that the one before it kept, and nothing else of the corpus.

Defined results for odd rows are those of the operators; a row with a null doc_id goes the same
way, and repeated rows of one document count as copies of it. No stage can be expressed in SQL as a whole
(the classifier is trained by gradient descent), so there is no ORACLE_SQL; the tests compare the
stages with brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailmine.llm.decontaminate import find_contamination
from mailmine.llm.near_dedup import without_near_copies
from mailmine.llm.pieces import encode_documents
from mailmine.llm.quality_model import fit_quality, score_quality
from mailmine.llm.secrets import scan_secrets
from mailmine.llm.tables import keep

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more; labels of held-out documents are not learnt from."""

    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn)
    return score_quality(docs, model, carry=True).where("score >= 0.5").select("carry.*")


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies (five words, similarity 0.8)."""

    return without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""

    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return found.where("not contaminated").select("carry.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by the name of its kind."""

    found = scan_secrets(docs, carry=True)
    clean = found.withColumn("clean", F.coalesce("redacted", "carry.text"))
    counted = {"text": F.col("clean"), "n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType)}
    return clean.select(*(counted.get(c, F.col("carry").getField(c)).alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the check that they decode to its text."""

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_one_of_near),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("piece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each result is written and read again."""

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
