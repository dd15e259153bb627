"""Matching mails to mined templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailmine.functions.text import combine
from mailmine.functions.tone import add_sentiment
from mailmine.operators.encode import HashedEncoder
from mailmine.operators.similarity import rank_targets

def encode_templates(templates: DataFrame, encoder=None) -> DataFrame:
    """``cluster_id, template_vec``: each template's subject and body encoded once."""

    encoder = encoder or HashedEncoder()
    texts = templates.select(
        "cluster_id", F.concat_ws("\n\n", "subject_template", "body_template").alias("__template")
    )
    return encoder.encode(texts, "__template", "template_vec").select("cluster_id", "template_vec")


def match(mails: DataFrame, template_vectors: DataFrame, top_k: int = 1, encoder=None,
          keep: tuple[str, ...] = ()) -> DataFrame:
    """The closest templates of each mail: kept columns, cluster_id, similarity, rank."""

    if top_k < 1:
        raise ValueError(f"top_k is {top_k}, but a mail has at least one closest template")
    encoder = encoder or HashedEncoder()
    texts = mails.withColumn("__text", combine(F.col("subject"), F.col("body")))
    encoded = encoder.encode(texts, "__text", "__query")
    return rank_targets(encoded, template_vectors, top_k, query_id="row_id", query_vec="__query",
                        target_id="cluster_id", target_vec="template_vec", keep=keep)


def match_annotated(mails: DataFrame, template_vectors: DataFrame, top_k: int = 1, encoder=None) -> DataFrame:
    """``match`` plus tone and sentiment of the raw mail text."""

    raw = F.concat(F.coalesce("subject", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    labelled = add_sentiment(mails.withColumn("__raw", raw), "__raw", "detected_sentiment", "detected_tone")
    return match(labelled, template_vectors, top_k, encoder, keep=("detected_sentiment", "detected_tone"))
