"""From cleaned mail rows to the prepared table all later steps read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailmine.functions import text as t


def add_texts(df: DataFrame) -> DataFrame:
    """Add clean_subject, clean_body and combined_text. Narrow: no shuffle."""

    cleaned = df.withColumns(
        {
            "clean_subject": t.normalize_whitespace(F.coalesce("subject", F.lit(""))),
            "clean_body": t.clean_body(F.coalesce("body", F.lit(""))),
        }
    )
    return cleaned.withColumn("combined_text", t.combine(F.col("clean_subject"), F.col("clean_body")))


FEATURES = ["greeting", "closing", "intent", "formality", "placeholders", "action_words"]


def add_features(df: DataFrame, text: str = "combined_text") -> DataFrame:
    """Add one column per feature of ``text``; what is not read later is not computed."""

    words, lowered = F.col(text), F.col("__lowered")
    return df.withColumn("__lowered", F.lower(words)).withColumns(
        {
            "greeting": t.extract_greeting(words),
            "closing": t.extract_closing(words),
            "intent": t.intent(words, lowered),
            "formality": t.formality(words, lowered),
            "placeholders": t.placeholder_slots(words),
            "action_words": t.action_words(words, lowered),
        }
    ).drop("__lowered")


def prepare(df: DataFrame) -> DataFrame:
    """Add texts and features: eight columns, one narrow stage."""

    out = add_features(add_texts(df)).withColumn("features", F.struct(*FEATURES))
    return out.drop("placeholders", "action_words")
