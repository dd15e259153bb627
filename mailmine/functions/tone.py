"""Rule-based sentiment and tone, and the plug point for a user's scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailmine.functions import lexicon as lx


def marker_hits(lowered: Column, markers: Iterable[str]) -> Column:
    """How many different markers the lowered text contains."""

    out = None
    for marker in markers:
        hit = lowered.contains(marker).cast("int")
        out = hit if out is None else out + hit
    return out


def _argmax_label(scores: dict[str, Column], default: str) -> Column:
    best = F.greatest(*scores.values())
    label = F.when(best == 0, default)
    for name, score in scores.items():
        label = label.when(score == best, name)
    return label


def add_scores(df: DataFrame, text: str, prefix: str = "score_") -> DataFrame:
    """One integer column per marker set, computed in one narrow stage; the text is lower-cased once, not once a set."""

    sets = {"positive": lx.POSITIVE_WORDS, "negative": lx.NEGATIVE_WORDS, **lx.TONE_MARKERS}
    lowered = df.withColumn("__lowered", F.lower(F.col(text)))
    return lowered.withColumns({prefix + n: marker_hits(F.col("__lowered"), words) for n, words in sets.items()}).drop("__lowered")


def add_sentiment(df: DataFrame, text: str, sentiment: str = "sentiment", tone: str = "tone",
                  scores: str | None = None) -> DataFrame:
    """Add sentiment and tone of ``text``; with ``scores`` also the map of all hit counts."""

    keep = df.columns
    prefix = "__score_"
    scored = add_scores(df, text, prefix)
    pos, neg = F.col(prefix + "positive"), F.col(prefix + "negative")
    tones = {name: F.col(prefix + name) for name in lx.TONE_MARKERS}
    added = {
        sentiment: F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral"),
        tone: _argmax_label(tones, lx.DEFAULT_TONE),
    }
    if scores:
        named = {"positive": pos, "negative": neg, **tones}
        added[scores] = F.map_from_arrays(
            F.array(*[F.lit(n) for n in named]), F.array(*[c.cast("double") for c in named.values()])
        )
    out = scored.withColumns(added)
    return out.select(*[c for c in keep if c not in added], *added)


def fill_if_all_null(df: DataFrame, filled: dict[str, str]) -> DataFrame:
    """Fill a label column from another one, only where the whole column is null.

    ``filled`` maps label column -> column with computed values. The test is one
    aggregate row over the labels alone, so only those columns are scanned for it.
    """

    gate = df.agg(*[F.count(c).alias(f"__n_{c}") for c in filled]).first()
    return df.withColumns(
        {c: F.col(src) if gate[f"__n_{c}"] == 0 else F.col(c) for c, src in filled.items()}
    )


# a scorer takes a series of texts and returns a frame with columns label, score
Scorer = Callable[[pd.Series], pd.DataFrame]


def add_model_sentiment(df: DataFrame, text: str, load_scorer: Callable[[], Scorer],
                        sentiment: str = "sentiment", tone: str = "tone",
                        confidence: str = "confidence", fault: str | None = None) -> DataFrame:
    """Sentiment from a user's model, tone from the rules.

    ``load_scorer`` runs once per task. A label holding 'pos' or 'neg' decides the
    sentiment; a batch the scorer fails on falls back to the rules, and ``fault`` names
    a column for what went wrong with a row's batch (null: nothing). The scorer
    gets the whole text and truncates as its model needs.
    """

    @F.pandas_udf("label string, score double, fault string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load_scorer()
        for texts in batches:
            try:
                out = scorer(texts)[["label", "score"]].reset_index(drop=True)
                out["fault"] = None
            except Exception as error:  # the rules take over, and the fault is told
                out = pd.DataFrame({"label": None, "score": None, "fault": repr(error)[:500]}, index=range(len(texts)))
            yield out.astype({"label": object, "score": "float64", "fault": object})

    ruled = add_sentiment(df, text, "__rule", tone).withColumn("__model", score(F.col(text)))
    label = F.lower(F.col("__model.label"))
    model = F.when(label.contains("pos"), "positive").when(label.contains("neg"), "negative")
    return ruled.withColumns(
        {
            sentiment: F.when(label.isNull(), F.col("__rule")).otherwise(
                F.coalesce(model, F.lit("neutral"))
            ),
            confidence: F.col("__model.score"),
            **({fault: F.col("__model.fault")} if fault else {}),
        }
    ).drop("__rule", "__model")
