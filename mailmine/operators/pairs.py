"""Training data for an encoder: label numbers and positive pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailmine.functions import lexicon as lx
from mailmine.operators.cluster import choose_k, kmeans
from mailmine.operators.components import number_in_order
from mailmine.session import cut_lineage


class NotEnoughPairs(ValueError):
    """Fewer than two training pairs."""


def encode_labels(rows: DataFrame, label: str, out: str = "label_id") -> DataFrame:
    """Number the labels 0, 1, ... in sorted order; a missing label is a label of its own."""

    named = rows.withColumn("__label", F.coalesce(F.col(label).cast("string"), F.lit(lx.MISSING_LABEL)))
    numbers = number_in_order(named, "__label", out)
    return named.join(numbers, "__label").drop("__label")


def pseudo_labels(vectors: DataFrame, n_clusters: int | None = None) -> DataFrame:
    """Cluster numbers as labels: k-means on the base vectors."""

    return kmeans(vectors, choose_k(vectors.count(), n_clusters))


def label_source(rows: DataFrame, label: str | None, allow_pseudo: bool = True) -> str:
    """'supervised' if any label is set, else 'pseudo' if allowed."""

    if label and label in rows.columns and rows.where(F.col(label).isNotNull()).limit(1).count():
        return "supervised"
    if allow_pseudo:
        return "pseudo"
    raise ValueError(f"column {label!r} holds no label, and clusters were not to stand in for them")


def _places(keys: DataFrame, label: str) -> DataFrame:
    """``place`` of every row within its label by (draw, row_id), from 1.

    Equal ranges of the draw's first 32 bits hold about ``PAIR_RANGE_ROWS`` rows of the whole
    table each, so a label with very many rows is spread over many tasks; a label's ranges are
    put in order by their counts.
    """

    keys = cut_lineage(keys)  # read three times
    n_ranges = max(1, -(-keys.count() // lx.PAIR_RANGE_ROWS))
    head = F.conv(F.substring("draw", 1, 8), 16, 10).cast("bigint")
    ranged = keys.withColumn("range", F.shiftright(head * F.lit(n_ranges).cast("bigint"), 32))
    counts = ranged.groupBy(label, "range").count()
    before = Window.partitionBy(label).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(label, "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy(label, "range").orderBy("draw", "row_id"))
    return ranged.withColumn("within", within).join(starts, [label, "range"]).select(
        label, "row_id", (F.col("start") + F.col("within")).alias("place"))


def training_pairs(rows: DataFrame, label: str = "label_id", text: str = "combined_text",
                   max_per_class: int | None = None, seed: int = lx.PAIR_SEED) -> DataFrame:
    """Positive pairs within a label: rows in a seeded order, neighbours paired.

    The order is that of the md5 of seed and row id, so it does not depend on partitioning.
    All rows of every label are paired (the odd last one stays alone); ``max_per_class`` asks for
    a sample instead, the first so many rows of each label, and then each task keeps at most
    that many rows of a label before the shuffle. Texts are joined to the finished pairs.
    """

    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string")))
    keys = rows.where(F.col(label) != lx.NOISE).select(label, "row_id", draw.alias("draw"))
    if max_per_class is None:
        placed = _places(keys, label)
    else:
        by_draw = Window.partitionBy(label).orderBy("draw", "row_id")
        placed = keys.withColumn("place", F.row_number().over(by_draw)).where(F.col("place") <= max_per_class)
    number = F.floor((F.col("place") - 1) / 2)
    paired = placed.groupBy(label, number.alias("number")).agg(
        F.min_by("row_id", "place").alias("anchor_id"), F.max_by("row_id", "place").alias("positive_id"), F.count("*").alias("n"))
    pairs = paired.where("n = 2").select(label, "anchor_id", "positive_id")
    texts = rows.select(F.col("row_id").alias("anchor_id"), F.col(text).alias("anchor"))
    found = pairs.join(texts, "anchor_id").join(
        texts.withColumnsRenamed({"anchor_id": "positive_id", "anchor": "positive"}), "positive_id"
    )
    return found.select(label, "anchor_id", "positive_id", "anchor", "positive")


def shuffled(pairs: DataFrame, seed: int = lx.PAIR_SEED) -> DataFrame:
    """Pairs in a seeded random order."""

    return pairs.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col("anchor_id").cast("string"))), "anchor_id")


def require_pairs(pairs: DataFrame) -> DataFrame:
    found = pairs.limit(2).count()
    if found < 2:
        raise NotEnoughPairs(f"{found} pairs; a fit needs two at least, so labels with two rows or more")
    return pairs
