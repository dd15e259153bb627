"""Cluster quality, template quality and the run report.

All cluster metrics are linear in the number of rows: pair sums are rewritten with
the vector sum of each cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailmine.functions.text import add_readability, strip
from mailmine.functions.vectors import distance, dot, l2_normalize, scaled, squared_norm, sum_vector
from mailmine.operators.balls import closest, meeting, near_blocks, plant, stack, wide_and_close
from mailmine.operators.cluster import cluster_sums, without_noise
from mailmine.operators.similarity import rank_targets
from mailmine.session import cut_lineage


def _means(members: DataFrame) -> DataFrame:
    mean = scaled(F.col("total"), 1 / F.col("size"))
    # written once: read twice, and its size lets the planner broadcast it or not
    return cut_lineage(cluster_sums(members).select("cluster_id", "size", mean.alias("mean")))


def silhouette(members: DataFrame, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """One row ``silhouette_score``: mean cosine silhouette of ``members(row_id, cluster_id, embedding)``.

    Null with fewer than two clusters, fewer than three rows, or as many clusters as rows.
    The mean distance of a row to a cluster is one minus its dot product with the
    cluster's mean, so the nearest other cluster is a nearest-target search, which visits
    only blocks of means that can be nearest; ``report`` as there.
    """

    unit = without_noise(members).select("row_id", "cluster_id", l2_normalize("embedding").alias("embedding"))
    means = _means(unit)
    others = means.select(F.col("cluster_id").alias("other"), F.col("mean").alias("other_mean"))
    nearest = rank_targets(unit, others, 1, query_id="row_id", query_vec="embedding", target_id="other",
                           target_vec="other_mean", keep=("cluster_id", "embedding"), skip="cluster_id", report=report)
    rows = nearest.join(means, "cluster_id").select(
        "cluster_id", "size", "similarity", dot("embedding", "mean").alias("own"), squared_norm("embedding").alias("norm")
    )
    size = F.col("size")
    inside = (size - size * F.col("own") - (1 - F.col("norm"))) / (size - 1)
    outside = F.lit(1.0) - F.col("similarity")
    top = F.greatest(inside, outside)
    score = F.when(size == 1, 0.0).when(top == 0, 0.0).otherwise((outside - inside) / top)
    summary = rows.agg(
        F.avg(score).alias("score"), F.count("*").alias("n"), F.countDistinct("cluster_id").alias("k")
    )
    valid = (F.col("k") >= 2) & (F.col("n") >= 3) & (F.col("k") < F.col("n"))
    return summary.select(F.when(valid, F.col("score")).alias("silhouette_score"))


def _worst_ratio(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
    """Per cluster: the largest (spread + other spread) / distance of the two means."""

    here, there = stack(l["mean"]), stack(r["mean"])
    squares = (here**2).sum(axis=1)[:, None] + (there**2).sum(axis=1)[None, :] - 2.0 * here @ there.T
    apart = np.sqrt(np.maximum(squares, 0.0))
    apart[l["cluster_id"].to_numpy()[:, None] == r["cluster_id"].to_numpy()[None, :]] = np.inf
    apart[apart < 1e-12] = np.inf
    ratio = (l["spread"].to_numpy()[:, None] + r["spread"].to_numpy()[None, :]) / apart
    return pd.DataFrame({"cluster_id": l["cluster_id"].to_numpy(), "ratio": ratio.max(axis=1)})


def davies_bouldin(members: DataFrame, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """One row ``davies_bouldin_score`` (Euclidean, plain means); null with fewer than two clusters.

    Means are planted as a ball tree. A block of means meets itself and the closest blocks first; what
    it finds is the floor for all others, which are visited only if their spreads and distance can
    beat it. ``report`` is told how many pairs of blocks there are, and how many were visited.
    """

    means = _means(members)
    rows = without_noise(members).join(means, "cluster_id")
    gaps = rows.select("cluster_id", distance("embedding", "mean").alias("gap"))
    spread = gaps.groupBy("cluster_id").agg(F.avg("gap").alias("spread"))
    tree = plant(spread.join(means.select("cluster_id", "mean"), "cluster_id"), "cluster_id", "mean")
    out = "cluster_id long, ratio double"

    def worst_of(df: DataFrame) -> DataFrame:
        return df.groupBy("cluster_id").agg(F.max("ratio").alias("ratio"))

    own = tree.leaves.select(F.col("block").alias("lb"), F.col("block").alias("rb"))
    guessed = cut_lineage(closest(tree, tree, 2).unionByName(own).distinct())
    worst = cut_lineage(worst_of(near_blocks(tree.rows, tree.rows, guessed, _worst_ratio, out)))
    bounds = tree.rows.join(worst, "cluster_id").groupBy("block").agg(F.min("ratio").alias("floor"), F.max("spread").alias("spread"))
    bounded = replace(tree, leaves=cut_lineage(tree.leaves.join(bounds, "block")))
    rest = cut_lineage(meeting(bounded, bounded, wide_and_close()).join(guessed, ["lb", "rb"], "left_anti"))
    if report:
        report(tree.leaves.count() ** 2, guessed.count() + rest.count())
    worst = worst_of(worst.unionByName(near_blocks(tree.rows, tree.rows, rest, _worst_ratio, out)))
    return worst.agg(
        F.when(F.count("*") >= 2, F.avg("ratio")).alias("davies_bouldin_score")
    )


def pair_means(members: DataFrame) -> DataFrame:
    """Per cluster of two or more: number of member pairs and their mean cosine, without forming the pairs."""

    own = without_noise(members).select("cluster_id", "embedding", squared_norm("embedding").alias("norm"))
    sums = own.groupBy("cluster_id").agg(
        F.count("*").alias("size"),
        sum_vector(F.col("embedding")).alias("total"),
        F.sum("norm").alias("selves"),
    )
    ordered = F.col("size") * (F.col("size") - 1)
    mean = (squared_norm("total") - F.col("selves")) / ordered
    return sums.where("size >= 2").select(
        "cluster_id", (ordered / 2).cast("bigint").alias("n_pairs"), mean.alias("mean_similarity")
    )


def intra_similarity(members: DataFrame) -> DataFrame:
    """One row: mean pairwise cosine inside a cluster, averaged over clusters of two or more."""

    mean = F.coalesce(F.avg("mean_similarity"), F.lit(0.0))
    return pair_means(members).agg(mean.alias("average_intra_cluster_similarity"))


def n_clusters(assignments: DataFrame) -> DataFrame:
    return without_noise(assignments).agg(F.countDistinct("cluster_id").alias("n_clusters"))


# --- templates --------------------------------------------------------------------------

def template_scores(templates: DataFrame) -> DataFrame:
    """One row: number of templates, mails covered, duplicate share, mean length, mean readability."""

    key = F.lower(strip(F.col("body_template")))
    scored = add_readability(templates.withColumn("__key", key), "body_template", "__readability")
    n = F.count("*")
    return scored.agg(
        n.alias("n_templates"),
        F.coalesce(F.sum("cluster_size"), F.lit(0)).alias("covered"),
        F.when(n > 1, (n - F.countDistinct("__key")) / n).otherwise(0.0).alias("duplicate_template_percentage"),
        F.coalesce(F.avg(F.length("body_template")), F.lit(0.0)).alias("average_template_length"),
        F.avg("__readability").alias("average_readability"),
    )


def coverage(covered, n_emails):
    """Share of mails in kept templates; 0 without mails."""

    return F.coalesce(F.try_divide(covered, n_emails), F.lit(0.0)).cast("double")


def size_map(sizes: DataFrame) -> DataFrame:
    """One row: cluster sizes as a map with text keys."""

    entry = F.struct(F.col("cluster_id").cast("string"), F.col("size"))
    return sizes.agg(F.map_from_entries(F.collect_list(entry)).alias("cluster_sizes"))


def improvement(baseline, tuned):
    """Difference of two scores, null if one of them is missing."""

    return tuned - baseline


def evaluation_report(members: DataFrame, templates: DataFrame, baseline: float | None = None,
                      tuned: float | None = None) -> DataFrame:
    """The run report, one row: counts, cluster quality, template quality, training delta.

    ``members`` has one row per mail with row_id, cluster_id and embedding. Every part
    is a one-row aggregate, so the parts meet on a constant key.
    """

    sizes = cut_lineage(without_noise(members).groupBy("cluster_id").agg(F.count("*").alias("size")))
    parts = [
        members.agg(F.count("*").alias("n_emails")),
        sizes.agg(F.count("*").alias("n_clusters")),
        template_scores(templates),
        silhouette(members),
        davies_bouldin(members),
        intra_similarity(members),
        size_map(sizes),
    ]
    one = F.lit(1).alias("__one")
    row = reduce(lambda x, y: x.join(y, "__one"), [p.select("*", one) for p in parts])
    base, fine = F.lit(baseline).cast("double"), F.lit(tuned).cast("double")
    return row.select(
        "n_emails", "n_clusters", "n_templates", "silhouette_score", "davies_bouldin_score",
        "average_intra_cluster_similarity", "cluster_sizes",
        coverage(F.col("covered"), F.col("n_emails")).alias("template_coverage"),
        "duplicate_template_percentage", "average_template_length", "average_readability",
        base.alias("baseline_silhouette"), fine.alias("fine_tuned_silhouette"),
        improvement(base, fine).alias("fine_tuning_improvement"),
    )


def run_status(members: DataFrame, templates: DataFrame, fine_tuned: bool) -> DataFrame:
    """One row: mails, templates, and whether a fitted encoder was used."""

    one = F.lit(1).alias("__one")
    mails = members.agg(F.count("*").alias("n_emails_loaded")).select("*", one)
    found = templates.agg(F.count("*").alias("n_templates")).select("*", one)
    return mails.join(found, "__one").drop("__one").withColumn("fine_tuned_loaded", F.lit(fine_tuned))


def exact_duplicates(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """Groups of equal texts (trimmed, any case): the first id and the number of copies."""

    key = F.lower(strip(F.col(text)))
    # a digest keeps long texts out of the shuffle
    grouped = texts.groupBy(F.sha2(key, 256).alias("key"))
    return grouped.agg(F.min(id_col).alias(id_col), F.count("*").alias("copies")).drop("key")
