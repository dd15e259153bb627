"""Mining templates: one representative mail per cluster, generalised, ranked and de-duplicated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailmine.functions import lexicon as lx
from mailmine.functions import placeholders as ph
from mailmine.functions.vectors import cosine
from mailmine.operators.cluster import centroids, without_noise
from mailmine.operators.dedup import greedy_keep
from mailmine.operators.encode import HashedEncoder
from mailmine.operators.labels import majority_labels, phrase_lists, top_phrases
from mailmine.session import cut_lineage

LABELS = ["category", "tone", "formality", "sentiment", "intent"]
PHRASES_PER_TEMPLATE = 5

TEMPLATE_COLUMNS = [
    "template_id", "cluster_id", "cluster_size", "category", "tone", "sentiment", "intent",
    "subject_template", "body_template", "placeholders", "representative_email_id",
    "similarity_to_centroid", "common_phrases",
]


class MisalignedInput(ValueError):
    """Rows, vectors and cluster numbers do not cover the same mails."""


def join_members(rows: DataFrame, vectors: DataFrame, assignments: DataFrame) -> DataFrame:
    """Rows with their vector and cluster; raises if a row lacks one of them."""

    members = cut_lineage(
        rows.join(vectors.select("row_id", "embedding"), "row_id").join(
            assignments.select("row_id", "cluster_id"), "row_id"
        )
    )
    # per id, so that a doubled one and a missing one do not cancel out
    sides = [df.select("row_id", *[F.lit(int(k == own)).alias(f"n{k}") for k in range(3)])
             for own, df in enumerate((rows, vectors, assignments))]
    per_id = sides[0].union(sides[1]).union(sides[2]).groupBy("row_id").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(3)])
    wrong = per_id.where("n0 <> 1 or n1 <> 1 or n2 <> 1").limit(5).collect()
    if wrong:
        raise MisalignedInput(f"not exactly one row, vector and cluster: {[tuple(r) for r in wrong]}")
    return members


def require_aligned(rows: DataFrame, assignments: DataFrame, placed: DataFrame) -> None:
    """Raises unless ``placed``, the rows with their cluster number, has each row once; three counts of ids."""

    n = F.count("*").alias("n")
    found = placed.agg(n, F.countDistinct("row_id").alias("d")).first()
    counts = (rows.agg(n).first()["n"], assignments.agg(n).first()["n"], found["n"], found["d"])
    if len(set(counts)) > 1:
        raise MisalignedInput(f"rows, cluster numbers, rows with one, different row ids: {counts}")


def representatives(members: DataFrame, centers: DataFrame) -> DataFrame:
    """The member most similar to its cluster's centroid; a tie goes to the smallest row id."""

    rows = without_noise(members.select("row_id", "cluster_id", "embedding"))
    scored = rows.join(centers.select("cluster_id", "centroid"), "cluster_id").select(
        "cluster_id", "row_id", cosine(F.col("embedding"), F.col("centroid")).alias("similarity")
    )
    best = F.max(F.struct("similarity", (-F.col("row_id")).alias("minus_row"))).alias("best")
    return scored.groupBy("cluster_id").agg(best).select(
        "cluster_id", (-F.col("best.minus_row")).alias("row_id"), F.col("best.similarity").alias("similarity")
    )


def cluster_templates(members: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """One template per cluster, before ranking and de-duplication.

    ``members`` carries row_id, email_id, the texts, the labels, cluster_id and
    embedding; ``placed``, if given, is a table of its row_id, cluster_id and embedding alone. Four
    aggregations by cluster meet in joins of one row per cluster.
    """

    placed = members if placed is None else placed
    centers = cut_lineage(centroids(placed))
    chosen = cut_lineage(representatives(placed, centers))
    texts = members.select("row_id", "email_id", "clean_subject", "clean_body").join(chosen, "row_id")
    bodies = ph.add_body_template(texts, "clean_body", "body_template")
    grouped = without_noise(members)
    labels = majority_labels(grouped, "cluster_id", LABELS)
    phrases = phrase_lists(
        top_phrases(grouped, "combined_text", 3, PHRASES_PER_TEMPLATE, "cluster_id"), "cluster_id"
    )
    joined = (
        bodies.join(centers.select("cluster_id", F.col("size").alias("cluster_size")), "cluster_id")
        .join(labels, "cluster_id")
        .join(phrases, "cluster_id", "left")
    )
    return joined.select(
        ph.template_id(F.col("body_template")).alias("template_id"),
        "cluster_id",
        "cluster_size",
        "category",
        F.coalesce("tone", "formality").alias("tone"),
        "sentiment",
        "intent",
        ph.subject_template(F.col("clean_subject")).alias("subject_template"),
        "body_template",
        ph.placeholder_targets(F.col("body_template")).alias("placeholders"),
        F.nullif(F.col("email_id"), F.lit("")).alias("representative_email_id"),
        F.col("similarity").alias("similarity_to_centroid"),
        F.coalesce("common_phrases", F.array().cast("array<string>")).alias("common_phrases"),
    )


def ranked(templates: DataFrame) -> DataFrame:
    """Largest cluster first, ties by cluster number."""

    return templates.orderBy(F.col("cluster_size").desc(), F.col("cluster_id").asc())


def capped(templates: DataFrame, max_templates: int = lx.MAX_TEMPLATES) -> DataFrame:
    """An explicit top list."""

    return ranked(templates).limit(max_templates)


def deduplicated(templates: DataFrame, encoder=None, threshold: float = lx.DUPLICATE_SIMILARITY) -> DataFrame:
    """Drop templates whose body is too similar to a kept template of a larger cluster."""

    encoder = encoder or HashedEncoder()
    items = encoder.encode(templates.select("cluster_id", "cluster_size", "body_template"), "body_template", "vec")
    kept = greedy_keep(
        cut_lineage(items), id_col="cluster_id", priority_col="cluster_size", vec_col="vec", threshold=threshold
    )
    return templates.join(kept, "cluster_id", "left_semi")


def generate_templates(members: DataFrame, encoder=None, threshold: float = lx.DUPLICATE_SIMILARITY,
                       max_templates: int | None = None, placed: DataFrame | None = None) -> DataFrame:
    """Templates of all clusters, de-duplicated and ranked; ``max_templates`` asks for a top list."""

    built = cut_lineage(cluster_templates(members, placed))
    kept = deduplicated(built, encoder, threshold)
    kept = ranked(kept) if max_templates is None else capped(kept, max_templates)
    return kept.select(*TEMPLATE_COLUMNS)


def search(templates: DataFrame, category: str | None = None, tone: str | None = None, text: str = "") -> DataFrame:
    """Templates of a category and tone whose fields contain the text, in any case."""

    out = templates
    if category:
        out = out.where(F.col("category") == category)
    if tone:
        out = out.where(F.col("tone") == tone)
    wanted = text.strip().lower()
    if wanted:
        fields = ["subject_template", "body_template", "intent", "category", "tone", "sentiment"]
        out = out.where(F.lower(F.concat_ws(" ", *fields)).contains(wanted))
    return out


def lookup(templates: DataFrame, template_id: str) -> DataFrame:
    return templates.where(F.col("template_id") == template_id)


def facets(templates: DataFrame) -> DataFrame:
    """Distinct categories and tones for filter lists, sorted."""

    pairs = templates.select(F.expr("stack(2, 'category', category, 'tone', tone) as (facet, value)"))
    return pairs.where("value <> ''").distinct().orderBy("facet", "value")


def listing(templates: DataFrame) -> DataFrame:
    """What a list of templates shows: everything but the phrases, with the total count."""

    total = templates.agg(F.count("*").alias("count"))
    rows = templates.drop("common_phrases").withColumn("__one", F.lit(1))
    return rows.join(total.withColumn("__one", F.lit(1)), "__one").drop("__one")
