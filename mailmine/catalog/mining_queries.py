"""Vector, metric and template queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailmine.catalog import duck as d
from mailmine.catalog import duck_mining as m
from mailmine.catalog.registry import query
from mailmine.catalog.tables import mails, prepared_mails, read
from mailmine.functions import lexicon as lx
from mailmine.functions import tone as tn
from mailmine.functions.vectors import l2_normalize
from mailmine.operators import cluster as cl
from mailmine.operators import encode as en
from mailmine.operators import labels as lb
from mailmine.operators import match as mt
from mailmine.operators import metrics as me
from mailmine.operators import pairs as pr
from mailmine.operators import templates as tp
from mailmine.operators.components import number_in_order
from mailmine.operators.dedup import greedy_keep
from mailmine.operators.prepare import add_texts
from mailmine.operators.similarity import rank_targets
from mailmine.session import cut_lineage, scratch_path

# --- shared inputs -----------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The given vectors with their label as cluster number."""

    return read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").alias("cluster_id"), "embedding"
    )


def document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text")
    return en.HashedEncoder().encode(docs, "text").select("doc_id", "embedding")


def desk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Prepared mails with filled sentiment and the group label."""

    rows = prepared_mails(spark, sf)
    found = tn.add_sentiment(rows, "combined_text", "found_sentiment", "found_tone")
    filled = tn.fill_if_all_null(found, {"sentiment": "found_sentiment", "tone": "found_tone"})
    desk = F.concat_ws("/", F.coalesce("category", F.lit(lx.MISSING_LABEL)), "sender", "formality")
    return filled.withColumn("desk", desk)


def desk_members(spark: SparkSession, sf: str) -> DataFrame:
    """Mails with hashed vector and the group number as cluster; written once, read by many steps."""

    rows = cut_lineage(desk_rows(spark, sf).drop("features"))
    members = en.HashedEncoder().encode(pr.encode_labels(rows, "desk", "cluster_id"), "combined_text")
    return cut_lineage(members)


def built_templates(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(tp.cluster_templates(desk_members(spark, sf)))


def mined_templates(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(tp.generate_templates(desk_members(spark, sf)))


def shown(templates: DataFrame) -> DataFrame:
    """Lists as text, similarity rounded, for comparison."""

    return templates.withColumns(
        {
            "placeholders": F.array_join("placeholders", ","),
            "common_phrases": F.array_join("common_phrases", "|"),
            "similarity_to_centroid": F.round("similarity_to_centroid", 6),
        }
    )


def _spread(df: DataFrame, key: str, vector: str) -> DataFrame:
    """A vector column as rows of position and rounded value, zeros left out."""

    # outer: without it the vector is computed once more to test that it is not empty
    long = df.select(key, F.posexplode_outer(vector).alias("position", "value")).where("value <> 0")
    return long.select(key, "position", F.round(F.col("value").cast("double"), 6).alias("value"))


# --- encoding ------------------------------------------------------------------------

@query(
    "encode_hashed",
    f"WITH {d.TEXTS_CTE}, {m.bag_cte('bag', 'texts', 'row_id', 'combined_text')} "
    "SELECT row_id, CAST(bucket AS INTEGER) AS position, round(w, 6) AS value FROM bag",
)
def encode_hashed(spark: SparkSession, sf: str) -> DataFrame:
    rows = add_texts(mails(spark, sf)).select("row_id", "combined_text")
    return _spread(en.HashedEncoder().encode(rows, "combined_text"), "row_id", "embedding")


@query(
    "encode_hashed_documents",
    f"WITH {m.bag_cte('bag', 'documents', 'doc_id', 'text')} "
    "SELECT doc_id, CAST(bucket AS INTEGER) AS position, round(w, 6) AS value FROM bag",
)
def encode_hashed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _spread(document_vectors(spark, sf), "doc_id", "embedding")


@query("encode_tfidf")
def encode_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    rows = add_texts(mails(spark, sf)).select("row_id", "combined_text")
    rows = cut_lineage(rows)
    return en.fit_tfidf(rows, "combined_text").encode(rows, "combined_text").select("row_id", "embedding")


@query(
    "content_key",
    f"WITH {d.TEXTS_CTE} SELECT row_id, sha256('hashed-64' || chr(31) || combined_text) AS content_key FROM texts",
)
def content_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = add_texts(mails(spark, sf))
    return rows.select("row_id", en.content_key(en.HashedEncoder().name, F.col("combined_text")).alias("content_key"))


@query(
    "embed_cache_misses",
    f"WITH {d.TEXTS_CTE}, keyed AS (SELECT sha256('hashed-64' || chr(31) || clean_body) AS content_key, category FROM texts) "
    "SELECT DISTINCT content_key FROM keyed WHERE content_key NOT IN (SELECT content_key FROM keyed WHERE category = 'thank_you')",
)
def embed_cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Contents still to encode when the thank-you mails are cached."""

    encoder = en.HashedEncoder()
    rows = add_texts(mails(spark, sf)).select("row_id", "category", "clean_body")
    cache = rows.where("category = 'thank_you'").select(en.content_key(encoder.name, F.col("clean_body")).alias("content_key"))
    return en.cache_misses(rows, cache, encoder, "clean_body").select("content_key")


# --- similarity ------------------------------------------------------------------------

_VEC = "(SELECT vec_id AS row_id, label AS cluster_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS position FROM embeddings)"
_CENTERS = (
    f"long AS MATERIALIZED (SELECT * FROM {_VEC}), means AS (SELECT cluster_id, position, avg(x) AS c FROM long GROUP BY ALL), "
    "centers AS (SELECT cluster_id, position, c / sqrt(sum(c * c) OVER (PARTITION BY cluster_id)) AS c FROM means)"
)


@query(
    "cosine_pairs",
    f"WITH {_CENTERS} SELECT row_id, c.cluster_id, round(round(sum(x * c), 9), 6) AS similarity FROM long l JOIN centers c USING (position) "
    "GROUP BY row_id, c.cluster_id",
)
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity matrix of all vectors and the cluster centroids."""

    rows = vectors(spark, sf)
    centers = cut_lineage(cl.centroids(rows))
    out = rank_targets(rows, centers, centers.count(), query_id="row_id", query_vec="embedding",
                       target_id="cluster_id", target_vec="centroid")
    return out.select("row_id", "cluster_id", F.round("similarity", 6).alias("similarity"))


@query(
    "nearest",
    f"WITH {m.bag_cte('docs', 'documents', 'doc_id', 'text')}, {m.bag_cte('items', 'benchmark', 'item_id', 'text')}, "
    f"{m.sims_cte('sims', 'docs', 'doc_id', 'items', 'item_id')} SELECT lid AS doc_id, rid AS item_id, round(sim, 6) AS similarity "
    "FROM sims QUALIFY row_number() OVER (PARTITION BY lid ORDER BY sim DESC, rid) = 1",
)
def nearest(spark: SparkSession, sf: str) -> DataFrame:
    items = en.HashedEncoder().encode(read(spark, sf, "benchmark", "item_id", "text"), "text")
    out = rank_targets(document_vectors(spark, sf), items, 1, query_id="doc_id", query_vec="embedding",
                       target_id="item_id", target_vec="embedding")
    return out.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


@query(
    "topk_similar",
    "WITH e AS (SELECT vec_id, embedding::FLOAT[64]::DOUBLE[64] AS v FROM embeddings), sims AS (SELECT l.vec_id, r.vec_id AS other_id, "
    "round(array_inner_product(l.v, r.v), 9) AS sim FROM e l, e r) SELECT vec_id, other_id, round(sim, 6) AS similarity, "
    "CAST(row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other_id) AS INTEGER) AS rank FROM sims QUALIFY rank <= 5",
)
def topk_similar(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "embeddings", "vec_id", "embedding")
    out = rank_targets(rows, rows.withColumnRenamed("vec_id", "other_id"), 5, query_id="vec_id", query_vec="embedding",
                       target_id="other_id", target_vec="embedding")
    return out.select("vec_id", "other_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    "l2_normalize",
    f"WITH scaled AS (SELECT row_id, CAST(position - 1 AS INTEGER) AS position, x * (cluster_id + 1) AS x FROM {_VEC}), "
    "unit AS (SELECT row_id, position, x / sqrt(sum(x * x) OVER (PARTITION BY row_id)) AS u FROM scaled) "
    "SELECT row_id, position, round(u, 6) AS value FROM unit WHERE u <> 0",
)
def q_l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    scaled = rows.withColumn("v", F.transform("embedding", lambda x: x.cast("double") * (F.col("cluster_id") + 1)))
    return _spread(scaled.select("row_id", l2_normalize("v").alias("unit")), "row_id", "unit")


# --- clusters: centroids, sizes, quality ---------------------------------------------------

@query(
    "centroids",
    f"WITH {_CENTERS} SELECT cluster_id, CAST(position - 1 AS INTEGER) AS position, round(c, 6) AS value FROM centers WHERE c <> 0",
)
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    return _spread(cl.centroids(vectors(spark, sf)), "cluster_id", "centroid")


# vectors whose first part is large play the noise that a density clustering leaves
_NOISY = "(SELECT vec_id, CASE WHEN embedding[1] > 0.15 THEN -1 ELSE label END AS label FROM embeddings)"


def noisy_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return rows.select("row_id", F.when(F.col("embedding")[0] > 0.15, lx.NOISE).otherwise(F.col("cluster_id")).alias("cluster_id"))


@query("cluster_sizes", f"SELECT label AS cluster_id, count(*) AS size FROM {_NOISY} WHERE label <> -1 GROUP BY 1")
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return cl.cluster_sizes(noisy_labels(spark, sf))


@query("n_clusters", f"SELECT count(DISTINCT label) AS n_clusters FROM {_NOISY} WHERE label <> -1")
def n_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return me.n_clusters(noisy_labels(spark, sf))


@query("distinct_labels", f"SELECT DISTINCT label AS cluster_id FROM {_NOISY} WHERE label <> -1 ORDER BY 1")
def distinct_labels(spark: SparkSession, sf: str) -> DataFrame:
    return cl.cluster_labels(noisy_labels(spark, sf))


@query(
    "heuristic_k",
    "SELECT source, count(*) AS n, CAST(least(20, greatest(4, round_even(sqrt(greatest(count(*), 4) / 2), 0))) AS INTEGER) AS k "
    "FROM documents GROUP BY source",
)
def heuristic_k(spark: SparkSession, sf: str) -> DataFrame:
    counts = read(spark, sf, "documents", "doc_id", "source").groupBy("source").agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.udf(cl.heuristic_k, "int")("n"))  # one row a source


_PAIRED = (
    "e AS (SELECT vec_id, label, embedding::FLOAT[64]::DOUBLE[64] AS v FROM embeddings), "
    "u AS (SELECT vec_id, label, v, sqrt(array_inner_product(v, v)) AS len FROM e)"
)


@query(
    "silhouette",
    f"WITH {_PAIRED}, dist AS (SELECT l.vec_id, l.label AS own, r.label AS other, sum(CASE WHEN l.vec_id = r.vec_id THEN 0 ELSE "
    "1 - array_inner_product(l.v, r.v) / (l.len * r.len) END) AS total, count(*) AS n FROM u l, u r GROUP BY ALL), "
    "ab AS (SELECT vec_id, max(CASE WHEN own = other THEN total / nullif(n - 1, 0) END) AS a, "
    "min(CASE WHEN own <> other THEN total / n END) AS b FROM dist GROUP BY 1) "
    "SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_score FROM ab",
)
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return me.silhouette(vectors(spark, sf)).select(F.round("silhouette_score", 6).alias("silhouette_score"))


@query(
    "davies_bouldin",
    f"WITH {_CENTERS}, gaps AS (SELECT row_id, cluster_id, sqrt(sum((x - c) * (x - c))) AS gap FROM long JOIN means USING (cluster_id, position) "
    "GROUP BY ALL), spread AS (SELECT cluster_id, avg(gap) AS s FROM gaps GROUP BY 1), apart AS (SELECT a.cluster_id AS i, b.cluster_id AS j, "
    "sqrt(sum((a.c - b.c) * (a.c - b.c))) AS gap FROM means a JOIN means b USING (position) WHERE a.cluster_id <> b.cluster_id GROUP BY ALL), "
    "worst AS (SELECT i, max((p.s + q.s) / gap) AS r FROM apart JOIN spread p ON p.cluster_id = i JOIN spread q ON q.cluster_id = j GROUP BY 1) "
    "SELECT round(avg(r), 6) AS davies_bouldin_score FROM worst",
)
def davies_bouldin(spark: SparkSession, sf: str) -> DataFrame:
    out = me.davies_bouldin(vectors(spark, sf))
    return out.select(F.round("davies_bouldin_score", 6).alias("davies_bouldin_score"))


_INTRA = (
    f"WITH {_PAIRED}, per AS (SELECT l.label AS cluster_id, count(*) AS n_pairs, avg(array_inner_product(l.v, r.v)) AS mean FROM u l JOIN u r "
    "ON l.label = r.label AND l.vec_id < r.vec_id GROUP BY 1) "
)


@query(
    "intra_similarity",
    _INTRA + "SELECT round(coalesce(avg(mean), 0), 6) AS average_intra_cluster_similarity FROM per",
)
def intra_similarity(spark: SparkSession, sf: str) -> DataFrame:
    out = me.intra_similarity(vectors(spark, sf))
    return out.select(F.round("average_intra_cluster_similarity", 6).alias("average_intra_cluster_similarity"))


@query("intra_pairs", _INTRA + "SELECT cluster_id, n_pairs, round(mean, 6) AS mean_similarity FROM per")
def intra_pairs(spark: SparkSession, sf: str) -> DataFrame:
    per = me.pair_means(vectors(spark, sf))
    return per.select("cluster_id", "n_pairs", F.round("mean_similarity", 6).alias("mean_similarity"))


@query(
    "row_vector_join",
    f"WITH {m.MEMBERS_CTE} SELECT row_id, email_id, cluster_id, count(*) AS words FROM members JOIN bag USING (row_id) GROUP BY ALL",
)
def row_vector_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(desk_rows(spark, sf).select("row_id", "email_id", "combined_text", "desk"))
    encoded = en.HashedEncoder().encode(rows, "combined_text").select("row_id", "embedding")
    numbered = pr.encode_labels(rows, "desk", "cluster_id")
    joined = tp.join_members(rows.select("row_id", "email_id"), encoded, numbered)
    filled = F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint")
    return joined.select("row_id", "email_id", "cluster_id", filled.alias("words"))


@query("label_encode", f"WITH {m.MEMBERS_CTE} SELECT row_id, cluster_id AS label_id FROM members")
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(desk_rows(spark, sf).select("row_id", "desk"))
    return pr.encode_labels(rows, "desk").select("row_id", "label_id")


@query(
    "label_encode_documents",
    "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY coalesce(CAST(quality AS VARCHAR), '__missing__')) - 1 AS BIGINT) AS label_id "
    "FROM documents LEFT JOIN labels USING (doc_id)",
)
def label_encode_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id").join(read(spark, sf, "labels", "doc_id", "quality"), "doc_id", "left")
    return pr.encode_labels(docs, "quality").select("doc_id", "label_id")


# --- labels and phrases ------------------------------------------------------------------

_PHRASE_SQL = "SELECT CAST(row_number() OVER (ORDER BY n DESC, seen) AS INTEGER) AS rank, phrase, n FROM {0} ORDER BY n DESC, seen LIMIT 10"


@query(
    "repeated_phrases",
    f"WITH {d.TEXTS_CTE}, {m.grams_cte('grams', 'texts', '1 AS one', 'row_id', 'combined_text')} " + _PHRASE_SQL.format("grams"),
)
def repeated_phrases(spark: SparkSession, sf: str) -> DataFrame:
    # written, as the texts are read three times
    rows = cut_lineage(add_texts(mails(spark, sf)).select("row_id", "combined_text"))
    return lb.top_phrases(rows, "combined_text", 3, 10)


@query(
    "repeated_phrases_documents",
    f"WITH {m.grams_cte('grams', 'documents', 'lang', 'doc_id', 'text', 2)} SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, seen) "
    "AS INTEGER) AS rank, phrase, n FROM grams QUALIFY rank <= 10",
)
def repeated_phrases_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "lang", "text")
    return lb.top_phrases(docs, "text", 2, 10, group="lang", order="doc_id")


@query(
    "cluster_phrases",
    f"WITH {m.MEMBERS_CTE}, {m.PHRASES_CTE} SELECT cluster_id, CAST(rank AS INTEGER) AS rank, phrase, n FROM phrases",
)
def cluster_phrases(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(desk_rows(spark, sf).select("row_id", "combined_text", "desk"))
    return lb.top_phrases(pr.encode_labels(rows, "desk", "cluster_id"), "combined_text", 3, 5, "cluster_id")


def _majority_sql(labels: list[str]) -> str:
    joins = " ".join(f"LEFT JOIN {m.majority(c)} l_{c} USING (cluster_id)" for c in labels)
    return f"(SELECT DISTINCT cluster_id FROM members) {joins}"


@query(
    "majority_label",
    f"WITH {m.MEMBERS_CTE} SELECT cluster_id, category, tone, formality, sentiment, intent FROM {_majority_sql(tp.LABELS)}",
)
def majority_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(desk_rows(spark, sf).select("row_id", "desk", *tp.LABELS))
    return lb.majority_labels(pr.encode_labels(rows, "desk", "cluster_id"), "cluster_id", tp.LABELS)


@query(
    "majority_label_documents",
    "SELECT source, lang FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents WHERE lang <> '' GROUP BY 1, 2) "
    "QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, f) = 1",
)
def majority_label_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "source", "lang")
    return lb.majority_labels(docs, "source", ["lang"], order="doc_id")


@query(
    "tone_fallback",
    f"WITH {m.MEMBERS_CTE} SELECT cluster_id, coalesce(tone, formality) AS tone FROM {_majority_sql(['tone', 'formality'])}",
)
def tone_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(desk_rows(spark, sf).select("row_id", "desk", "tone", "formality"))
    found = lb.majority_labels(pr.encode_labels(rows, "desk", "cluster_id"), "cluster_id", ["tone", "formality"])
    return found.select("cluster_id", F.coalesce("tone", "formality").alias("tone"))


# --- templates ------------------------------------------------------------------------

@query(
    "representative",
    f"WITH {m.MEMBERS_CTE} SELECT cluster_id, row_id, round(sim, 6) AS similarity FROM reps",
)
def representative(spark: SparkSession, sf: str) -> DataFrame:
    members = desk_members(spark, sf)
    best = tp.representatives(members, cut_lineage(cl.centroids(members)))
    return best.select("cluster_id", "row_id", F.round("similarity", 6).alias("similarity"))


@query(
    "representative_vectors",
    f"WITH {_CENTERS}, own AS (SELECT row_id, cluster_id, round(sum(x * c), 9) AS sim FROM long JOIN centers USING (cluster_id, position) GROUP BY ALL) "
    "SELECT cluster_id, row_id, round(sim, 6) AS similarity FROM own QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY sim DESC, row_id) = 1",
)
def representative_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    best = tp.representatives(rows, cut_lineage(cl.centroids(rows)))
    return best.select("cluster_id", "row_id", F.round("similarity", 6).alias("similarity"))


@query("templates_by_category", f"WITH {m.BUILT_CTE} {m.template_rows('built')}")
def templates_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """One template per group of mails, before de-duplication."""

    return shown(tp.ranked(built_templates(spark, sf)))


@query("templates_ranked", f"WITH {m.BUILT_CTE} SELECT row_number() OVER (ORDER BY cluster_size DESC, cluster_id) AS place, cluster_id, cluster_size FROM built")
def templates_ranked(spark: SparkSession, sf: str) -> DataFrame:
    key = F.struct((-F.col("cluster_size")).alias("a"), F.col("cluster_id").alias("b")).alias("key")
    places = number_in_order(built_templates(spark, sf).select(key), "key", "at")
    return places.select(
        (F.col("at") + 1).cast("bigint").alias("place"),
        F.col("key.b").alias("cluster_id"),
        (-F.col("key.a")).alias("cluster_size"),
    )


@query("templates_capped", f"WITH {m.BUILT_CTE} SELECT cluster_id, cluster_size FROM built ORDER BY cluster_size DESC, cluster_id LIMIT 50")
def templates_capped(spark: SparkSession, sf: str) -> DataFrame:
    return tp.capped(built_templates(spark, sf)).select("cluster_id", "cluster_size")


@query(
    "near_dup_greedy",
    f"WITH RECURSIVE {m.DEDUPED_CTE} SELECT cluster_id, cluster_size, template_id FROM built JOIN kept USING (cluster_id)",
)
def near_dup_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return tp.deduplicated(built_templates(spark, sf)).select("cluster_id", "cluster_size", "template_id")


@query(
    "near_dup_documents",
    f"WITH RECURSIVE {m.bag_cte('bag', 'documents', 'doc_id', 'text')}, {m.greedy_cte('bag', 'doc_id', 'n_chars DESC, doc_id', 'documents')} "
    "SELECT doc_id FROM kept",
)
def near_dup_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents kept by the greedy rule, longest first."""

    docs = read(spark, sf, "documents", "doc_id", "n_chars", "text")
    items = cut_lineage(en.HashedEncoder().encode(docs, "text").select("doc_id", "n_chars", "embedding"))
    return greedy_keep(items, id_col="doc_id", priority_col="n_chars", vec_col="embedding")


@query("generate_templates", f"WITH RECURSIVE {m.DEDUPED_CTE} {m.template_rows('mined')}")
def generate_templates(spark: SparkSession, sf: str) -> DataFrame:
    return shown(mined_templates(spark, sf))


@query(
    "template_search",
    f"WITH RECURSIVE {m.DEDUPED_CTE} SELECT template_id, cluster_id FROM mined WHERE tone = 'formal' AND contains(lower(concat_ws(' ', "
    "subject_template, body_template, intent, category, tone, sentiment)), 'please')",
)
def template_search(spark: SparkSession, sf: str) -> DataFrame:
    return tp.search(mined_templates(spark, sf), tone="formal", text=" Please ").select("template_id", "cluster_id")


@query(
    "template_lookup",
    f"WITH RECURSIVE {m.DEDUPED_CTE} {m.template_rows('mined')} WHERE template_id = (SELECT min(template_id) FROM mined)",
)
def template_lookup(spark: SparkSession, sf: str) -> DataFrame:
    mined = mined_templates(spark, sf)
    wanted = mined.agg(F.min("template_id")).first()[0]
    return shown(tp.lookup(mined, wanted))


@query(
    "template_facets",
    f"WITH RECURSIVE {m.DEDUPED_CTE} SELECT DISTINCT 'category' AS facet, category AS value FROM mined WHERE category <> '' "
    "UNION ALL SELECT DISTINCT 'tone', tone FROM mined WHERE tone <> ''",
)
def template_facets(spark: SparkSession, sf: str) -> DataFrame:
    return tp.facets(mined_templates(spark, sf))


@query(
    "templates_list",
    f"WITH RECURSIVE {m.DEDUPED_CTE} SELECT (SELECT count(*) FROM mined) AS count, * EXCLUDE (common_phrases) FROM ({m.template_rows('mined')})",
)
def templates_list(spark: SparkSession, sf: str) -> DataFrame:
    return tp.listing(shown(mined_templates(spark, sf)))


@query(
    "exact_dups",
    "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))",
)
def exact_dups(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text")
    return me.exact_duplicates(docs, "doc_id", "text")


# --- report ------------------------------------------------------------------------------

@query(
    "template_coverage",
    f"WITH RECURSIVE {m.DEDUPED_CTE} SELECT round((SELECT sum(cluster_size) FROM mined) / (SELECT count(*) FROM members), 6) AS template_coverage",
)
def template_coverage(spark: SparkSession, sf: str) -> DataFrame:
    members = desk_members(spark, sf)
    covered = tp.generate_templates(members).agg(F.sum("cluster_size")).first()[0]
    total = members.agg(F.count("*").alias("n"))
    return total.select(F.round(me.coverage(F.lit(covered), F.col("n")), 6).alias("template_coverage"))


_BUILT_SCORES = {
    "duplicate_pct": ("duplicate_template_percentage", rf"(count(*) - count(DISTINCT lower({d.strip('body_template')}))) / count(*)"),
    "avg_length": ("average_template_length", "avg(length(body_template))"),
}


def _score_query(name: str, column: str, sql: str) -> None:
    @query(name, f"WITH {m.BUILT_CTE} SELECT round({sql}, 6) AS {column} FROM built")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return me.template_scores(built_templates(spark, sf)).select(F.round(column, 6).alias(column))


def _readable(column: str = "body_template") -> str:
    from mailmine.catalog.text_queries import READABILITY_SQL

    return READABILITY_SQL


_BUILT_SCORES["avg_readability"] = ("average_readability", f"avg({_readable()})")
for _name, (_column, _sql) in _BUILT_SCORES.items():
    _score_query(_name, _column, _sql)


@query(
    "avg_length_documents",
    "SELECT source, round(avg(length(text)), 6) AS average_length FROM documents GROUP BY source",
)
def avg_length_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "source", "text")
    return docs.groupBy("source").agg(F.round(F.avg(F.length("text")), 6).alias("average_length"))


@query("cluster_size_map", f"WITH {m.MEMBERS_CTE} SELECT CAST(cluster_id AS VARCHAR) AS cluster, size FROM sizes")
def cluster_size_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(desk_rows(spark, sf).select("row_id", "desk"))
    sizes = cl.cluster_sizes(pr.encode_labels(rows, "desk", "cluster_id"))
    return me.size_map(sizes).select(F.explode("cluster_sizes").alias("cluster", "size"))


@query(
    "improvement",
    "SELECT source, round(avg(quality) - avg(CASE WHEN toxic = 1 THEN quality END), 6) AS improvement FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
)
def improvement(spark: SparkSession, sf: str) -> DataFrame:
    """Difference of two scores per source; null where one of them is missing."""

    docs = read(spark, sf, "documents", "doc_id", "source").join(read(spark, sf, "labels"), "doc_id", "left")
    scores = docs.groupBy("source").agg(
        F.avg("quality").alias("after"), F.avg(F.when(F.col("toxic") == 1, F.col("quality"))).alias("before")
    )
    return scores.select("source", F.round(me.improvement(F.col("before"), F.col("after")), 6).alias("improvement"))


_REPORT_SQL = f"""WITH RECURSIVE {m.DEDUPED_CTE}, unit AS (SELECT row_id, cluster_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS w
  FROM bag JOIN members USING (row_id)
), umeans AS MATERIALIZED (SELECT cluster_id, bucket, sum(w) / any_value(size) AS m FROM unit JOIN sizes USING (cluster_id) GROUP BY 1, 2
), dots AS (SELECT u.row_id, u.cluster_id AS own, s.cluster_id AS other, any_value(s.size) AS size, sum(u.w * coalesce(c.m, 0)) AS dot
  FROM unit u JOIN sizes s ON true LEFT JOIN umeans c ON c.cluster_id = s.cluster_id AND c.bucket = u.bucket GROUP BY 1, 2, 3
), ab AS (SELECT row_id, max(CASE WHEN own = other THEN (size - size * dot) / nullif(size - 1, 0) END) AS a,
    min(CASE WHEN own <> other THEN 1 - dot END) AS b FROM dots GROUP BY 1
), sil AS (SELECT avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette_score FROM ab
), norms AS (SELECT row_id, sum(w * w) AS n2 FROM bag GROUP BY 1
), mnorms AS (SELECT cluster_id, sum(m * m) AS n2 FROM means GROUP BY 1
), inner_dots AS (SELECT row_id, members.cluster_id, sum(w * m) AS dot FROM bag JOIN members USING (row_id) JOIN means USING (cluster_id, bucket) GROUP BY ALL
), spread AS (SELECT cluster_id, avg(sqrt(greatest(0, norms.n2 - 2 * dot + mnorms.n2))) AS s FROM inner_dots JOIN norms USING (row_id) JOIN mnorms USING (cluster_id) GROUP BY 1
), cross_dots AS (SELECT a.cluster_id AS i, b.cluster_id AS j, sum(a.m * b.m) AS dot FROM means a JOIN means b USING (bucket) WHERE a.cluster_id <> b.cluster_id GROUP BY ALL
), worst AS (SELECT i, max((p.s + q.s) / sqrt(x.n2 + y.n2 - 2 * dot)) AS r FROM cross_dots JOIN spread p ON p.cluster_id = i JOIN spread q ON q.cluster_id = j
    JOIN mnorms x ON x.cluster_id = i JOIN mnorms y ON y.cluster_id = j GROUP BY 1
), selves AS (SELECT cluster_id, sum(n2) AS total FROM norms JOIN members USING (row_id) GROUP BY 1
), intra AS (SELECT avg((size * size * mnorms.n2 - total) / (size * (size - 1))) AS v FROM sizes JOIN mnorms USING (cluster_id) JOIN selves USING (cluster_id) WHERE size >= 2
), tscores AS (SELECT count(*) AS n_templates, sum(cluster_size) AS covered, CASE WHEN count(*) > 1 THEN (count(*) - count(DISTINCT lower({d.strip('body_template')}))) / count(*) ELSE 0 END AS dup,
    avg(length(body_template)) AS len, avg({_readable()}) AS readable FROM mined)
SELECT (SELECT count(*) FROM members) AS n_emails, (SELECT count(*) FROM sizes) AS n_clusters, n_templates,
  round(silhouette_score, 6) AS silhouette_score, round((SELECT avg(r) FROM worst), 6) AS davies_bouldin_score,
  round(intra.v, 6) AS average_intra_cluster_similarity,
  (SELECT array_to_string(list(cluster_id || '=' || size ORDER BY cluster_id), ',') FROM sizes) AS cluster_sizes,
  round(covered / (SELECT count(*) FROM members), 6) AS template_coverage, round(dup, 6) AS duplicate_template_percentage,
  round(len, 6) AS average_template_length, round(readable, 6) AS average_readability,
  CAST(0.4 AS DOUBLE) AS baseline_silhouette, CAST(0.5 AS DOUBLE) AS fine_tuned_silhouette, round(CAST(0.5 AS DOUBLE) - CAST(0.4 AS DOUBLE), 6) AS fine_tuning_improvement
FROM tscores, sil, intra"""


@query("evaluation_report", _REPORT_SQL)
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    members = desk_members(spark, sf)
    templates = cut_lineage(tp.generate_templates(members))
    report = me.evaluation_report(members, templates, baseline=0.4, tuned=0.5)
    listed = F.array_sort(
        F.transform(F.map_entries("cluster_sizes"), lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"].alias("v")))
    )
    text = F.array_join(F.transform(listed, lambda e: F.concat_ws("=", e["k"], e["v"])), ",")
    rounded = [c for c, kind in report.dtypes if kind == "double"]
    return report.withColumns({"cluster_sizes": text, **{c: F.round(c, 6) for c in rounded}})


@query(
    "run_status",
    f"WITH RECURSIVE {m.DEDUPED_CTE} SELECT (SELECT count(*) FROM members) AS n_emails_loaded, (SELECT count(*) FROM mined) AS n_templates, "
    "CAST(0 AS INTEGER) AS fine_tuned_loaded",
)
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    members = desk_members(spark, sf)
    status = me.run_status(members, tp.generate_templates(members), en.resolve_encoder(spark, scratch_path(spark, "no-encoder")).fitted)
    return status.withColumn("fine_tuned_loaded", F.col("fine_tuned_loaded").cast("int"))


# --- matching ------------------------------------------------------------------------------

_MATCH_CTE = (
    f"WITH RECURSIVE {m.DEDUPED_CTE}, asked AS (SELECT row_id, coalesce(subject, '') || chr(10) || chr(10) || body AS raw, CASE WHEN {d.strip('subject')} <> '' "
    f"THEN {d.strip('subject')} || chr(10) || chr(10) || {d.strip('body')} ELSE {d.strip('body')} END AS text FROM cleaned), "
    "targets AS (SELECT cluster_id, subject_template || chr(10) || chr(10) || body_template AS text FROM mined), "
    + m.bag_cte("qbag", "asked", "row_id", "text") + ", " + m.bag_cte("gbag", "targets", "cluster_id", "text") + ", "
    + m.sims_cte("sims", "qbag", "row_id", "gbag", "cluster_id")
    + ", best AS (SELECT lid AS row_id, rid AS cluster_id, sim, CAST(row_number() OVER (PARTITION BY lid ORDER BY sim DESC, rid) AS INTEGER) AS rank "
    "FROM sims QUALIFY rank <= 3) "
)


def _match_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mails(spark, sf), mt.encode_templates(mined_templates(spark, sf))


@query("match_topk", _MATCH_CTE + "SELECT row_id, cluster_id, round(sim, 6) AS similarity, rank FROM best")
def match_topk(spark: SparkSession, sf: str) -> DataFrame:
    asked, targets = _match_inputs(spark, sf)
    out = mt.match(asked, targets, top_k=3)
    return out.select("row_id", "cluster_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    "match_annotated",
    _MATCH_CTE + f"SELECT row_id, cluster_id, round(sim, 6) AS similarity, rank, {d.sentiment('lower(raw)')} AS detected_sentiment, "
    f"{d.tone('lower(raw)')} AS detected_tone FROM best JOIN asked USING (row_id) WHERE rank <= 1",
)
def match_annotated(spark: SparkSession, sf: str) -> DataFrame:
    asked, targets = _match_inputs(spark, sf)
    out = mt.match_annotated(asked, targets, top_k=1)
    return out.withColumn("similarity", F.round("similarity", 6))


# --- training pairs ------------------------------------------------------------------------

@query(
    "training_pairs",
    f"WITH {m.MEMBERS_CTE}, drawn AS (SELECT cluster_id AS label_id, row_id, row_number() OVER (PARTITION BY cluster_id ORDER BY md5('13:' || row_id), row_id) "
    "AS place FROM members), paired AS (SELECT a.label_id, a.row_id AS anchor_id, b.row_id AS positive_id FROM drawn a JOIN drawn b "
    "ON a.label_id = b.label_id AND b.place = a.place + 1 WHERE a.place % 2 = 1) SELECT p.*, x.combined_text AS anchor, y.combined_text AS positive "
    "FROM paired p JOIN members x ON x.row_id = anchor_id JOIN members y ON y.row_id = positive_id",
)
def training_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(desk_rows(spark, sf).select("row_id", "combined_text", "desk"))
    return pr.require_pairs(pr.training_pairs(cut_lineage(pr.encode_labels(rows, "desk"))))
