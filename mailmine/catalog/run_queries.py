"""Clustering, training, source, sink and streaming queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailmine.catalog import duck as d
from mailmine.catalog import duck_mining as m
from mailmine.catalog import mining_queries as mq
from mailmine.catalog.registry import query
from mailmine.catalog.tables import mails, raw_mails, read
from mailmine.functions import lexicon as lx
from mailmine.operators import cluster as cl
from mailmine.operators import encode as en
from mailmine.operators import pairs as pr
from mailmine.operators import templates as tp
from mailmine.operators.components import number_in_order
from mailmine.operators.prepare import add_texts
from mailmine.plans import mining, runs, training
from mailmine.session import cut_lineage, scratch_path
from mailmine.sources import landing, sinks
from mailmine.sources.mails import load_csv
from mailmine.streaming import mails as st

# --- clustering -----------------------------------------------------------------------


@query("kmeans_assign")
def kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    rows = mq.vectors(spark, sf).select("row_id", "embedding")
    return cl.cluster(rows, "kmeans")


@query("agglomerative")
def agglomerative(spark: SparkSession, sf: str) -> DataFrame:
    rows = mq.vectors(spark, sf).select("row_id", "embedding")
    return cl.cluster(rows, "agglomerative")


_DBSCAN_SQL = f"""WITH RECURSIVE {m.bag_cte('bag', 'documents', 'doc_id', 'text')}, near AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM bag a JOIN bag b USING (bucket) GROUP BY 1, 2
  HAVING round(sum(a.w * b.w), 9) >= 1 - {{eps}} - 1e-12
), core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= {lx.DBSCAN_MIN_SAMPLES}
), links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)
), reach AS (SELECT id, id AS low FROM core UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.id
), comp AS (SELECT id, min(low) AS low FROM reach GROUP BY 1
), numbered AS (SELECT low, CAST(dense_rank() OVER (ORDER BY low) - 1 AS BIGINT) AS cluster_id FROM (SELECT DISTINCT low FROM comp)
), border AS (SELECT n.a AS id, min(c.low) AS low FROM near n JOIN comp c ON c.id = n.b WHERE n.a NOT IN (FROM core) GROUP BY 1
), found AS (SELECT * FROM comp UNION ALL SELECT * FROM border)
SELECT doc_id AS row_id, coalesce(cluster_id, -1) AS cluster_id FROM documents LEFT JOIN found ON id = doc_id LEFT JOIN numbered USING (low)"""


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(mq.document_vectors(spark, sf).withColumnRenamed("doc_id", "row_id"))


@query("dbscan", _DBSCAN_SQL.format(eps=lx.DBSCAN_EPS))
def dbscan(spark: SparkSession, sf: str) -> DataFrame:
    return cl.dbscan(_documents(spark, sf))


@query("dbscan_tight", _DBSCAN_SQL.format(eps=0.04))
def dbscan_tight(spark: SparkSession, sf: str) -> DataFrame:
    """A smaller radius: several clusters, borders and noise."""

    return cl.dbscan(_documents(spark, sf), eps=0.04)


@query("dbscan_mails")
def dbscan_mails(spark: SparkSession, sf: str) -> DataFrame:
    rows = add_texts(mails(spark, sf)).select("row_id", "combined_text")
    return cl.dbscan(cut_lineage(en.HashedEncoder().encode(rows, "combined_text")))


# --- training ---------------------------------------------------------------------------

@query("pseudo_labels")
def pseudo_labels(spark: SparkSession, sf: str) -> DataFrame:
    return pr.pseudo_labels(_documents(spark, sf))


def _mail_texts(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(add_texts(mails(spark, sf)).select("row_id", "category", "combined_text"))


@query("encoder_comparison")
def encoder_comparison(spark: SparkSession, sf: str) -> DataFrame:
    rows = _mail_texts(spark, sf)
    return training.compare_encoders(rows, training.fit_encoder(rows, "tfidf"))


@query(
    "encoder_fit",
    f"""WITH {d.TEXTS_CTE} SELECT row_id, CAST({lx.EMBED_DIM} AS INTEGER) AS n_dims,
  CASE WHEN trim(combined_text) = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS norm FROM texts""",
)
def encoder_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on the mails and their training pairs, save, load again and encode: every row keeps a vector of unit length."""

    rows = _mail_texts(spark, sf)
    path = scratch_path(spark, "encoder")
    training.fit_encoder(rows, "cooccurrence", path=path, pairs=cut_lineage(training.training_set(rows)))
    found = en.resolve_encoder(spark, path).encode(rows, "combined_text").select("row_id", "embedding")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return found.select("row_id", F.size("embedding").alias("n_dims"), F.round(norm, 4).alias("norm"))


@query("encoder_fit_word2vec")
def encoder_fit_word2vec(spark: SparkSession, sf: str) -> DataFrame:
    """Word vectors of Spark ML: fit on the mails, save, load again and encode."""

    rows = _mail_texts(spark, sf)
    path = scratch_path(spark, "encoder")
    training.fit_encoder(rows, "word2vec", path=path)
    encoder = en.resolve_encoder(spark, path)
    return encoder.encode(rows, "combined_text").select("row_id", "embedding")


@query("mine_mails")
def mine_mails(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run with its default settings."""

    return mq.shown(mining.mine(mails(spark, sf)).templates)


@query("mine_documents")
def mine_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns of the document table by density clustering."""

    docs = read(spark, sf, "documents", "doc_id", "source", "text").select(
        F.col("doc_id").alias("row_id"), F.col("doc_id").cast("string").alias("email_id"), F.lit("").alias("subject"),
        F.col("text").alias("body"), F.col("source").alias("category"),
        F.lit(None).cast("string").alias("sentiment"), F.lit(None).cast("string").alias("tone"),
    )
    return mq.shown(mining.mine(docs, mining.MiningParams(method="dbscan")).templates)


@query("run_reload", f"WITH RECURSIVE {m.DEDUPED_CTE} SELECT *, (SELECT count(*) FROM members) AS n_emails, 2::BIGINT AS runs FROM ({m.template_rows('mined')})")
def run_reload(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs are stored, a third is broken off; the latest finished one is read back."""

    folder = scratch_path(spark, "runs")
    members = mq.desk_members(spark, sf)
    report = members.agg(F.count("*").alias("n_emails"))
    mined = cut_lineage(tp.generate_templates(members))
    placed = members.select("row_id", "cluster_id")
    mining.MiningRun("first", placed, mined.limit(1), report).save(folder)
    mining.MiningRun("second", placed, mined, report).save(folder)
    runs.write_tables(folder, "third", {"templates": mined.limit(2), "evaluation": report})
    run = mining.load_run(spark, folder)
    assert run.run_id == "second"
    n_emails = run.evaluation.first()["n_emails"]
    return mq.shown(run.templates).withColumns({"n_emails": F.lit(n_emails), "runs": F.lit(runs.list_runs(spark, folder).count()).cast("bigint")})


# --- facts about results that SQL can not repeat ---------------------------------------------

def _side_by_side(*rows: DataFrame) -> DataFrame:
    """Tables of one row each as one row; they meet on a constant key."""

    return reduce(lambda x, y: x.join(y, "__one"), [r.withColumn("__one", F.lit(1)) for r in rows]).drop("__one")


def _grouping_facts(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: rows, groups, vectors whose copies are in two groups, and groups not numbered by their smallest row."""

    rows, groups = cut_lineage(rows.select("row_id", "embedding")), cut_lineage(groups)
    placed = rows.join(groups, "row_id")
    split = placed.groupBy("embedding").agg(F.min("cluster_id").alias("low"), F.max("cluster_id").alias("high"))
    split = split.agg(F.count_if(F.col("low") != F.col("high")).alias("split_copies"))
    first = placed.where("cluster_id >= 0").groupBy("cluster_id").agg(F.min("row_id").alias("first_row"))
    expected = number_in_order(first, "first_row", "place")
    named = first.join(expected, "first_row").agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("cluster_id") != F.col("place")).alias("misnumbered"))
    return _side_by_side(placed.agg(F.count("*").alias("n_rows"), F.count_distinct("row_id").alias("n_ids")), named, split)


def _grouping_sql(table: str) -> str:
    low, high = cl.BOUNDS
    k = f"greatest(2, least(least({high}, greatest({low}, round_even(sqrt(greatest(count(*), 4) / 2), 0))), greatest(2, count(*) - 1)))"
    return (f"SELECT count(*) AS n_rows, count(*) AS n_ids, {k}::BIGINT AS n_groups, 0::BIGINT AS misnumbered, "
            f"0::BIGINT AS split_copies FROM {table}")


@query("kmeans_facts", _grouping_sql("embeddings"))
def kmeans_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector has one group, copies share it, and there are as many groups as asked for."""

    rows = mq.vectors(spark, sf)
    return _grouping_facts(rows, cl.cluster(rows.select("row_id", "embedding"), "kmeans"))


@query("agglomerative_facts", _grouping_sql("embeddings"))
def agglomerative_facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = mq.vectors(spark, sf)
    return _grouping_facts(rows, cl.cluster(rows.select("row_id", "embedding"), "agglomerative"))


@query("pseudo_label_facts", _grouping_sql("documents"))
def pseudo_label_facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _documents(spark, sf)
    return _grouping_facts(rows, pr.pseudo_labels(rows))


_TFIDF_DIM = 256


@query(
    "encode_tfidf_facts",
    f"""WITH {d.TEXTS_CTE} SELECT row_id, CAST({_TFIDF_DIM} AS INTEGER) AS n_dims,
  CASE WHEN trim(combined_text) = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS norm FROM texts""",
)
def encode_tfidf_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Every row keeps a vector of unit length; a blank text the zero vector."""

    rows = _mail_texts(spark, sf)
    found = en.fit_tfidf(rows, "combined_text", _TFIDF_DIM).encode(rows, "combined_text")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return found.select("row_id", F.size("embedding").alias("n_dims"), F.round(norm, 4).alias("norm"))


@query("mine_mails_facts", f"""WITH {d.TEXTS_CTE} SELECT count(*) AS n_mails, 0::BIGINT AS wrong_sizes,
  0::BIGINT AS strange_representatives, 0::BIGINT AS equal_bodies, true AS reported FROM texts""")
def mine_mails_facts(spark: SparkSession, sf: str) -> DataFrame:
    """A whole run: all mails are members, a template has its cluster's size and one of its mails, none is there twice."""

    run = mining.mine(mails(spark, sf))
    members = cut_lineage(run.members.select("email_id", "cluster_id"))
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    held = members.select("cluster_id", F.col("email_id").alias("representative_email_id")).distinct()
    wrong = run.templates.join(sizes, "cluster_id", "left").agg(
        F.count_if(~F.col("cluster_size").eqNullSafe(F.col("size"))).alias("wrong_sizes"),
        (F.count("*") - F.count_distinct("body_template")).alias("equal_bodies"), F.count("*").alias("n"))
    strange = run.templates.join(held, ["cluster_id", "representative_email_id"], "left_anti")
    strange = strange.agg(F.count("*").alias("strange_representatives"))
    facts = _side_by_side(members.agg(F.count("*").alias("n_mails")), wrong, strange, run.evaluation.select("n_emails", "n_templates"))
    reported = (F.col("n_templates") == F.col("n")) & (F.col("n_emails") == F.col("n_mails"))
    return facts.select("n_mails", "wrong_sizes", "strange_representatives", "equal_bodies", reported.alias("reported"))


# --- sources and sinks ---------------------------------------------------------------------

def _written_csv(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "mails_csv")
    sinks.write_csv(raw_mails(spark, sf).select("row_id", "email_id", "subject", "body", "category"), path)
    return path


@query("csv_scan", f"WITH {d.CLEANED_CTE} SELECT row_id, email_id, subject, body, category FROM cleaned")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    loaded = load_csv(spark, _written_csv(spark, sf))
    return loaded.select(F.col("row_id").cast("bigint").alias("row_id"), "email_id", "subject", "body", "category")


_DELIVERED = (
    f"WITH {d.CLEANED_CTE} SELECT 'mails' AS delivery, {d.lit(','.join(lx.REQUIRED_COLUMNS + lx.OPTIONAL_COLUMNS))} AS columns, CAST(NULL AS VARCHAR) AS error, count(*) AS rows FROM cleaned "
    "UNION ALL SELECT 'documents', NULL, 'unreadable: ' || "
    + d.lit("columns email_id, subject, body are not there, only doc_id, lang")
    + f", NULL UNION ALL SELECT 'notes', NULL, {d.lit(landing.NOT_CSV)}, NULL"
)


@query("landing_report", _DELIVERED)
def landing_report(spark: SparkSession, sf: str) -> DataFrame:
    """Report on delivered files: mails with all columns, documents without a body, a text file."""

    folder = scratch_path(spark, "landing")
    sinks.write_csv(raw_mails(spark, sf).select("email_id", "subject", "body"), f"{folder}/mails")
    sinks.write_csv(read(spark, sf, "documents", "doc_id", "lang"), f"{folder}/documents")
    read(spark, sf, "benchmark", "text").write.text(f"{folder}/notes")
    report = landing.landing_report(spark, folder)
    kind = F.regexp_extract("file", r"/(mails|documents|notes)/", 1).alias("delivery")
    by_delivery = report.select(kind, "rows", F.array_join("columns", ",").alias("columns"), "error")
    return by_delivery.groupBy("delivery", "columns", "error").agg(F.sum("rows").alias("rows"))


@query("templates_markdown", f"""WITH {m.BUILT_CTE} SELECT cluster_id, '## ' || template_id || chr(10) || '- cluster_id=' || cluster_id ||
  ' | cluster_size=' || cluster_size || coalesce(' | category=' || nullif(category, ''), '') || coalesce(' | tone=' || nullif(tone, ''), '') ||
  coalesce(' | sentiment=' || nullif(sentiment, ''), '') || coalesce(' | intent=' || nullif(intent, ''), '') || chr(10) || chr(10) ||
  '**Subject:** ' || subject_template || chr(10) || chr(10) || '**Body:**' || chr(10) || chr(10) || '```' || chr(10) || body_template || chr(10) || '```' ||
  chr(10) || chr(10) || '**Placeholders:** ' || array_to_string(list_transform(placeholders, lambda p: '`{{' || p || '}}`'), ', ') ||
  CASE WHEN len(common_phrases) > 0 THEN chr(10) || chr(10) || '**Common phrases:** ' || array_to_string(common_phrases, ', ') ELSE '' END ||
  chr(10) || chr(10) || '---' || chr(10) AS block FROM built""".replace("{{", "{").replace("}}", "}"))
def templates_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.markdown_blocks(mq.built_templates(spark, sf)).select("cluster_id", "block")


def _round_trip(spark: SparkSession, sf: str) -> DataFrame:
    mined = mq.mined_templates(spark, sf)
    path = sinks.export(mined, "json", scratch_path(spark, "templates"))
    return sinks.read_written_json(spark, path, mined.schema)


@query("templates_json", f"WITH RECURSIVE {m.DEDUPED_CTE} {m.template_rows('mined')}")
def templates_json(spark: SparkSession, sf: str) -> DataFrame:
    """Templates written as one JSON array and read back."""

    return mq.shown(_round_trip(spark, sf))


# --- streaming -----------------------------------------------------------------------------

@query("stream_landing", f"WITH {d.CLEANED_CTE} SELECT row_id, email_id, subject, body FROM cleaned")
def stream_landing(spark: SparkSession, sf: str) -> DataFrame:
    """The mail files read as a stream; equal to the batch scan."""

    folder, out = _written_csv(spark, sf), scratch_path(spark, "landed")
    schema = "row_id bigint, email_id string, subject string, body string, category string"
    arriving = st.landing_stream(spark, folder, schema)
    st.write_stream(arriving, out, scratch_path(spark, "landing_state")).awaitTermination()
    return spark.read.parquet(out).select("row_id", "email_id", "subject", "body")


def _mail_stream(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "mails")
    stored = add_texts(mails(spark, sf)).select("row_id", "subject", "body", "clean_body")
    stored.write.parquet(path)
    return spark.readStream.schema(stored.schema).parquet(path)


@query("stream_match", mq._MATCH_CTE + "SELECT row_id, cluster_id, round(sim, 6) AS similarity, rank FROM best")
def stream_match(spark: SparkSession, sf: str) -> DataFrame:
    """The mails matched as a stream; equal to the batch match."""

    out = scratch_path(spark, "matched")
    matched = st.match_stream(_mail_stream(spark, sf), mq.mined_templates(spark, sf), out, scratch_path(spark, "match_state"), top_k=3)
    matched.awaitTermination()
    found = spark.read.parquet(out)
    return found.select("row_id", "cluster_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    "stream_encode",
    f"WITH {d.TEXTS_CTE} SELECT sha256('hashed-64' || chr(31) || clean_body) AS content_key, 1::BIGINT AS vectors FROM texts GROUP BY 1",
)
def stream_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Contents encoded by the stream, and how often each was encoded."""

    cache = scratch_path(spark, "vectors")
    run = st.encode_stream(_mail_stream(spark, sf), cache, scratch_path(spark, "encode_state"), en.HashedEncoder(), "clean_body")
    run.awaitTermination()
    stored = spark.read.parquet(cache)
    return stored.groupBy("content_key").agg(F.count("*").alias("vectors"))
