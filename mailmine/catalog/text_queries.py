"""Cleaning, features, sentiment and placeholder queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailmine.catalog import duck as d
from mailmine.catalog.registry import query
from mailmine.catalog.tables import mails, prepared_mails, raw_mails, read
from mailmine.functions import lexicon as lx
from mailmine.functions import placeholders as ph
from mailmine.functions import text as t
from mailmine.functions import tone as tn
from mailmine.operators.prepare import add_features, add_texts
from mailmine.sources.mails import add_optional_columns, clean_rows, normalize_columns


def _list(col: str):
    return F.array_join(F.col(col), ",")


# --- rows ------------------------------------------------------------------------

@query("norm_columns", "SELECT doc_id, lang AS document_lang, source AS document_source FROM documents")
def norm_columns(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "lang", "source")
    return normalize_columns(docs.toDF(" Doc ID", "Document-Lang ", "DOCUMENT source"))


@query("clean_rows", f"WITH {d.CLEANED_CTE} SELECT row_id, email_id, subject, body FROM cleaned")
def q_clean_rows(spark: SparkSession, sf: str) -> DataFrame:
    return mails(spark, sf).select("row_id", "email_id", "subject", "body")


@query(
    "clean_rows_documents",
    f"SELECT doc_id, lang, '' AS subject, {d.strip('text')} AS body FROM documents "
    f"WHERE text IS NOT NULL AND length({d.strip('text')}) > 0",
)
def clean_rows_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "lang", "text")
    rows = docs.withColumnRenamed("text", "body").withColumn("email_id", F.col("doc_id"))
    return clean_rows(rows).select("doc_id", "lang", "subject", "body")


@query(
    "optional_backfill",
    "SELECT conv_id AS email_id, turn, text AS body, "
    + ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in lx.OPTIONAL_COLUMNS)
    + " FROM conversations",
)
def optional_backfill(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations", "conv_id", "turn", "text")
    rows = rows.withColumnsRenamed({"conv_id": "email_id", "text": "body"})
    return add_optional_columns(rows)


# --- cleaning ----------------------------------------------------------------------

@query(
    "ws_normalize",
    f"WITH {d.MAILS_CTE} SELECT 'mail' AS kind, row_id, {d.ws('body')} AS text FROM mails WHERE body IS NOT NULL "
    f"UNION ALL SELECT 'document', doc_id, {d.ws('text')} FROM documents "
    f"UNION ALL SELECT 'page', page_id, {d.ws('html')} FROM pages",
)
def ws_normalize(spark: SparkSession, sf: str) -> DataFrame:
    mail = raw_mails(spark, sf).where("body IS NOT NULL").selectExpr("'mail' AS kind", "row_id", "body AS text")
    docs = read(spark, sf, "documents").selectExpr("'document' AS kind", "doc_id AS row_id", "text")
    page = read(spark, sf, "pages").selectExpr("'page' AS kind", "page_id AS row_id", "html AS text")
    texts = mail.union(docs).union(page)
    return texts.withColumn("text", t.normalize_whitespace(F.col("text")))


@query("quoted_removed", f"WITH {d.CLEANED_CTE} SELECT row_id, {d.no_quotes(d.ws('body'))} AS text FROM cleaned")
def quoted_removed(spark: SparkSession, sf: str) -> DataFrame:
    return mails(spark, sf).select(
        "row_id", t.remove_quoted_replies(t.normalize_whitespace(F.col("body"))).alias("text")
    )


@query("signature_removed", f"WITH {d.CLEANED_CTE} SELECT row_id, {d.no_signature('body')} AS text FROM cleaned")
def signature_removed(spark: SparkSession, sf: str) -> DataFrame:
    return mails(spark, sf).select("row_id", t.remove_signatures(F.col("body")).alias("text"))


@query(
    "tracking_removed",
    f"WITH {d.MAILS_CTE} SELECT 'mail' AS kind, row_id, {d.no_tracking('body')} AS text FROM mails WHERE body IS NOT NULL "
    f"UNION ALL SELECT 'page', page_id, {d.no_tracking('url')} FROM pages",
)
def tracking_removed(spark: SparkSession, sf: str) -> DataFrame:
    mail = raw_mails(spark, sf).where("body IS NOT NULL").selectExpr("'mail' AS kind", "row_id", "body AS text")
    page = read(spark, sf, "pages").selectExpr("'page' AS kind", "page_id AS row_id", "url AS text")
    return mail.union(page).withColumn("text", t.remove_tracking_text(F.col("text")))


@query("clean_body", f"WITH {d.TEXTS_CTE} SELECT row_id, clean_body FROM texts")
def clean_body(spark: SparkSession, sf: str) -> DataFrame:
    return mails(spark, sf).select("row_id", t.clean_body(F.col("body")).alias("clean_body"))


@query("combined_text", f"WITH {d.TEXTS_CTE} SELECT row_id, combined_text FROM texts")
def combined_text(spark: SparkSession, sf: str) -> DataFrame:
    return add_texts(mails(spark, sf)).select("row_id", "combined_text")


# --- features ------------------------------------------------------------------------

def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return add_texts(mails(spark, sf)).select("row_id", "clean_body", "combined_text")


@query(
    "greeting",
    f"WITH {d.TEXTS_CTE} SELECT row_id, {d.greeting('combined_text')} AS greeting, "
    f"{d.greeting('clean_body')} AS body_greeting FROM texts",
)
def greeting(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select(
        "row_id",
        t.extract_greeting(F.col("combined_text")).alias("greeting"),
        t.extract_greeting(F.col("clean_body")).alias("body_greeting"),
    )


@query("closing", f"WITH {d.TEXTS_CTE} SELECT row_id, {d.closing('combined_text')} AS closing FROM texts")
def closing(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("row_id", t.extract_closing(F.col("combined_text")).alias("closing"))


def _first_replaced(found: str, replacement: str) -> str:
    return (
        f"CASE WHEN {found} = '' THEN clean_body ELSE substr(clean_body, 1, strpos(clean_body, {found}) - 1) || "
        f"{replacement} || substr(clean_body, strpos(clean_body, {found}) + length({found})) END"
    )


@query(
    "greeting_canon",
    f"WITH {d.TEXTS_CTE}, found AS (SELECT row_id, clean_body, {d.greeting('clean_body')} AS g FROM texts) "
    f"SELECT row_id, {_first_replaced('g', d.lit(lx.GREETING_TEXT))} AS text FROM found",
)
def greeting_canon(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("row_id", t.canonical_greeting(F.col("clean_body")).alias("text"))


@query(
    "closing_canon",
    f"WITH {d.TEXTS_CTE}, found AS (SELECT row_id, clean_body, {d.closing('clean_body')} AS c FROM texts) "
    f"SELECT row_id, {_first_replaced('c', d.lit(lx.CLOSING_TEXT))} AS text FROM found",
)
def closing_canon(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("row_id", t.canonical_closing(F.col("clean_body")).alias("text"))


@query(
    "action_words",
    f"WITH {d.TEXTS_CTE} SELECT row_id, {d.actions('lower(combined_text)')} AS action_words FROM texts",
)
def action_words(spark: SparkSession, sf: str) -> DataFrame:
    out = _texts(spark, sf).select("row_id", t.action_words(F.col("combined_text")).alias("action_words"))
    return out.withColumn("action_words", _list("action_words"))


@query("placeholder_slots", f"WITH {d.TEXTS_CTE} SELECT row_id, {d.slots('combined_text')} AS slots FROM texts")
def placeholder_slots(spark: SparkSession, sf: str) -> DataFrame:
    out = _texts(spark, sf).select("row_id", t.placeholder_slots(F.col("combined_text")).alias("slots"))
    return out.withColumn("slots", _list("slots"))


@query("intent", f"WITH {d.TEXTS_CTE} SELECT row_id, {d.intent('lower(combined_text)')} AS intent FROM texts")
def intent(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("row_id", t.intent(F.col("combined_text")).alias("intent"))


@query("formality", f"WITH {d.TEXTS_CTE} SELECT row_id, {d.formality('lower(combined_text)')} AS formality FROM texts")
def formality(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("row_id", t.formality(F.col("combined_text")).alias("formality"))


@query(
    "features",
    f"WITH {d.PREPARED_CTE} SELECT row_id, greeting, closing, intent, formality, "
    f"{d.slots('combined_text')} AS placeholders, {d.actions('low')} AS action_words FROM prepared",
)
def features(spark: SparkSession, sf: str) -> DataFrame:
    out = prepared_mails(spark, sf)
    return out.select(
        "row_id", "features.greeting", "features.closing", "features.intent", "features.formality",
        F.array_join("features.placeholders", ",").alias("placeholders"),
        F.array_join("features.action_words", ",").alias("action_words"),
    )


@query(
    "preprocess",
    f"WITH {d.PREPARED_CTE} SELECT row_id, email_id, clean_subject, clean_body, combined_text, intent, formality, "
    "greeting, closing FROM prepared",
)
def preprocess(spark: SparkSession, sf: str) -> DataFrame:
    return prepared_mails(spark, sf).select(
        "row_id", "email_id", "clean_subject", "clean_body", "combined_text", "intent", "formality",
        "greeting", "closing",
    )


# --- sentiment ------------------------------------------------------------------------

def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return tn.add_sentiment(
        _texts(spark, sf), "combined_text", "found_sentiment", "found_tone", scores="scores"
    )


@query("sentiment", f"WITH {d.PREPARED_CTE} SELECT row_id, found_sentiment FROM prepared")
def sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("row_id", "found_sentiment")


@query("tone", f"WITH {d.PREPARED_CTE} SELECT row_id, found_tone FROM prepared")
def tone(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("row_id", "found_tone")


_SCORE_SETS = {"positive": lx.POSITIVE_WORDS, "negative": lx.NEGATIVE_WORDS, **lx.TONE_MARKERS}


@query(
    "tone_scores",
    f"WITH {d.PREPARED_CTE} SELECT row_id, "
    + ", ".join(f"CAST({d.hits('low', words)} AS DOUBLE) AS {n}" for n, words in _SCORE_SETS.items())
    + " FROM prepared",
)
def tone_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(
        "row_id", *[F.element_at("scores", F.lit(n)).alias(n) for n in _SCORE_SETS]
    )


@query(
    "enrich_labels",
    f"WITH {d.PREPARED_CTE}, gate AS (SELECT count(sentiment) AS ns, count(tone) AS nt FROM prepared) "
    "SELECT row_id, CASE WHEN ns = 0 THEN found_sentiment ELSE sentiment END AS sentiment, "
    "CASE WHEN nt = 0 THEN found_tone ELSE tone END AS tone FROM prepared CROSS JOIN gate",
)
def enrich_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = add_texts(mails(spark, sf)).select("row_id", "combined_text", "sentiment", "tone")
    found = tn.add_sentiment(rows, "combined_text", "found_sentiment", "found_tone")
    filled = tn.fill_if_all_null(found, {"sentiment": "found_sentiment", "tone": "found_tone"})
    return filled.select("row_id", "sentiment", "tone")


def _shouting_scorer():
    """A stand-in for a user's model: exclamation marks decide."""

    import pandas as pd

    def score(texts: "pd.Series") -> "pd.DataFrame":
        marks = texts.str.count("!")
        label = marks.map(lambda n: "POSITIVE" if n else "NEGATIVE")
        return pd.DataFrame({"label": label, "score": 1.0 / (1.0 + marks)})

    return score


@query(
    "model_sentiment",
    f"WITH {d.PREPARED_CTE} SELECT row_id, CASE WHEN contains(combined_text, '!') THEN 'positive' ELSE 'negative' END "
    "AS sentiment, found_tone AS tone, round(1.0 / (1 + length(combined_text) - length(replace(combined_text, '!', ''))), 6) "
    "AS confidence FROM prepared",
)
def model_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    rows = tn.add_model_sentiment(_texts(spark, sf), "combined_text", _shouting_scorer)
    return rows.select("row_id", "sentiment", "tone", F.round("confidence", 6).alias("confidence"))


# --- placeholders ------------------------------------------------------------------------

def _rule_query(name: str) -> None:
    @query(f"ph_{name}", f"WITH {d.TEXTS_CTE} SELECT row_id, {d.rule('clean_body', name)} AS text FROM texts")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _texts(spark, sf).select("row_id", ph.apply_rule(F.col("clean_body"), name).alias("text"))


for _name in ph.RULES:
    _rule_query(_name)


@query(
    "ph_contact_documents",
    f"SELECT doc_id, {d.rule(d.rule('text', 'email'), 'phone')} AS text FROM documents",
)
def ph_contact_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", ph.apply_rule(ph.apply_rule(F.col("text"), "email"), "phone").alias("text"))


@query("placeholderize", f"WITH {d.TEXTS_CTE} SELECT row_id, {d.placeholderize('clean_body')} AS text FROM texts")
def placeholderize(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("row_id", ph.placeholderize(F.col("clean_body")).alias("text"))


@query("greeting_template", f"WITH {d.TEXTS_CTE} SELECT row_id, {d.greeting_template('clean_body')} AS text FROM texts")
def greeting_template(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("row_id", ph.greeting_template(F.col("clean_body")).alias("text"))


@query("closing_template", f"WITH {d.TEXTS_CTE} SELECT row_id, {d.closing_template('clean_body')} AS text FROM texts")
def closing_template(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("row_id", ph.closing_template(F.col("clean_body")).alias("text"))


_TEMPLATED = d.TEXTS_CTE + d.body_template_cte("texts", "templated")


def _templated(spark: SparkSession, sf: str) -> DataFrame:
    return ph.add_body_template(_texts(spark, sf), "clean_body", "body_template")


@query("template_body", f"WITH {_TEMPLATED} SELECT row_id, body_template FROM templated")
def template_body(spark: SparkSession, sf: str) -> DataFrame:
    return _templated(spark, sf).select("row_id", "body_template")


@query(
    "template_subject",
    f"WITH {d.TEXTS_CTE} SELECT row_id, coalesce(nullif({d.ws(d.placeholderize('clean_subject'))}, ''), "
    f"{d.lit(lx.SUBJECT_FALLBACK)}) AS subject_template FROM texts",
)
def template_subject(spark: SparkSession, sf: str) -> DataFrame:
    rows = add_texts(mails(spark, sf))
    return rows.select("row_id", ph.subject_template(F.col("clean_subject")).alias("subject_template"))


@query(
    "placeholder_names",
    f"WITH {_TEMPLATED} SELECT row_id, array_to_string({d.names('body_template')}, ',') AS names FROM templated",
)
def placeholder_names(spark: SparkSession, sf: str) -> DataFrame:
    return _templated(spark, sf).select(
        "row_id", F.array_join(ph.placeholder_names(F.col("body_template")), ",").alias("names")
    )


@query(
    "placeholder_targets",
    f"WITH {_TEMPLATED} SELECT row_id, array_to_string({d.targets('body_template')}, ',') AS names FROM templated",
)
def placeholder_targets(spark: SparkSession, sf: str) -> DataFrame:
    return _templated(spark, sf).select(
        "row_id", F.array_join(ph.placeholder_targets(F.col("body_template")), ",").alias("names")
    )


@query("template_id", f"WITH {_TEMPLATED} SELECT row_id, {d.template_id('body_template')} AS template_id FROM templated")
def template_id(spark: SparkSession, sf: str) -> DataFrame:
    return _templated(spark, sf).select("row_id", ph.template_id(F.col("body_template")).alias("template_id"))


_WORDS = rf"len(regexp_extract_all(lower(body_template), {d.lit(lx.TOKEN)}))"
_SENTENCES = r"greatest(len(regexp_extract_all(body_template, '[.!?]+')), 1)"
_SYLLABLES = r"len(regexp_extract_all(lower(body_template), '[aeiouy]+'))"
READABILITY_SQL = (
    f"CASE WHEN {_WORDS} > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * ({_WORDS}::DOUBLE / {_SENTENCES}) "
    f"- 84.6::DOUBLE * ({_SYLLABLES}::DOUBLE / {_WORDS}) END"
)


@query("readability", f"WITH {_TEMPLATED} SELECT row_id, round({READABILITY_SQL}, 6) AS score FROM templated")
def readability(spark: SparkSession, sf: str) -> DataFrame:
    scored = t.add_readability(_templated(spark, sf), "body_template", "score")
    return scored.select("row_id", F.round("score", 6).alias("score"))


# --- the chain over whole given texts: documents, pages, conversations ---------------------

@query("clean_body_documents", f"SELECT doc_id, {d.clean('text')} AS clean_body FROM documents")
def clean_body_documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents", "doc_id", "text").select("doc_id", t.clean_body(F.col("text")).alias("clean_body"))


@query("placeholderize_pages", f"SELECT page_id, {d.placeholderize('html')} AS text FROM pages")
def placeholderize_pages(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages", "page_id", "html").select("page_id", ph.placeholderize(F.col("html")).alias("text"))


@query(
    "features_conversations",
    f"WITH low AS (SELECT conv_id, turn, text, lower(text) AS low FROM conversations) SELECT conv_id, turn, {d.greeting('text')} AS greeting, "
    f"{d.closing('text')} AS closing, {d.intent('low')} AS intent, {d.formality('low')} AS formality, {d.slots('text')} AS placeholders, "
    f"{d.actions('low')} AS action_words FROM low",
)
def features_conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations", "conv_id", "turn", "text")
    return add_features(rows, "text").select(
        "conv_id", "turn", "greeting", "closing", "intent", "formality", F.array_join("placeholders", ",").alias("placeholders"),
        F.array_join("action_words", ",").alias("action_words"),
    )


@query("template_body_documents", f"WITH src AS (SELECT doc_id, text FROM documents){d.body_template_cte('src', 'done', 'text')} SELECT doc_id, body_template FROM done")
def template_body_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text")
    return ph.add_body_template(docs, "text", "body_template").select("doc_id", "body_template")
