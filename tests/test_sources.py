"""Reading, landing, writing and streaming."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from mailmine.catalog import ORACLE, QUERIES
from mailmine.operators import encode as en
from mailmine.operators import match as mt
from mailmine.plans.mining import MiningParams, mine
from mailmine.sources import landing, sinks
from mailmine.sources import mails as sm
from mailmine.streaming import mails as st


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, newline="")
    return str(path)


MESSY = 'Email ID,Subject,Body,Sent-At\n001,"Hi","line one\nline ""two"" , three ",x\nE2,,Hello there,\nE3,Hi,"   ",y\nE4,Hi,,z\nE5,Hi,NA,z\n'


def test_csv(spark, tmp_path):
    df = sm.load_csv(spark, write(tmp_path / "raw.csv", MESSY))
    rows = {r["email_id"]: r for r in df.collect()}
    assert set(rows) == {"001", "E2", "E5"}
    assert rows["001"]["body"] == 'line one\nline "two" , three' and rows["E2"]["subject"] == ""
    assert {"sent_at", "category", "sentiment", "tone", "sender", "recipient", "created_at"} <= set(df.columns)
    assert sm.load_csv(spark, str(tmp_path / "raw.csv"), na_values=["NA"]).count() == 2
    with pytest.raises(FileNotFoundError):
        sm.load_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(sm.DataValidationError, match="body"):
        sm.load_csv(spark, write(tmp_path / "bad.csv", "email_id,subject\n1,x\n"))


def test_cleaning_trims_unicode_blanks(spark):
    df = spark.createDataFrame([("1", None, " \xa0text\t\n"), ("2", "s", " "), ("3", "s", None)],
                               "email_id string, subject string, body string")
    assert [(r["email_id"], r["subject"], r["body"]) for r in sm.clean_rows(df).collect()] == [("1", "", "text")]


def test_landing_report(spark, tmp_path):
    write(tmp_path / "good.csv", MESSY)
    write(tmp_path / "bad.csv", "email_id,subject\n1,x\n")
    write(tmp_path / "notes.txt", "hello")
    write(tmp_path / "none.csv", "email_id,subject,body\n")
    write(tmp_path / "zero.csv", "")
    rows = {r["file"].rsplit("/", 1)[1]: r for r in landing.landing_report(spark, str(tmp_path)).collect()}
    assert rows["good.csv"]["rows"] == 3 and rows["good.csv"]["error"] is None
    assert rows["none.csv"]["rows"] == 0
    assert rows["zero.csv"]["error"] == landing.EMPTY and len(rows) == 5
    assert "body" in rows["bad.csv"]["error"] and rows["notes.txt"]["error"] == landing.NOT_CSV


def test_data_set_resolution(spark, tmp_path):
    sample = str(tmp_path / "sample")
    with pytest.raises(FileNotFoundError):
        landing.resolve_dataset(spark, sample=sample)
    write(tmp_path / "kept.csv", "email_id,subject,body\n1,a,b\n2,c,d\n")
    sample = str(tmp_path / "kept.csv")
    assert landing.resolve_dataset(spark, sample=sample).count() == 2
    upload = write(tmp_path / "up.csv", "email_id,subject,body\n1,a,b\n")
    assert landing.resolve_dataset(spark, uploads=["/no/such", upload], sample=sample).count() == 1
    assert landing.resolve_dataset(spark, path=upload).count() == 1


@pytest.fixture(scope="module")
def templates(spark, two_topics):
    return mine(two_topics, MiningParams(n_clusters=2)).templates


def test_exports(spark, templates, tmp_path):
    paths = sinks.save_templates(templates, str(tmp_path))
    back = sinks.read_written_json(spark, paths["json"], templates.schema)
    assert back.collect() == templates.collect()
    text = "".join(p.read_text() for p in (tmp_path / "templates_json").glob("part-*"))
    assert len(json.loads(text)) == 2
    flat = spark.read.options(**sm.CSV_OPTIONS).csv(paths["csv"])
    assert sorted(r["body_template"] for r in flat.collect()) == sorted(r["body_template"] for r in templates.collect())
    assert json.loads(flat.first()["placeholders"]) == templates.first()["placeholders"]
    text = "".join(p.read_text() for p in (tmp_path / "templates_md").glob("part-*"))
    assert text.startswith("# Email Templates\n\n## tmpl_") and text.count("\n---\n") == 2
    assert "| category=meeting_request | tone=formal" in text and "`{sender_name}`" in text
    with pytest.raises(ValueError):
        sinks.export(templates, "xml", str(tmp_path / "x"))


def test_markdown_leaves_missing_labels_out(spark, templates):
    bare = templates.withColumns({"tone": F.lit(None).cast("string"), "intent": F.lit(""),
                                  "common_phrases": F.array().cast("array<string>")})
    block = sinks.markdown_blocks(bare).first()["block"]
    assert "tone=" not in block and "intent=" not in block and "Common phrases" not in block


def test_processed_round_trip(spark, two_topics, tmp_path):
    for fmt in ("parquet", "csv"):
        sinks.save_processed(two_topics, str(tmp_path / fmt), fmt)
    rows = sorted(map(tuple, two_topics.select("email_id", "body").collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "parquet")).select("email_id", "body").collect())) == rows
    assert sorted(map(tuple, sm.load_csv(spark, str(tmp_path / "csv")).select("email_id", "body").collect())) == rows


def test_streams_equal_batch(spark, two_topics, templates, tmp_path):
    landed = str(tmp_path / "in")
    sinks.write_csv(two_topics, landed)
    arriving = st.landing_stream(spark, landed, two_topics.schema.simpleString()[7:-1].replace(":", " "))
    st.write_stream(arriving, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    columns = ["row_id", "email_id", "subject", "body"]
    batch = sm.load_csv(spark, landed).withColumn("row_id", F.col("row_id").cast("long"))
    assert sorted(stored.select(*columns).collect()) == sorted(batch.select(*columns).collect())

    vectors = mt.encode_templates(templates)
    stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "out"))
    st.match_stream(stream, templates, str(tmp_path / "m"), str(tmp_path / "c2"), 2).awaitTermination()
    matched = spark.read.parquet(str(tmp_path / "m")).select("row_id", "cluster_id", "similarity", "rank")
    assert sorted(matched.collect()) == sorted(mt.match(stored, vectors, 2).collect())

    cache = str(tmp_path / "vectors")
    for check in ("c3", "c4"):  # the second run replays everything
        stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "out"))
        st.encode_stream(stream, cache, str(tmp_path / check), en.HashedEncoder(), "body").awaitTermination()
    assert spark.read.parquet(cache).count() == 2


def test_landing_stream_refuses_another_header(spark, tmp_path):
    write(tmp_path / "in" / "bad.csv", "email_id,subject\n1,x\n")
    df = st.landing_stream(spark, str(tmp_path / "in"), "email_id string, subject string, body string")
    with pytest.raises(Exception):
        st.write_stream(df, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()


def test_every_checked_query_is_registered():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 90
