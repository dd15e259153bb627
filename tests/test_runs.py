"""Stored runs, the vector store, and the streams that use them."""

from __future__ import annotations

import os
import re
import shutil

import pytest
from pyspark.sql import functions as F

from mailmine.operators import encode as en
from mailmine.operators import match as mt
from mailmine.operators import similarity
from mailmine.operators import templates as tp
from mailmine.operators.vector_store import VectorStore
from mailmine.plans import runs
from mailmine.plans.mining import MiningParams, MiningRun, load_run, mine
from mailmine.sources import landing
from mailmine.streaming import mails as st


@pytest.fixture(scope="module")
def run(spark, two_topics):
    return mine(two_topics, MiningParams(n_clusters=2))


def test_a_stored_run_is_read_back(spark, run, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(runs.NoSuchRun):
        load_run(spark, folder)
    run.save(folder)
    back = load_run(spark, folder)
    assert back.run_id == run.run_id and back.templates.schema == run.templates.schema
    assert sorted(back.templates.collect()) == sorted(run.templates.collect())
    assert back.evaluation.drop("generated_at").collect() == run.evaluation.drop("generated_at").collect()
    assert back.members.count() == 40
    wanted = back.templates.first()["template_id"]
    assert tp.lookup(back.templates, wanted).count() == 1 and tp.listing(back.templates).first()["count"] == 2
    with pytest.raises(runs.NoSuchRun):
        load_run(spark, folder, "another")


def test_readers_see_finished_runs_only(spark, run, tmp_path):
    folder = str(tmp_path)
    members, report = run.members.select("row_id", "cluster_id"), run.evaluation.select("n_emails")
    one, two = (run.templates.where(F.col("cluster_id") == c) for c in (0, 1))
    MiningRun("b", members, one, report).save(folder)
    MiningRun("a", members, two, report).save(folder)
    runs.write_tables(folder, "c", {"templates": run.templates})             # broken off before its line
    latest, older = load_run(spark, folder), load_run(spark, folder, "b")
    assert (latest.run_id, latest.templates.first()["cluster_id"], older.templates.first()["cluster_id"]) == ("a", 1, 0)
    assert {r["run_id"] for r in runs.list_runs(spark, folder).collect()} == {"a", "b"}
    MiningRun("b", members, run.templates, report).save(folder)             # stored again: now it is the latest
    assert load_run(spark, folder).run_id == "b" and load_run(spark, folder).templates.count() == 2
    for part in (tmp_path / "run=a" / "templates").glob("*part-*.parquet"):
        os.remove(part)
    with pytest.raises(runs.NoSuchRun):
        load_run(spark, folder, "a")


def test_misplaced_rows_are_refused(spark):
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "row_id long")
    tp.require_aligned(ids(1, 2, 3), ids(1, 2, 3), ids(1, 2, 3))
    for rows, numbers, placed in (((1, 2), (1, 2, 3), (1, 2)), ((1, 2, 3), (1, 2), (1, 2)), ((1, 1, 2), (1, 2), (1, 1, 2)), ((1, 2, 3), (1, 2, 2), (1, 2, 2))):
        with pytest.raises(tp.MisalignedInput):
            tp.require_aligned(ids(*rows), ids(*numbers), ids(*placed))


def test_store_reads_the_partitions_asked_for(spark, tmp_path):
    store = VectorStore(str(tmp_path / "v"))
    keys = spark.range(600).select(F.sha2(F.col("id").cast("string"), 256).alias("content_key"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    store.add(keys, "first")
    few = keys.limit(3)
    prefixes = store.prefixes(few)
    assert 1 <= len(prefixes) <= 3
    read = store.read(spark, prefixes)
    names = spark.read.parquet(store.path).where(F.col("prefix").isin(prefixes)).select("_metadata.file_path").distinct().collect()
    scanned = {re.search(r"prefix=(\w+)", r["file_path"])[1] for r in names}
    assert scanned == set(prefixes)
    assert "PartitionFilters: [prefix" in read._jdf.queryExecution().toString()
    assert read.where(F.substring("content_key", 1, 2).isin(prefixes)).count() == read.count() < 60
    assert store.missing(few, prefixes).count() == 0 and store.read(spark).count() == 600
    assert VectorStore(str(tmp_path / "none")).read(spark, ["aa"]).count() == 0


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    path, encoder = str(tmp_path / "v"), en.HashedEncoder()
    texts = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b")], "row_id long, t string")
    for _ in range(2):
        assert en.encode_incremental(texts, path, encoder, "t", batch="7").count() == 3
    files = sorted(os.listdir(path))
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(f"{path}.batches").count() == 1
    shutil.rmtree(f"{path}.batches")     # broken off after its vectors: run again, it finds them by their keys
    en.encode_incremental(texts, path, encoder, "t", batch="7")
    assert sorted(os.listdir(path)) == files and spark.read.parquet(path).count() == 2


@pytest.mark.parametrize("block", [1024, 4])
def test_match_stream_follows_the_latest_run(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(similarity, "RANK_BLOCK", block)     # 4: more templates than one block holds
    folder, source, out, state = (str(tmp_path / n) for n in ("runs", "in", "out", "state"))
    made = spark.range(9).select(F.col("id").alias("cluster_id"), F.concat(F.lit("subject "), "id").alias("subject_template"),
                                 F.concat(F.lit("body of w"), "id").alias("body_template"))

    def store(run_id, templates):
        runs.write_tables(folder, run_id, {"templates": templates})
        runs.publish(spark, folder, run_id, ("templates",))

    store("one", made)
    mail = lambda i: spark.createDataFrame([(i, "subject 3", "body of w3")], "row_id long, subject string, body string")
    mail(1).write.parquet(source)
    stream = spark.readStream.schema(mail(1).schema).parquet(source)
    st.match_stream(stream, folder, out, state, top_k=2).awaitTermination()
    store("two", made.where("cluster_id <> 3"))
    mail(2).write.mode("append").parquet(source)
    st.match_stream(stream, folder, out, state, top_k=2).awaitTermination()
    found = {(r["row_id"], r["rank"]): r["cluster_id"] for r in spark.read.parquet(out).collect()}
    want = {1: mt.match(mail(1), mt.encode_templates(made), 2), 2: mt.match(mail(2), mt.encode_templates(made.where("cluster_id <> 3")), 2)}
    assert found == {(i, r["rank"]): r["cluster_id"] for i, df in want.items() for r in df.collect()}
    assert found[1, 1] == 3 and found[2, 1] != 3


def test_one_bad_file_does_not_stop_the_landing(spark, tmp_path):
    source, out, refused = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "refused")
    (source / "day 1").mkdir(parents=True)
    files = {"good.csv": "email_id,subject,body\n1,a,b\n2,c,\n", "other.csv": "Email ID,Subject,Body,Category\n3,,x,z\n", "bad.csv": "email_id,subject\n1,x\n",
             "empty.csv": "", "notes.txt": "email_id,subject,body\n", "day 1/late.csv": "email_id,subject,body\n4,s,t\n"}
    for name, text in files.items():
        (source / name).write_text(text)
    archive = tmp_path / "done"
    for _ in range(2):      # the second run finds nothing new
        st.land_stream(spark, str(source), out, refused, str(tmp_path / "state"), archive=str(archive), files_at_once=2).awaitTermination()
    rows = {(r["email_id"], r["subject"], r["body"], r["category"]) for r in spark.read.parquet(out).collect()}
    assert rows == {("1", "a", "b", None), ("3", "", "x", "z"), ("4", "s", "t", None)}
    told = {os.path.basename(r["file"]): r["error"] for r in spark.read.parquet(refused).collect()}
    assert set(told) == {"bad.csv", "notes.txt"}
    assert told["bad.csv"] == "unreadable: columns body are not there, only email_id, subject"
    assert told["notes.txt"] == landing.NOT_CSV


def test_headers_are_read_without_the_files(spark, tmp_path):
    big = tmp_path / "big.csv"
    big.write_text("email_id,subject,body\n" + "1,a,b\n" * 4_000_000)       # 24 MB
    tracker = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem
    tracker.clearStatistics()
    assert landing.first_lines(spark, [str(big)]) == {str(big): "email_id,subject,body"}
    read = sum(s.getBytesRead() for s in tracker.getAllStatistics())
    assert 0 < read < 4_000_000
