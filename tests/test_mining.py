"""Templates, report, matching and training on small mail tables."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mailmine.functions import lexicon as lx
from mailmine.operators import encode as en
from mailmine.operators import labels as lb
from mailmine.operators import match as mt
from mailmine.operators import metrics as me
from mailmine.operators import pairs as pr
from mailmine.operators import templates as tp
from mailmine.operators.prepare import prepare
from mailmine.plans import training
from mailmine.plans.mining import MiningParams, load_run, mine
from tests.conftest import MAIL


def test_run_end_to_end(spark, two_topics, tmp_path):
    run = mine(two_topics, MiningParams(n_clusters=2))
    rows = run.templates.collect()
    assert len(rows) == 2
    assert all("{recipient_name}" in r["body_template"] for r in rows)
    assert [(r["cluster_id"], r["cluster_size"], r["category"]) for r in rows] == [
        (0, 20, "meeting_request"), (1, 20, "complaint")]
    assert {r["representative_email_id"] for r in rows} == {"M0", "C0"}
    report = run.evaluation.first().asDict()
    assert report["n_emails"] == 40 and report["template_coverage"] == 1.0 and report["cluster_sizes"] == {"0": 20, "1": 20}
    assert report["fine_tuning_improvement"] is None and "generated_at" in report
    run.save(str(tmp_path))
    run.register()
    assert spark.sql("SELECT count(*) FROM templates").first()[0] == 2


def test_equal_mails_give_one_template(spark):
    body = "Hello Kai,\n\nWhen can you look at my draft?\n\nThanks,\nRobin"
    rows = [(i, f"X{i}", "My draft", body, "request", "neutral", "neutral") for i in range(30)]
    run = mine(spark.createDataFrame(rows, MAIL), MiningParams(n_clusters=3, duplicate_similarity=0.5))
    assert run.templates.count() == 1


@pytest.mark.parametrize("method", ["agglomerative", "dbscan"])
def test_other_methods(spark, two_topics, method):
    run = mine(two_topics, MiningParams(method=method, n_clusters=2))
    assert sorted(r["cluster_size"] for r in run.templates.collect()) == [20, 20]


def test_report_keeps_given_scores(spark, two_topics):
    run = mine(two_topics, MiningParams(n_clusters=2))
    row = me.evaluation_report(run.members, run.templates, baseline=0.4, tuned=0.5).first()
    assert row["fine_tuning_improvement"] == pytest.approx(0.1)
    assert len(row) == 14


def test_majority_and_ties(spark):
    rows = [(1, 3, "b"), (1, 1, "a"), (1, 2, "b"), (1, 4, "a"), (2, 5, ""), (2, 6, None), (3, 9, "z"), (3, 8, ""), (3, 7, "")]
    df = spark.createDataFrame(rows, "g int, row_id long, label string").repartition(3)
    out = {r["g"]: r["label"] for r in lb.majority_labels(df, "g", ["label"]).collect()}
    assert out == {1: "a", 2: None, 3: "z"}


def test_phrases_first_seen_wins(spark):
    rows = [(1, "x y z"), (0, "p q r s"), (2, "x y z")]
    df = spark.createDataFrame(rows, "row_id long, t string").repartition(3)
    assert [(r["phrase"], r["n"]) for r in lb.top_phrases(df, "t", 3, 3).orderBy("rank").collect()] == [
        ("x y z", 2), ("p q r", 1), ("q r s", 1)]


def test_misaligned_input_is_refused(spark, two_topics):
    rows = prepare(two_topics)
    vectors = en.HashedEncoder().encode(rows, "combined_text")
    groups = rows.select("row_id", F.lit(0).alias("cluster_id"))
    with pytest.raises(tp.MisalignedInput):
        tp.join_members(rows, vectors.where("row_id > 3"), groups)


def test_scores_of_few_templates(spark):
    schema = "cluster_size long, body_template string"
    one = me.template_scores(spark.createDataFrame([(3, "A b.")], schema)).first()
    assert one["duplicate_template_percentage"] == 0.0 and one["average_template_length"] == 4.0
    two = me.template_scores(spark.createDataFrame([(3, "A b. "), (2, "a B.")], schema)).first()
    assert two["duplicate_template_percentage"] == 0.5
    none = me.template_scores(spark.createDataFrame([], schema)).first()
    assert none["covered"] == 0 and none["average_template_length"] == 0.0 and none["average_readability"] is None
    assert spark.range(1).select(me.coverage(F.lit(5), F.lit(0))).first()[0] == 0.0


def test_search_lookup_facets(spark, two_topics):
    templates = mine(two_topics, MiningParams(n_clusters=2)).templates
    assert tp.search(templates, category="complaint").count() == 1
    assert tp.search(templates, tone="formal", text=" ROADMAP ").count() == 1
    assert tp.search(templates, text="no such words").count() == 0
    wanted = templates.first()["template_id"]
    assert tp.lookup(templates, wanted).count() == 1 and tp.lookup(templates, "tmpl_none").count() == 0
    assert [tuple(r) for r in tp.facets(templates).collect()] == [
        ("category", "complaint"), ("category", "meeting_request"), ("tone", "formal")]


def test_match_finds_the_template_of_a_mail(spark, two_topics):
    templates = mine(two_topics, MiningParams(n_clusters=2)).templates
    vectors = mt.encode_templates(templates)
    rows = mt.match_annotated(two_topics, vectors, top_k=2).collect()
    best = {r["row_id"]: r["cluster_id"] for r in rows if r["rank"] == 1}
    assert len(rows) == 80 and all(best[i] == (0 if i < 20 else 1) for i in range(40))
    assert {r["detected_sentiment"] for r in rows if r["row_id"] >= 20} == {"negative"}
    with pytest.raises(ValueError):
        mt.match(two_topics, vectors, top_k=0)


def test_encoder_values_and_empty_text(spark):
    import hashlib

    df = spark.createDataFrame([("Alpha beta ALPHA\n",), ("",), ("  ",)], "t string").coalesce(1)
    rows = [r["embedding"] for r in en.HashedEncoder(64).encode(df, "t").collect()]
    slot = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64 for w in ("alpha", "beta")}
    assert rows[0][slot["alpha"]] == pytest.approx(2 / 5**0.5) and rows[0][slot["beta"]] == pytest.approx(1 / 5**0.5)
    assert sum(x * x for x in rows[0]) == pytest.approx(1.0) and set(rows[1]) == set(rows[2]) == {0.0}


def test_incremental_encode_adds_only_new_content(spark, tmp_path):
    path, encoder = str(tmp_path / "cache"), en.HashedEncoder()
    first = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "row_id long, t string")
    assert en.encode_incremental(first, path, encoder, "t").count() == 3
    assert spark.read.parquet(path).count() == 2
    more = spark.createDataFrame([(4, "c"), (5, "d")], "row_id long, t string")
    out = {r["row_id"]: r["embedding"] for r in en.encode_incremental(more, path, encoder, "t").collect()}
    assert spark.read.parquet(path).count() == 3
    again = {r["row_id"]: r["embedding"] for r in encoder.encode(more, "t").collect()}
    assert out == again


def test_saved_encoder_is_used_only_if_it_is_there(spark, two_topics, tmp_path):
    rows = prepare(two_topics)
    path = tmp_path / "encoder"
    path.mkdir()
    (path / ".gitkeep").write_text("")
    assert isinstance(en.resolve_encoder(spark, str(path)), en.HashedEncoder)
    fitted = training.fit_encoder(rows, "tfidf", path=str(path))
    loaded = en.resolve_encoder(spark, str(path))
    same = [e.encode(rows, "combined_text").orderBy("row_id").first()["embedding"] for e in (fitted, loaded)]
    assert same[0] == same[1]


def test_user_model(spark):
    def load():
        return lambda texts: [[len(x), 1.0] for x in texts]

    df = spark.createDataFrame([("abc",)], "t string")
    vector = en.FunctionEncoder(load, "lengths").encode(df, "t").first()["embedding"]
    assert vector == pytest.approx([3 / 10**0.5, 1 / 10**0.5])


def test_pairs(spark):
    rows = [(i, "a" if i < 205 else "b" if i < 207 else None, f"text {i}") for i in range(208)]
    df = spark.createDataFrame(rows, "row_id long, label string, combined_text string").repartition(4)
    coded = pr.encode_labels(df, "label")
    assert {r["label"]: r["label_id"] for r in coded.collect()} == {None: 0, "a": 1, "b": 2}
    pairs = pr.training_pairs(coded, max_per_class=100).collect()
    by_label = [sum(r["label_id"] == i for r in pairs) for i in range(3)]
    assert by_label == [0, 50, 1]  # a hundred rows drawn, two rows, one row alone
    used = [x for r in pairs for x in (r["anchor_id"], r["positive_id"])]
    assert len(used) == len(set(used)) and all(r["anchor"] == f"text {r['anchor_id']}" for r in pairs)
    again = pr.training_pairs(coded.repartition(1), max_per_class=100).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in pairs}
    noise = coded.withColumn("label_id", F.lit(-1))
    with pytest.raises(pr.NotEnoughPairs):
        pr.require_pairs(pr.training_pairs(noise))


def test_pairs_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(lx, "PAIR_RANGE_ROWS", 16)  # labels of many ranges
    rows = [(i, 0 if i < 701 else 1 if i < 704 else 2 if i < 705 else -1, f"text {i}") for i in range(720)]
    df = spark.createDataFrame(rows, "row_id long, label_id int, combined_text string").repartition(4)
    found = pr.training_pairs(df, max_per_class=None).collect()
    want = set()
    for label in range(3):
        ids = sorted((i for i, x, _ in rows if x == label), key=lambda i: hashlib.md5(f"13:{i}".encode()).hexdigest())
        want |= {(label, a, b, f"text {a}", f"text {b}") for a, b in zip(ids[::2], ids[1::2], strict=False)}
    assert len(found) == len(want) == 351 and {tuple(r) for r in found} == want


def test_training_set_has_all_rows(spark):
    rows = [(i, "a" if i < 205 else "b", f"text {i}") for i in range(208)]
    df = spark.createDataFrame(rows, "row_id long, category string, combined_text string")
    assert training.training_set(df).count() == 103


def test_label_source(spark, two_topics):
    blank = two_topics.withColumn("category", F.lit(None).cast("string"))
    assert pr.label_source(two_topics, "category") == "supervised"
    assert pr.label_source(blank, "category") == "pseudo"
    with pytest.raises(ValueError):
        pr.label_source(blank, "category", allow_pseudo=False)
    assert training.training_set(prepare(blank), n_clusters=2).count() == 20


def test_encoder_comparison(spark, two_topics):
    rows = prepare(two_topics).withColumn(
        "combined_text", F.concat("combined_text", F.lit(" "), F.col("row_id").cast("string"))
    )
    row = training.compare_encoders(rows, training.fit_encoder(rows, "tfidf")).first()
    assert row["improvement"] == pytest.approx(row["fine_tuned_silhouette"] - row["baseline_silhouette"])


def test_a_run_knows_its_fitted_encoder(spark, two_topics, tmp_path):
    tuned = training.fit_encoder(prepare(two_topics), "tfidf")
    run = mine(two_topics, MiningParams(n_clusters=2, encoder=tuned, scores=(0.25, 0.75)))
    row = run.evaluation.first()
    assert (row["baseline_silhouette"], row["fine_tuned_silhouette"], row["fine_tuning_improvement"]) == (0.25, 0.75, 0.5)
    run.save(str(tmp_path))
    status = load_run(spark, str(tmp_path)).status().first()
    assert tuple(status) == (40, run.templates.count(), True)


def test_pruned_phrases_are_exact(spark):
    r = random.Random(11)
    words = ["".join("abcdefghij"[int(d)] for d in f"{i:03}") for i in range(400)]
    rows = [(i, None if i % 50 == 7 else i % 3, " ".join(r.choice(words if r.random() < 0.7 else words[:6]) for _ in range(40))) for i in range(600)]
    rows += [(1000, 9, "a b c d"), (1001, 9, "b c d a"), (1002, 8, None), (1003, 8, "")]
    df = spark.createDataFrame(rows, "row_id long, g int, t string").repartition(4)
    for group, k in (("g", 5), (None, 10), ("g", 1)):
        want = lb.top_phrases(df, "t", 2, k, group, counters=None).collect()
        for counters in (1 << 14, 64):
            assert sorted(map(str, lb.top_phrases(df, "t", 2, k, group, counters=counters).collect())) == sorted(map(str, want))
    kept = lb.likely_grams(df, "t", 2, 10, [], "row_id", 1 << 14)
    every = sum(max(0, len((t or "").split()) - 1) for _, _, t in rows)
    assert kept.select("phrase").distinct().count() < 200 and kept.count() < every / 3
    assert lb.top_phrases(df.limit(0), "t", 2, 5).count() == 0 and lb.top_phrases(df.limit(0), "t", 2, 5, "g").count() == 0
