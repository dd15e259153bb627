"""Steps whose cost must not grow beyond the input: bounded vocabulary, texts read once, few comparisons."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mailmine.functions import text as t
from mailmine.operators import balls as bl
from mailmine.operators import cluster as cl
from mailmine.operators import encode as en
from mailmine.operators import labels as lb
from mailmine.operators import similarity as sm


def test_word2vec_vocabulary_is_bounded(spark):
    df = spark.createDataFrame([(f"same w{i} w{i}",) for i in range(60)], "t string")
    model = en.fit_word2vec(df, "t", dim=4, buckets=16).model
    assert model.stages[-2].getVectors().count() <= 16
    own = en.fit_word2vec(df, "t", dim=4, buckets=61).model
    assert own.stages[-2].getVectors().count() == 61


def test_hashed_word2vec_is_loaded_again(spark, tmp_path):
    df = spark.createDataFrame([(i, f"same w{i} w{i}") for i in range(60)], "row_id long, t string")
    fitted = en.fit_word2vec(df, "t", dim=4, buckets=16)
    fitted.save(str(tmp_path / "m"))
    again = en.load_encoder(str(tmp_path / "m")).encode(df, "t").orderBy("row_id").collect()
    assert again == fitted.encode(df, "t").orderBy("row_id").collect() and all(any(r["embedding"]) for r in again)


def test_word2vec_words_keep_their_own_vectors_however_many(spark):
    n = (1 << 16) + 4_464
    words = "transform(sequence(0, 19), i -> concat('w', cast(id * 10 + i % 10 as string)))"
    df = spark.range(n // 10).selectExpr(f"array_join({words}, ' ') AS t")
    vectors = en.fit_word2vec(df, "t", dim=2).model.stages[-2].getVectors()
    assert vectors.count() == n and vectors.where("word = 'w0'").count() == 1


def test_lines_are_split_once_for_the_closing(spark):
    df = spark.createDataFrame([("a\n\nThanks,\nB\nRegards\nx\ny",)], "s string").select(t.extract_closing(F.col("s")).alias("c"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1 and df.first()["c"] == "Regards"


def test_strip_takes_all_white_space_and_nothing_else(spark):
    texts = [chr(c) + "x" + chr(c) for c in (*range(1, 0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x180E, 0x3000, 0xFEFF)]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    rows = df.select("s", t.strip(F.col("s")).alias("a"), F.regexp_replace("s", r"(?U)\A\s+|\s+\z", "").alias("b")).collect()
    assert [r for r in rows if r["a"] != r["b"]] == []
    assert "regexp_replace" not in df.select(t.strip(F.col("s")))._jdf.queryExecution().analyzed().toString()


def test_phrases_are_pruned_before_they_are_exploded(spark):
    df = spark.createDataFrame([(i, "x y z" if i % 2 else f"{'q' * i} b c") for i in range(400)], "row_id long, t string")
    found = lb.likely_grams(df, "t", 3, 1, [], "row_id", 1 << 14)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[1:] for r in lb.top_phrases(df, "t", 3, 1).collect()] == [("x y z", 200)]


@pytest.mark.parametrize("threshold", [0.92, 0.65 - 1e-12, 0.3, 1.0, -0.5])
def test_near_is_the_rounded_comparison(threshold):
    rng = np.random.default_rng(1)
    s = threshold + np.concatenate([rng.uniform(-2e-9, 2e-9, 20000), np.arange(-50, 50) * 1e-16])
    expected = sm.similarities(s[:, None], np.ones((1, 1)))[:, 0] >= threshold
    assert (sm.near(s[:, None], np.ones((1, 1)), threshold)[:, 0] == expected).all()


def _dense(spark, n=400):
    rng = np.random.default_rng(5)
    points = rng.normal(0, 0.02, (n, 8)) + 1
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), "embedding": points.tolist()}), "row_id long, embedding array<double>")


def test_a_dense_region_is_not_compared_with_all_of_itself(spark, monkeypatch):
    monkeypatch.setattr(bl, "BLOCK", 25)
    asked = []

    def counting(left, right, pairs, *rest, **named):
        asked.append((left.count(), pairs.where("lb <> rb").count()))
        return bl.near_blocks(left, right, pairs, *rest, **named)

    monkeypatch.setattr(cl, "WITNESSES", 2)
    monkeypatch.setattr(cl, "near_blocks", counting)
    out = cl.dbscan(_dense(spark), eps=0.35).collect()
    assert {r["cluster_id"] for r in out} == {0} and len(out) == 400
    assert all(rows <= 2 * 400 / 5 for rows, across in asked if across)


@pytest.mark.parametrize("tile", [30, 16384])
def test_tiles_meet_each_pair_once(spark, monkeypatch, tile):
    monkeypatch.setattr(bl, "BLOCK", 25)
    monkeypatch.setattr(bl, "TILE", tile)
    rows = _dense(spark, 200).select(F.col("row_id").alias("id"), F.col("embedding").alias("vec"), F.lit(1).cast("long").alias("weight"))
    tree = bl.plant(rows)
    pairs = bl.meeting(tree, tree, bl.within(2.0))
    counted = bl.near_blocks(tree.rows, tree.rows, pairs, lambda l, r: cl._count_near(l, r, 0.5), "id long, near long", tiles=True)
    assert {r["n"] for r in counted.groupBy("id").agg(F.sum("near").alias("n")).collect()} == {200}


def test_groups_compare_only_the_blocks_that_meet(spark, monkeypatch):
    monkeypatch.setattr(bl, "BLOCK", 25)
    rows = _dense(spark, 200).select(F.col("row_id").alias("id"), F.col("embedding").alias("vec"), F.lit(1).cast("long").alias("weight"))
    tree = bl.plant(rows)
    own = tree.leaves.select(F.col("block").alias("lb"), F.col("block").alias("rb"))
    counted = bl.near_blocks(tree.rows, tree.rows, own, lambda l, r: cl._count_near(l, r, 0.5), "id long, near long", tiles=True)
    found = counted.join(tree.rows, "id").join(tree.leaves, "block").select("near", "size").collect()
    assert len(found) == 200 and all(r["near"] == r["size"] for r in found)


def _side(points):
    return pd.DataFrame({"id": np.arange(len(points)), "vec": list(points), "weight": 1})


def test_counting_stops_where_enough_are_near(monkeypatch):
    monkeypatch.setattr(bl, "PIECE", 10)
    side, compared = _side(np.ones((1000, 1))), []
    monkeypatch.setattr(cl, "near", lambda a, b, t: (compared.append(len(a) * len(b)), sm.near(a, b, t))[1])
    assert (cl._count_near(side, side, 0.5, 5)["near"] >= 5).all() and sum(compared) == 1000 * 10
    low = cl._lowest_core(side, side.assign(component=np.arange(1000)[::-1]), 0.5)
    assert (low["component"] == 0).all() and sum(compared) == 2 * 1000 * 10


@pytest.mark.parametrize("density", [0.002, 0.01, 0.2])
def test_links_of_blocks_and_groups_connect_the_same(monkeypatch, density):
    rng = np.random.default_rng(7)
    hit, l_ids, r_ids = rng.random((60, 90)) < density, rng.permutation(60), 60 + rng.permutation(90)
    l_low, r_low = l_ids.copy(), r_ids.copy()
    for _ in range(200):
        r_low = np.minimum(r_low, np.where(hit, l_low[:, None], 999).min(axis=0))
        l_low = np.minimum(l_low, np.where(hit, r_low[None, :], 999).min(axis=1))
    have = cl._lowest(hit, l_ids, r_ids)
    assert (have[0] == l_low).all() and (have[1] == r_low).all()
    rows, cols = np.nonzero(hit)
    edges = cl._forest(l_ids[rows], r_ids[cols])
    expected = dict(zip([*l_ids, *r_ids], [*l_low, *r_low], strict=True))
    assert {k: v for k, v in expected.items() if k != v} == dict(zip(edges["a"], edges["b"], strict=True))
    points = rng.normal(size=(150, 3))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    whole = cl._local_links(_side(points), _side(points), 0.95)
    monkeypatch.setattr(bl, "BLOCK", 16)
    parts = cl._group_links(_side(points), _side(points), 0.95)
    assert sorted(zip(whole["a"], whole["b"])) == sorted(zip(parts["a"], parts["b"]))


@pytest.mark.parametrize("eps, witnesses", [(0.02, 1), (0.1, 1), (0.35, 2)])
def test_dbscan_with_few_witnesses_is_exact(spark, monkeypatch, eps, witnesses):
    monkeypatch.setattr(bl, "BLOCK", 20)
    monkeypatch.setattr(cl, "WITNESSES", witnesses)
    rng = np.random.default_rng(int(eps * 100))
    points = rng.normal(size=(300, 3))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(300), "embedding": points.tolist()}), "row_id long, embedding array<double>")
    found = {r["row_id"]: r["cluster_id"] for r in cl.dbscan(df, eps=eps).collect()}
    hit = sm.similarities(points, points) >= 1 - eps - 1e-12
    core = hit.sum(axis=1) >= 5
    label = np.where(core, np.arange(300), 999)
    for _ in range(300):
        label = np.where(core, np.where(hit & core[None, :], label[None, :], 999).min(axis=1), 999)
    low = np.where(core, label, np.where(hit & core[None, :], label[None, :], 999).min(axis=1))
    order = {v: k for k, v in enumerate(sorted(set(label[core])))}
    assert found == {i: order.get(v, -1) for i, v in enumerate(low)}
