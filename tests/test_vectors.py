"""Similarity, clustering and de-duplication against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailmine.operators import balls as bl
from mailmine.operators import cluster as cl
from mailmine.operators import dedup as de
from mailmine.operators import metrics as me
from mailmine.operators import similarity as sm
from mailmine.operators.components import connected_components, number_in_order
from mailmine.operators.dedup import greedy_keep


def unit(rows):
    rows = np.asarray(rows, dtype=np.float32).astype(np.float64)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def blobs(n_groups, per_group, spread, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n_groups, dim))
    return unit(np.vstack([c + rng.normal(scale=spread, size=(per_group, dim)) for c in centers]))


def frame(spark, vectors, names="row_id long, embedding array<float>"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], names).repartition(4)


def sims(v):
    v = v.astype(np.float64)
    return np.round(np.clip(v @ v.T, -1, 1), 9)


@pytest.mark.parametrize("block, scaled", [(1024, False), (1024, True), (30, True)])
def test_top_k_in_one_block_and_by_balls(spark, block, scaled, monkeypatch):
    monkeypatch.setattr(sm, "RANK_BLOCK", block)
    monkeypatch.setattr(bl, "FAN", 4)
    v = blobs(6, 20, 0.3)
    v[7] = v[3]  # a tie
    goal = v * np.linspace(0.2, 1.0, len(v))[:, None].astype(np.float32) if scaled else v
    df = frame(spark, v)
    out = sm.rank_targets(df, frame(spark, goal, "other long, embedding array<float>"), 4, query_id="row_id", query_vec="embedding",
                          target_id="other", target_vec="embedding", skip="row_id")
    have = {(r["row_id"], r["rank"]): r["other"] for r in out.collect()}
    s = np.round(np.clip(v.astype(np.float64) @ goal.astype(np.float64).T, -1, 1), 9)
    np.fill_diagonal(s, -9)
    order = np.argsort(-s, axis=1, kind="stable")[:, :4]
    assert have == {(i, k + 1): int(order[i, k]) for i in range(len(v)) for k in range(4)}


def test_top_k_asks_for_more_than_a_block_holds(spark, monkeypatch):
    monkeypatch.setattr(sm, "RANK_BLOCK", 8)
    v = blobs(3, 10, 0.3)
    df = frame(spark, v).withColumn("kind", F.col("row_id") % 2)
    out = sm.rank_targets(df, df.withColumnRenamed("row_id", "other"), 100, query_id="row_id", query_vec="embedding",
                          target_id="other", target_vec="embedding", keep=("kind",))
    assert out.count() == 900 and out.columns == ["row_id", "kind", "other", "similarity", "rank"]
    empty = sm.rank_targets(df, df.limit(0).withColumnRenamed("row_id", "other"), 3, query_id="row_id", query_vec="embedding",
                            target_id="other", target_vec="embedding")
    assert empty.count() == 0


def test_top_k_visits_few_blocks_of_planted_groups(spark, monkeypatch):
    monkeypatch.setattr(sm, "RANK_BLOCK", 40)
    df = frame(spark, blobs(40, 30, 0.02, dim=16))
    seen = []
    sm.rank_targets(df, df.withColumnRenamed("row_id", "other"), 5, query_id="row_id", query_vec="embedding",
                    target_id="other", target_vec="embedding", report=lambda *n: seen.append(n))
    (there, visited), = seen
    assert there > 1_200 and visited < 0.25 * there


def test_tree_holds_every_row_in_small_balls(spark, monkeypatch):
    v = np.vstack([blobs(5, 40, 0.2), np.repeat(blobs(1, 1, 0.1), 100, axis=0)])   # with more equal rows than a leaf holds
    tree = bl.plant(frame(spark, v, "id long, vec array<float>"), block=16, fan=3)
    assert sorted(r["id"] for r in tree.rows.collect()) == list(range(len(v)))
    ball = {r["block"]: (np.array(r["centre"]), r["radius"], r["size"]) for r in tree.leaves.collect()}
    assert max(size for *_, size in ball.values()) <= 16 and tree.depth >= 2
    rows = [(r["block"], np.array(r["vec"])) for r in tree.rows.collect()]
    assert all(np.linalg.norm(x - ball[b][0]) <= ball[b][1] + 1e-6 for b, x in rows)
    for d in range(tree.depth + 1):
        nodes = {r["node"]: (np.array(r["centre"]), r["radius"]) for r in tree.level(d).collect()}
        for b, x in rows:
            c, radius = nodes[".".join(b.split(".")[:d + 1])]
            assert np.linalg.norm(x - c) <= radius + 1e-6


def test_blocks_see_every_near_pair_and_skip_the_rest(spark, monkeypatch):
    v = blobs(40, 30, 0.03, dim=16)
    df = frame(spark, v, "id long, vec array<float>").withColumn("weight", F.lit(1))
    tree = bl.plant(df, block=32)
    pairs = bl.meeting(tree, tree, bl.within(sm.chord(0.9)))
    out = bl.near_blocks(tree.rows, tree.rows, pairs, lambda l, r: cl._count_near(l, r, 0.9), "id long, near long")
    have = {r["id"]: r["near"] for r in out.groupBy("id").agg(F.sum("near").alias("near")).collect()}
    assert have == dict(enumerate((sims(v) >= 0.9).sum(axis=1).tolist()))
    blocks = tree.leaves.count()
    assert blocks >= 38 and pairs.count() < 0.1 * blocks**2


def brute_greedy(v, priority, threshold):
    s, kept = sims(v), []
    for i in sorted(range(len(v)), key=lambda i: (-priority[i], i)):
        if not any(s[i, j] >= threshold for j in kept):
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("block, first", [(1024, 16), (20, 2)])
def test_greedy_removal(spark, block, first, monkeypatch):
    monkeypatch.setattr(bl, "BLOCK", block)
    monkeypatch.setattr(de, "FIRST", first)
    rng = np.random.default_rng(1)
    v = np.vstack([blobs(12, 12, 0.35), np.repeat(blobs(1, 1, 0.1), 60, axis=0), unit(rng.normal(size=(60, 8)))])
    priority = rng.integers(0, 5, len(v)).tolist()
    rows = [(i, priority[i], [float(x) for x in v[i]]) for i in range(len(v))]
    df = spark.createDataFrame(rows, "id long, p long, v array<float>").repartition(4)
    kept = greedy_keep(df, id_col="id", priority_col="p", vec_col="v", threshold=0.9)
    assert sorted(r["id"] for r in kept.collect()) == brute_greedy(v, priority, 0.9)


def test_greedy_is_not_transitive(spark):
    angle = np.deg2rad([0.0, 20.0, 40.0])  # neighbours similar, ends not
    v = np.c_[np.cos(angle), np.sin(angle)]
    rows = [(i, 1, [float(x) for x in v[i]]) for i in range(3)] + [(3, 1, [0.0, 0.0]), (4, 1, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, p long, v array<float>")
    kept = greedy_keep(df, id_col="id", priority_col="p", vec_col="v", threshold=0.92)
    assert sorted(r["id"] for r in kept.collect()) == [0, 2, 3, 4]


def brute_dbscan(v, eps, least):
    near = 1 - sims(v) <= eps + 1e-12
    core = near.sum(axis=1) >= least
    label, number = np.full(len(v), -1), 0
    for start in range(len(v)):
        if not core[start] or label[start] >= 0:
            continue
        open_rows = [start]
        label[start] = number
        while open_rows:
            i = open_rows.pop()
            for j in np.flatnonzero(near[i]):
                if label[j] < 0:
                    label[j] = number
                    if core[j]:
                        open_rows.append(j)
        number += 1
    return label.tolist()


def test_dbscan_equals_sequential_scan(spark, monkeypatch):
    monkeypatch.setattr(bl, "BLOCK", 25)
    rng = np.random.default_rng(9)
    v = np.vstack([blobs(5, 25, 0.3, dim=4), unit(rng.normal(size=(40, 4)))])
    v[10:14] = v[3]  # equal vectors
    v = v[rng.permutation(len(v))]
    have = {r["row_id"]: r["cluster_id"] for r in cl.dbscan(frame(spark, v), eps=0.03, min_samples=5).collect()}
    want = brute_dbscan(v, 0.03, 5)
    assert [have[i] for i in range(len(v))] == want
    assert len(set(want)) > 3 and -1 in want


def brute_average_linkage(v, k):
    groups = [[i] for i in range(len(v))]
    dist = 1 - v.astype(np.float64) @ v.astype(np.float64).T
    while len(groups) > k:
        best = min(
            (np.mean(dist[np.ix_(a, b)]), x, y)
            for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y
        )
        groups[best[1]] = groups[best[1]] + groups.pop(best[2])
    return sorted(sorted(g) for g in groups)


def test_average_linkage_equals_one_by_one_merging(spark):
    v = blobs(5, 8, 0.5)
    v[4] = v[2]
    out = cl.agglomerative(frame(spark, v), 6).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["cluster_id"], []).append(r["row_id"])
    assert sorted(sorted(g) for g in groups.values()) == brute_average_linkage(v, 6)
    assert [min(groups[c]) for c in sorted(groups)] == sorted(min(g) for g in groups.values())


def test_average_linkage_searches_only_where_neighbours_merged(spark):
    angle = 0.01 * 1.4 ** np.arange(12)   # each point is nearest to the one before: one merge a round
    v = unit(np.c_[np.cos(angle), np.sin(angle)])
    seen = []
    out = cl.agglomerative(frame(spark, v), 3, report=lambda groups, asked: seen.append((groups, asked))).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["cluster_id"], []).append(r["row_id"])
    assert sorted(sorted(g) for g in groups.values()) == brute_average_linkage(v, 3)
    assert seen[0] == (12, 12) and sum(asked for _, asked in seen) < 0.6 * sum(there for there, _ in seen)


def test_metrics_of_many_clusters_visit_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(bl, "BLOCK", 32)
    monkeypatch.setattr(sm, "RANK_BLOCK", 32)
    rng = np.random.default_rng(4)
    towns = np.repeat(unit(rng.normal(size=(30, 12))), 20, axis=0)
    centers = towns + rng.normal(scale=0.02, size=towns.shape)      # 600 clusters in 30 far groups
    v = unit(np.repeat(centers, 2, axis=0) + rng.normal(scale=0.004, size=(1_200, 12)))
    members = frame(spark, v).withColumn("cluster_id", F.floor(F.col("row_id") / 2))
    parts = v.reshape(600, 2, 12).astype(np.float64)
    means = parts.mean(axis=1)
    spread = np.linalg.norm(parts - means[:, None], axis=2).mean(axis=1)
    apart = np.sqrt(np.maximum(0, ((means[:, None] - means[None]) ** 2).sum(axis=2)))
    np.fill_diagonal(apart, np.inf)
    seen = []
    have = me.davies_bouldin(members, report=lambda *n: seen.append(n)).first()[0]
    assert have == pytest.approx(((spread[:, None] + spread[None]) / apart).max(axis=1).mean())
    assert me.silhouette(members, report=lambda *n: seen.append(n)).first()[0] > 0.5
    assert all(visited < 0.3 * there for there, visited in seen), seen


def two_blobs(n):
    rng = np.random.default_rng(7)
    return unit(np.vstack([rng.normal(1, 0.05, (n, 8)), rng.normal(-1, 0.05, (n, 8))]))


def test_kmeans_recovers_planted_groups(spark):
    df = frame(spark, two_blobs(30))
    groups = cl.cluster(df, "KMeans", n_clusters=2)
    members = df.join(groups, "row_id").cache()
    assert sorted(r["size"] for r in cl.cluster_sizes(members).collect()) == [30, 30]
    assert me.silhouette(members).first()[0] > 0.5
    assert cl.centroids(members).count() == 2
    assert {r["cluster_id"] for r in members.where("row_id < 30").collect()} == {0}


def test_method_dispatch(spark):
    df = frame(spark, two_blobs(3))
    with pytest.raises(ValueError):
        cl.cluster(df, "not-a-method")
    with pytest.raises(ValueError):
        cl.cluster(df.limit(1), "kmeans")


def test_choice_of_k():
    assert [cl.heuristic_k(n) for n in (1, 32, 100, 1100, 10**9)] == [4, 4, 7, 20, 20]
    assert cl.choose_k(10, 0, 3) == 3 and cl.choose_k(3, 50) == 2 and cl.choose_k(2) == 2


def test_metrics_leave_noise_out_and_know_when_to_be_null(spark):
    v = two_blobs(3)
    df = frame(spark, v)
    one = df.withColumn("cluster_id", F.lit(0))
    assert me.silhouette(one).first()[0] is None and me.davies_bouldin(one).first()[0] is None
    alone = df.withColumn("cluster_id", F.col("row_id").cast("int"))
    assert me.silhouette(alone).first()[0] is None
    assert me.intra_similarity(alone).first()[0] == 0.0
    noisy = df.withColumn("cluster_id", F.when(F.col("row_id") == 5, -1).when(F.col("row_id") < 3, 0).otherwise(1))
    clean = noisy.where("cluster_id >= 0")
    for metric in (me.silhouette, me.davies_bouldin, me.intra_similarity, me.n_clusters):
        assert metric(noisy).first()[0] == pytest.approx(metric(clean).first()[0])


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()
    assert {(r["node"], r["component"]) for r in out} == {(i, 0) for i in range(61)} | {(i, 100) for i in range(100, 160)}


def test_numbers_follow_the_order(spark):
    values = ["b", "a", "d", "c", "a"]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(3)
    assert {r["v"]: r["n"] for r in number_in_order(df, "v", "n").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_null_vectors_stay_null(spark):
    from mailmine.functions import vectors as vc

    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0]), (4, None)], "i int, v array<double>").coalesce(1)
    found = rows.select("i", vc.dot("v", "v").alias("d"), vc.squared_norm("v").alias("s"), vc.distance("v", "v").alias("z"), vc.l2_normalize("v").alias("u"))
    found = {r["i"]: tuple(r)[1:] for r in found.collect()}
    assert found[1] == (25.0, 25.0, 0.0, [0.6, 0.8]) and found[3] == (0.0, 0.0, 0.0, [0.0, 0.0])
    assert found[2] == found[4] == (None,) * 4
    uneven = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>").coalesce(1)
    with pytest.raises(Exception, match="lengths"):
        uneven.select(vc.dot("v", "v")).collect()


def test_match_gives_as_many_as_asked(spark):
    from mailmine.operators import match as mt

    templates = spark.createDataFrame([(i, f"subject {i}", f"body of w{i}") for i in range(14)], "cluster_id long, subject_template string, body_template string")
    mails = spark.createDataFrame([(1, "subject 3", "body of w3")], "row_id long, subject string, body string")
    found = mt.match(mails, mt.encode_templates(templates), top_k=10).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 11)) and found[0]["cluster_id"] == 3


def test_average_linkage_of_few_groups_needs_no_distributed_rounds(spark, monkeypatch):
    searches, search = [], cl._nearest_groups
    monkeypatch.setattr(cl, "_nearest_groups", lambda *a: searches.append(1) or search(*a))
    angle = 0.01 * 1.4 ** np.arange(12)   # one merge a round
    chain = unit(np.c_[np.cos(angle), np.sin(angle)])
    cl.agglomerative(frame(spark, chain), 3).collect()
    assert not searches
    v = blobs(4, 10, 0.6)
    whole = sorted(map(tuple, cl.agglomerative(frame(spark, v), 5).collect()))
    assert not searches
    for last in (1, 12):   # all rounds, and the first ones, on tables
        monkeypatch.setattr(cl, "LAST_GROUPS", last)
        assert sorted(map(tuple, cl.agglomerative(frame(spark, v), 5).collect())) == whole
    assert searches


def test_best_target_is_found_without_rounding_all_products(monkeypatch):
    monkeypatch.setattr(sm, "SCORES", 64)
    rng = np.random.default_rng(5)
    queries, targets = unit(rng.normal(size=(50, 4))), unit(rng.normal(size=(30, 4)))
    targets[20:] = targets[:10] + rng.normal(scale=1e-12, size=(10, 4))   # equal after rounding
    queries[:10] = targets[:10]
    hide = np.where(np.arange(50) % 3 == 0, np.arange(50) % 30, -1)
    scores = sm.similarities(queries, targets)
    scores[np.flatnonzero(hide >= 0), hide[hide >= 0]] = -np.inf
    place, sim = sm.closest_rows(queries, targets, hide)
    assert (place == scores.argmax(axis=1)).all() and (sim == scores.max(axis=1)).all()
    place, sim = sm.closest_rows(queries[:1], targets[:1], np.array([0]))
    assert sim[0] == -np.inf
