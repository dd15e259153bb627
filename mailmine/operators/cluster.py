"""Clustering unit vectors: k-means, average linkage, density.

Every method returns ``assignments(row_id, cluster_id)``; cluster numbers follow
the smallest row id of a cluster, noise is -1.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailmine.functions import lexicon as lx
from mailmine.functions.vectors import l2_normalize, scaled, sum_vector
from mailmine.operators import balls
from mailmine.operators.balls import near_blocks, stack
from mailmine.operators.components import connected_components, number_in_order
from mailmine.operators.similarity import chord, closest_rows, collapse_equal, near, rank_targets
from mailmine.session import cut_lineage, scratch_path

WITNESSES = 32   # rows of a component of a block that speak for it at first
LAST_GROUPS = 1 << 15   # groups of average linkage, as sums of 64 numbers about 16 MB, that one task merges to the end

METHODS = ("kmeans", "agglomerative", "dbscan")


BOUNDS = (lx.MIN_CLUSTERS, lx.MAX_CLUSTERS)


def heuristic_k(n: int, bounds: tuple[int, int] = BOUNDS) -> int:
    """About sqrt(n / 2), between two bounds; give a higher upper one for large tables."""

    return int(min(bounds[1], max(bounds[0], round(math.sqrt(max(n, 4) / 2)))))


def choose_k(n: int, requested: int | None = None, configured: int | None = None, bounds: tuple[int, int] = BOUNDS) -> int:
    """Requested, else configured, else heuristic; zero counts as not given."""

    k = requested or configured or heuristic_k(n, bounds)
    return max(2, min(k, max(2, n - 1)))


def _numbered(grouped: DataFrame) -> DataFrame:
    """Replace group keys by 0, 1, ... in order of each group's smallest row id."""

    first = grouped.groupBy("group").agg(F.min("row_id").alias("first_row"))
    first = cut_lineage(first)
    numbers = number_in_order(first, "first_row", "cluster_id")
    named = cut_lineage(first.join(numbers, "first_row").select("group", "cluster_id"))
    return grouped.join(named, "group").select("row_id", "cluster_id")


def kmeans(vectors: DataFrame, k: int, seed: int = lx.RANDOM_STATE, start: str = "k-means||") -> DataFrame:
    """Euclidean k-means on unit vectors.

    Fitted on the distinct vectors with their counts as weights: the same objective
    over fewer points, and copies can not crowd out the starting centres. There are never
    more clusters than distinct vectors. ``start`` is the way of choosing the first centres.
    """

    rows = vectors.select("row_id", "embedding")
    distinct = collapse_equal(rows, "row_id", "embedding")
    k = min(k, distinct.count())
    if k < 2:  # nothing to divide
        return rows.select("row_id", F.lit(0).cast("bigint").alias("cluster_id"))
    points = distinct.select("weight", array_to_vector("vec").alias("features")).persist()
    try:
        model = KMeans(k=k, seed=seed, maxIter=50, initMode=start, weightCol="weight").fit(points)
    finally:
        points.unpersist()
    labelled = model.transform(rows.select("row_id", array_to_vector("embedding").alias("features")))
    return _numbered(cut_lineage(labelled.select("row_id", F.col("prediction").alias("group"))))


# --- average linkage --------------------------------------------------------------------

def _nearest_groups(state: DataFrame, asking: DataFrame) -> DataFrame:
    """(id, other, similarity): the nearest other group of each group in ``asking``."""

    mean = scaled(F.col("total"), 1 / F.col("size"))
    goals = state.select(F.col("id").alias("other"), mean.alias("mean"))
    rows = asking.select("id", F.col("id").alias("own"), mean.alias("mean"))
    best = rank_targets(rows, goals, 1, query_id="id", query_vec="mean", target_id="other", target_vec="mean", skip="own")
    return cut_lineage(best.select("id", "other", "similarity"))


def _merge_rounds(groups: pd.DataFrame) -> pd.DataFrame:
    """The merges of ``agglomerative`` from these groups (id, size, total) down to one, by the same rounds.

    Of each round also how many groups there were and how many of them searched. A round that merges two or three
    of thousands, as where a few large groups take in one neighbour after the other, costs milliseconds.
    """

    groups = groups.sort_values("id", ignore_index=True)
    ids, size, total = groups["id"].to_numpy(), groups["size"].to_numpy(np.int64), stack(groups["total"])
    mean = total * (1 / size)[:, None]
    alive, other, sim = np.ones(len(ids), bool), np.full(len(ids), -1), np.zeros(len(ids))
    asking, found = np.arange(len(ids)), []
    while (there := int(alive.sum())) > 1:
        if there < 0.8 * len(alive):   # the merged ones are passed over, until they are many
            place = np.cumsum(alive) - 1
            asking = place[asking]
            ids, size, total, mean, sim = (x[alive] for x in (ids, size, total, mean, sim))
            other, alive = place[other[alive]], np.ones(there, bool)
        other[asking], sim[asking] = closest_rows(mean[asking], mean, asking, ~alive)
        left = np.flatnonzero(alive)
        a = left[(other[other[left]] == left) & (left < other[left])]
        b = other[a]
        if not len(a):  # rounding made the relation one-sided: the best pair alone
            best = left[sim[left].argmax()]
            a, b = np.array([min(best, other[best])]), np.array([max(best, other[best])])
            sim[a] = sim[best]
        height = np.maximum(0.0, 1.0 - sim[a])
        found.append(pd.DataFrame({"a": ids[a], "b": ids[b], "height": height, "groups": there, "asked": len(asking)}))
        total[a] += total[b]
        size[a] += size[b]
        mean[a] = total[a] * (1 / size[a])[:, None]
        alive[b] = False
        gone = np.zeros(len(alive), bool)
        gone[a] = gone[b] = True
        asking = np.flatnonzero(alive & (gone | gone[other]))
    return pd.concat(found)   # two groups at least came in


def agglomerative(vectors: DataFrame, k: int, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """Average-linkage clustering by cosine distance, cut at ``k`` clusters. Exact.

    For unit vectors the average distance of two groups is one minus the dot product
    of their means, so a group is its vector sum and its size. Every round merges all
    pairs of groups that are each other's nearest, the ends of all nearest-neighbour chains at once
    (average linkage allows that), and the recorded heights decide the cut, as in one-by-one
    merging. Equal vectors merge first, at height zero.

    Nearest neighbours are kept from round to round: a merged group is never closer to
    another one than the closer of its parts was, so only new groups and those whose neighbour
    has merged search again, and a search visits only blocks that can hold the nearest. As soon as no more than
    ``LAST_GROUPS`` groups are left, a bounded number whatever the input, one task goes on with the same rounds:
    without clear groups in the data thousands of rounds follow that merge two or three pairs each.
    ``report`` is told the groups of each round and how many of them searched.
    """

    rows = vectors.select(F.col("row_id").alias("id"), F.col("embedding").alias("vec"))
    distinct = collapse_equal(rows, "id", "vec")
    copies = rows.join(distinct.select("vec", F.col("id").alias("keep")), "vec").where("id <> keep")
    spark, tree_path = vectors.sparkSession, scratch_path(vectors.sparkSession, "merges")
    merged = copies.select(F.col("keep").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("height"))
    merged.write.parquet(tree_path)
    tree_schema = spark.read.parquet(tree_path).schema
    n = rows.count()
    total = scaled(F.col("vec"), F.col("weight"))
    state = cut_lineage(distinct.select("id", F.col("weight").alias("size"), total.alias("total")))
    groups = state.count()
    done = n - groups
    asking, known = state, None

    while groups > 1:
        if groups <= LAST_GROUPS:
            last = state.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_merge_rounds, "a long, b long, height double, groups long, asked long")
            last = cut_lineage(last)
            if report:
                for r in last.select("groups", "asked").distinct().orderBy(F.col("groups").desc()).collect():
                    report(r["groups"], r["asked"])
            last.select("a", "b", "height").write.mode("append").parquet(tree_path)
            done += groups - 1
            break
        fresh = _nearest_groups(state, asking)
        nearest = fresh if known is None else cut_lineage(known.unionByName(fresh))
        if report:
            report(groups, fresh.count())
        back = nearest.select(F.col("id").alias("other"), F.col("other").alias("id"))
        height = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("similarity")).alias("height")
        pairs = nearest.join(back, ["id", "other"]).where("id < other")
        pairs = cut_lineage(pairs.select(F.col("id").alias("a"), F.col("other").alias("b"), height))
        found, lowest = pairs.agg(F.count("*"), F.min("height")).first()
        if not found:  # rounding made the relation one-sided: take the best pair alone
            best = nearest.orderBy(F.col("similarity").desc(), "id").limit(1)
            low, high = F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")
            pairs = cut_lineage(best.select(low, high, height))
            found, lowest = pairs.agg(F.count("*"), F.min("height")).first()
        if done >= n - k:
            # merges below the nearest pair of this round can not be undercut any more
            recorded = spark.read.schema(tree_schema).parquet(tree_path)
            if recorded.where(F.col("height") <= lowest).count() >= n - k:
                break
        pairs.write.mode("append").parquet(tree_path)
        target = pairs.select(F.col("b").alias("id"), "a")
        moved = state.join(target, "id", "left").withColumn("id", F.coalesce("a", "id")).drop("a")
        sums = sum_vector(F.col("total")).alias("total")
        state = cut_lineage(moved.groupBy("id").agg(F.sum("size").alias("size"), sums))
        gone = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        known = nearest.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "other"), "other", "left_anti")
        known = cut_lineage(known.select("id", "other", "similarity"))
        asking = state.join(known.select("id"), "id", "left_anti")
        groups -= found
        done += found

    tree = spark.read.schema(tree_schema).parquet(tree_path)
    extra = done - (n - k)  # at most k - 1 merges lie above the cut
    if extra > 0:
        above = tree.orderBy(F.col("height").desc(), F.col("b").desc()).limit(extra).select("a", "b")
        tree = tree.join(above, ["a", "b"], "left_anti")
    linked = connected_components(tree.select("a", "b"))
    grouped = rows.select(F.col("id").alias("row_id")).join(
        linked.withColumnRenamed("node", "row_id"), "row_id", "left"
    )
    grouped = grouped.select("row_id", F.coalesce("component", "row_id").alias("group"))
    return _numbered(cut_lineage(grouped))


# --- density ------------------------------------------------------------------------------

def _count_near(l: pd.DataFrame, r: pd.DataFrame, floor: float, enough: float = np.inf) -> pd.DataFrame:
    """Weight of the right rows near each left row; counting stops at ``enough``."""

    here, there, weight = stack(l["vec"]), stack(r["vec"]), r["weight"].to_numpy(np.float64)
    counts = np.zeros(len(l))
    for own, part in balls.pieces(len(l), len(r), lambda rows: counts[rows] >= enough):
        counts[own] += near(here[own], there[part], floor).astype(np.float64) @ weight[part]
    some = counts > 0
    return pd.DataFrame({"id": l["id"].to_numpy()[some], "near": counts[some].astype(np.int64)})


def _near_rows(l: pd.DataFrame, r: pd.DataFrame, floor: float) -> np.ndarray:
    here, there = stack(l["vec"]), stack(r["vec"])
    hit = np.empty((len(l), len(r)), bool)
    for own, part in balls.pieces(len(l), len(r)):
        hit[own[0]:own[-1] + 1, part] = near(here[own], there[part], floor)
    return hit


def _lowest(hit: np.ndarray, l_ids: np.ndarray, r_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each left and each right row is connected to; a row is visited once."""

    l_low, r_low, back = l_ids.copy(), r_ids.copy(), np.ascontiguousarray(hit.T)
    l_open, r_open = hit.any(axis=1), np.ones(len(r_ids), bool)
    for first in np.flatnonzero(l_open):
        if not l_open[first]:
            continue
        front, lefts, rights = np.array([first]), [], []
        while len(front):
            l_open[front] = False
            lefts.append(front)
            reached = np.flatnonzero(hit[front].any(axis=0) & r_open)
            r_open[reached] = False
            rights.append(reached)
            front = np.flatnonzero(back[reached].any(axis=0) & l_open)
        own, other = np.concatenate(lefts), np.concatenate(rights)
        l_low[own] = r_low[other] = min(l_ids[own].min(), r_ids[other].min())
    return l_low, r_low


def _local_links(l: pd.DataFrame, r: pd.DataFrame, floor: float, key: str = "id") -> pd.DataFrame:
    """Edges that connect what is connected inside the two blocks: a forest, not all pairs."""

    l_ids, r_ids = l[key].to_numpy(), r[key].to_numpy()
    ids, low = np.concatenate([l_ids, r_ids]), np.concatenate(_lowest(_near_rows(l, r, floor), l_ids, r_ids))
    linked = ids != low
    return pd.DataFrame({"a": ids[linked], "b": low[linked]}).drop_duplicates()


def _forest(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """The same connections as the edges give, one edge a node at most: to the smallest node of its component."""

    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, low = ends[:len(a)], ends[len(a):], np.arange(len(ids))
    while True:
        least = np.minimum(low[a], low[b])
        root = low.copy()
        np.minimum.at(root, low[a], least)
        np.minimum.at(root, low[b], least)
        while (root != (up := root[root])).any():
            root = up
        if (root == low).all():
            linked = low != np.arange(len(ids))
            return pd.DataFrame({"a": ids[linked], "b": ids[low[linked]]})
        low = root


def _group_links(l: pd.DataFrame, r: pd.DataFrame, floor: float, key: str = "id") -> pd.DataFrame:
    """``_local_links`` for any number of rows, a block of each side at a time."""

    found = [_local_links(l[i:i + balls.BLOCK], r[j:j + balls.BLOCK], floor, key)
             for i in range(0, len(l), balls.BLOCK) for j in range(0, len(r), balls.BLOCK)]
    edges = pd.concat(found) if len(found) > 1 else found[0]
    return _forest(edges["a"].to_numpy(np.int64), edges["b"].to_numpy(np.int64)) if len(found) > 1 else edges


def _lowest_core(l: pd.DataFrame, r: pd.DataFrame, floor: float) -> pd.DataFrame:
    r = r.sort_values("component", ignore_index=True)     # the first that is near has the lowest
    here, there, lowest = stack(l["vec"]), stack(r["vec"]), r["component"].to_numpy()
    best = np.full(len(l), -1)
    for own, part in balls.pieces(len(l), len(r), lambda rows: best[rows] >= 0):
        hit = near(here[own], there[part], floor)
        first = hit.argmax(axis=1)
        best[own] = np.where(hit[np.arange(len(own)), first], part.start + first, -1)
    any_near = best >= 0
    return pd.DataFrame({"id": l["id"].to_numpy()[any_near], "component": lowest[best[any_near]]})


def _merged(placed: DataFrame, links: DataFrame) -> DataFrame:
    """``placed`` with the components that ``links`` connect made one."""

    joined = connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("now"))
    placed = placed.join(joined, "component", "left").withColumn("component", F.coalesce("now", "component"))
    return cut_lineage(placed.drop("now"))


def _core_components(core_rows: DataFrame, pairs: DataFrame, floor: float) -> DataFrame:
    """``core_rows`` with their ``component``, the smallest id reachable over near rows.

    Rows of a block are linked first, then blocks by a few witnesses of each component. What is linked already
    need not be compared: a link still missing has an end outside the largest component, so only rows
    there search, and only in pairs of blocks that hold different components.
    """

    def links(l: DataFrame, r: DataFrame, which: DataFrame, key: str) -> DataFrame:
        return near_blocks(l, r, which, lambda x, y: _group_links(x, y, floor, key), "a long, b long", tiles=True)

    placed = core_rows.withColumn("component", F.col("id"))
    placed = _merged(placed, links(core_rows, core_rows, pairs.where("lb = rb"), "id"))
    across = pairs.where("lb < rb")
    if not across.limit(1).count():
        return placed
    place = F.row_number().over(Window.partitionBy("block", "component").orderBy(F.xxhash64("id"), "id"))
    some = cut_lineage(placed.withColumn("place", place).where(F.col("place") <= WITNESSES).drop("place"))
    placed = _merged(placed, links(some, some, across, "component"))
    sizes = cut_lineage(placed.groupBy("component").agg(F.count("*").alias("n")))
    largest = sizes.orderBy(F.col("n").desc(), "component").first()
    total = sizes.agg(F.sum("n")).first()[0]
    if largest is None or largest["n"] == total:
        return placed
    few = 2 * largest["n"] > total
    asking = cut_lineage(placed.where(F.col("component") != largest["component"])) if few else placed

    def ends(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy(F.col("block").alias(f"{side}b")).agg(F.min("component").alias(f"{side}_low"), F.max("component").alias(f"{side}_high"))

    met = (pairs.where("lb <> rb") if few else across).join(ends(asking, "l"), "lb").join(ends(placed, "r"), "rb")
    open_pairs = cut_lineage(met.where(F.least("l_low", "r_low") < F.greatest("l_high", "r_high")).select("lb", "rb"))
    return _merged(placed, links(asking, placed, open_pairs, "component"))


def dbscan(vectors: DataFrame, eps: float = lx.DBSCAN_EPS, min_samples: int = lx.DBSCAN_MIN_SAMPLES) -> DataFrame:
    """Density clustering by cosine distance. Exact; border rows join the earliest cluster.

    Equal vectors count as one with a weight. Degrees, links and borders go over the
    pairs of blocks whose balls come within the radius; a pass writes a count, a forest or a minimum
    per group of blocks, never the pairs of rows. Rows with enough neighbours in their own block are core without
    a look at other blocks; components are searched only where they can still grow together.
    """

    floor = 1.0 - eps
    rows = vectors.select(F.col("row_id").alias("id"), F.col("embedding").alias("vec"))
    distinct = collapse_equal(rows, "id", "vec")
    tree = balls.plant(distinct)
    pairs = cut_lineage(balls.meeting(tree, tree, balls.within(chord(floor))))
    floor -= 1e-12

    def dense(asking: DataFrame, which: DataFrame, tiles: bool) -> DataFrame:
        counted = near_blocks(asking, tree.rows, which, lambda l, r: _count_near(l, r, floor, min_samples), "id long, near long", tiles)
        enough = counted.groupBy("id").agg(F.sum("near").alias("near")).where(F.col("near") >= min_samples)
        return cut_lineage(enough.select("id"))

    core = dense(tree.rows, pairs.where("lb = rb"), False)
    if tree.depth:
        core = core.unionByName(dense(cut_lineage(tree.rows.join(core, "id", "left_anti")), pairs, True))
    core_rows = cut_lineage(tree.rows.join(core, "id", "left_semi"))
    labelled = _core_components(core_rows, pairs, floor)
    cores = labelled.select("id", "component")

    others = cut_lineage(tree.rows.join(core, "id", "left_anti"))
    border = near_blocks(others, labelled, pairs, lambda l, r: _lowest_core(l, r, floor), "id long, component long", tiles=True)
    border = border.groupBy("id").agg(F.min("component").alias("component"))
    found = cut_lineage(cores.unionByName(border))

    # clusters are numbered by their first core row
    numbers = number_in_order(cores.select("component").distinct(), "component", "cluster_id")
    by_vector = distinct.select("id", "vec").join(found.join(numbers, "component"), "id", "left")
    by_vector = by_vector.select("vec", F.coalesce("cluster_id", F.lit(lx.NOISE)).alias("cluster_id"))
    return cut_lineage(rows.join(by_vector, "vec").select(F.col("id").alias("row_id"), "cluster_id"))


def cluster(vectors: DataFrame, method: str = "kmeans", n_clusters: int | None = None,
            configured: int | None = None, seed: int = lx.RANDOM_STATE, bounds: tuple[int, int] = BOUNDS) -> DataFrame:
    """Cluster ``vectors(row_id, embedding)`` by the named method."""

    name = method.lower()
    if name not in METHODS:
        raise ValueError(f"{method!r} is none of {', '.join(METHODS)}")
    n = vectors.count()
    if n < 2:
        raise ValueError(f"{n} vectors make no clusters")
    if name == "dbscan":
        return dbscan(vectors)
    k = choose_k(n, n_clusters, configured, bounds)
    return kmeans(vectors, k, seed) if name == "kmeans" else agglomerative(vectors, k)


# --- centroids ----------------------------------------------------------------------------

def without_noise(df: DataFrame) -> DataFrame:
    return df.where(F.col("cluster_id") != lx.NOISE)


def cluster_sums(members: DataFrame) -> DataFrame:
    """``cluster_id, size, total`` of ``members(cluster_id, embedding)``, noise left out."""

    sums = without_noise(members).groupBy("cluster_id")
    return sums.agg(F.count("*").alias("size"), sum_vector(F.col("embedding")).alias("total"))


def centroids(members: DataFrame) -> DataFrame:
    """Mean vector per cluster, scaled to unit length."""

    return cluster_sums(members).select("cluster_id", "size", l2_normalize("total").alias("centroid"))


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    return without_noise(assignments).groupBy("cluster_id").agg(F.count("*").alias("size"))


def cluster_labels(assignments: DataFrame) -> DataFrame:
    """The cluster numbers in use, ascending, noise left out."""

    return without_noise(assignments).select("cluster_id").distinct().orderBy("cluster_id")
