"""Exact similarity search between vector tables.

``rank_targets`` compares each query with the targets that can be among its best ``k``. Up to one
block of targets (RANK_BLOCK rows) is handed to every task and queries pass by it. More targets
are planted as a ball tree, and so are the queries: a first pass compares each block of
queries with the few most promising blocks of targets, which sets a floor per query; a second one
visits only those blocks whose bound reaches the floor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mailmine.functions.vectors import SIM_DIGITS, matrix
from mailmine.operators import balls
from mailmine.operators.balls import stack
from mailmine.session import cut_lineage

RANK_BLOCK = 8192  # queries and targets of a block: larger than for pairs, so that few copies are dealt where bounds rule out little
STRIP = 1024  # targets compared at a time inside a task
SCORES = 1 << 22  # products held at a time where only the best target is wanted
GUESSES = 2   # blocks of targets that the first pass visits for each block of queries


def similarities(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.round(np.clip(left @ right.T, -1.0, 1.0), SIM_DIGITS)


@lru_cache
def _cutoff(threshold: float) -> float:
    """The smallest number that ``similarities`` rounds to at least ``threshold``."""

    if not -1.0 < threshold <= 1.0:
        return np.inf if threshold > 1.0 else -np.inf
    low, high = np.float64(threshold - 1e-8), np.float64(threshold + 1e-8)
    while np.nextafter(low, 2.0) < high:
        middle = (low + high) / 2
        low, high = (low, middle) if np.round(middle, SIM_DIGITS) >= threshold else (middle, high)
    return float(high)


def near(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """``similarities(left, right) >= threshold``, without rounding each of them."""

    return left @ right.T >= _cutoff(threshold)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores per row, ties by position."""

    if k >= scores.shape[1] or scores.shape[1] <= 64:
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    if k == 1:
        return scores.argmax(axis=1)[:, None]
    floor = np.partition(scores, -k, axis=1)[:, -k]
    rows = []
    for row, low in zip(scores, floor):
        seen = np.flatnonzero(row >= low)
        rows.append(seen[np.argsort(-row[seen], kind="stable")[:k]])
    return np.array(rows)


def closest_rows(queries: np.ndarray, targets: np.ndarray, hide: np.ndarray | None = None,
                 out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Position and similarity of each query's best target; ties after rounding go to the smaller position.

    Only what lies within rounding of a query's largest product is rounded. ``hide`` holds a position per query
    to skip (-1: none), ``out`` marks targets that no query may have.
    """

    best, sims = np.empty(len(queries), np.int64), np.empty(len(queries))
    step = max(1, SCORES // max(1, len(targets)))
    for start in range(0, len(queries), step):
        scores = queries[start : start + step] @ targets.T
        if out is not None:
            scores[:, out] = -np.inf
        if hide is not None:
            own = hide[start : start + step]
            scores[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
        highest = np.minimum(scores.max(axis=1), 1.0)
        rows, cols = np.nonzero(scores >= (highest - 2 * 10.0**-SIM_DIGITS)[:, None])
        near_best = np.round(np.clip(scores[rows, cols], -1.0, 1.0), SIM_DIGITS)
        near_best[~np.isfinite(scores[rows, cols])] = -np.inf
        first = np.searchsorted(rows, np.arange(len(scores)))
        top = np.maximum.reduceat(near_best, first)
        equal = np.flatnonzero(near_best == top[rows])
        equal = equal[np.searchsorted(rows[equal], np.arange(len(scores)))]
        best[start : start + step], sims[start : start + step] = cols[equal], top
    return best, sims


def _top(queries: np.ndarray, targets: np.ndarray, k: int, hide: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Best k targets per query, strip by strip. ``hide`` holds one position per query to skip."""

    if k == 1 and len(targets):
        pos, sim = closest_rows(queries, targets, hide)
        return pos[:, None], sim[:, None]
    best_pos = np.empty((len(queries), 0), dtype=np.int64)
    best_sim = np.empty((len(queries), 0))
    for start in range(0, len(targets), STRIP):
        strip = similarities(queries, targets[start : start + STRIP])
        if hide is not None:
            inside = np.flatnonzero((hide >= start) & (hide < start + strip.shape[1]))
            strip[inside, hide[inside] - start] = -np.inf
        # earlier strips hold smaller positions, so a stable order keeps the tie rule
        both_sim = np.hstack([best_sim, strip])
        both_pos = np.hstack([best_pos, np.broadcast_to(np.arange(start, start + strip.shape[1]), strip.shape)])
        pick = _best(both_sim, k)
        best_sim = np.take_along_axis(both_sim, pick, axis=1)
        best_pos = np.take_along_axis(both_pos, pick, axis=1)
    return best_pos, best_sim


def _positions(ids: list, wanted: list) -> np.ndarray:
    at = {v: i for i, v in enumerate(ids)}
    return np.array([at.get(v, -1) for v in wanted], dtype=np.int64)


def rank_targets(queries: DataFrame, targets: DataFrame, k: int, *, query_id: str, query_vec: str,
                 target_id: str, target_vec: str, keep: tuple[str, ...] = (), skip: str | None = None,
                 report: Callable[[int, int], None] | None = None) -> DataFrame:
    """The ``k`` most similar targets of every query: query id, kept columns, target id, similarity, rank.

    Ties go to the smaller target id. ``skip`` names a query column with the id of
    a target to leave out (its own row, its own cluster). Target ids are unique. ``report`` is
    told how many pairs of blocks there are, and how many were visited.
    """

    names = list(dict.fromkeys([query_id, *keep, *([skip] if skip else [])]))
    queries = queries.select(*names, F.col(query_vec).alias("__vec"))
    targets = cut_lineage(targets.select(F.col(target_id).alias("__tid"), F.col(target_vec).alias("__tvec")))
    kept = [f for f in queries.schema.fields if f.name in (query_id, *keep)]
    schema = T.StructType([*kept, T.StructField(target_id, targets.schema["__tid"].dataType), T.StructField("similarity", T.DoubleType()),
                           T.StructField("rank", T.IntegerType())])

    n_targets = targets.count()
    if not n_targets:
        return queries.sparkSession.createDataFrame([], schema)
    if n_targets > RANK_BLOCK:
        return _rank_by_balls(queries, targets, k, skip, target_id, schema, report)
    if report:
        report(1, 1)
    found = targets.toPandas().sort_values("__tid", ignore_index=True)  # one block
    tids, goal = list(found["__tid"]), stack(found["__tvec"])
    id_values = pa.Array.from_pandas(found["__tid"])
    kept_names = [f.name for f in kept]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hide = _positions(tids, batch.column(skip).to_pylist()) if skip else None
            pos, sim = _top(matrix(batch.column("__vec")), goal, k, hide)
            good = np.isfinite(sim)
            rows, cols = np.nonzero(good)
            take = pa.array(rows)
            columns = [batch.column(n).take(take) for n in kept_names]
            columns.append(id_values.take(pa.array(pos[rows, cols])))
            columns.append(pa.array(sim[rows, cols]))
            columns.append(pa.array((cols + 1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept_names, target_id, "similarity", "rank"])

    return queries.mapInArrow(rank, schema)


def _compare(k: int, skip: str | None):
    """Kernel: the best ``k`` targets of a block for the queries of a block that can still gain from it."""

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("__tid", ignore_index=True)
        here, there = stack(q["__vec"]), stack(t["__tvec"])
        if "floor" in q:
            centre = there.mean(axis=0)
            radius = np.sqrt(((there - centre) ** 2).sum(axis=1).max())
            floor = q["floor"].to_numpy()
            may = here @ centre + np.linalg.norm(here, axis=1) * radius + balls.SLACK >= floor
            q, here, floor = q[may], here[may], floor[may]
        if not len(q):
            return pd.DataFrame({"__q": [], "__tid": [], "similarity": []})
        hide = _positions(list(t["__tid"]), list(q[skip])) if skip else None
        pos, sim = _top(here, there, k, hide)
        tids, good = t["__tid"].to_numpy(), np.isfinite(sim)
        if "floor" in q:
            # what only equals the floor must have a smaller id to take its place
            rows, cols = np.nonzero(good & (sim == floor[:, None]))
            late = ~(tids[pos[rows, cols]] < q["floor_tid"].to_numpy()[rows])
            good &= sim >= floor[:, None]
            good[rows[late], cols[late]] = False
        rows, cols = np.nonzero(good)
        return pd.DataFrame({"__q": q["__q"].to_numpy()[rows], "__tid": tids[pos[rows, cols]], "similarity": sim[rows, cols]})

    return run


def _rank_by_balls(queries: DataFrame, targets: DataFrame, k: int, skip: str | None, target_id: str, schema: T.StructType,
                   report: Callable[[int, int], None] | None) -> DataFrame:
    """``rank_targets`` for more targets than one block holds."""

    numbered = cut_lineage(queries.withColumn("__q", F.monotonically_increasing_id()))
    own = list(dict.fromkeys(["__q", *([skip] if skip else []), "__vec"]))
    q_tree = balls.plant(numbered.select(*own), "__q", "__vec", RANK_BLOCK)
    t_tree = balls.plant(targets, "__tid", "__tvec", RANK_BLOCK)
    found = f"__q long, __tid {targets.schema['__tid'].dataType.simpleString()}, similarity double"
    best = Window.partitionBy("__q").orderBy(F.col("similarity").desc(), "__tid")

    def top(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    guessed = balls.closest(q_tree, t_tree, GUESSES)
    first = cut_lineage(top(balls.near_blocks(q_tree.rows, t_tree.rows, guessed, _compare(k, skip), found)))
    # a query that has met k targets needs no worse ones; the others may still need any
    floors = first.where(F.col("rank") == k).select("__q", F.col("similarity").alias("floor"), F.col("__tid").alias("floor_tid"))
    rows = cut_lineage(q_tree.rows.join(floors, "__q", "left").withColumns({
        "floor": F.coalesce("floor", F.lit(-np.inf)), "floor_tid": F.coalesce("floor_tid", F.lit(0).cast(targets.schema["__tid"].dataType))}))
    lowest = rows.groupBy("block").agg(F.min("floor").alias("floor"))
    leaves = cut_lineage(q_tree.leaves.join(lowest, "block"))
    may = balls.meeting(replace(q_tree, rows=rows, leaves=leaves), t_tree, balls.above_floor())
    rest = cut_lineage(may.join(guessed, ["lb", "rb"], "left_anti"))
    if report:
        report(q_tree.leaves.count() * t_tree.leaves.count(), guessed.count() + rest.count())
    second = balls.near_blocks(rows, t_tree.rows, rest, _compare(k, skip), found)
    ranked = top(first.drop("rank").unionByName(second)).withColumnRenamed("__tid", target_id)
    kept = [n for n in schema.names if n not in (target_id, "similarity", "rank")]
    return numbered.select("__q", *kept).join(ranked, "__q").select(*schema.names)


def chord(similarity: float) -> float:
    """Distance of two unit vectors with the given cosine."""

    return float(np.sqrt(max(0.0, 2.0 - 2.0 * similarity)))


def collapse_equal(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """One row per distinct vector: its smallest id, and how many rows share it.

    Copies meet in a partial aggregate before the shuffle, so a vector shared by a
    third of all rows costs one row per task.
    """

    grouped = vectors.groupBy(F.col(vec_col).alias("vec")).agg(
        F.min(id_col).alias("id"), F.count("*").alias("weight")
    )
    return cut_lineage(grouped.select("id", "weight", "vec"))
