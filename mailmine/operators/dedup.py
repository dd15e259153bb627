"""Greedy near-duplicate removal, equal to the sequential rule on any number of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailmine.functions import lexicon as lx
from mailmine.functions.vectors import squared_norm
from mailmine.operators.balls import meeting, near_blocks, pieces, plant, stack, within
from mailmine.operators.similarity import chord, near
from mailmine.session import cut_lineage

FIRST = 64   # rows of a block that are candidates in the first round
FASTER = 4   # times as many in each further one


def _hits(l: pd.DataFrame, r: pd.DataFrame, threshold: float, earlier: bool) -> pd.DataFrame:
    here, there = stack(l["vec"]), stack(r["vec"])
    lp, li, rp, ri = (side[c].to_numpy() for side in (l, r) for c in ("priority", "id"))
    found = np.zeros(len(l), bool)
    for own, part in pieces(len(l), len(r), lambda rows: found[rows]):
        hit = near(here[own], there[part], threshold)
        if earlier:
            p, i = lp[own, None], li[own, None]
            hit &= (rp[part] > p) | ((rp[part] == p) & (ri[part] < i))
        found[own] = hit.any(axis=1)
    return pd.DataFrame({"id": li[found]})


def greedy_keep(items: DataFrame, *, id_col: str, priority_col: str, vec_col: str,
                threshold: float = lx.DUPLICATE_SIMILARITY) -> DataFrame:
    """Ids of the items kept when they are taken by descending priority (ties: ascending id)
    and each is dropped if it is at least ``threshold`` similar to an item already kept.

    1. Equal vectors: only the first of them can be kept, so the rest go first.
    2. The others are planted in blocks, and only blocks whose balls come within the radius meet.
    3. Rounds: of each block's undecided items the first few are candidates. A candidate without
       an earlier undecided neighbour in any block is kept, and what is near it is dropped. Few
       candidates make dense regions vanish cheaply; their number grows from round to round, so
       sparse blocks do not take many. Only flags per item are written, never pairs.
    """

    source = items.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(priority_col).cast("long").alias("priority"),
        F.col(vec_col).alias("vec"),
    )
    source = cut_lineage(source.withColumn("norm", squared_norm("vec")))
    blank = F.col("norm") == 0
    # a zero vector resembles nothing, not even itself
    kept = source.where(blank).select("id")
    first = F.max(F.struct("priority", (-F.col("id")).alias("minus_id"))).alias("first")
    distinct = source.where(~blank).groupBy("vec").agg(first)
    distinct = distinct.select((-F.col("first.minus_id")).alias("id"), F.col("first.priority").alias("priority"), "vec")
    tree = plant(distinct)
    pairs = cut_lineage(meeting(tree, tree, within(chord(threshold))))
    # a block never holds more than a leaf may: its order is a small window
    place = F.row_number().over(Window.partitionBy("block").orderBy(F.col("priority").desc(), "id"))
    undecided, candidates = tree.rows, FIRST
    while undecided.limit(1).count():
        heads = cut_lineage(undecided.withColumn("place", place).where(F.col("place") <= candidates).drop("place"))
        blocked = near_blocks(heads, undecided, pairs, lambda l, r: _hits(l, r, threshold, True), "id long", tiles=True)
        fresh = cut_lineage(heads.join(blocked.distinct(), "id", "left_anti"))
        kept = kept.unionByName(fresh.select("id"))
        waiting = undecided.join(fresh.select("id"), "id", "left_anti")
        dropped = near_blocks(fresh, waiting, pairs, lambda l, r: _hits(r, l, threshold, False), "id long", tiles=True)
        undecided = cut_lineage(waiting.join(dropped.distinct(), "id", "left_anti"))
        candidates *= FASTER
    return kept.select(F.col("id").alias(id_col))
