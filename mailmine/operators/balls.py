"""Blocks of near vectors, the balls around them, and joins of only those blocks that a bound lets meet.

``plant`` divides vectors top-down: a node with more rows than a leaf may hold is split around
centres of a sample of its rows, level by level, all nodes of a level in one distributed pass. A
leaf is a block of bounded size with the ball (centre, radius) around it; inner nodes are balls
around their leaves.

``meeting`` descends two such trees at once: pairs of nodes whose bound rules a match out
are dropped with all that is below them, and the pairs of leaves that remain are the only ones
whose rows are compared. ``near_blocks`` then hands each remaining pair of blocks to a kernel, so
a vector is copied once for each partner block that can match, and no list of pairs is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailmine.functions.vectors import distance, dot, scaled, squared_norm, sum_vector
from mailmine.session import cut_lineage

BLOCK = 4096      # rows of a leaf at most
FAN = 32          # children of a node at most; a node gets about one for each leaf its rows would fill
SAMPLED = 4       # sampled rows for each child
TOGETHER = 4096   # rows of partner blocks that meet a block in one task
TILE = 65536      # rows of a group of blocks at most, about, where groups meet
GROUPS = 8        # groups that a smaller table still has, so that pairs of them fill the slots
STRIP = 512       # rows of a group compared at a time
TASKS = 1 << 14   # tasks in which groups meet at most
PIECE = 2048      # with so many rows of another one: products that stay in the cache of a core
SALT_ROWS = 8192  # rows of a large node that one task splits
DEPTH = 12        # beyond it rows are too alike to be told apart by centres
SLACK = 1e-6      # for rounding in centres and radii
ROOT = "r"


def stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


@dataclass(frozen=True)
class BallTree:
    """Rows with their ``block``; per block ``size``, ``centre``, ``radius``; levels below the root."""

    rows: DataFrame
    leaves: DataFrame
    depth: int

    def level(self, d: int) -> DataFrame:
        """Balls of the nodes at depth ``d`` (leaves above it stay), with the node above and the leaves' bounds.

        Besides its ball a leaf may have ``floor`` and ``spread``: the lowest and the highest count for a node.
        """

        named = self.leaves.withColumn("node", F.substring_index("block", ".", d + 1))
        total = sum_vector(scaled(F.col("centre"), F.col("size").cast("double"))).alias("total")
        centres = named.groupBy("node").agg(F.sum("size").alias("n"), total)
        centres = centres.select("node", scaled(F.col("total"), 1 / F.col("n")).alias("middle"))
        bounds = [f for name, f in (("floor", F.min("floor")), ("spread", F.max("spread"))) if name in named.columns]
        names = [name for name in ("floor", "spread") if name in named.columns]
        balls = named.join(centres, "node").withColumn("reach", distance("centre", "middle") + F.col("radius"))
        found = balls.groupBy("node").agg(F.first("middle").alias("centre"), F.max("reach").alias("radius"),
                                          *(f.alias(n) for f, n in zip(bounds, names, strict=True)))
        return found.withColumns({"above": F.substring_index("node", ".", d), "norm": F.sqrt(squared_norm("centre"))})


def _centres(sample: np.ndarray, fan: int) -> np.ndarray:
    """Centres that divide a sample: far apart at first, then moved to the middle of what is nearest to them."""

    points = np.unique(sample, axis=0)
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(fan, len(points)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    centres = points[chosen]
    for _ in range(4):
        home = _nearest(points, centres)
        centres = np.stack([points[home == k].mean(axis=0) for k in np.unique(home)])
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2.0 * points @ centres.T).argmin(axis=1)


def _split(rows: DataFrame, large: DataFrame, id_col: str, vec_col: str, block: int, fan: int, depth: int) -> DataFrame:
    """Rows of the nodes in ``large`` with the child they belong to as their new ``block``."""

    names, schema = rows.columns, rows.schema
    slot = F.pmod(F.xxhash64(id_col, F.lit(depth)), F.lit(1 << 30))
    sized = rows.join(large, "block").withColumn("salt", F.pmod(F.xxhash64(id_col), F.ceil(F.col("size") / SALT_ROWS)).cast("int"))
    if depth > DEPTH:
        parts = F.ceil(2 * F.col("size") / block).cast("bigint")
        return sized.withColumn("block", F.concat_ws(".", "block", F.pmod(slot, parts))).select(*names)
    children = F.greatest(F.lit(2), F.least(F.lit(fan), F.ceil(F.col("size") / block))).cast("int")
    chosen = sized.where(slot.cast("double") * F.col("size") < children.cast("double") * (SAMPLED * (1 << 30)))
    salts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / SALT_ROWS).cast("int") - 1))
    pivots = chosen.select(F.col("block").alias("node"), F.col(id_col).alias("pivot"), F.col(vec_col).alias("at"), children.alias("children"), salts.alias("slice"))

    def divide(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty:
            return l[names]
        centres = _centres(stack(r.sort_values("pivot")["at"]), int(r["children"].iloc[0])) if len(r) else np.empty((0, 1))
        if len(centres) > 1:
            child = _nearest(stack(l[vec_col]), centres)
        else:   # equal vectors: any division is as good as another
            child = pd.util.hash_array(l[id_col].to_numpy()) % np.uint64(-(-2 * int(l["size"].iloc[0]) // block))
        return l.assign(block=l["block"] + "." + pd.Series(child, index=l.index).astype(str))[names]

    return sized.groupBy("block", "salt").cogroup(pivots.groupBy("node", "slice")).applyInPandas(divide, schema)


def _ball(rows: pd.DataFrame, vec_col: str) -> pd.DataFrame:
    points = stack(rows[vec_col])
    centre = points.mean(axis=0)
    radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "size": [len(rows)], "centre": [centre.tolist()], "radius": [radius]})


def plant(rows: DataFrame, id_col: str = "id", vec_col: str = "vec", block: int | None = None, fan: int | None = None) -> BallTree:
    """The ball tree of ``rows``; ids are distinct. Every level is written and read back."""

    block, fan = block or BLOCK, fan or FAN
    current, parts, depth = cut_lineage(rows.withColumn("block", F.lit(ROOT))), [], 0
    while True:
        sizes = cut_lineage(current.groupBy("block").agg(F.count("*").alias("size")))
        large = sizes.where(F.col("size") > block)
        if not large.limit(1).count():
            break
        parts.append(current.join(large, "block", "left_anti"))
        depth += 1
        current = cut_lineage(_split(current, large, id_col, vec_col, block, fan, depth))
    placed = cut_lineage(reduce(DataFrame.unionByName, [*parts, current])) if parts else current
    leaves = placed.groupBy("block").applyInPandas(lambda p: _ball(p, vec_col), "block string, size long, centre array<double>, radius double")
    return BallTree(placed, cut_lineage(leaves), depth)


def _side(level: DataFrame, side: str) -> DataFrame:
    return level.select(*(F.col(c).alias(f"{side}_{c}") for c in level.columns))


def meeting(left: BallTree, right: BallTree, can: Column) -> DataFrame:
    """(lb, rb): the pairs of leaves that ``can`` does not rule out, on any level.

    ``can`` speaks of the columns l_centre, l_radius, l_norm (l_floor, l_spread) and the same with r_.
    """

    pairs = left.rows.sparkSession.createDataFrame([(ROOT, ROOT)], "lb string, rb string")
    for d in range(1, max(left.depth, right.depth) + 1):
        down = pairs.join(_side(left.level(d), "l"), F.col("lb") == F.col("l_above")).join(_side(right.level(d), "r"), F.col("rb") == F.col("r_above"))
        pairs = cut_lineage(down.where(can).select(F.col("l_node").alias("lb"), F.col("r_node").alias("rb")))
    return pairs


def within(reach: float) -> Column:
    """Balls that may hold two vectors no farther apart than ``reach``."""

    return distance("l_centre", "r_centre") <= F.col("l_radius") + F.col("r_radius") + F.lit(reach + SLACK)


def above_floor() -> Column:
    """Balls that may hold a product of at least the left side's ``floor``."""

    room = F.col("l_norm") * F.col("r_radius") + F.col("r_norm") * F.col("l_radius") + F.col("l_radius") * F.col("r_radius")
    return dot("l_centre", "r_centre") + room + SLACK >= F.col("l_floor")


def wide_and_close() -> Column:
    """Balls where (spread + spread) / distance may reach the left side's ``floor``."""

    apart = distance("l_centre", "r_centre") - F.col("l_radius") - F.col("r_radius") - SLACK
    return F.col("l_spread") + F.col("r_spread") >= F.col("l_floor") * F.greatest(apart, F.lit(0.0))


def closest(left: BallTree, right: BallTree, width: int) -> DataFrame:
    """(lb, rb): for each left leaf ``width`` right leaves whose centres have the largest products with its own.

    Found by descent with so many candidates a level: a good guess that costs little, not a bound.
    """

    own = left.leaves.select(F.col("block").alias("lb"), F.col("centre").alias("l_centre"))
    found = own.withColumn("rb", F.lit(ROOT))
    for d in range(1, right.depth + 1):
        down = found.join(_side(right.level(d), "r"), F.col("rb") == F.col("r_above"))
        down = down.select("lb", "l_centre", F.struct((-dot("l_centre", "r_centre")).alias("far"), F.col("r_node").alias("node")).alias("c"))
        ranked = down.groupBy("lb").agg(F.first("l_centre").alias("l_centre"), F.slice(F.sort_array(F.collect_list("c")), 1, width).alias("c"))
        found = cut_lineage(ranked.select("lb", "l_centre", F.explode("c.node").alias("rb")))
    return found.select("lb", "rb")


def _packed(rows: DataFrame, side: str) -> DataFrame:
    """One row a block: its name, its number of rows and the rows as a compressed Arrow stream. Written."""

    names = [c for c in rows.columns if c != "block"]

    def pack(table: pa.Table) -> pa.Table:
        held = table.select(names).combine_chunks()
        body = pa.BufferOutputStream()
        with pa.ipc.new_stream(body, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(held)
        return pa.table({f"{side}b": [table.column("block")[0].as_py()], "n": [len(held)], "body": pa.array([body.getvalue().to_pybytes()], pa.binary())})

    return cut_lineage(rows.groupBy("block").applyInArrow(pack, f"{side}b string, n long, body binary"))


def _opened(body: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(body).read_pandas()


def _groups(packed: DataFrame, side: str) -> DataFrame:
    """(block, group): neighbouring blocks together, about ``TILE`` rows a group. One number a block is put in order."""

    in_order, everything = Window.orderBy(f"{side}b"), Window.partitionBy()
    tile = F.greatest(F.lit(1), F.least(F.lit(TILE), F.ceil(F.sum("n").over(everything) / GROUPS)))
    group = F.floor((F.sum("n").over(in_order) - F.col("n")) / tile)
    return packed.select(f"{side}b", "n").select(f"{side}b", group.alias(f"{side}g"))


def _near_groups(left: DataFrame, right: DataFrame, pairs: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``near_blocks`` where groups of neighbouring blocks meet, block by block as ``pairs`` says."""

    names = [part.strip().split()[0] for part in schema.split(",")]
    left, right = _packed(left, "l"), _packed(right, "r")
    dealt = pairs.join(_groups(left, "l"), "lb").join(_groups(right, "r"), "rb")
    dealt = cut_lineage(dealt.groupBy("lb", "lg", "rg").agg(F.collect_list("rb").alias("meets")))
    # the planner makes tasks by bytes, but the work of a pair of groups grows with its comparisons
    tasks = max(1, min(TASKS, dealt.select("lg", "rg").distinct().count()))
    goals = dealt.select(F.explode("meets").alias("rb"), F.col("lg").alias("to_lg"), F.col("rg").alias("to_rg")).distinct()
    here = left.select("lb", "body").join(dealt, "lb").repartition(tasks, "lg", "rg")
    met = right.select("rb", "body").join(goals, "rb").repartition(tasks, "to_lg", "to_rg")

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        there = {name: _opened(body) for name, body in zip(r["rb"], r["body"], strict=True)}
        asking: dict[tuple, list[pd.DataFrame]] = {}    # left blocks by the right blocks that they meet
        for body, meets in zip(l["body"], l["meets"], strict=True):
            if goals := tuple(sorted(there.keys() & set(meets))):
                asking.setdefault(goals, []).append(_opened(body))
        found = [kernel(pd.concat(own, ignore_index=True), pd.concat([there[g] for g in goals], ignore_index=True)) for goals, own in asking.items()]
        return pd.concat(found) if found else pd.DataFrame({n: [] for n in names})

    return here.groupBy("lg", "rg").cogroup(met.groupBy("to_lg", "to_rg")).applyInPandas(run, schema)


def pieces(left: int, right: int, done: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, slice]]:
    """(left places, right slice) of all pairs of rows, few at a time; left places for which ``done`` holds need no more."""

    for start in range(0, left, STRIP):
        own = np.arange(start, min(start + STRIP, left))
        for at in range(0, right, PIECE):
            yield own, slice(at, at + PIECE)
            if done is not None:
                own = own[~done(own)]
                if not len(own):
                    break


def near_blocks(left: DataFrame, right: DataFrame, pairs: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
                schema: str, tiles: bool = False) -> DataFrame:
    """``kernel`` on left rows and right rows of all pairs of blocks in ``pairs(lb, rb)``; both sides carry ``block``.

    Give the smaller side as ``left``: its rows are copied once for each partner block. They meet a
    right block in groups of about ``TOGETHER`` rows of whole left blocks; the right block is copied once a group.

    With ``tiles`` neighbouring blocks of both sides form groups of about ``TILE`` rows, and groups meet: a block is
    packed and copied once for each partner group, many times less where most blocks meet. Inside two groups
    only the pairs of blocks are compared, left blocks with the same partners in one call.
    """

    if tiles:
        return _near_groups(left, right, pairs, kernel, schema)
    names = [part.strip().split()[0] for part in schema.split(",")]
    # pairs of which one side has no rows (any more) are not dealt out
    there = pairs.join(right.select(F.col("block").alias("rb")).distinct(), "rb", "left_semi")
    there = there.join(left.groupBy(F.col("block").alias("lb")).agg(F.count("*").alias("n")), "lb")
    parts = there.groupBy("rb").agg(F.ceil(F.sum("n") / TOGETHER).cast("int").alias("parts"))
    dealt = there.join(parts, "rb").select("lb", F.col("rb").alias("goal"), F.pmod(F.xxhash64("lb"), F.col("parts")).cast("int").alias("part"))
    dealt = cut_lineage(dealt)
    goals = dealt.select(F.col("goal").alias("rb"), F.col("part").alias("part"), F.col("goal").alias("goal")).distinct()
    here = left.select(*(F.col(c).alias(c) for c in left.columns if c != "block"), F.col("block").alias("lb")).join(dealt, "lb")
    met = right.select(*(F.col(c).alias(c) for c in right.columns if c != "block"), F.col("block").alias("rb")).join(goals, "rb")

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame({n: [] for n in names})
        return kernel(l, r)

    return here.groupBy("goal", "part").cogroup(met.groupBy("goal", "part")).applyInPandas(run, schema)
