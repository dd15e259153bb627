"""Connected components, and consecutive numbers in a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailmine.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("low"))
    lowest = cut_lineage(lowest.select("a", F.least("a", "low").alias("low")))
    linked = both.join(lowest, "a").where(F.col("b") > F.col("a"))
    return linked.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = cut_lineage(edges.groupBy("a").agg(F.min("b").alias("low")))
    linked = edges.join(lowest, "a")
    moved = linked.where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(lowest.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges(a, b)``; the component is its smallest node.

    Alternates large-star and small-star steps. Each step is a minimum per node
    (combined before the shuffle) joined back to the edges. The minima are written first:
    the join then reads two plain sides, so that small minima are broadcast by the planner and
    otherwise adaptive execution splits a node with very many edges, which it can not do where
    one side is an aggregate of the same stage.
    """

    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = cut_lineage(down.distinct())
    before = _state(current)
    while before[0]:
        current = cut_lineage(_small_star(_large_star(current)))
        after = _state(current)
        if after == before:
            break
        before = after
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.union(roots)


def number_in_order(values: DataFrame, column: str, out: str) -> DataFrame:
    """0, 1, 2, ... for the distinct values of ``column`` in ascending order.

    Sorted range by range; only one count per range reaches the driver.
    """

    spark = values.sparkSession
    ranged = values.select(column).distinct().repartitionByRange(column)
    ranged = cut_lineage(ranged.withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").count().orderBy("__part").collect()
    offsets, total = [], 0
    for row in counts:
        offsets.append((row["__part"], total))
        total += row["count"]
    if not offsets:
        return ranged.select(column, F.lit(0).cast("bigint").alias(out))
    starts = spark.createDataFrame(offsets, "__part int, __start long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(column))
    numbered = ranged.join(F.broadcast(starts), "__part")
    # written, so that the planner knows its size when rows are joined to it
    return cut_lineage(numbered.select(column, (F.col("__start") + within - 1).alias(out)))
