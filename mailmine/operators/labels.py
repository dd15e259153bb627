"""Labels and phrases a group of mails has in common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mailmine.functions.text import explode_ngrams, tokens


def majority_labels(rows: DataFrame, group: str, labels: list[str], order: str = "row_id") -> DataFrame:
    """Most frequent non-empty value of each label per group; a tie goes to the value seen first.

    All labels are counted in one pass and one shuffle, after a map-side count.
    """

    pairs = ", ".join(f"'{c}', cast({c} as string)" for c in labels)
    long = rows.select(group, order, F.expr(f"stack({len(labels)}, {pairs}) as (kind, label)"))
    counted = long.where("label <> ''").groupBy(group, "kind", "label").agg(
        F.count("*").alias("n"), F.min(order).alias("first_row")
    )
    best = counted.groupBy(group).agg(
        *[
            F.max(F.when(F.col("kind") == c, F.struct("n", (-F.col("first_row")).alias("first"), "label"))).alias(c)
            for c in labels
        ]
    )
    found = best.select(group, *[F.col(f"{c}.label").alias(c) for c in labels])
    every = rows.select(group).distinct()
    return every.join(found, group, "left")


SKETCH_ROWS = 2
FLOOR_SHARE = 8      # one row in so many sets the floors
SLICE_WORDS = 1 << 20   # words of a batch that are hashed at a time, about


def _cell(keys: np.ndarray, row: int, counters: int) -> np.ndarray:
    """The counter of each hashed phrase in one row of the sketch."""

    mixed = (keys ^ np.uint64(row + 1)) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(counters)).astype(np.int64)


def _hashed_grams(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """Per slice of a batch: its rows; of each n-gram the row, the place of its first word and its hash with the group; words, their numbers."""

    sizes = batch.column("__words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.append(-1, np.cumsum(sizes) // SLICE_WORDS)))   # a slice starts where another block of words does
    for start, end in zip(cuts, np.append(cuts[1:], len(sizes))):
        rows, size = batch.slice(start, end - start), sizes[start:end]
        found = rows.column("__words").flatten().dictionary_encode()
        if len(found) < n:
            continue
        words = found.indices.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(size)), size)
        starts = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        known = pd.util.hash_array(np.array(found.dictionary.to_pylist(), dtype=object), categorize=False)
        keys = rows.column("__group").to_numpy(zero_copy_only=False).view(np.uint64)[owner[starts]]
        for k in range(n):
            keys = (keys ^ known[words[starts + k]]) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(32)
        yield rows, owner[starts], starts, keys, found.dictionary, words


def likely_grams(rows: DataFrame, text: str, n: int, top_k: int, keys: list[str], order: str, counters: int) -> DataFrame:
    """The n-grams that can be among the ``top_k`` of their group, with all their places.

    Counts over a share of the rows are lower bounds of the counts over all, so their k-th
    largest is a floor of the group. A count-min sketch of all n-grams never counts too little:
    n-grams whose smallest counter is below the floor are left out before anything is shuffled
    by phrase. Sketch and floors (the smallest of the groups in a slot) have at most
    ``counters`` entries a row, whatever the input, and so go to every task. Up to there an n-gram is
    a 64-bit hash, made from the hashes of its words batch by batch; only those left become texts.
    """

    group = F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")
    words = rows.select(*keys, order, tokens(F.col(text)).alias("__words"), group.alias("__group"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, owner, _, hashes, _, _ in _hashed_grams(batch, n):
                found, first, times = np.unique(hashes, return_index=True, return_counts=True)
                groups = part.column("__group").take(pa.array(owner[first]))
                yield pa.RecordBatch.from_arrays([groups, pa.array(found.view(np.int64)), pa.array(times)], names=["__group", "gram", "n"])

    some = words.where(F.pmod(F.xxhash64(order), F.lit(FLOOR_SHARE)) == 0)
    sums = some.mapInArrow(counted, "__group long, gram long, n long").groupBy("__group", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("__group").orderBy(F.col("n").desc()))
    floors = sums.withColumn("place", place).where(F.col("place") == top_k).select("__group", F.col("n").alias("floor"))
    # a group without a floor of its own must keep its slot at nothing
    floors = words.select("__group").distinct().join(floors, "__group", "left")
    slot = F.pmod("__group", F.lit(counters)).cast("int")
    slots = floors.groupBy(slot.alias("slot")).agg(F.min(F.coalesce("floor", F.lit(0))).alias("floor"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((SKETCH_ROWS, counters), np.int64)
        for batch in batches:
            for _, _, _, hashes, _, _ in _hashed_grams(batch, n):
                for i in range(SKETCH_ROWS):
                    cells[i] += np.bincount(_cell(hashes, i, counters), minlength=counters)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells.ravel()[at])], names=["cell", "n"])

    sketch = words.mapInArrow(sketched, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    lowest, tops = np.zeros(counters, np.int64), np.zeros(SKETCH_ROWS * counters, np.int64)
    for table, into in ((slots, lowest), (sketch, tops)):
        entries = table.toArrow()
        into[entries.column(0).to_numpy()] = entries.column(1).to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast((lowest, tops.reshape(SKETCH_ROWS, counters)))
    fields = [f for f in words.schema.fields if f.name in (*keys, order)]
    schema = T.StructType([*fields, T.StructField("position", T.IntegerType()), T.StructField("phrase", T.StringType())])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest, tops = shared.value
        for batch in batches:
            for part, owner, starts, hashes, texts, words in _hashed_grams(batch, n):
                floor = lowest[part.column("__group").to_numpy(zero_copy_only=False) % counters][owner]
                able = np.minimum.reduce([tops[i][_cell(hashes, i, counters)] for i in range(SKETCH_ROWS)]) >= floor
                owner, starts, hashes = owner[able], starts[able], hashes[able]
                _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
                spelled = texts.to_pylist()
                phrases = pa.array([" ".join(spelled[w] for w in words[s : s + n]) for s in starts[one]], pa.string())
                sizes = part.column("__words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                position = starts - (np.cumsum(sizes) - sizes)[owner]
                columns = [part.column(f.name).take(pa.array(owner)) for f in fields]
                columns += [pa.array(position.astype(np.int32)), phrases.take(pa.array(which))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return words.mapInArrow(likely, schema)


def top_phrases(rows: DataFrame, text: str, n: int = 3, top_k: int = 10, group: str | None = None,
                order: str = "row_id", counters: int | None = 1 << 17) -> DataFrame:
    """The ``top_k`` most frequent word n-grams (per group); a tie goes to the phrase seen first.

    Returns the group (if given), ``rank, phrase, n``. A sketch of ``counters`` entries prunes n-grams
    that can not be among them (``likely_grams``); None counts all of them. The result is exact either way.
    """

    keys = [group] if group else []
    if counters:
        grams = likely_grams(rows, text, n, top_k, keys, order, counters)
    else:
        grams = explode_ngrams(rows, text, n, keep=(*keys, order))
    # row and position in one number, so that the count stays a hash aggregate
    seen = F.col(order).cast("decimal(20,0)") * F.lit(2**32).cast("decimal(11,0)") + F.col("position")
    counted = grams.groupBy(*keys, "phrase").agg(F.count("*").alias("n"), F.min(seen).alias("seen"))
    ordering = [F.col("n").desc(), F.col("seen").asc()]
    if group:
        window = Window.partitionBy(group).orderBy(*ordering)
        ranked = counted.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top_k)
    else:
        best = counted.orderBy(*ordering).limit(top_k)
        ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*ordering)))
    return ranked.select(*keys, "rank", "phrase", "n")


def phrase_lists(ranked: DataFrame, group: str, out: str = "common_phrases") -> DataFrame:
    """The ranked phrases of each group as one list, best first."""

    rows = F.array_sort(F.collect_list(F.struct("rank", "phrase")))
    return ranked.groupBy(group).agg(F.transform(rows, lambda r: r["phrase"]).alias(out))
