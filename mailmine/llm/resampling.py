"""Importance resampling towards a target: weights from hashed features, an exact cutoff, sorted winners.

1. Every task counts the hashed features of its texts in one array; the arrays are added up
   per bucket. Raw and target counts of a bucket give its gain, the log of their ratio.
2. A second pass looks the gains up for each document: its weight is their mean, its score the
   weight plus Gumbel noise from the document's id, so that the highest scores are a draw by weight.
3. The cutoff among all scores is found by weighted medians of medians: each partition names the
   median of its remaining keys and their number, the median of those, weighted by the numbers, has
   at least a quarter of all remaining keys on either side, and one counting pass tells which side
   holds the cutoff. What remains is written anew when it has halved, so all rounds together
   read a few times the keys. A round brings one row per partition to the driver.
4. Rows up to the cutoff are ranked by a range-partitioned sort.

Defined results: null and empty texts have no feature and weight 0; a null doc_id draws its noise as
the text ``null`` and counts as the largest id in ties; rows equal in score and id go by number of
features, and rows equal in that too are ranked one after another; repeated rows are drawn each
by itself; further columns are ignored; empty tables give an empty result (documents) or equal gains of an
empty target (benchmark).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailmine.llm import bytesops as B
from mailmine.llm.tables import keep, prepare


@dataclass(frozen=True)
class ResampleParams:
    ngram: int = 1            # features are runs of 1 to ``ngram`` words
    buckets: int = 10_000
    min_words: int = 20       # shorter documents are scored but not drawn
    percent: int = 10
    seed: int = 2024
    finish_rows: int = 256  # so few remaining keys are sorted at once


def _crc_table() -> np.ndarray:
    """One step of the checksum for each byte, from its polynomial."""

    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_STEP = _crc_table()
_LONG = 64    # longer ranges one by one


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each data[start:end]: one array step per byte position, over all ranges that reach it."""

    out = np.empty(len(starts), np.uint32)
    lengths = ends - starts
    for k in np.flatnonzero(lengths > _LONG).tolist():
        out[k] = zlib.crc32(data[starts[k]:ends[k]])
    short = np.flatnonzero(lengths <= _LONG)
    order = short[np.argsort(-lengths[short], kind="stable")]
    at, falling = starts[order], -lengths[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(-falling[0]) if len(order) else 0):
        n = int(np.searchsorted(falling, -j))
        part = crc[:n]
        crc[:n] = _STEP[(part ^ data[at[:n] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out[order] = ~crc
    return out


def _features(data: np.ndarray, offsets: np.ndarray, params: ResampleParams) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice of rows: first and last row, words of each row, and (for each length of run) buckets by row.

    The words of a slice are laid side by side with one space between, so that a run of words is a range.
    """

    for low, high in B.slices(offsets):
        part = B.LOWER[data[offsets[low]:offsets[high]]]
        starts, ends, rows = B.word_bounds(part, offsets[low:high + 1] - offsets[low], B.ALNUM)
        words = np.diff(rows)
        if params.ngram > 1 and len(starts):
            sizes = ends - starts
            new_ends = np.cumsum(sizes + 1) - 1
            new_starts = new_ends - sizes
            within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            joined = np.full(int(new_ends[-1]), 32, np.uint8)
            joined[np.repeat(new_starts, sizes) + within] = part[np.repeat(starts, sizes) + within]
            part, starts, ends = joined, new_starts, new_ends
        sums, found = np.zeros(high - low, np.int64), []
        for n in range(1, params.ngram + 1):
            inside = np.flatnonzero(B.inside_rows(rows, n, len(starts)))
            bucket = crc32_of(part, starts[inside], ends[inside + n - 1]) % np.uint32(params.buckets)
            per_row = np.maximum(words - n + 1, 0)
            sums += per_row
            found.append((bucket, per_row))
        yield low, high, words, sums, found


def _bucket_counts(params: ResampleParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(params.buckets, np.int64)
        for batch in batches:
            for _, _, _, _, found in _features(*B.texts(batch.column("text")), params):
                for bucket, _ in found:
                    total += np.bincount(bucket, minlength=params.buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(total[filled], pa.int64())], names=["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, params: ResampleParams) -> np.ndarray:
    """Occurrences of features per bucket over all texts; as many numbers as there are buckets."""

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_bucket_counts(params), "bucket int, n bigint")
    out = np.zeros(params.buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket in target and raw texts."""

    n, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel draw that the id decides."""

    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def _scored(gain: np.ndarray, params: ResampleParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            n_words, n_features = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            total = np.zeros(len(ids), np.int64)
            for low, high, words, count, found in _features(*B.texts(batch.column("text")), params):
                n_words[low:high], n_features[low:high] = words, count
                for bucket, per_row in found:
                    sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                    cuts = np.concatenate([[0], np.cumsum(per_row)])
                    total[low:high] += sums[cuts[1:]] - sums[cuts[:-1]]
            weight = total // np.maximum(n_features, 1)
            score = weight + np.array([noise(i, params.seed) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight, score))],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])
    return run


KEY = ["low", "id", "n_features", "row"]
Key = tuple[int, int, int, int]


def _keyed(scored: DataFrame) -> DataFrame:
    """Keys that ascend from the best row on, all distinct."""

    return scored.select((-F.col("score")).alias("low"), F.coalesce("doc_id", F.lit(B.NO_ID)).alias("id"), "n_features", "row")


def _up_to(key: Key) -> Column:
    """Whether a row comes no later than ``key``; the first part also prunes files."""

    last = F.struct(*(F.lit(v).cast("bigint").alias(c) for c, v in zip(KEY, key, strict=True)))
    return (F.col("low") <= key[0]) & (F.struct(*KEY) <= last)


def _after(key: Key) -> Column:
    last = F.struct(*(F.lit(v).cast("bigint").alias(c) for c, v in zip(KEY, key, strict=True)))
    return (F.col("low") >= key[0]) & (F.struct(*KEY) > last)


def _median(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lower median of a partition's keys, and their number."""

    parts = [[np.asarray(batch.column(c)) for c in KEY] for batch in batches if batch.num_rows]
    if not parts:
        return
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    n = len(columns[0])
    middle = (n - 1) // 2
    # only the rows with the median's first part need the full order
    first = np.partition(columns[0], middle)[middle]
    before, equal = int((columns[0] < first).sum()), np.flatnonzero(columns[0] == first)
    chosen = equal[np.lexsort([c[equal] for c in reversed(columns)])[middle - before]]
    yield pa.RecordBatch.from_arrays([*(pa.array([int(c[chosen])], pa.int64()) for c in columns), pa.array([n], pa.int64())], names=[*KEY, "size"])


def weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The first key at which half of all weight is reached."""

    half, passed = sum(size for _, size in medians) / 2, 0
    for key, size in sorted(medians):
        passed += size
        if passed >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, k: int, finish_rows: int) -> Key:
    """The ``k``-th smallest key of the written table ``keys``, 1 <= k <= its rows."""

    remaining = written = keys.count()
    while remaining > max(finish_rows, 1):
        found = keys.mapInArrow(_median, ", ".join(f"{c} bigint" for c in [*KEY, "size"])).collect()
        pivot = weighted_median([(tuple(r[c] for c in KEY), r["size"]) for r in found])
        below = keys.where(_up_to(pivot)).count()
        if below == k:
            return pivot
        if below > k:
            keys, remaining = keys.where(_up_to(pivot)), below
        else:
            keys, remaining, k = keys.where(_after(pivot)), remaining - below, k - below
        if remaining * 2 <= written:
            keys, _ = keep(keys, "remaining-keys")
            written = remaining
    return sorted(tuple(r[c] for c in KEY) for r in keys.collect())[k - 1]


def _ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with their rank by KEY: ranges sorted by themselves, the sizes of those before added."""

    ranged, _ = keep(winners.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()), "winners")
    starts, total = [], 0
    for row in ranged.groupBy("part").count().orderBy("part").collect():
        starts.append((row["part"], total))
        total += row["count"]
    before = F.broadcast(ranged.sparkSession.createDataFrame(starts, "part int, before bigint"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*KEY))
    return ranged.join(before, "part").select("doc_id", "n_features", "weight", "score", (F.col("before") + within).cast("bigint").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, params: ResampleParams = ResampleParams()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs``; undrawn rows have no rank."""

    spark = docs.sparkSession
    prepare(spark)
    gain = gains(bucket_counts(docs, params), bucket_counts(target, params))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_scored(gain, params), "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    # written once: the row numbers stay as they are whatever is lost later
    scored, _ = keep(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    may = scored.where(F.col("n_words") >= params.min_words)
    wanted = params.percent * may.count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    keys, _ = keep(_keyed(may), "keys")
    last = cutoff(keys, wanted, params.finish_rows)
    full = scored.withColumns({"low": -F.col("score"), "id": F.coalesce("doc_id", F.lit(B.NO_ID))})
    drawn = (F.col("n_words") >= params.min_words) & _up_to(last)
    undrawn = full.where(~drawn).select(*out, F.lit(None).cast("bigint").alias("rank"))
    return _ranked(full.where(drawn)).unionByName(undrawn)
