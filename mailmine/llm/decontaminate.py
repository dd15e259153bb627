"""Benchmark decontamination with suffix arrays over the training texts.

Every task sorts the suffixes of its texts, a shard at a time, and binary-searches every test
suffix that can begin a window in each shard. The neighbours of the place found give the longest
verbatim match; all training suffixes that share the window are its locations. Only words of
the test vocabulary can match, so a shard keeps the runs of such words that are long enough for
some window (a sparse suffix array). No shuffle is needed.

The test set goes to the tasks in blocks of at most ``block_bytes`` of text: one block
is the usual case; more blocks are searched one after another and their marks joined by row.

Defined results: null and empty texts have no words and no hits; an item without words or
without an id has no window; repeated items and rows count each by itself; further columns
are ignored; empty tables on either side give no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailmine.llm import bytesops as B
from mailmine.llm.tables import carried, carrying, documents, keep, prepare


@dataclass(frozen=True)
class Tests:
    """A block of test items: word ids from 1 by vocabulary, laid out with a 0 after each item."""

    vocabulary: np.ndarray   # sorted hashes; the id of a word is its place plus one
    words: np.ndarray
    suffixes: np.ndarray     # starts of the suffixes that begin a window
    need: np.ndarray         # words of the window, by suffix
    item: np.ndarray         # index into names, by suffix
    names: list[str]


def lowered_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z in lower case, and the word offsets of the rows."""

    data = B.LOWER[data]
    starts, ends, rows = B.word_bounds(data, offsets, B.ALNUM)
    return B.word_hashes(data, starts, ends), rows


def test_block(items: list[tuple[str, str]], window: int) -> Tests:
    data, offsets = B.texts(pa.array([text for _, text in items], pa.string()))
    hashes, rows = lowered_words(data, offsets)
    vocabulary = np.unique(hashes)
    lengths = np.diff(rows)
    words = np.zeros(len(hashes) + len(items), np.int64)
    owner = np.repeat(np.arange(len(items)), lengths)
    words[np.arange(len(hashes)) + owner] = np.searchsorted(vocabulary, hashes) + 1
    need = np.minimum(window, lengths)
    left = np.repeat(rows[1:], lengths) - np.arange(len(hashes))
    first = np.flatnonzero(left >= need[owner])
    return Tests(vocabulary, words, first + owner[first], need[owner[first]], owner[first], [name for name, _ in items])


def suffix_order(words: np.ndarray, longest: int) -> np.ndarray:
    """Starts of all suffixes in order, by doubling the compared length until every rank is settled.

    0 ends a run of words: nothing is compared beyond it, and no suffix starts there."""

    rank, size = words.copy(), 1
    stop = words == 0
    while size < longest:
        behind = np.zeros(len(rank), np.int64)
        behind[:-size or None] = rank[size:] if size < len(rank) else 0
        key = rank * (int(rank.max()) + 1) + behind
        key[stop] = 0
        distinct, rank = np.unique(key, return_inverse=True)
        # a settled order stays; the stops share rank 0
        size *= 2
        if len(distinct) == len(rank) - stop.sum() + 1:
            break
    order = np.argsort(rank, kind="stable")
    return order[~stop[order]]


def common_prefix(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, most: int | None = None) -> np.ndarray:
    """Number of equal words from a[at] and b[to] on; both end at a 0."""

    out, active = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(active) and (most is None or out[active[0]] < most):
        x, y = a[at[active] + out[active]], b[to[active] + out[active]]
        active = active[(x == y) & (x != 0)]
        out[active] += 1
    return out


def insertion(tests: Tests, queries: np.ndarray, words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Binary search: for each query the first place in ``order`` whose suffix is not smaller."""

    low = np.zeros(len(queries), np.int64)
    high = np.full(len(queries), len(order), np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        q, t = queries[open_], order[middle]
        same = common_prefix(tests.words, q, words, t)
        smaller = words[t + same] < tests.words[q + same]
        low[open_] = np.where(smaller, middle + 1, low[open_])
        high[open_] = np.where(smaller, high[open_], middle)
    return low


def search(tests: Tests, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[dict[int, int]]]:
    """Hit flag per word of a shard, and per row the items found with their longest match."""

    hit = np.zeros(len(hashes), bool)
    found: list[dict[int, int]] = [{} for _ in range(len(rows) - 1)]
    if not len(tests.suffixes) or not len(hashes):
        return hit, found
    place = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
    known = tests.vocabulary[place] == hashes
    # runs of known words within a row, long enough for the shortest window
    edge = np.ones(len(hashes), bool)
    edge[1:] = known[1:] != known[:-1]
    edge[rows[:-1][rows[:-1] < len(hashes)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(hashes))
    use = known[starts] & (ends - starts >= tests.need.min())
    starts, ends = starts[use], ends[use]
    if not len(starts):
        return hit, found
    lengths = ends - starts
    shift = np.concatenate([[0], np.cumsum(lengths + 1)])
    origin = np.repeat(starts - shift[:-1], lengths + 1) + np.arange(shift[-1])   # of each place, in the shard
    words = np.zeros(shift[-1], np.int64)
    real = np.ones(shift[-1], bool)
    real[shift[1:] - 1] = False
    words[real] = place[origin[real]] + 1
    order = suffix_order(words, int(lengths.max()))

    at = insertion(tests, tests.suffixes, words, order)
    best, near = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for step in (0, -1):
        valid = np.flatnonzero((at + step >= 0) & (at + step < len(order)))
        same = common_prefix(tests.words, tests.suffixes[valid], words, order[at[valid] + step])
        longer = same > best[valid]
        best[valid[longer]], near[valid[longer]] = same[longer], at[valid[longer]] + step
    owner = np.searchsorted(rows, origin[order], "right") - 1
    for need in np.unique(tests.need[best >= tests.need]):
        shared = common_prefix(words, order[:-1], words, order[1:], int(need)) >= need
        group = np.concatenate([[0], np.cumsum(~shared)])
        opens = np.searchsorted(group, np.arange(group[-1] + 2))
        for q in np.flatnonzero((tests.need == need) & (best >= need)):
            places = slice(opens[group[near[q]]], opens[group[near[q]] + 1])
            for row in np.unique(owner[places]):
                item = int(tests.item[q])
                found[row][item] = max(found[row].get(item, 0), int(best[q]))
        windows = np.unique(group[near[(tests.need == need) & (best >= need)]])
        spots = origin[order[np.isin(group, windows)]]
        hit |= B.spread(spots, spots + need, len(hit))
    return hit, found


MARKS = "row bigint, doc_id bigint, n_words bigint, hits binary, items array<string>, longest bigint"


def _mark(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = test_block(shared.value, window)
        for batch in batches:
            data, offsets = B.texts(batch.column("text"))
            rest = [c for c in batch.schema.names if c == "carry"]
            for low, high in B.slices(offsets):
                part, body = offsets[low:high + 1] - offsets[low], data[offsets[low]:offsets[high]]
                hashes, rows = lowered_words(body, part)
                hit, found = search(tests, hashes, rows)
                bits = [np.packbits(hit[a:b]).tobytes() if f else b"" for a, b, f in zip(rows[:-1], rows[1:], found, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(low, high - low), batch.column("doc_id").slice(low, high - low),
                    pa.array(np.diff(rows), pa.int64()), pa.array(bits, pa.binary()),
                    pa.array([[tests.names[i] for i in f] for f in found], pa.list_(pa.string())),
                    pa.array([max(f.values(), default=0) for f in found], pa.int64()),
                    *(batch.column(c).slice(low, high - low) for c in rest),
                ], names=["row", "doc_id", "n_words", "hits", "items", "longest", *rest])
    return run


RESULT = ("doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
          "longest_match bigint, items array<string>")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document from the marks of all blocks."""

    for batch in batches:
        out = []
        rest = [c for c in batch.schema.names if c == "carry"]
        for row in batch.select(["doc_id", "n_words", "marks"]).to_pylist():
            marks = row["marks"]
            bits = np.zeros(max(len(m["hits"]) for m in marks), np.uint8)
            for m in marks:
                bits[:len(m["hits"])] |= np.frombuffer(m["hits"], np.uint8)
            items = sorted({i for m in marks for i in m["items"] if i is not None})
            n_hit = int(np.unpackbits(bits).sum())
            out.append((row["doc_id"], row["n_words"], n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(),
                        n_hit > 0, max(m["longest"] for m in marks), items))
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *(batch.column(c) for c in rest)],
                                         names=[*(x.split()[0] for x in RESULT.split(", ")), *rest])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20,
                       carry: bool = False) -> DataFrame:
    """One row per document: words, words inside test windows, the items found and the longest match.

    With ``carry`` the input row comes along as a struct of that name."""

    spark = docs.sparkSession
    prepare(spark)
    tests = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("words"))
    tests = tests.where(F.col("words").isNotNull())
    size = tests.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    rows = (carrying(docs) if carry else documents(docs)).withColumn("row", F.monotonically_increasing_id())
    if n_blocks > 1:
        rows, _ = keep(rows, "rows")      # the row numbers must be the same for every block
    marks = []
    for block in range(n_blocks):
        part = tests.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == block).orderBy("item", "words")
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.toLocalIterator()])
        given = rows if n_blocks == 1 else rows.select("row", "doc_id", "text")
        marks.append(given.mapInArrow(_mark(shared, window), carried(given, MARKS)))
    mark = F.struct("hits", "items", "longest")
    along = ["carry"] if carry else []
    if n_blocks == 1:
        ready = marks[0].select("doc_id", "n_words", F.array(mark).alias("marks"), *along)
        return ready.mapInArrow(_finish, carried(ready, RESULT))
    united = marks[0]
    for more in marks[1:]:
        united = united.union(more)
    united = united.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                       F.collect_list(mark).alias("marks"))
    ready = united.join(rows.select("row", "carry"), "row") if carry else united
    ready = ready.select("doc_id", "n_words", "marks", *along)
    return ready.mapInArrow(_finish, carried(ready, RESULT))
