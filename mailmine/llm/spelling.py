"""Spelling variants: words one letter apart, found in bit-sliced indexes, and the form each word goes back to.

1. Runs of letters are counted; a run may lose a letter by the checksum of document and run, which
   stands for typing errors. Words with enough letters and occurrences are the vocabulary.
2. Two words one edit apart share their first half or their last half, so each word goes to the
   buckets of its halves, as the shorter and as the longer word of a pair. A bucket of more than
   ``block_words`` words is cut into blocks, and all its words visit each block as queries.
3. A block holds, for every position and letter, the set of its words with that letter there, as
   bits of one whole number. A query walks through its letters once; a few logical operations a
   letter treat all words of the block: the set without an error so far, and the sets with one
   replaced, one additional (index shifted by one) or one missing letter (shifted the other way).
4. Counts and best near words of a query are added up over its buckets; pairs are never shuffled.
   A pair is counted in one bucket only: that of the first halves if these are equal.
5. A form has at least twice the occurrences of its word, so chains are short; roots are found by
   rounds of pointer doubling.

Defined results: null and empty texts have no runs; a null doc_id takes part as the text
``null``; repeated rows count each by itself; ties of occurrences go to the smaller word; further
columns are ignored; an empty table, or one without a frequent word, gives an empty result. Words
of any length are whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailmine.llm.tables import documents, keep, prepare

RUN = re.compile("[A-Za-zÀ-ÿ]+")
HELD_WORDS = 200_000     # distinct words of a task before they are handed on


@dataclass(frozen=True)
class SpellingParams:
    min_chars: int = 5
    min_count: int = 3
    drop_every: int = 97     # a run loses a letter if this divides its checksum; 0: never
    form_factor: int = 2     # a form has at least so many times the occurrences
    block_words: int = 1 << 15


def written_runs(doc_id: int | None, text: str, drop_every: int) -> Counter:
    """The lower-cased runs of a text with their occurrences, after the loss of letters."""

    # bytes.lower() knows A-Z only
    runs = Counter(RUN.findall(text.encode().lower().decode()))
    if not drop_every:
        return runs
    start = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % drop_every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def _counts(params: SpellingParams):
    def handed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for word, n in written_runs(doc_id, value.as_py() or "", params.drop_every).items():
                    if len(word) >= params.min_chars:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield handed(held)
                    held = Counter()
        if held:
            yield handed(held)
    return run


def vocabulary(docs: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """(word, n): the words of enough letters and occurrences over all texts."""

    counted = documents(docs).mapInArrow(_counts(params), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= params.min_count)


class BitIndex:
    """For every position and letter the set of the words that have it there, as bits of a number."""

    def __init__(self, words: list[str], size: int) -> None:
        self.at: dict[tuple[int, str], int] = {}
        self.short = self.long = 0     # words of ``size`` letters, and of one more
        for k, word in enumerate(words):
            bit = 1 << k
            if len(word) == size:
                self.short |= bit
            else:
                self.long |= bit
            for place in enumerate(word):
                self.at[place] = self.at.get(place, 0) | bit
        self.size = size

    def near(self, query: str) -> int:
        """Words of the index exactly one edit away; of two longer words none (another bucket has them)."""

        get = self.at.get
        zero = self.short | self.long
        if len(query) == self.size:
            replaced, added = 0, zero
            for i, letter in enumerate(query):
                here = get((i, letter), 0)
                exact = zero & here
                replaced = (replaced & here) | (zero ^ exact)
                added = (added & get((i + 1, letter), 0)) | exact
                zero = exact
                if not (zero or replaced or added):
                    return 0
            return (replaced & self.short) | (added & self.long)
        missing = 0
        for i, letter in enumerate(query):
            missing = (missing & get((i - 1, letter), 0)) | zero
            zero &= get((i, letter), 0)
            if not (zero or missing):
                return 0
        return missing & self.short


def _ones(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


ENTRY = "bucket bigint, size int, side int, block int, member boolean, word string, n bigint"
FOUND = "word string, n_near bigint, best_n bigint, best string"


def _block(size: int, side: int, rows: list[tuple]) -> Iterator[tuple]:
    """Per query of a block: number of near words that this bucket answers for, and the best of them."""

    members = [(word, n) for member, word, n in rows if member]
    if not members or len(rows) < 2:
        return
    index, half = BitIndex([w for w, _ in members], size), size // 2
    for _, word, _ in rows:
        found = 0
        best: tuple | None = None
        for k in _ones(index.near(word)):
            other, n = members[k]
            # equal first halves belong to the bucket of first halves alone
            if (other[:half] == word[:half]) == (side == 0):
                found += 1
                if best is None or (-n, other) < best:
                    best = (-n, other)
        if best:
            yield word, found, -best[0], best[1]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come one after another, as their rows are sorted; one block is held at a time."""

    def entries() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

    out: list[tuple] = []

    def handed() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                          names=["word", "n_near", "best_n", "best"])

    for (_, size, side, _), rows in groupby(entries(), key=lambda e: e[:4]):
        out.extend(_block(size, side, [e[4:] for e in rows]))
        if len(out) >= 20_000:
            yield handed()
            out.clear()
    if out:
        yield handed()


def _entries(words: DataFrame, params: SpellingParams) -> DataFrame:
    """Each word in the buckets of its halves: as the shorter word of a pair, and as the longer one."""

    long_too = F.length("word") > params.min_chars
    sizes = F.when(long_too, F.array(F.length("word"), F.length("word") - 1)).otherwise(F.array(F.length("word")))
    halves = words.select("word", "n", F.explode(sizes).alias("size")).select(
        "word", "n", "size", F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.expr("left(word, size div 2)").alias("half")),
            F.struct(F.lit(1).alias("side"), F.expr("right(word, size - size div 2)").alias("half")))).alias("h"))
    return halves.select(F.xxhash64("size", "h.side", "h.half").alias("bucket"), "size", "h.side", "word", "n")


def near_words(words: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """(word, n_near, best_n, best) for each of ``words(word, n)`` that has a near word."""

    entries = _entries(words, params)
    # the list of large buckets is written: the planner knows its size and chooses the join by it
    large, _ = keep(entries.groupBy("bucket").count().where(F.col("count") > params.block_words), "large-buckets")
    blocks = F.ceil(F.col("count") / params.block_words).cast("int")
    cut = entries.join(large, "bucket", "left").withColumn("blocks", F.coalesce(blocks, F.lit(1)))
    visits = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    home = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    dealt = visits.select("bucket", "size", "side", "block", (home == F.col("block")).alias("member"), "word", "n")
    sorted_ = dealt.repartition("bucket", "block").sortWithinPartitions("bucket", "size", "side", "block")
    found = sorted_.mapInArrow(_search, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("low"), F.col("best").alias("word")))
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return summed.select("word", "n_near", (-F.col("b.low")).alias("best_n"), F.col("b.word").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms(word, form)``: the end of the chain of forms, by pointer doubling."""

    current, _ = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved, _ = keep(current.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                    F.col("further").isNotNull().alias("moved")), "roots")
        current = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return current


def group_spellings(docs: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary of ``docs(doc_id, text)``."""

    prepare(docs.sparkSession)
    words, _ = keep(vocabulary(docs, params), "vocabulary")
    near = words.join(near_words(words, params), "word", "left")
    frequent = F.col("best_n") >= params.form_factor * F.col("n")
    formed, _ = keep(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                 F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
