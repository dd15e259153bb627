"""Quality classifier: supervised subword embeddings.

Words, word n-grams and the character n-grams of words are hashed to buckets; each bucket has a learned vector, a
document is the mean of its vectors, and a softmax layer gives the class. The model is
trained by stochastic gradient descent in numpy, inside one task, on a bounded sample of
labelled rows (``ModelParams.sample_rows`` and ``sample_bytes``, the rows with the smallest hash of their id). As
score, the softmax of two classes is the logistic of their difference, so the product of
vectors and output layer is one number per bucket: scoring is a lookup and a mean.

Defined results: a null or empty text has no features and gets the score of the bias; a label
that is null or without a document is ignored, and so is an id with both labels; without any usable label every score is 0.5;
repeated rows are scored each by itself; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailmine.llm import bytesops as B
from mailmine.llm.tables import carried, carrying, documents, prepare


@dataclass(frozen=True)
class ModelParams:
    sample_rows: int = 4000        # labelled rows the fit reads at most; nothing else is sampled
    sample_bytes: int = 256 << 20  # and at most so many bytes of their features
    word_grams: tuple[int, ...] = (2, 3)
    bucket_bits: int = 18
    dim: int = 8
    epochs: int = 6
    rate: float = 0.2
    char_grams: tuple[int, ...] = (3, 5)
    seed: int = 7


def features(data: np.ndarray, offsets: np.ndarray, p: ModelParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, starts, ends): one group of hashed features after another, rows as ranges of it."""

    top = np.uint64(64 - p.bucket_bits)
    starts, ends, rows = B.word_bounds(data, offsets)
    words = B.word_hashes(data, starts, ends)
    yield (words >> top).astype(np.int64), rows[:-1], rows[1:]
    for n in p.word_grams:
        gram = B.window_hashes(words, n, words=True)
        first = np.minimum(rows[:-1], len(gram))
        yield (B.mix(gram + np.uint64(n)) >> top).astype(np.int64), first, np.maximum(np.minimum(rows[1:] - n + 1, len(gram)), first)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    symbols = np.where(blank, np.uint32(0x20), points).astype(np.uint64) + np.uint64(1)
    before = np.concatenate([[0], np.cumsum(blank)])
    place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    for n in p.char_grams:
        size = max(len(points) - n + 1, 0)
        gram = np.full(size, n, np.uint64)
        for k in range(n):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + symbols[k:size + k]
        # characters of one word, with the blank before or behind it
        inner = np.flatnonzero(before[n - 1:size + n - 1] == before[1:size + 1])
        first = np.searchsorted(inner, place[:-1])
        yield ((B.mix(gram[inner]) >> top).astype(np.int64), first,
               np.maximum(np.searchsorted(inner, place[1:] - n + 1), first))


def _packed(p: ModelParams):
    """Per labelled document its distinct buckets and their weights, which sum to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.texts(batch.column("text"))
            out = []
            for row in range(len(offsets) - 1):
                body = data[offsets[row]:offsets[row + 1]]
                found = [b[s[0]:e[0]] for b, s, e in features(body, np.array([0, len(body)]), p)]
                bucket, count = np.unique(np.concatenate(found), return_counts=True)
                weight = (count / max(count.sum(), 1)).astype(np.float32)
                out.append(bucket.astype(np.int32).tobytes() + weight.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("label"), pa.array(out, pa.binary())],
                                             names=["rank", "label", "packed"])
    return run


def _fit(p: ModelParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, size = [], 0
        for batch in batches:
            for packed, label in zip(batch.column("packed").to_pylist(), batch.column("label").to_pylist(), strict=True):
                size, half = size + len(packed), len(packed) // 2
                if len(samples) < p.sample_rows and size <= p.sample_bytes:
                    samples.append((np.frombuffer(packed[:half], np.int32), np.frombuffer(packed[half:], np.float32), int(label)))
        yield pa.RecordBatch.from_arrays([pa.array([descend(samples, p).tobytes()], pa.binary())], names=["model"])
    return run


def descend(samples: list[tuple[np.ndarray, np.ndarray, int]], p: ModelParams) -> np.ndarray:
    """One number per bucket, the bias last: how far the bucket speaks for label 1."""

    random = np.random.default_rng(p.seed)
    vectors = random.uniform(-1 / p.dim, 1 / p.dim, (1 << p.bucket_bits, p.dim)).astype(np.float32)
    out, bias = np.zeros((p.dim, 2), np.float32), np.zeros(2, np.float32)
    step, steps = 0, max(1, p.epochs * len(samples))
    for _ in range(p.epochs):
        for k in random.permutation(len(samples)):
            bucket, weight, label = samples[k]
            rate = p.rate * (1 - step / steps)
            step += 1
            mean = weight @ vectors[bucket]
            score = mean @ out + bias
            score = np.exp(score - score.max())
            error = score / score.sum()
            error[label] -= 1
            back = out @ error
            out -= np.float32(rate * 0.1) * np.outer(mean, error)
            bias -= np.float32(rate * 0.01) * error
            # rows share few rare buckets: scaling by the features' number makes the step that of their sum
            vectors[bucket] -= np.float32(rate) * np.minimum(weight * len(bucket), 4)[:, None] * back
    difference = out[:, 1] - out[:, 0]
    return np.append(vectors @ difference, bias[1] - bias[0]).astype(np.float64) if samples else np.zeros(1)


def _score(p: ModelParams, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.frombuffer(model.value, np.float64)
        for batch in batches:
            data, offsets = B.texts(batch.column("text"))
            for low, high in B.slices(offsets):
                part, body = offsets[low:high + 1] - offsets[low], data[offsets[low]:offsets[high]]
                total, count = np.zeros(high - low), np.zeros(high - low)
                if len(values) > 1:
                    for bucket, start, end in features(body, part, p):
                        sums = np.concatenate([[0.0], np.cumsum(values[bucket])])
                        total += sums[end] - sums[start]
                        count += end - start
                score = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + values[-1], -500, 500)))
                rest = [c for c in batch.schema.names if c == "carry"]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(low, high - low), pa.array(score),
                    *(batch.column(c).slice(low, high - low) for c in rest)], names=["doc_id", "score", *rest])
    return run


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, params: ModelParams = ModelParams()) -> bytes:
    """The model, from the labelled rows where ``learn`` (over doc_id) holds; its size is fixed by the parameters.

    ``labels`` has doc_id and quality (0 or 1). Of them the ``sample_rows`` with the smallest hash of
    their id are read; the order is by that hash, so the fit is repeatable."""

    prepare(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    marked = marked.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn)
    # an id marked both ways says nothing
    marked = marked.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    chosen = marked.withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(params.sample_rows)
    rows = documents(docs).join(F.broadcast(chosen), "doc_id").select("rank", "label", "text")
    packed = rows.mapInArrow(_packed(params), "rank bigint, label int, packed binary")
    # one task in the order of the hash; it stops at the bounds of the sample, which repeated or long documents could exceed
    found = packed.repartition(1).sortWithinPartitions("rank", "packed").mapInArrow(_fit(params), "model binary").first()
    return bytes(found["model"]) if found else np.zeros(1).tobytes()


def score_quality(docs: DataFrame, model: bytes, params: ModelParams = ModelParams(), carry: bool = False) -> DataFrame:
    """(doc_id, score): every document with the score of its whole text; one narrow pass.

    With ``carry`` the input row comes along as a struct of that name."""

    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = carrying(docs) if carry else documents(docs)
    return rows.mapInArrow(_score(params, shared), carried(rows, "doc_id bigint, score double"))
