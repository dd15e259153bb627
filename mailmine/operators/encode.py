"""Encoders: text -> unit vector ``array<float>``, and the incremental encode."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.feature import (
    HashingTF,
    IDF,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    Word2Vec,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailmine.functions import lexicon as lx
from mailmine.operators.cooccurrence import KIND, load_cooccurrence
from mailmine.operators.vector_store import VectorStore


def content_key(model_name: str, text: Column) -> Column:
    """Key of one encoded text: changes with the model and with the text."""

    return F.sha2(F.concat(F.lit(model_name + "\x1f"), text), 256)


class HashedEncoder:
    """Bag of words hashed into ``dim`` buckets, scaled to unit length.

    A bucket is the first 32 bits of the word's md5 modulo ``dim``. The words of a batch are hashed once
    each, however often they occur. A narrow projection. A text without words becomes the zero vector.
    """

    fitted = False

    def __init__(self, dim: int = lx.EMBED_DIM) -> None:
        self.dim = dim
        self.name = f"hashed-{dim}"

    def encode(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        dim = self.dim

        @F.arrow_udf("array<float>")
        def run(lists: pa.Array) -> pa.Array:
            if lists.null_count:
                raise ValueError(f"{lists.null_count} null texts")
            found = lists.flatten().dictionary_encode()
            words = found.dictionary.to_pylist()
            first = b"".join(hashlib.md5(w.encode()).digest()[:4] for w in words)
            buckets = (np.frombuffer(first, ">u4") % dim).astype(np.int64)
            times = np.array([w != "" for w in words], np.float64)   # a split leaves empty ends
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            place = found.indices.to_numpy(zero_copy_only=False)
            counts = np.bincount(rows * dim + buckets[place], times[place], len(lists) * dim).reshape(-1, dim)
            norms = np.sqrt((counts**2).sum(axis=1, keepdims=True))
            norms[norms == 0] = 1.0
            ends = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dim)
            return pa.ListArray.from_arrays(ends, pa.array((counts / norms).astype(np.float32).ravel()))

        return df.withColumn(out, run(F.split(F.lower(F.col(text)), r"(?U)\s+")))


class FittedEncoder:
    """A Spark ML model fitted on a corpus, saved and loaded as one artefact."""

    fitted = True

    def __init__(self, model: PipelineModel, name: str) -> None:
        self.model = model
        self.name = name

    def encode(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        keep = [c for c in df.columns if c != out]
        encoded = self.model.transform(df.withColumn("__text", F.col(text)))
        return encoded.select(*keep, vector_to_array("__unit", "float32").alias(out))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


def _tokenizer(out: str = "__words") -> RegexTokenizer:
    return RegexTokenizer(inputCol="__text", outputCol=out, pattern=r"\s+")


def _fit(df: DataFrame, text: str, stages: list, name: str, words: str = "__words") -> FittedEncoder:
    unit = Normalizer(p=2.0, inputCol="__raw", outputCol="__unit")
    model = Pipeline(stages=[_tokenizer(words), *stages, unit]).fit(df.select(F.col(text).alias("__text")))
    return FittedEncoder(model, name)


def fit_tfidf(df: DataFrame, text: str, dim: int = 256) -> FittedEncoder:
    """Hashed term frequencies weighted by inverse document frequency."""

    tf = HashingTF(numFeatures=dim, inputCol="__words", outputCol="__tf")
    return _fit(df, text, [tf, IDF(inputCol="__tf", outputCol="__raw")], f"tfidf-{dim}")


def fit_word2vec(df: DataFrame, text: str, dim: int = lx.EMBED_DIM, seed: int = lx.RANDOM_STATE,
                 partitions: int = 8, min_count: int = 2, buckets: int | None = None) -> FittedEncoder:
    """Word vectors learned on the corpus, averaged over a text.

    ``partitions`` shapes the result, so it does not follow the cluster; words seen less than
    ``min_count`` times have no vector. Every other word has its own, whatever the corpus: Spark's trainer holds
    them on the driver. Only a caller that gives ``buckets`` has more words than that hashed into so many
    buckets, as ``fit_tfidf`` does; words of one bucket then share a vector.
    """

    hashed = False
    if buckets is not None:
        words = _tokenizer().transform(df.select(F.col(text).alias("__text"))).select(F.explode("__words").alias("word"))
        seen = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
        hashed = seen.limit(buckets + 1).count() > buckets
    if hashed:
        slot = f"transform(__plain, w -> cast(pmod(xxhash64(w), {buckets}) AS string))"
        shared = [SQLTransformer(statement=f"SELECT *, {slot} AS __words FROM __THIS__")]
    else:
        shared = []
    w2v = Word2Vec(vectorSize=dim, minCount=min_count, seed=seed, numPartitions=partitions,
                   inputCol="__words", outputCol="__raw")
    return _fit(df, text, [*shared, w2v], f"word2vec-{dim}", "__plain" if hashed else "__words")


class FunctionEncoder:
    """A user's model. ``load`` runs once per task and gives texts -> 2-d array."""

    fitted = False

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], name: str) -> None:
        self.load = load
        self.name = name

    def encode(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        load = self.load

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                vectors = np.asarray(model(list(texts)), dtype=np.float64)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                norms[norms == 0] = 1.0
                yield pd.Series(list((vectors / norms).astype(np.float32)))

        return df.withColumn(out, run(F.col(text)))


def load_encoder(path: str, name: str = "fitted") -> FittedEncoder:
    return FittedEncoder(PipelineModel.load(path), name)


def resolve_encoder(spark: SparkSession, path: str | None = None, base=None):
    """The saved encoder under ``path`` if one is really there, else the base encoder."""

    base = base or HashedEncoder()
    if path is None:
        return base
    try:
        note = spark.read.text(f"{path.rstrip('/')}/metadata").first()
    except AnalysisException:
        note = None
    if note is not None and json.loads(note["value"]).get("kind") == KIND:
        return load_cooccurrence(spark, path)
    return load_encoder(path, f"{base.name}-ft-{_model_digest(spark, path)}") if note is not None else base


def _model_digest(spark: SparkSession, path: str) -> str:
    """A digest of the saved model's files: vectors of an older fit are no hits for a newer one."""

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    part = F.sha2("content", 256)
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), ""), 256).alias("d")).first()["d"][:16]


def cache_misses(texts: DataFrame, cache: DataFrame, encoder, text: str) -> DataFrame:
    """Rows whose content has no vector in the cache yet, one row per content."""

    keyed = texts.withColumn("content_key", content_key(encoder.name, F.col(text)))
    fresh = keyed.join(cache.select("content_key"), "content_key", "left_anti")
    return fresh.dropDuplicates(["content_key"])


def encode_incremental(texts: DataFrame, cache_path: str, encoder, text: str,
                       out: str = "embedding", batch: str | None = None) -> DataFrame:
    """Encode only what the store at ``cache_path`` does not hold, add it, and return all vectors.

    Every distinct content is encoded once, however many rows repeat it; only the partitions of the
    store that the texts' keys fall into are read. A ``batch`` that has finished before adds nothing.
    """

    spark, store = texts.sparkSession, VectorStore(cache_path)
    keyed = texts.withColumn("content_key", content_key(encoder.name, F.col(text)))
    prefixes = store.prefixes(keyed)
    if batch is None or not store.finished(spark, batch):
        store.add(encoder.encode(store.missing(keyed, prefixes), text, "embedding"), batch)
    return keyed.join(store.read(spark, prefixes).withColumnRenamed("embedding", out), "content_key")
