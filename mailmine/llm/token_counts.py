"""Token counts without ids: pieces once per distinct pre-token, joined to frequencies per document.

A piece never has a blank mark after another character, so a text falls apart before every run of
blanks and the merges of one part never look at the next: the count of a text is the sum over
its pre-tokens. A line end that is in no longer piece stands alone as well. The vocabulary is
tested for both.

1. Each chunk of documents is written as its distinct pre-tokens and, per document, the
   frequencies of those pre-tokens (both packed).
2. The distinct pre-tokens of all chunks meet by hash; each is counted once by the tokenizer's
   own library, and the counts go back to the chunks that asked.
3. Frequencies and counts of a chunk are joined and summed per document.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows count each by
itself; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailmine.llm import bytesops as B
from mailmine.llm.tables import documents, keep, prepare, shards

BLANK = "▁"
CHUNK_BYTES = 8 << 20
WORDS_PER_SHARD = 300_000

_loaded: dict[str, object] = {}


def library(path: str):
    """The tokenizer at ``path``, once per worker process."""

    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def splitter(path: str) -> re.Pattern:
    """Pattern of the pre-tokens, after the vocabulary was found to allow it."""

    model = library(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(BLANK in p.lstrip(BLANK) for p in pieces):
        return re.compile(r"[\s\S]+")
    if any("\n" in p for p in pieces):
        return re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
    return re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")


def pre_tokens(text: str, pattern: re.Pattern) -> list[str]:
    return pattern.findall(BLANK + text.replace(" ", BLANK)) if text else []


def count_pieces(words: list[str], path: str) -> np.ndarray:
    """Pieces of each pre-token. The library puts a blank in front; parts without one go behind a line end."""

    model = library(path)
    given, minus = [], []
    for w in words:
        if w.startswith(BLANK):
            given.append(w[1:])
            minus.append(0 if len(w) > 1 else -1)   # an empty text has no piece, a lone blank is one
        else:
            given.append("\n" + w)
            minus.append(2)                          # the blank put in front and the line end
    found = model.encode(given, num_threads=1)
    return np.array([len(x) for x in found], np.int64) - np.array(minus, np.int64)


def _chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, part, serial = splitter(path), TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        index: dict[str, int] = {}
        size = 0
        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = value.as_py() or ""
                counts = Counter(pre_tokens(text, pattern))
                known = np.fromiter((index.setdefault(w, len(index)) for w in counts), np.uint32, len(counts))
                often = np.fromiter(counts.values(), np.uint32, len(counts))
                rows.append((doc_id, len(text.encode()), known, often))
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield _pack((part << 32) + serial, rows, index)
                    rows, index, size, serial = [], {}, 0, serial + 1
        if rows:
            yield _pack((part << 32) + serial, rows, index)
    return run


def squeezed(values: np.ndarray) -> bytes:
    """Small numbers, packed: the bytes of equal weight lie side by side and are compressed."""

    planes = np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes())


def unsqueezed(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1).astype(np.int64)


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _pack(chunk: int, rows: list[tuple], index: dict[str, int]) -> pa.RecordBatch:
    """The words in the order of their hashes, so that the words of a shard lie together."""

    words = np.array(list(index), object)
    order = np.argsort(_hashes(words), kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    steps, often = [], []
    for _, _, known, times in rows:
        place = rank[known]
        by_place = np.argsort(place)
        steps.append(np.diff(place[by_place], prepend=0))
        often.append(times[by_place])
    listed = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([
        pa.array([chunk], pa.int64()), pa.array([[r[0] for r in rows]], listed), pa.array([[r[1] for r in rows]], listed),
        pa.array([[len(r[2]) for r in rows]], listed), pa.array([len(words)], pa.int64()),
        pa.array([list(words[order])], pa.list_(pa.string())),
        pa.array([squeezed(np.concatenate(steps))], pa.binary()), pa.array([squeezed(np.concatenate(often))], pa.binary()),
    ], names=["chunk", "doc_ids", "sizes", "lengths", "n_words", "words", "steps", "often"])


FREQUENCIES = "chunk bigint, doc_ids array<bigint>, sizes array<bigint>, lengths array<bigint>, n_words bigint"
CHUNK_SCHEMA = f"{FREQUENCIES}, words array<string>, steps binary, often binary"


def _ask(n: int):
    """Per chunk and shard the distinct pre-tokens of the chunk that belong there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words in zip(batch.column("chunk").to_pylist(), batch.column("words"), strict=True):
                words = words.as_py()
                shard = ((_hashes(words) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(shard, np.arange(n + 1))
                filled = np.flatnonzero(np.diff(cuts)).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(filled, pa.int32()), pa.array([chunk] * len(filled), pa.int64()),
                    pa.array([words[cuts[k]:cuts[k + 1]] for k in filled], pa.list_(pa.string())),
                ], names=["shard", "chunk", "words"])
    return run


def _answer(path: str):
    """Each distinct pre-token of a shard is counted once."""

    def run(asked: pa.Table) -> pa.Table:
        lists = asked.column("words").combine_chunks()
        flat = lists.flatten().dictionary_encode()
        counts = count_pieces(flat.dictionary.to_pylist(), path)[np.asarray(flat.indices)] if len(flat) else np.empty(0, np.int64)
        cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        return pa.table({"chunk": asked.column("chunk"), "shard": asked.column("shard"), "counts": pa.array(
            [squeezed(counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})
    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            # answers in the order of the shards are counts in the order of the words
            answers = sorted(row["answers"] or [], key=lambda a: a["shard"])
            counts = np.concatenate([np.empty(0, np.int64), *(unsqueezed(a["counts"]) for a in answers)])
            cuts = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int64)
            steps, often = unsqueezed(row["steps"]), unsqueezed(row["often"])
            # places are summed steps, anew for each document
            run = np.cumsum(steps)
            before = np.concatenate([[0], run])[cuts[:-1]]
            known = run - np.repeat(before, np.diff(cuts))
            sums = np.concatenate([[0], np.cumsum(counts[known] * often)])
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array(row["sizes"], pa.int64()),
                pa.array(sums[cuts[1:]] - sums[cuts[:-1]], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): tokens of the whole text as the tokenizer at ``path`` gives them."""

    spark = docs.sparkSession
    prepare(spark)
    chunks, _ = keep(documents(docs).mapInArrow(_chunks(path), CHUNK_SCHEMA), "pretokens")
    asked = chunks.agg(F.sum(F.size("words"))).first()[0] or 0
    n = shards(asked, WORDS_PER_SHARD)
    asks = chunks.select("chunk", "words").mapInArrow(_ask(n), "shard int, chunk bigint, words array<string>")
    answers, _ = keep(asks.groupBy("shard").applyInArrow(_answer(path), "chunk bigint, shard int, counts binary"), "counts")
    answered = answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "counts")).alias("answers"))
    return chunks.drop("words").join(answered, "chunk", "left").mapInArrow(_sum, "doc_id bigint, n_bytes bigint, n_tokens bigint")
