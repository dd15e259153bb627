"""Chunks of documents that ask questions about hashes, and get the answers back.

A chunk is a few MB of whole documents as one row of a written table, so its content and number
are the same whoever reads it. A chunk sends its *distinct* keys to shards by hash; a key with any
number of occurrences costs one entry per chunk, so no hot key meets in one task row by
row. A shard answers each chunk with bits in the order of the keys asked. The number of shards
follows the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailmine.llm import bytesops as B
from mailmine.llm.tables import documents, keep

CHUNK_BYTES = 2 << 20
CHUNK = "chunk bigint, n_bytes bigint, doc_ids binary, offsets binary, data binary"
ANSWER = "chunk bigint, shard int, bits binary"


def _packed(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    part, serial, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row() -> pa.RecordBatch:
        data = np.concatenate([d for _, _, d in held])
        lengths = np.concatenate([np.diff(o) for _, o, _ in held])
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        ids = np.concatenate([i for i, _, _ in held])
        return pa.RecordBatch.from_arrays([
            pa.array([(part << 32) + serial], pa.int64()), pa.array([len(data)], pa.int64()),
            *(pa.array([x.tobytes()], pa.binary()) for x in (ids, offsets, data))], names=["chunk", "n_bytes", "doc_ids", "offsets", "data"])

    for batch in batches:
        data, offsets = B.texts(batch.column("text"))
        ids = B.ids(batch.column("doc_id"))
        for low, high in B.slices(offsets, limit):
            held.append((ids[low:high], offsets[low:high + 1] - offsets[low], data[offsets[low]:offsets[high]]))
            size += int(offsets[high] - offsets[low])
            if size >= limit // 2:
                yield row()
                held, size, serial = [], 0, serial + 1
    if held:
        yield row()


def chunked(docs: DataFrame, limit: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """The written table of chunks, and its bytes of text."""

    chunks, _ = keep(documents(docs).mapInArrow(lambda batches: _packed(batches, limit), CHUNK), "chunks")
    return chunks, int(chunks.agg(F.sum("n_bytes")).first()[0] or 0)


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, offsets and bytes of a chunk."""

    return (np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["offsets"], np.int64), np.frombuffer(row["data"], np.uint8))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time: a chunk is large, a batch of them need not fit as Python objects."""

    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}


def record(ddl: str, values: tuple) -> pa.RecordBatch:
    """One row, by the same DDL that Spark is given."""

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields, strict=True)],
                                      names=[n for n, _ in fields])


class Deal:
    """Places of the keys by shard; a shard's keys keep their order."""

    def __init__(self, by: np.ndarray, n: int) -> None:
        shard = (by % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.int64)     # short numbers are sorted digit by digit
        self.order = np.argsort(shard, kind="stable")
        self.cuts = np.append(0, np.cumsum(np.bincount(shard, minlength=n)))
        self.size = len(by)

    def filled(self) -> list[int]:
        return np.flatnonzero(np.diff(self.cuts)).tolist()

    def places(self, shard: int) -> np.ndarray:
        return self.order[self.cuts[shard]:self.cuts[shard + 1]]

    def bits(self, answers: list[dict]) -> np.ndarray:
        out = np.zeros(self.size, bool)
        for a in answers:
            at = self.places(a["shard"])
            out[at] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=len(at)).astype(bool)
        return out


    def pairs(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """As ``bits``, for answers of two bits a key."""

        one, two = np.zeros(self.size, bool), np.zeros(self.size, bool)
        for a in answers:
            at = self.places(a["shard"])
            bits = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=2 * len(at)).astype(bool)
            one[at], two[at] = bits[::2], bits[1::2]
        return one, two


def ask_repeated(keys: np.ndarray, twice: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
    """Payloads by shard: distinct keys, and whether the chunk alone has a key twice."""

    deal = Deal(keys, n)
    for shard in deal.filled():
        at = deal.places(shard)
        yield shard, keys[at].tobytes() + np.packbits(twice[at]).tobytes()


def repeated_asked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Keys, flags and keys per payload of what ``ask_repeated`` has sent to a shard."""

    payloads = [x.as_py() for x in table.column("payload")]
    # 8 bytes and a bit a key: n keys take 8 n + ceil(n / 8) bytes
    sizes = [len(p) * 8 // 65 for p in payloads]
    keys = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(payloads, sizes, strict=True)])
    twice = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8, offset=8 * n), count=n) for p, n in zip(payloads, sizes, strict=True)])
    return keys, twice, sizes


def answer_repeated(table: pa.Table) -> pa.Table:
    """For each key asked whether it occurs more than once over all chunks."""

    keys, twice, sizes = repeated_asked(table)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    repeated = (counts > 1) | (np.bincount(inverse, twice) > 0)
    return answers(table, repeated[inverse], sizes)


def answers(table: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    bits = [np.packbits(flags[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "bits": pa.array(bits, pa.binary())})


ASK = "chunk bigint, shard int, payload binary"


def asking(chunk: int, payloads: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """All a chunk asks, one row a shard, as one batch: shards grow with the input, batches must not."""

    dealt = list(payloads)
    if dealt:
        to, data = zip(*dealt, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(dealt), pa.int64()), pa.array(to, pa.int32()), pa.array(data, pa.binary())],
                                         names=["chunk", "shard", "payload"])


def answered(asks: DataFrame, answer: Callable[[pa.Table], pa.Table], name: str) -> DataFrame:
    """(chunk, <name>): the answers to each chunk, collected; they are bits for its own keys. Written."""

    found = asks.groupBy("shard").applyInArrow(answer, ANSWER)
    out, _ = keep(found.groupBy("chunk").agg(F.collect_list(F.struct("shard", "bits")).alias(name)), name)
    return out
