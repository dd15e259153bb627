"""SentencePiece encoding and decoding as a max-plus parallel scan.

The best segmentation of a text is the one with the largest sum of piece scores. A giant
document is cut into chunks of ``chunk_chars`` code points. What a chunk has to know of its left
neighbour is only how many of its first characters belong to a piece begun there: the boundary state, 0 up
to the longest piece less one. Each chunk yields the matrix of best scores from every entering
to every leaving state; max-plus products of the matrices are associative, so blocks of chunks
are combined in parallel, and the best scores of the states before every block and every chunk follow. With them a
chunk knows, for each state it may be left in, the state it was entered in: a map, and maps
are composed from the right in the same two levels. Then every chunk is traced back independently. Where a blank mark follows another
character no piece can cross (the vocabulary is tested for that), so paths meet there and
each distinct part between two such places is solved once per worker.

The pieces and scores are read from a given model file; nothing is trained. Characters
without a piece become byte pieces. Ties go to the longest last piece, whatever the chunks: the ids do not
depend on ``chunk_chars``.

Defined results: null and empty texts have no pieces; repeated rows are encoded each by itself;
further columns are ignored; an empty table gives an empty result. Decoding gives back the text
exactly, but for a literal blank mark, which comes back as a blank.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailmine.llm import bytesops as B
from mailmine.llm.tables import documents, keep, prepare
from mailmine.llm.token_counts import BLANK, library

CHUNK_CHARS = 1 << 15
BLOCK = 256                 # chunk matrices of one block
SHORT = 48                  # characters of parts solved together
BLOCK_CHARS = 1 << 18       # characters solved at a time
CACHE = 250_000             # parts a worker remembers
NEVER = -np.inf


class Vocabulary:
    """Pieces, scores and byte pieces of a model file, with the parts solved so far."""

    def __init__(self, path: str) -> None:
        model = library(path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(len(self.names))]
        self.pieces = {p: (int(model.get_score(i)), i) for i, p in enumerate(self.names) if not special[i]}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.names) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = min(s for s, _ in self.pieces.values()) - 10
        self.longest = max(map(len, self.pieces))
        # every beginning of a piece; None where it is no piece itself
        self.begun: dict[str, tuple[int, int] | None] = {p[:k]: None for p in self.pieces for k in range(1, len(p))}
        self.begun |= self.pieces
        meets = not any(BLANK in p.lstrip(BLANK) for p in self.pieces)
        alone = not any("\n" in p for p in self.pieces)     # a line end then stands alone
        blank, end = (BLANK, "\n") if alone else (BLANK, "")
        self.part = re.compile(("\n|" if alone else "") + f"{blank}+[^{blank}{end}]*|[^{blank}{end}]+" if meets else r"[\s\S]+")
        self.meet = re.compile(f"(?<=[^{BLANK}]){BLANK}" + (r"|\n|(?<=\n)[\s\S]" if alone else "")) if meets else re.compile(r"(?!)")
        # the bytes of every id, end to end, and its score: a character without a piece counts once, at its first byte
        raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(BLANK, " ").encode() for i, p in enumerate(self.names)]
        self.raw, self.raw_sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw])
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.values = np.zeros(len(self.names), np.int64)
        for score, i in self.pieces.values():
            self.values[i] = score
        for i, byte in self.byte_of.items():
            self.values[i] = 0 if 0x80 <= byte < 0xC0 else self.unknown
        self.solved: dict[str, bytes] = {}      # ids of a part, four bytes each
        # by length: hashes of the pieces in order, scores, ids, and which leading hash bits a piece or its beginning has
        self.tables = {}
        for size in range(1, self.longest + 1):
            rows = [(p, *v) for p, v in self.pieces.items() if len(p) == size] or [("\0" * size, 0, -1)]
            points = np.frombuffer("".join(r[0] for r in rows).encode("utf-32-le"), np.uint32)
            hashes = B.window_hashes(points, size)[::size]
            order, likely = np.argsort(hashes), np.zeros(1 << 20, bool)
            begun = np.frombuffer("".join(p for p in self.begun if len(p) == size).encode("utf-32-le"), np.uint32)
            likely[B.window_hashes(begun, size)[::size] >> np.uint64(44)] = True
            self.tables[size] = hashes[order], np.array([float(r[1]) for r in rows])[order], np.array([r[2] for r in rows])[order], likely

    def forward(self, text: str, start: int, stop: int, given: np.ndarray | None = None) -> tuple[list, list]:
        """Best score and best last start of every node, for pieces that begin in start..stop.

        ``given`` holds best scores of the first nodes over pieces from before the text; those have last start -1.
        """

        begun, n, no = self.begun, len(text), 0
        best: list = [None] * (n + 1)
        back = [0] * (n + 1)
        best[start] = 0
        if given is not None:
            for i, score in enumerate(given.tolist()[:n + 1]):
                best[i], back[i] = None if score == NEVER else score, -1
        for i in range(start, stop):
            score = best[i]
            if score is None:
                continue
            if text[i] not in self.pieces:
                other = score + self.unknown
                if best[i + 1] is None or other > best[i + 1]:
                    best[i + 1], back[i + 1] = other, i
            for j in range(i + 1, n + 1):
                found = begun.get(text[i:j], no)
                if found is no:
                    break
                if found is not None:
                    other = score + found[0]
                    if best[j] is None or other > best[j]:
                        best[j], back[j] = other, i
        return best, back

    def trace(self, text: str, back: list, start: int, end: int) -> list[int]:
        cuts = [end]
        while cuts[-1] > start:
            cuts.append(back[cuts[-1]])
        out: list[int] = []
        for a, b in zip(cuts[:0:-1], cuts[-2::-1], strict=True):
            found = self.pieces.get(text[a:b])
            out += [found[1]] if found else [self.bytes[x] for x in text[a:b].encode()]
        return out

    def solve(self, part: str) -> bytes:
        _, back = self.forward(part, 0, len(part))
        return np.array(self.trace(part, back, 0, len(part)), np.int32).tobytes()

    def solve_many(self, parts: list[str]) -> None:
        """``solve`` for many short parts at once: one step of the recursion is an array step over all parts."""

        lengths = np.array([len(p) for p in parts])
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(parts)), lengths)
        offset = np.arange(len(points)) - starts[word]
        left = lengths[word] - offset
        # every piece found at any place: where, how long, its score and id
        places, sizes, values, names = [], [], [], []
        hashes_at, open_ = B.hashes_at(points), np.arange(len(points))
        for size in range(1, min(self.longest, int(lengths.max())) + 1):
            keys, scores, ids, likely = self.tables[size]
            open_ = open_[left[open_] >= size]
            hashes = hashes_at(open_, size)
            begun = likely[hashes >> np.uint64(44)]
            open_, hashes = open_[begun], hashes[begun]       # others begin no longer piece either
            row = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[row] == hashes
            at, row = open_[hit], row[hit]
            score, name = scores[row], ids[row]
            if size == 1:
                none = np.ones(len(points), bool)
                none[at] = False
                none = np.flatnonzero(none)
                at, score, name = np.append(at, none), np.append(score, np.full(len(none), float(self.unknown))), np.append(name, np.full(len(none), -1))
            places.append(at)
            sizes.append(np.full(len(at), size))
            values.append(score)
            names.append(name)
        place, size, value, name = (np.concatenate(x) for x in (places, sizes, values, names))
        order = np.argsort(offset[place].astype(np.uint8), kind="stable")
        place, size, value, name = place[order], size[order], value[order], name[order]
        node = place + word[place]                           # a part of n characters has n + 1 nodes
        to, step = node + size, np.searchsorted(offset[place], np.arange(int(lengths.max()) + 1))
        nodes = starts + np.arange(len(parts))
        best = np.full(len(points) + len(parts), NEVER)
        back, last = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        best[nodes] = 0
        for a, b in zip(step[:-1], step[1:], strict=True):
            # pieces that begin at one offset end at different nodes
            other = best[node[a:b]] + value[a:b]
            better = np.flatnonzero(other > best[to[a:b]]) + a
            goal = to[better]
            best[goal], back[goal], last[goal] = other[better - a], size[better], name[better]
        found_at, found_ids, at, own = [], [], nodes + lengths, np.arange(len(parts))
        while len(own):
            found_at.append(own)
            found_ids.append(last[at])
            at = at - back[at]
            more = at > nodes[own]
            at, own = at[more], own[more]
        owner, ids = np.concatenate(found_at[::-1]), np.concatenate(found_ids[::-1])
        order = np.argsort(owner, kind="stable")
        unknown = owner[ids < 0]
        raw, cuts = ids[order].astype(np.int32).tobytes(), (4 * np.searchsorted(owner[order], np.arange(len(parts) + 1))).tolist()
        self.solved |= zip(parts, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        # characters without a piece become bytes: those parts are few
        for k in np.unique(unknown).tolist():
            self.solved[parts[k]] = self.solve(parts[k])

    def encode(self, marked: str) -> tuple[int, list[int]]:
        """Best score and ids of a text that has its blank marks."""

        ids = np.frombuffer(self.encode_texts([marked])[0], np.int32)
        return int(self.values[ids].sum()), ids.tolist()

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of many texts, four bytes each; their distinct parts are solved together, a bounded number at a time."""

        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            for block in self.blocks(text):
                held.append((k, self.part.findall(block)))
                size += len(block)
                if size >= BLOCK_CHARS:
                    self._finish(held, out)
                    held, size = [], 0
        self._finish(held, out)
        return [b"".join(x) for x in out]

    def _finish(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        wanted = set(chain.from_iterable(parts for _, parts in held))
        new = wanted - self.solved.keys()
        if len(self.solved) + len(new) > CACHE:
            self.solved.clear()
            new = wanted
        if short := [p for p in new if len(p) <= SHORT]:
            self.solve_many(short)
        for part in new:
            if len(part) > SHORT:
                self.solved[part] = self.solve(part)
        for k, parts in held:
            out[k].append(b"".join(map(self.solved.__getitem__, parts)))

    def blocks(self, marked: str) -> Iterator[str]:
        """Stretches of a text between places where paths meet, so that what is solved at once stays bounded."""

        at = 0
        while len(marked) - at > 2 * BLOCK_CHARS:
            cut = self.meet.search(marked, at + BLOCK_CHARS)
            if cut is None:
                break
            yield marked[at:cut.start()]
            at = cut.start()
        yield marked[at:]

    def transfer(self, text: str, n: int) -> np.ndarray:
        """Best score from each entering to each leaving state of a chunk of n characters; text has the lookahead."""

        m = self.longest
        out = np.full((m, m), NEVER)
        meets = [x.start() for x in self.meet.finditer(text, 0, n)]
        first = next((p for p in meets if p >= m - 1), None)
        if first is None:
            for i in range(min(m, n + 1)):
                best, _ = self.forward(text, i, n)
                out[i, :len(best[n:])] = [NEVER if b is None else b for b in best[n:]]
            return out
        last = meets[-1]
        middle = self.encode(text[first:last])[0]
        best, _ = self.forward(text[last:], 0, n - last)
        leave = np.array([NEVER if b is None else b for b in best[n - last:]])
        for i in range(m):
            out[i, :len(leave)] = self.forward(text[:first], i, first)[0][first] + middle + leave
        return out

    def enters(self, text: str, n: int, given: np.ndarray) -> np.ndarray:
        """The entering state that belongs to each leaving state, given the best scores of the entering states."""

        m = self.longest
        out = np.zeros(m, np.int32)
        first = next((x.start() for x in self.meet.finditer(text, 0, n) if x.start() >= m - 1), None)
        if first is None:
            best, back = self.forward(text, 0, n, given)
            ends = [(k, n + k) for k in range(m) if n + k <= len(text) and best[n + k] is not None]
        else:
            _, back = self.forward(text[:first], 0, first, given)
            ends = [(slice(None), first)]
        for k, at in ends:
            while back[at] >= 0:
                at = back[at]
            out[k] = at
        return out

    def between(self, text: str, n: int, enter: int, leave: int) -> list[int]:
        """Ids of the pieces that begin in a chunk, given its two states."""

        meets = [x.start() for x in self.meet.finditer(text, 0, n) if x.start() >= enter]
        if not meets:
            _, back = self.forward(text, enter, n)
            return self.trace(text, back, enter, n + leave)
        first, last = meets[0], meets[-1]
        _, head = self.forward(text[:first], enter, first)
        _, tail = self.forward(text[last:], 0, n - last)
        return [*self.trace(text[:first], head, enter, first), *self.encode(text[first:last])[1],
                *self.trace(text[last:], tail, 0, n - last + leave)]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        ids, out = np.asarray(ids, np.int64), []
        for at in range(0, len(ids), BLOCK_CHARS):
            block = ids[at:at + BLOCK_CHARS]
            sizes = self.raw_sizes[block]
            shift = self.raw_starts[block] - np.cumsum(sizes) + sizes
            out.append(self.raw[np.repeat(shift, sizes) + np.arange(sizes.sum())].tobytes())
        return b"".join(out).decode("utf-8", "replace")[1:]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def marked(text: str) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""

    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def befores(matrices: list[np.ndarray], given: np.ndarray) -> list[np.ndarray]:
    """Best scores of the states before each matrix, from those before the first."""

    out = [given]
    for m in matrices[:-1]:
        out.append((out[-1][:, None] + m).max(axis=0))
    return out


def entered(maps: list[np.ndarray], leave: int) -> list[int]:
    """The states before, between and after the maps, from the last one."""

    out = [leave]
    for m in maps[::-1]:
        out.append(int(m[out[-1]]))
    return out[::-1]


OUT = "doc_id bigint, n_chars bigint, n_chunks int, n_tokens bigint, ids_sha256 string, round_trip boolean, ids array<int>"
OUT_NAMES = [x.split()[0] for x in OUT.split(", ")]


def _row(v: Vocabulary, doc_id: int | None, text: str | None, n_chunks: int, raw: bytes, with_ids: bool) -> tuple:
    text, ids = text or "", np.frombuffer(raw, np.int32)
    return (doc_id, len(text), n_chunks, len(ids), hashlib.sha256(raw).hexdigest(),
            v.decode(ids) == text.replace(BLANK, " ") if raw else not text, ids if with_ids else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32())]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=OUT_NAMES)


def _whole(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [marked(x or "") for x in batch.column("text").to_pylist()]
            yield _batch([_row(v, d, t, 1 if t else 0, ids, with_ids)
                          for d, t, ids in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), v.encode_texts(texts), strict=True)])
    return run


def _cut(path: str, size: int):
    """Chunks of the giant documents, each with the characters a piece begun in it may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = vocabulary(path).longest - 1
        for batch in batches:
            for key, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
                text = marked(text)
                starts = range(0, len(text), size)
                n = len(starts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([key] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()),
                    pa.array([min(size, len(text) - s) for s in starts], pa.int32()),
                    pa.array([text[s:s + size + ahead] for s in starts], pa.string()),
                ], names=["key", "doc_id", "chunk", "n", "text"])
    return run


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            found = [v.transfer(t, n).tobytes() for t, n in zip(batch.column("text").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(found, pa.binary())], names=["key", "chunk", "matrix"])
    return run


def _loaded(table: pa.Table, by: str, column: str, kind: type = np.float64) -> tuple[pa.Table, list[np.ndarray]]:
    table = table.sort_by(by)
    return table, [np.frombuffer(x.as_py(), kind) for x in table.column(column)]


def _square(found: list[np.ndarray]) -> list[np.ndarray]:
    return [x.reshape(int(len(x) ** 0.5), -1) for x in found]


def _combine(table: pa.Table) -> pa.Table:
    """The product of the matrices of a block."""

    table, found = _loaded(table, "chunk", "matrix")
    total, *others = _square(found)
    for m in others:
        total = product(total, m)
    return pa.table({"key": table.column("key")[:1], "block": table.column("block")[:1], "matrix": pa.array([total.tobytes()], pa.binary())})


def _block_befores(table: pa.Table) -> pa.Table:
    table, found = _loaded(table, "block", "matrix")
    found = _square(found)
    given = np.full(len(found[0]), NEVER)
    given[0] = 0
    return pa.table({"key": table.column("key"), "block": table.column("block"),
                     "before": pa.array([x.tobytes() for x in befores(found, given)], pa.binary())})


def _chunk_befores(table: pa.Table) -> pa.Table:
    table, found = _loaded(table, "chunk", "matrix")
    given = np.frombuffer(table.column("before")[0].as_py())
    return pa.table({"key": table.column("key"), "chunk": table.column("chunk"),
                     "before": pa.array([x.tobytes() for x in befores(_square(found), given)], pa.binary())})


def _maps(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            found = [v.enters(r["text"], r["n"], np.frombuffer(r["before"])).tobytes() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(found, pa.binary())], names=["key", "chunk", "map"])
    return run


def _composed(table: pa.Table) -> pa.Table:
    """The map of a block: from the state it is left in to the state it was entered in."""

    table, found = _loaded(table, "chunk", "map", np.int32)
    total = found[-1]
    for m in found[-2::-1]:
        total = m[total]
    return pa.table({"key": table.column("key")[:1], "block": table.column("block")[:1], "map": pa.array([total.tobytes()], pa.binary())})


def _block_leaves(table: pa.Table) -> pa.Table:
    table, found = _loaded(table, "block", "map", np.int32)
    return pa.table({"key": table.column("key"), "block": table.column("block"), "leave": pa.array(entered(found, 0)[1:], pa.int32())})


def _chunk_states(table: pa.Table) -> pa.Table:
    table, found = _loaded(table, "chunk", "map", np.int32)
    at = entered(found, table.column("leave")[0].as_py())
    return pa.table({"key": table.column("key"), "chunk": table.column("chunk"),
                     "enter": pa.array(at[:-1], pa.int32()), "leave": pa.array(at[1:], pa.int32())})


def _traced(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            rows = batch.to_pylist()
            ids = [v.between(r["text"], r["n"], r["enter"], r["leave"]) for r in rows]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("key", "doc_id", "chunk")), pa.array([r["text"][:r["n"]] for r in rows], pa.string()),
                pa.array(ids, pa.list_(pa.int32()))], names=["key", "doc_id", "chunk", "text", "ids"])
    return run


def _gathered(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for row in batch.to_pylist():
                parts = sorted(row["parts"], key=lambda x: x["chunk"])
                text = "".join(x["text"] for x in parts)[1:].replace(BLANK, " ")
                yield _batch([_row(v, row["doc_id"], text, len(parts), np.array([i for x in parts for i in x["ids"]], np.int32).tobytes(), with_ids)])
    return run


def _block() -> Column:
    return F.floor(F.col("chunk") / BLOCK).cast("int")


def encode_documents(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS, with_ids: bool = True) -> DataFrame:
    """One row per document: ids (if asked for), their number and digest, and whether decoding gives the text."""

    spark = docs.sparkSession
    prepare(spark)
    docs = documents(docs)
    giant = F.length("text") > chunk_chars
    small = docs.where(~F.coalesce(giant, F.lit(False))).mapInArrow(_whole(path, with_ids), OUT)
    large = docs.where(giant).withColumn("key", F.monotonically_increasing_id()).select("key", "doc_id", "text")
    chunks, _ = keep(large.mapInArrow(_cut(path, chunk_chars), "key bigint, doc_id bigint, chunk int, n int, text string"), "chunks")
    found = chunks.select("key", "chunk", "n", "text").mapInArrow(_matrices(path), "key bigint, chunk int, matrix binary")
    matrices, _ = keep(found.withColumn("block", _block()), "matrices")
    blocks = matrices.groupBy("key", "block").applyInArrow(_combine, "key bigint, block int, matrix binary")
    starts = blocks.groupBy("key").applyInArrow(_block_befores, "key bigint, block int, before binary")
    befores_ = matrices.join(starts, ["key", "block"]).groupBy("key", "block").applyInArrow(_chunk_befores, "key bigint, chunk int, before binary")
    mapped = chunks.join(befores_, ["key", "chunk"]).select("key", "chunk", "n", "text", "before").mapInArrow(_maps(path), "key bigint, chunk int, map binary")
    maps, _ = keep(mapped.withColumn("block", _block()), "maps")
    steps = maps.groupBy("key", "block").applyInArrow(_composed, "key bigint, block int, map binary")
    ends = steps.groupBy("key").applyInArrow(_block_leaves, "key bigint, block int, leave int")
    ready, _ = keep(maps.join(ends, ["key", "block"]).groupBy("key", "block").applyInArrow(_chunk_states, "key bigint, chunk int, enter int, leave int"), "states")
    traced = chunks.join(ready, ["key", "chunk"]).mapInArrow(_traced(path), "key bigint, doc_id bigint, chunk int, text string, ids array<int>")
    rows = traced.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("chunk", "text", "ids")).alias("parts"))
    return small.union(rows.drop("key").mapInArrow(_gathered(path, with_ids), OUT))


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else v.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return run


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    prepare(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id bigint, text string")
