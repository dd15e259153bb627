"""Near-duplicate detection: fast similarity sketches, banding, exact verification.

1. Sketch. In round i every shingle hashes to one bin and a value there; a bin keeps the
   smallest (round, value). Rounds go on until every bin is filled; after ``bins`` rounds bin i
   itself takes the minimum over all shingles, so at most 2 * bins rounds fill every coordinate. Two
   sets agree in a coordinate with the probability of their similarity, with concentration as for
   independent samples, in one round for large sets.
2. Equal sets collapse to one class. Bands of the sketch bring classes of similar sets together:
   at a similarity of 0.8 a pair shares no band with a probability below 1e-7.
3. Classes that share bands, directly or through others, form candidate groups. Within a
   group links are confirmed on the full sets: from a pivot to all classes not yet linked, breadth
   first, so only pairs that could still join two components are compared. Groups above
   ``group_values`` shingles are first compared with a few pivots each; what no pivot
   links is compared with the group in blocks of bounded size.
4. Components of the confirmed links, then back to every document by its class.

Defined results: an empty set (null, empty or blank text) is linked with nothing; a null doc_id
counts as larger than every id and comes out as null, so a component of null ids alone has a null
component_id; a row has the component of its class, whichever other rows have its doc_id;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailmine.llm import bytesops as B
from mailmine.llm.tables import documents, keep, prepare, shards
from mailmine.operators.components import connected_components


@dataclass(frozen=True)
class NearParams:
    shingle: int = 5                 # words
    percent: int = 80                # least similarity of a link
    bands: int = 56
    rows: int = 6                    # coordinates of a band
    group_values: int = 4_000_000    # shingles of one task of the confirmation
    pivots: int = 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its shingles; a shorter text is one shingle."""

    data = B.LOWER[data]
    starts, ends, rows = B.word_bounds(data, offsets)
    words = B.word_hashes(data, starts, ends)
    firsts, lasts, counts = [], [], []
    lengths = np.diff(rows)
    n = np.where(lengths == 0, 0, np.maximum(lengths - size + 1, 1))
    owner = np.repeat(np.arange(len(n)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + rows[:-1][owner]
    last = np.minimum(first + size, rows[1:][owner])
    hashes = B.range_hashes(words, first, last, words=True)
    cuts = np.concatenate([[0], np.cumsum(n)])
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def sketch(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """(len(sets), bins) sketch; no set may be empty."""

    out = np.full((len(sets), bins), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    open_ = np.arange(len(sets))
    values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for step in range(bins):
        h = B.mix(values + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bin_ = ((h >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(flat, owner * bins + bin_, (np.uint64(step) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1)))
        full = (out[open_] != np.iinfo(np.uint64).max).all(axis=1)
        if full.any():
            open_ = open_[~full]
            if not len(open_):
                return out
            stay = np.isin(owner, open_)
            values, owner = values[stay], owner[stay]
    # the last rounds: bin i takes the minimum over all shingles; only open bins can still change
    starts = np.searchsorted(owner, open_)
    for bin_ in np.flatnonzero((out[open_] == np.iinfo(np.uint64).max).any(axis=0)):
        step = bins + int(bin_)
        h = B.mix(values + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & np.uint64((1 << 40) - 1)
        least = np.minimum.reduceat(h, starts)
        column = out[open_, bin_]
        out[open_, bin_] = np.minimum(column, (np.uint64(step) << np.uint64(40)) | least)
    return out


def band_keys(sketches: np.ndarray, p: NearParams) -> np.ndarray:
    keys = np.zeros((len(sketches), p.bands), np.uint64)
    parts = sketches.reshape(len(sketches), p.bands, p.rows)
    for k in range(p.rows):
        keys = B.mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return B.mix(keys + np.arange(p.bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


SKETCHED = "doc_id bigint, text_key bigint, n_shingles bigint, set_key binary, bands array<bigint>"


def _sketched(p: NearParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.texts(batch.column("text"))
            for low, high in B.slices(offsets):
                sets = shingle_sets(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], p.shingle)
                some = [s for s in sets if len(s)]
                found = iter(band_keys(sketch(some, p.bands * p.rows), p)) if some else iter(())
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(low, high - low) for c in ("doc_id", "text_key")), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ], names=["doc_id", "text_key", "n_shingles", "set_key", "bands"])
    return run


def _set_key(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _sets(p: NearParams):
    """The full sets of the class representatives, ``(grp, rep, n, values)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.texts(batch.column("text"))
            keys, reps, groups = (batch.column(c).to_pylist() for c in ("set_key", "rep", "grp"))
            for low, high in B.slices(offsets):
                sets = shingle_sets(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], p.shingle)
                rows = [(groups[low + k], reps[low + k], len(s), s.tobytes()) for k, s in enumerate(sets) if len(s) and _set_key(s) == keys[low + k]]
                if rows:
                    grp, rep, n, values = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(rep, pa.int64()), pa.array(n, pa.int64()),
                                                      pa.array(values, pa.binary())], names=["grp", "rep", "n", "values"])
    return run


def linked(reps: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest representative it is linked with, through others too."""

    label = np.full(len(sets), -1, np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets], np.int64)
    start = np.cumsum(size) - size
    seen = np.zeros(int(flat.max()) + 1, bool)
    order = np.argsort(reps, kind="stable")
    rest = order          # sets without a label, with their values side by side
    values = np.concatenate([flat[start[k]:start[k] + size[k]] for k in rest])
    for first in order:
        if label[first] >= 0:
            continue
        label[first], queue = reps[first], [first]
        while queue:
            pivot = queue.pop()
            mine = flat[start[pivot]:start[pivot] + size[pivot]]
            if (label[rest] >= 0).mean() > 0.25:     # drop what has a label
                rest = rest[label[rest] < 0]
                values = np.concatenate([flat[start[k]:start[k] + size[k]] for k in rest]) if len(rest) else values[:0]
            if not len(rest):
                break
            seen[mine] = True
            common = np.add.reduceat(seen[values].astype(np.int64), np.cumsum(size[rest]) - size[rest])
            seen[mine] = False
            near = rest[(100 * common >= percent * (size[rest] + size[pivot] - common)) & (label[rest] < 0)]
            label[near] = reps[first]
            queue += near.tolist()
    return label


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    return (np.asarray(table.column("grp")), np.asarray(table.column("rep")),
            [np.frombuffer(v.as_py(), np.uint64) for v in table.column("values")])


def _confirm(percent: int):
    """Links inside the groups of one shard."""

    def run(table: pa.Table) -> pa.Table:
        grp, rep, sets = _arrays(table)
        order = np.argsort(grp, kind="stable")
        cuts = np.flatnonzero(np.append(True, grp[order][1:] != grp[order][:-1]))
        out_a, out_b = [], []
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            own = order[a:b]
            label = linked(rep[own], [sets[k] for k in own], percent)
            moved = label != rep[own]
            out_a.append(rep[own][moved])
            out_b.append(label[moved])
        return pa.table({"a": pa.array(np.concatenate(out_a), pa.int64()), "b": pa.array(np.concatenate(out_b), pa.int64())})
    return run


def _to_pivots(percent: int):
    """Links of the classes of a large group with its pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = np.frombuffer(r["values"], np.uint64)
                for pivot in r["pivots"]:
                    other = np.frombuffer(pivot["values"], np.uint64)
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    if pivot["rep"] != r["rep"] and 100 * common >= percent * (len(own) + len(other) - common):
                        out.append((r["rep"], pivot["rep"]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
    return run


def _large_groups(sets: DataFrame, p: NearParams) -> DataFrame:
    """Confirmed links ``(a, b)`` that give the components of groups too large for one task."""

    rank = F.xxhash64("rep")
    pivots = sets.groupBy("grp").agg(F.min_by("rep", rank).alias("p1"), F.min("rep").alias("p2"), F.max_by("rep", rank).alias("p3"),
                                     F.max("rep").alias("p4"))
    pivots = pivots.select("grp", F.explode(F.array_distinct(F.slice(F.array("p1", "p2", "p3", "p4"), 1, p.pivots))).alias("rep"))
    chosen = sets.join(pivots, ["grp", "rep"], "left_semi")
    chosen = chosen.groupBy("grp").agg(F.collect_list(F.struct("rep", "values")).alias("pivots"))
    links, _ = keep(sets.join(chosen, "grp").mapInArrow(_to_pivots(p.percent), "a bigint, b bigint"), "links")
    found = connected_components(links)
    labels = sets.select("grp", "rep", "n").join(found, F.col("rep") == F.col("node"), "left").select(
        "grp", "rep", "n", F.coalesce("component", "rep").alias("label"))
    # the largest component of a group needs no comparison with itself
    main = labels.groupBy("grp", "label").agg(F.count("*").alias("members"))
    main = main.groupBy("grp").agg(F.max_by("label", F.struct("members", "label")).alias("main"))
    sides = labels.join(main, "grp").select("grp", "rep", "n", (F.col("label") != F.col("main")).alias("apart"))
    totals = sides.groupBy("grp").agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col("apart"), F.col("n")).otherwise(0)).alias("n_apart"))
    half = F.lit(max(1, p.group_values // 2))
    sides = sides.join(totals.where("n_apart > 0"), "grp")
    blocks_apart, blocks_all = F.ceil(F.col("n_apart") / half), F.ceil(F.col("n_all") / half)
    sides = sides.withColumn("own", F.pmod(rank, blocks_apart)).withColumn("other", F.pmod(F.xxhash64("rep", F.lit(1)), blocks_all))
    # every class meets every class that stands apart: rows go to the tasks (block apart, block of all)
    left = sides.where("apart").select("rep", "grp", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks_all - 1)).alias("j"))
    right = sides.select("rep", "grp", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks_apart - 1)).alias("i"), F.col("other").alias("j"))
    pairs = left.select("rep", "grp", "i", "j").union(right.select("rep", "grp", "i", "j")).distinct()
    blocks = sets.select("rep", "values").join(pairs, "rep")
    more = blocks.groupBy("grp", "i", "j").applyInArrow(_confirm(p.percent), "a bigint, b bigint")
    return links.union(more)


def _row_key() -> tuple[Column, Column]:
    """doc_id and text_key: tell rows of different texts apart, also where ids are missing or shared."""

    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(B.NO_ID)), F.xxhash64(F.lit("text"), F.col("text").cast("string"))


def _components(docs: DataFrame, p: NearParams) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, component, component_id): one row per document.

    ``component`` is a key of classes and tells components apart whatever their ids; it is null
    for an empty set. ``component_id`` is the smallest doc_id of the component. A null doc_id is NO_ID.
    """

    prepare(docs.sparkSession)
    doc_id, text_key = _row_key()
    docs = documents(docs).select(doc_id.alias("doc_id"), "text", text_key.alias("text_key"))
    sketched, _ = keep(docs.mapInArrow(_sketched(p), SKETCHED), "sketches")
    # a class is known by the hash of its set, 63 bits as ``linked`` takes no negative keys; its ids may be missing or shared with other classes.
    # One of its texts, told by (doc_id, text_key), gives the full set.
    classes = sketched.where("set_key is not null").groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.any_value("bands").alias("bands"))
    classes = classes.select("set_key", F.shiftrightunsigned(F.xxhash64("set_key"), 1).alias("rep"), "first.doc_id", "first.text_key", "bands")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges, _ = keep(banded.join(hubs, "band").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "edges")
    groups, _ = keep(connected_components(edges), "groups")
    members = classes.drop("bands").join(groups, F.col("rep") == F.col("node")).select(
        "doc_id", "text_key", "set_key", "rep", F.col("component").alias("grp"))
    text = docs.join(members, ["doc_id", "text_key"]).select("set_key", "rep", "grp", "text")
    sets, _ = keep(text.mapInArrow(_sets(p), "grp bigint, rep bigint, n bigint, values binary").dropDuplicates(["rep", "grp"]), "sets")
    sizes = sets.groupBy("grp").agg(F.sum("n").alias("total"))
    large = sizes.where(F.col("total") > p.group_values).select("grp")
    n = shards(sets.agg(F.sum("n")).first()[0] or 0, p.group_values // 2)
    small = sets.join(large, "grp", "left_anti").withColumn("shard", F.pmod(F.xxhash64("grp"), F.lit(n)))
    links = small.groupBy("shard").applyInArrow(_confirm(p.percent), "a bigint, b bigint")
    if large.limit(1).count():
        links = links.union(_large_groups(sets.join(large, "grp", "left_semi"), p))
    links, _ = keep(links, "confirmed")
    found = connected_components(links).withColumnRenamed("node", "rep")
    joined, _ = keep(classes.select("rep", "doc_id").join(found, "rep"), "components")
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = joined.select("rep", "component").join(least, "component")
    by_class = classes.select("set_key", "rep", "doc_id").join(joined, "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = sketched.select("doc_id", "text_key", "n_shingles", "set_key").join(by_class, "set_key", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def find_near_duplicates(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document."""

    none = F.lit(B.NO_ID)
    return _components(docs, params).select(
        F.nullif("doc_id", none).alias("doc_id"), "n_shingles", F.nullif("component_id", none).alias("component_id"),
        (F.col("doc_id") == F.col("component_id")).alias("kept"))


def without_near_copies(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """One row of ``docs`` per component: smallest doc_id, of equal ones the smallest text key. Empty
    texts are linked with nothing; of those with equal doc_id and text one row stays."""

    rows = _components(docs, params)
    row = F.struct("doc_id", "text_key")
    kept = rows.where("component is not null").groupBy("component").agg(F.min(row).alias("row")).select("row")
    kept = kept.union(rows.where("component is null").select(row.alias("row"))).select("row.*").distinct()
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_text"))
    doc_id, text_key = _row_key()
    same = (doc_id == F.col("kept_id")) & (text_key == F.col("kept_text"))
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])
