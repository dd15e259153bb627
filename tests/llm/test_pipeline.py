"""The pipeline's stages on a small corpus with planted cases."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tests.llm import plain


def corpus() -> tuple[list[tuple], list[tuple], list[tuple]]:
    r = random.Random(4)
    good, bad = [f"good{i}" for i in range(300)], [f"bad{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(240):
        label = int(i % 4 > 0)
        docs.append((i, " ".join(r.choice(good if label else bad) for _ in range(40))))
        labels.append((i, label, 0))
    item = " ".join(r.choice(good) for _ in range(30))
    docs += [(300 + k, docs[1][1]) for k in range(5)]
    docs += [(310, docs[2][1].replace(docs[2][1].split()[20], "changed", 1)), (320, f"{docs[3][1]} {item} {docs[5][1]}"),
             (330, f"{docs[6][1]} password=abcdefgh12345678 {docs[7][1]}"), (340, None), (None, " ".join(r.choice(good) for _ in range(30)))]
    return docs, labels, [(1, item), (2, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("corpus"))
    docs, labels, items = corpus()
    rows = [(d, t, "en", "src0", None if t is None else len(t)) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_each_stage_on_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(x) for x in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(x) for x in given.select("doc_id", "text").collect()]
        given = spark.createDataFrame(stage(spark, given, folder).collect(), docs.schema)
        assert given.columns == docs.columns
        after = {x["doc_id"]: x["text"] for x in given.collect()}
        if name == "quality classifier":
            assert all(i in after for i in range(240) if i % 4) and not any(i in after for i in range(0, 240, 4))
        if name == "near-duplicates":
            assert set(after) == {d for d, _, _, kept in plain.near(before, 5, 80) if kept}
        if name == "benchmark decontamination":
            assert set(after) == {d for d, *_, bad in plain.contaminated(before, items, 10) if not bad}
            assert 320 not in after
        if name == "secret scans":
            assert set(after) == {d for d, _ in before} and "abcdefgh12345678" not in after[330] and "[assign]" in after[330]
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in given.collect())


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in found}
    assert {1, 2, 3} <= ids and not ids & {0, 300, 304, 320}
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in found)


def test_empty_tables(spark, tmp_path):
    docs, labels = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"
    for name, ddl in (("documents", docs), ("labels", labels), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
