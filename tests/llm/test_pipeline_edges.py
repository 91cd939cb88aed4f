"""Each stage of the pipeline on nulls, empties, repeats, very long texts, clashing columns and empty tables."""

import random

import pytest

pytest.importorskip("chronofold.llm.queries")
import corpus_pipeline  # noqa: E402

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, p long, root long, cell string, score double, row string, h long, u long, key long, y double, fold int, at long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edges"))
    rng = random.Random(2)
    words = ["lore", "mipsa", "dolar", "sitta", "ametor", "conse", "tetura"]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over 5 lazy dogs near the mill"), (2, None), (None, "x y z u v w"), (3, ""), (4, "short")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = [(k, prose(60) if k % 3 else "!!! ### " * 30) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "  \n\t"), (None, prose(50)), (None, None), (103, "the quick brown fox jumps over 9 lazy dogs near the mill"), (104, "w " * 200_000), (105, "y" * 300_000), rows[4], rows[4], (106, rows[7][1])]
    full = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "a", 7, 1, 2, "c", 0.5, "r", 3, 4, 5, 0.1, 6, 8) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, CLASHING).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stage_on_odd_rows(spark, folder, at):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs, folder)
    got = out.collect()
    if at == len(corpus_pipeline.STAGES) - 1:
        assert len(got) == docs.count() and all(r["n_tokens"] >= 1 for r in got)
        return
    assert out.schema == docs.schema
    whole = [tuple(r) for r in docs.collect()]
    kept = [tuple(r) for r in got]
    assert all(kept.count(r) <= whole.count(r) for r in set(kept))
    ids = {r["doc_id"] for r in got}
    if name == "quality":
        assert len(ids & set(range(0, 60, 3))) <= 2 and len(ids & {k for k in range(60) if k % 3}) >= 38
    if name == "near_duplicates":
        assert {100, 7, 4, None} <= ids and not {101, 102, 106} & ids and sum(r["doc_id"] == 4 for r in got) == 3
    if name == "decontamination":
        assert ids == {r[0] for r in whole} - {103}
    if name == "mixing":
        assert 0 < len(got) <= len(whole)


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stage_on_empty_tables(spark, folder, tmp_path, at):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    _, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs, str(tmp_path))
    assert out.count() == 0
    if at < len(corpus_pipeline.STAGES) - 1:
        assert out.schema == docs.schema


def test_run_on_odd_rows(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(got.columns) and got.count() > 0
