"""Queries reach every row of their tables."""

import pandas as pd
from pyspark.sql import functions as F

from chronofold.plans import catalog, catalog_io


def test_all_rows_are_read(spark, small):
    events, part = catalog.t(spark, small, "events"), catalog.t(spark, small, "part")
    for name in ("cached_rows", "learnt_templates"):
        assert catalog.QUERIES[name](spark, small).count() == events.count()
    assert catalog._items(spark, small).count() == catalog.t(spark, small, "lineitem").count()
    more = part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 400))
    seen = []
    keep, catalog.t = catalog.t, lambda *_: more
    fold, catalog.fuzzy.entities_of_fragments = catalog.fuzzy.entities_of_fragments, lambda f, dim, k: seen.append(f)
    try:
        catalog.entities_of_frames(spark, small)
    finally:
        catalog.t, catalog.fuzzy.entities_of_fragments = keep, fold
    assert seen[0].count() == seen[0].select("frame_id", "frag_no").distinct().count() == 2 * part.count()


def test_pictures_are_shrunk_by_the_batch(monkeypatch):
    """Not by the picture, each in a table of its own: two batches give two tables, with each picture's own means."""

    class Batches:
        select = lambda self, *_: self
        mapInPandas = lambda self, f, _: list(f(iter([pd.DataFrame({"p_partkey": k}) for k in (range(5000), range(5000, 5100), [])])))  # noqa: E731, N815

    monkeypatch.setattr(catalog_io, "t", lambda *_: Batches())
    got = catalog_io.shrunk_pictures(None, "")
    assert [len(x) for x in got] == [30000, 600, 0]
    for k, x, y, value in got[1].itertuples(index=False):
        assert value == (sum((k + a + 3 * b) * 7 % 256 for a in (2 * x, 2 * x + 1) for b in (2 * y, 2 * y + 1)) + 2) // 4


def test_frames_are_dealt_by_number(spark, small, monkeypatch):
    """A task's share of the lines is bounded, whatever the session's number of partitions."""
    monkeypatch.setattr(catalog.nearest, "FRAME_ROWS", 500)
    n = -(-catalog.t(spark, small, "lineitem").count() // 500)
    plan = catalog.nearest_boxes(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert n > 4 and f"{n}), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
