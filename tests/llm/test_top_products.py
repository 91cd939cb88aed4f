"""Exact top-k search against all products."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

pytest.importorskip("chronofold.llm.queries")
from chronofold.llm import queries, top_products  # noqa: E402


def plain(rows, k=10, every=100):
    """Python integers, one pair after the other."""
    whole = {(i, tuple(max(-(2**63), min(2**63 - 1024, math.floor(1024 * float(x)))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for qi, q in whole:
        if qi % every == 0:
            all_ = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, p, strict=False)))), pi) for pi, p in whole if pi != qi]
            out += [(qi, r + 1, pi, -s) for r, (s, pi) in enumerate(sorted(all_)[:k])]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def test_the_query_and_its_sql(spark, small):
    got = rows_of(queries.op11_top_products(spark, small))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert got == plain(rows)
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    theirs = c.sql(queries.oracle_sql()["op11_top_products"])
    at = [theirs.columns.index(x) for x in ("query_id", "rank", "vec_id", "score")]
    assert got == sorted(tuple(r[i] for i in at) for r in theirs.fetchall())


def test_odd_rows(spark):
    """Nulls, non-finite and huge components, other widths, zero vectors, repeated rows and ids, ties, a column of a clashing name."""
    rng = random.Random(3)
    rows = [(k, [rng.choice([-1.0, 0.0, 0.5, 1 / 3]) for _ in range(rng.choice([3, 3, 5]))]) for k in range(0, 260)]
    rows += [(None, [1.0, 2.0, 3.0]), (400, None), (500, [1.0, None]), (600, [float("nan"), 1.0]), (700, [float("inf")]), (800, []), (900, [0.0, 0.0, 0.0]), (1000, [1e12, -1e12, 3.0]), (1001, [1e300, 1.0]), (1100, [-1e300, 2.0])]
    rows += [rows[0], rows[0], rows[7], (100, [9.0, 9.0, 9.0]), (7, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, place int, score double").repartition(5)
    assert rows_of(top_products.top_products(df)) == plain(rows)
    assert top_products.top_products(df.limit(0)).count() == 0
    assert top_products.top_products(df.filter("vec_id % 100 <> 0")).count() == 0
    few = [r for r in rows if r[0] in (0, 1, 2)]
    assert rows_of(top_products.top_products(df.filter("vec_id in (0, 1, 2)"))) == plain(few)


@pytest.mark.parametrize("seed", [1, 2])
def test_queries_in_many_blocks_and_buckets(spark, monkeypatch, seed):
    monkeypatch.setattr(top_products, "BLOCK_NUMBERS", 200)
    monkeypatch.setattr(top_products, "BUCKET", 32)
    rng = np.random.default_rng(seed)
    rows = [(k, (rng.normal(size=8) * rng.lognormal(0, 1)).tolist()) for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    from pyspark.sql import functions as F

    assert rows_of(top_products.top_products(df, k=4, is_query=F.col("vec_id") % 9 == 0)) == plain(rows, 4, 9)


@pytest.mark.parametrize("kind", ["lengths", "clusters", "plain", "copies"])
def test_pruning_loses_nothing(kind, monkeypatch):
    """Each way of pruning is taken on rows made for it, and the answers are those of all products."""
    monkeypatch.setattr(top_products, "BUCKET", 512)
    monkeypatch.setattr(top_products, "LOOKUPS", 16)
    rng = np.random.default_rng(7)
    n, d, k = 6000, 24, 5
    v = rng.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "lengths":
        v *= rng.lognormal(0, 1.5, size=(n, 1))
    if kind == "clusters":  # tight ones of nearly one length, in no order, so that thresholds are near 1 and length tells little
        v = v[rng.integers(0, 40, n)] + 0.002 * v
        v *= 20 / np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "copies":
        v = v[rng.integers(0, 3, n)]
    whole = np.floor(1024 * v).astype(np.int64)
    ids = rng.permutation(n).astype(np.int64)
    if kind != "clusters":
        whole = whole[np.argsort(-np.linalg.norm(whole, axis=1), kind="stable")]
    own = np.flatnonzero(ids % 50 == 0)
    search = top_products.Search(ids[own], whole[own], k)
    for a in range(0, n, 512):
        search.bucket(ids[a : a + 512], whole[a : a + 512])
    got = sorted(zip(search.ids[search.best.query].tolist(), search.best.score.tolist(), search.best.vec.tolist(), strict=True))
    want = []
    for q in own:
        s = whole @ whole[q]
        order = [x for x in np.lexsort((ids, -s)) if ids[x] != ids[q]][:k]
        want += [(int(ids[q]), int(s[x]), int(ids[x])) for x in order]
    assert got == sorted(want)
    seen = search.seen
    if kind == "lengths":
        assert seen["multiplied"] < 0.1 * n * len(own) and seen["skipped"] > 0
    if kind == "clusters":
        assert 0 < seen["looked up"] < 0.1 * n * len(own)


def test_intervals_hold():
    rng = np.random.default_rng(1)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(20_000, 3)), rng.normal(size=(20_000, 3))))
    low, high = top_products.interval(x[:, 0], (x * y).sum(axis=1))
    assert (low <= y[:, 0]).all() and (y[:, 0] <= high).all()
