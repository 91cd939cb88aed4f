"""Ranked lexical search against scoring each document."""

from __future__ import annotations

import collections
import math
import random
import re

import duckdb
import pytest

pytest.importorskip("chronofold.llm.queries")
from chronofold.llm import queries, tiered_search  # noqa: E402

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    rows = [(i, collections.Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n, length = len(rows), sum(x[2] for x in rows)
    df = collections.Counter(t for _, c, _ in rows for t in c)
    asked = collections.defaultdict(collections.Counter)
    for i, text in set(items):
        if i is not None:
            asked[i].update(terms(text))
    out = []
    for item, c in asked.items():
        scored = []
        for i, d, m in rows:
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * d[t]) // (1000 * d[t] + 8 * (25 + (75 * m * n) // length))) for t, q in c.items() if t in d)
            if s and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def rows_of(df):
    assert dict(df.dtypes)["rank"] == "int"
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))


def test_the_query_and_its_sql(spark, small):
    got = rows_of(queries.op12_tiered_search(spark, small))
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{small}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got == plain(docs, items)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    theirs = c.sql(queries.oracle_sql()["op12_tiered_search"])
    at = [theirs.columns.index(x) for x in ("item_id", "rank", "doc_id", "score")]
    assert got == sorted(tuple(r[i] for i in at) for r in theirs.fetchall())


def made(seed, n_docs, n_items):
    """Words of very different frequency, hot words, copies, ties, long and empty texts, odd signs."""
    rng = random.Random(seed)
    words = ["The", "of", "a1", "É", "é", "ß", "K", "İ", "日本", *(f"w{k}" for k in range(400))]
    some = lambda n: rng.choice([" ", "-", "\n", "_"]).join(words[min(int(rng.paretovariate(0.6)) - 1, len(words) - 1)] for _ in range(n))
    docs = [(k, some(rng.randint(1, 60))) for k in range(n_docs)]
    docs += [(None, docs[0][1]), (None, None), (5000, None), (5001, ""), (5002, " .,:;\0 "), (5003, some(3000)), (3, some(9)), docs[4], docs[4]]
    items = [(k, some(rng.randint(1, 12))) for k in range(n_items)] + [(7, "more w1 w2"), (None, "w1"), (9000, None), (9001, "?"), (9002, "nowhere"), (9003, some(500)), (9004, "the the The")]
    return docs, [*items, items[0], items[0]]


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x", None) for i, t in docs], "doc_id long, text string, n long, terms string, item_id long").repartition(5)
    return d, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int").repartition(3)


@pytest.mark.parametrize("entries", [400_000, 40])
def test_odd_rows(spark, monkeypatch, entries):
    monkeypatch.setattr(tiered_search, "ENTRIES", entries)
    monkeypatch.setattr(tiered_search, "CELLS", 1000)
    monkeypatch.setattr(tiered_search, "PIECE", 50)
    docs, items = made(1, 150, 12)
    d, b = frames(spark, docs, items)
    assert rows_of(tiered_search.search(d, b)) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = made(2, 5, 3)
    d, b = frames(spark, docs, items)
    for x, y in ((d.limit(0), b), (d, b.limit(0)), (d.filter("text is null"), b), (d, b.filter("item_id = 9001"))):
        assert tiered_search.search(x, y).count() == 0


def test_some_items_are_proven_early_and_some_fall_through(spark, monkeypatch):
    """With tiers that hold part of the common words only; the answers are those of all postings."""
    monkeypatch.setattr(tiered_search, "FEW", 30)
    monkeypatch.setattr(tiered_search, "LEVEL", 1 << 10)
    docs, items = made(3, 1500, 40)
    items += [(10_000 + k, docs[k][1]) for k in range(20)]  # whole documents
    d, b = frames(spark, docs, items)
    proofs = []
    assert rows_of(tiered_search.search(d, b, k=3, proofs=proofs)) == plain(docs, items, 3)
    assert proofs[0][0] > 0 and proofs[0][1] > 0 and sum(x for x, _ in proofs) + proofs[-1][1] == sum(proofs[0])


def test_terms():
    n, counts = tiered_search.term_counts("A-b_C é\0É x" + " y" * 40)
    assert (n, dict(counts)) == (46, {b"a": 1, b"b": 1, b"c": 1, "é".encode(): 1, "É".encode(): 1, b"x": 1, b"y": 40})
