"""The co-bucketed pair of tables against plain Python, file by file."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest

pytest.importorskip("chronofold.llm.queries")
from chronofold.llm import co_buckets, queries  # noqa: E402

N = co_buckets.BUCKETS
SALES = "sale_id long, status string, total double, run string, bucket int, sold_at timestamp_ntz"
LINES = "_to_file long, item_id long, sale_id long, n int, flag string, row boolean, day date"


def crc(text):
    return zlib.crc32(text.encode()) % N


def key_of(row):
    """Nulls first, NaN last, -0.0 as 0.0, strings by bytes."""

    def one(v):
        if v is None:
            return (0,)
        if isinstance(v, float):
            return (2,) if math.isnan(v) else (1, v + 0.0)
        return (1, v.encode() if isinstance(v, str) else v)

    return [one(v) for v in row]


def same(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def expected(sales, lines, sale_cols, line_cols):
    """Each final file's row, and its rows in order, by (table, bucket)."""
    known = {r[sale_cols.index("sale_id")] for r in sales} - {None}
    out = {}
    counts = {}
    for name, rows, cols in (("sales", sales, sale_cols), ("sale_lines", lines, line_cols)):
        at = cols.index("sale_id")
        moves, files, starts = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
        for r in rows:
            k = r[at]
            home = N + 1 if k is None else crc(f"s{k}")
            if name == "sales":
                b, start = home, home - (home % 4 == 1)
            else:
                b = home if k is None or k in known else N
                item = r[cols.index("item_id")]
                start = 0 if item is None else crc(str(item))
            moves[start, b] += 1
            files[b].append(r)
            starts[start].add(b)
            counts.setdefault(k, collections.Counter())[name] += 1
        for b, rs in files.items():
            rs.sort(key=lambda r: key_of([r[at], *(v for i, v in enumerate(r) if i != at)]))
            parts = sorted((s, n) for (s, x), n in moves.items() if x == b)
            ids = ",".join("" if r[at] is None else str(r[at]) for r in rs)
            lineage = ",".join(f"{s}:{n}" for s, n in parts)
            stays = len(parts) == 1 and len(starts[parts[0][0]]) == 1
            out[name, b] = {"columns": ",".join(cols), "ids_sha256": hashlib.sha256(ids.encode()).hexdigest(), "lineage_sha256": hashlib.sha256(lineage.encode()).hexdigest(), "n_rows": len(rs), "rewritten": not stays}, rs
    joined = collections.Counter()
    for k, c in counts.items():
        if k is not None:
            joined[crc(f"s{k}")] += c["sales"] * c["sale_lines"]
    for (name, b), (row, _) in out.items():
        row["n_joined"] = joined[b] if b < N else 0
    return out


def check(got, sales, lines, sale_cols, line_cols):
    want = expected(sales, lines, sale_cols, line_cols)
    rows = got.collect()
    assert len(rows) == len(want) and {(r["table_name"], r["bucket"]) for r in rows} == set(want)
    folders = collections.defaultdict(set)
    for r in rows:
        row, held = want[r["table_name"], r["bucket"]]
        assert {k: r[k] for k in row} == row, (r, row)
        at = r["path"].removeprefix("file://")
        folders[r["table_name"]].add(at)
        table = pq.read_table(at)
        assert table.column_names == row["columns"].split(",")
        found = list(zip(*(table.column(k).to_pylist() for k in range(table.num_columns)), strict=True))
        assert [list(map(same, x)) for x in found] == [list(map(same, x)) for x in held]
    for paths in folders.values():
        folder = next(iter(paths)).rpartition("/")[0]
        assert set(ds.dataset(folder).files) == paths  # starting files that moved are gone


def tuples(df):
    return [tuple(r) for r in df.collect()]


def odd_tables(spark, seed, n):
    """Hot, null and unknown keys, repeats, NaN, zero bytes, two-byte letters, column names that the operator uses itself."""
    rng = random.Random(seed)
    import datetime as dt

    some = lambda *v: rng.choice(v)
    key = lambda: some(7, 7, None, *range(40), -5, 9_007_199_254_740_993)
    sales = [(key(), some(None, "", "a", "a\0b", "a\0", "é", "z"), some(None, 0.0, -0.0, float("nan"), -1.5, 1e300, float("-inf")), some("x", None), some(None, -1, 3), some(None, dt.datetime(2024, 1, 1, 0, 0, k % 60) if (k := rng.randint(0, 99)) else None)) for _ in range(n)]
    lines = [(some(None, 5), some(None, 11, 12, 13, *range(900)), some(key(), key(), 10**6 + rng.randint(0, 9)), some(None, -(2**31), 4), some(None, "\0", "ß", "ss"), some(None, True, False), some(None, dt.date(1969, 12, 31), dt.date(2024, 2, 29))) for _ in range(3 * n)]
    return [*sales, *sales[:5]], [*lines, *lines[:9]]


def test_the_query_on_the_small_tables(spark, small):
    got = queries.op13_co_buckets(spark, small)
    sales, lines = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("sales", "sale_lines"))
    check(got, tuples(sales), tuples(lines), sales.columns, lines.columns)
    assert got.columns == ["table_name", "path", "columns", "ids_sha256", "lineage_sha256", "bucket", "n_rows", "n_joined", "rewritten"]


@pytest.mark.parametrize("limits", [None, (1 << 10, 3, 2, 0, 0), (1 << 10, 3, 2, 2000, 5000)])
def test_odd_rows(spark, limits, monkeypatch):
    """Also with runs of a few rows and blocks of three, merged two at a time, alone or packed."""
    if limits:
        for name, v in zip(("RUN_BYTES", "BLOCK_ROWS", "FAN_IN", "SMALL", "PACKED"), limits, strict=True):
            monkeypatch.setattr(co_buckets, name, v)
    sales, lines = odd_tables(spark, 3, 150)
    a, b = spark.createDataFrame(sales, SALES).repartition(5), spark.createDataFrame(lines, LINES).repartition(7)
    check(co_buckets.co_bucket(a, b), sales, lines, a.columns, b.columns)


def test_empty_tables(spark):
    a, b = spark.createDataFrame([], SALES), spark.createDataFrame([], LINES)
    assert co_buckets.co_bucket(a, b).count() == 0
    lines = odd_tables(spark, 4, 20)[1]
    only = spark.createDataFrame(lines, LINES)
    check(co_buckets.co_bucket(a, only), [], lines, a.columns, only.columns)


def test_columns_of_other_kinds_are_told(spark):
    a, b = spark.createDataFrame([(1, [2])], "sale_id long, x array<int>"), spark.createDataFrame([], LINES)
    with pytest.raises(Exception, match="can't be sorted"):
        co_buckets.co_bucket(a, b).count()


def test_key_order():
    values = [None, -(2**63), -1, 0, 1, 2**63 - 1]
    keys = co_buckets.sort_keys([pa.array(values, pa.int64())]).to_pylist()
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    values = [None, float("-inf"), -2.5, -1e-300, 0.0, 1e-300, 2.5, float("inf"), float("nan")]
    keys = co_buckets.sort_keys([pa.array(values)]).to_pylist()
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    pairs = [(None, 9), ("", 1), ("\0", 0), ("a", 5), ("a\0", 4), ("a\0b", 3), ("ab", 2), ("é", 1), ("😀", 0)]
    keys = co_buckets.sort_keys([pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs])]).to_pylist()
    assert keys == sorted(keys)


def test_merging_holds_one_block_a_run(tmp_path):
    """A long segment is read block by block: what is held doesn't grow with it."""
    from pyarrow import fs

    store, held = fs.LocalFileSystem(), []
    n = 60_000
    index = []
    for k in range(3):
        rows = pa.RecordBatch.from_arrays([pa.array([0] * n), pa.array(range(k, 3 * n, 3))], names=["no", "x"])
        index += co_buckets._spill(store, str(tmp_path), [rows], [0])
    segments = co_buckets.packed([(f"{tmp_path}/{run}", at, size) for _, run, at, size, _ in index])
    assert [len(x) for x in segments] == [1, 1, 1]
    for b in co_buckets.merged(co_buckets._Files(store), segments, [0]):
        held.append(b.num_rows)
    assert sum(held) == 3 * n and max(held) <= 3 * co_buckets.BLOCK_ROWS


def test_many_runs_are_merged_in_passes(tmp_path, monkeypatch):
    """More runs than one merge reads at once go to longer runs first, whether small ones are packed or not."""
    from pyarrow import fs

    store, rng = fs.LocalFileSystem(), random.Random(4)
    values = [rng.randint(0, 500) for _ in range(900)]
    for limits in ((4, 7, 0, 0), (2, 50, 0, 0), (3, 5, 1 << 16, 3000)):
        for name, v in zip(("FAN_IN", "BLOCK_ROWS", "SMALL", "PACKED"), limits, strict=True):
            monkeypatch.setattr(co_buckets, name, v)
        segments = []
        for k in range(30):
            rows = pa.RecordBatch.from_arrays([pa.array([0] * 30), pa.array(values[k * 30 : k * 30 + 30])], names=["no", "x"])
            segments += [(f"{tmp_path}/{run}", at, size) for _, run, at, size, _ in co_buckets._spill(store, str(tmp_path), [rows], [0])]
        files = co_buckets._Files(store, most=3)
        runs = co_buckets._fewer(files, str(tmp_path), co_buckets.packed(segments), [0])
        assert len(runs) <= limits[0]
        assert [x for b in co_buckets.merged(files, runs, [0]) for x in b.column(0).to_pylist()] == sorted(values)


def test_small_segments_are_packed():
    segments = [("a", 0, 10)] * 5 + [("b", 0, 1 << 20)] + [("c", 0, co_buckets.SMALL)] * 9
    runs = co_buckets.packed(segments)
    assert sorted(x for r in runs for x in r) == sorted(segments) and [("b", 0, 1 << 20)] in runs
    assert all(len(r) == 1 or sum(s for _, _, s in r) <= co_buckets.PACKED for r in runs) and len(runs) <= 5
