"""Folds that depend on order, with bounded memory: against plain versions, and on long groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.functions import similarity
from chronofold.operators import dimension, merge, nearest


def made_thumbs(rng, n, kinds):
    """Thumbs of some pictures with noise, some of them at just the distance that parts leaders."""
    base = rng.integers(0, 200, (kinds, *nearest.ROW_SHAPE))
    out = base[rng.integers(0, kinds, n)] + rng.integers(-4, 5, (n, *nearest.ROW_SHAPE))
    out[::7, :8, :8] += 12
    return out.astype(np.int16)


@pytest.mark.parametrize("limit", [5, 1024])
def test_leaders_are_those_of_all_comparisons(limit):
    rng = np.random.default_rng(3)
    thumbs = made_thumbs(rng, 400, 60)
    known, store, places, all_ = nearest.Leaders(limit, 12.0), np.zeros((0, *nearest.ROW_SHAPE), np.int16), [], 0
    for one in thumbs:
        far = similarity.cell_max_all(store, one) if len(store) else np.array([99.0])
        all_ += len(store)
        want = int(far.argmin()) if far.min() < 12 else None
        assert known.nearest(one) == want
        if want is None:
            assert known.add(one) == (len(store) < limit)
            if len(store) < limit:
                store = np.concatenate([store, one[None]])
        places.append(want)
    assert len(known.thumbs) <= max(16, limit) and sum(p is None for p in places) > 5
    print(f"compared {known.compared} of {all_}")
    assert known.compared < 0.2 * all_ or limit == 5


def test_leaders_of_a_long_segment(spark):
    """One segment of many rows beside short ones, in no order: the same leaders as one comparison after the other."""
    rng = np.random.default_rng(5)
    thumbs = made_thumbs(rng, 150, 12)
    rows = [(1 if k % 10 else k, k * 3, t.ravel().tolist()) for k, t in enumerate(thumbs)]
    df = spark.createDataFrame(rows, "segment_id long, ord long, thumb array<short>").repartition(5)
    got = {(r["segment_id"], r["ord"]): (r["leader"], r["is_leader"]) for r in nearest.row_leaders(df).collect()}
    held: dict[int, list] = {}
    for s, at, t in sorted(rows, key=lambda r: r[:2]):
        one = np.array(t, np.int16).reshape(nearest.ROW_SHAPE)
        near = [(similarity.cell_max_all(x[None], one)[0], k) for k, (x, _) in enumerate(held.setdefault(s, []))]
        best = min(near, default=(99, 0))
        leader = held[s][best[1]][1] if best[0] < 12 else at
        if leader == at:
            held[s].append((one, at))
        assert got[s, at] == (leader, leader == at)


def test_a_name_of_very_many_segments(spark):
    """Segments of one name are folded as they come; the union, and what it takes in, is that of a plain fold."""
    rng = random.Random(8)
    n = 20_000
    rows = spark.range(1, n + 1).select(
        F.col("id").cast("int").alias("seg_no"),
        F.when(F.col("id") % 50 == 1, F.lit("A")).otherwise(merge.UNKNOWN).alias("name"),
        F.transform(F.sequence(F.lit(0), (F.col("id") % 4).cast("int")), lambda k: F.concat(F.lit("i"), ((F.col("id") * 7 + k) % 40).cast("string"))).alias("items"),
    )
    union: dict[str, None] = {}
    for seg in range(1, n + 1, 50):
        union |= dict.fromkeys(f"i{(seg * 7 + k) % 40}" for k in range(seg % 4 + 1))
    merged, left = [], 0
    for seg in range(1, n + 1):
        if seg % 50 == 1:
            continue
        own = dict.fromkeys(f"i{(seg * 7 + k) % 40}" for k in range(seg % 4 + 1))
        if len(union.keys() & own.keys()) / min(len(union), len(own)) >= 0.9:
            union |= own
            merged.append(seg)
        else:
            left += 1
    got = merge.containment_merge(rows.orderBy(F.rand(rng.randint(0, 9)))).collect()
    named = [r for r in got if r["entity"] == "A"]
    assert len(named) == 1 and named[0]["items"] == list(union) and named[0]["merged"] == merged and named[0]["seg_no"] == 1
    assert len(got) == left + 1


def test_items_are_numbered_in_several_tasks(spark):
    rng = random.Random(2)
    names = ["", "a", "b", "é", "あ", "あい", "😀", *{"".join(rng.choice("abあいうé") for _ in range(rng.randint(1, 5))) for _ in range(300)}]
    df = spark.createDataFrame([(n, 1) for n in dict.fromkeys(names)], "name string, pp int").repartition(6)
    got = {r["name"]: r["id"] for r in dimension.number_items(df).collect()}
    assert got == {n: k + 1 for k, n in enumerate(sorted(got, key=lambda x: x.encode()))}


def test_a_thumb_seen_before_is_compared_with_newer_ones_only():
    """And has the leader that comparing all gives: the first of the nearest."""
    known, shape = nearest.Leaders(8, 12.0), nearest.ROW_SHAPE
    flat = [np.full(shape, v, np.int16) for v in (0, 11, 15, 22)]
    assert known.nearest(flat[0]) is None and known.add(flat[0])
    assert known.nearest(flat[1]) == 0 and known.compared == 1
    for _ in range(50):
        assert known.nearest(flat[1]) == 0
    assert known.compared == 1
    assert known.nearest(flat[2]) is None and known.add(flat[2])
    assert [known.nearest(flat[1]) for _ in range(50)] == [1] * 50 and known.compared == 2  # 15 is nearer to 11 than 0 is
    assert known.nearest(flat[3]) == 1
