"""Queries that SQL can't express, against plain Python over the whole small tables."""

from collections import defaultdict
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest

from chronofold.functions.text import fold_text
from chronofold.operators import merge
from chronofold.plans import catalog


@pytest.fixture(scope="module")
def tables(small):
    return lambda name, cols: duckdb.sql(f"select {cols} from '{small}/{name}.parquet'").fetchall()


def test_second_pass(spark, small, tables):
    seen = defaultdict(set)
    for supplier, order, part in tables("lineitem", "l_suppkey, l_orderkey, l_partkey"):
        seen[supplier % 40] |= {f"item{part % 60}"} if order % 3 > 0 else set()
    name = {s: f"S{s % 5}" if s % 3 > 0 else merge.UNKNOWN for s in seen}
    union = defaultdict(list)
    for s in sorted(seen):
        if name[s] != merge.UNKNOWN:
            union[name[s]] += [i for i in sorted(seen[s]) if i not in union[name[s]]]
    merged, anchor, alone = defaultdict(list), None, {}
    for s in sorted(seen):
        if name[s] != merge.UNKNOWN:
            anchor = name[s]
            continue
        own = sorted(seen[s])
        both = set(union[anchor]) & set(own) if anchor else set()
        if anchor and own and union[anchor] and len(both) / min(len(own), len(union[anchor])) >= 0.8:
            union[anchor] += [i for i in own if i not in union[anchor]]
            merged[anchor].append(s)
        else:
            alone[f"(unknown {s})"] = own
    want = {(k, ",".join(v), len(merged[k])) for k, v in union.items()} | {(k, ",".join(v), 0) for k, v in alone.items()}
    assert {tuple(r[c] for c in ("entity", "items", "n_merged")) for r in catalog.second_pass(spark, small).collect()} == want


def test_cached_rows(spark, small, tables):
    want, store = {}, defaultdict(list)
    for user, event in sorted(tables("events", "user_id, event_id"), key=lambda r: (r[0], r[1])):
        thumb = ((event % 5 * 40 + np.arange(24 * 96) % 7) % 256).reshape(24, 96)
        near = [(np.abs(t - thumb).reshape(3, 8, 12, 8).mean(axis=(1, 3)).max(), k) for k, (t, _) in enumerate(store[user])]
        best = min(near, default=(99, 0))
        if best[0] < 12:
            want[user, event] = (store[user][best[1]][1], True)
        else:
            store[user].append((thumb, f"t{event % 5}"))
            want[user, event] = (f"t{event % 5}", False)
    got = {(r["segment_id"], r["ord"]): (r["cached_text"], r["was_cached"]) for r in catalog.cached_rows(spark, small).collect()}
    assert got == want


def test_learnt_templates(spark, small):
    from chronofold.plans.catalog import frames

    by = defaultdict(list)
    for r in frames(spark, small).collect():
        by[r["group_id"]].append((r["ts"], int(r["value"] % 30), r["kind"]))
    got = defaultdict(list)
    for r in catalog.learnt_templates(spark, small).collect():
        got[r["group_id"]].append((r["ts"], r["kind"], r["by_template"], r["learnt"]))
    for group, rows in by.items():
        rows.sort(key=lambda r: r[0])
        if len({r[0] for r in rows}) < len(rows):
            continue  # frames of one time may come in any order
        known, want = {}, []
        for ts, v, read in rows:
            kind = None
            if "detail" in known and "move_list" in known:
                flat = [(k, t) for k in known for t in known[k]]
                far, at = min((abs(v - t) / 2, n) for n, (_, t) in enumerate(flat))
                kind = flat[at][0] if far < 5 else None
            own = known.setdefault(read, []) if kind is None else []
            learnt = kind is None and len(own) < 32 and all(abs(v - t) / 2 >= 5 for t in own)
            if learnt:
                own.append(v)
            want.append((ts, kind or read, kind is not None, learnt))
        assert sorted(got[group]) == want, group


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def best_entities(raw, names, k, least=None):
    """Names have no form here: the whole ratio, or that of the name and the text's beginning."""
    norm, scored = fold_text(raw), []
    for i, n in names:
        name = fold_text(n)
        whole = ratio(norm, name)
        scored.append((-max(whole, ratio(name, norm[: len(name)])), -whole, i, n))
    return [(i, n, -s) for s, _, i, n in sorted(scored)[:k] if least is None or -s >= least]


def dimension(tables):
    names = defaultdict(lambda: 1 << 60)
    for k, n in tables("part", "p_partkey, p_name"):
        names[n] = min(names[n], k)
    return [(k, n) for n, k in names.items()]


def test_fuzzy_entities(spark, small, tables):
    names = dimension(tables)
    raws = set()
    for k, n in tables("part", "p_partkey, p_name"):
        raws.add(n[1:99] + "x" if k % 4 == 0 else n.replace("e", "c") if k % 4 == 1 else n[:4] if k % 4 == 2 else n)
    want = {(raw, rank, i, round(s, 9)) for raw in raws for rank, (i, _, s) in enumerate(best_entities(raw, names, 3, 0.7), 1)}
    assert {(r["raw"], r["rank"], r["id"], round(r["score"], 9)) for r in catalog.fuzzy_entities(spark, small).collect()} == want


def test_entities_of_frames(spark, small, tables):
    names, frames = dimension(tables), defaultdict(list)
    for k, n in tables("part", "p_partkey, p_name"):
        frames[k // 400 * 100 + k % 100].append((k // 100 % 4, n.strip()))
    want = set()
    for f, frags in frames.items():
        texts = [t for _, t in sorted(frags) if len(t) >= 2]
        each = ([" ".join(texts)] if len(texts) > 1 else []) + texts
        found = [(-s, -len(n), at, rank, i, n) for at, t in enumerate(each) for rank, (i, n, s) in enumerate(best_entities(t, names, 5))]
        once, seen = [], set()
        for s, size, at, _, i, n in sorted(found):
            if i not in seen:
                seen.add(i)
                once.append((s, size, at, i, n))
        want |= {(f, rank, i, round(-s, 9)) for rank, (s, _, _, i, n) in enumerate(sorted(once)[:5], 1)}
    got = {(r["frame_id"], r["rank"], r["id"], round(r["score"], 9)) for r in catalog.entities_of_frames(spark, small).collect()}
    assert got == want
