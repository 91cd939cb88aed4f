"""Golden values and differential tests against plain Python."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronofold.functions import recognize, similarity, text
from chronofold.operators import dimension, fuzzy, merge, nearest, rows, segments, timeline, votes
from chronofold.options import Options
from chronofold.plans import recording
from chronofold.streaming.segmenter import SegmentFold


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_folds(spark):
    assert len(text.FOLD[0]) == 69
    for src, want in [("１０００まんボルト", "1000まんホルト"), ("ｶﾞ", "カ"), ("ニャオニクス♀", "ニヤオニクス♀"), ("オスのすがた", "オスのすかた")]:
        assert text.fold_text(src) == want
    df = spark.createDataFrame([("オスのすがた",), ("三三ロップ",)], "s string")
    assert values(df.select(text.entity_fold(F.col("s")).alias("x")), "x") == [("♂",), (text.fold_text("ミミロップ"),)]


@pytest.mark.parametrize(("a", "b", "want"), [("なゆきり", "こなゆき", 0.5), ("ほうふく", "ぼうふう", 0.75), ("ねこと", "ねごと", 1.0), ("フエアリー", "フェアリー", 1.0), ("10まんボルト", "１０００まんボルト", 0.7778), ("かつたへパーー", "オーバーヒート", 0.1429)])
def test_edit_similarity(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(similarity.edit_similarity(text.kana_fold(F.col("a")), text.kana_fold(F.col("b"))).alias("s"))
    assert round(df.first()[0], 4) == want


def test_bonus_does_not_beat_an_exact_hit(spark):
    dim = spark.createDataFrame([(1, "ほうふく", "x", 5), (2, "ぼうふう", "y", 5)], "id int, name string, type string, pp int")
    got = fuzzy.match_items(spark.createDataFrame([("ほうふく", "y")], "raw string, observed_type string"), dim, 2)
    assert [(r["id"], r["score"]) for r in got.orderBy("rank").collect()] == [(1, 1.0), (2, 0.75)]


def test_items_against_plain_python(spark):
    rng = random.Random(42)
    names = sorted({"".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 9))).strip() or "a" for _ in range(60)})
    dim = [(k + 1, n, rng.choice("xyz"), 1) for k, n in enumerate(names)]
    texts = [(rng.choice(names), None) for _ in range(20)]
    for _ in range(60):
        s = list(rng.choice(names))
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "b"])
        texts.append(("".join(s), rng.choice(["x", "y", None])))

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    want = set()
    for raw, kind in set(texts):
        if raw:
            scored = sorted((-(1 - far(raw, n) / max(len(raw), len(n)) + (0.15 if kind == ty else 0)), i, n) for i, n, ty, _ in dim)
            want |= {(raw, kind, k + 1, i) for k, (_, i, n) in enumerate(scored[:3])}
    o = spark.createDataFrame(texts, "raw string, observed_type string")
    d = spark.createDataFrame(dim, "id int, name string, type string, pp int")
    assert set(values(fuzzy.match_items(o, d, 3, ascii_only=True), "raw", "observed_type", "rank", "id")) == want
    fuzzy_slices = fuzzy.slices
    try:
        fuzzy.slices = lambda dim: [dim.filter(F.col("id") % 3 == k) for k in range(3)]
        assert set(values(fuzzy.match_items(o, d, 3, ascii_only=True), "raw", "observed_type", "rank", "id")) == want
    finally:
        fuzzy.slices = fuzzy_slices


def test_entities(spark):
    names = ["ギルガルド(シールド)", "ライチュウ", "ライチュウ(アローラ)", "ロトム", "ロトム(ヒート)", "ミミロップ"]
    dim = spark.createDataFrame([(k + 1, n) for k, n in enumerate(names)], "id int, name string")
    o = spark.createDataFrame([("ギルガルド シールドフォルム",), ("ライチュウ アローラのすがた",), ("ロトム ヒートロトム",), ("三三ロップ",), ("",)], "raw string")
    got = {r["raw"]: (r["name"], round(r["score"], 2)) for r in fuzzy.match_entities(o, dim, 1, least=0.7).collect()}
    assert got == {"ギルガルド シールドフォルム": (names[0], 1.0), "ライチュウ アローラのすがた": (names[2], 1.0), "ロトム ヒートロトム": (names[4], 1.0), "三三ロップ": (names[5], 1.0)}
    assert {(r["raw"], r["id"]) for r in fuzzy.match_entities(o, dim, 1).collect()} == {(r["raw"], r["id"]) for r in fuzzy.match_entities(o, dim, 1, least=0.1).collect()}
    frags = spark.createDataFrame([(1, 0, "ロトム "), (1, 1, " ヒートロトム"), (1, 2, "x")], "frame_id int, frag_no int, text string")
    assert fuzzy.entities_of_fragments(frags, dim, 1).first()["name"] == "ロトム(ヒート)"


def test_sequence_ratio_and_bound(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("a", ""), ("三三", "ミミ")]
    got = spark.createDataFrame(pairs, "a string, b string").select(similarity.sequence_ratio("a", "b").alias("r"), similarity.sequence_bound(F.col("a"), F.col("b")).alias("b")).collect()
    for (a, b), (r, bound) in zip(pairs, got, strict=True):
        assert r == SequenceMatcher(None, a, b).ratio() <= bound + 1e-12


def test_scalars(spark):
    df = spark.createDataFrame([(" 10", 1.0), ("1x", float("nan")), ("10.5", -3.0), ("", float("inf"))], "s string, f double")
    assert [r[0] for r in df.select(text.int_or_zero(F.col("s"))).collect()] == [10, 0, 0, 0]
    assert [r[0] for r in df.select(timeline.safe_fps(F.col("f"))).collect()] == [1.0, 30.0, 30.0, 30.0]
    one = spark.createDataFrame([(0, 30.0), (2, 30.0), (3, 30.0)], "frame_idx long, src_fps double")
    assert [r["frame_idx"] for r in timeline.thin(one, 12.0).collect()] == [0, 2]
    cats = spark.createDataFrame([(c,) for c in "あカヴー・5５(） x"], "c string").select(text.char_category(F.col("c")).alias("k"))
    assert [r[0] for r in cats.collect()] == ["hiragana", "katakana", "katakana", "chouon", "middle_dot", "digit", "digit", "paren", "paren", "space", "other"]
    kinds = spark.createDataFrame([("教える技",), ("能力",), ("x",)], "s string").select(text.kind_by_words(F.col("s")).alias("k"))
    assert [r[0] for r in kinds.collect()] == ["move_list", "detail", "other"]
    for bad in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            timeline.check_rates(bad)
    with pytest.raises(ValueError):
        Options(start=5.0, end=5.0)


def test_segments_fixture_and_random_timelines(spark):
    fixed = [(0, "other", "A"), (1, "detail", None), (2, "other", None), (3, "detail", None), (4, "move_list", None), (5, "other", None), (6, "detail", None), (7, "move_list", None), (8, "other", "B"), (9, "detail", None), (10, "other", "C"), (11, "detail", None), (12, "move_list", None)]
    rng = random.Random(7)
    lines = {"fixed": fixed}
    for k in range(400):
        lines[f"r{k:03d}"] = [(i, kind, rng.choice([None, "A", "B", "C"]) if kind == "other" else None) for i in range(rng.randint(1, 25)) for kind in [rng.choice(["detail", "move_list", "other"])]]
    df = spark.createDataFrame([(g, float(ts), ts, k, b) for g, fs in lines.items() for ts, k, b in fs], "group_id string, ts double, ord int, kind string, box string")
    got = {}
    for r in segments.segments(df).orderBy("group_id", "segment_no").collect():
        got.setdefault(r["group_id"], []).append((r["entity"], r["detail_ts"], r["list_start"], r["list_end"], r["list_frames"]))
    assert [(x[0], x[4]) for x in got["fixed"]] == [("A", 1), (None, 1), ("C", 1)]
    for g, fs in lines.items():
        fold = SegmentFold()
        want = [x for f in fs if (x := fold.frame(*f))] + [x for x in [fold.close()] if x]
        assert got.get(g, []) == [(x["entity"], x["detail_ts"], x["list_start"], x["list_end"], x["list_frames"]) for x in want], g


def test_containment_merge(spark):
    df = spark.createDataFrame([(1, "S", ["a", "b", "c"]), (2, "(unknown)", ["a", "b"]), (3, "(unknown)", ["x"]), (4, "(unknown)", ["a", "b", "c", "z"]), (5, "T", []), (6, "(unknown)", [])], "seg_no int, name string, items array<string>")
    got = {r["entity"]: (r["items"], r["merged"]) for r in merge.containment_merge(df, 0.9).collect()}
    assert got == {"S": (["a", "b", "c", "z"], [2, 4]), "T": ([], []), "(unknown 3)": (["x"], []), "(unknown 6)": ([], [])}


def test_row_cache_and_templates(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 255, (4, 24, 96))
    seen = [(1, k, (base[k % 4] + rng.integers(0, 3, (24, 96))).ravel().tolist(), f"t{k % 4}-{k}") for k in range(20)]
    got = nearest.row_texts(spark.createDataFrame(seen, "segment_id long, ord long, thumb array<smallint>, text string")).orderBy("ord").collect()
    assert [(r["cached_text"], r["was_cached"]) for r in got] == [(f"t{k % 4}-{k % 4}", k >= 4) for k in range(20)]
    f = [("g", float(k), [v, v], kind) for k, (v, kind) in enumerate([(0, "detail"), (1, "wrong"), (50, "move_list"), (2, "wrong"), (90, "other"), (51, "wrong"), (91, "wrong")])]
    got = nearest.learn_templates(spark.createDataFrame(f, "group_id string, ts double, thumb array<int>, read_kind string")).orderBy("ts").collect()
    assert [(r["kind"], r["by_template"]) for r in got] == [("detail", False), ("wrong", False), ("move_list", False), ("wrong", True), ("other", False), ("move_list", True), ("other", True)]


def test_bands_and_accepted_items(spark):
    dark = [0, 1, 1, 0, 1, 1, 1, 0, 1, 1, 1]
    assert values(rows.text_band(spark.createDataFrame([(1, y, float(v)) for y, v in enumerate(dark)], "frame_id int, y int, dark double")), "centre") == [(5,)]
    dim = spark.createDataFrame([(1, "alpha", "x", 1), (2, "gamma", "y", 1)], "id int, name string, type string, pp int")
    obs = spark.createDataFrame([(1, "gamma", 0, 1), (1, "alphb", 0, 0), (1, "alpha", 2, 0), (1, "zzzzz", 1, 0)], "segment_id int, name string, frame_idx int, row_no int")
    items, doubtful = votes.accepted_items(votes.votes(obs), dim, ascii_only=True)
    assert values(items.orderBy("pos"), "item", "pos") == [("alpha", 1), ("gamma", 2)]
    assert values(doubtful, "raw") == [("zzzzz",)]


def test_dimension_rules(spark):
    e = spark.createDataFrame([("a b", 2, 0, 0, "old", 1), ("a b", 5, 1, 0, "new", 2), ("a b", 9, 2, 0, None, None), ("ab", 5, 1, 1, "x", 3), ("junk", 3, 0, 0, None, None)], "name string, rank int, file_ord int, game_pos int, type string, pp int")
    won = dimension.latest_wins(e)
    assert set(values(won, "name", "best_rank", "type")) == {("a b", 5, "new"), ("ab", 5, "x")}
    assert values(dimension.collapse_spellings(won), "key", "name", "dropped") == [("ab", "ab", ["a b"])]


def test_recognizer(spark):
    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    box = (0, 0, 2, 2)
    known = {(recognize.TableRecognizer.key(image), box): [("hi", 0.9, [(0, 0), (1, 0), (1, 1), (0, 1)])]}
    frames = spark.createDataFrame([(7, 4, 4, bytearray(image.tobytes()))], "frame_idx long, height int, width int, image binary")
    got = recognize.recognize(frames, lambda: recognize.Wrapped(recognize.TableRecognizer(known), lambda r: (r[0].upper(), r[1], r[2])), [box, (1, 1, 2, 2)]).collect()
    assert [(r["frame_idx"], r["box_no"], r["text"]) for r in got] == [(7, 0, "HI")]
    assert recognize.shrink(np.full((8, 8, 3), 9, np.uint8), 2, 2).tolist() == [[[9, 9, 9]] * 2] * 2
    assert recognize.to_source([(4, 6)], (10, 20, 5, 5), 2.0) == [(12, 23)]


def test_whole_run(spark):
    kinds = ["other", "detail", "move_list", "move_list", "detail", "move_list"]
    f = [("g", float(k), k, kind, [k * 50], [k * 50], [k * 50], 99.0) for k, kind in enumerate(kinds)]
    frames = spark.createDataFrame(f, "group_id string, ts double, ord int, read_kind string, header_thumb array<int>, slot_thumb array<int>, box_thumb array<int>, mean_luma double")
    reads = spark.createDataFrame([("g", 0, "ロトム")], "group_id string, ord int, raw string")
    obs = spark.createDataFrame([("g", k, r, raw, None) for k, r, raw in [(2, 0, "alpha"), (3, 0, "gamma"), (3, 1, "alphx"), (5, 0, "alpha"), (5, 1, "gamma")]], "group_id string, ord int, row_no int, raw string, observed_type string")
    ents = spark.createDataFrame([(1, "ロトム")], "id int, name string")
    items = spark.createDataFrame([(1, "alpha", "x", 1), (2, "gamma", "y", 1)], "id int, name string, type string, pp int")
    got = recording.run(frames, reads, obs, ents, items, Options(index_fps=4.0, ascii_names=True)).collect()
    assert [(r["entity"], r["items"], r["merged"]) for r in got] == [("ロトム", ["alpha", "gamma"], [2])]
