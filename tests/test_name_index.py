"""Indexes of names against comparing every name, and how many they compare."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from chronofold.functions import similarity
from chronofold.operators import fuzzy, name_index

KANA = [chr(c) for c in range(0x30A1, 0x30F5)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
    return row[-1]


def noisy(rng, name, alphabet, n):
    out = list(name)
    for _ in range(n):
        k = rng.randrange(len(out) + 1)
        how = rng.choice("sdi")
        if how == "i" or k == len(out):
            out.insert(k, rng.choice(alphabet))
        elif how == "s":
            out[k] = rng.choice(alphabet)
        else:
            del out[k]
    return "".join(out)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij \0é", "".join(KANA)])
def test_edit_distances(alphabet):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
    names = [word() for _ in range(200)] + ["", "😀a", "x" * 90]
    for text in [word() for _ in range(20)] + ["", "😀", "y" * 200]:
        assert name_index.edit_distances(text, names).tolist() == [distance(text, n) for n in names]


@pytest.mark.parametrize(("alphabet", "n"), [("ab", 60), ("abcdef", 500), ("".join(KANA), 300), ("abc", 3)])
def test_items_are_those_of_all_names(alphabet, n):
    """200 random observations of each kind, types equal, other or none, k of 1 and 3, with ties and repeated names."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 10)))
    rows = [(i * 7 % 1009, f"name {i}", word(), rng.choice(["x", "y", "z", None])) for i in range(n)]
    rows += [(2000, "twice", rows[0][2], "x"), (2001, "empty", "", "y")]
    index = name_index.Items(rows)
    for _ in range(200):
        text, kind, k = noisy(rng, rng.choice(rows)[2], alphabet, rng.randint(0, 3)), rng.choice(["x", "y", None, "other"]), rng.choice([1, 3])
        want = []
        for i, name, norm, t in rows:
            longest = max(len(text), len(norm))
            s = 1 - distance(text, norm) / longest if longest else 1.0
            want.append((-(s + (0.15 if kind is not None and t == kind else 0.0)), i, name, s))
        assert index.best(text, kind, k, 0.15) == [(i, name, s) for _, i, name, s in sorted(want)[:k]]


@pytest.mark.parametrize("least", [None, 0.7, 0.3])
def test_entities_are_those_of_all_names(least):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("アイウエオカキ") for _ in range(rng.randint(1, 7)))
    rows = []
    for i in range(150):
        base, form = word(), rng.choice(["", "", "アイ", "カ"])
        rows.append((i, f"n{i}", base + form, rng.choice([base, base, ""]), form))
    index = name_index.Entities(rows)
    for _ in range(120):
        text, k = noisy(rng, rng.choice(rows)[2], "アイウカ", rng.randint(0, 3)), rng.choice([1, 5])
        want = []
        for i, name, norm, base, form in rows:
            whole = SequenceMatcher(None, text, norm).ratio()
            prefix = SequenceMatcher(None, base, text[: len(base)]).ratio() if base else 0.0
            s = max(whole, prefix) if form in text else whole
            if least is None or s >= least:
                want.append((-s, -whole, i, name))
        assert index.best(text, k, least) == [(i, name, -s, -w) for s, w, i, name in sorted(want)[:k]]


def test_few_names_are_compared():
    """Of 20,000 names each text meets less than a tenth; of entities' names, less than a tenth too where a score is asked for."""
    rng = random.Random(2)
    types = [f"t{k}" for k in range(18)]
    names = list(dict.fromkeys("".join(rng.choice(KANA) for _ in range(rng.randint(4, 12))) for _ in range(20_000)))
    items = name_index.Items([(i, n, n, rng.choice(types)) for i, n in enumerate(names)])
    texts = [noisy(rng, rng.choice(names), KANA, rng.randint(1, 3)) for _ in range(60)]
    for t in texts:
        items.best(t, rng.choice(types), 3, 0.15)
    print(f"items: {items.compared / len(texts) / len(names):.4f} of all pairs")
    assert items.compared < 0.1 * len(texts) * len(names)
    entities = name_index.Entities([(i, n, n, n, "") for i, n in enumerate(names)])
    for t in texts:
        entities.best(t, 5, 0.7)
    print(f"entities: {entities.compared / len(texts) / len(names):.4f} of all pairs")
    assert entities.compared < 0.1 * len(texts) * len(names)


def test_joins_are_those_of_all_pairs(spark, monkeypatch):
    """The recipe of a differential check: exact names, mutated names and fixed strings, each with a type or none; also over several slices."""
    rng = random.Random(42)
    names = list(dict.fromkeys("".join(rng.choice("aeioknst") for _ in range(rng.randint(2, 9))) for _ in range(400)))
    types = ["fire", "water", None]
    dim = spark.createDataFrame([(i + 1, n, rng.choice(types)) for i, n in enumerate(names)], "id int, name string, type string")
    seen = [(n, rng.choice(types)) for n in names[:100]] + [(noisy(rng, rng.choice(names), "aeiouxyz", rng.randint(1, 3)), rng.choice(types)) for _ in range(150)] + [("", None), (" ", "fire"), ("q" * 40, None), ("a", "water")]
    observed = spark.createDataFrame(seen, "raw string, observed_type string")
    pairs = observed.distinct().filter(F.length("raw") > 0).crossJoin(dim).withColumn("score", similarity.edit_similarity(F.col("raw"), F.col("name")))
    pairs = pairs.withColumn("boosted", F.col("score") + F.when(F.col("type") == F.col("observed_type"), 0.15).otherwise(0.0))
    for k in (1, 3):
        want = fuzzy._best(pairs, ["raw", "observed_type"], [F.desc("boosted"), "id"], k).select("raw", "observed_type", "rank", "id", "name", "score")
        got = fuzzy.match_items(observed, dim, k, ascii_only=True)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    monkeypatch.setattr(fuzzy, "BROADCAST_ROWS", 150)
    assert sorted(map(str, fuzzy.match_items(observed, dim, 3, ascii_only=True).collect())) == sorted(map(str, want.collect()))


def test_texts_are_dealt_by_number(spark):
    """Few bytes of texts are many tasks' work, and each is answered once."""
    texts = spark.range(400).select(F.concat(F.lit("t"), F.col("id")).alias("raw")).distinct()
    got = fuzzy._probed(texts, 1, lambda index, raw: [(raw, TaskContext.get().partitionId())], "raw string, task int").collect()
    assert len(got) == len({r["raw"] for r in got}) == 400 and len({r["task"] for r in got}) > 1
