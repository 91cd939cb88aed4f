"""Benchmark templates: names anywhere, variants, short items, capitals; and all of it against a plain version on strings."""

import random
import re

import pytest

pytest.importorskip("chronofold.llm.queries")
from chronofold.llm import decontaminate as dc  # noqa: E402


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in dc.contaminated(d, b).collect()}


def test_renamed_items(spark):
    shops = "Tom buys 12 pens. Anna buys 7 pens. Tom gives 3 to Anna."
    trip = "The rate of 5 km in Paris was 40 per cent when Alice met Bob at the old stone mill near 5 other towers"
    city = "She moved from Boston to the small harbour and paid 90 coins for the boat there"
    docs = [
        (1, "Kim buys 31 pens. Lea buys 8 pens. Kim gives 5 to Lea."),
        (2, ("Some text\n" + trip.replace("5", "17").replace("Paris", "Rome").replace("Alice", "Berta").replace("40", "3,000")).upper() + "!"),
        (3, trip.lower()),
        (4, city.replace("Boston", "New York")),
        (5, "Words. " + shops.replace("Tom", "Zed").replace("12", "22").replace("7", "9") + " And then " + shops.replace("Tom", "Bob").replace("12", "88").replace("7", "61")),
        (6, "Kim buys 31 pens. Lea sells 8 books. Kim takes 5 from Lea."),
        (7, shops.replace("\n", " ").replace(". ", ".\n")),
        (8, "Dan buys 31 pens. Lea buys 8 pens. Kim gives 5 to Ida."),
    ]
    got = found(spark, docs, [(10, shops), (11, trip), (12, city)])
    assert set(got) == {(1, 10), (2, 11), (3, 11), (4, 12), (5, 10), (7, 10)}
    low = {k: (r["coverage"], r["slot_consistency"]) for k, r in got.items() if r["coverage"] < 0.9 or r["slot_consistency"] < 1}
    assert not low, low
    assert {k for k, r in got.items() if r["same_values"]} == {(3, 11), (7, 10)}


def test_short_items_are_whole_documents(spark):
    docs = [(1, "yes, of course"), (2, "Yes of course!"), (3, "yes of course and more"), (4, "12"), (5, ""), (6, None), (7, "seven kg"), (8, "Paris")]
    assert set(found(spark, docs, [(1, "Yes, of course."), (2, "3"), (3, ""), (4, None)])) == {(1, 1), (2, 1)}


def test_other_items_take_nothing_away(spark):
    """Items that have a question's names, or any of its words, as plain words, at random: no pair of it is lost."""
    rng = random.Random(11)
    item = "She moved with Tom from Boston to the small harbour and paid 90 coins for the boat that Anna had there"
    docs = [(1, item), (2, item.replace("Tom", "Kim").replace("Boston", "Rome").replace("90", "41").replace("Anna", "Lea").lower()), (3, item.upper()), (4, item.replace("Boston", "Oslo")), (5, "a small boat with 90 coins was there in the harbour of Boston")]
    before = found(spark, docs, [(1, item)])
    assert set(before) == {(k, 1) for k in (1, 2, 3, 4)}
    words = "kim rome lea boston tom anna oslo harbour boat coins paid small moved stone river green".split()
    more = [(2, "an old kim and a green rome lea by the river")] + [(k, " ".join(rng.choice(words) for _ in range(9))) for k in range(3, 15)]
    for n in (1, 4, len(more)):
        after = found(spark, docs, [(1, item), *more[:n]])
        assert set(before) <= set(after)
        assert all(after[k]["coverage"] >= before[k]["coverage"] - 1e-9 for k in before)


def test_words_are_told_exactly():
    import numpy as np

    own, other = np.arange(1, 200_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(300_000, 900_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    table = dc.Words(own)
    assert table.has(own).all() and not table.has(other).any() and not dc.Words(own[:0]).has(other).any()


def test_an_item_with_several_texts(spark):
    a, b = "the old mill had many stones beside the road", "a quiet river runs below the long wooden bridge"
    docs = [(1, a), (2, b), (3, a + " " + b), (4, "nothing here at all to be seen by anyone")]
    got = found(spark, docs, [(5, a), (5, b), (5, b)])
    assert set(got) == {(1, 5), (2, 5), (3, 5)} and all(r["coverage"] == 1.0 for r in got.values())


# ---- a plain version


def forms(text, vocabulary=None):
    words = re.findall(r"\n|[^\s]+", text or "")
    tokens, first, numbered = [], True, False
    for w in words:
        bare = w.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
        low = bare.lower()
        if w != "\n" and bare:
            number = bool(re.fullmatch(r"[+-]?[$€£]*[0-9][0-9.,:/]*(?:%|[a-z]{1,3})?", low)) or low in dc.NUMBERS.split()
            unit = not number and numbered and low in dc.UNITS.split()
            capital = bare[:1].isupper() and bare[1:].islower() and low not in dc.COMMON.split() and not number and not unit
            strange = vocabulary is not None and low not in vocabulary and not number and not unit
            kind = "#n" if number else "#u" if unit else None
            stop = bool(re.search(r"[.!?:][#$%&*|\"')\]]*$", w)) and w != bare
            tokens.append((low, kind or ("#p" if capital and not first else None), kind or ("#p" if capital or strange else None), stop))
            numbered = number
        first = w == "\n" or bool(re.search(r"[.!?:][#$%&*|\"')\]]*$", w) and (w != bare)) if bare or w == "\n" else first and not w.endswith((".", "!", "?", ":")) or w.endswith((".", "!", "?", ":"))
    out = []
    for k in (1, 2):
        row, at = [], 0
        for t in tokens:
            if t[k] == "#p" and row and row[-1][0] == "#p" and not tokens[at - 1][3]:
                row[-1][2].append(t[0])
            else:
                row.append((t[k] or t[0], at, [t[0]], t[k]))
            at += 1
        out.append(row)
    return out if [r[0] for r in out[0]] != [r[0] for r in out[1]] else out[:1]


def test_windows_are_those_of_a_plain_version(spark):
    rng = random.Random(4)
    plain = "the mill of old stone and water near a long road with two birds under grey clouds".split()
    names = ["Alice", "Bob", "New York", "Rome", "Kim Lee"]
    sentence = lambda: " ".join(rng.choice([rng.choice(plain)] * 6 + [rng.choice(names), str(rng.randint(1, 99)), "5 km"]) for _ in range(rng.randint(3, 9)))
    texts = [". ".join(s[:1].upper() + s[1:] for s in (sentence() for _ in range(rng.randint(1, 4)))) + "." for _ in range(120)]
    items = [(k, t) for k, t in enumerate(texts[:40])]
    docs = [(1000 + k, t) for k, t in enumerate(texts)] + [(2000 + k, f"{rng.choice(texts)} {t}\n{rng.choice(texts)}") for k, t in enumerate(texts[:30])]
    vocabulary = {x[0] for _, t in items for x in forms(t)[0] if x[3] is None}

    def grams(rows):
        n = min(dc.WINDOW, len(rows))
        if n < dc.WINDOW and all(r[3] for r in rows):
            return []
        return [(rows[k][1], (n if n < dc.WINDOW else 0, *(r[0] for r in rows[k : k + n]))) for k in range(len(rows) - n + 1)]

    want = {}
    theirs = {i: {g for f in forms(t, vocabulary) for _, g in grams(f)} for i, t in docs}
    # words of the open form that may be names: neither slots nor common, and no number or unit
    free = {i: [(at, g, tuple(r[3] is None and r[0] not in dc.COMMON.split() for r in f[k : k + dc.WINDOW])) for f in forms(t, vocabulary)[-1:] for k, (at, g) in enumerate(grams(f))] for i, t in docs}

    def has(d, x):
        """Whether a document has an item's window, as it is or with some of its words as names."""
        return x in theirs[d] or any(len(g) == len(x) and g[0] == x[0] and all(a == b or b == "#p" and f for a, b, f in zip(g[1:], x[1:], may, strict=True)) for _, g, may in free[d])

    for i, t in items:
        own = [grams(f) for f in forms(t)]
        if not own[0]:
            continue
        n = min(len({at for at, _ in g}) for g in own)
        for d, have in theirs.items():
            hit = {at for g in own for at, x in g if x in have or ("#p" in x and has(d, x))}
            if n and len(hit) >= n * dc.COVERAGE:
                want[d, i] = (n, min(n, len(hit)))
    got = found(spark, docs, items)
    assert {(i + 1000, i) for i, _ in items if forms(items[i][1])[0]} <= set(got)
    assert all(want[k] == (r["n_windows"], r["n_found"]) for k, r in got.items())
    # what the plain version has beyond that failed on its slots
    loose = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), consistent=-1.0).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_found"]) for r in loose} == want
