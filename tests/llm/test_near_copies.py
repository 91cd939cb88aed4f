"""The pipeline's near copies against all pairs."""

import random

import pytest

pytest.importorskip("chronofold.llm.queries")
import corpus_pipeline  # noqa: E402
from chronofold.llm import near_copies  # noqa: E402


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("stars", [(1, 2, 4), (1,), ()])
def test_near_copies_are_all_pairs(spark, monkeypatch, stars):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    rows = [(None, "x"), (900, None), (901, " \n"), (902, "")]
    for group in range(8):
        base = rng.choices(words, k=300)
        for k in range(12):  # four changed words apart: about 0.88 between neighbours, less along the chain
            rows.append((group * 20 + k, " ".join(base)))
            for at in rng.sample(range(300), 4):
                base[at] = rng.choice(words)
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    sets = {i: grams(t) for i, t in rows if i is not None}
    group = {i: i for i in sets}
    near = {i: [j for j in sets if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    assert sum(map(len, near.values())) > 2 * len(near)
    for _ in sets:
        group = {i: min(group[j] for j in near[i]) for i in sets}
    monkeypatch.setattr(near_copies, "STARS", stars)
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {*group.values(), None}
