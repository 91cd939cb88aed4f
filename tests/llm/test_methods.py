"""The methods behind operators against plain versions, planted truths and exact results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("chronofold.llm.queries")
from chronofold.llm import common, mixing, multiset, quality, simhash, token_files, toxicity  # noqa: E402

# ---- op2


def test_sampled_rows_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 7 + 1), "a" if k % 3 else "b", "en", k, float(k), "x", k) for k in range(300)], "doc_id long, text string, source string, lang string, _cell int, _probability double, cell string, row long")
    kept = mixing.sample_rows(docs, keep=0.5)
    assert kept.schema == docs.schema
    want = {tuple(r) for r in docs.collect()}
    got = [tuple(r) for r in kept.collect()]
    assert 50 < len(got) < 250 and set(got) <= want
    assert {r[0] for r in got} == {r["doc_id"] for r in mixing.mix(docs, keep=0.5).collect()}


def test_topics_may_be_a_column(spark):
    docs = spark.createDataFrame([(k, "w w", "a", "en", "t1" if k % 4 else "t2") for k in range(400)], "doc_id long, text string, source string, lang string, subject string")
    goal = {"topic": {"t1": 0.5, "t2": 0.5}}
    got = mixing.mix(docs, goal, keep=0.4, topic_of=F.col("subject")).groupBy("topic").agg(F.sum(F.col("weight") * F.col("n_tokens")).alias("w")).collect()
    share = {r["topic"]: r["w"] for r in got}
    assert abs(share["t1"] / sum(share.values()) - 0.5) < 0.08
    rows = mixing.sample_rows(docs, goal, keep=0.4, topic_of=F.col("subject"))
    assert rows.columns == docs.columns and 0.15 < rows.filter("subject = 't2'").count() / rows.count() < 0.7


def test_contradicting_targets_settle(spark):
    cells = spark.createDataFrame([("a", "en", "t", 80), ("b", "fr", "t", 10), ("c", "fr", "t", 10)], "source string, lang string, topic string, tokens long")
    goal = {"source": {"a": 0.6, "b": 0.2, "c": 0.2}, "lang": {"en": 0.5, "fr": 0.5}}
    got = {r["source"]: r["raked"] for r in mixing.rake(cells, goal).collect()}
    assert abs(got["a"] - 0.5) < 1e-9 and abs(got["b"] - 0.25) < 1e-9  # the later marginal holds


def test_unsettled_targets_fail(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_ROUNDS", 5)
    monkeypatch.setattr(mixing, "SETTLED", 1e-12)
    cells = spark.createDataFrame([("a", "en", "t", 80), ("a", "fr", "t", 1), ("b", "en", "t", 3), ("b", "fr", "t", 10)], "source string, lang string, topic string, tokens long")
    with pytest.raises(ValueError, match="settle"):
        mixing.rake(cells, {"source": {"a": 0.1, "b": 0.9}, "lang": {"en": 0.9, "fr": 0.1}})


# ---- op4, op6, op10: caches, very long texts, wide lanes


def test_word_caches_are_bounded_in_bytes(monkeypatch):
    made = []
    known: dict = {}

    def make(words):
        made.extend(words)
        return [w[:1] for w in words]

    long = b"x" * 100
    assert common.looked_up(known, [b"a", long, b"a"], make, 3) == [b"a", b"x", b"a"]
    assert common.looked_up(known, [long, b"b"], make, 3) == [b"x", b"b"] and set(known) == {b"a", b"b"} and made.count(long) == 2
    assert common.looked_up(known, [b"c", b"d"], make, 3) == [b"c", b"d"] and set(known) == {b"c", b"d"}
    assert common.looked_up(known, [b"e", b"f", b"g", b"h"], make, 3) == [b"e", b"f", b"g", b"h"] and not known
    monkeypatch.setattr(token_files, "CACHE_WORDS", 4)
    monkeypatch.setattr(multiset, "CACHE_WORDS", 4)
    text = " ".join(["y" * 300, *(f"w{k}" for k in range(50))])
    assert multiset.Fingerprint.of([text.encode()]) == multiset.Fingerprint.of([text.encode()])


def test_likeness_of_long_repetitive_texts():
    one = multiset.Fingerprint.of([b"a " * 65538])
    assert one.likeness(multiset.Fingerprint.of([b"a " * 60000])) > 0.99
    assert multiset.Fingerprint.from_hex(one.hex()) == one
    assert (one - one).likeness(multiset.Fingerprint()) == 1.0


def test_long_texts_settle_in_pieces(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ab", "c", "def", "gh\t", "\x0b"]) for _ in range(n)) for n in (0, 1, 3, 4, 5, 400, 5000)] + [" " * 500, "x" * 700]
    want = simhash.fingerprints_of(texts)
    for piece in (8, 64, 1000):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert (simhash.fingerprints_of(texts) == want).all()


@pytest.mark.parametrize("radius", [0, 7, 20, 59])
def test_wide_planes(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, (1, 4), dtype=np.uint64)
    near = base ^ np.stack([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (40, 3), dtype=np.uint64), axis=1) for _ in range(4)], axis=1) * (rng.random((40, 4)) < 0.7)
    far = rng.integers(0, 2**63, (60, 4), dtype=np.uint64)
    points = np.concatenate([base, near.astype(np.uint64), far])
    distance = np.bitwise_count(points[:, None, :] ^ points[None, :, :]).sum(axis=2)
    want = {(i, j) for i, j in zip(*np.nonzero(distance <= radius), strict=True) if i < j}
    got = {(int(a), int(b)) for q, p in simhash.within(points, points, radius, True, rows=16) for a, b in zip(q, p, strict=True)}
    assert got == {(int(i), int(j)) for i, j in want}


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://x:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_scratch_tables_are_dropped(spark):
    scratch = common.Scratch(spark, "t")
    a, b = scratch.save(spark.range(3)), scratch.save(spark.range(4))
    fs, at = scratch._at(a._scratch_path)
    scratch.drop(a, spark.range(1))
    assert not fs.exists(at) and b.count() == 4


# ---- op7


def test_ridge_on_fourier_features_is_near_the_exact_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, quality.STATISTICS))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 > 0.5).astype(float)
    features = quality.Fourier(x.mean(0), x.std(0), features=4000)
    z = features(x)[:, :-1]
    scaled = (x - x.mean(0)) / x.std(0)
    far = ((scaled[:, None] - scaled[None]) ** 2).sum(-1)
    kernel = np.exp(-far / (2 * quality.WIDTH**2 * quality.STATISTICS))
    assert np.abs(z @ z.T - kernel).max() < 0.12 and np.abs(z @ z.T - kernel).mean() < 0.02
    lam = 0.1
    exact = kernel @ np.linalg.solve(kernel + lam * np.eye(len(x)), y)
    ours = z @ np.linalg.solve(z.T @ z + lam * np.eye(z.shape[1]), z.T @ y)
    assert np.corrcoef(exact, ours)[0, 1] > 0.98


def test_sums_in_the_cluster_are_plain_normal_equations(spark):
    rng = random.Random(2)
    words = ["ab", "Cde", "f1", "gh!", "###", "i"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(1, 30))), float(rng.random() < 0.5), rng.randrange(4), k) for k in range(500)]
    vectors = quality._vectors(spark.createDataFrame(rows, "text string, y double, fold int, doc_id long").repartition(7)).drop("doc_id")
    model = quality._solve(vectors, 0.5)
    x = np.array([quality.statistics(t) for t, *_ in rows])
    y, fold = (np.array([r[k] for r in rows]) for k in (1, 2))
    z = quality.Fourier(x.mean(0), x.std(0) + 1e-6)(x)
    own = z[fold > 0]
    weights = np.linalg.solve(own.T @ own + quality.RIDGE * len(own) / own.shape[1] * np.eye(own.shape[1]), own.T @ y[fold > 0])
    assert np.allclose(z @ weights, model.raw(x), atol=1e-4)


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(20, 60))
        x, y = rng.integers(0, 15, n).astype(float), rng.integers(0, 2, n).astype(float)
        at, value = quality.isotonic(x, y)
        levels = np.unique(x)
        mean, size = np.array([y[x == v].mean() for v in levels]), np.array([(x == v).sum() for v in levels])
        # min-max formula of the best rising fit
        best = [max(min((mean[a : b + 1] * size[a : b + 1]).sum() / size[a : b + 1].sum() for b in range(k, len(levels))) for a in range(k + 1)) for k in range(len(levels))]
        blocks = {v: sum(size[np.isclose(best, v)]) for v in best}
        want = np.maximum.accumulate([v if blocks[v] >= 10 else (v * blocks[v] + 0.5) / (blocks[v] + 1) for v in best])
        assert np.allclose(np.interp(levels, at, value), want)


# ---- op9


def planted(n, rng, copies=True):
    """Votes of eight voters of known accuracy on a class of known share; the last two repeat the first, mostly."""
    y = rng.random(n) < 0.2
    on, off = np.array([0.7, 0.6, 0.5, 0.8, 0.4, 0.3]), np.array([0.05, 0.02, 0.1, 0.2, 0.01, 0.02])
    votes = (rng.random((n, 6)) < np.where(y[:, None], on, off)).astype(np.uint8)
    again = np.where(rng.random((n, 2)) < 0.95, votes[:, :1], 1 - votes[:, :1]).astype(np.uint8)
    return y.astype(float), np.hstack([votes, again]) if copies else votes, on, off


def fitted(spark, votes, start, anchors, y, anchor=toxicity.ANCHOR):
    packed = [(bytearray(p.tobytes()),) for p in np.packbits(votes, axis=1)]
    patterns = spark.createDataFrame(packed, "votes binary").groupBy("votes").agg(F.count("*").alias("n")).cache()
    return toxicity.fit_label_model(patterns, start, anchors, y, anchor)


def test_the_label_model_recovers_planted_rates_and_dependence(spark):
    rng = np.random.default_rng(7)
    y, votes, on, off = planted(40_000, rng)
    guess = toxicity.LabelModel(0.3, np.full(8, 0.4), np.full(8, 0.1))
    model = fitted(spark, votes, guess, np.zeros((0, 8)), np.zeros(0))
    assert model.settled and abs(model.prior - 0.2) < 0.03
    got_on, got_off = model.marginal()
    assert np.abs(got_on[:6] - on).max() < 0.08 and np.abs(got_off[:6] - off).max() < 0.03
    tied = {frozenset((k, int(p))) for k, p in enumerate(model.parent) if p >= 0}
    assert {frozenset((0, 6)), frozenset((0, 7))} <= tied | {frozenset((6, 7))} and len({k for t in tied if t <= {0, 6, 7} for k in t}) == 3
    sure = model.posterior(votes.astype(float))
    assert ((sure > 0.5) == (y > 0.5)).mean() > 0.95
    # three voices that say one thing aren't three witnesses
    only = np.zeros((1, 8))
    only[0, [0, 6, 7]] = 1
    blind = toxicity.LabelModel(model.prior, got_on, got_off)
    assert model.posterior(only)[0] < blind.posterior(only)[0]


def test_anchors_hold_a_model_that_starts_wrong(spark):
    rng = np.random.default_rng(8)
    y, votes, on, off = planted(20_000, rng, copies=False)
    wrong = toxicity.LabelModel(0.3, np.full(6, 0.2), np.full(6, 0.3))  # the classes exchanged
    known = rng.integers(0, len(y), 1500)
    model = fitted(spark, votes, wrong, votes[known].astype(float), y[known])
    got_on, got_off = model.marginal()
    assert np.abs(got_on - on).max() < 0.08 and np.abs(got_off - off).max() < 0.04


def test_spanning_forest_and_dependence():
    gain = np.zeros((5, 5))
    for a, b, g in ((0, 1, 0.5), (1, 2, 0.4), (0, 2, 0.3), (3, 4, 0.00001)):
        gain[a, b] = gain[b, a] = g
    assert toxicity.spanning_forest(gain).tolist() == [-1, 0, 1, -1, -1]
    rng = np.random.default_rng(1)
    x = (rng.random((5000, 3)) < 0.3).astype(float)
    x[:, 2] = x[:, 0]
    info = toxicity.dependence(x.T @ x, len(x))
    p = x[:, 0].mean()
    assert info[0, 1] < 1e-3 and abs(info[0, 2] + (p * np.log(p) + (1 - p) * np.log(1 - p))) < 1e-9


def test_voters_look_at_the_densest_words():
    voters = toxicity.Voters([b"zogan", b"brik*"])
    passage = "zogan brikt " * 40
    clean = "plain words here now " * 5000
    short, long = (voters.fire(t)[0] for t in (passage + clean[:2000], clean + passage + clean))
    assert voters.place[b"zogan"] in short and voters.place[b"zogan"] in long and voters.place[b"brik*"] in long
    shouted = voters.names.index("shouted")
    assert shouted in voters.fire("you IDIOT there")[0] and shouted not in voters.fire("a SCRAPBOOK of crap")[0]
    assert toxicity.densest([0, 1, 2, 4000, 4001, 8002], 4000) == 3


# ---- odd tables


def test_labels_with_clashing_columns(spark):
    docs = spark.createDataFrame([(k, f"words {k} " * 9 + ("idiot " * 3 if k % 4 == 0 else ""), "l") for k in range(60)], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 4 == 0), "t", 1.0, "v", b"x") for k in range(60)], "doc_id long, quality int, toxic int, text string, y double, votes string, words binary")
    for module, target in ((quality, "quality"), (toxicity, "toxic")):
        got = module.classify(docs, labels).collect()
        plain = module.classify(docs, labels.select("doc_id", target)).collect()
        assert len(got) == 60 and {r["doc_id"]: r["predicted"] for r in got} == {r["doc_id"]: r["predicted"] for r in plain}


def test_filters_on_empty_tables(spark):
    from chronofold.llm import decontaminate, near_copies

    docs = spark.createDataFrame([], "doc_id long, text string, component_id int, fp string")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (simhash.first_of_each(docs), near_copies.first_of_near_copies(docs), decontaminate.drop_contaminated(docs, bench), quality.keep_good(docs, quality.fit(docs, labels)), mixing.sample_rows(docs.selectExpr("*", "'a' AS source", "'b' AS lang"))):
        assert out.count() == 0 and out.columns[:4] == docs.columns
