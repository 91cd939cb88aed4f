"""Operators for training data against brute force, and on odd tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("chronofold.llm.queries")
from chronofold.llm import components, decontaminate, line_runs, mixing, multiset, pii, quality, queries, secrets, simhash, token_files, toxicity  # noqa: E402
from chronofold.llm.common import Scratch  # noqa: E402

SCHEMA = "n_chars long, mix string, doc_id long, text string, lang string, source string, h int, fp string, score double, range int, _cell int, doc int"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))


def table(spark, rows):
    """Rows of (doc_id, text, lang, source) among columns whose names operators use themselves."""
    return spark.createDataFrame([(None, "x", i, t, lang, s, 1, "y", 0.5, 3, 4, 5) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice(["an", "to", "re", "th", "lo", "éa"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="module")
def rows(words):
    """Documents with copies, near copies, shared passages, repeats, nulls and long texts."""
    rng = random.Random(9)
    prose = lambda n: "\n".join(" ".join(rng.choices(words, k=rng.randint(3, 14))) + "." for _ in range(n))
    texts = [prose(rng.randint(1, 12)) for _ in range(60)]
    passage = " ".join(rng.choices(words, k=60))
    texts += [texts[3], texts[3], texts[4] + " extra", texts[5].replace("an", "AN"), texts[7] + "\n" + passage, passage + "\n" + texts[8], passage, texts[9] + "\n" + "\n".join(texts[10].split("\n")[:9])]
    out = [(k * 3, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None])) for k, t in enumerate(texts)]
    out += [(1, None, "en", "a"), (2, "", None, None), (4, "  \n ", "en", "b"), (None, texts[3], "en", "a"), (None, None, None, None), (1000, LONG, "en", "a")]
    return [*out, out[0], out[0]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


def runs(spark, docs, empty=False):
    labels = spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(0, 150, 3)] + [(None, 1, 1), (3, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "short one"), (2, None), (None, "a b c d e f g"), (3, LONG[:600])], "item_id long, text string")
    if empty:
        labels, bench = labels.limit(0), bench.limit(0)
    return {
        1: lambda: decontaminate.contaminated(docs, bench), 2: lambda: mixing.mix(docs), 3: lambda: secrets.candidates(docs), 4: lambda: token_files.token_files(docs, queries.tokenizer_path()), 5: lambda: pii.find_pii(docs),
        6: lambda: simhash.near_duplicates(docs), 7: lambda: quality.classify(docs, labels), 8: lambda: line_runs.drop_later_copies(docs), 9: lambda: toxicity.classify(docs, labels), 10: lambda: multiset.fingerprint_edits(docs),
    }


@pytest.mark.parametrize("op", range(1, 11))
def test_empty_table(spark, op):
    assert runs(spark, table(spark, []), empty=True)[op]().count() == 0


@pytest.mark.parametrize("op", [4, 5, 6, 7, 8, 9, 10])
def test_a_row_for_each_row(spark, docs, rows, op):
    got = runs(spark, docs)[op]().select("doc_id").collect()
    assert collections.Counter(r[0] for r in got) == collections.Counter(r[0] for r in rows)


@pytest.mark.parametrize("op", [7, 9])
def test_without_labels(spark, docs, op):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = (quality if op == 7 else toxicity).classify(docs.limit(5), empty).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)


def test_decontamination(spark, docs, rows):
    item = "The rate of 5 km in Paris was 40 per cent when Alice and Alice met at the old stone mill near 5 other towers"
    other = item.replace("5", "17").replace("Paris", "Rome").replace("Alice", "Bertha").replace("40", "3,000")
    mixed = item.replace("5 km", "7 km").replace("Alice and Alice", "Carla and Dora")
    more = [(5001, "Words before. " + item + " and after.", "en", "a"), (5002, "Some text\n" + other.upper() + "!", "en", "a"), (5003, other, "en", "a"), (5004, mixed, "en", "a"), (5005, item[:40], "en", "a"), (None, item, "en", "a")]
    bench = spark.createDataFrame([(7, item, "x"), (7, item, "y"), (8, "one two three", "z")], "item_id long, text string, doc_id string")
    both = docs.unionByName(table(spark, more))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(both, bench).collect()}
    assert {k for k in got if k[0] != 5002} == {(5001, 7), (5003, 7)}
    assert got[5001, 7]["same_values"] and not got[5003, 7]["same_values"]
    limit, decontaminate.MOST_WINDOWS = decontaminate.MOST_WINDOWS, 0  # without the bit table
    try:
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(both, bench).collect()} == set(got)
    finally:
        decontaminate.MOST_WINDOWS = limit
    kept = decontaminate.drop_contaminated(both, bench)
    assert kept.columns == docs.columns and kept.count() == both.count() - len({k[0] for k in got})


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.randint(1, 40)), rng.choice(["en", "en", "fr"]), rng.choice(["a", "a", "a", "b", None])) for k in range(3000)]
    docs = table(spark, rows)
    targets = {"source": {"a": 0.5, "b": 0.3, "(none)": 0.2}, "lang": {"en": 0.5, "fr": 0.5}, "topic": {"prose": 1.0}}
    got = mixing.mix(docs, targets, keep=0.3).toPandas()
    weight = got.weight * got.n_tokens
    for col, goal in targets.items():
        share = weight.groupby(got[col]).sum() / weight.sum()
        assert all(abs(share[k] - v) < 0.05 for k, v in goal.items())
    total = sum(len(r[1].split()) for r in rows)
    assert abs(got.n_tokens.sum() / total - 0.3) < 0.04
    more = mixing.mix(docs, targets, keep=0.6).toPandas()
    assert set(got.doc_id) <= set(more.doc_id)
    kept = mixing.sample_rows(docs, targets, keep=0.3)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(got.doc_id)


def test_secrets(spark):
    key = hashlib.sha1(b"k").hexdigest()
    lines = [f'api_key = "{key}" and more', f"see commit {key} for this", "call 4111111111111111 now", 'token = "xxxxxxxxxxxxxxxx1"', "https://x.example.com/static/main-2023.index.page.js", f'a token="{key}" b secret: "{hashlib.sha1(b"q").hexdigest()}"']
    docs = table(spark, [(1, "\n".join(lines), "en", "a"), (2, None, "en", "a"), (3, "plain words " * 50, "en", "a")])
    found = secrets.candidates(docs).collect()
    want = [(i, m.start(), m[0]) for i, line in enumerate(lines) for m in re.finditer(secrets.CANDIDATE, line)]
    assert sorted((r["line"], r["start"], r["candidate"]) for r in found) == sorted(want)
    kept = {(r["line"], r["start"]) for r in secrets.scan(docs).collect()}
    assert kept == {(0, 11), (5, 9), (5, 9 + 40 + 13)}
    made = secrets.labelled_findings(spark, 1500).withColumn("fold", F.pmod(F.xxhash64("candidate"), F.lit(3)))
    model = secrets.train(made.filter("fold > 0"))
    held = secrets.score(made.filter("fold = 0"), model).toPandas()
    assert ((held.score >= 0.5) == (held.label == 1)).mean() > 0.97
    alike = spark.createDataFrame([("", "a" * 16 + "1", "", 0.0)], "before string, candidate string, after string, label double")
    assert secrets.train(alike) == 0.0 and secrets.train(alike.limit(0)) == 0.5


def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    odd = [(9001, "Don't STOP<|endoftext|>now don't, it's 3.14%… “quoted”. K’s x y\x1cz é. naïve…. a'b 'tis", "en", "a"), (9002, "é ́x ÀÉ!", "en", "a")]
    both = docs.unionByName(table(spark, odd))
    path = Scratch(spark, "t").path()
    token_files.write_token_files(both, path, queries.tokenizer_path())
    got = token_files.read_token_index(spark, path, with_ids=True).toPandas().sort_values("start")
    assert got.doc_id.dropna().is_monotonic_increasing and got.doc_id.isna().iloc[:2].all()
    start = 0
    text = {i: t or "" for i, t, _, _ in rows + odd if i is not None}
    for r in got.itertuples():
        assert r.start == start and r.n_tokens == len(r.ids)
        start += r.n_tokens
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        if r.doc_id == r.doc_id:
            assert list(r.ids) == [*tok.encode(text[r.doc_id], add_special_tokens=False).ids, 1], r.doc_id
    assert token_files.read_document(spark, path, 9001) == [*tok.encode(odd[0][1], add_special_tokens=False).ids, 1]
    assert token_files.read_document(spark, path, 77777) is None
    bad = Scratch(spark, "t").path()
    token_files.write_token_files(docs, bad, queries.tokenizer_path(), dictionary=b"")
    assert token_files.load_dictionary(spark, bad) == b""


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def test_pii_base_is_the_plain_patterns():
    rng = random.Random(2)
    valid = (lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 16 <= sum(map(str.isdigit, s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s)), lambda s: 8 <= sum(map(str.isdigit, s)) <= 15)
    texts = ["".join(rng.choice("ab1.@-_%+ 9(4") for _ in range(rng.randint(1, 50))) for _ in range(3000)] + ["4111 1111-1111 1111 +49 (30) 1234567 a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1", "9" * 50_000, "a" * 50_000 + "@"]
    for t in texts[:-2]:
        assert pii.detect(t) == sorted((k, *m.span()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, t) if valid[k](m[0])), t
    assert pii.detect(texts[-2]) == pii.detect(texts[-1]) == []


@pytest.mark.parametrize(("text", "found"), [("write jane.doe at example dot com now", "email:jane.doe at example dot com"), ("x (at) host [dot] org", "email:x (at) host [dot] org"), ("j＠ｅｘａｍｐｌｅ.com", "email:j＠ｅｘａｍｐｌｅ.com"), ("jo​hn@exаmple.com", "email:jo​hn@exаmple.com"), ("one nine two dot one six eight dot one dot one", "ip:one nine two dot one six eight dot one dot one"), ("ring plus four nine one seven one double two three four five six", "phone:plus four nine one seven one double two three four five six"), ("4111-1111 1111—1111", "card:4111-1111 1111—1111"), ("host 192 dot 168 dot 1 dot 1 up", "ip:192 dot 168 dot 1 dot 1"), ("jane dot doe at mail dot example dot com", "email:jane dot doe at mail dot example dot com"), ("card 4lll 1111 1111 1111.", "card:4lll 1111 1111 1111"), ("+49 3O 1234567", "phone:+49 3O 1234567"), ("Oil 10 lot IO 12", ""), ("He was at home dot the end", ""), ("Look at example.com", ""), ("say one two three", ""), ("meet at and. It is", "")])
def test_pii_disguises(text, found):
    base, spans = pii.find(text)
    assert ",".join(f"{pii.KINDS[k]}:{text[a:z]}" for k, a, z in spans) == found and not base


def test_simhash_is_brute_force(spark, docs, rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    from xxhash import xxh64_intdigest

    def print_of(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) > 3 else [" ".join(w)] * bool(w)
        h = [xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    got = simhash.near_duplicates(docs).collect()
    prints = {i: print_of(t) for i, t, _, _ in rows if i is not None}
    assert {(r["doc_id"], r["fingerprint"]) for r in got if r["doc_id"] is not None} == {(i, f"{p:016x}") for i, p in prints.items()}
    group = {i: i for i in prints}
    for _ in range(len(prints)):
        new = {i: min(group[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
        if new == group:
            break
        group = new
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == set(group.items())
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} - {None} == set(group.values())


@pytest.mark.parametrize("radius", [0, 1, 4, 6])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    points = np.unique(np.concatenate([rng.integers(0, 2**63, 300, dtype=np.uint64), *(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) for _ in range(2))]))
    want = {(i, j) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points[i] ^ points) <= radius).tolist() if i < j}
    got = {(a, b) for q, p in simhash.within(points, points, radius, True, rows=100) for a, b in zip(q.tolist(), p.tolist(), strict=True)}
    assert got == want
    cross = {(a, b) for q, p in simhash.within(points[:130], points[130:], radius, False, rows=50) for a, b in zip(q.tolist(), p.tolist(), strict=True)}
    assert cross == {(i, j - 130) for i, j in want if i < 130 <= j}


def test_blocks_and_more_bands_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(1)
    near = np.bitwise_xor.accumulate(np.append(np.uint64(99), np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)))  # a chain
    points = np.unique(np.concatenate([near, rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    scratch = Scratch(spark, "t")

    def groups():
        edges = scratch.save(simhash.fingerprint_links(df, 4, scratch))
        return {(r["node"], r["root"]) for r in components.components(edges, scratch).collect()}

    want = groups()
    monkeypatch.setattr(simhash, "BLOCK", 16)
    assert groups() == want
    monkeypatch.setattr(simhash, "BUCKET", -1)
    assert len(simhash.band_plan(len(points), 4)[0]) > 5 and groups() == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 300), (7, 7), (-5, 300)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert all(got[k] == 0 for k in range(1, 61)) and {got[k] for k in (100, 200, 300)} == {-5}


def test_quality_holds_out(spark, words):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choices(words, k=80)) + "."
    bad = lambda: rng.choice([lambda: " ".join([rng.choice(words)] * 60), lambda: "!! ".join(w.upper() for w in rng.choices(words, k=60)), lambda: "### ".join(rng.choices(words, k=60))])()
    rows = [(k, (bad if k % 4 == 0 else good)(), "en", "a") for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(600)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    got = quality.classify(docs, labels).toPandas()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(got.doc_id, got.held_out, strict=True))
    held = got[got.held_out]
    assert (held.predicted == (held.doc_id % 4 > 0)).mean() > 0.97 and ((got.score >= 0.3) == (got.predicted == 1)).all()
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(quality.classify(docs, flipped).toPandas().set_index("doc_id").score, got.set_index("doc_id").score.reindex(range(600)).sort_index().reindex(quality.classify(docs, flipped).toPandas().doc_id))
    x, y = np.array([3.0, 1, 2, 2, 5]), np.array([1.0, 0, 1, 0, 1])
    knots, value = quality.isotonic(x, y)
    assert list(knots) == sorted(knots) and (np.diff(value) >= 0).all()


def test_toxicity_holds_out(spark, words):
    rng = random.Random(4)
    slurs = ["zogan", "brikt", "idiot"]
    rows = [(k, " ".join(rng.choices(words, k=90) if k % 4 else rng.sample(rng.choices(words, k=86) + rng.choices(slurs, k=4), 90)), "en", "a") for k in range(600)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(table(spark, rows), labels).toPandas()
    held = got[got.held_out]
    assert (held.predicted == (held.doc_id % 4 == 0)).mean() > 0.97


def test_line_runs_is_brute_force(spark, docs, rows):
    texts = sorted({(1 << 63 if i is None else i, t or "") for i, t, _, _ in rows})
    mixes = {r["text"]: r["m"] for r in docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("m")).distinct().collect()}
    want, seen = {}, set()
    for i, t in sorted(texts, key=lambda x: (x[0], mixes[x[1]])):
        lines = t.split("\n")
        sizes, gone = [len(x.split()) for x in lines], set()
        for a in range(len(lines)):
            for z in range(a + 1, len(lines) + 1):
                if sum(sizes[a:z]) >= 50:
                    run = tuple(lines[a:z])
                    if run in seen:
                        gone.update(range(a, z))
                    seen.add(run)
        want[i, t] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    got = line_runs.drop_later_copies(docs).collect()
    assert sum(n for _, n in want.values()) > 20
    by_id = collections.defaultdict(set)
    for (i, _), v in want.items():
        by_id[None if i == 1 << 63 else i].add(v)
    for r in got:
        assert (r["text"], r["n_removed"]) in by_id[r["doc_id"]], r["doc_id"]


def test_multiset(spark, docs, rows):
    one = multiset.Fingerprint
    a, b, c = b"alpha beta gamma delta", b"x", b"alpha beta gamma"
    assert one.of([a, b, c]) == one.of([c, a, b]) != one.of([a, b, c, c])
    assert one.of([a, b]) + one.of([c]) - one.of([a]) == one.of([b, c]) == one.from_hex(one.of([c, b]).hex())
    assert one.of([a, b]).likeness(one.of([b, a])) == 1.0
    got = {r["doc_id"]: r for r in multiset.fingerprint_edits(docs).collect() if r["doc_id"] is not None}
    order = sorted({(i, t or "") for i, t, _, _ in rows if i is not None}, reverse=True)
    for k, (i, t) in enumerate(order[1:-1], 1):
        n, after = len(t), order[k + 1][1]
        new = t[: n - n // 3] + after[: n // 3]
        r = got[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["edited_fingerprint"] == one.of(multiset.paragraphs(new)).hex() and r["fingerprint"] == one.of(multiset.paragraphs(t)).hex()
        assert r["near_next"] == one.of(multiset.paragraphs(t)).likeness(one.of(multiset.paragraphs(after)))


def test_pipeline(spark, tmp_path, rows, words):
    import corpus_pipeline

    rng = random.Random(8)
    item = " ".join(rng.choices(words, k=30))
    extra = [(2000 + k, " ".join(rng.choices(words, k=120)) + "\n" + (item if k % 10 == 0 else "end"), "en", "a") for k in range(60)] + [(3000 + k, "!! ".join(w.upper() for w in rng.choices(words, k=60)), "en", "b") for k in range(40)]
    table(spark, rows + extra).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 3000), 0) for i, *_ in extra], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, scratch = str(tmp_path), Scratch(spark, "t")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.save(stage(spark, docs, d))
        assert out.columns == docs.columns
        kept[name] = {r[0] for r in out.select("doc_id").collect()}
        docs = out
    assert not {i for i in kept["quality"] if i and i >= 3000} and len({i for i in kept["quality"] if i and i >= 2000}) == 60
    assert not {i for i in kept["decontamination"] if i and 2000 <= i < 3000 and i % 10 == 0}
    assert kept["near_duplicates"] - kept["decontamination"] == {i for i in kept["near_duplicates"] if i and 2000 <= i < 3000 and i % 10 == 0}
    got = corpus_pipeline.run(spark, d).toPandas()
    assert set(got.doc_id.dropna()) == kept["mixing"] - {None}


def test_query_names():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))
