"""Toxicity by weak supervision.

Voters look at a whole text and fire or not: one for each word of a small fixed lexicon and for each word or word beginning that labelled
rows show to go with toxic texts, some for groups of them and for their share of the words, some for patterns (address, shouting,
disguised letters, several insults). Shares are those of the densest ``SPAN`` words, so a passage counts in a long text as it does in a
short one.

A generative label model is fitted to the votes of all documents by expectation and maximisation: the share of toxic texts, each voter's
rate on either class (its accuracy), and which voters go together beyond the class. Dependence is part of the likelihood: a voter's rate
may depend on one other voter's vote (a tree, the one that explains most), so that voters that say the same thing twice aren't believed
twice. Labelled rows are the start, and anchors: their votes, of known class, count as ``ANCHOR`` of all documents. Without an anchor the one
latent class of such votes may settle on a language. The posterior of each row of a bounded sample is the label that a logistic regression
over words and voters learns from; its scores are calibrated on labelled rows that aren't held out.

One pass over the texts writes each document's votes and words as bits; label model, classifier and scores work from these.

Bounds: ``SAMPLE`` labelled rows (or so) for the words and the classifier; the driver gets the best ``LEARNT`` words, sums over the voters
and the sample's bits. Words of more than 64 bytes aren't learnt, and a word that one text repeats counts a bounded number of times there.
Votes are counted over all documents, and every document is scored.

Defined cases: null and empty texts fire no voter and are scored like any other; null labels are left out; a document with several
labels counts with their mean; without labels the fixed lexicon's votes and a prior of ``PRIOR`` serve; a null ``doc_id`` is scored and
not held out; rows repeat as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, Scratch, bounded_sample, held_out, summed, texts

SAMPLE = 12_000
LEARNT = 60
VOCABULARY = 256
PRIOR = 0.1

# Words that insult, threaten or degrade, by language.
LEXICON = {
    "en": "idiot idiots moron morons imbecile stupid dumb dumbass loser losers scum trash garbage worthless pathetic disgusting clown bastard bitch asshole crap bullshit fuck fucking shit retard retarded freak creep pig vermin filth filthy parasite subhuman coward liar jerk ugly vile despicable",
    "fr": "connard connasse salaud salope merde putain crétin abruti imbécile débile ordure raclure minable dégueulasse bouffon enculé",
    "de": "arschloch idiot idioten dummkopf trottel depp abschaum scheiße scheiss drecksau hurensohn wichser versager widerlich ekelhaft erbärmlich",
    "es": "imbécil estúpido estúpida idiota basura mierda cabrón puta puto pendejo gilipollas inútil asqueroso asquerosa escoria payaso patético",
}
THREATS = "kill die hang burn hurt destroy töten sterben mourir crever tuer matar morir"
ADDRESS = rb"(?:you|youre|you're|your|u|ur|tu|toi|vous|du|dich|ihr|eres|te|vosotros|they|these|those)"

_BREAKS = bytes(c if c >= 128 or chr(c).isalnum() or chr(c) in "'" else 32 for c in range(256))
_LEET = bytes.maketrans(b"013457@$", b"oieastas")
_LEET_HINT = re.compile(rb"[a-z][013457@$]+[a-z]")
FIXED = {k: frozenset(w.encode() for w in v.split()) for k, v in LEXICON.items()}
INSULTS = frozenset().union(*FIXED.values())
_THREATS = frozenset(w.encode() for w in THREATS.split())
_ADDRESS = frozenset(w for w in ADDRESS[3:-1].split(b"|"))


def words_of(text: str | None) -> tuple[bytes, list[bytes]]:
    low = (text or "").lower().encode()
    return low, low.translate(_BREAKS).split()


#: The share of toxic rows that a learnt unit has at least.
RARE = 0.015
#: Lengths, in bytes, of the word beginnings that are learnt beside whole words.
STEMS = (4, 5, 6, 7)
#: Shares of the words at which a learnt word, a learnt stem, and all hits together count: of the densest ``SPAN`` words of a longer text.
WORD_SHARE, STEM_SHARE, HIT_SHARES = 0.001, 0.008, (0.006, 0.009, 0.013, 0.02)
SPAN = 4000
#: The label model: the weight of labelled rows, as a share of all documents; the rounds it may take and the change at which it has settled.
ANCHOR, MOST_ROUNDS, SETTLED = 0.25, 200, 5e-4
#: The least dependence, in nats for each document, for which a voter looks at another one.
LEAST_GAIN = 1e-4


def stems(word: bytes) -> list[bytes]:
    """Beginnings of a longer word that end with a whole character, marked with an asterisk."""
    n = len(word)
    return [word[:k] + b"*" for k in STEMS if n > k and not 128 <= word[k] < 192]


def densest(at: list[int], span: int = SPAN) -> int:
    """The most of ascending places that lie within ``span`` words."""
    best = first = 0
    for k, x in enumerate(at):
        while x - at[first] >= span:
            first += 1
        best = max(best, k - first + 1)
    return best


class Voters:
    """The voters that learnt units (words, and stems marked with an asterisk) and the fixed lists make; names in order."""

    def __init__(self, units: list[bytes]) -> None:
        words = [u for u in units if not u.endswith(b"*")]
        self.stems = frozenset(u for u in units if u.endswith(b"*"))
        self.all = INSULTS | frozenset(words)
        singles = words + sorted(INSULTS - frozenset(words)) + sorted(self.stems)
        self.place = {w: k for k, w in enumerate(singles)}
        self.names = [w.decode(errors="replace") for w in singles] + [f"lexicon {k}" for k in FIXED] + [f"hits {x:g}" for x in HIT_SHARES] + ["two insults", "three insults", "addressed", "shouted", "disguised", "threat beside insult"]

    def fire(self, text: str | None) -> tuple[list[int], set[bytes], list[bytes]]:
        """Indices of the voters that fire; the text's distinct words; its words."""
        low, words = words_of(text)
        have = set(words)
        n, out = len(words), []
        at, base = len(self.place), len(self.place) + len(FIXED)
        insults = have & INSULTS
        hits = {w: (w,) for w in have & self.all}
        for w in have if self.stems else ():
            if len(w) > STEMS[0] and (s := self.stems.intersection(stems(w))):
                hits[w] = (*hits.get(w, ()), *s)
        if hits:
            near = [i for i, w in enumerate(words) if w in hits]
            places: dict[bytes, list[int]] = {}
            for i in near:
                for u in hits[words[i]]:
                    places.setdefault(u, []).append(i)
            many = len if n <= SPAN else densest
            n = min(n, SPAN)
            counts = {u: many(x) for u, x in places.items()}
            near_most = many(near)
            out += [self.place[u] for u, c in counts.items() if u in INSULTS or c >= n * (STEM_SHARE if u.endswith(b"*") else WORD_SHARE)]
            out += [at + k for k, fixed in enumerate(FIXED.values()) if not fixed.isdisjoint(insults)]
            out += [base + k for k, x in enumerate(HIT_SHARES) if near_most >= n * x]
        base += len(HIT_SHARES)
        if insults:
            if len(insults) > 1:
                out.append(base)
            if len(insults) > 2:
                out.append(base + 1)
            near = [i for i, w in enumerate(words) if w in insults]
            if any(not _ADDRESS.isdisjoint(words[max(0, i - 4) : i + 4]) for i in near):
                out.append(base + 2)
            if not insults.isdisjoint(w.lower() for w in text.encode().translate(_BREAKS).split() if len(w) > 2 and w.isupper()):
                out.append(base + 3)
            if any(not _THREATS.isdisjoint(words[max(0, i - 6) : i + 7]) for i in near):
                out.append(base + 5)
        if _LEET_HINT.search(low) and any(w.translate(_LEET) in INSULTS and w not in INSULTS for w in low.split() if _LEET_HINT.search(w)):
            out.append(base + 4)
        return sorted(out), have, words


def frequent(vocabulary: frozenset[bytes], have: set[bytes], words: list[bytes]) -> list[bytes]:
    """The words of ``vocabulary`` that make up WORD_SHARE of a text, or of its densest ``SPAN`` words."""
    some = vocabulary & have
    if len(words) * WORD_SHARE <= 1 or not some:
        return list(some)
    if len(words) <= SPAN:
        return [w for w in some if words.count(w) >= len(words) * WORD_SHARE]
    places: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        if w in some:
            places.setdefault(w, []).append(i)
    return [w for w, x in places.items() if densest(x) >= SPAN * WORD_SHARE]


class LabelModel:
    """A generative model of the votes.

    ``prior``: the share of toxic texts. ``parent``: for each voter the voter that it depends on beside the class, or -1. ``rate[y, u, i]``:
    how often voter ``i`` fires on class ``y`` where its parent's vote is ``u`` (without a parent, ``u`` is 0). ``rounds`` and ``settled`` tell how
    the fit ended.
    """

    def __init__(self, prior: float, on: np.ndarray, off: np.ndarray) -> None:
        self.prior, self.parent = prior, np.full(len(on), -1)
        one = np.stack([np.clip(off, 1e-4, 0.999), np.clip(on, 1e-3, 0.999)])
        self.rate = np.repeat(one[:, None, :], 2, axis=1)
        self.rounds, self.settled = 0, False

    def given(self, votes: np.ndarray) -> np.ndarray:
        """Each voter's parent's vote; 0 without one."""
        return np.where(self.parent >= 0, votes[:, self.parent], 0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Of rows of 0 and 1."""
        up = self.given(votes)
        z = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for u in (0, 1):
            own = up == u
            yes, no = np.log(self.rate[1, u] / self.rate[0, u]), np.log((1 - self.rate[1, u]) / (1 - self.rate[0, u]))
            z += (own * votes) @ yes + (own * (1 - votes)) @ no
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def counts(self, votes: np.ndarray, weight: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """Weighted sums that the next round needs: for each class and parent's vote, how often voters could fire and did; then the weights."""
        up = self.given(votes)
        out = []
        for w in (weight * (1 - toxic), weight * toxic):
            for u in (0, 1):
                out += [w @ (up == u), w @ ((up == u) * votes)]
        return np.concatenate([*out, [weight @ toxic, weight.sum()]])

    def update(self, sums: np.ndarray) -> float:
        """Maximise; returns the largest change of a rate or of the share of toxic texts."""
        m = len(self.parent)
        table = sums[:-2].reshape(2, 2, 2, m)
        could, did = table[:, :, 0], table[:, :, 1]
        # a pair of votes never seen on a class is as likely as the class's own rate has it
        both = (did.sum(axis=1) + 0.02) / (could.sum(axis=1) + 0.5)
        rate = np.clip((did + 2 * both[:, None, :]) / (could + 2), 1e-4, 0.999)
        prior = float(np.clip(sums[-2] / sums[-1], 0.001, 0.9))
        moved = max(float(np.abs(rate - self.rate).max()), abs(prior - self.prior))
        self.rate, self.prior = rate, prior
        return moved

    def marginal(self) -> tuple[np.ndarray, np.ndarray]:
        """Each voter's rate on toxic texts and on others, whatever its parent's vote: its accuracy."""
        out = []
        for y in (1, 0):
            p = np.full(len(self.parent), np.nan)

            def of(i: int) -> float:
                if np.isnan(p[i]):
                    up = self.parent[i]
                    p[i] = self.rate[y, 0, i] if up < 0 else self.rate[y, 1, i] * of(up) + self.rate[y, 0, i] * (1 - of(up))
                return p[i]

            out.append(np.array([of(i) for i in range(len(p))]))
        return out[0], out[1]


def dependence(second: np.ndarray, weight: float) -> np.ndarray:
    """Mutual information of each pair of voters, in nats, from sums of weighted pairs of votes (on one class) and the sum of weights."""
    if weight <= 0:
        return np.zeros_like(second)
    one = np.diag(second) / weight
    both = second / weight
    out = np.zeros_like(both)
    for a, b, p in ((one, one, both), (one, 1 - one, one[:, None] - both), (1 - one, one, one[None, :] - both), (1 - one, 1 - one, 1 - one[:, None] - one[None, :] + both)):
        p, q = np.maximum(p, 0), np.maximum(np.outer(a, b), 1e-12)
        out += np.where(p > 1e-12, p * np.log(np.maximum(p, 1e-12) / q), 0)
    return np.maximum(out, 0)


def spanning_forest(gain: np.ndarray, least: float = LEAST_GAIN) -> np.ndarray:
    """Each voter's parent in the forest of the largest total gain, -1 for roots; pairs that gain less than ``least`` stay apart."""
    m = len(gain)
    i, j = np.nonzero(np.triu(gain, 1) >= least)
    order = np.argsort(-gain[i, j], kind="stable")
    group, near = np.arange(m), [[] for _ in range(m)]
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if group[a] != group[b]:
            group[group == group[b]] = group[a]
            near[a].append(b)
            near[b].append(a)
    parent, seen = np.full(m, -1), np.zeros(m, bool)
    for root in range(m):
        stack = [] if seen[root] else [root]
        while stack:
            a = stack.pop()
            seen[a] = True
            for b in near[a]:
                if not seen[b]:
                    parent[b] = a
                    stack.append(b)
    return parent


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Rows of 0 and 1 from packed bits."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -(-width // 8))
    return np.unpackbits(raw, axis=1, count=width) if width else np.zeros((len(column), 0), np.uint8)


def fit_label_model(patterns: DataFrame, start: LabelModel, anchor_votes: np.ndarray, anchor_y: np.ndarray, anchor: float = ANCHOR) -> LabelModel:
    """Expectation and maximisation over ``patterns`` (``votes``, packed bits, and ``n``, how many documents have them), anchored by votes of known
    class: first as if voters were independent given the class, then with the tree of their dependences.
    """
    model, m = start, len(start.parent)
    total = summed(patterns, lambda b: np.array([float(sum(b.column(1).to_pylist()))]))
    scale = 0.0 if total is None or not len(anchor_y) else anchor * total[0] / len(anchor_y)
    weight = np.full(len(anchor_y), scale)

    def expect(b: pa.RecordBatch) -> np.ndarray:
        votes = unpacked(b.column(0), m).astype(float)
        return model.counts(votes, b.column(1).to_numpy().astype(float), model.posterior(votes))

    def pairs(b: pa.RecordBatch) -> np.ndarray:
        votes, n = unpacked(b.column(0), m).astype(float), b.column(1).to_numpy().astype(float)
        toxic = model.posterior(votes)
        return np.concatenate([*(((votes * w[:, None]).T @ votes).ravel() for w in (n * (1 - toxic), n * toxic)), [(n * (1 - toxic)).sum(), (n * toxic).sum()]])

    def settle() -> None:
        model.settled = False
        while total is not None and not model.settled and model.rounds < MOST_ROUNDS:
            sums = summed(patterns, expect)
            if len(anchor_y):
                sums = sums + model.counts(anchor_votes, weight, anchor_y)
            model.rounds += 1
            model.settled = model.update(sums) < SETTLED

    settle()
    if total is not None:
        sums = summed(patterns, pairs)
        gain = sum(dependence(sums[k * m * m : (k + 1) * m * m].reshape(m, m), sums[2 * m * m + k]) * sums[2 * m * m + k] for k in (0, 1)) / max(total[0], 1)
        model.parent = spanning_forest(gain)
        model.rounds = 0
        settle()
        if not model.settled:
            warnings.warn(f"the label model hasn't settled after {model.rounds} rounds", stacklevel=2)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Newton's method on soft labels; the last column is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


class ToxicityModel:
    """Voters, words, what the label model made of them, and the weights that score a row of bits: words first, then voters."""

    def __init__(self, voters: Voters, vocabulary: list[bytes]) -> None:
        self.voters, self.place, self.words = voters, {w: k for k, w in enumerate(vocabulary)}, frozenset(vocabulary)
        self.label_model: LabelModel | None = None
        self.weights, self.slope, self.shift = np.zeros(self.width + 1), 1.0, 0.0

    @property
    def width(self) -> int:
        return len(self.place) + len(self.voters.names)

    def bits(self, text: str | None) -> tuple[list[int], list[int]]:
        """Which words, and which voters, a text has."""
        fired, have, words = self.voters.fire(text)
        return [self.place[w] for w in frequent(self.words, have, words)], fired

    def of_bits(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))

    def score(self, text: str | None) -> float:
        words, fired = self.bits(text)
        x = np.zeros((1, self.width))
        x[0, words + [len(self.place) + k for k in fired]] = 1
        return float(self.of_bits(x)[0])


def _labelled(docs: DataFrame, labels: DataFrame, target: str, sample: int) -> DataFrame:
    known = labels.filter(F.col(target).isNotNull() & F.col(ID).isNotNull() & ~held_out()).groupBy(F.col(ID).cast("long").alias(ID)).agg(F.avg(F.col(target).cast("double")).alias("y"))
    known = bounded_sample(known, sample)
    return texts(docs).join(F.broadcast(known), ID).select(ID, TEXT, "y")  # at most about ``sample`` ids are broadcast


def learn_units(rows: DataFrame, most: int, with_stems: bool) -> list[bytes]:
    """The words, and word beginnings, whose rate is most clearly higher in toxic texts of ``rows`` (``text``, ``y``); counted in the
    cluster, the best come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[bytes, list[float]] = {}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)[1]
                own: dict[bytes, int] = {b"": len(words)}
                for w in words:
                    own[w] = own.get(w, 0) + 1
                if with_stems:
                    for w, c in list(own.items()):
                        for u in stems(w):
                            own[u] = own.get(u, 0) + c
                for u, c in own.items():
                    c = min(c, 2 + len(words) // 40) if u else c  # a word that one text repeats tells little
                    if len(u) <= 64:
                        t = counts.setdefault(u, [0.0, 0.0, 0.0])
                        t[0] += c * y
                        t[1] += c * (1 - y)
                        t[2] += y
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), *(pa.array([t[k] for t in counts.values()], pa.float64()) for k in range(3))], names=["unit", "a", "b", "docs"])

    toxic = rows.agg(F.sum("y")).first()[0] or 0.0
    counts = rows.mapInArrow(run, "unit binary, a double, b double, docs double").groupBy("unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("docs").alias("docs"))
    sizes = counts.filter(F.length("unit") == 0).first()
    if not sizes or not sizes["a"] or not sizes["b"]:
        return []
    odds = F.log((F.col("a") + 0.5) / sizes["a"]) - F.log((F.col("b") + 0.5) / sizes["b"])
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = counts.filter(F.length("unit") > 0).filter(F.col("docs") >= max(3.0, RARE * toxic)).withColumn("z", z).withColumn("odds", odds).filter("z > 4 and odds > 2.5").orderBy(F.desc("z"), "unit").limit(most)
    return [bytes(r["unit"]) for r in best.collect()]


def observed(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id``, ``held_out``, ``words``, ``votes`` (packed bits): one row for each row of ``docs``. The one pass over the texts."""
    n, m = len(model.place), len(model.voters.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, votes = np.zeros((b.num_rows, n), np.uint8), np.zeros((b.num_rows, m), np.uint8)
            for r, text in enumerate(b.column(1).to_pylist()):
                own, fired = model.bits(text)
                words[r, own] = 1
                votes[r, fired] = 1
            packed = [pa.array([p.tobytes() for p in np.packbits(x, axis=1)], pa.binary()) for x in (words, votes)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *packed], names=[ID, "held_out", "words", "votes"])

    return texts(docs).withColumn("held_out", held_out()).mapInArrow(run, f"{ID} long, held_out boolean, words binary, votes binary")


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = SAMPLE) -> tuple[ToxicityModel, DataFrame]:
    """The model, and the documents' bits (``observed``) that it was fitted to."""
    scratch = Scratch(docs.sparkSession, "votes")
    rows = scratch.save(_labelled(docs, labels, target, sample))
    prior = rows.agg(F.avg("y")).first()[0]
    model = ToxicityModel(Voters(learn_units(rows.select(TEXT, "y"), LEARNT, True)), learn_units(rows.select(TEXT, "y"), VOCABULARY, False))
    known = rows.groupBy(ID).agg(F.first("y").alias("y"))
    seen = scratch.save(observed(docs, model))
    n, m = len(model.place), len(model.voters.names)
    got = seen.join(F.broadcast(known), ID).select("words", "votes", "y").toArrow()  # bits of about ``sample`` rows
    scratch.drop(rows)
    words, votes = (unpacked(got.column(k), w).astype(float) for k, w in ((0, n), (1, m)))
    y = got.column(2).to_numpy().astype(float)
    sure = np.array([not x.startswith("hits") for x in model.voters.names]) * 1.0  # a guess for what no labels tell about
    on = (y @ votes + 0.3 * sure) / (y.sum() + 1)
    off = ((1 - y) @ votes + 0.02) / ((1 - y).sum() + 1)
    start = LabelModel(PRIOR if prior is None else min(0.9, max(0.005, float(prior))), on, off)
    patterns = scratch.save(seen.groupBy("votes").agg(F.count("*").alias("n")))
    model.label_model = fit_label_model(patterns, start, votes, y)
    scratch.drop(patterns)
    if not len(y):
        model.weights = np.concatenate([np.zeros(n), sure * 2.0, [-3.0]])
        return model, seen
    x = np.hstack([words, votes, np.ones((len(y), 1))])
    model.weights = logistic(x, model.label_model.posterior(votes), ridge=1.0)
    if 0 < y.mean() < 1:
        slope, model.shift = logistic(np.stack([x @ model.weights, np.ones(len(y))], axis=1), y, ridge=0.5).tolist()
        model.slope = max(slope, 1e-3)
    return model, seen


def score(seen: DataFrame, model: ToxicityModel, cut: float = 0.5) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` (1 at ``cut`` or more) of documents' bits: one row for each."""
    n, m = len(model.place), len(model.voters.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.hstack([unpacked(b.column(2), n), unpacked(b.column(3), m)]).astype(float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.of_bits(x))], names=[ID, "held_out", "score"])

    return seen.mapInArrow(run, f"{ID} long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= cut).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model, seen = fit(docs, labels)
    return score(seen, model)
