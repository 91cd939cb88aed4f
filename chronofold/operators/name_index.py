"""Indexes of a dimension's names that answer top-k queries by similarity without comparing a text with every name.

Both give each name an upper bound of its score from what it shares with the text, look at names in the order of these bounds, and stop when no
other name can enter the k best. So answers, ties included, are those of comparing all. ``compared`` counts the names that were compared.
"""

from __future__ import annotations

from collections.abc import Iterable
from difflib import SequenceMatcher

import numpy as np

#: Names compared first; then as many at a time as may still enter, in steps of ``STEP``.
FIRST, STEP = 32, 256
#: Cells of one table of edit distances.
CELLS = 1 << 20
#: Strings whose characters' places are kept at a time.
MATCHERS = 4096


def _numbered(parts: Iterable[str]) -> list[tuple[str, int]]:
    """Each part with how often it came before, so that sets of these are multisets of the parts."""
    seen: dict[str, int] = {}
    out = []
    for p in parts:
        k = seen.get(p, 0)
        seen[p] = k + 1
        out.append((p, k))
    return out


class Postings:
    """Which names have a part, as one array; ``shared`` tells how many parts each name shares with a text, as multisets."""

    def __init__(self, names: list[list[str]]) -> None:
        at: dict[tuple[str, int], list[int]] = {}
        for k, parts in enumerate(names):
            for p in _numbered(parts):
                at.setdefault(p, []).append(k)
        self.n, self.place = len(names), {p: i for i, p in enumerate(at)}
        self.ends = np.cumsum([0, *map(len, at.values())])
        self.names = np.fromiter((k for ks in at.values() for k in ks), np.int32, int(self.ends[-1]))

    def shared(self, parts: Iterable[str]) -> np.ndarray:
        found = [i for p in _numbered(parts) if (i := self.place.get(p)) is not None]
        lists = [self.names[self.ends[i] : self.ends[i + 1]] for i in found]
        return np.bincount(np.concatenate(lists), minlength=self.n) if lists else np.zeros(self.n, np.int64)


def grams(text: str) -> list[str]:
    """Pairs of neighbours, with the edges: one more than the text has characters."""
    edged = f"\0{text}\0"
    return [edged[k : k + 2] for k in range(len(edged) - 1)] if text else []


def edit_distances(text: str, names: list[str]) -> np.ndarray:
    """Of one text to many names: the table of each is filled row by row, all names at once."""
    sizes = np.fromiter(map(len, names), np.int64, len(names))
    out, order = np.empty(len(names), np.int64), np.argsort(sizes, kind="stable")
    a = 0
    while a < len(order):  # names of like lengths share a table
        z = a + 1
        while z < len(order) and (z - a + 1) * (int(sizes[order[z]]) + 1) <= CELLS:
            z += 1
        some = order[a:z]
        width = int(sizes[some[-1]])
        codes = np.full((len(some), width), -1, np.int64)
        for row, k in enumerate(some):
            codes[row, : sizes[k]] = np.frombuffer(names[k].encode("utf-32-le", "surrogatepass"), "<u4")
        steps = np.arange(width + 1)
        now = np.broadcast_to(steps, (len(some), width + 1))
        for k, c in enumerate(text):
            best = now + 1  # the character goes
            np.minimum(best[:, 1:], now[:, :-1] + (codes != ord(c)), out=best[:, 1:])
            best[:, 0] = k + 1
            now = np.minimum.accumulate(best - steps, axis=1) + steps  # characters come
        out[some] = now[np.arange(len(some)), sizes[some]]
        a = z
    return out


class Items:
    """Names with types, ranked by edit similarity and a bonus where the type agrees; ties by id.

    An edit spoils two grams and one character at most, so two strings are at least (longest + 1 - shared grams) / 2 edits apart, and longest -
    shared characters, and as many as their lengths differ by.
    """

    def __init__(self, rows: list[tuple[int, str, str, str | None]]) -> None:
        rows = sorted(rows, key=lambda r: r[0])
        self.ids, self.names = np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]
        self.norms, self.sizes = [r[2] for r in rows], np.array([len(r[2]) for r in rows], np.int64)
        self.types: dict[str, np.ndarray] = {}
        for k, r in enumerate(rows):
            if r[3] is not None:
                self.types.setdefault(r[3], []).append(k)
        self.types = {t: np.array(ks) for t, ks in self.types.items()}
        self.grams, self.characters = Postings([grams(x) for x in self.norms]), Postings([list(x) for x in self.norms])
        self.compared = 0

    def best(self, norm: str, kind: str | None, k: int, bonus: float) -> list[tuple[int, str, float]]:
        """``id``, ``name`` and ``score`` (without the bonus) of the ``k`` best."""
        if not len(self.ids):
            return []
        longest = np.maximum(self.sizes, len(norm))
        edits = np.maximum((longest + 2 - self.grams.shared(grams(norm))) // 2, longest - self.characters.shared(norm))
        edits = np.minimum(np.maximum(edits, np.abs(self.sizes - len(norm))), longest)
        more = np.zeros(len(self.ids))
        if kind is not None and kind in self.types:
            more[self.types[kind]] = bonus
        at_most = np.where(longest > 0, 1 - edits / np.maximum(longest, 1), 1.0) + more
        held: list[tuple[float, int, int, float]] = []

        def compare(some: np.ndarray) -> None:
            nonlocal held
            self.compared += len(some)
            far = edit_distances(norm, [self.norms[j] for j in some])
            for j, d in zip(some.tolist(), far.tolist(), strict=True):
                score = 1 - d / longest[j] if longest[j] else 1.0
                held.append((-(score + more[j]), int(self.ids[j]), j, float(score)))
            held = sorted(held)[:k]

        first = np.argpartition(-at_most, FIRST)[:FIRST] if len(at_most) > FIRST else np.arange(len(at_most))
        compare(first)
        rest = at_most.copy()
        rest[first] = -np.inf
        left = np.flatnonzero(rest >= (-held[-1][0] if len(held) == k else -np.inf))
        left = left[np.isfinite(rest[left])]
        left = left[np.argsort(-rest[left], kind="stable")]
        for a in range(0, len(left), STEP):
            some = left[a : a + STEP]
            if len(held) == k:
                some = some[rest[some] >= -held[-1][0]]
            if not len(some):
                break
            compare(some)
        return [(i, self.names[j], s) for _, i, j, s in held]


class Entities:
    """Names with a base and a form, ranked by the ratio of the whole names, or of the base and the text's beginning where the form allows it; ties by
    the whole ratio, then id.

    Twice the characters that two strings share over both lengths is an upper bound of their ratio.
    """

    def __init__(self, rows: list[tuple[int, str, str, str, str]]) -> None:
        rows = sorted(rows, key=lambda r: r[0])
        self.ids, self.names, self.norms, self.bases = ([r[k] for r in rows] for k in range(4))
        self.sizes, self.base_sizes = (np.array([len(x) for x in xs], np.int64) for xs in (self.norms, self.bases))
        self.forms: dict[str, list[int]] = {}
        for k, r in enumerate(rows):
            self.forms.setdefault(r[4], []).append(k)
        self.whole, self.base = Postings([list(x) for x in self.norms]), Postings([list(x) for x in self.bases])
        self.compared = 0
        self.matchers: dict[str, SequenceMatcher] = {}

    def _ratio(self, a: str, b: str) -> float:
        self.compared += 1
        if (held := self.matchers.get(b)) is None:  # what it knows of its second string is kept
            if len(self.matchers) >= MATCHERS:
                self.matchers.clear()
            held = self.matchers[b] = SequenceMatcher(None, "", b)
        held.set_seq1(a)
        return held.ratio()

    def best(self, norm: str, k: int, least: float | None = None) -> list[tuple[int, str, float, float]]:
        """``id``, ``name``, ``score`` and ``whole`` (the ratio of the whole names) of the ``k`` best, of those that reach ``least``."""
        if not self.ids:
            return []
        total = self.sizes + len(norm)
        whole = np.where(total > 0, 2.0 * self.whole.shared(norm) / np.maximum(total, 1), 1.0)
        head = np.minimum(self.base_sizes, len(norm))
        prefix = np.where(self.base_sizes > 0, 2.0 * np.minimum(self.base.shared(norm), head) / np.maximum(self.base_sizes + head, 1), 0.0)
        gate = np.zeros(len(self.ids), bool)
        for form, ks in self.forms.items():
            gate[ks] = form in norm  # without a form: always
        prefix = np.where(gate, prefix, 0.0)
        at_most = np.maximum(whole, prefix)
        floor = -np.inf if least is None else least
        order = np.flatnonzero(at_most >= floor)
        order = order[np.argsort(-at_most[order], kind="stable")]
        held: list[tuple[float, float, int, int]] = []
        for j in order.tolist():
            now = -held[-1][0] if len(held) == k else floor
            if at_most[j] < now:
                break
            full = self._ratio(norm, self.norms[j])
            score = full
            if prefix[j] > full and prefix[j] >= now:
                start = norm[: self.base_sizes[j]]
                score = max(full, self._ratio(self.bases[j], start))
            if score >= floor:
                held.append((-score, -full, self.ids[j], j))
                held = sorted(held)[:k]
        return [(i, self.names[j], -s, -w) for s, w, i, j in held]
