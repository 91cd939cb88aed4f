"""Benchmark decontamination by template windows.

Texts become templates: numbers, units behind numbers and names are replaced by typed placeholders, a run of names by one; other words
lose case and the punctuation around them; tokens that are punctuation alone vanish. A template has two forms:

* plain: a name is a capitalised word within a sentence that isn't one of ``COMMON``;
* open: capitalised words that begin a sentence are names too, and in documents so is every word that no benchmark item has as a plain
  word. So a name is found at the start of a sentence, and in texts that are written in capitals or without any.

A word that one item has as a plain word may be another item's name. So a window of a document's open form also counts with any of its other
words (but those of ``COMMON``) as names, wherever some item's window has names in these places: what an item is found by doesn't hang on
the words of other items. (One thing does: a name of several words in lower case is one name while no item has any of them as a plain word.)

Windows of ``WINDOW`` template tokens of either form are hashed and hash-joined with the benchmark's windows. An item is found in a
document if enough of its windows, told by their places in the item, are there and its slots are consistent: a value of the item stands
for one value of the document wherever it occurs. A document may have a window at several places, so the item is laid over it at each
offset that a window gives, every window at its place nearest to that offset, and the best offset counts. So a question with other numbers
or names is caught as long as they are exchanged throughout, in each of its variants.

A text of fewer than ``WINDOW`` template tokens has one window, its whole template: a short item is found where it is the whole document.
Short templates of placeholders alone have none.

Before the join, a bit table of the benchmark's window hashes drops windows that can't match; it is built only while the benchmark has at
most ``MOST_WINDOWS`` windows, and beyond that all windows go to the join, with the same result.

Defined cases: null and empty texts have no windows and never match; items and documents without an id are left out of the result;
repeated items or documents count once for each id, and an item id with several texts is found
where one of them is; an item written in
capitals has its names as plain words; an empty table gives no rows; other columns are ignored, and kept by ``drop_contaminated``. A whole
text is held at once, with 9 bytes for each word beside it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import ID, TEXT, Scratch, cache_of, looked_up, texts, without

WINDOW = 5
#: Shares of an item's windows that must be found, and of its slots that must be consistent.
COVERAGE, CONSISTENT = 0.6, 0.8
MOST_WINDOWS = 1 << 22
#: Bits of the table of windows, for each entry, and at most (32 MB).
ENTRY_BITS, MOST_BITS = 512, 1 << 28
CACHE_WORDS = 150_000

# Words that are units behind a number; number words; words that are no names though they begin sentences.
UNITS = (
    "kg g mg lb lbs oz ton tons tonnes km m cm mm mi mile miles ft foot feet inch inches yard yards meter meters metre metres kilometers "
    "kilometres l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years mph kmh km/h m/s °c °f degrees dollar dollars usd euro euros eur pound pounds cent cents percent items people "
    "points jahre tage stunden minuten heures jours ans horas días años"
)
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million half dozen"
)
COMMON = (
    "a an the this that these those and but or nor so if when while where who what which why how is are was were do does did can could "
    "will would shall should may might must he she it they we you i his her its their our your my in on at by for from of to with as after "
    "before since until then there here not no all some each every any both first later "
    "le la les un une des et mais ou si quand où qui que quel quelle il elle ils elles nous vous je ce cette ces dans sur avec pour par de du "
    "der die das ein eine und aber oder wenn wo wer was welche wie er sie es wir ihr ich in im auf mit für von zu "
    "el los las una y pero o cuando donde quien cual como él ella nosotros este esta estos en con para por del"
)
_UNITS, _NUMBERS, _COMMON = (frozenset(x.encode() for x in v.split()) for v in (UNITS, NUMBERS, COMMON))
_NUMBER = re.compile(rb"[+-]?[$\xe2\x82\xac\xc2\xa3]*[0-9][0-9.,:/]*(?:%|[a-z]{1,3})?$")
_EDGES = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())

_NUM, _UNIT, _NAME, _SKIP, _STOP, _STRANGE, _USUAL = 1, 2, 4, 8, 16, 32, 64
ENTRY = np.dtype([("word", "<u8"), ("flags", "u1")])
PLACEHOLDERS = {_NUM: 0x9D39247E33776D41, _UNIT: 0x2AF7398005AAA5C7, _NAME: 0x44DB015024623547}
_LINE, _AFTER_STOP, _STOPS = b"\x00", b"#$%&*|\"')]", (b".", b"!", b"?", b":")
_pack = struct.Struct("<QB").pack


class Bits:
    """A set of hashes as a table of bits: it may have a hash that isn't in the set, and never lacks one that is."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.bits = min(MOST_BITS, 1 << max(16, int(len(hashes) * ENTRY_BITS).bit_length()))
        self.table = np.zeros(self.bits // 8, np.uint8)
        at = self._at(hashes)
        np.bitwise_or.at(self.table, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        self.tag = xxh64_intdigest(self.table.tobytes())

    def _at(self, hashes: np.ndarray) -> np.ndarray:
        return _mix(hashes) >> np.uint64(65 - self.bits.bit_length())

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self._at(hashes)
        return (self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Words:
    """The benchmark's plain words, exactly, as sorted hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.unique(hashes)
        self.tag = xxh64_intdigest(self.sorted.tobytes())

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return self.sorted[at] == hashes


def _bare(word: bytes) -> bytes:
    own = word.strip(_EDGES)
    return own.lower() if own.isascii() else own.decode().lower().encode()


def _entry(word: bytes) -> tuple[int, int]:
    """A word's hash and flags."""
    own = word.strip(_EDGES)
    if own.isalpha():  # of ASCII letters
        bare, name = own.lower(), own[:1].isupper() and own[1:].islower()
        flags = 0
    else:
        text = own.decode()
        bare, name = text.lower().encode(), text[:1].isupper() and text[1:].islower()
        flags = _NUM if _NUMBER.match(bare) else 0
    if name and bare not in _COMMON:
        flags |= _NAME
    if not bare or word == _LINE:
        flags = _SKIP
    elif bare in _NUMBERS:
        flags |= _NUM
    if bare in _UNITS:
        flags |= _UNIT
    if bare in _COMMON:
        flags |= _USUAL
    if len(own) < len(word) and word.rstrip(_AFTER_STOP)[-1:] in _STOPS or word == _LINE:
        flags |= _STOP
    return xxh64_intdigest(bare), flags


def _entries(words: list[bytes], vocabulary: Words | None) -> list[bytes]:
    made = [_entry(w) for w in words]
    strange = ~vocabulary.has(np.array([h for h, _ in made], np.uint64)) if vocabulary is not None else np.zeros(len(made), bool)
    return [_pack(h, f | _STRANGE if s else f) for (h, f), s in zip(made, strange.tolist(), strict=True)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Form:
    """A template in one form: codes of its tokens, which are slots, which are names and which may be, and the words that each token stands for."""

    __slots__ = ("codes", "slots", "names", "maybe", "starts", "ends", "words")

    def __init__(self, codes: np.ndarray, slots: np.ndarray, names: np.ndarray, maybe: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: list[bytes]) -> None:
        self.codes, self.slots, self.names, self.maybe, self.starts, self.ends, self.words = codes, slots, names, maybe, starts, ends, words

    def value(self, token: int) -> str:
        """What stands in a slot."""
        own = b" ".join(x for w in self.words[self.starts[token] : self.ends[token]] if w != _LINE and (x := _bare(w)))
        return own.decode() if len(own) <= 64 else f"{xxh64_intdigest(own):016x}"


def template(text: str | None, vocabulary: Words | None = None) -> list[Form]:
    """The template's plain form, and its open form where that is another one."""
    words = (text or "").encode().replace(b"\x00", b" ").replace(b"\n", b" \x00 ").split()
    entries = looked_up(cache_of(f"template {vocabulary.tag if vocabulary else 0}"), words, lambda new: _entries(new, vocabulary), CACHE_WORDS)
    all_ = np.frombuffer(b"".join(entries), ENTRY)
    flags = all_["flags"]
    first = np.append(True, (flags[:-1] & _STOP) > 0)[: len(flags)]  # of a sentence
    kept = np.flatnonzero((flags & _SKIP) == 0)
    # a token of punctuation alone may end a sentence for the word that follows it
    flags, plain, first = flags[kept], all_["word"][kept], first[kept]
    number = (flags & _NUM) > 0
    unit = ((flags & _UNIT) > 0) & np.append(False, number[:-1])[: len(number)] & ~number
    free = ~number & ~unit
    capital = ((flags & _NAME) > 0) & free
    name = capital & ~first
    open_ = capital | ((flags & _STRANGE) > 0) & free
    out = []
    for names in (name, open_) if (open_ != name).any() else (name,):
        codes = plain.copy()
        for where, kind in ((number, _NUM), (unit, _UNIT), (names, _NAME)):
            codes[where] = PLACEHOLDERS[kind]
        run = names & np.append(False, names[:-1] & ((flags[:-1] & _STOP) == 0))[: len(names)]  # goes on with the names before, within a sentence
        at = np.flatnonzero(~run)
        ends = np.append(kept, len(words))[np.append(at[1:], len(kept))] if len(at) else at
        maybe = free & ~names & ((flags & _USUAL) == 0)
        out.append(Form(codes[at], (number | unit | names)[at], names[at], maybe[at], kept[at], ends, words))
    return out


#: What tells the places in a window apart.
_PLACES = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) for k in range(WINDOW)], np.uint64)


def _placed(codes: np.ndarray, k: int) -> np.ndarray:
    return _mix(codes * _PLACES[k] + _PLACES[-1 - k])


def windows(codes: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Hashes of all windows; of the whole template if it is shorter and has a plain word. A hash is a sum over the places."""
    size = min(WINDOW, len(codes))
    if size < WINDOW and slots.all():
        return np.zeros(0, np.uint64)
    n = len(codes) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h += _placed(codes[k : k + n], k)
    return h


def _mask(marks: np.ndarray, n: int) -> np.ndarray:
    """For each window, the places that are marked, as bits."""
    out = np.zeros(n, np.uint8)
    for k in range(min(WINDOW, len(marks))):
        out |= marks[k : k + n].astype(np.uint8) << np.uint8(k)
    return out


def _pair(one: np.ndarray, other: np.ndarray, distance: int) -> np.ndarray:
    return _mix(one * _PLACES[0] + _mix(other * _PLACES[1] + np.uint64(distance)))


def name_places(form: Form) -> tuple[set[int], list[np.ndarray]]:
    """Which sets of places of a form's windows have names, as bits; the pairs of tokens that stand next to each other there but for names."""
    n = len(windows(form.codes, form.slots))
    masks, pairs = _mask(form.names, n), []
    for m in set(masks.tolist()) - {0}:
        at = np.flatnonzero(masks == m)
        plain = [k for k in range(min(WINDOW, len(form.codes))) if not m >> k & 1]
        pairs += [_pair(form.codes[at + a], form.codes[at + z], z - a) for a, z in zip(plain[:-1], plain[1:], strict=True)]
    return set(masks.tolist()) - {0}, pairs


def renamed(forms: list[Form], masks: list[int], pairs: Bits | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of the benchmark's ``masks`` (places of names): the windows, over all ``forms`` in a row, that have names in just these places if some of
    their words are names, and their hashes then. Windows whose other words no item has next to each other are left out first, by ``pairs``.
    """
    sizes = np.array([len(f.codes) for f in forms])
    n, ahead = int(sizes.sum()), WINDOW - 1
    # tokens of no text at the end, so that a window begins at each token
    codes, names, maybe = (np.concatenate([*(getattr(f, c) for f in forms), np.zeros(ahead, t)]) for c, t in (("codes", np.uint64), ("names", bool), ("maybe", bool)))
    text, long = np.append(np.repeat(np.arange(len(forms)), sizes), np.full(ahead, -1)), np.repeat(sizes, sizes)
    free, inside = names | maybe, {d: text[:n] == text[d : d + n] for d in range(1, WINDOW)}
    met = {d: inside[d] & pairs.has(_pair(codes[:n], codes[d : d + n], d)) if pairs is not None else inside[d] for d in range(1, WINDOW)}
    met = {d: np.append(x, np.zeros(ahead, bool)) for d, x in met.items()}
    first = np.append(True, text[1:n] != text[: n - 1]) if n else np.zeros(0, bool)
    for m in masks:
        for size in range(m.bit_length(), WINDOW + 1):
            # a short text is one window, from its first token
            start = (long >= WINDOW) & inside[ahead] if size == WINDOW else first & (long == size)
            plain = [k for k in range(size) if not m >> k & 1]
            if not plain or not start.any():
                continue
            for k in range(size):
                start = start & (free[k : k + n] if m >> k & 1 else ~names[k : k + n])
            for a, z in zip(plain[:-1], plain[1:], strict=True):
                start = start & met[z - a][a : a + n]
            at = np.flatnonzero(start)
            at = at[~np.logical_and.reduce([names[at + k] for k in range(size) if m >> k & 1])]  # those are the form's own windows
            if len(at):
                h = np.full(len(at), size, np.uint64)
                for k in range(size):
                    h += _placed(np.full(1, PLACEHOLDERS[_NAME], np.uint64) if m >> k & 1 else codes[at + k], k)
                yield m, at, h


ROWS = "long, form int, at long, h long, slots array<string>"
_ROW_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()))


#: Tokens of documents whose renamed windows are looked for together.
TOGETHER = 200_000


class Names:
    """Where the benchmark's windows have names, and which other words stand next to each other there."""

    def __init__(self, masks: list[int], pairs: Bits | None) -> None:
        self.masks, self.pairs = masks, pairs


def _rows(id_name: str, table: Bits | None, vocabulary: Words | None, names: Names | None = None):
    """Windows of each text that ``table`` doesn't rule out: the form they are of, their places and the values of their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in _ROW_TYPES]
            held: list[tuple[int, int, int, Form]] = []

            def add(doc_id: int, apart: int, k: int, form: Form, mask: int, found: np.ndarray, hashes: np.ndarray, out: list[list] = out) -> None:
                out[0] += [doc_id] * len(found)
                out[1] += [k] * len(found)
                out[2] += (form.starts[found] + apart).tolist()
                out[3] += hashes.view(np.int64).tolist()
                slots = form.slots
                out[4] += [[form.value(p) for p in range(a, min(a + WINDOW, len(slots))) if slots[p] or mask >> (p - a) & 1] for a in found.tolist()]

            def look(held: list[tuple[int, int, int, Form]] = held) -> None:
                starts = np.cumsum([0, *(len(f.codes) for *_, f in held)])
                for mask, at, hashes in renamed([f for *_, f in held], names.masks, names.pairs):
                    ok = np.flatnonzero(table.has(hashes)) if table is not None else np.arange(len(at))
                    which = np.searchsorted(starts, at[ok], side="right") - 1
                    for w in np.unique(which).tolist():
                        own = ok[which == w]
                        add(*held[w], mask, at[own] - starts[w], hashes[own])
                held.clear()

            tokens = 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                forms, apart = template(text, vocabulary), xxh64_intdigest((text or "").encode()) >> 42 << 32  # rows that share an id stay apart
                for k, form in enumerate(forms):
                    h = windows(form.codes, form.slots)
                    found = np.arange(len(h)) if table is None else np.flatnonzero(table.has(h))
                    if len(found):
                        add(doc_id, apart, k, form, 0, found, h[found])
                if names is not None and names.masks and len(forms[-1].codes):
                    held.append((doc_id, apart, len(forms) - 1, forms[-1]))
                    tokens += len(forms[-1].codes)
                    if tokens >= TOGETHER:
                        look()
                        tokens = 0
            if held:
                look()
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, _ROW_TYPES, strict=True)], names=[id_name, "form", "at", "h", "slots"])

    return run


def _plain_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes = {h for t in b.column(0).to_pylist() for form in template(t)[:1] for h in form.codes[~form.slots].tolist()}
        yield pa.RecordBatch.from_arrays([pa.array(np.array(list(hashes), np.uint64).view(np.int64))], names=["h"])


def _name_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``name_places`` of items: a row for each set of places (``h`` null) and for each pair (``mask`` null)."""
    masks: set[int] = set()
    for b in batches:
        pairs = [np.zeros(0, np.uint64)]
        for t in b.column(0).to_pylist():
            for form in template(t):
                own, next_to = name_places(form)
                masks |= own
                pairs += next_to
        h = np.unique(np.concatenate(pairs)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int32()), pa.array(h)], names=["mask", "h"])
    yield pa.RecordBatch.from_arrays([pa.array(sorted(masks), pa.int32()), pa.nulls(len(masks), pa.int64())], names=["mask", "h"])


def _hashes(rows: DataFrame) -> np.ndarray:
    return np.asarray(rows.select("h").distinct().toArrow().column("h"), np.int64).view(np.uint64)


def consistency(hits: list[dict], n_windows: int, coverage: float) -> tuple[float, bool]:
    """The share of an item's slot values that stand for one value of the document, at the best offset; whether all values are the same.

    ``hits`` has the item's and the document's occurrences (``at``, ``slots``) of each window that both have. Windows further from an
    offset than the item is long don't count there, if those that are near reach ``coverage``.
    """
    places = [np.sort(np.array([o["at"] for o in h["occ"]])) for h in hits]
    values = [{o["at"]: o["slots"] for o in h["occ"]} for h in hits]
    length = 1 + max(o["at"] for h in hits for o in h["item_occ"])
    offsets, counts = np.unique(np.concatenate([(p[:, None] - np.array([o["at"] for o in h["item_occ"]])[None, :]).ravel() for p, h in zip(places, hits, strict=True)]), return_counts=True)
    best = (-1.0, False)
    for d in offsets[np.argsort(-counts, kind="stable")].tolist():
        laid = []
        for p, v, h in zip(places, values, hits, strict=True):
            for o in h["item_occ"]:
                i = int(np.searchsorted(p, o["at"] + d))
                near = min(p[max(i - 1, 0) : i + 1].tolist(), key=lambda x: abs(x - o["at"] - d))
                laid.append((o["at"], abs(near - o["at"] - d) <= length, o["slots"], v[near]))
        if len({at for at, close, _, _ in laid if close}) >= n_windows * coverage:
            laid = [x for x in laid if x[1]]
        meant: dict[str, set[str]] = {}
        for _, _, ours, theirs in laid:
            for a, b in zip(ours, theirs, strict=False):
                meant.setdefault(a, set()).add(b)
        share = sum(len(v) == 1 for v in meant.values()) / len(meant) if meant else 1.0
        best = max(best, (share, all(v == {a} for a, v in meant.items())))
        if best == (1.0, True):
            break
    return best


def _judge(coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [consistency(hits, n, coverage) for hits, n in zip(b.column(4).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(4)), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.bool_())],
                names=[ID, "item_id", "n_windows", "n_found", "slot_consistency", "same_values"],
            )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistent: float = CONSISTENT, item_id: str = "item_id", item_text: str = TEXT) -> DataFrame:
    """Pairs ``doc_id``, ``item_id`` of documents and the items they have, with ``n_windows`` (places in the item), ``n_found``,
    ``coverage``, ``slot_consistency`` and ``same_values`` (no slot has another value: not only the template is there).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "items")
    items = texts(benchmark, item_id, item_text).filter(F.col(ID).isNotNull()).withColumnRenamed(ID, "item_id").dropDuplicates()
    each = scratch.save(items.mapInArrow(_rows("item_id", None, None), f"item_id {ROWS}").withColumn("item_text", F.shiftright("at", 32)))
    occurrences = F.collect_set(F.struct("at", "slots"))
    item = ["item_id", "item_text"]
    # an item's own places count from its start
    own = F.struct(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at"), "slots")
    ours = scratch.save(each.groupBy(*item, "h").agg(F.collect_set(own).alias("item_occ")))
    # the forms may differ in how many places they have: a run of names is one
    total = scratch.save(each.groupBy(*item, "form").agg(F.countDistinct("at").alias("n")).groupBy(*item).agg(F.min("n").alias("n_windows")))
    n = ours.count()
    table = spark.sparkContext.broadcast(Bits(_hashes(ours))) if n <= MOST_WINDOWS else None
    # the benchmark's distinct words, 8 bytes each, and at most 31 sets of places
    vocabulary = spark.sparkContext.broadcast(Words(_hashes(items.select(TEXT).mapInArrow(_plain_words, "h long"))))
    places_of = scratch.save(items.select(TEXT).mapInArrow(_name_places, "mask int, h long").distinct())
    masks = sorted(r[0] for r in places_of.filter("mask is not null").select("mask").collect())
    names = spark.sparkContext.broadcast(Names(masks, Bits(_hashes(places_of.filter("h is not null"))) if n <= MOST_WINDOWS else None))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(ID, table and table.value, vocabulary.value, names.value)(batches)

    few = n <= 100_000  # windows, of at most WINDOW slots of 64 bytes each
    theirs = texts(docs).filter(F.col(ID).isNotNull()).mapInArrow(rows, f"{ID} {ROWS}")
    # one row for each window of an item that a document has, with its places in both
    places = ours.select(*item, "h", F.transform("item_occ", lambda o: o["at"]).alias("ats")).join(total, item)
    pair = [ID, *item, "n_windows"]
    hits = theirs.join(F.broadcast(places) if few else places, "h").groupBy(*pair, "h").agg(occurrences.alias("occ"), F.first("ats").alias("ats"))
    found = F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long")
    many = hits.groupBy(*pair).agg(found.alias("n_found"), F.collect_list(F.struct("h", "occ")).alias("found"))
    many = many.filter(F.col("n_found") >= F.col("n_windows") * coverage)
    theirs_of = ours.groupBy(*item).agg(F.map_from_entries(F.collect_list(F.struct("h", "item_occ"))).alias("places"))
    both = many.join(F.broadcast(theirs_of) if few else theirs_of, item)
    laid = F.transform("found", lambda f: F.struct(F.col("places")[f["h"]].alias("item_occ"), f["occ"].alias("occ")))
    pairs = both.select(ID, "item_id", "n_windows", F.least("n_found", "n_windows").alias("n_found"), laid.alias("hits"))
    judged = pairs.mapInArrow(_judge(coverage), f"{ID} long, item_id long, n_windows long, n_found long, slot_consistency double, same_values boolean")
    columns = [(F.col("n_found") / F.col("n_windows")).alias("coverage"), "slot_consistency", "same_values", "n_windows", "n_found"]
    best = judged.filter(F.col("slot_consistency") >= consistent).groupBy(ID, "item_id").agg(F.max(F.struct(*columns)).alias("best"))
    return best.select(ID, "item_id", "best.n_windows", "best.n_found", "best.coverage", "best.slot_consistency", "best.same_values")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have no benchmark item, with their columns; rows without an id stay."""
    return without(docs, contaminated(docs, benchmark), Scratch(docs.sparkSession, "contaminated"))
