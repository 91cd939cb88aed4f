"""SimHash near copies at a similarity: five-word shingles, Jaccard 0.8 or more, tested exactly.

The same operator as ``simhash`` for another contract. Shingle sets at similarity 0.8 have a cosine of 0.889 at least, so 15 % of the bits
of their SimHash fingerprints differ: 39 of ``BITS`` on average, 5.7 standard deviation. Fingerprints within ``RADIUS`` bits are compared
(4.8 deviations more: one in a million pairs at 0.8 exactly is further apart, and far fewer above), bit-sliced as in ``simhash``; each pair
that is near enough is then tested on the shingle sets themselves.

A radius of 66 bits leaves no band of bits that must agree, so points meet in buckets of minima: points that agree in one of ``BANDS``
bands of ``ROWS`` minima share a bucket; a pair at similarity s shares none with probability (1 - s^4)^24: 3 in a million at 0.8, less than
3 in 100 million from 0.85 on.

Texts that are equal are one point. A bucket's pairs aren't all tested. First every point of a bucket is tested with one of its points, native
and linear in the bucket; that point then leaves it. (``STARS`` may ask for more such rounds, with several points of random groups each.) Where a bucket then still has points that no links join, its points are compared by bit planes, block by block
(``BLOCK`` points, so that a task holds two blocks of sets); pairs that are near in bits and in no common group yet are tested there, and
only links that join groups come out, fewer than points. Pairs of one group add nothing to the components, so the result is that of all
pairs. Fingerprints and sets are computed for points that share a bucket only.

Defined cases: words and short texts as in ``simhash``; null and empty texts and white space only are copies of each other; null ids link
and stay; repeated rows are one point and stay together; other columns are kept whatever their names; an empty table gives no rows. Texts
are held whole, with one hash for each distinct shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ID, Scratch, small, texts, without
from .components import components
from .simhash import component_ids, dealt, groups, pieces, shingle_hashes, within

SIZE, LEAST = 5, 0.8
BANDS, ROWS = 24, 4
WORDS = 4
BITS, RADIUS = 64 * WORDS, 66
#: How many points of a bucket each round tests with all others; after these rounds, all points of different groups.
STARS = (1,)
BLOCK = 512
SEED = 42
_rng = np.random.default_rng(SEED)
_MUL, _ADD = _rng.integers(0, 2**64, (2, 1, BANDS * ROWS), dtype=np.uint64)
_MUL |= np.uint64(1)
PRINT = [f"f{k}" for k in range(WORDS)]


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Distinct hashes of a text's word shingles."""
    raw, parts, words = (text or "").encode().lower(), [], []
    for words in pieces(raw, size):
        parts.append(np.unique(np.array(shingle_hashes(words, size), np.uint64)))
    if not sum(map(len, parts)):
        return np.array([hash_of(words)] if words else [], np.uint64)
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def hash_of(words: list[bytes]) -> int:
    return shingle_hashes(words, len(words))[0]


def bands(h: np.ndarray) -> np.ndarray:
    """A hash of each band of minima, as signed longs."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for a in range(0, len(h), 2048):
        least = np.minimum(least, (h[a : a + 2048, None] * _MUL + _ADD).min(axis=0))
    out = np.zeros(BANDS, np.uint64)
    for row in (least >> np.uint64(20)).reshape(BANDS, ROWS).T:
        out = (out ^ row) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def print_of(h: np.ndarray) -> np.ndarray:
    """The ``BITS``-bit SimHash of a set of shingles, as ``WORDS`` signed longs; a bit is 1 if more than half of the shingles have it."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 255):  # so many can be added up in bytes
        x = h[a : a + 255]
        wide = np.stack([x, *((x ^ (x >> np.uint64(29))) * _MUL[0, k] for k in range(1, WORDS))], axis=1)
        wide[:, 1:] ^= wide[:, 1:] >> np.uint64(32)
        ones += np.unpackbits(wide.astype("<u8").view(np.uint8).reshape(len(x), BITS // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits((ones * 2 > len(h)).astype(np.uint8), bitorder="little").view("<i8")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t) for t in b.column(2).to_pylist()]
        lists = pa.array([bands(h).tolist() for h in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(h) for h in sets], pa.int32()), lists], names=["p", ID, "n", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t) for t in b.column(1).to_pylist()]
        prints = np.array([print_of(h) for h in sets], np.int64).reshape(len(sets), WORDS)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(prints[:, k]) for k in range(WORDS)), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["p", *PRINT, "set"])


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``least`` or more."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= (len(a) + len(b) - common) * least


def joined(one: list[np.ndarray], two: list[np.ndarray] | None, least: float) -> tuple[list[int], list[int]]:
    """Links that join the points of one block, or of two, as all pairs at ``least`` similarity do. Columns: point, size, root, prints, set."""
    both = one if two is None else [np.concatenate(c) for c in zip(one, two, strict=True)]
    point, size, sets = both[0], both[1], both[-1]
    label = np.unique(both[2], return_inverse=True)[1]
    bits = [np.stack(side[3:-1], axis=1).astype(np.int64).view(np.uint64) for side in ([one] if two is None else [one, two])]
    u, v = [], []
    for q, p in within(bits[0], bits[-1], RADIUS, two is None):
        p = p if two is None else p + len(one[0])
        fits = np.minimum(size[q], size[p]) >= np.maximum(size[q], size[p]) * least
        q, p = q[fits], p[fits]
        cuts = [0, *(np.flatnonzero(q[1:] != q[:-1]) + 1).tolist(), len(q)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a == z:
                continue
            x, ends = q[a], p[a:z]
            while len(ends := ends[label[ends] != label[x]]):
                y, ends = ends[0], ends[1:]
                if alike(sets[x], sets[y], least):
                    u.append(point[x])
                    v.append(point[y])
                    label[label == label[y]] = label[x]
    return u, v


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for same, left, right in groups(batches):
            if not left[0] or not same and not right[0]:
                continue
            u, v = joined([np.concatenate(c) for c in left], None if same else [np.concatenate(c) for c in right], least)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in (u, v)], names=["u", "v"])

    return run


def links(own: DataFrame, points: DataFrame, least: float, scratch: Scratch) -> DataFrame | None:
    """Links (``u``, ``v``) of points at ``least`` similarity or more that join them as all such links do; None without any."""
    keyed = points.select("p", "n", F.posexplode("bands").alias("band", "key")).select("p", "n", F.xxhash64("band", "key").alias("key"))
    several = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"))
    if several.isEmpty():
        return None
    shared = scratch.save(keyed.join(several, "key"))
    scratch.drop(several)
    # one row of each point: that of its smallest id, so that very many copies of a text don't meet in a task
    no_id = F.lit(-(1 << 63))
    meeting = small(scratch.save(points.select("p", F.coalesce("first", no_id).alias("at")).join(shared.select("p").distinct(), "p", "left_semi")))
    text = own.select(F.xxhash64("text").alias("p"), F.coalesce(ID, no_id).alias("at"), "text").join(meeting, ["p", "at"], "left_semi").select("p", "text").dropDuplicates(["p"])
    sets = scratch.save(text.mapInArrow(_sets, f"p long, {', '.join(f'{c} long' for c in PRINT)}, set array<long>"))
    columns = ["p", "n", "root", *PRINT]
    members = scratch.save(shared.join(sets.select("p", *PRINT), "p").withColumn("root", F.col("p")).select("key", *columns))
    scratch.drop(shared)

    bits = reduce(Column.__add__, [F.bit_count(F.col(f"l.{c}").bitwiseXOR(F.col(f"r.{c}"))) for c in PRINT])
    near = (F.col("l.root") != F.col("r.root")) & (F.least("l.n", "r.n") >= F.greatest("l.n", "r.n") * least) & (bits <= RADIUS)
    one, two = (sets.select(F.col("p").alias(c), F.col("set").alias(f"{c}_set")) for c in ("u", "v"))
    common = F.size(F.array_intersect("u_set", "v_set"))
    whole = F.size("u_set") + F.size("v_set") - common
    tested: list[DataFrame] = []
    found: list[DataFrame] = []
    for k, stars in enumerate(STARS):
        # points of random groups, so that those which nothing has joined yet take their turn
        picks = [F.min_by(F.struct(*columns), F.struct(F.xxhash64(F.lit(k), F.lit(i), "root"), F.xxhash64(F.lit(k), "p"))) for i in range(stars)]
        ends = [F.min("root").alias("lo"), F.max("root").alias("hi")]
        mixed = scratch.save(members.groupBy("key").agg(*ends, F.array_distinct(F.array(*picks)).alias("picks")).filter("lo < hi").select("key", "picks"))
        if mixed.isEmpty():
            break
        star = scratch.save(mixed.select("key", F.explode("picks").alias("s")).select("key", "s.*"))
        both = members.alias("l").join(star.alias("r"), "key").filter(near)
        pairs = both.select(F.least("l.p", "r.p").alias("u"), F.greatest("l.p", "r.p").alias("v")).distinct()
        for t in tested:
            pairs = pairs.join(t, ["u", "v"], "left_anti")
        pairs = scratch.save(pairs)
        tested.append(pairs)
        good = scratch.save(pairs.join(one, "u").join(two, "v").filter(common >= whole * least).select("u", "v"))
        if not good.isEmpty():
            found.append(good)
        # a star has met all others of its bucket
        some = members.join(mixed.select("key"), "key", "left_semi").join(star.select("key", "p"), ["key", "p"], "left_anti")
        if found:
            roots = components(reduce(DataFrame.unionByName, found), scratch).withColumnRenamed("root", "to")
            some = some.join(roots, F.col("p") == F.col("node"), "left").withColumn("root", F.coalesce("to", "root"))
        new = scratch.save(some.select("key", *columns))
        scratch.drop(members, mixed, star)
        members = new
    mixed = scratch.save(members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key"))
    if not mixed.isEmpty():
        rest = scratch.save(members.join(mixed, "key", "left_semi"))
        with_sets = rest.join(sets.select("p", "set"), "p")
        found.append(scratch.save(dealt(with_sets, [*columns, "set"], scratch, BLOCK).mapInArrow(_compare(least), "u long, v long")))
        scratch.drop(rest)
    scratch.drop(members, mixed, sets, *tested)
    return reduce(DataFrame.unionByName, found) if found else None


def near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``p`` (a hash of the text), ``doc_id``, ``component_id`` (smallest ``doc_id`` of the group of near copies): one row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "near")
    own = texts(docs)
    sketch = scratch.save(own.select(F.xxhash64("text").alias("p"), ID, "text").mapInArrow(_sketches, f"p long, {ID} long, n int, bands array<long>"))
    points = scratch.save(sketch.groupBy("p").agg(F.min(ID).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    edges = links(own, points, least, scratch)
    if edges is None:
        named = points.select("p", F.col("first").alias("component_id"))
    else:
        named = component_ids(points.select("p", "first"), components(edges, scratch), "p", scratch)
    return sketch.select("p", ID).join(named, "p")


def first_of_near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is the smallest of its group of near copies, with their columns; rows without an id stay."""
    return without(docs, near_copies(docs, least).filter(F.col("component_id") != F.col(ID)), Scratch(docs.sparkSession, "copies"))
