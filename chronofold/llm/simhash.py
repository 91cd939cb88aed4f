"""SimHash near-duplicates: fingerprints of word shingles, compared as bit planes.

Rows with equal fingerprints are one point. Points that link must agree in some bands of bits (pigeonhole: ``radius`` differing bits
can't touch every set of bands), so each point goes to one bucket for every choice of agreeing bands, and a bucket compares its points
bit-sliced: plane ``b`` holds bit ``b`` of all points, 64 to a word; a carry-save counter of bit vectors (three up to a radius of 7)
counts differing bits for all points at once and keeps "more than the radius" as its overflow; a block of queries is abandoned as soon as all its pairs have
overflowed. A bucket gives a spanning forest of its links, never the pairs. A bucket of more points than ``BLOCK`` is cut into blocks
and each pair of blocks is compared in a task of its own. The result is exact for every choice of bands.

Defined cases: a null or empty text, or white space only, has fingerprint 0, linked like any other; a null ``doc_id`` has a fingerprint
and links, its component's id is the smallest id that isn't null (null if there is none); repeated rows are one point; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import ID, Scratch, texts, without
from .components import components

BITS = 64
#: Points that one comparison holds on each side.
BLOCK = 2048
SEED = 42
#: Points that a bucket should hold on average at most; more bands are used until that is so.
BUCKET = 4096


#: Bytes of a text whose words are held at once, but for a single word that is longer.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(raw: bytes, size: int) -> Iterator[list[bytes]]:
    """A text's words in lists, each beginning with the last ``size - 1`` words of the one before, so that no shingle is lost or counted twice."""
    at, kept = 0, []
    while at < len(raw):
        end = at + PIECE
        end = m.start() if end < len(raw) and (m := _SPACE.search(raw, end)) else len(raw)
        words = kept + raw[at:end].split()
        yield words
        kept, at = words[-(size - 1) :] if size > 1 else [], end


def shingle_hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 of each run of ``size`` words; none if there are fewer."""
    if len(words) < size:
        return []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    return [xxh64_intdigest(line[a : z - 1], SEED) for a, z in zip([0, *ends], ends[size - 1 :], strict=False)]


def _bits(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _settled(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.packbits((ones * 2 > n).astype(np.uint8), axis=-1, bitorder="little").view("<u8").ravel()


def _long_print(raw: bytes, size: int) -> int:
    """A very long text's fingerprint, piece by piece."""
    ones, n, words = np.zeros(BITS, np.int64), 0, []
    for words in pieces(raw, size):
        if h := shingle_hashes(words, size):
            ones += _bits(h).sum(axis=0, dtype=np.int64)
            n += len(h)
    if not n and words:
        ones, n = _bits([xxh64_intdigest(b" ".join(words), SEED)])[0].astype(np.int64), 1
    return _settled(ones, np.int64(n))[0] if n else 0


def fingerprints_of(values: list[str | None], size: int = 4) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text's word shingles."""
    out = np.zeros(len(values), np.uint64)
    hashes: list[int] = []
    held: list[tuple[int, int]] = []  # which text, and where its hashes begin

    def settle() -> None:
        if held:
            starts = np.array([s for _, s in held])
            ones = np.add.reduceat(_bits(hashes), starts, axis=0, dtype=np.uint32)
            out[[k for k, _ in held]] = _settled(ones, np.diff(np.append(starts, len(hashes)))[:, None])
            hashes.clear()
            held.clear()

    for k, text in enumerate(values):
        raw = (text or "").encode().lower()  # bytes: ASCII letters and ASCII white space only
        if len(raw) > PIECE:
            out[k] = _long_print(raw, size)
            continue
        if not (words := raw.split()):
            continue
        held.append((k, len(hashes)))
        hashes += shingle_hashes(words, size) or [xxh64_intdigest(b" ".join(words), SEED)]
        if len(hashes) > 100_000:
            settle()
    settle()
    return out


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(b.column(1).to_pylist(), size).view(np.int64))], names=[ID, "fp"])

    return texts(docs).mapInArrow(run, f"{ID} long, fp long")


def planes(points: np.ndarray) -> np.ndarray:
    """Bit planes: row ``b`` has bit ``b`` of all points, 64 points to a word. A point is a word of 64 bits, or a row of several."""
    n, bits = len(points), 64 * (points.shape[1] if points.ndim > 1 else 1)
    out = np.zeros((-(-n // 64) * 64, bits), np.uint8)
    out[:n] = np.unpackbits(np.ascontiguousarray(points.astype("<u8")).view(np.uint8).reshape(n, bits // 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(out.T), axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, points: np.ndarray, radius: int, same: bool, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, point) at ``radius`` or fewer differing bits, by blocks of queries; with ``same``, both are one list and pairs are (i, j), i < j.

    The counter has as many bits as ``radius`` (three at least) and starts so that it overflows at ``radius + 1``.
    """
    table, n = planes(points), len(points)
    bits, digits = len(table), max(3, radius.bit_length())
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    start = [ones if (2**digits - 1 - radius) >> k & 1 else np.uint64(0) for k in range(digits)]
    full = np.zeros(table.shape[1] * 64, np.uint8)
    full[n:] = 1
    look = 4 if bits == 64 else 16  # planes between two looks at what has overflowed
    for first in range(0, len(queries), rows):
        block = queries[first : first + rows]
        at = first // 64 * 64 if same else 0  # points before the block's first query were its partners already
        part = table[:, at // 64 :]
        if same:
            index = np.arange(at, table.shape[1] * 64)
            out = (index[None, :] <= np.arange(first, first + len(block))[:, None]) | (index >= n)[None, :]
            over = np.packbits(out, axis=1, bitorder="little").view("<u8").copy()
        else:
            over = np.repeat(np.packbits(full, bitorder="little").view("<u8")[None, :], len(block), axis=0)
        alive = np.arange(len(block))
        counter = [np.full(over.shape, s) for s in start]
        flips = np.where(np.unpackbits(np.ascontiguousarray(block.astype("<u8")).view(np.uint8).reshape(len(block), bits // 8), axis=1, bitorder="little").astype(bool), ones, np.uint64(0))
        for b in range(bits):
            carry = part[b][None, :] ^ flips[alive, b][:, None]
            for digit in counter:
                rest = digit & carry
                digit ^= carry
                carry = rest
            over |= carry
            if b >= radius and b % look == look - 1:
                left = (over != ones).any(axis=1)
                if not left.any():
                    break
                if left.sum() * 2 < len(left):
                    alive, over, counter = alive[left], over[left], [x[left] for x in counter]
        else:
            q, p = np.nonzero(~np.unpackbits(over.view(np.uint8), axis=1, bitorder="little").astype(bool))
            yield alive[q] + first, p + at


def links_in(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between points of one block, or of two: fewer links than points, however many pairs there are."""
    both = left if right is None else np.concatenate([left, right])
    label, u, v = np.arange(len(both)), [], []
    for q, p in within(left, left if right is None else right, radius, right is None):
        p = p if right is None else p + len(left)
        cuts = [0, *(np.flatnonzero(q[1:] != q[:-1]) + 1).tolist(), len(q)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a == z:
                continue
            one, ends = q[a], p[a:z]
            other = ends[label[ends] != label[one]]
            while len(other):
                u.append(one)
                v.append(other[0])
                label[label == label[other[0]]] = label[one]
                other = other[label[other] != label[one]]
    return both[u], both[v]


def band_plan(n: int, radius: int) -> tuple[list[int], int]:
    """Masks of the bits that must agree, one for each choice of bands; how many bands agree. More bands for more points, all exact."""
    agree = 1
    while True:
        bands = radius + agree
        edges = np.linspace(0, BITS, bands + 1).round().astype(int)
        least = min(sum(edges[i + 1] - edges[i] for i in c) for c in combinations(range(bands), agree))
        if n >> int(least) <= BUCKET or agree == 6:
            break
        agree += 1
    band = [sum(1 << int(b) for b in range(edges[i], edges[i + 1])) for i in range(bands)]
    return [sum(band[i] for i in c) for c in combinations(range(bands), agree)], agree


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt(keyed: DataFrame, columns: list[str], scratch: Scratch, block: int | None = None) -> DataFrame:
    """Rows of buckets (``key``) for a comparison in Arrow, by bucket and pair of blocks: ``key``, ``i``, ``j``, ``b`` and ``columns``.

    A bucket of up to ``block`` (``BLOCK``) rows is one group. A larger one is cut into blocks by a hash of the first of ``columns``, and each pair of
    blocks (i <= j) is a group of its own, in which ``b`` tells a row's block. So no task holds more than two blocks of a bucket.
    """
    block = block or BLOCK
    sizes = keyed.groupBy("key").count()
    large = scratch.save(sizes.filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    n_large = large.count()  # at most rows / block of them
    crowd = keyed.join(F.broadcast(large) if n_large <= 100_000 else large, "key", "left") if n_large else keyed.withColumn("blocks", F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64(F.lit("block"), columns[0]), F.col("blocks")).cast("int")
    # (i, j), i <= j: the pair of blocks that a task compares; a point of block b takes part in each pair that has b
    pair = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j"), own.alias("b")))
    )
    out = crowd.withColumn("pair", F.explode(pair)).select("key", "pair.i", "pair.j", "pair.b", *columns)
    return out.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j", "b")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[list[np.ndarray]], list[list[np.ndarray]]]]:
    """From ``dealt`` rows, each group of two rows or more: whether it is one block with itself, and the columns of the rows of either block."""
    group, sides = None, None

    def ready() -> bool:
        return group is not None and sum(len(x) for x in sides[0][0] + sides[1][0]) > 1

    for b in batches:
        if not b.num_rows:
            continue
        keys = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]).astype(np.int64)
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4, b.num_columns)]
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if tuple(keys[a, :3]) != group:
                if ready():
                    yield group[1] == group[2], *sides
                group, sides = tuple(keys[a, :3]), tuple([[] for _ in columns] for _ in range(2))
            for held, column in zip(sides[int(keys[a, 3] != keys[a, 1])], columns, strict=True):
                held.append(column[a:z])
    if ready():
        yield group[1] == group[2], *sides


def fingerprint_links(points: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Links (``u``, ``v``) that join the distinct fingerprints ``fp`` of ``points`` as all links at ``radius`` or fewer bits do."""
    masks, _ = band_plan(points.count(), radius)
    keyed = points.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks]))).select("fp", F.xxhash64("pos", "col").alias("key"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for same, left, right in groups(batches):
            one, two = (np.concatenate([none, *x[0]]).view(np.uint64) for x in (left, right))
            u, v = links_in(one, None if same else two, radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return dealt(keyed, ["fp"], scratch).mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest ``doc_id`` reachable over links): one row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, size))
    points = scratch.save(prints.groupBy("fp").agg(F.min(ID).alias("first")))
    edges = scratch.save(fingerprint_links(points.select("fp"), radius, scratch).distinct())
    if edges.isEmpty():
        named = points.select("fp", F.col("first").alias("component_id"))
    else:
        named = component_ids(points, components(edges, scratch), "fp", scratch)
        scratch.drop(points)
    scratch.drop(edges)
    return prints.join(named, "fp").select(ID, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def component_ids(points: DataFrame, roots: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``key`` and ``component_id``, the smallest ``first`` of a point's component; a point without links is its own.

    Written table by table, so that Spark can split a component that holds very many points.
    """
    rooted = scratch.save(points.join(roots, F.col(key) == F.col("node"), "left").select(key, "first", F.coalesce("root", key).alias("root")))
    low = scratch.save(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = scratch.save(rooted.join(low, "root").select(key, "component_id"))
    scratch.drop(rooted, low)
    return named


def first_of_each(docs: DataFrame, radius: int = 4, size: int = 4) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is its component's smallest, with their columns; rows without an id, and rows that share that id, stay."""
    rest = near_duplicates(docs, radius, size).filter(F.col("component_id") != F.col(ID))
    return without(docs, rest, Scratch(docs.sparkSession, "copies"))
