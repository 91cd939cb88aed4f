"""Homomorphic multiset fingerprints of documents.

A paragraph (text between line feeds) hashes to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, each lane
modulo a power of two. So the order of paragraphs doesn't matter, and a paragraph is inserted by adding its vector and deleted by
subtracting it. Two groups of lanes:

* ``EXACT`` lanes modulo 2**64, from BLAKE2b of the whole paragraph: equal multisets of paragraphs have equal lanes, others differ but
  for a collision.
* ``LANES`` lanes modulo 2**32: the sum, over the paragraph's runs of three words, of vectors of +1 and -1 hashed from the run. The
  squared length of a difference estimates in how many runs two documents differ, which gives their likeness. A lane only wraps once
  a text has 2**31 runs, more than a text can hold.

Defined cases: a null or empty text is one empty paragraph; the next document of the last is the first, so a table of one document is
its own next; rows with the same ``doc_id`` follow by their texts' hash, then text; rows with a null id come last in descending order;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, cache_of, looked_up, parts, texts

EXACT, LANES, RUN = 4, 128, 3
#: Words whose hashes a worker remembers; when full, it starts anew.
CACHE_WORDS = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_digest

    return np.frombuffer(b"".join(looked_up(cache_of("runs"), words, lambda new: map(xxh64_digest, new), CACHE_WORDS)), "<u8")


def _ones(bits: np.ndarray) -> np.ndarray:
    """Set bits in each column; runs of 255 rows can be added up in bytes."""
    m = len(bits) // 255 * 255
    out = bits[m:].sum(axis=0, dtype=np.uint8).astype(np.int64)
    return out + bits[:m].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) if m else out


class Fingerprint:
    """A sum of paragraphs' vectors."""

    __slots__ = ("exact", "lanes")

    def __init__(self, exact: np.ndarray | None = None, lanes: np.ndarray | None = None) -> None:
        self.exact = np.zeros(EXACT, np.uint64) if exact is None else exact
        self.lanes = np.zeros(LANES, np.uint32) if lanes is None else lanes

    @classmethod
    def of(cls, paragraphs: list[bytes]) -> Fingerprint:
        digests = b"".join(hashlib.blake2b(p, digest_size=8 * EXACT).digest() for p in paragraphs)
        out = cls(np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(axis=0, dtype=np.uint64))
        split = [p.split() for p in paragraphs]
        counts = np.array([len(w) for w in split])
        words = [w for ws in split for w in ws]
        step = 1 << 16
        if not words:
            return out
        ends = np.repeat(np.cumsum(counts), counts)
        h = np.concatenate([_word_hashes(words), np.zeros(RUN, np.uint64)])
        at = np.arange(len(words))
        left = ends - at  # words to the paragraph's end
        x = np.zeros(len(words), np.uint64)
        for k in range(RUN):
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + np.where(left > k, h[k : k + len(words)], np.uint64(k)))
        first = np.append(True, ends[1:] != ends[:-1])
        x = x[(left >= RUN) | first]
        for a in range(0, len(x), step):
            y = x[a : a + step]
            wide = np.stack([_mix(y + np.uint64((0xD1B54A32D192ED03 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)) for k in range(LANES // 64)], axis=1)
            ones = _ones(np.unpackbits(wide.astype("<u8").view(np.uint8).reshape(len(y), -1), axis=1, bitorder="little"))
            out.lanes += (2 * ones - len(y)).astype(np.uint32)
        return out

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.lanes + other.lanes)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, self.lanes - other.lanes)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.exact == other.exact).all() and (self.lanes == other.lanes).all())

    __hash__ = None

    def hex(self) -> str:
        return self.exact.astype("<u8").tobytes().hex() + self.lanes.astype("<u4").tobytes().hex()

    @classmethod
    def from_hex(cls, s: str) -> Fingerprint:
        raw = bytes.fromhex(s)
        return cls(np.frombuffer(raw[: 8 * EXACT], "<u8").copy(), np.frombuffer(raw[8 * EXACT :], "<u4").copy())

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, about the shared part of the runs of words otherwise, 0 for nothing in common."""
        if self == other:
            return 1.0
        a, b, d = (x.view(np.int32).astype(float) for x in (self.lanes, other.lanes, self.lanes - other.lanes))
        size = a @ a + b @ b
        return float(min(1.0, max(0.0, 1 - (d @ d) / size))) if size else 0.0


def paragraphs(text: str) -> list[bytes]:
    return text.encode().split(b"\n")


def edited(text: str, after: str) -> tuple[str, list[bytes], list[bytes]]:
    """``text`` with its last third replaced by the beginning of ``after``; the paragraphs that this deletes and inserts."""
    n = len(text)
    cut = n - n // 3
    head = text.rfind("\n", 0, cut) + 1
    tail = after[: n // 3]
    return text[:cut] + tail, paragraphs(text[head:]), paragraphs(text[head:cut] + tail)


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` dealt into ascending ranges of ``doc_id``, sorted within each, and before each range's rows the row that precedes it (that
    of the first range is the last of all), marked ``lead``. One shuffle of the texts; before it, a pass over the ids finds the ranges and one finds their last rows.
    """
    from pyspark.ml.feature import Bucketizer  # here, as workers needn't import it

    spark, n = docs.sparkSession, parts(docs.sparkSession)
    docs = texts(docs).withColumn("mix", F.xxhash64(TEXT)).withColumn("place", F.coalesce(F.col(ID).cast("double"), F.lit(float("-inf"))))
    cuts = docs.select(F.percentile_approx(ID, [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    splits = [float("-inf"), *sorted({float(x) for x in cuts or [0]}), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="place", outputCol="range", handleInvalid="keep").transform(docs).withColumn("range", F.col("range").cast("int")).drop("place")
    # one row for each range: its last row, and where the next rows are
    last = dict(dealt.groupBy("range").agg(F.max(F.struct(F.coalesce(F.col(ID), F.lit(-(1 << 63))).alias("id"), F.col(ID).isNotNull().alias("has"), "mix")).alias("last")).collect())
    ranges = sorted(last)
    rows = [(r, last[r]["id"] if last[r]["has"] else None, last[r]["mix"], ranges[(k + 1) % len(ranges)]) for k, r in enumerate(ranges)]
    ends = spark.createDataFrame(rows, "range int, end_id long, end_mix long, following int")
    own = F.struct(F.col("range").alias("part"), F.lit(False).alias("lead"))
    to = F.when(F.col(ID).eqNullSafe(F.col("end_id")) & (F.col("mix") == F.col("end_mix")), F.array(own, F.struct(F.col("following").alias("part"), F.lit(True).alias("lead")))).otherwise(F.array(own))
    order = ["part", F.desc("lead"), F.col(ID).asc_nulls_first(), "mix", TEXT]
    return dealt.join(F.broadcast(ends), "range").select(ID, TEXT, "mix", F.explode(to).alias("to")).select("to.part", "to.lead", ID, TEXT, "mix").repartitionById(n, F.col("part")).sortWithinPartitions(*order).select("part", "lead", ID, TEXT)


SCHEMA = f"{ID} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long"


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and likenesses; the edited text's comes from the document's by deleting and inserting paragraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = before = prints = None
        for b in batches:
            rows = []
            for p, lead, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    part, before, prints = p, None, None
                own = Fingerprint.of(lines := paragraphs(text))
                if not lead:
                    new, gone, come = edited(text, before)
                    after = own - Fingerprint.of(gone) + Fingerprint.of(come)
                    rows.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own.hex(), after.hex(), own.likeness(after), own.likeness(prints), len(lines)))
                before, prints = text, own
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

    return in_order(docs).mapInArrow(run, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` of each document, without order or shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([Fingerprint.of(paragraphs(t)).hex() for t in b.column(1).to_pylist()], pa.string())], names=[ID, "fingerprint"])

    return texts(docs).mapInArrow(run, f"{ID} long, fingerprint string")
