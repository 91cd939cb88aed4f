"""Ranked lexical search by a tiered index: high-impact postings first, and a proof for each item that what is left can't matter.

A posting (term, document) has an impact: its part of the score but for the term's weight. The index keeps, for the terms that are asked for,
each document's postings. Its upper tiers hold the postings of the highest impact of each term: as many whole levels of impact as have a share
of the term's postings (``TIERS``), or all of a term that has few. A tier's *residual bound* of a term is the highest impact that it lacks.

Items are first ranked on the first tier: the sum over the postings there is a lower bound of a document's score, and with the residual bounds
of the item's other terms an upper one. The documents that lead there are scored from all their postings; the k-th best of these scores is the
item's threshold. If it is above what the residual bounds of all the item's terms add up to, no document that the tier doesn't know can be
among the best; those whose upper bound reaches the threshold are then scored from all their postings, which is exact. Items without such a
proof fall through to the next tier, and at last to all postings.

Items come in blocks of about ``ENTRIES`` terms; a block's terms, with their weights, cuts and bounds, are all that is broadcast or comes to the
driver, and their number doesn't depend on the input. Documents are scored where their postings lie, many at once, and a task gives at most k
rows for each item (and the candidates' ids, once the proof has a threshold).

Defined cases: a null text has no term; documents without a term count for nothing; documents without an id count in all statistics but aren't
ranked; rows that share an id are documents of their own; items without an id or a term find nothing, rows that repeat an item count once, the
terms of different texts of one item are taken together; equal scores go by id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ID, TEXT, Scratch, small, texts
from .top_products import Best

#: Parts of a score, in thousandths: 1.2 times 1000 in all, of which three quarters follow the document's length.
IMPACT, TERM, LENGTH, FIXED, RELATIVE = 1_000_000_000, 1000, 8, 25, 75
#: Shares of a term's postings that the upper tiers hold; a term with no more than ``FEW`` is in the first tier whole.
TIERS, FEW = (1 / 32, 1 / 4), 1024
#: Impacts are cut at multiples of this.
LEVEL = 1 << 14
#: Terms of items that are ranked together, about.
ENTRIES = 400_000
#: Bytes of a text whose words are held at once, but for a longer word.
PIECE = 1 << 20
#: Sums of documents and items that are held at once, and postings times items.
CELLS = 1 << 21
EXACT = 1 << 53
#: Letters, digits and what isn't ASCII stand; capitals of ASCII become small; the rest parts terms.
_FOLD = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256)).lower()


def term_counts(text: str, get=None) -> tuple[int, Counter]:
    """How many terms a text has, and how often each occurs: all, or those for which ``get`` gives a number."""
    raw = text.encode().translate(_FOLD)
    n, counts, at = 0, Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE) if len(raw) - at > PIECE else -1
        words = raw[at : end if end >= 0 else len(raw)].split()
        n += len(words)
        counts.update(map(get, words) if get else words)
        at = end if end >= 0 else len(raw)
    counts.pop(None, None)
    return n, counts


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id``, ``term`` and ``n``, how often the item has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                counts = term_counts(text.as_py())[1]
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["item_id", "term", "n"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).dropna().distinct()
    return rows.mapInArrow(run, "item_id long, term binary, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def postings_of(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``doc_id``, its number of terms ``n``, those of ``terms`` that it has (``terms``, by number) and how often (``tfs``); documents without any term are left out."""
    known = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for b in batches:
            ids, sizes, lists, times = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, counts = term_counts(text.as_py(), get)
                if n:
                    ids.append(i)
                    sizes.append(n)
                    lists.append(np.fromiter(counts.keys(), np.int32, len(counts)))
                    times.append(np.fromiter(counts.values(), np.int64, len(counts)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], names=[ID, "n", "terms", "tfs"])

    return texts(docs).mapInArrow(run, f"{ID} long, n long, terms array<int>, tfs array<long>")


class Items:
    """A block of items: by term, the items that have it and how much a unit of impact adds there. ``keep`` has the numbers of those still asked."""

    def __init__(self, n: int, term: np.ndarray, item: np.ndarray, gain: np.ndarray, n_terms: int) -> None:
        order = np.argsort(term, kind="stable")
        self.n, self.n_terms, self.term, self.item, self.gain = n, n_terms, term[order], item[order], gain[order]
        self.first = np.searchsorted(self.term, np.arange(n_terms + 1))

    def only(self, keep: np.ndarray) -> Items:
        ok = keep[self.item]
        return Items(self.n, self.term[ok], self.item[ok], self.gain[ok], self.n_terms)

    def sums(self, worth: np.ndarray) -> np.ndarray:
        """For each item the sum of its gains times ``worth`` of their terms, as whole numbers."""
        out = np.zeros(self.n, np.int64)
        np.add.at(out, self.item, self.gain * worth[self.term])
        return out

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, worth: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Sums over postings, documents x items; and of ``worth`` of the terms that were there."""
        sizes = self.first[term + 1] - self.first[term]
        row = np.repeat(np.arange(len(term)), sizes)
        at = self.first[term][row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        cell = doc[row] * self.n + self.item[at]
        gain = self.gain[at]

        def added(x: np.ndarray) -> np.ndarray:
            total = np.bincount(cell, x & 0xFFFFF, n_docs * self.n).astype(np.int64)  # in two parts, whose sums are exact
            return (total + (np.bincount(cell, x >> 20, n_docs * self.n).astype(np.int64) << 20)).reshape(n_docs, self.n)

        return added(gain * impact[row]), None if worth is None else added(gain * worth[term[row]])


def _impact(tf, n, n_docs: int, n_terms: int):
    """In whole numbers; of numpy arrays."""
    return IMPACT * tf // (TERM * tf + LENGTH * (FIXED + RELATIVE * n * n_docs // n_terms))


def _pieces(batch: pa.RecordBatch, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, slice]]:
    """Document (from 0), term and impact or frequency of the postings of some documents of a batch at a time."""
    lists, values = batch.column(2), batch.column(3)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    term, value = lists.flatten().to_numpy(), values.flatten().to_numpy()
    work = np.append(0, np.cumsum(items.first[term + 1] - items.first[term]))
    a = 0
    while a < batch.num_rows:
        begin = ends[a - 1] if a else 0
        z = min(batch.num_rows, a + max(1, CELLS // max(1, items.n)))
        z = max(a + 1, min(z, int(np.searchsorted(work[ends], work[begin] + CELLS, "right"))))
        end = ends[z - 1]
        yield np.repeat(np.arange(z - a), np.diff(ends[a:z], prepend=begin)), term[begin:end].astype(np.int64), value[begin:end].astype(np.int64), slice(a, z)
        a = z


def _ranked(rows: DataFrame, shared, k: int, whole: tuple[int, int] | None) -> DataFrame:
    """``item`` (its number), ``score`` and ``doc_id`` of each task's k best. ``whole`` (documents and terms of all): rows have frequencies, not impacts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        best = Best(items.n, k)
        for b in batches:
            ids, sizes = b.column(0).to_numpy(), b.column(1).to_numpy()
            for doc, term, value, part in _pieces(b, items):
                impact = value if whole is None else _impact(value, sizes[part][doc], *whole)
                scores = items.scores(doc, term, impact, part.stop - part.start, None)[0]
                least = np.maximum(best.least, 1)
                if len(scores) > k and np.count_nonzero(scores >= least) > 2 * k * items.n:
                    least = np.maximum(least, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
                row, item = np.nonzero(scores >= least)
                best.add(item, scores[row, item], ids[part][row])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.query, best.score, best.vec)], names=["item", "score", ID])

    found = rows.filter(f"{ID} is not null").mapInArrow(run, f"item long, score long, {ID} long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), ID))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def _candidates(tier: DataFrame, shared) -> DataFrame:
    """Ids of documents of a tier whose upper bound reaches the threshold of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, bound, rest, least = shared.value
        for b in batches:
            ids = b.column(0).to_numpy()
            for doc, term, impact, part in _pieces(b, items):
                low, seen = items.scores(doc, term, impact, part.stop - part.start, bound)
                hit = ((low > 0) & (low + (rest - seen) >= least)).any(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part][hit])], names=[ID])

    return tier.filter(f"{ID} is not null").mapInArrow(run, f"{ID} long").distinct()


def _cuts(postings: DataFrame, whole: tuple[int, int], n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """For each tier and term the least impact that it holds, and the residual bound."""
    one = postings.select("n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("n", F.col("p.terms").alias("t"), F.col("p.tfs").alias("tf"))
    impact = F.expr(f"{IMPACT} * tf div ({TERM} * tf + {LENGTH} * ({FIXED} + {RELATIVE} * n * {whole[0]} div {whole[1]}))")
    levels = one.withColumn("impact", impact).groupBy("t", F.expr(f"impact div {LEVEL}").alias("level")).agg(F.count("*").alias("n"), F.max("impact").alias("most"))
    down = Window.partitionBy("t").orderBy(F.desc("level"))
    above, all_ = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(Window.partitionBy("t"))
    levels = levels.select("t", "level", "most", above.alias("above"), all_.alias("df"), F.row_number().over(down).alias("place"))
    holds = [(F.col("place") == 1) | (F.col("above") <= F.greatest(F.lit(float(FEW)), F.col("df") * share)) for share in TIERS]
    cuts = levels.groupBy("t").agg(*(x for k, h in enumerate(holds) for x in (F.min(F.when(h, F.col("level"))).alias(f"cut{k}"), F.max(F.when(~h, F.col("most"))).alias(f"rest{k}"))))
    cut, rest = np.zeros((len(TIERS), n_terms), np.int64), np.zeros((len(TIERS), n_terms), np.int64)
    got = cuts.toArrow()  # a row for each of the block's terms
    t = got.column("t").to_numpy()
    for k in range(len(TIERS)):
        cut[k, t] = got.column(f"cut{k}").to_numpy() * LEVEL
        rest[k, t] = got.column(f"rest{k}").fill_null(0).to_numpy()
    return cut, rest


def _tiers(postings: DataFrame, cut: np.ndarray, whole: tuple[int, int], scratch: Scratch) -> list[DataFrame]:
    """The upper tiers, each with those of the tiers above it: documents with their postings of enough impact (``terms``, ``tfs`` for the impacts)."""
    spark = postings.sparkSession
    shared = spark.sparkContext.broadcast(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for b in batches:
            sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(b.num_rows), sizes)
            term = b.column(2).flatten().to_numpy()
            impact = _impact(b.column(3).flatten().to_numpy(), b.column(1).to_numpy()[doc], *whole)
            for k in range(len(cuts)):
                ok = impact >= cuts[k, term]
                left = np.bincount(doc[ok], minlength=b.num_rows)
                has = left > 0
                offsets = pa.array(np.append(0, np.cumsum(left[has])), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).filter(pa.array(has)), b.column(1).filter(pa.array(has)), pa.ListArray.from_arrays(offsets, pa.array(term[ok], pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(impact[ok], pa.int64())), pa.array(np.full(int(has.sum()), k, np.int32))],
                    names=[ID, "n", "terms", "tfs", "tier"],
                )

    path = scratch.path()
    postings.mapInArrow(run, f"{ID} long, n long, terms array<int>, tfs array<long>, tier int").write.partitionBy("tier").parquet(path)
    shared.destroy()
    return [spark.read.schema(postings.schema).parquet(f"{path}/tier={k}") for k in range(len(cut))]


def _block(docs: DataFrame, asked: pa.Table, k: int, scratch: Scratch, proofs: list | None) -> DataFrame | None:
    """The ranking of one block's items, or None if there is nothing to rank."""
    spark: SparkSession = docs.sparkSession
    sc = spark.sparkContext
    words = asked.column("term").combine_chunks().dictionary_encode()
    names, item = np.unique(asked.column("item_id").to_numpy(), return_inverse=True)
    terms, term = words.dictionary.to_pylist(), words.indices.to_numpy()
    postings = scratch.save(postings_of(docs, terms))
    n_docs, n_terms = postings.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    whole = (n_docs, n_terms)
    df = np.zeros(len(terms), np.int64)
    found = postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
    df[found.column("t").to_numpy()] = found.column("df").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    items = Items(len(names), term, item, weight[term] * asked.column("n").to_numpy(), len(terms))
    cut, rest = _cuts(postings, whole, len(terms))
    tiers = _tiers(postings, cut, whole, scratch)
    number = spark.createDataFrame([(i, int(x)) for i, x in enumerate(names)], "item long, item_id long")
    left, answers = np.ones(len(names), bool), []

    def answer(rows: DataFrame, keep: np.ndarray) -> None:
        shared = sc.broadcast(items.only(keep))
        best = scratch.save(_ranked(rows, shared, k, whole))
        answers.append(best.join(F.broadcast(number), "item").select("item_id", "rank", ID, "score"))
        shared.destroy()

    for tier, bound in zip(tiers, rest, strict=True):
        if not left.any():
            break
        here = items.only(left)
        shared = sc.broadcast(here)
        leading = scratch.save(_ranked(tier, shared, k, None).select(ID).distinct())
        kth = _ranked(postings.join(small(leading), ID, "left_semi"), shared, k, whole).filter(F.col("rank") == k).select("item", "score").toArrow()
        least = np.full(len(names), -1, np.int64)
        least[kth.column("item").to_numpy()] = kth.column("score").to_numpy()
        shared.destroy()
        scratch.drop(leading)
        unknown = here.sums(bound)
        proven = left & (least > unknown)
        if proven.any():
            shared = sc.broadcast((items.only(proven), bound, unknown, np.where(proven, least, np.iinfo(np.int64).max)))
            ids = scratch.save(_candidates(tier, shared))
            answer(postings.join(small(ids), ID, "left_semi"), proven)
            shared.destroy()
            left &= ~proven
        if proofs is not None:
            proofs.append((int(proven.sum()), int(left.sum())))
    if left.any():
        answer(postings, left)
    scratch.drop(postings)
    out = answers[0]
    for x in answers[1:]:
        out = out.unionByName(x)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text", proofs: list | None = None) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id``, ``rank``, ``doc_id``, ``score``. ``proofs`` gets, for each block and upper tier, how many items it has proven and how many fell through."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    asked = scratch.save(item_terms(items, item_id, item_text))
    blocks = -(-asked.count() // ENTRIES)
    out = None
    for n in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n).toArrow()  # one bounded block
        rows = _block(docs, own, k, scratch, proofs) if own.num_rows else None
        if rows is not None:
            out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], f"item_id long, rank int, {ID} long, score long") if out is None else out


def search_sql() -> str:
    terms = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
    with d as (select doc_id, {terms.format("text")} as ts from documents where text is not null),
    long as (select doc_id, len(ts)::bigint as n, ts from d where len(ts) > 0),
    whole as (select count(*)::bigint as docs, sum(n)::bigint as terms from long),
    q as (select item_id, t, count(*)::bigint as times from (select item_id, unnest({terms.format("text")}) as t from benchmark) group by all),
    p as (select doc_id, n, t, count(*)::bigint as tf from (select doc_id, n, unnest(ts) as t from long) where t in (select t from q) group by all),
    w as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from p, whole group by t, docs),
    s as (
        select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint as score
        from q join p using (t) join w using (t), whole group by all
    ), r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
    select item_id, rank::int as rank, doc_id, score from r where rank <= 10"""
