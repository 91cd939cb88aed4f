"""Exact top-k search by inner product: vectors in buckets of similar length, each pruned by length or by coordinate, products verified.

The vectors are sorted by length, longest first, and read in buckets of ``BUCKET`` neighbours. For a query ``q`` with the k-th best score ``t``
so far, a vector ``p`` of a bucket whose longest vector has length ``l`` can only enter if the cosine of the two is ``t / (|q| l)`` or more: the
bucket's local threshold. By that threshold each bucket chooses for each query:

* above 1: the bucket is skipped, and so are all shorter ones;
* *length*: only the bucket's head, of vectors with ``|p| >= t / |q|``, is multiplied;
* *coordinate*: a cosine of ``c`` or more confines each coordinate of ``p / |p|`` to an interval around that of ``q / |q|``; sorted lists of the
  coordinates give those in the interval, of which the narrowest of ``FOCUS`` is taken. It is chosen where a sample of the bucket tells that so
  few vectors are left that looking them up is cheaper than multiplying the head.

What is left is verified by its exact product. Intervals have a margin for rounding, so pruning never loses a vector.

Queries come in blocks of about ``BLOCK_NUMBERS`` numbers (by a hash), each of which reads all vectors once, in parallel: a block is the only thing
that is broadcast, and its size doesn't depend on the input. Before, one task compares the block with the longest vectors, which gives every
task a first threshold. A task keeps k rows for each query; these meet in a ranking by query.

Defined cases: a component ``x`` becomes floor(1024 x), held to 64 bits; vectors that are null or have null or non-finite components, and rows
without an id, take no part; a shorter vector counts as filled with zeros; rows that repeat an id and its vector count once; rows of one id with
different vectors are candidates each, never of a query of that id, and each of them is a query of its own (so ranks of that id repeat);
scores are held to 64 bits; ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parts

SCALE = 1024
#: Vectors of a bucket, and numbers in it at most.
BUCKET, BUCKET_NUMBERS = 4096, 1 << 22
#: Numbers of the queries that one pass over the vectors answers, about.
BLOCK_NUMBERS = 1 << 21
#: Products that are held at once.
TILE = 1 << 21
#: Coordinates of a query (its largest ones) that may be looked up.
FOCUS = 4
#: Vectors of a bucket that tell how many are in an interval.
PROBE = 128
#: Looking up costs as much as multiplying ``LOOKUP`` vectors for each that is found, and ``LOOKUPS`` besides.
LOOKUP, LOOKUPS = 8, 1024
#: Queries that must choose it before a bucket sorts its coordinates.
SORTING = 16
#: For rounding in cosines, relative to 1.
SLACK = 1e-9
#: Sums of products of floating numbers are exact below.
EXACT = float(1 << 53)
ROWS = "place long, query_id long, score long, vec_id long"


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``v`` (whole numbers) and ``norm2`` of the rows that take part, repeated ones once."""
    x = F.col(vector_col)
    sound = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-(2.0**63))), F.lit(2.0**63 - 1024))).cast("long"))
    rows = vectors.filter(sound).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return rows.withColumn("norm2", squares).dropDuplicates(["vec_id", "v"])


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """The lists as rows of whole numbers, short ones filled with zeros."""
    lists = lists.combine_chunks() if lists.num_chunks != 1 else lists.chunk(0)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    width = max(int(sizes.max(initial=0)), 1)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m.astype(float), m.astype(float)))


def _product(a: np.ndarray, b: np.ndarray) -> int:
    return max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))))


class Best:
    """The k best rows so far of each query: scores down, then ids up. ``start`` has a score for each that k rows are known to reach."""

    def __init__(self, n: int, k: int, start: np.ndarray | None = None) -> None:
        self.k, self.least = k, np.full(n, -np.inf) if start is None else start.astype(float)
        self.query, self.score, self.vec = (np.empty(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        if not len(query):
            return
        q, s, v = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.vec, vec)))
        order = np.lexsort((v, ~s, q))  # ~s falls as s rises, without overflow
        q, s, v = q[order], s[order], v[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = rank == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])
        keep = rank < self.k
        self.query, self.score, self.vec = q[keep], s[keep], v[keep]


class Search:
    """A block of queries against buckets of vectors; ``seen`` counts vectors that were skipped, multiplied and looked up."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, start: np.ndarray | None = None) -> None:
        self.ids, self.v, self.norm = ids, vectors, _lengths(vectors)
        self.unit = vectors / np.where(self.norm > 0, self.norm, 1.0)[:, None]
        self.best = Best(len(ids), k, start)
        self.seen = {"skipped": 0, "multiplied": 0, "looked up": 0}

    def bucket(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        width = min(self.v.shape[1], vectors.shape[1])  # a component that one of two vectors lacks adds nothing
        norm = _lengths(vectors)
        order = np.argsort(-norm, kind="stable")
        ids, vectors, norm = ids[order], vectors[order, :width], norm[order]
        q = self.v[:, :width]
        if max(norm[0], 1.0) * max(self.norm.max(), 1.0) >= EXACT:
            for k in range(len(ids)):
                self._take(np.arange(len(q)), np.array([_product(x, vectors[k]) for x in q], np.int64), np.full(len(q), ids[k]))
            return
        p = np.ascontiguousarray(vectors, dtype=float)
        least = self.best.least
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(self.norm > 0, least / self.norm, np.where(least > 0, np.inf, -np.inf))  # the length that a vector needs
            cosine = np.where(need <= 0, -1.0, need / norm[0])
        live = np.flatnonzero(cosine <= 1 + SLACK)
        self.seen["skipped"] += len(ids) * (len(self.ids) - len(live))
        head = np.where(need[live] > 0, np.searchsorted(-norm, -need[live] * (1 - SLACK), side="right"), len(ids))
        found = self._by_coordinate(ids, p, norm, live, cosine[live], head, width)
        live, head = live[~found], head[~found]
        order = np.argsort(head, kind="stable")
        live, head = live[order], head[order]
        step = max(1, TILE // len(ids))
        for a in range(0, len(live), step):
            self._by_length(ids, p, live[a : a + step], int(head[a : a + step].max()), width)

    def _by_length(self, ids: np.ndarray, p: np.ndarray, some: np.ndarray, most: int, width: int) -> None:
        scores = self.v[some, :width].astype(float) @ p[:most].T
        self.seen["multiplied"] += scores.size
        own = np.flatnonzero(np.isin(ids[:most], self.ids[some]))
        scores[:, own] = np.where(ids[own] == self.ids[some][:, None], -np.inf, scores[:, own])
        least = self.best.least[some]
        k = self.best.k
        if most > k and np.count_nonzero(scores >= least[:, None]) > 2 * k * len(some):
            least = np.maximum(least, np.partition(scores, most - k, axis=1)[:, most - k])
        row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        self.best.add(some[row], scores[row, col].astype(np.int64), ids[col])

    def _take(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        ok = (score >= self.best.least[query]) & (self.ids[query] != vec)
        self.best.add(query[ok], score[ok], vec[ok])

    def _by_coordinate(self, ids: np.ndarray, p: np.ndarray, norm: np.ndarray, live: np.ndarray, cosine: np.ndarray, head: np.ndarray, width: int) -> np.ndarray:
        """Answer the queries for which that is cheaper; tells which of ``live`` those are."""
        none = np.zeros(len(live), bool)
        if norm[-1] <= 0 or len(live) < SORTING:
            return none
        unit = self.unit[live, :width]
        f = min(FOCUS, width)
        focus = np.argpartition(-np.abs(unit), f - 1, axis=1)[:, :f]
        low, high = interval(np.take_along_axis(unit, focus, 1), cosine[:, None])
        some = np.linspace(0, len(p) - 1, min(PROBE, len(p))).astype(int)
        sample = p[some] / norm[some][:, None]
        share = np.stack([((x := sample[:, focus[:, j]]) >= low[:, j]) & (x <= high[:, j]) for j in range(f)]).mean(axis=1)
        best = share.argmin(axis=0)
        chosen = share.min(axis=0) * len(p) * LOOKUP + LOOKUPS < head
        if chosen.sum() < SORTING:
            return none
        whole, lists = p / norm[:, None], {}
        for i in np.flatnonzero(chosen):
            c, j = focus[i, best[i]], best[i]
            if c not in lists:
                order = np.argsort(whole[:, c])
                lists[c] = order, whole[order, c]
            order, values = lists[c]
            near = order[np.searchsorted(values, low[i, j], "left") : np.searchsorted(values, high[i, j], "right")]
            for j in set(range(f)) - {best[i]}:  # the other large coordinates sift what is left
                x = whole[near, focus[i, j]]
                near = near[(x >= low[i, j]) & (x <= high[i, j])]
            self.seen["looked up"] += len(near)
            scores = p[near] @ self.v[live[i], :width].astype(float)
            self._take(np.full(len(near), live[i]), scores.astype(np.int64), ids[near])
        return chosen

    def rows(self) -> pa.RecordBatch:
        b = self.best
        return pa.RecordBatch.from_arrays([pa.array(b.query), pa.array(self.ids[b.query]), pa.array(b.score), pa.array(b.vec)], names=ROWS.replace(" long", "").split(", "))


def interval(q: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a coordinate of a unit vector can lie if its cosine with one of coordinate ``q`` is ``cosine`` or more."""
    c = np.clip(cosine, -1, 1)
    wide = np.sqrt(np.maximum(0, (1 - c * c) * (1 - q * q)))
    return np.where(q <= -c, -1.0, c * q - wide) - SLACK, np.where(q >= c, 1.0, c * q + wide) + SLACK


def _searched(rows: DataFrame, block, k: int) -> DataFrame:
    """Each task's best rows for the broadcast block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*block.value[:2], k, block.value[2])
        held, n, numbers = [], 0, 0

        def flush() -> None:
            m = pa.Table.from_batches(held)
            search.bucket(m.column(0).to_numpy(), _matrix(m.column(1)))
            held.clear()

        for b in batches:
            for a in range(0, b.num_rows, BUCKET):
                held.append(b.slice(a, BUCKET))
                n, numbers = n + held[-1].num_rows, numbers + held[-1].nbytes // 8
                if n >= BUCKET or numbers >= BUCKET_NUMBERS:
                    flush()
                    n = numbers = 0
        if held:
            flush()
        yield search.rows()

    return rows.select("vec_id", "v").mapInArrow(run, ROWS)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, k: int = 10, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest inner products of each query with all other rows: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``is_query`` (of the column ``vec_id``) tells the queries, by default those whose id is divisible by 100.
    """
    spark = vectors.sparkSession
    sc, scratch = spark.sparkContext, Scratch(spark, "products")
    is_query = F.col("vec_id") % 100 == 0 if is_query is None else is_query
    order = [F.desc("norm2"), F.asc("vec_id")]
    whole = whole_vectors(vectors, id_col, vector_col)
    rows = scratch.save(whole.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order))
    asked = rows.filter(is_query)
    numbers = asked.agg(F.sum(F.size("v") + 2)).first()[0] or 0
    blocks = -(-numbers // BLOCK_NUMBERS)
    longest = scratch.save(rows.orderBy(*order).limit(BUCKET).coalesce(1))
    answers = None
    for n in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == n).select("vec_id", "v").toArrow()  # one bounded block
        ids, v = own.column(0).to_numpy(), _matrix(own.column(1))
        first = sc.broadcast((ids, v, None))
        kth = _best(_searched(longest, first, k), k).filter(F.col("rank") == k).select("place", "score").toArrow()
        start = np.full(len(ids), -np.inf)
        start[kth.column(0).to_numpy()] = kth.column(1).to_numpy()
        block = sc.broadcast((ids, v, start))
        found = scratch.save(_best(_searched(rows, block, k), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
        answers = found if answers is None else answers.unionByName(found)
        first.destroy()
        block.destroy()
    scratch.drop(longest, rows)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if answers is None else answers


def top_products_sql() -> str:
    """The same rows for tables of vectors of one width without repeated ids."""
    return """
    with whole as (
        select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
        where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), parts as (
        select vec_id, unnest(v) as x, unnest(range(len(v))) as i from whole
    ), products as (
        select q.vec_id as query_id, p.vec_id, sum(q.x * p.x)::bigint as score
        from parts q join parts p on q.i = p.i and q.vec_id <> p.vec_id where q.vec_id % 100 = 0 group by all
    ), ranked as (
        select *, row_number() over (partition by query_id order by score desc, vec_id) as r from products
    )
    select query_id, r::int as rank, vec_id, score from ranked where r <= 10"""
