"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The input's id and text columns, wherever an operator takes documents.
ID, TEXT = "doc_id", "text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one; other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).cast("long").alias(ID), F.coalesce(F.col(text_col), F.lit("")).alias(TEXT))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor sees. Set here only where a local session has none, as in tests; a
    cluster without one is an error, as its machines wouldn't see each other's files.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="chronofold-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """The path of a folder in the shared one that no other call has; what is written there stays."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


class Scratch:
    """Tables in the shared folder that cut a plan's lineage; each survives the loss of executors.

    Tables that no later plan reads are dropped by their operator; the rest, which a result still reads, go when the driver ends.
    """

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.n = spark, 0
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        fs, at = self._at(self.root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}"

    def save(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads; others are left alone."""
        for df in tables:
            if path := getattr(df, "_scratch_path", None):
                fs, at = self._at(path)
                fs.delete(at, True)


#: Ids that are broadcast at most, 16 bytes each; more are joined with a shuffle, with the same result.
BROADCAST_IDS = 500_000


def small(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast if its size, which is checked here, allows."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def without(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs``, with their columns, whose ``doc_id`` isn't in ``ids``; rows without an id stay. Few ids spare the texts a shuffle."""
    return docs.join(small(scratch.save(ids.select(ID).distinct())), ID, "left_anti").select(*docs.columns)


#: Tasks that sum partitions' arrays before the last one.
FAN = 16
#: The longest word, in bytes, that a worker's cache keeps.
CACHED_BYTES = 64


_caches: dict[str, dict] = {}


def cache_of(name: str) -> dict:
    """This worker's cache of that name. Those of other operators, whose stages are over, are emptied: a worker holds one at a time."""
    for other, held in _caches.items():
        if other != name and held:
            held.clear()
    return _caches.setdefault(name, {})


def looked_up(known: dict, words: list[bytes], make: Callable[[list[bytes]], Iterable], most: int) -> list:
    """The value of each word: from ``known``, or by ``make`` for the distinct words that it lacks.

    Words of up to ``CACHED_BYTES`` are remembered, at most ``most`` of them; then the cache starts anew. So its memory is bounded in bytes,
    however long unbroken words are.
    """
    new = list(set(words).difference(known))
    if not new:
        return list(map(known.__getitem__, words))
    made = dict(zip(new, make(new), strict=True))
    short = made if max(map(len, new)) <= CACHED_BYTES else {w: x for w, x in made.items() if len(w) <= CACHED_BYTES}
    if len(known) + len(short) > most:
        made |= {w: known[w] for w in set(words).difference(made)}
        known.clear()
        if len(short) <= most:
            known.update(short)
        return list(map(made.__getitem__, words))
    known.update(short)
    if short is made:
        return list(map(known.__getitem__, words))
    return [made[w] if x is None else x for w, x in zip(words, map(known.get, words), strict=True)]


def summed(rows: DataFrame, make: Callable, wide: bool = False) -> np.ndarray | None:
    """The sum, over all rows, of the arrays that ``make(batch)`` gives for an Arrow batch; None without rows.

    Partitions are summed where they are, their sums in one task, in an order that doesn't depend on the tasks'; one array comes to the driver.
    With ``wide`` (for arrays of many numbers), ``FAN`` tasks sum some partitions' arrays each before.
    """

    def run(batches):
        yield from one((make(b) for b in batches if b.num_rows), None)

    def add(batches):
        sums = sorted((k, bytes(v)) for b in batches for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from one((np.frombuffer(v, float) for _, v in sums), -1)

    def one(arrays, part):
        total = None
        for a in arrays:
            total = a.astype(float) if total is None else total + a
        if total is not None:
            part = TaskContext.get().partitionId() if part is None else part
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    parted = rows.mapInArrow(run, "part int, sums binary")
    if wide:
        some = F.pmod("part", F.lit(FAN))
        parted = parted.repartition(FAN, some).mapInArrow(add, "part int, sums binary")
    got = parted.repartition(1).mapInArrow(add, "part int, sums binary").first()
    return np.frombuffer(got["sums"], float) if got else None


def parts(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str | Column = ID) -> Column:
    """Whether a row is in the fold that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce((F.crc32(c.cast("string").cast("binary")) % 5) == 0, F.lit(False))


def bounded_sample(labels: DataFrame, most: int, key: str = ID) -> DataFrame:
    """About ``most`` rows of ``labels`` (all if there are no more), the same ones in each run: those whose id hashes low enough."""
    n = labels.count()
    if n <= most:
        return labels
    return labels.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 32)) < int((1 << 32) * (most / n)))
