"""Token-ID output: each document's ids compressed by themselves under one shared zstandard dictionary.

File format. A folder with two Parquet tables that Spark's own committer writes, so a lost executor or a repeated task leaves no half
file:

``dictionary``  one row: ``dict_hash`` (first 16 hex digits of the dictionary's SHA-256, empty if there is none), ``dictionary``.
``segments``    rows of about ``SEGMENT_BYTES``, in ascending order of documents within a shard and over the shards: ``shard``,
                ``segment``, ``dict_hash``, ``first_token`` (ids of the shard before this row), ``n_tokens``, ``blob`` (zstandard frames
                of little-endian unsigned 32-bit ids, one for each document) and the offset index, arrays with an entry for each
                document: ``doc_ids``, ``doc_tokens``, ``offsets`` (of the frame in ``blob``; one entry more, the end).

A short document is read by its segment's row (Parquet's statistics of ``min_doc`` and ``max_doc`` leave out the others), one slice of
``blob`` and one small frame.

Defined cases: a null or empty text has the end id alone; a null ``doc_id`` sorts first; rows with the same id follow by their texts'
hash, then text; an empty table gives an empty folder and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ID, TEXT, cache_of, looked_up, new_folder, parts, texts

END_ID = 1
SEGMENT_BYTES = 4 << 20
#: The dictionary is trained on at most so many documents, each of at most so many characters (it serves short documents). A document
#: that isn't among them is encoded just as well: training decides on sizes, never on content.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 8000, 64 << 10
#: Words of up to ``common.CACHED_BYTES`` that a worker remembers the ids of; when full, it starts anew.
CACHE_WORDS = 350_000

SEGMENTS = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("segment", T.LongType()),
        T.StructField("dict_hash", T.StringType()),
        T.StructField("min_doc", T.LongType()),
        T.StructField("max_doc", T.LongType()),
        T.StructField("first_token", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("blob", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_tokens", T.ArrayType(T.LongType())),
        T.StructField("offsets", T.ArrayType(T.LongType())),
    ]
)


class WordEncoder:
    """Whole texts to ids, the same ids as the tokenizer gives for the text at once, with each distinct word encoded once.

    It holds for tokenizers that drop white space before anything else looks at the words, as the lower-case word BPE does. Words are
    cut at ASCII white space, and between an ASCII letter and ASCII punctuation other than an apostrophe, where its pattern always cuts.
    Texts with the marks of special tokens are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.name = f"ids {path}"
        self.cut = re.compile(rb"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])").sub
        self.model = self.tokenizer.model
        probe = ("a", "z", "word", "internationalisation", "qxzjvk")
        self.plain = all([t.id for t in self.model.tokenize(w)] == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without the end id."""
        raw = text.encode()
        if b"<|" in raw:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(looked_up(cache_of(self.name), self.cut(b" ", raw.lower()).split(), self.learn, CACHE_WORDS))

    def learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of words. A word of ASCII letters is one piece to the tokenizer's pattern and goes to its model at once."""
        model, out, rest = self.model.tokenize, [], []
        for w in words:
            if self.plain and w.isalpha():
                out.append(array("I", [t.id for t in model(w.decode())]).tobytes())
            else:
                rest.append(len(out))
                out.append(b"")
        for at in range(0, len(rest), 2000):
            some = [words[k].decode() for k in rest[at : at + 2000]]
            starts = np.cumsum([0, *(len(w) + 1 for w in some)])
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, offsets = array("I", found.ids).tobytes(), found.offsets
            cuts = (4 * np.searchsorted(np.fromiter(map(itemgetter(0), offsets), np.int64, len(offsets)), starts)).tolist()
            for k, a, z in zip(rest[at : at + 2000], cuts[:-1], cuts[1:], strict=True):
                out[k] = ids[a:z]
        return out


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker; its cache of words outlives a task, but not the stage (``common.cache_of``)."""
    return WordEncoder(path)


def train_dictionary(docs: DataFrame, tokenizer: str, size: int = DICTIONARY_BYTES) -> bytes:
    """The shared dictionary; empty where there are too few samples to train one."""
    docs = texts(docs)
    mix = F.xxhash64(F.lit("dictionary"), F.col(ID))
    cut = docs.select(mix.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if cut is None:
        return b""
    few = docs.filter((mix <= cut) & (F.length(TEXT) <= SAMPLE_CHARS)).select(TEXT).limit(2 * SAMPLE_DOCS).collect()
    words = encoder(tokenizer)
    samples = sorted(x for r in few if (x := words.encode(r[0])))
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()[:16] if dictionary else ""


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, dictionary: bytes | None = None, level: int = 3) -> str:
    """Encode ``docs`` and write them to the folder ``path``; returns the path.

    Ranges of ``doc_id`` are shards, so one shuffle of the texts puts them in order; encoding follows it, and only a segment is held at
    once.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer) if dictionary is None else dictionary
    tag = dictionary_hash(dictionary)
    spark.createDataFrame([(tag, dictionary)], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, shard = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        ids, sizes, frames, held, segment, before = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, frames)]).tolist()
            known = [x for x in ids if x is not None] or [None]
            values = [shard, segment, tag, min(known), max(known), before, sum(sizes), b"".join(frames), list(ids), list(sizes), offsets]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, KINDS, strict=True)], names=SEGMENTS.names)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = words.encode(text.as_py()) + end
                ids.append(doc_id)
                sizes.append(len(raw) // 4)
                frames.append(packer.compress(raw))
                held += len(frames[-1]) + 24
                if held >= SEGMENT_BYTES:
                    yield row()
                    before += sum(sizes)
                    segment += 1
                    ids, sizes, frames, held = [], [], [], 0
        if ids:
            yield row()

    mix = F.xxhash64(TEXT)
    (
        texts(docs)
        .repartitionByRange(parts(spark), F.col(ID).asc_nulls_first(), mix.asc())
        .sortWithinPartitions(F.col(ID).asc_nulls_first(), mix, TEXT)
        .mapInArrow(encode, SEGMENTS)
        .write.parquet(f"{path}/segments")
    )
    return path


#: Arrow's types of SEGMENTS.
KINDS = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.binary(), *[pa.list_(pa.int64())] * 3]


def load_dictionary(spark: SparkSession, path: str) -> bytes:
    """The folder's dictionary, checked against its hash."""
    tag, dictionary = spark.read.schema("dict_hash string, dictionary binary").parquet(f"{path}/dictionary").first()
    dictionary = bytes(dictionary or b"")
    if dictionary_hash(dictionary) != tag:
        raise ValueError(f"the dictionary in {path} isn't the one that its hash names")
    return dictionary


def _decoder(dictionary: bytes, tag: str):
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def frames(blob: bytes, offsets: list[int], dict_hash: str):
        if dict_hash != tag:
            raise ValueError(f"a segment asks for dictionary {dict_hash!r}; the folder has {tag!r}")
        view = memoryview(blob)
        for a, z in zip(offsets[:-1], offsets[1:], strict=True):
            yield unpack.decompress(view[a:z])

    return frames


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments")


def read_token_index(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Read the files back: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32``, ``n_bytes`` (of the frame), ``dict_hash``; ``ids`` if asked for."""
    dictionary = load_dictionary(spark, path)
    tag = dictionary_hash(dictionary)
    segments = read_segments(spark, path)
    fields = [("shard", T.LongType()), ("at", T.LongType()), (ID, T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()), ("n_bytes", T.LongType()), ("dict_hash", T.StringType())]
    schema = T.StructType([T.StructField(*f) for f in fields] + ([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = _decoder(dictionary, tag)
        for b in batches:
            for r in range(b.num_rows):
                shard, dict_hash, at, blob, ids, sizes, offsets = (b.column(k)[r].as_py() for k in range(7))
                crcs, lists = [], []
                for raw in frames(blob, offsets, dict_hash):
                    crcs.append(zlib.crc32(raw))
                    if with_ids:
                        lists.append(np.frombuffer(raw, "<u4").astype(np.int64))
                n = len(ids)
                cols = [pa.array([shard] * n, pa.int64()), pa.array(at + np.cumsum([0, *sizes[:-1]], dtype=np.int64)), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array([dict_hash] * n, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(lists, pa.list_(pa.int64()))] if with_ids else []), names=schema.names)

    rows = segments.select("shard", "dict_hash", "first_token", "blob", "doc_ids", "doc_tokens", "offsets").mapInArrow(decode, schema)
    # one row for each shard, of which there are as many as partitions; a running sum over them gives where each begins
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(starts), "shard").select(ID, (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "n_bytes", "dict_hash", *(["ids"] if with_ids else []))


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """One document's ids by the offset index: one segment's row is read and one frame is unpacked."""
    at = F.array_position("doc_ids", F.lit(doc_id).cast("long"))
    row = (
        read_segments(spark, path)
        .filter((F.col("min_doc") <= doc_id) & (F.col("max_doc") >= doc_id) & (at > 0))
        .select("dict_hash", F.substring(F.col("blob"), F.element_at("offsets", at.cast("int")).cast("int") + 1, (F.element_at("offsets", at.cast("int") + 1) - F.element_at("offsets", at.cast("int"))).cast("int")).alias("frame"))
        .first()
    )
    if row is None:
        return None
    dictionary = load_dictionary(spark, path)
    frame = bytes(row["frame"])
    return np.frombuffer(next(_decoder(dictionary, dictionary_hash(dictionary))(frame, [0, len(frame)], row["dict_hash"])), "<u4").tolist()


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` to ``path`` (by default a new folder in the shared one, which stays) and read the index back from the files."""
    spark = docs.sparkSession
    path = write_token_files(docs, path or new_folder(spark, "tokens"), tokenizer)
    return read_token_index(spark, path)
