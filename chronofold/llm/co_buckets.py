"""A pair of tables in the same buckets: a two-phase external sort over shared storage.

**Phase one, map tasks.** Each task takes its rows as Arrow batches, holds at most ``RUN_BYTES`` of them, sorts these by bucket and key, and
spills them as one run: an Arrow file in the shared folder, in which each bucket is a segment of its own. What the task returns is an index
row for each segment (bucket, file, offset, length); the index is written, so neither a lost executor nor a repeated task changes it.

**Phase two, bucket tasks.** A task takes the index rows of its buckets and merges their segments through a heap: it holds one block of each
run, pops the block that ends first, takes from every run what sorts up to that end, and streams it into the bucket's one file. Its memory
is the blocks of ``FAN_IN`` runs, whatever the bucket's size; more runs than that are merged to longer runs first. The file appears under
its name only when it is whole, so a task that is tried again writes the same file again.

Lines whose key no sale has are told in the same merge: the bucket's sales, in the same order, are read beside it, a block at a time. What
none of them matches becomes one more sorted run; these runs, one a bucket, are merged to the strangers' bucket at the end. So no row is
shuffled or joined, and a key that a third of the rows have costs no more than its rows.

Keys are compared as bytes: each row's columns are encoded so that byte order is column order (nulls first, numbers by value with -0.0 as 0.0
and NaN last, strings by their UTF-8 bytes).

``co_bucket`` lays a pair of tables out in numbered starting files and rewrites them to common buckets. A starting file that already holds
exactly a bucket's rows stays. Which rows go from which file to which bucket is counted by Spark before anything moves.

Defined cases: a null key goes to bucket ``n + 1`` of either table, a line's key that no sale has to bucket ``n``; they join nothing. Repeated
rows are all kept. Buckets without rows have no file, so empty tables give no rows. All columns of the tables are kept, whatever their names;
a column of another kind than whole numbers, floating numbers, booleans, dates, timestamps, strings and binaries is an error.
"""

from __future__ import annotations

import contextlib
import hashlib
import heapq
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Scratch, new_folder, parts

#: Arrow bytes that a map task holds before it spills a run.
RUN_BYTES = 32 << 20
#: Rows of a segment's blocks; a merge holds one block of each run.
BLOCK_ROWS = 4096
#: Runs that one merge reads at once; more are merged in several passes.
FAN_IN = 128
#: Bytes of a segment that is read whole, and of such segments that are sorted together to one run.
SMALL, PACKED = 1 << 16, 1 << 18
#: Rows of a group in the final files.
GROUP_ROWS = 1 << 18
BUCKETS = 600
#: The column that carries a row's file number to the tasks; the table's columns follow by position, so their names don't matter.
TO = "file_no"
INDEX = "file_no long, run string, at long, size long, n long"
FILES = "file_no long, path string, n_rows long, ids_sha256 string"
#: What bucket tasks return: files, or segments of rows that belong to another file.
MERGED = f"{FILES}, run string, at long, size long, n long"


# --- keys as bytes -------------------------------------------------------------------------------------------------------------------


def _fixed(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """A byte for null or not, then eight big-endian bytes, for unsigned numbers."""
    out = np.zeros((len(values), 9), np.uint8)
    out[:, 0] = valid
    out[:, 1:] = np.where(valid, values, 0).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    valid = pc.is_valid(column).to_numpy(zero_copy_only=False)
    kind = column.type
    if pa.types.is_floating(kind):
        x = pc.fill_null(column.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) + 0.0  # -0.0 as 0.0
        bits = np.where(np.isnan(x), np.float64("nan"), x).view(np.int64)
        return _fixed(np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))).view(np.uint64), valid)
    if pa.types.is_timestamp(kind) or pa.types.is_date64(kind):
        column = column.cast(pa.int64())
    elif pa.types.is_date32(kind):
        column = column.cast(pa.int32())
    x = pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    return _fixed((x ^ np.int64(-(2**63))).view(np.uint64), valid)


def _bytes(column: pa.Array) -> pa.Array:
    """1, the bytes with 0 as 0 255, 0 0; a null is 0."""
    raw = pc.replace_substring(column.cast(pa.binary()), b"\x00", b"\x00\xff")
    return pc.fill_null(pc.binary_join_element_wise(b"\x01", raw, b"\x00\x00", b""), b"\x00")


def sort_keys(columns: Iterable[pa.Array]) -> pa.Array:
    """One binary a row; their byte order is the order of the columns from left to right."""
    done: list[pa.Array] = []
    fixed: list[np.ndarray] = []

    def flush() -> None:
        if fixed:
            wide = np.ascontiguousarray(np.concatenate(fixed, axis=1))
            done.append(pa.Array.from_buffers(pa.binary(wide.shape[1]), len(wide), [None, pa.py_buffer(wide)]).cast(pa.binary()))
            fixed.clear()

    for c in columns:
        kind = c.type
        if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
            flush()
            done.append(_bytes(c))
        elif pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind) or pa.types.is_temporal(kind):
            fixed.append(_numbers(c))
        else:
            raise TypeError(f"rows can't be sorted by a column of type {kind}")
    flush()
    return done[0] if len(done) == 1 else pc.binary_join_element_wise(*done, b"")


def _keys(rows: pa.RecordBatch, order: list[int]) -> pa.Array:
    return sort_keys(rows.column(k) for k in order)


# --- phase one: runs -----------------------------------------------------------------------------------------------------------------


def _storage(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and the path of a shared folder, in whatever store its address names."""
    return arrow_fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (arrow_fs.LocalFileSystem(), root)


def _segment(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        for a in range(0, rows.num_rows, BLOCK_ROWS):
            w.write_batch(rows.slice(a, BLOCK_ROWS))
    return sink.getvalue().to_pybytes()


def _spill(store: arrow_fs.FileSystem, folder: str, held: list[pa.RecordBatch], order: list[int]) -> Iterator[tuple]:
    """Write one sorted run of rows whose first column is the file number; yields its segments' index rows."""
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    rows = rows.take(pc.sort_indices(sort_keys([rows.column(0), *(rows.column(k + 1) for k in order)])))
    numbers = rows.column(0).to_numpy()
    rows = rows.select(list(range(1, rows.num_columns)))
    edges = np.flatnonzero(np.diff(numbers, prepend=numbers[0] - 1, append=numbers[-1] + 1))
    run, at, found = f"run-{uuid.uuid4().hex}", 0, []
    with store.open_output_stream(f"{folder}/{run}") as out:
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            blob = _segment(rows.slice(a, z - a))
            out.write(blob)
            found.append((int(numbers[a]), run, at, len(blob), int(z - a)))
            at += len(blob)
    yield from found


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def spill_runs(rows: DataFrame, folder: str, columns: list[str], order: list[str]) -> DataFrame:
    """The index of the sorted runs that map tasks write to ``folder``; ``rows`` has its file number, then what ``columns`` names."""
    at, kinds = [columns.index(c) for c in order], to_arrow_schema(StructType.fromDDL(INDEX))

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _storage(folder)
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= RUN_BYTES:
                yield _as_batch(list(_spill(store, path, held, at)), kinds)
                held, size = [], 0
        if held:
            yield _as_batch(list(_spill(store, path, held, at)), kinds)

    return rows.mapInArrow(spill, INDEX)


# --- phase two: merges ---------------------------------------------------------------------------------------------------------------


class _Files:
    """A store's files, the last few of them kept open: buckets of one task read the same runs."""

    def __init__(self, store: arrow_fs.FileSystem, most: int = 256) -> None:
        self.store, self.most, self.open = store, most, {}

    def read(self, path: str, at: int, size: int) -> pa.Buffer:
        file = self.open.pop(path, None) or self.store.open_input_file(path)
        self.open[path] = file  # the last one used
        if len(self.open) > self.most:
            self.open.pop(next(iter(self.open))).close()
        return file.read_buffer_at(size, at) if hasattr(file, "read_buffer_at") else pa.py_buffer(file.read_at(size, at))

    def stream(self, path: str, at: int) -> pa.NativeFile:
        file = self.store.open_input_file(path)
        file.seek(at)
        return file


class _Run:
    """Sorted rows of which one block is held: a segment, or some small segments that are read whole and sorted together."""

    def __init__(self, files: _Files, segments: list[tuple[str, int, int]], order: list[int]) -> None:
        self.order, self.file = order, None
        if len(segments) == 1 and segments[0][2] > SMALL:
            self.file = files.stream(*segments[0][:2])
            self.blocks = iter(pa.ipc.open_stream(self.file))
        else:
            rows = pa.Table.from_batches([b for s in segments for b in pa.ipc.open_stream(files.read(*s))]).combine_chunks().to_batches()[0]
            rows = rows.take(pc.sort_indices(_keys(rows, order))) if len(segments) > 1 else rows
            self.blocks = iter([rows.slice(a, BLOCK_ROWS) for a in range(0, rows.num_rows, BLOCK_ROWS)])
        self.next()

    def next(self) -> bool:
        self.block, self.at = next(self.blocks, None), 0
        if self.block is None:
            if self.file:
                self.file.close()
            return False
        self.keys = _keys(self.block, self.order).to_pylist()
        return True

    def upto(self, key: bytes) -> pa.RecordBatch | None:
        """What this block still has up to ``key``, which goes."""
        if self.block is None or self.at == len(self.keys) or self.keys[self.at] > key:
            return None
        a, self.at = self.at, bisect_right(self.keys, key, self.at)
        return self.block.slice(a, self.at - a)


def packed(segments: list[tuple[str, int, int]]) -> list[list[tuple[str, int, int]]]:
    """Segments as runs: a large one is a run, small ones are packed to ``PACKED`` bytes."""
    out, held = [[s] for s in segments if s[2] > SMALL], PACKED
    for s in segments:
        if s[2] <= SMALL:
            if held + s[2] > PACKED:
                out.append([])
                held = 0
            out[-1].append(s)
            held += s[2]
    return out


def merged(files: _Files, runs: list[list[tuple[str, int, int]]], order: list[int]) -> Iterator[pa.RecordBatch]:
    """All rows of the sorted runs in order, a block of each in memory."""
    held = [_Run(files, r, order) for r in runs]
    heap = [(r.keys[-1], k) for k, r in enumerate(held) if r.block is not None]
    heapq.heapify(heap)
    while heap:
        end, k = heap[0]
        taken = [x for r in held if (x := r.upto(end)) is not None]
        if taken:
            rows = taken[0] if len(taken) == 1 else pa.Table.from_batches(taken).combine_chunks().to_batches()[0]
            yield rows if len(taken) == 1 else rows.take(pc.sort_indices(_keys(rows, order)))
        if held[k].next():
            heapq.heapreplace(heap, (held[k].keys[-1], k))
        else:
            heapq.heappop(heap)


def _fewer(files: _Files, folder: str, runs: list[list[tuple[str, int, int]]], order: list[int]) -> list[list[tuple[str, int, int]]]:
    """Merge ``FAN_IN`` runs at a time to longer ones until so few are left."""
    while len(runs) > FAN_IN:
        longer = []
        for a in range(0, len(runs), FAN_IN):
            path, blocks = f"{folder}/run-{uuid.uuid4().hex}", merged(files, runs[a : a + FAN_IN], order)
            first = next(blocks)
            with files.store.open_output_stream(path) as out, pa.ipc.new_stream(out, first.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
                w.write_batch(first)
                for b in blocks:
                    w.write_batch(b)
            longer.append((path, 0, files.store.get_file_info(path).size))
        runs = packed(longer)
    return runs


def _ids(column: pa.Array) -> bytes:
    return b",".join(b"" if x is None else b"%d" % x for x in column.to_pylist())


class _Known:
    """Tells which of ever larger keys a sorted file has; one block of it is held."""

    def __init__(self, store: arrow_fs.FileSystem, path: str | None, key: str) -> None:
        self.blocks = iter(()) if path is None else pq.ParquetFile(store.open_input_file(path)).iter_batches(BLOCK_ROWS, columns=[key])
        self.now = None

    def has(self, keys: pa.Array) -> pa.Array:
        last, found = sort_keys([keys[-1:]])[0].as_py(), pa.array(np.zeros(len(keys), bool))
        while True:
            if self.now is None:
                block = next(self.blocks, None)
                if block is None:
                    return found
                self.now = block.column(0)
            if len(self.now):
                found = pc.or_(found, pc.is_in(keys, self.now))
                if sort_keys([self.now[-1:]])[0].as_py() >= last:
                    return found
            self.now = None


def merge_runs(index: DataFrame, runs: str, folder: str, prefix: str, like: DataFrame, order: list[str], key: str, strangers: int | None = None) -> DataFrame:
    """Merge each file number's segments into ``folder``/``prefix``-number.parquet; returns ``MERGED`` rows.

    ``ids_sha256`` is of the file's ``key`` values in their order, in decimal, comma-joined, nulls empty. With ``strangers``, ``index`` has a
    column ``known``: for numbers below that, rows whose key isn't in that file (or that have none) go to a run for the number ``strangers``.
    """
    schema, at = to_arrow_schema(like.schema), [like.columns.index(c) for c in order]
    kinds, key_at = to_arrow_schema(StructType.fromDDL(MERGED)), like.columns.index(key)

    def write(files: _Files, number: int, segments: list[tuple[str, int, int]], known: str | None) -> Iterator[tuple]:
        store, path = files.store, _storage(folder)[1]
        _, spilled = _storage(runs)
        name, staged, aside = f"{prefix}-{number:05d}.parquet", f"{spilled}/staged-{uuid.uuid4().hex}", f"run-{uuid.uuid4().hex}"
        digest, n, n_aside, held = hashlib.sha256(), 0, 0, 0
        file = stream = None
        group: list[pa.RecordBatch] = []
        sales = None if strangers is None or number >= strangers else _Known(store, known and _storage(known)[1], key)
        with contextlib.ExitStack() as opened:

            def flush() -> None:
                nonlocal file, held
                if file is None:
                    file = opened.enter_context(pq.ParquetWriter(opened.enter_context(store.open_output_stream(staged)), schema, compression="zstd", version="2.6"))
                file.write_table(pa.Table.from_batches(group, schema), row_group_size=GROUP_ROWS)
                group.clear()
                held = 0

            for b in merged(files, _fewer(files, spilled, packed(segments), at), at):
                if sales is not None:
                    ours = sales.has(b.column(key_at))
                    others = b.filter(pc.invert(ours))
                    if others.num_rows:
                        if stream is None:
                            stream = opened.enter_context(pa.ipc.new_stream(opened.enter_context(store.open_output_stream(f"{spilled}/{aside}")), b.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")))
                        stream.write_batch(others)
                        n_aside += others.num_rows
                        b = b.filter(ours)
                if b.num_rows:
                    digest.update((b"," if n else b"") + _ids(b.column(key_at)))
                    n, held = n + b.num_rows, held + b.nbytes
                    group.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema, strict=True)], schema=schema))
                    if held >= RUN_BYTES:
                        flush()
            if group:
                flush()
        if n:
            store.move(staged, f"{path}/{name}")
            yield number, f"{folder}/{name}", n, digest.hexdigest(), None, None, None, None
        if n_aside:
            yield strangers, None, None, None, aside, 0, store.get_file_info(f"{spilled}/{aside}").size, n_aside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, spilled = _storage(runs)
        files, number, known, segments = _Files(_storage(folder)[0]), None, None, []
        for b in batches:
            for no, name, start, size, _n, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if no != number and segments:
                    if done := list(write(files, number, segments, known)):
                        yield _as_batch(done, kinds)
                    segments = []
                number, known = no, own
                segments.append((f"{spilled}/{name}", start, size))
        if segments and (done := list(write(files, number, segments, known))):
            yield _as_batch(done, kinds)

    index = index if "known" in index.columns else index.withColumn("known", F.lit(None).cast("string"))
    return index.repartition(parts(index.sparkSession), "file_no").sortWithinPartitions("file_no", "run", "at").mapInArrow(run, MERGED)


# --- the two together ----------------------------------------------------------------------------------------------------------------


def _make(folder: str) -> None:
    store, path = _storage(folder)
    store.create_dir(path)


def external_sort(rows: DataFrame, columns: DataFrame, order: list[str], key: str, folder: str, prefix: str, scratch: Scratch, known: DataFrame | None = None, strangers: int | None = None) -> DataFrame:
    """Write ``rows`` (their file number, then the columns of ``columns``) as one sorted file a number; returns a written table of the files (``FILES``).

    With ``known`` (``file_no``, ``known``: a sorted file of the keys that a number may have), rows of other keys go to the file ``strangers``.
    """
    runs = scratch.path()
    _make(runs)
    # no more map tasks than partitions are asked for, so that runs are long however many files there are
    index = scratch.save(spill_runs(rows.coalesce(parts(rows.sparkSession)), runs, columns.columns, order))
    segments = index if known is None else index.join(known, "file_no", "left").select(*index.columns, "known")
    done = scratch.save(merge_runs(segments, runs, folder, prefix, columns, order, key, None if known is None else strangers))
    names = [f.name for f in StructType.fromDDL(FILES)]
    files = done.filter("run is null").select(*names)
    if known is not None:
        others = done.filter("run is not null").select(*index.columns)
        files = files.unionByName(scratch.save(merge_runs(others, runs, folder, prefix, columns, order, key)).select(*names))
    scratch.drop(index)
    store, path = _storage(runs)
    store.delete_dir(path)  # with what tasks that were tried again have left
    return files


def _crc(prefix: str, column: Column, buckets: int) -> Column:
    return F.crc32(F.concat(F.lit(prefix), column.cast("string")).cast("binary")) % buckets


def _started(table: DataFrame, folder: str, key: str) -> DataFrame:
    """The rows of a table's starting files: the file's number ``start``, the key, the whole row."""
    rows = table.sparkSession.read.schema(table.schema).parquet(folder)
    start = F.regexp_extract(rows.metadataColumn("_metadata")["file_name"], r"-(\d+)\.", 1).cast("long")
    return rows.select(start.alias("start"), F.col(f"`{key}`").alias("key"), F.struct(*(F.col(f"`{c}`") for c in table.columns)).alias("row"))


def _moves(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """How many rows go from which starting file to which bucket; it ``stays`` if the two hold the same rows. At most files x buckets rows."""
    moves = scratch.save(counted.groupBy("start", "bucket").agg(F.sum("n").alias("n")))
    of_start, of_bucket = (moves.groupBy(c).agg(F.count("*").alias(f"of_{c}")) for c in ("start", "bucket"))
    alone = (F.col("of_start") == 1) & (F.col("of_bucket") == 1)
    return scratch.save(moves.join(of_start, "start").join(of_bucket, "bucket").select("start", "bucket", "n", alone.alias("stays")))


def co_bucket(sales: DataFrame, lines: DataFrame, key: str = "sale_id", file_key: str = "item_id", buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Lay ``sales`` and ``lines`` out in starting files below ``path``, then rewrite them to one sorted file a table and bucket.

    A bucket is crc32 of "s" and the decimal key, modulo ``buckets``. Starting files of ``sales`` follow the bucket (two buckets share one
    where it is 1 modulo 4), those of ``lines`` crc32 of the decimal ``file_key``. Returns a row for each final file: ``table_name``, ``path``,
    ``columns``, ``ids_sha256``, ``lineage_sha256``, ``bucket``, ``n_rows``, ``n_joined``, ``rewritten``.
    """
    spark = sales.sparkSession
    scratch, root = Scratch(spark, "co-buckets"), path or new_folder(spark, "co-bucketed")

    def home_of(column: str) -> Column:
        return F.coalesce(_crc("s", F.col(column), buckets), F.lit(buckets + 1))

    home = home_of(f"`{key}`")
    first = {"sales": F.when(home % 4 == 1, home - 1).otherwise(home), "sale_lines": F.coalesce(_crc("", F.col(f"`{file_key}`"), buckets), F.lit(0))}
    tables, at = {"sales": sales, "sale_lines": lines}, {name: f"{root}/{name}" for name in first}
    order = {name: [key, *(c for c in table.columns if c != key)] for name, table in tables.items()}

    begun, started, counted = {}, {}, {}
    for name, table in tables.items():
        _make(at[name])
        numbered = table.select(first[name].cast("long").alias(TO), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(table.columns)))
        begun[name] = external_sort(numbered, table, order[name], key, at[name], "start", scratch)
        started[name] = _started(table, at[name], key)
        counted[name] = scratch.save(started[name].groupBy("start", "key").agg(F.count("*").alias("n")))  # reads the key column only

    of_key = {name: rows.filter("key is not null").groupBy("key").agg(F.sum("n").alias(name)) for name, rows in counted.items()}
    pairs = scratch.save(of_key["sales"].join(of_key["sale_lines"], "key", "full"))
    joined = scratch.save(pairs.groupBy(home_of("key").alias("bucket")).agg(F.sum(F.col("sales") * F.col("sale_lines")).alias("n_joined")))
    # the counts alone, one row a key and starting file, are joined to tell the lines' strangers
    lines_of = counted["sale_lines"].filter("key is not null").join(pairs.filter("sales is null").select("key", F.lit(True).alias("stranger")).hint("merge"), "key", "left")
    buckets_of = {
        "sales": counted["sales"].withColumn("bucket", home_of("key")),
        "sale_lines": lines_of.select("start", "n", F.when(F.col("stranger"), buckets).otherwise(home_of("key")).alias("bucket")).unionByName(counted["sale_lines"].filter("key is null").select("start", "n", F.lit(buckets + 1).cast("long").alias("bucket"))),
    }

    final, sorted_sales = [], None
    for name, table in tables.items():
        moves = _moves(buckets_of[name], scratch)
        gone = scratch.save(moves.filter("not stays").select("start").distinct())
        moved = started[name].join(F.broadcast(gone), "start")  # ``gone`` has a number for each file at most
        moved = moved.select(home_of("key").alias(TO), *(F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(table.columns)))
        new = external_sort(moved, table, order[name], key, at[name], "bucket", scratch, sorted_sales, buckets if name == "sale_lines" else None)
        old = begun[name].join(moves.filter("stays"), F.col("file_no") == F.col("start")).select("bucket", "path", "n_rows", "ids_sha256", F.lit(False).alias("rewritten"))
        new = new.select(F.col("file_no").alias("bucket"), "path", "n_rows", "ids_sha256", F.lit(True).alias("rewritten"))
        parts_of = F.transform(F.array_sort(F.collect_list(F.struct("start", "n"))), lambda x: F.concat_ws(":", x["start"].cast("string"), x["n"].cast("string")))
        lineage = moves.groupBy("bucket").agg(F.sha2(F.array_join(parts_of, ",").cast("binary"), 256).alias("lineage_sha256"))
        done = scratch.save(old.unionByName(new).join(lineage, "bucket").withColumns({"table_name": F.lit(name), "columns": F.lit(",".join(table.columns))}))
        sorted_sales = done.select(F.col("bucket").alias("file_no"), F.col("path").alias("known"))
        final.append(done)
        store, folder = _storage(at[name])
        for r in gone.collect():  # one for each starting file at most
            store.delete_file(f"{folder}/start-{r['start']:05d}.parquet")
    scratch.drop(*counted.values(), pairs)
    names = ("table_name", "path", "columns", "ids_sha256", "lineage_sha256", "bucket", "n_rows")
    return final[0].unionByName(final[1]).join(joined, "bucket", "left").select(*names, F.coalesce("n_joined", F.lit(0)).alias("n_joined"), "rewritten")
