"""JSON files in and out. Reads go through Spark's own readers, so any store that Spark reads will do."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import keyed, scan

ITEM = "id int, name string, type string, pp int"
CANDIDATES = "array<struct<id:int,name:string,score:double>>"
SEGMENT = f"struct<seg_no:bigint,candidates:{CANDIDATES},detail_ts:double,list_start:double,list_end:double,list_frames:int>"
INDEX = f"index_fps double, groups array<struct<videos:array<string>,resolution:array<int>,segments:array<{SEGMENT}>>>"


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one of ``spark.checkpoint.dir``, gone when the driver ends. A local session without one gets one of its own; a
    cluster must name it.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="chronofold-"))
        root = sc.getCheckpointDir()
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch folder and read from there: what it took isn't done again, and plans over it stay small."""
    path = f"{scratch(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def matches(spark: SparkSession, pattern: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def rename(spark: SparkSession, old: str, new: str) -> None:
    """``old`` under the name ``new``, in the place of what had that name."""
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    a, z = paths(old), paths(new)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(z, True)
    if not fs.rename(a, z):
        raise OSError(f"{old} can't be renamed to {new}")


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _must_exist(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """An array of item objects."""
    return spark.read.schema(ITEM).option("multiLine", True).option("mode", "FAILFAST").json(_must_exist(spark, path))


#: A scheme and the slashes behind it, of which there may be one or three.
SCHEME = "^([A-Za-z0-9+.-]+):/+"


def _uri(spark: SparkSession, path: str) -> str:
    """A path as the column of file names has it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub(SCHEME, r"\1:/", at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString())


def _whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text([_must_exist(spark, p) for p in paths], wholetext=True)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """An array of names; an entity's id is its place, from 1. Anything but an array of strings fails."""
    names = _whole(spark, [path]).select(F.from_json("value", "array<string>").alias("names"))
    checked = names.select(F.when(F.col("names").isNull(), F.raise_error(F.lit(f"not an array of names: {path}"))).otherwise(F.col("names")).alias("names"))
    return checked.select(F.posexplode("names").alias("pos", "name")).select((F.col("pos") + 1).alias("id"), "name")


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Result files, objects of lists: ``file_ord`` (place in ``paths``), ``entity``, ``ent_pos``, ``pos``, ``item``."""
    # one scan of all files; a file's place in ``paths`` is told by its name, so the plan doesn't grow with them
    first: dict[str, int] = {}
    for k, p in enumerate(paths):
        first.setdefault(_uri(spark, p), k)
    place = F.create_map(*(F.lit(x) for kv in first.items() for x in kv))
    whole = _whole(spark, list(dict.fromkeys(paths))).select("value", place[F.regexp_replace("_metadata.file_path", SCHEME, "$1:/")].alias("file_ord"))
    entries = whole.select("file_ord", F.from_json("value", "map<string,array<string>>").alias("m")).select("file_ord", F.posexplode(F.map_entries("m")).alias("ent_pos", "e"))
    return entries.select("file_ord", F.col("e.key").alias("entity"), "ent_pos", F.posexplode("e.value").alias("pos", "item"))


def read_collected(spark: SparkSession, path: str) -> DataFrame:
    """Names that a file of objects, one a line, has as keys; no rows, and a notice, where there is no file."""
    if not exists(spark, path):
        print(f"nothing collected yet: {path}")
        return spark.createDataFrame([], "entity string")
    return spark.read.text(path).filter(F.trim("value") != "").select(F.explode(F.map_keys(F.from_json("value", "map<string,string>"))).alias("entity")).distinct()


def read_editions(spark: SparkSession, pattern: str, order: list[str]) -> DataFrame:
    """Lists of items by edition, ``*/name.json`` with ``{waza_list: {game: {name: facts}}}``: ``name``, ``rank`` (of the folder's name in ``order``), ``file_ord`` (by path), ``game_pos``, ``type``, ``pp`` (null unless the facts are an object that has them)."""
    from ..functions.text import int_or_zero, rank_in

    whole = spark.read.text(pattern, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    games = whole.select("path", F.posexplode(F.map_values(F.from_json(F.get_json_object("value", "$.waza_list"), "map<string,string>"))).alias("game_pos", "game"))
    names = games.filter(F.ltrim("game").startswith("{")).select("path", "game_pos", F.explode(F.from_json("game", "map<string,string>")).alias("name", "facts"))
    rank = rank_in(F.regexp_extract("path", "([^/]+)/[^/]+$", 1), order)
    facts = F.when(F.ltrim("facts").startswith("{") & (F.trim("facts") != "{}"), F.col("facts"))
    # one row for each file finds its place
    files = whole.select("path").distinct().withColumn("rank", rank)
    placed = files.withColumn("file_ord", F.row_number().over(Window.orderBy("rank", "path")))
    ordered = names.join(placed, "path")
    return ordered.select("name", "rank", "file_ord", "game_pos", F.when(facts.isNotNull(), F.coalesce(F.get_json_object(facts, "$.type"), F.lit(""))).alias("type"), F.when(facts.isNotNull(), int_or_zero(F.coalesce(F.get_json_object(facts, "$.pp"), F.lit("")))).alias("pp"))


def write_items(items: DataFrame, path: str) -> None:
    """A dimension as Parquet; ``items_json`` gives the exchange form."""
    items.write.mode("overwrite").parquet(path)


def items_json(items: DataFrame) -> DataFrame:
    return items.groupBy().agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "name", "type", "pp")))).alias("value"))


def result_json(merged: DataFrame) -> DataFrame:
    """One row, the whole result as an object of lists in order (``entity``, ``ent_pos``, ``pos``, ``item``)."""
    lists = merged.groupBy("ent_pos", "entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda s: s["item"]).alias("items"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("ent_pos", "entity", "items"))), lambda s: F.struct(s["entity"], s["items"]))
    return lists.groupBy().agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small export as one file in any store that Spark's file systems reach, replaced as a whole."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_lists(lists: DataFrame, path: str) -> None:
    """``ent_pos``, ``entity`` and ``items`` as one file, an object of lists in order, unescaped and indented by two blanks.

    Tasks write the text of ranges of ``ent_pos``; their files are then copied one after the other. The whole is never in one task or the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for entity, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                one = json.dumps({entity: items}, ensure_ascii=False, indent=2)
                texts.append(f"{one[2:-2]},")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

    spark = lists.sparkSession
    parts = f"{scratch(spark)}/text"
    lists.orderBy("ent_pos").select("entity", "items").mapInArrow(run, "value string").write.text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, new = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    source, target = at.getFileSystem(conf), new.getFileSystem(conf)
    found = [f for f in source.listStatus(at) if f.getPath().getName().startswith("part-") and f.getLen()]
    found.sort(key=lambda f: f.getPath().getName())
    out = target.create(new, True)
    out.write(bytearray(b"{\n" if found else b"{}\n"))
    for k, f in enumerate(found):
        one = source.open(f.getPath())
        jvm.org.apache.commons.io.IOUtils.copyLarge(one, out, 0, f.getLen() - (2 if k == len(found) - 1 else 0))  # without the last comma
        one.close()
    if found:
        out.write(bytearray(b"\n}\n"))
    out.close()
    rename(spark, f"{path}.new", path)


def write_json(one: DataFrame, path: str) -> None:
    """A small export: one row of JSON as one file, unescaped and indented by two blanks."""
    row = one.first()
    text = json.dumps(json.loads((row and row["value"]) or "{}"), ensure_ascii=False, indent=2)
    write_text(one.sparkSession, path, text + "\n")


def sidecar(path: str) -> str:
    return f"{path}.segments.json"


def index_json(groups: DataFrame, index_fps: float) -> DataFrame:
    """One row: the index of segments (``group_no``, ``videos``, ``resolution``, and a segment's columns)."""
    seg = F.struct("seg_no", "candidates", "detail_ts", "list_start", "list_end", "list_frames")
    by = groups.groupBy("group_no").agg(F.first("videos").alias("videos"), F.first("resolution").alias("resolution"), F.array_sort(F.collect_list(seg)).alias("segments"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("group_no", "videos", "resolution", "segments"))), lambda g: F.struct(g["videos"].alias("videos"), g["resolution"].alias("resolution"), g["segments"].alias("segments")))
    return by.groupBy().agg(F.to_json(F.struct(F.lit(index_fps).alias("index_fps"), every.alias("groups"))).alias("value"))


#: What the first line of an index by lines is, and nothing else that JSON writers write.
BY_LINES = re.compile(r'\{"index_fps": ([^,\s]+), "groups": \[\n')


def write_index(groups: DataFrame, index_fps: float, path: str) -> None:
    """The index of segments (columns as in ``index_json``) as one file of JSON, a line for each segment and two for each group.

    Tasks write ranges of lines; their files are then copied one after the other. The whole is never in one task, and the driver holds a buffer of it.
    """
    spark, seg = groups.sparkSession, F.struct("seg_no", "candidates", "detail_ts", "list_start", "list_end", "list_frames")
    rows = kept(groups.withColumn("seg", seg).select("group_no", "videos", "resolution", "seg"))
    by = rows.groupBy("group_no").agg(F.first("videos").alias("videos"), F.first("resolution").alias("resolution"))
    none, head = F.lit(None).cast(rows.schema["seg"].dataType), F.to_json(F.struct("videos", "resolution"), {"ignoreNullFields": "false"})
    opened = by.select("group_no", F.lit(0).alias("part"), none.alias("seg"), F.concat(F.regexp_replace(head, "\\}$", ""), F.lit(',"segments":[')).alias("value"))
    closed = by.select("group_no", F.lit(2).alias("part"), none.alias("seg"), F.lit("]}").alias("value"))
    lines = rows.select("group_no", F.lit(1).alias("part"), "seg", F.to_json("seg").alias("value")).unionByName(opened).unionByName(closed)

    def comma(before: str, after: str) -> str:
        """What ends a line, told by its last sign and the next line's first."""
        return "" if before == "[" or after == "]" else ","

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last line of a task's file waits for the next file's first
        for b in batches:
            out = []
            for one in b.column(0).to_pylist():
                if held is not None:
                    out.append(held + comma(held[-1], one[0]))
                held = one
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.string())], names=["value"])

    parts = f"{scratch(spark)}/text"
    lines.orderBy("group_no", "part", "seg").select("value").mapInArrow(run, "value string").write.text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, new = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    source, target = at.getFileSystem(conf), new.getFileSystem(conf)
    found = sorted((f for f in source.listStatus(at) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getPath().getName())
    out = target.create(new, True)
    out.write(bytearray(f'{{"index_fps": {json.dumps(float(index_fps))}, "groups": ['.encode()))
    before = "["
    for f in found:
        one = source.open(f.getPath())
        out.write(bytearray(f"{comma(before, chr(one.read()))}\n".encode()))
        one.seek(f.getLen() - 2)
        before = chr(one.read())
        one.seek(0)
        jvm.org.apache.commons.io.IOUtils.copyLarge(one, out, 0, f.getLen() - 1)  # without the end of the last line
        one.close()
    out.write(bytearray(b"\n]}\n"))
    out.close()
    rename(spark, f"{path}.new", path)


def _by_lines(spark: SparkSession, path: str) -> float | None:
    """The rate of an index that ``write_index`` wrote, by its first line; nothing where the file is laid out otherwise."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_must_exist(spark, path))
    stream, head = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at), ""
    try:
        while len(head) < 80 and not head.endswith("\n") and (c := stream.read()) >= 0:
            head += chr(c)
    finally:
        stream.close()
    found = BY_LINES.fullmatch(head)
    return float(found[1]) if found else None


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of an index file: by its lines where ``write_index`` laid it out, in as many tasks as it has blocks; else the whole as one row."""
    rate = _by_lines(spark, path)
    if rate is None:
        rows = _whole(spark, [path]).select(F.from_json("value", INDEX).alias("v")).select("v.index_fps", F.posexplode("v.groups").alias("group_no", "g"))
        return rows.select("index_fps", "group_no", "g.videos", "g.resolution", F.explode("g.segments").alias("s")).select("index_fps", "group_no", "videos", "resolution", "s.*")
    value = F.rtrim(F.col("value"), F.lit(","))
    lines = spark.read.text(path).select(F.lit(0).alias("group_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), value.alias("value"))
    lines = lines.filter(~F.col("value").startswith("]") & ~F.col("value").startswith('{"index_fps"'))
    opens = F.col("value").startswith('{"videos"')
    head = F.when(opens, F.from_json(F.concat("value", F.lit("]}")), "videos array<string>, resolution array<int>", {"mode": "FAILFAST"}))
    # a segment's group is told by the lines before it, of its own block or of others; filters may be moved, so the parser sees no other lines by itself
    rows = scan(keyed(lines, F.col("block")), ["line"], last={"head": head}, total={"n": F.when(opens, 1).otherwise(0)}).filter(~opens)
    each = rows.select(F.lit(rate).alias("index_fps"), (F.col("n") - 1).cast("int").alias("group_no"), "head", F.from_json(F.when(~opens, F.col("value")), SEGMENT, {"mode": "FAILFAST"}).alias("s"))
    return each.select("index_fps", "group_no", "head.videos", "head.resolution", "s.*")


def read_index(spark: SparkSession, path: str, dim: DataFrame | None = None) -> DataFrame:
    """Segments of a stored index: ``index_fps``, ``group_no``, ``seg_no`` and so on; candidates that ``dim`` lacks are dropped, names are its own."""
    segs = _segments(spark, path)
    if dim is None:
        return segs
    each = segs.select("group_no", "seg_no", F.posexplode("candidates").alias("pos", "c")).join(dim.select("id", F.col("name").alias("own")), F.col("c.id") == F.col("id"))
    known = each.groupBy("group_no", "seg_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("c.id").alias("id"), F.col("own").alias("name"), F.col("c.score").alias("score")).alias("c")))), lambda x: x["c"]).alias("known"))
    return segs.join(known, ["group_no", "seg_no"], "left").withColumn("candidates", F.coalesce("known", F.array().cast(CANDIDATES))).drop("known")


def text_corners(fragments: DataFrame) -> DataFrame:
    """Fragments (``box`` of four corners) with their first and third corners, as a reader's dump shows them."""
    return fragments.select("frame_id", "box_no", "frag_no", "text", "confidence", F.element_at("box", 1).alias("first_corner"), F.element_at("box", 3).alias("third_corner"))
