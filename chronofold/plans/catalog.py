"""Every relational operator as a query over the test tables, with its SQL.

The tables stand in for recordings: ``events`` are frames (``user_id`` the recording, ``event_type`` the screen's kind, ``value`` a
picture's brightness), ``part`` holds observed texts and, with distinct names, the dimension; ``lineitem`` the votes and item lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import dimension, fuzzy, merge, nearest, rows, segments, timeline, votes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Microseconds since 1970, whatever the session's time zone.
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
SECONDS = "epoch_us(ts) / 1000000.0"


#: Events are few in an hour: the slots of their scans are this many seconds.
SLOT = 14 * 86_400.0


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames; a third of them read the entity of their box."""
    kind = F.when(F.col("event_type") == "click", "detail").when(F.col("event_type").isin("view", "signup"), "move_list").otherwise("other")
    box = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), F.concat(F.lit("E"), (F.col("event_id") % 7).cast("string")))
    return t(spark, d, "events").select(F.col("user_id").cast("string").alias("group_id"), (F.expr(MICROS) / 1000000.0).alias("ts"), F.col("event_id").alias("ord"), kind.alias("kind"), box.alias("box"), "value")


FRAMES = f"""SELECT user_id::VARCHAR AS group_id, {SECONDS} AS ts, event_id AS ord, CASE WHEN event_type = 'click' THEN 'detail' WHEN event_type IN ('view', 'signup') THEN 'move_list' ELSE 'other' END AS kind,
 CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'E' || (event_id % 7)::VARCHAR END AS box, value FROM events"""

MARKED = f"""f AS ({FRAMES}), m AS (SELECT *, (kind = 'detail' AND coalesce(lag(kind) OVER w, 'other') <> 'detail') AS entry FROM f WINDOW w AS (PARTITION BY group_id ORDER BY ts, ord)),
n AS (SELECT *, sum(entry::INT) OVER (PARTITION BY group_id ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS seg FROM m),
e AS (SELECT group_id, seg, min(CASE WHEN entry THEN ts END) AS entry_ts, min(CASE WHEN kind = 'move_list' THEN ts END) AS list_start, max(CASE WHEN kind = 'move_list' THEN ts END) AS list_end, count(*) FILTER (kind = 'move_list') AS list_frames,
 arg_max(box, (ts, ord)) FILTER (kind = 'other' AND box IS NOT NULL) AS read FROM n GROUP BY ALL),
g AS (SELECT *, lag(read) OVER w AS given, lag(list_frames) OVER w AS n_before FROM e WINDOW w AS (PARTITION BY group_id ORDER BY seg)),
r AS (SELECT *, sum(CASE WHEN n_before > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY group_id ORDER BY seg ROWS UNBOUNDED PRECEDING) AS run FROM g),
s AS (SELECT *, CASE WHEN seg > 0 THEN last_value(given IGNORE NULLS) OVER (PARTITION BY group_id, run ORDER BY seg ROWS UNBOUNDED PRECEDING) END AS entity FROM r),
segs AS (SELECT group_id, seg, row_number() OVER (PARTITION BY group_id ORDER BY seg) AS segment_no, entity, CASE WHEN entity IS NOT NULL THEN entry_ts END AS detail_ts, list_start, list_end, list_frames FROM s WHERE list_frames > 0)"""


@query(f"WITH {MARKED} SELECT group_id, seg::BIGINT AS seg, segment_no::BIGINT AS segment_no, entity, detail_ts, list_start, list_end, list_frames FROM segs")
def timeline_segments(spark, d):
    """The state machine as windows."""
    out = segments.segments(frames(spark, d), SLOT)
    return out.withColumns({"seg": F.col("seg").cast("long"), "segment_no": F.col("segment_no").cast("long")})


@query("""SELECT event_id, greatest(1, round_even((CASE WHEN value < 5 THEN 30.0 ELSE value END) / 4.0, 0)::INT) AS step FROM events
WHERE event_id % greatest(1, round_even((CASE WHEN value < 5 THEN 30.0 ELSE value END) / 4.0, 0)::INT) = 0""")
def thin_frames(spark, d):
    """A grid of frames; rates that are no rates become 30."""
    src = t(spark, d, "events").select("event_id", F.col("event_id").alias("frame_idx"), F.when(F.col("value") < 5, F.when(F.col("event_id") % 2 == 0, float("nan")).otherwise(-1.0)).otherwise(F.col("value")).alias("src_fps"))
    return timeline.thin(src, 4.0).select("event_id", "step")


@query(f"SELECT event_id, {SECONDS} AS ts FROM events WHERE {SECONDS} >= 1704070800 AND {SECONDS} < 1704110400")
def time_range(spark, d):
    """A half-open range of seconds, in the column's own type."""
    return timeline.in_range(t(spark, d, "events"), 1704070800.0, 1704110400.0).select("event_id", (F.expr(MICROS) / 1000000.0).alias("ts"))


@query("""SELECT p_partkey, greatest(1, trunc(228 * ((640 + p_size * 10) / 1280.0))::INT) AS slot_w, trunc(220 * ((360 + p_size * 5) / 720.0))::INT AS first_y, greatest(1, trunc(9 * ((640 + p_size * 10) / 1280.0))::INT) AS icon_w, trunc(80 * ((640 + p_size * 10) / 1280.0))::INT AS header_x FROM part""")
def scaled_layout(spark, d):
    """Fixed places, scaled by truncation."""
    w, h = (640 + F.col("p_size") * 10).cast("double"), (360 + F.col("p_size") * 5).cast("double")
    cols = t(spark, d, "part").select("p_partkey", *timeline.layout(w, h))
    return cols.select("p_partkey", F.col("move_slot_w").alias("slot_w"), F.col("move_slot_ys")[0].alias("first_y"), F.col("type_icon_w").alias("icon_w"), F.col("header.x").alias("header_x"))


@query("""WITH v AS (SELECT o_custkey % 20 AS group_id, o_orderkey AS video_seq, (o_orderkey % 997) + 1 AS frame_count, CASE WHEN o_orderkey % 5 = 0 THEN 30.0 ELSE 25.0 END AS fps, o_custkey % 3 AS shape FROM orders)
SELECT group_id, video_seq, round(coalesce(sum(frame_count / fps) OVER (PARTITION BY group_id ORDER BY video_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS "offset" FROM v""")
def video_offsets(spark, d):
    """Seconds before each file on the joined timeline."""
    v = t(spark, d, "orders").select((F.col("o_custkey") % 20).alias("group_id"), F.col("o_orderkey").alias("video_seq"), (F.col("o_orderkey") % 997 + 1).alias("frame_count"), F.when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise(25.0).alias("src_fps"))
    return timeline.offsets(v).select("group_id", "video_seq", F.round("offset", 3).alias("offset"))


@query("SELECT l_partkey % 50 AS group_id, l_orderkey AS video_seq, l_linenumber AS frame_idx, row_number() OVER (PARTITION BY l_partkey % 50 ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS global_idx FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL) QUALIFY count(*) OVER (PARTITION BY l_partkey % 50, l_orderkey, l_linenumber) = 1")
def frame_numbers(spark, d):
    """A running number over files. Places that two frames share are left out."""
    f = t(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("group_id"), F.col("l_orderkey").alias("video_seq"), F.col("l_linenumber").alias("frame_idx"), "l_partkey").count()
    one = f.groupBy("group_id", "video_seq", "frame_idx").agg(F.count("*").alias("n"))
    return timeline.number_frames(f.drop("l_partkey", "count"), 20_000).join(one, ["group_id", "video_seq", "frame_idx"]).filter("n = 1").select("group_id", "video_seq", "frame_idx", F.col("global_idx").cast("long").alias("global_idx"))


THUMBS = "f AS (SELECT user_id::VARCHAR AS group_id, " + SECONDS + " AS ts, event_id AS ord, [floor(value / 20)::INT, (user_id % 3)::INT, 7] AS thumb, event_type AS read_kind FROM events), p AS (SELECT *, lag(thumb) OVER (PARTITION BY group_id ORDER BY ts, ord) AS before FROM f), q AS (SELECT *, coalesce((abs(thumb[1] - before[1]) + abs(thumb[2] - before[2]) + abs(thumb[3] - before[3])) / 3.0 < 2.0, false) AS same FROM p)"


def _thumbs(spark, d):
    thumb = F.array(F.floor(F.col("value") / 20).cast("int"), (F.col("user_id") % 3).cast("int"), F.lit(7))
    return t(spark, d, "events").select(F.col("user_id").cast("string").alias("group_id"), (F.expr(MICROS) / 1000000.0).alias("ts"), F.col("event_id").alias("ord"), thumb.alias("header_thumb"), F.col("event_type").alias("read_kind"))


@query(f"WITH {THUMBS} SELECT group_id, ord, last_value(CASE WHEN NOT same THEN read_kind END IGNORE NULLS) OVER (PARTITION BY group_id ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS kind FROM q")
def carried_kinds(spark, d):
    """A header like the one before keeps its kind."""
    return timeline.carry_kind(_thumbs(spark, d), SLOT).select("group_id", "ord", "kind")


@query(f"""WITH f AS ({FRAMES}), p AS (SELECT *, [floor(value / 10)::INT, 3] AS th, lag(kind) OVER w AS k0, lag([floor(value / 10)::INT, 3]) OVER w AS t0, lag(value) OVER w AS v0 FROM f WINDOW w AS (PARTITION BY group_id ORDER BY ts, ord)),
q AS (SELECT *, coalesce((abs(th[1] - t0[1]) + abs(th[2] - t0[2])) / 2.0 < 2.0, false) AS same FROM p)
SELECT group_id, ord, kind = 'move_list' AND NOT coalesce(k0 = 'move_list' AND same, false) AS vote, kind = 'other' AND value > 40 AND NOT (coalesce(k0 = 'other' AND v0 > 40, false) AND same) AS box_read FROM q""")
def frames_to_read(spark, d):
    """Which frames the costly readers see."""
    f = frames(spark, d)
    thumb = F.array(F.floor(F.col("value") / 10).cast("int"), F.lit(3))
    return timeline.to_read(f.withColumns({"slot_thumb": thumb, "box_thumb": thumb, "mean_luma": F.col("value")}), SLOT).select("group_id", "ord", "vote", "box_read")


@query(f"""WITH {MARKED} SELECT f.group_id, f.ord, segs.segment_no::BIGINT AS segment_no FROM f JOIN segs ON f.group_id = segs.group_id AND f.ts >= greatest(0, list_start - 200.0) AND f.ts < list_end + 200.0""")
def segment_frames(spark, d):
    """Range join of frames and segments."""
    f = frames(spark, d)
    return segments.frames_of_segments(f, segments.segments(f, SLOT), 0.01, slot=3600.0).select("group_id", "ord", F.col("segment_no").cast("long").alias("segment_no"))


@query(f"""WITH {MARKED}, z AS (SELECT *, row_number() OVER (ORDER BY group_id, segment_no) AS global_no FROM segs), names AS (SELECT coalesce(entity, '(unknown)') AS name, max(global_no) AS global_no FROM z GROUP BY 1)
SELECT global_no::BIGINT AS global_no, entity FROM z WHERE global_no IN (3, 17, 99999999) OR global_no IN (SELECT global_no FROM names WHERE name IN ('E1', '(unknown)', 'nobody'))""")
def selected_segments(spark, d):
    """By running number or name, the last of a name."""
    numbered = segments.number_segments(segments.segments(frames(spark, d), SLOT), "group_id")
    return segments.select_segments(numbered, "3, 17,99999999,E1,(unknown), nobody").select("global_no", "entity")


def _dim(spark, d):
    return t(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("int").alias("id"), F.min_by("p_type", "p_partkey").alias("type"))


def _observed(spark, d):
    """Part names, some with letters lost or changed."""
    name, k = F.col("p_name"), F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.substring(name, 2, 99), F.lit("x"))).when(k % 4 == 1, F.replace(name, F.lit("e"), F.lit("c"))).when(k % 4 == 2, F.substring(name, 1, 4)).otherwise(name)
    return t(spark, d, "part").select("p_partkey", raw.alias("raw"), F.when(k % 3 > 0, F.col("p_type")).alias("observed_type"))


OBSERVED = """d AS (SELECT p_name AS name, min(p_partkey)::INT AS id, arg_min(p_type, p_partkey) AS type FROM part GROUP BY 1),
o AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN substr(p_name, 2, 99) || 'x' WHEN p_partkey % 4 = 1 THEN replace(p_name, 'e', 'c') WHEN p_partkey % 4 = 2 THEN substr(p_name, 1, 4) ELSE p_name END AS raw, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS observed_type FROM part),
x AS (SELECT DISTINCT raw, observed_type FROM o WHERE length(raw) > 0),
s AS (SELECT raw, observed_type, id, name, 1 - levenshtein(raw, name) / greatest(length(raw), length(name)) AS score, CASE WHEN type = observed_type THEN 0.15 ELSE 0 END AS bonus FROM x CROSS JOIN d),
r AS (SELECT *, row_number() OVER (PARTITION BY raw, observed_type ORDER BY score + bonus DESC, id) AS rank FROM s)"""


@query(f"WITH {OBSERVED} SELECT raw, observed_type, rank::INT AS rank, id, name, round(score, 6) AS score FROM r WHERE rank <= 3")
def fuzzy_items(spark, d):
    """The nearest items, types as a soft boost."""
    return fuzzy.match_items(_observed(spark, d), _dim(spark, d), 3, ascii_only=True).withColumn("score", F.round("score", 6))


@query(f"WITH {OBSERVED} SELECT p_partkey, o.raw, CASE WHEN r.score >= 0.7 THEN r.name ELSE o.raw END AS canonical FROM o JOIN r ON o.raw = r.raw AND o.observed_type IS NOT DISTINCT FROM r.observed_type AND r.rank = 1")
def canonical_names(spark, d):
    """The name if it is near enough, else the text."""
    return fuzzy.canonical_texts(_observed(spark, d), _dim(spark, d), ascii_only=True).select("p_partkey", "raw", "canonical")


@query()
def fuzzy_entities(spark, d):
    """Sequence ratios; SQL has none, the tests compare with plain Python."""
    o = _observed(spark, d).select("raw").distinct()
    return fuzzy.match_entities(o, _dim(spark, d).select("id", "name"), 3, least=0.7)


@query()
def entities_of_frames(spark, d):
    """Entities from a frame's fragments and their join."""
    k = F.col("p_partkey")
    f = t(spark, d, "part").select((F.floor(k / 400) * 100 + k % 100).alias("frame_id"), (F.floor(k / 100) % 4).cast("int").alias("frag_no"), F.concat(F.lit(" "), F.col("p_name")).alias("text"))
    return fuzzy.entities_of_fragments(f, _dim(spark, d).select("id", "name"), 5)


@query("""WITH c AS (SELECT * FROM (VALUES """ + ", ".join(f"({k}, '{n}', {b}, {g}, {r})" for k, (n, (b, g, r)) in enumerate(nearest.COLOURS.items())) + """) AS v(ord, type, b, g, r)),
s AS (SELECT p_partkey, (p_size * 5)::DOUBLE AS cb, (p_partkey % 256)::DOUBLE AS cg, ((p_partkey * 7) % 256)::DOUBLE AS cr FROM part),
n AS (SELECT p_partkey, type, (cb - b) ** 2 + (cg - g) ** 2 + (cr - r) ** 2 AS d2, row_number() OVER (PARTITION BY p_partkey ORDER BY (cb - b) ** 2 + (cg - g) ** 2 + (cr - r) ** 2, ord) AS k FROM s CROSS JOIN c)
SELECT p_partkey, CASE WHEN d2 <= 2500 THEN type END AS type, d2 FROM n WHERE k = 1""")
def nearest_colours(spark, d):
    """The nearest reference colour within reach."""
    s = t(spark, d, "part").select("p_partkey", (F.col("p_size") * 5).cast("double").alias("cb"), (F.col("p_partkey") % 256).cast("double").alias("cg"), (F.col("p_partkey") * 7 % 256).cast("double").alias("cr"))
    return nearest.nearest_colour(s, nearest.reference_colours(spark)).select("p_partkey", "type", "d2")


@query("""WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: round(x * 100)::INT) AS th FROM embeddings), r AS (SELECT vec_id AS ord, th AS ref, 'k' || (vec_id % 3)::VARCHAR AS kind FROM f WHERE vec_id < 20),
p AS (SELECT f.vec_id, kind, ord, list_sum(list_transform(range(1, len(th) + 1), lambda i: abs(th[i] - ref[i])::DOUBLE)) / len(th) AS dist FROM f CROSS JOIN r),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, ord) AS k FROM p) SELECT vec_id AS frame_id, CASE WHEN dist < 9 THEN kind END AS kind, dist AS distance FROM b WHERE k = 1""")
def template_kinds(spark, d):
    """The nearest of twenty templates, strictly within reach. Cells are hundredths, rounded as the vectors' own type has them: Spark widens
    a float times an integer to a double, in which 0.105 falls short of 10.5.
    """
    thumb = F.transform("embedding", lambda x: F.round((x * 100).cast("float")).cast("int"))
    f = t(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), thumb.alias("thumb"))
    r = f.filter("frame_id < 20").select(F.col("frame_id").alias("ord"), F.col("thumb").alias("ref"), F.concat(F.lit("k"), (F.col("frame_id") % 3).cast("string")).alias("kind"))
    return nearest.classify_by_templates(f, r, 9.0).select("frame_id", "kind", "distance")


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS frame_id, l_linenumber AS res_no, (l_orderkey * 7 + l_linenumber * 31) % 100 AS cy FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS frame_id, l_linenumber AS box_no, l_linenumber * 15 AS box_y FROM lineitem),
j AS (SELECT frame_id, res_no, box_no, row_number() OVER (PARTITION BY frame_id, res_no ORDER BY abs(cy - box_y), box_no) AS k FROM r JOIN b USING (frame_id)) SELECT frame_id, res_no, box_no FROM j WHERE k = 1""")
def nearest_boxes(spark, d):
    """Results to the nearest box of their frame."""
    li = nearest.dealt(t(spark, d, "lineitem"), "l_orderkey")
    r = li.select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("res_no")).distinct().withColumn("cy", (F.col("frame_id") * 7 + F.col("res_no") * 31) % 100)
    b = li.select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("box_no")).distinct().withColumn("by", F.col("box_no") * 15)
    return nearest.nearest_box(r, b)


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS frame_id, l_linenumber AS res_no FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS frame_id, l_linenumber + 3 AS box_no FROM lineitem WHERE l_quantity > 10),
p AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY res_no) AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM r),
q AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY box_no) AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM b)
SELECT p.frame_id, res_no, box_no FROM p JOIN q ON p.frame_id = q.frame_id AND p.k = q.k AND p.n = q.n""")
def zipped_boxes(spark, d):
    """By place in order, where a frame has as many results as boxes."""
    li = nearest.dealt(t(spark, d, "lineitem"), "l_orderkey")
    r = li.select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("res_no")).distinct()
    b = li.filter("l_quantity > 10").select(F.col("l_orderkey").alias("frame_id"), (F.col("l_linenumber") + 3).alias("box_no")).distinct()
    return nearest.zip_boxes(r, b)


@query("SELECT p_brand AS patch, median(p_size) AS cb, median(p_retailprice) AS cg, median(p_partkey) AS cr FROM part GROUP BY 1")
def median_colours(spark, d):
    """A10: medians by channel."""
    p = t(spark, d, "part").select(F.col("p_brand").alias("patch"), F.col("p_size").alias("b"), F.col("p_retailprice").alias("g"), F.col("p_partkey").alias("r"))
    return nearest.median_colour(p, ["patch"])


ITEMS = "i AS (SELECT l_suppkey % 40 AS seg_no, CASE WHEN l_suppkey % 40 % 3 > 0 THEN 'S' || (l_suppkey % 7)::VARCHAR ELSE '(unknown)' END AS entity, l_orderkey AS pos, 'item' || (l_partkey % 60)::VARCHAR AS item FROM lineitem)"


def _items(spark, d):
    s = F.col("l_suppkey") % 40
    e = F.when(s % 3 > 0, F.concat(F.lit("S"), (F.col("l_suppkey") % 7).cast("string"))).otherwise(merge.UNKNOWN)
    return t(spark, d, "lineitem").select(s.alias("seg_no"), e.alias("entity"), F.col("l_orderkey").alias("pos"), F.concat(F.lit("item"), (F.col("l_partkey") % 60).cast("string")).alias("item"))


@query(f"WITH {ITEMS} SELECT seg_no AS segment_id, item AS name, count(*) AS votes, min(pos) AS first_frame FROM i GROUP BY 1, 2 HAVING count(*) >= 2")
def segment_votes(spark, d):
    """Votes with the place first seen."""
    o = _items(spark, d).select(F.col("seg_no").alias("segment_id"), F.col("item").alias("name"), F.col("pos").alias("frame_idx"), F.lit(0).alias("row_no"))
    return votes.votes(o, 2).select("segment_id", "name", "votes", F.col("first_seen.frame_idx").alias("first_frame"))


@query(f"WITH {ITEMS}, g AS (SELECT seg_no, item, min(pos) AS f FROM i GROUP BY 1, 2) SELECT seg_no, item, row_number() OVER (PARTITION BY seg_no ORDER BY f, item)::INT AS pos FROM g")
def ordered_items(spark, d):
    """A3, U4: each value once, where it first stands."""
    return votes.ordered_distinct(_items(spark, d), ["seg_no"], "item", ["pos"])


@query(f"WITH {ITEMS}, k AS (SELECT CASE WHEN entity = '(unknown)' THEN '(unknown ' || seg_no::VARCHAR || ')' ELSE entity END AS entity, item, min((seg_no, pos)) AS f FROM i GROUP BY 1, 2) SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY f, item)::INT AS pos, item FROM k")
def merged_segments(spark, d):
    """Ordered union by entity; unknown segments stay apart."""
    i = _items(spark, d)
    return merge.merge_segments(i.withColumn("pos", F.struct("pos", "item")))


@query("""WITH i AS (SELECT l_linenumber AS file_ord, CASE WHEN l_suppkey % 11 = 0 THEN '(unknown 3)' ELSE 'S' || (l_suppkey % 11)::VARCHAR END AS entity, l_orderkey AS pos, 'item' || (l_partkey % 90)::VARCHAR AS item FROM lineitem),
u AS (SELECT file_ord, entity, pos, item FROM i WHERE entity NOT LIKE '(unknown%'), f AS (SELECT entity, item, min(file_ord) AS file_ord FROM u GROUP BY 1, 2)
SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY file_ord, pos, item)::INT AS pos, item FROM u JOIN f USING (entity, item, file_ord)""")
def merged_files(spark, d):
    """Later files add what is new."""
    e = F.when(F.col("l_suppkey") % 11 == 0, "(unknown 3)").otherwise(F.concat(F.lit("S"), (F.col("l_suppkey") % 11).cast("string")))
    i = t(spark, d, "lineitem").select(F.col("l_linenumber").alias("file_ord"), e.alias("entity"), F.struct("l_orderkey", F.concat(F.lit("item"), (F.col("l_partkey") % 90).cast("string"))).alias("pos"), F.concat(F.lit("item"), (F.col("l_partkey") % 90).cast("string")).alias("item"))
    return merge.merge_files(i)


@query()
def second_pass(spark, d):
    """The containment fold; compared with plain Python in the tests."""
    first = _items(spark, d).groupBy("seg_no").agg(F.first("entity").alias("name"), F.array_sort(F.collect_set(F.when(F.col("pos") % 3 > 0, F.col("item")))).alias("items"))
    out = merge.containment_merge(first.withColumn("name", F.when(F.col("seg_no") % 3 > 0, F.concat(F.lit("S"), (F.col("seg_no") % 5).cast("string"))).otherwise(merge.UNKNOWN)), 0.8)
    return out.select("entity", F.array_join("items", ",").alias("items"), F.size("merged").alias("n_merged"))


@query("SELECT conv_id AS frame_id, string_agg(coalesce(role, ''), '' ORDER BY turn) AS text FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) GROUP BY 1")
def header_texts(spark, d):
    """Fragments in order as one string."""
    return votes.header_text(t(spark, d, "conversations").select(F.col("conv_id").alias("frame_id"), F.col("turn").alias("frag_no"), F.coalesce("role", F.lit("")).alias("text")).distinct())


@query("""WITH f AS (SELECT l_orderkey AS frame_id, l_suppkey % 3 AS box_no, l_linenumber AS frag_no, 't' || l_partkey::VARCHAR AS text, (l_quantity % 5) / 5 AS confidence FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY frame_id, box_no ORDER BY confidence DESC, frag_no, text DESC) AS k FROM f),
x AS (SELECT frame_id, box_no, text, confidence FROM b WHERE k = 1)
SELECT frame_id, box_no, CASE WHEN confidence < 0.5 AND frame_id % 2 = 0 THEN 'second ' || frame_id::VARCHAR ELSE text END AS text, confidence FROM x""")
def best_texts(spark, d):
    """The surest text of a box, with a second reading of doubtful ones."""
    f = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), (F.col("l_suppkey") % 3).alias("box_no"), (F.col("l_linenumber") * 1000000 - F.col("l_partkey") * 0).alias("frag_no"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("text"), (F.col("l_quantity") % 5 / 5).alias("confidence"))
    f = f.groupBy("frame_id", "box_no", "frag_no", "confidence").agg(F.max("text").alias("text"))
    first = votes.best_text(f)
    second = first.filter("confidence < 0.5").select("frame_id", "box_no", F.when(F.col("frame_id") % 2 == 0, F.concat(F.lit("second "), F.col("frame_id").cast("string"))).otherwise("").alias("text"))
    return votes.with_fallback(first, second, ["frame_id", "box_no"])


@query("""WITH v AS (SELECT s_suppkey AS video_seq, s_name AS path, CASE WHEN s_nationkey % 3 = 0 THEN 1280 ELSE 1920 END AS width, CASE WHEN s_nationkey % 3 = 0 THEN 720 WHEN s_nationkey % 3 = 1 THEN 1080 ELSE 1200 END AS height FROM supplier),
g AS (SELECT width, height, min(video_seq) AS first_seq, string_agg(path, ',' ORDER BY video_seq) AS paths FROM v GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY first_seq)::INT AS group_no FROM g""")
def video_groups(spark, d):
    """Files by resolution, in order of first sight."""
    n = F.col("s_nationkey") % 3
    v = t(spark, d, "supplier").select(F.col("s_suppkey").alias("video_seq"), F.col("s_name").alias("path"), F.when(n == 0, 1280).otherwise(1920).alias("width"), F.when(n == 0, 720).when(n == 1, 1080).otherwise(1200).alias("height"))
    return timeline.group_videos(v).withColumn("paths", F.array_join("paths", ","))


EDITIONS = "e AS (SELECT replace(p_name, ' ', CASE WHEN p_size % 2 = 0 THEN ' ' ELSE '' END) AS name, (p_size % 6 - 1)::INT AS rank, p_partkey AS file_ord, CASE WHEN p_partkey % 4 > 0 THEN p_type END AS type, CASE WHEN p_partkey % 4 > 0 THEN p_size END AS pp FROM part), w AS (SELECT name, max(rank) AS best_rank, arg_max(type, (rank, file_ord)) AS type, arg_max(pp, (rank, file_ord)) AS pp FROM e WHERE type IS NOT NULL GROUP BY 1)"


def _editions(spark, d):
    k = F.col("p_partkey") % 4 > 0
    return t(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.when(F.col("p_size") % 2 == 0, " ").otherwise("")).alias("name"), (F.col("p_size") % 6 - 1).alias("rank"), F.col("p_partkey").alias("file_ord"), F.lit(0).alias("game_pos"), F.when(k, F.col("p_type")).alias("type"), F.when(k, F.col("p_size")).alias("pp"))


@query(f"WITH {EDITIONS} SELECT name, best_rank, type, pp FROM w")
def latest_editions(spark, d):
    """The newest facts of each name."""
    return dimension.latest_wins(_editions(spark, d))


@query(f"""WITH {EDITIONS}, c AS (SELECT replace(name, ' ', '') AS key, name, row_number() OVER (PARTITION BY replace(name, ' ', '') ORDER BY best_rank DESC, (name NOT LIKE '% %') DESC, name DESC) AS k FROM w)
SELECT key, max(CASE WHEN k = 1 THEN name END) AS name, coalesce(string_agg(CASE WHEN k > 1 THEN name END, ',' ORDER BY name), '') AS dropped FROM c GROUP BY 1""")
def collapsed_spellings(spark, d):
    """One spelling of each name."""
    return dimension.collapse_spellings(dimension.latest_wins(_editions(spark, d)), ascii_only=True).withColumn("dropped", F.array_join("dropped", ","))


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 2 = 0), a AS (SELECT name FROM n UNION SELECT 'zz extra' UNION SELECT DISTINCT p_name FROM part WHERE p_partkey % 7 = 0) SELECT name, row_number() OVER (ORDER BY name)::INT AS id FROM a")
def supplemented_items(spark, d):
    """Missing names added, ids by code points."""
    p = t(spark, d, "part")
    names = p.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("name")).distinct()
    more = p.filter("p_partkey % 7 = 0").select(F.col("p_name").alias("name")).distinct().unionByName(spark.createDataFrame([("zz extra",)], "name string"))
    return dimension.number_items(dimension.supplement(names, more))


CHARS = "c AS (SELECT unnest(string_split(p_name || ' ' || p_brand || '(' || p_size::VARCHAR || ')', '')) AS char FROM part), n AS (SELECT char, count(*) AS n, CASE WHEN char IN ('(', ')') THEN 'paren' WHEN char BETWEEN '0' AND '9' THEN 'digit' WHEN char = ' ' THEN 'space' ELSE 'other' END AS category FROM c WHERE char <> '' GROUP BY 1)"


def _chars(spark, d):
    return dimension.character_counts(t(spark, d, "part").select(F.concat("p_name", F.lit(" "), "p_brand", F.lit("("), F.col("p_size").cast("string"), F.lit(")")).alias("name")))


@query(f"WITH {CHARS} SELECT * FROM n")
def character_counts(spark, d):
    """Characters by category."""
    return _chars(spark, d)


@query(f"WITH {CHARS}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, char)::INT AS rank FROM n) SELECT * FROM r WHERE rank <= 5")
def frequent_characters(spark, d):
    """The most frequent of each category."""
    return dimension.frequent_characters(_chars(spark, d))


@query("SELECT DISTINCT c_name AS entity FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def not_collected(spark, d):
    """Entities without results yet."""
    have = t(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("entity"))
    return merge.not_collected(t(spark, d, "customer").select(F.col("c_name").alias("entity")), have)


@query("SELECT c_name AS entity FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def collected_too(spark, d):
    """Entities that are there already."""
    have = t(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("entity"))
    return merge.collected_too(t(spark, d, "customer").select(F.col("c_name").alias("entity")), have)


@query("WITH a AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size < 8), b AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 45) SELECT name, 'left' AS side FROM a WHERE name NOT IN (SELECT name FROM b) UNION ALL SELECT name, 'right' FROM b WHERE name NOT IN (SELECT name FROM a)")
def name_differences(spark, d):
    """Names of one list only."""
    p = t(spark, d, "part").select(F.col("p_name").alias("name"), "p_size")
    return merge.name_differences(p.filter("p_size < 8"), p.filter("p_size > 45"))


@query("SELECT l_orderkey AS seg_no, l_linenumber AS pos, p_partkey AS id, p_name AS name, l_discount AS score FROM lineitem JOIN part ON p_partkey = l_partkey * 2")
def known_candidates(spark, d):
    """Candidates with names, unknown ids dropped."""
    c = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("seg_no"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") * 2).alias("id"), F.col("l_discount").alias("score"))
    return segments.known_candidates(c, t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '(unknown)' WHEN c_acctbal / 10000 >= 0.85 THEN c_name END AS name, c_custkey % 5 > 0 AND c_acctbal / 10000 < 0.85 AS review FROM customer")
def chosen_entities(spark, d):
    """Sure entities, and those for review."""
    c = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("top_name"), (F.col("c_acctbal") / 10000).alias("top_score"))
    return votes.choose_entity(c, no_prompt=False).select("c_custkey", "name", "review")


PIXELS = "p AS (SELECT l_suppkey % 10 AS frame_id, l_partkey % 200 AS y, (l_quantity * 5) AS sat, (l_orderkey % 256) AS val, (l_orderkey * 3 % 256) AS gray FROM lineitem), q AS (SELECT frame_id, y, avg(sat) AS sat, avg(val) AS val, avg((gray < 120)::INT) AS dark FROM p GROUP BY 1, 2), i AS (SELECT *, ((sat > 50) OR (val > 120 AND sat < 45))::INT AS icon FROM q)"


def _profiles(spark, d):
    p = t(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("frame_id"), (F.col("l_partkey") % 200).alias("y"), (F.col("l_quantity") * 5).alias("sat"), (F.col("l_orderkey") % 256).alias("val"), (F.col("l_orderkey") * 3 % 256).alias("gray"))
    return rows.profiles(p)


@query(f"WITH {PIXELS} SELECT frame_id, y, round(sat, 6) AS sat, round(val, 6) AS val, round(dark, 6) AS dark FROM q")
def row_profiles(spark, d):
    """Means by height."""
    return _profiles(spark, d).select("frame_id", "y", *(F.round(c, 6).alias(c) for c in ("sat", "val", "dark")))


@query(f"""WITH {PIXELS}, z AS (SELECT frame_id, y, CASE WHEN y % 3 = 0 THEN icon ELSE 0 END AS icon FROM i), h AS (SELECT frame_id, y % 17 AS "offset", sum(icon) AS hits FROM z GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY hits DESC, "offset") AS k FROM h),
a AS (SELECT z.frame_id, y + 10 AS centre FROM z JOIN b ON z.frame_id = b.frame_id AND k = 1 AND y % 17 = "offset" WHERE icon = 1)
SELECT frame_id, greatest(20, centre - 6) AS text_top, centre - 6 AS icon_top FROM a WHERE centre BETWEEN 18 AND 174 AND greatest(20, centre - 6) >= 10 AND greatest(20, centre - 6) + 12 <= 190""")
def icon_rows(spark, d):
    """Rows that a comb finds."""
    p = rows.icon_like(_profiles(spark, d)).withColumn("icon", F.when(F.col("y") % 3 == 0, F.col("icon")).otherwise(0))
    return rows.icon_rows(p, rows.comb_phase(p, 17), 17, 12, (20, 37, 160), 10, 190)


@query(f"""WITH {PIXELS}, k AS (SELECT frame_id, y, y - row_number() OVER (PARTITION BY frame_id ORDER BY y) AS island FROM q WHERE dark > 0.45), r AS (SELECT frame_id, min(y) AS s, max(y) AS e FROM k GROUP BY frame_id, island), b AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY e - s DESC, s) AS n FROM r),
c AS (SELECT frame_id, (s + e) // 2 AS centre FROM b WHERE n = 1) SELECT frame_id, centre FROM c WHERE centre - 5 >= 20 AND centre + 5 <= 180""")
def text_bands(spark, d):
    """The longest run of dark heights, within the list."""
    b = rows.text_band(_profiles(spark, d), 0.45).withColumns({"by": F.col("centre") - 5, "h": F.lit(10)})
    return rows.whole_rows(b, 20, 180).select("frame_id", "centre")


@query("""SELECT p_partkey, CASE WHEN p_name || p_type LIKE '%SMALL%' OR p_name || p_type LIKE '%ring%' THEN 'move_list' WHEN p_name || p_type LIKE '%gear%' THEN 'detail' ELSE 'other' END AS kind,
 CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END AS pp, coalesce(list_position(['ECONOMY', 'SMALL', 'LARGE'], p_type), 0)::INT - 1 AS rank, p_name || '  (score=' || printf('%.2f', p_size / 10.0) || ')' AS shown FROM part""")
def scalar_functions(spark, d):
    """words to kinds, numbers with a default, ranks, display."""
    both = F.concat("p_name", "p_type")
    number = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit("x"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    return t(spark, d, "part").select("p_partkey", text.kind_by_words(both, ("SMALL", "ring"), ("gear",)).alias("kind"), text.int_or_zero(number).alias("pp"), text.rank_in(F.col("p_type"), ["ECONOMY", "SMALL", "LARGE"]).alias("rank"), text.shown(F.col("p_name"), F.col("p_size") / 10.0).alias("shown"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE regexp_extract(p_name || '(' || p_type || ') ', '^([^(]*)\((.*)\)\s*$', 1) END AS base, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END AS form, replace(p_name, ' ', '') AS key, regexp_replace(p_name || p_brand, '[^A-Z0-9]', '', 'g') AS allowed FROM part""")
def name_parts(spark, d):
    """Base and form, spelling keys, allowed characters."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("("), "p_type", F.lit(") ")))
    base, form = text.base_and_form(name, ascii_only=True)
    return t(spark, d, "part").select("p_partkey", base.alias("base"), form.alias("form"), text.spelling_key(F.col("p_name"), ascii_only=True).alias("key"), text.only_allowed(F.concat("p_name", "p_brand")).alias("allowed"))


@query("SELECT count(DISTINCT l_orderkey) AS segments, count(*) AS items, (SELECT count(*) FROM part) AS dimension FROM lineitem")
def totals(spark, d):
    """Counts for reports."""
    return t(spark, d, "lineitem").agg(F.countDistinct("l_orderkey").alias("segments"), F.count("*").alias("items")).crossJoin(t(spark, d, "part").agg(F.count("*").alias("dimension")))


@query()
def cached_rows(spark, d):
    """Leader clustering of row thumbs; compared with plain Python in the tests."""
    seven = F.array(*(((F.col("event_id") % 5 * 40 + i) % 256).cast("short") for i in range(7)))
    thumb = F.slice(F.flatten(F.array_repeat(seven, 24 * 96 // 7 + 1)), 1, 24 * 96)  # copied, not computed pixel by pixel
    r = t(spark, d, "events").select(F.col("user_id").alias("segment_id"), F.col("event_id").alias("ord"), thumb.alias("thumb"), F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string")).alias("text"))
    return nearest.row_texts(r)


@query()
def learnt_templates(spark, d):
    """Templates learnt online, up to a limit; compared with plain Python in the tests."""
    f = frames(spark, d)
    return nearest.learn_templates(f.select("group_id", "ts", F.array((F.col("value") % 30).cast("int"), F.lit(1)).alias("thumb"), F.col("kind").alias("read_kind")))


@query("SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS edit, round(2.0 * least(length(p_name), length(p_type)) / (length(p_name) + length(p_type)), 6) AS bound FROM part")
def similarities(spark, d):
    """edit similarity and the bound of the sequence ratio."""
    return t(spark, d, "part").select("p_partkey", F.round(similarity.edit_similarity(F.col("p_name"), F.col("p_type")), 6).alias("edit"), F.round(similarity.sequence_bound(F.col("p_name"), F.col("p_type")), 6).alias("bound"))
