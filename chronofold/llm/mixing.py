"""Mixing sources to target weights by iterative proportional fitting. DataFrame operations only.

Documents fall into cells of source, language and topic. The cells' token weights are raked: scaled to each marginal's targets in turn
until all fit. A cell's ratio of raked to own weight, times one constant, is the probability with which each of its documents is
sampled, at most 1; the constant is the one for which the expected tokens are ``keep`` of all (solved in closed form over the cells in
order of their ratios). ``weight`` is the ratio over the probability: weighted token sums of the sample hit the targets even where a
probability stops at 1.

A document's draw is a hash of its id, so samples repeat and a larger ``keep`` contains a smaller one's.

Sizes: the table of cells is the only thing that one task holds; its rows are combinations of sources, languages and topics that occur,
not documents. Beyond ``BROADCAST_CELLS`` of them, they are joined with a shuffle.

Defined cases: null sources and languages are values of their own, written ``(none)``; null and empty texts have no tokens, and a cell
without tokens has ratio 1; documents with a null id share one draw; repeated rows stay or go together; a target that no document has is
left out and the others are scaled to 1; an empty table gives no rows; other columns are ignored by ``mix`` and kept by ``sample_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ID, TEXT, Scratch

DIMS = ("source", "lang", "topic")
#: Where no targets are given, a value's target share goes with its token share to this power: rare values count for more.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.7}
KEEP = 0.5
MOST_ROUNDS, PER_TABLE, TOLERANCE, SETTLED = 500, 5, 1e-12, 1e-5
#: Rounds that the SQL takes, which can't stop by itself.
SQL_ROUNDS = 100
BROADCAST_CELLS = 100_000
SEED = "mix"
#: Topics by marks that a text has; the first that fits.
TOPICS = (("licence", "License"), ("credentials", "token ="), ("contact", "@"), ("tabular", " | "), ("shouting", "!!"), ("symbols", "$$$"))


def topic(text: Column) -> Column:
    out = F.lit("prose")
    for name, mark in reversed(TOPICS):
        out = F.when(F.contains(text, F.lit(mark)), F.lit(name)).otherwise(out)
    return out


def _measured(docs: DataFrame, topic_of: Column | None) -> DataFrame:
    text = F.coalesce(F.col(TEXT), F.lit(""))
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col(ID).cast("long").alias(ID), *(F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in ("source", "lang")), (topic(text) if topic_of is None else topic_of).alias("topic"), tokens.alias("n_tokens"))


def _shares(cells: DataFrame, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """``t_source`` and so on: the target share of each cell's value."""
    everything = Window.partitionBy()
    for d in DIMS:
        own = F.sum("tokens").over(Window.partitionBy(d))
        if targets and d in targets:
            wish = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in targets[d].items() for x in (k, float(v)))), F.col(d)), F.lit(0.0))
        else:
            wish = F.pow(own / F.sum("tokens").over(everything), F.lit(TEMPER[d]))
        wish = F.when(own > 0, wish).otherwise(0.0)
        first = F.row_number().over(Window.partitionBy(d).orderBy(*DIMS)) == 1
        cells = cells.withColumn("wish", wish).withColumn("once", F.when(first, F.col("wish")).otherwise(0.0))
        cells = cells.withColumn(f"t_{d}", F.col("wish") / F.nullif(F.sum("once").over(everything), F.lit(0.0))).drop("wish", "once")
    return cells


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``cells`` (``source``, ``lang``, ``topic``, ``tokens``) with ``raked``: shares of all tokens that fit the targets.

    Rounds go on until none moves a share by ``TOLERANCE``. Targets that contradict each other (a source that only has one language, and
    the two wish for different shares) settle too, with the last marginal met and the others as near as raking brings them. What hasn't
    settled after ``MOST_ROUNDS`` is an error, unless it moves by less than ``SETTLED``.
    """
    scratch = Scratch(cells.sparkSession, "rake")
    total = F.sum("tokens").over(Window.partitionBy())
    now = scratch.save(_shares(cells.coalesce(1), targets).withColumn("raked", F.col("tokens") / F.nullif(total, F.lit(0.0))))
    for _ in range(0, MOST_ROUNDS, PER_TABLE):
        step = now.drop("before").coalesce(1)  # the cells are one task's rows: the windows below need no exchange
        for _ in range(PER_TABLE):
            step = step.withColumn("before", F.col("raked"))
            for d in DIMS:
                have = F.sum("raked").over(Window.partitionBy(d))
                step = step.withColumn("raked", F.when(have > 0, F.col("raked") * F.col(f"t_{d}") / have).otherwise(0.0))
        new = scratch.save(step)
        moved = new.agg(F.max(F.abs(F.col("raked") - F.col("before")))).first()[0]
        scratch.drop(now)
        now = new
        if moved is None or moved < TOLERANCE:
            break
    else:
        if moved > SETTLED:
            raise ValueError(f"the targets don't settle: after {MOST_ROUNDS} rounds a share still moves by {moved:.2g}")
    return now.drop("before")


def calibrate(raked: DataFrame, keep: float = KEEP) -> DataFrame:
    """``ratio``, ``probability`` and ``weight`` of each cell, so that ``keep`` of the tokens are expected."""
    everything = Window.partitionBy()
    total = F.sum("tokens").over(everything)
    cells = raked.coalesce(1).withColumn("total", total.cast("double")).withColumn("ratio", F.when(F.col("tokens") > 0, F.col("raked") * F.col("total") / F.col("tokens")).otherwise(1.0))
    order = Window.partitionBy().orderBy(F.desc("ratio"), *DIMS)
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mass = F.col("ratio") * F.col("tokens")
    used = F.coalesce(F.sum(mass).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    cells = cells.withColumn("scale", (F.lit(keep) * F.col("total") - before) / F.nullif(F.sum(mass).over(everything) - used, F.lit(0.0)))
    # cells of the highest ratios that the constant lifts over 1 are sampled whole; it is solved for the rest
    fits = F.when((F.col("scale") * F.col("ratio") <= 1) & (F.col("tokens") > 0), F.struct(-F.col("ratio"), *DIMS, "scale"))
    scale = F.coalesce(F.min(fits).over(everything)["scale"], F.lit(1e18))
    p = F.least(F.lit(1.0), scale * F.col("ratio"))
    return cells.withColumn("probability", p).withColumn("weight", F.when(p > 0, F.col("ratio") / p)).select(*DIMS, "tokens", "raked", "ratio", "probability", "weight")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 up to 1, the same for the same id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _with_probability(docs: DataFrame, targets, keep: float, topic_of: Column | None) -> tuple[DataFrame, DataFrame]:
    measured = _measured(docs, topic_of)
    cells = measured.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"))
    table = Scratch(docs.sparkSession, "cells").save(calibrate(rake(cells, targets), keep))
    return measured, F.broadcast(table) if table.count() <= BROADCAST_CELLS else table


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, topic_of: Column | None = None) -> DataFrame:
    """The sample: ``doc_id``, ``source``, ``lang``, ``topic``, ``n_tokens``, ``probability``, ``weight``."""
    measured, cells = _with_probability(docs, targets, keep, topic_of)
    return measured.join(cells, list(DIMS)).filter(draw(F.col(ID)) < F.col("probability")).select(ID, *DIMS, "n_tokens", "probability", "weight")


def sample_rows(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, topic_of: Column | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with their own columns, whatever their names: each row travels as one struct beside its cell."""
    _, cells = _with_probability(docs, targets, keep, topic_of)
    cell = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in ("source", "lang")), (topic(F.coalesce(F.col(TEXT), F.lit(""))) if topic_of is None else topic_of).alias("topic"))
    rows = docs.select(F.struct("*").alias("row"), cell.alias("cell"))
    cells = cells.select(F.struct(*DIMS).alias("cell"), "probability")
    return rows.join(cells, "cell").filter(draw(F.col(f"row.{ID}")) < F.col("probability")).select("row.*")


def _sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mix_sql(documents: str = "documents", keep: float = KEEP, rounds: int = SQL_ROUNDS) -> str:
    """DuckDB SQL for ``mix`` with tempered targets, its numbers rounded as the query rounds them."""
    case = "CASE " + " ".join(f"WHEN contains(x, {_sql_literal(mark)}) THEN '{name}'" for name, mark in TOPICS) + " ELSE 'prose' END"
    goal = ", ".join(f"CASE WHEN own_{d} > 0 THEN (own_{d} / total) ** {TEMPER[d]} ELSE 0 END AS wish_{d}" for d in DIMS)
    own = ", ".join(f"sum(tokens) OVER (PARTITION BY {d}) AS own_{d}, row_number() OVER (PARTITION BY {d} ORDER BY source, lang, topic) AS rn_{d}" for d in DIMS)
    share = ", ".join(f"wish_{d} / sum(CASE WHEN rn_{d} = 1 THEN wish_{d} ELSE 0 END) OVER () AS t_{d}" for d in DIMS)
    keys = "source, lang, topic, tokens, t_source, t_lang, t_topic"
    inner = "SELECT * FROM ipf WHERE it < %d" % rounds
    for d in DIMS:
        inner = f"SELECT it, {keys}, CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * t_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w FROM ({inner})"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang FROM {documents}),
m AS (SELECT doc_id, source, lang, {case} AS topic, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM d),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM m GROUP BY ALL),
o AS (SELECT *, sum(tokens) OVER () AS total, {own} FROM c),
g AS (SELECT *, {goal} FROM o),
s AS (SELECT source, lang, topic, tokens, total, {share} FROM g),
ipf AS (SELECT 0 AS it, {keys}, tokens / total AS w FROM s UNION ALL SELECT it + 1, {keys}, w FROM ({inner})),
r AS (SELECT *, sum(tokens) OVER () AS total FROM ipf WHERE it = {rounds}),
q AS (SELECT *, CASE WHEN tokens > 0 THEN w * total / tokens ELSE 1 END AS ratio FROM r),
k AS (SELECT *, coalesce(sum(tokens) OVER o, 0) AS before, coalesce(sum(ratio * tokens) OVER o, 0) AS used, sum(ratio * tokens) OVER () AS mass FROM q
      WINDOW o AS (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, ({keep} * total - before) / nullif(mass - used, 0) AS scale FROM k),
f AS (SELECT coalesce((SELECT scale FROM z WHERE scale * ratio <= 1 AND tokens > 0 ORDER BY ratio DESC, source, lang, topic LIMIT 1), 1e18) AS scale),
p AS (SELECT source, lang, topic, ratio, least(1.0, (SELECT scale FROM f) * ratio) AS p FROM z)
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability, round(ratio / p, 6) AS weight
FROM m JOIN p USING (source, lang, topic)
WHERE ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < p
"""
