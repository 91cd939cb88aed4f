"""Ordered scans of a group in several tasks: what a row needs of the rows before it, without the whole group in one.

A group is cut into slots along its order. Windows run within a slot; each slot gives one row of what it hands on (its last row's values, its last
values that aren't null, its sums); these few rows meet by group, and each slot's rows get what came before their slot. The results are those of
windows over the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a recording whose frames are one task's.
SLOT = 3600.0
KEY = "_slot_key"


def time_slot(ts: Column, seconds: float = SLOT) -> Column:
    """A number that doesn't fall along the order of ``ts``: nulls first, NaN last."""
    ts = ts.cast("double")
    return F.when(F.isnan(ts), F.lit(2**63 - 1)).otherwise(F.floor(ts / seconds))


def keyed(rows: DataFrame, slot: Column, group: str = "group_id") -> DataFrame:
    """``rows`` with the key of their slot (``KEY``), for one or several scans. As a struct it is never null, whatever it holds."""
    return rows.withColumn(KEY, F.struct(F.col(group).alias("of"), slot.alias("slot")))


def scan(rows: DataFrame, order: list[str], before: dict[str, Column] | None = None, last: dict[str, Column] | None = None, total: dict[str, Column] | None = None) -> DataFrame:
    """``keyed`` rows with more columns, each over the rows of the group in ``order``: ``before``, the value of the row before; ``last``, the last value up to
    this row that isn't null; ``total``, the sum over the rows before this one (0 for the first).
    """
    before, last, total = before or {}, last or {}, total or {}
    w, at = Window.partitionBy(KEY).orderBy(*order), F.struct(*order)
    earlier, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns(
        {f"_in_{n}": F.lag(F.struct(c.alias("v"))).over(w) for n, c in before.items()}
        | {f"_in_{n}": F.last(F.when(c.isNotNull(), F.struct(c.alias("v"))), ignorenulls=True).over(upto) for n, c in last.items()}
        | {f"_in_{n}": F.sum(c).over(earlier) for n, c in total.items()}
    )
    edges = rows.groupBy(KEY).agg(
        *(F.max_by(F.struct(c.alias("v")), at).alias(n) for n, c in before.items()),
        *(F.max_by(F.struct(c.alias("v")), F.when(c.isNotNull(), at)).alias(n) for n, c in last.items()),
        *(F.sum(c).alias(n) for n, c in total.items()),
    )
    so = Window.partitionBy(f"{KEY}.of").orderBy(f"{KEY}.slot")
    slots = so.rowsBetween(Window.unboundedPreceding, -1)
    handed = edges.select(
        KEY,
        *(F.lag(n).over(so).alias(f"_of_{n}") for n in before),
        *(F.last(n, ignorenulls=True).over(slots).alias(f"_of_{n}") for n in last),
        *(F.sum(n).over(slots).alias(f"_of_{n}") for n in total),
    )
    out = within.join(handed, KEY)
    found = {n: F.coalesce(f"_in_{n}", f"_of_{n}")["v"] for n in (*before, *last)}
    found |= {n: F.coalesce(f"_in_{n}", F.lit(0)) + F.coalesce(f"_of_{n}", F.lit(0)) for n in total}
    return out.withColumns(found).drop(*(f"_{k}_{n}" for n in found for k in ("in", "of")))
