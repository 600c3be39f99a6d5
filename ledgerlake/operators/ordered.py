"""Ordered per-key scans that split one key over many tasks.

A window partitioned by a key alone puts the whole key into one task, so one customer holding a
third of all rows would stall the job. Here a key's rows are cut into consecutive segments (a day,
a month). Windows run per (key, segment); what crosses a segment border comes from a one-row summary
per (key, segment), built with map-side aggregation and scanned in a second, far smaller window. The
result does not depend on the segment width, only the size of the largest task does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F


def segmented_scan(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: str,
    carry: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    running: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add columns computed along ``order`` (ascending, total within a key) for each key.

    ``carry``   output -> column: its last non-null value up to and including the row.
    ``lead``    output -> column: its value in the following row, null on the last row.
    ``running`` output -> column: its sum up to and including the row.

    ``segment`` must not decrease along ``order``.
    """
    carry, lead, running = dict(carry or {}), dict(lead or {}), dict(running or {})
    cells = [*keys, segment]
    position = F.struct(*[F.col(c) for c in order])

    inside = Window.partitionBy(*cells).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select(
        "*",
        *[F.last(c, ignorenulls=True).over(so_far).alias(f"__in_{o}") for o, c in carry.items()],
        *[F.lead(F.struct(c)).over(inside).alias(f"__in_{o}") for o, c in lead.items()],
        *[F.sum(c).over(so_far).alias(f"__in_{o}") for o, c in running.items()],
    )

    summary = rows.groupBy(*cells).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(o) for o, c in carry.items()],
        *[F.min_by(F.struct(c), position).alias(o) for o, c in lead.items()],
        *[F.sum(c).alias(o) for o, c in running.items()],
    )
    across = Window.partitionBy(*keys).orderBy(segment)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    borders = summary.select(
        *cells,
        *[F.last(o, ignorenulls=True).over(before).alias(f"__out_{o}") for o in carry],
        *[F.lead(o).over(across).alias(f"__out_{o}") for o in lead],
        *[F.sum(o).over(before).alias(f"__out_{o}") for o in running],
    )

    scanned = local.join(borders, cells, "left")
    both = {o: (F.col(f"__in_{o}"), F.col(f"__out_{o}")) for o in [*carry, *lead, *running]}
    return scanned.select(
        *[F.col(c) for c in rows.columns],
        *[F.coalesce(*both[o]).alias(o) for o in carry],
        *[F.coalesce(*both[o])[c].alias(o) for o, c in lead.items()],
        *[(F.coalesce(both[o][0], F.lit(0)) + F.coalesce(both[o][1], F.lit(0))).alias(o) for o in running],
    )


def segment_of(timestamp: str, grain: str = "day"):
    return F.date_trunc(grain, F.col(timestamp))
