"""Exact ranks and prefix sums over tables that must not be sorted in one task.

A window without a selective partition key puts all its rows into one task. Here
the rows are range-partitioned on the sort key, each piece is scanned on its own,
and the totals of earlier pieces are added. At most one key group crosses each
piece border, so the broadcast offsets hold at most one row per piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.session import materialize

# A table known to be this small may be sorted by one task.
SINGLE_TASK_ROWS = 200_000


def _sort_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def prefix_scan(
    df: DataFrame,
    order: Sequence[str | Column],
    sums: dict[str, str | Column],
    within: Sequence[str] = (),
    following: dict[str, str] | None = None,
    pieces: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add exclusive running sums, ``sums = {output: expression}``, per ``within`` group.

    ``order`` must be total inside a group. ``following = {output: column}`` adds the
    value of that column in the next row of the group (NULL at its end; ascending order only).
    ``rows`` is the size of ``df`` where the caller knows it.
    """
    order = _sort_columns(order)
    within = list(within)
    following = following or {}
    if rows is not None and rows <= SINGLE_TASK_ROWS:
        return _plain_scan(df, order, sums, within, following)
    keys = [F.col(c) for c in within] + order
    ranged = df.repartitionByRange(pieces, *keys) if pieces else df.repartitionByRange(*keys)
    laid = materialize(ranged.withColumn("_piece", F.spark_partition_id()), "scan")
    laid = laid.select("*", *[_expr(e).alias(f"_v_{o}") for o, e in sums.items()])

    totals = laid.groupBy(*within, "_piece").agg(
        *[F.sum(f"_v_{o}").alias(f"_t_{o}") for o in sums],
        *[F.min_by(c, F.struct(*order)).alias(f"_f_{o}") for o, c in following.items()],
    )
    by_piece = Window.partitionBy(*within).orderBy("_piece")
    earlier = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *within,
        "_piece",
        F.row_number().over(by_piece).alias("_nth"),
        *[F.sum(f"_t_{o}").over(earlier).alias(f"_o_{o}") for o in sums],
        *[F.lead(f"_f_{o}").over(by_piece).alias(f"_n_{o}") for o in following],
        F.lead(F.lit(1)).over(by_piece).alias("_more"),
    ).where("_nth > 1 OR _more IS NOT NULL")
    joined = laid.join(F.broadcast(offsets), within + ["_piece"], "left")

    local = Window.partitionBy(*within, "_piece").orderBy(*order)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    out = [
        (F.coalesce(F.sum(f"_v_{o}").over(before), zero) + F.coalesce(F.col(f"_o_{o}"), zero)).alias(o)
        for o in sums
    ]
    out += [
        F.coalesce(F.lead(c).over(local), F.col(f"_n_{o}")).alias(o) for o, c in following.items()
    ]
    return joined.select(*[F.col(c) for c in df.columns], *out)


def _plain_scan(
    df: DataFrame, order: list[Column], sums: dict, within: list[str], following: dict[str, str]
) -> DataFrame:
    whole = Window.partitionBy(*within).orderBy(*order)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    out = [F.coalesce(F.sum(_expr(e)).over(before), F.lit(0)).alias(o) for o, e in sums.items()]
    out += [F.lead(c).over(whole).alias(o) for o, c in following.items()]
    return df.select("*", *out)


def exact_rank(
    df: DataFrame,
    order: Sequence[str | Column],
    out: str = "rank",
    within: Sequence[str] = (),
    pieces: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """``row_number()`` (1-based) without a single-task sort of a large table."""
    scanned = prefix_scan(df, order, {out: F.lit(1)}, within, pieces=pieces, rows=rows)
    return scanned.withColumn(out, (F.col(out) + 1).cast("bigint"))


def _expr(e: str | Column) -> Column:
    return F.col(e) if isinstance(e, str) else e

