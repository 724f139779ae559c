"""The fold cube: one aggregation from which every fold's fitted state follows.

All encoders but two are functions of ``(n, pos)`` per (column, level). Counting them once per
(outer fold, phase, out-of-fold part) gives the state fitted on a whole training side as a sum
of parts, and the state that excludes a part by subtraction, which is exact on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.session import materialize
from foldspark.sources.categories import Wide, to_long

SIDE = ["outer_fold", "phase"]
STATE = ["outer_fold", "phase", "part"]
FULL = -1  # part number of the state fitted on the whole training side


def fold_cube(assigned: DataFrame, columns: list[str]) -> DataFrame:
    """``outer_fold, phase, part, col, level → n, pos`` over the fitting roles.

    The explode feeds map-side partial aggregation, so what is shuffled is at most one cube
    per task and never the exploded rows. Rows of a wide table are counted without an explode.
    """
    if isinstance(columns, Wide):
        return materialize(_wide_cube(assigned, columns), "cube")
    fit = F.explode(F.filter("uses", lambda u: u["part"] >= 0)).alias("_use")
    long = to_long(assigned.select("y", fit, *columns), columns, ["y", "_use"])
    each = long.select("_use.outer_fold", "_use.phase", "_use.part", "col", "level", "y")
    cube = each.groupBy(*STATE, "col", "level").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    return materialize(cube, "cube")


PART_BITS = 16  # of the number of a (side, part)
HELD_CELLS = 1 << 22  # cells of a wide cube (states times levels) that a task holds before it hands them on
CHUNK_ROWS = 1 << 20  # values of a wide table that are counted at once


def _count_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial cubes ``state, col, level, n, pos`` of rows ``y, fits, levels``."""
    slots: dict[tuple[int, str | None], int] = {}  # of (column, level)
    held: dict[int, np.ndarray] = {}  # [2, slots] of a state: rows, positives

    def grown(state: int) -> np.ndarray:
        old = held.get(state)
        if old is None or old.shape[1] < len(slots):
            new = np.zeros((2, max(1024, 2 * len(slots))), np.int64)
            if old is not None:
                new[:, : old.shape[1]] = old
            held[state] = old = new
        return old

    def handed() -> Iterator[pa.RecordBatch]:
        col, level = (pa.array([k[i] for k in slots], t) for i, t in enumerate((pa.int32(), pa.string())))
        for state, (n, pos) in held.items():
            here = np.flatnonzero(n[: len(slots)])
            at = pa.array(here)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), state)), col.take(at), level.take(at), pa.array(n[here]), pa.array(pos[here])], ["state", "col", "level", "n", "pos"])
        slots.clear()
        held.clear()

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = batch.column("levels").value_lengths().to_numpy(zero_copy_only=False)
        step = max(1, int(CHUNK_ROWS // max(1, values.max())))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)

    for batch in batches:
        for some in parts(batch) if batch.num_rows else ():
            levels = some.column("levels")
            width = levels.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(width)])
            named = levels.flatten().dictionary_encode()
            code = named.indices.fill_null(len(named.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [*named.dictionary.to_pylist(), None]
            pair = (np.arange(first[-1]) - np.repeat(first[:-1], width)) * len(texts) + code
            found, inverse = np.unique(pair, return_inverse=True)
            number = np.array([slots.setdefault((p // len(texts), texts[p % len(texts)]), len(slots)) for p in found.tolist()], np.int64)
            slot = number[inverse]
            y = some.column("y").fill_null(0).to_numpy(zero_copy_only=False)
            fits = some.column("fits")
            row = np.repeat(np.arange(some.num_rows), fits.value_lengths().to_numpy(zero_copy_only=False))
            states = fits.flatten().to_numpy(zero_copy_only=False)
            even = slot.reshape(some.num_rows, -1) if (width == width[0]).all() else None

            def counted(rows: np.ndarray) -> np.ndarray:
                mine = even[rows].ravel() if even is not None else np.concatenate([slot[:0], *(slot[first[r] : first[r + 1]] for r in rows)])
                return np.bincount(mine, minlength=len(slots))

            for state in np.unique(states).tolist():
                mine, count = row[states == state], grown(state)
                count[0, : len(slots)] += counted(mine)
                for value in np.unique(y[mine]).tolist():
                    if value:
                        count[1, : len(slots)] += value * counted(mine[y[mine] == value])
            if len(slots) * max(1, len(held)) > HELD_CELLS:
                yield from handed()
    if slots:
        yield from handed()


def _wide_cube(assigned: DataFrame, columns: Wide) -> DataFrame:
    """The fold cube of a wide table; a value is counted as a number in its task, not as a record for each use."""
    number = lambda u: (u["outer_fold"] * 2 + F.when(u["phase"] == "outer", 1).otherwise(0)).cast("bigint") * (1 << PART_BITS) + u["part"]
    fits = F.transform(F.filter("uses", lambda u: u["part"] >= 0), number).alias("fits")
    rows = assigned.select(F.col("y").cast("bigint").alias("y"), fits, F.col(columns.array).alias("levels")).where(F.size("fits") > 0)
    partial = rows.mapInArrow(_count_wide, "state bigint, col int, level string, n bigint, pos bigint")
    whole = partial.groupBy("state", "col", "level").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    side = F.shiftright("state", PART_BITS)
    state = [F.floor(side / 2).cast("int").alias("outer_fold"), F.when(side % 2 == 1, "outer").otherwise("inner").alias("phase"), (F.col("state") % (1 << PART_BITS)).cast("int").alias("part")]
    return whole.select(*state, F.col("col").cast("string").alias("col"), "level", "n", "pos")


PACKED_ROWS = 1 << 32  # tables below have rows and positives of a cell in one long


def side_counts(assigned: DataFrame, columns: list[str], sides: int, parts: int) -> DataFrame:
    """What every state of few columns is fitted on, with one record per (col, level): its rows ``n`` in the table, and
    ``codes``, an array of rows (low 32 bits) and positives (high ones): for each side, those of the whole side and those
    outside each part.

    Rows are not told apart by their uses, so a column with a level for each row is grouped once and not once a use.
    """
    side = lambda u: (u["outer_fold"] * 2 + F.when(u["phase"] == "outer", 1).otherwise(0)).cast("int")
    found = F.map_from_entries(F.transform(F.filter("uses", lambda u: u["part"] >= 0), lambda u: F.struct(side(u), u["part"])))
    part = F.array(*[F.try_element_at(found, F.lit(s)) for s in range(sides)]).alias("_part")
    one = (F.lit(1) + F.coalesce(F.col("y"), F.lit(0)).cast("bigint") * F.lit(1 << 32)).alias("_one")
    long = to_long(assigned.select(one, part, *columns), columns, ["_one", "_part"])
    cells = [F.get("_part", F.lit(s)) != q for s in range(sides) for q in (FULL, *range(parts))]  # NULL: not fitted there
    sums = [F.coalesce(F.sum(F.when(here, F.col("_one"))), F.lit(0)).alias(f"c{i}") for i, here in enumerate(cells)]
    counted = long.groupBy("col", "level").agg(F.count("*").alias("n"), *sums)
    return materialize(counted.select("col", "level", "n", F.array(*[F.col(f"c{i}") for i in range(len(cells))]).alias("codes")), "counts", "col")


def rows_and_positives(cell: Column) -> tuple[Column, Column]:
    return cell.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(cell, 32)


def cube_of(counts: DataFrame, parts: int) -> DataFrame:
    """:func:`fold_cube` from :func:`side_counts`: a part is what the whole side has more than its outside."""
    each = counts.select("col", "level", "codes", F.posexplode("codes").alias("at", "outside")).where(F.col("at") % (parts + 1) > 0)
    side = F.floor(F.col("at") / (parts + 1)).cast("int")
    n, pos = rows_and_positives(F.get("codes", side * (parts + 1)) - F.col("outside"))
    phase = F.when(side % 2 == 1, "outer").otherwise("inner")
    state = [F.floor(side / 2).cast("int").alias("outer_fold"), phase.alias("phase"), (F.col("at") % (parts + 1) - 1).alias("part")]
    return materialize(each.select(*state, "col", "level", n.alias("n"), pos.alias("pos")).where("n > 0"), "cube")


def state_totals(cube: DataFrame, column: str) -> DataFrame:
    """Rows ``fit_n`` and positives ``fit_pos`` of every state: a few dozen records."""
    parts = cube.where(F.col("col") == column).groupBy(*STATE).agg(
        F.sum("n").alias("part_n"), F.sum("pos").alias("part_pos")
    )
    full = parts.groupBy(*SIDE).agg(F.sum("part_n").alias("fit_n"), F.sum("part_pos").alias("fit_pos"))
    without = parts.join(F.broadcast(full), SIDE).select(
        *STATE,
        (F.col("fit_n") - F.col("part_n")).alias("fit_n"),
        (F.col("fit_pos") - F.col("part_pos")).alias("fit_pos"),
    )
    return without.unionByName(full.withColumn("part", F.lit(FULL)))


def full_states(cube: DataFrame, column: str) -> DataFrame:
    """States fitted on whole training sides only (``part`` = -1), for label-free encoders."""
    counts = cube.groupBy(*SIDE, "col", "level").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    totals = state_totals(cube, column).where(F.col("part") == FULL)
    return counts.join(F.broadcast(totals), SIDE)


def all_states(cube: DataFrame, column: str) -> DataFrame:
    """Whole-side and out-of-fold states: ``STATE, col, level, n, pos, fit_n, fit_pos``.

    A level that occurs only in the excluded part has no row left and is dropped: it is unseen.
    """
    parts = range((cube.agg(F.max("part")).first()[0] or 0) + 1)  # k_oof sums of numbers, no list to gather
    sums = [F.sum(F.when(F.col("part") == q, F.col(c))).alias(f"{c}{q}") for c in ("n", "pos") for q in parts]
    counts = cube.groupBy(*SIDE, "col", "level").agg(F.sum("n").alias("side_n"), F.sum("pos").alias("side_pos"), *sums)
    each = counts.join(F.broadcast(state_totals(cube, column)), SIDE)

    def left_of(c: str) -> Column:
        own = F.get(F.array(*[F.col(f"{c}{q}") for q in parts]), F.col("part"))
        return F.col(f"side_{c}") - F.coalesce(own, F.lit(0))

    left = each.withColumns({"n": left_of("n"), "pos": left_of("pos")})
    return left.where("n > 0").select(*STATE, "col", "level", "n", "pos", "fit_n", "fit_pos")


def whole_states(rows: DataFrame, columns: list[str]) -> DataFrame:
    """State fitted on every row: the contaminated arm, or a plain fit without folds."""
    counts = to_long(rows, columns, ["y"]).groupBy("col", "level").agg(
        F.count("*").alias("n"), F.sum("y").alias("pos")
    )
    counts = materialize(counts, "whole")
    one = counts.where(F.col("col") == columns[0])
    return counts.withColumns(
        {
            "fit_n": one.agg(F.sum("n").alias("v")).scalar(),
            "fit_pos": one.agg(F.sum("pos").alias("v")).scalar(),
        }
    )
