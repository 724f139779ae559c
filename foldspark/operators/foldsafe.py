"""Fold-safe encoding: fit on a training side, code every row of every fold in one pass."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.operators import cube as cb
from foldspark.operators import encoders as enc
from foldspark.operators import homals as hm
from foldspark.operators.ordered import PERMUTATION_SEED, ordered_codes, whole_codes
from foldspark.operators.skew import lookup
from foldspark.operators.splits import SplitPlan
from foldspark.session import materialize
from foldspark.sources.categories import Wide, level_array, to_long

USE = ["outer_fold", "phase", "role"]
NARROW = 32  # up to so many codes a row are written out as one expression each
COUNTED = ("count", "target")  # encoders whose codes follow from the counts of a level in one record
PLAIN = ("label", "count", "target", "woe")  # encoders with one code a column, looked up in a small state


def _slot(fold: Column, phase: Column, part: Column, plan: SplitPlan) -> Column:
    """Position of a state in the packed code array of a level."""
    side = fold * 2 + F.when(phase == "outer", 1).otherwise(0)
    return (side * (plan.k_oof + 1) + part + 1).cast("int")


def pack_codes(codes: DataFrame, plan: SplitPlan) -> DataFrame:
    """One record per (column, level) with its code in every state (NULL: unseen there).

    The array length is fixed by the split plan, so a level costs one lookup per row for all
    folds instead of one per fold.
    """
    slot = _slot(F.col("outer_fold"), F.col("phase"), F.col("part"), plan)
    each = [F.max(F.when(F.col("_slot") == i, F.col("code"))).alias(f"_s{i}") for i in range(2 * plan.k * (plan.k_oof + 1))]
    packed = codes.withColumn("_slot", slot).groupBy("col", "level").agg(F.max("n").alias("n"), *each)
    dense = F.array(*[F.col(f"_s{i}") for i in range(len(each))])
    return materialize(packed.select("col", "level", "n", dense.alias("codes")), "codes", "col")


def _attach(rows: DataFrame, packed: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``_codes ARRAY<ARRAY<DOUBLE>>``: the packed codes of each category of a row.

    One lookup per column. A wide table is looked up in long form instead, and each row is
    put together again; only its m own entries meet in one group.
    """
    if isinstance(columns, Wide):
        long = to_long(rows, columns, ["row_id"])
        found = lookup(long, packed, ["col", "level"], ["row_id"])
        at = F.struct(F.col("col").cast("int").alias("i"), F.col("codes").alias("c"))
        per_row = found.groupBy("row_id").agg(F.array_sort(F.collect_list(at)).alias("_c"))
        per_row = per_row.select("row_id", F.transform("_c", lambda e: e["c"]).alias("_codes"))
        return rows.join(per_row, "row_id")
    sizes = {r["col"]: r["count"] for r in packed.groupBy("col").count().collect()}  # one per column
    for i, c in enumerate(columns):
        one = packed.where(F.col("col") == c).select(
            F.col("level").alias(c), "n", F.col("codes").alias(f"_codes{i}")
        )
        rows = lookup(rows, one, [c], ["row_id"], rows=sizes.get(c, 0))
    held = [f"_codes{i}" for i in range(len(columns))]
    return rows.withColumn("_codes", F.array(*held)).drop(*held)


def _narrow(columns: list[str]) -> bool:
    return not isinstance(columns, Wide) and len(columns) <= NARROW


def _pick(slot: Column, unseen: Column, width: int | None = None) -> Column:
    """The code of every category in one state; few are compiled as one expression each."""
    if width is not None:
        return F.array(*[F.coalesce(F.get(F.get("_codes", F.lit(i)), slot), unseen) for i in range(width)])
    return F.transform("_codes", lambda c: F.coalesce(F.get(c, slot), unseen))


def _each_use(assigned: DataFrame, held: str, carry: Sequence[str] = ()) -> DataFrame:
    kept = ["row_id", "y", *carry, held]
    return assigned.select(*kept, F.explode("uses").alias("_use")).select(*kept, "_use.*")


def code_rows(
    assigned: DataFrame,
    codes: DataFrame,
    columns: list[str],
    plan: SplitPlan,
    unseen: DataFrame | Column | float,
    whole_side: bool,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``row_id, y, carry…, outer_fold, phase, role, codes`` from fitted ``STATE, col, level, n, code``.

    ``unseen`` is the code of unseen levels, or a table of it per state. ``whole_side`` uses the
    whole-side state for all rows (label-free encoders).
    """
    blocks = _blocks(codes, columns)
    if blocks is None:
        each = _each_use(_attach(assigned.drop("n"), pack_codes(codes, plan), columns), "_codes", carry)
    else:
        slots = {f"_slots{i}": _slots_of(columns, b) for i, b in enumerate(blocks)}
        held = F.struct(*[x.alias(name) for name, x in slots.items()])
        each = _each_use(assigned.withColumn("_held", held), "_held", carry).select("*", "_held.*").drop("_held")
    if whole_side:
        each = each.withColumn("part", F.lit(cb.FULL))
    if isinstance(unseen, DataFrame):
        each = each.join(F.broadcast(unseen), cb.STATE)  # one record per state
    else:
        each = each.withColumn("_unseen", unseen if isinstance(unseen, Column) else F.lit(unseen))
    if blocks is None:
        slot = _slot(F.col("outer_fold"), F.col("phase"), F.col("part"), plan)
        return each.select("row_id", "y", *carry, *USE, _pick(slot, F.col("_unseen"), len(columns) if _narrow(columns) else None).alias("codes"))
    picked = []
    for i, block in enumerate(blocks):
        # one record per state; all blocks together are at most STATE_BYTES
        tables = _state_arrays(codes, columns, block).withColumnRenamed("_table", f"_table{i}")
        each = each.join(F.broadcast(tables), cb.STATE)
        picked.append(_picked(f"_slots{i}", f"_table{i}", block.last - block.first if _narrow(columns) else None))
    return each.select("row_id", "y", *carry, *USE, (F.concat(*picked) if len(picked) > 1 else picked[0]).alias("codes"))


def _code_by_counts(
    assigned: DataFrame, counts: DataFrame, columns: list[str], name: str, plan: SplitPlan, carry: Sequence[str] = ()
) -> DataFrame:
    """:func:`code_rows` of an encoder of ``COUNTED`` from ``cb.side_counts``: a row looks up the counts of its levels and has the
    codes of its own uses computed, so no record or code of a level is written per state."""
    encoder = enc.ENCODERS[name]
    first = counts.where(F.col("col") == columns[0])
    total = [F.sum(F.get("codes", F.lit(i))).alias(f"t{i}") for i in range(2 * plan.k * (plan.k_oof + 1))]
    states = first.agg(*total).select(F.posexplode(F.array(*[F.col(f"t{i}") for i in range(len(total))])).alias("slot", "t"))
    fit_n, fit_pos = cb.rows_and_positives(F.col("t"))
    states = materialize(states.select("slot", fit_n.alias("fit_n"), fit_pos.alias("fit_pos")), "totals")
    each = _each_use(_attach(assigned.drop("n"), counts, columns), "_codes", carry)
    part = F.col("part") if encoder.supervised else F.lit(cb.FULL)
    each = each.withColumn("slot", _slot(F.col("outer_fold"), F.col("phase"), part, plan)).join(F.broadcast(states), "slot")  # one record per state
    unseen = F.lit(encoder.unseen) if encoder.unseen is not None else F.col("fit_pos") / F.col("fit_n")
    codes = []
    for i in range(len(columns)):
        n, pos = cb.rows_and_positives(F.get(F.get("_codes", F.lit(i)), F.col("slot")))
        codes.append(F.when(n > 0, enc.FORMULAS[name](n, pos, F.col("fit_n"), F.col("fit_pos"))).otherwise(unseen))
    return each.select("row_id", "y", *carry, *USE, F.array(*codes).alias("codes"))


# ---- dictionaries of blocks of columns -------------------------------------------------------

BLOCK_SLOTS = 8192  # levels of a block of neighbouring columns
BLOCK_BYTES = 1 << 20  # of their texts
COLUMN_LEVELS = 256  # levels of one column
WIDE_TIMES = 32  # as many in a wide table, whose long lookup would move the packed codes of every column
STATE_BYTES = 256 << 20  # codes of all states that a task holds


@dataclass(frozen=True)
class _Block:
    """Columns ``first`` to ``last`` (exclusive) with a constant ``ARRAY<STRUCT<start, levels>>`` of ``size`` slots."""

    first: int
    last: int
    dictionary: Column
    size: int


def _blocks(codes: DataFrame, columns: list[str]) -> list[_Block] | None:
    """Dictionaries of all columns, offered only when their checked sizes are small; rows are then coded without any join
    on levels: no row is shuffled, however many columns there are."""
    levels = codes.groupBy("col", "level").agg(F.max("n").alias("n")).withColumn("b", F.octet_length("level"))
    per = levels.groupBy("col").agg(F.count("*").alias("k"), F.sum("b").alias("b"))
    top, size, longest, found = per.agg(F.max("k"), F.sum("k"), F.max("b"), F.count("*")).first()
    most = COLUMN_LEVELS * (WIDE_TIMES if isinstance(columns, Wide) else 1)
    if found != len(columns) or top > most or longest > BLOCK_BYTES:
        return None
    states = codes.select(*cb.STATE).distinct().count()
    if size * states * 16 > STATE_BYTES:
        return None
    often = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "level")))  # a search finds common levels first
    named = levels.groupBy("col").agg(F.transform(often, lambda e: e["level"]).alias("levels"), F.sum("b").alias("b"))
    out, entries, start, held, first = [], [], 0, 0, 0

    def close(last: int) -> None:
        dictionary = F.from_json(F.lit(json.dumps(entries)), "array<struct<start:int,levels:array<string>>>")
        out.append(_Block(first, last, dictionary, start))

    for row in sorted(named.select(_position(columns).alias("i"), "levels", "b").collect()):  # bounded: see above
        if entries and (start + len(row.levels) > BLOCK_SLOTS or held + row.b > BLOCK_BYTES):
            close(row.i)
            entries, start, held, first = [], 0, 0, row.i
        entries.append({"start": start, "levels": row.levels})
        start, held = start + len(row.levels), held + row.b
    close(len(columns))
    return out


def _picked(slots: str, table: str, width: int | None) -> Column:
    if width is not None:
        return F.array(*[F.coalesce(F.get(table, F.get(slots, F.lit(i))), F.col("_unseen")) for i in range(width)])
    return F.transform(slots, lambda s: F.coalesce(F.get(table, s), F.col("_unseen")))


def _slots_of(columns: list[str], block: _Block) -> Column:
    """Slot of the level of every column; few columns are compiled as one expression each, which a lambda is not."""
    if _narrow(columns):
        entries = [F.get(block.dictionary, F.lit(i)) for i in range(block.last - block.first)]
        return F.array(*[_slot_in(e, F.col(c)) for e, c in zip(entries, columns[block.first : block.last])])
    levels = F.slice(level_array(columns), block.first + 1, block.last - block.first)
    return F.zip_with(block.dictionary, levels, _slot_in)


def _position(columns: list[str]) -> Column:
    """0-based position of the column named in ``col``."""
    at = F.col("col") if isinstance(columns, Wide) else enc.column_positions(columns)
    return at.cast("int")


def _slot_in(entry: Column, level: Column) -> Column:
    """Slot of a level; NULL when the dictionary does not have it."""
    found = F.nullif(F.array_position(entry["levels"], level), F.lit(0))
    return (found + entry["start"] - 1).cast("int")


def _state_arrays(codes: DataFrame, columns: list[str], block: _Block) -> DataFrame:
    """Codes of every state as one array indexed by slot; NULL where a level is unseen.

    One record per state, of ``size`` codes.
    """
    at = _position(columns)
    entry = F.get(block.dictionary, at - block.first)
    mine = codes.where((at >= block.first) & (at < block.last))
    known = mine.select(*cb.STATE, "code", _slot_in(entry, F.col("level")).alias("slot"))
    every = codes.select(*cb.STATE).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(block.size - 1))))
    filled = every.join(known, [*cb.STATE, "slot"], "left")
    packed = filled.groupBy(*cb.STATE).agg(F.array_sort(F.collect_list(F.struct("slot", "code"))).alias("_t"))
    return packed.select(*cb.STATE, F.transform("_t", lambda e: e["code"]).alias("_table"))


def encode(
    assigned: DataFrame, columns: list[str], name: str, plan: SplitPlan = SplitPlan(),
    cube: DataFrame | None = None, permutation_seed: int = PERMUTATION_SEED, carry: Sequence[str] = (),
) -> DataFrame:
    """Fold-safe codes of every row in all its uses.

    Label-free encoders are fitted on the training side. Supervised ones give each training
    row the state that excludes its own part. The ordered statistic is its own cross-fit.
    ``carry`` names columns that are passed on (encoders of ``PLAIN`` only).
    """
    encoder = enc.ENCODERS[name]
    if cube is None and name in COUNTED and _narrow(columns):
        counts = cb.side_counts(assigned, columns, 2 * plan.k, plan.k_oof)
        levels, rows = counts.groupBy("col").agg(F.count("*").alias("k"), F.sum("n").alias("n")).agg(F.max("k"), F.max("n")).first()
        if rows is not None and rows < cb.PACKED_ROWS:
            if levels > COLUMN_LEVELS:
                return _code_by_counts(assigned, counts, columns, name, plan, carry)
            cube = cb.cube_of(counts, plan.k_oof)
    cube = fold_cube(assigned, columns) if cube is None else cube
    codes, unseen = _fitted(cube, columns, name)
    if name != "ordered":
        return code_rows(assigned, codes, columns, plan, unseen, not encoder.supervised, carry)
    held_out = F.filter("uses", lambda u: u["part"] < 0)
    others = code_rows(assigned.withColumn("uses", held_out), codes, columns, plan, unseen, True)
    totals = cb.state_totals(cube, columns[0])
    return ordered_fit_codes(assigned, totals, columns, plan, permutation_seed).unionByName(others)


fold_cube = cb.fold_cube


def _fitted(cube: DataFrame, columns: list[str], name: str) -> tuple[DataFrame, DataFrame | float | Column]:
    """Codes of all fitted states, and the code of a level that a state has not seen."""
    encoder = enc.ENCODERS[name]
    own_part = encoder.supervised and name != "ordered"
    states = (cb.all_states if own_part else cb.full_states)(cube, columns[0])
    codes = materialize(encoder.codes(states, cb.STATE).select(*cb.STATE, "col", "level", "n", "code"), "states")
    if encoder.unseen is not None:
        return codes, encoder.unseen
    totals = cb.state_totals(cube, columns[0])
    return codes, totals.select(*cb.STATE, (F.col("fit_pos") / F.col("fit_n")).alias("_unseen"))


def encode_scaled(
    assigned: DataFrame, columns: list[str], name: str, plan: SplitPlan = SplitPlan(), cube: DataFrame | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """:func:`scale_foldsafe` of the codes of an encoder of ``PLAIN``, as ``scaled``, without a pass over the rows for the bounds.

    The training rows of a part with one level share a code, and the cube lists these: their extremes are those of the rows.
    """
    whole_side = not enc.ENCODERS[name].supervised
    cube = fold_cube(assigned, columns) if cube is None else cube
    codes, unseen = _fitted(cube, columns, name)
    occurring = cube.withColumn("part", F.lit(cb.FULL)) if whole_side else cube
    found = occurring.select(*cb.STATE, "col", "level").join(codes.drop("n"), [*cb.STATE, "col", "level"], "left")
    if isinstance(unseen, DataFrame):
        found = found.join(F.broadcast(unseen), cb.STATE)  # one record per state
    else:
        found = found.withColumn("_unseen", unseen if isinstance(unseen, Column) else F.lit(unseen))
    code = F.coalesce("code", "_unseen").cast("double")
    per = found.groupBy(*cb.SIDE, _position(columns).alias("i")).agg(F.min(code).alias("lo"), F.max(code).alias("hi"))
    packed = per.groupBy(*cb.SIDE).agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("bounds"))
    coded = code_rows(assigned, codes, columns, plan, unseen, whole_side, carry)
    return scale(coded, materialize(packed, "bounds"), cb.SIDE, len(columns) if _narrow(columns) else None)


def ordered_fit_codes(
    assigned: DataFrame, totals: DataFrame, columns: list[str], plan: SplitPlan, seed: int = PERMUTATION_SEED
) -> DataFrame:
    """Ordered codes of the training rows of every (fold, phase); all sides share one scan per permutation."""
    sides = [(f, p) for f in range(plan.k) for p in ("inner", "outer")]
    priors = {(r.outer_fold, r.phase): r.fit_pos / r.fit_n for r in totals.where(F.col("part") == cb.FULL).collect()}

    def fits_in(fold: int, phase: str) -> Column:
        return F.exists(
            "uses", lambda u: (u["outer_fold"] == fold) & (u["phase"] == phase) & (u["part"] >= 0)
        )

    mask = sum((F.when(fits_in(*side), 1 << i).otherwise(0) for i, side in enumerate(sides)), F.lit(0))
    coded = ordered_codes(assigned, columns, mask, [priors[side] for side in sides], seed)
    named = [
        F.struct(
            F.lit(f).alias("outer_fold"), F.lit(p).alias("phase"),
            F.lit("inner_train" if p == "inner" else "train").alias("role"),
        )
        for f, p in sides
    ]
    use = F.get(F.array(*named), F.col("side"))
    return coded.select("row_id", "y", use.alias("_use"), "codes").select("row_id", "y", "_use.*", "codes")


def ordered_whole_codes(rows: DataFrame, columns: list[str], seed: int = PERMUTATION_SEED) -> DataFrame:
    """Ordered codes of a plain fit on all rows; each permutation is a shuffle of all rows by a seeded hash of their ids."""
    prior, n_rows = rows.agg(F.sum("y") / F.count("*"), F.count("*")).first()
    return whole_codes(rows, columns, prior, n_rows, seed)


def encode_onehot(
    assigned: DataFrame, columns: list[str], plan: SplitPlan = SplitPlan(), cube: DataFrame | None = None
) -> DataFrame:
    """Fold-safe one-hot codes as active slots (one per column) and the code width."""
    cube = fold_cube(assigned, columns) if cube is None else cube
    states = materialize(cb.full_states(cube, columns[0]), "states")
    slots = enc.onehot_slots(states, columns, cb.STATE).withColumn("code", F.col("slot").cast("double"))
    codes = materialize(slots.select(*cb.STATE, "col", "level", "n", "code"), "slots")
    coded = code_rows(assigned, codes, columns, plan, -1.0, True)
    blocks = enc.onehot_blocks(states, columns, cb.STATE)
    at = F.struct(_position(columns).alias("i"), F.col("unseen_slot").cast("int").alias("s"))
    per_state = blocks.groupBy(*cb.SIDE).agg(
        F.array_sort(F.collect_list(at)).alias("_unseen"),
        F.sum(F.col("levels") + 1).cast("int").alias("width"),
    )
    each = coded.join(F.broadcast(per_state), cb.SIDE)  # 2k records
    active = F.zip_with("codes", "_unseen", lambda c, u: F.when(c < 0, u["s"]).otherwise(c.cast("int")))
    return each.select("row_id", "y", *USE, active.alias("slots"), "width")


def encode_homals(assigned: DataFrame, columns: list[str], plan: SplitPlan = SplitPlan()) -> DataFrame:
    """Fold-safe quantifications: two codes per column; an unseen level is the origin."""
    fit = F.explode(F.filter("uses", lambda u: u["part"] >= 0)).alias("_use")
    each = assigned.select(*columns, fit).select(*columns, "_use.outer_fold", "_use.phase")
    quants = hm.fit(each, columns, tuple(cb.SIDE))
    codes = quants.select(*cb.SIDE, F.lit(cb.FULL).alias("part"), "col", "level", "n", F.array("q1", "q2").alias("code"))
    origin = F.array(F.lit(0.0), F.lit(0.0))
    coded = code_rows(assigned, materialize(codes, "states"), columns, plan, origin, True)
    return coded.withColumn("codes", F.flatten("codes"))


class TooWideError(ValueError):
    """The one-hot code of a training side is wider than the cap."""


def encode_any(
    assigned: DataFrame, columns: list[str], name: str, plan: SplitPlan = SplitPlan(), cube: DataFrame | None = None
) -> DataFrame:
    """Dense fold-safe codes of any encoder, by name."""
    if name == "onehot":
        cube = fold_cube(assigned, columns) if cube is None else cube
        inner = cb.full_states(cube, columns[0]).where("phase = 'inner'")
        wide = enc.onehot_eligibility(inner, ["outer_fold"]).where("status <> 'ELIGIBLE'").count()
        if wide:
            raise TooWideError(f"{wide} folds exceed {enc.ONEHOT_WIDTH_CAP} columns")
        coded = encode_onehot(assigned, columns, plan, cube)
        return coded.select("row_id", "y", *USE, dense_slots(F.col("slots"), F.col("width")).alias("codes"))
    if name in ("hash_column", "hash_shared"):
        coded = encode_hash(assigned, columns, name == "hash_column", cube)
        dense = enc.dense_counts(F.col("slots"), F.col("counts"), F.col("buckets"))
        return coded.select("row_id", "y", *USE, dense.alias("codes"))
    if name == "homals":
        return encode_homals(assigned, columns, plan)
    return encode(assigned, columns, name, plan, cube)


def dense_slots(slots: Column, width: Column) -> Column:
    """0/1 vector of a row from its active slots, which ascend with the columns."""
    return enc.dense_counts(slots, F.transform(slots, lambda s: F.lit(1.0)), width)


def encode_hash(
    assigned: DataFrame, columns: list[str], column_aware: bool, cube: DataFrame | None = None
) -> DataFrame:
    """Fold-safe hashed counts: only the bucket width is fitted, per training side.

    Codes are sparse, ``slots ARRAY<INT>`` with their ``counts``.
    """
    cube = fold_cube(assigned, columns) if cube is None else cube
    widths = enc.hash_width(cube.select(*cb.SIDE, "col", "level").distinct(), columns, cb.SIDE)
    widths = materialize(widths.select(*cb.SIDE, "buckets"), "widths")  # 2k records
    # the width rule has four values: a row is counted once for each that occurs, not once a use
    occurring = F.explode(widths.agg(F.collect_set("buckets")).scalar()).alias("buckets")
    each = assigned.select("row_id", "y", "uses", enc.row_hashes(columns, column_aware).alias("_h"), occurring)
    counted = enc.with_bucket_counts(each, enc.buckets_of(F.col("_h"), F.col("buckets"))).drop("_h")
    used = counted.select("row_id", "y", "slots", "counts", "buckets", F.explode("uses").alias("_use"))
    used = used.select("row_id", "y", "slots", "counts", "buckets", "_use.*").join(F.broadcast(widths), [*cb.SIDE, "buckets"])
    return used.select("row_id", "y", *USE, "slots", "counts", "buckets")


def encode_global(assigned: DataFrame, columns: list[str], name: str, carry: Sequence[str] = ()) -> DataFrame:
    """Contrast arm: fitted on all rows, labels of test rows included. Labelled as such."""
    encoder = enc.ENCODERS[name]
    states = cb.whole_states(assigned, columns)
    codes = encoder.codes(states, ())
    table = materialize(codes.select("col", "level", "n", F.array("code").alias("codes")), "codes", "col")
    wide = _attach(assigned.drop("n"), table, columns)
    if _narrow(columns):  # every level was fitted
        codes = F.array(*[F.get(F.get("_codes", F.lit(i)), F.lit(0)) for i in range(len(columns))])
    else:
        codes = F.transform("_codes", lambda c: c[0])
    kept = ["row_id", "y", *carry]
    coded = wide.select(*kept, codes.alias("codes"), "uses")  # before the uses are told apart
    each = coded.select(*kept, "codes", F.explode("uses").alias("_use"))
    return each.select(*kept, "_use.outer_fold", "_use.phase", "_use.role", "codes").withColumn(
        "protocol", F.lit("global")
    )


def apply_plain(rows: DataFrame, states: DataFrame, columns: list[str], unseen: Column) -> DataFrame:
    """Codes of rows under one plain fitted state (``col, level, n, code``)."""
    table = materialize(states.select("col", "level", "n", F.array("code").alias("codes")), "codes", "col")
    wide = _attach(rows, table, columns)
    return wide.withColumn("codes", _pick(F.lit(0), unseen)).drop("_codes")


# ---- scaling ---------------------------------------------------------------------------------


def scaler_bounds(coded: DataFrame, keys: list[str], fit: Column, width: int | None = None) -> DataFrame:
    """Minimum and maximum of every code position over the fitting rows of each state; ``width``: codes a row, where few."""
    if width is not None:
        at = [(F.lit(i).alias("i"), F.get("codes", F.lit(i))) for i in range(width)]
        each = coded.where(fit).groupBy(*keys).agg(*[f(v).alias(f"{n}{i}") for i, (_, v) in enumerate(at) for n, f in (("lo", F.min), ("hi", F.max))])
        found = [F.struct(at[i][0], F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i in range(width)]
        return each.select(*keys, F.array(*found).alias("bounds"))
    long = coded.where(fit).select(*keys, F.posexplode_outer("codes").alias("i", "v"))
    per = long.groupBy(*keys, "i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    packed = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("bounds"))
    return packed


def scale(coded: DataFrame, bounds: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """Min-max to [0, 1] with clipping; a constant position becomes 0."""
    joined = coded.join(F.broadcast(bounds), keys)  # one record per state

    def one(v: Column, b: Column) -> Column:
        span = b["hi"] - b["lo"]
        unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(v - b["lo"], span)))
        return F.when(span > 0, unit).otherwise(0.0)

    if width is not None:
        each = [one(F.get("codes", F.lit(i)), F.get("bounds", F.lit(i))) for i in range(width)]
        return joined.withColumn("scaled", F.array(*each)).drop("bounds")
    return joined.withColumn("scaled", F.zip_with("codes", "bounds", one)).drop("bounds")


def scale_foldsafe(coded: DataFrame, width: int | None = None) -> DataFrame:
    """Scaler fitted on the training-side codes of each (fold, phase) only."""
    fit = F.col("role").isin("inner_train", "train")
    return scale(coded, scaler_bounds(coded, cb.SIDE, fit, width), cb.SIDE, width)


def own_label_gap(coded: DataFrame, keys: list[str]) -> DataFrame:
    """Mean code of positives minus mean code of negatives, per code position."""
    long = coded.select(*keys, "y", F.posexplode_outer("codes").alias("i", "v"))
    gap = F.avg(F.when(F.col("y") == 1, F.col("v"))) - F.avg(F.when(F.col("y") == 0, F.col("v")))
    return long.groupBy(*keys, F.col("i").alias("position")).agg(gap.alias("gap"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
