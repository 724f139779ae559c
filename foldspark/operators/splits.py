"""Deterministic group-aware folds, dealt by exact ranks instead of a greedy loop.

All functions work on the group table ``(group_id, n, pos)``: rows never move, a hot group
is one record. The result is the table of *uses*, one record per (group, outer fold, phase):

    group_id, outer_fold, phase {inner, outer}, role, part

``role`` is inner_train / inner_val in the inner phase and train / test in the outer one;
``part`` is the out-of-fold part of a fitting role and -1 for the held-out roles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.functions.hashing import seeded_md5, set_hash
from foldspark.operators.groups import group_overlap
from foldspark.operators.scan import exact_rank
from foldspark.operators.skew import lookup
from foldspark.session import materialize


class SplitError(ValueError):
    """The groups cannot be split as asked (too few, or one side would be empty)."""


@dataclass(frozen=True)
class SplitPlan:
    """Number of folds and the seeds of the three dealings."""

    k: int = 5
    seed_outer: int = 42
    seed_inner: int = 421
    inner_share: float = 0.2
    k_oof: int = 5
    seed_oof_inner: int = 4211
    seed_oof_outer: int = 4211 + 7


def group_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("group_id").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


def _serpentine(i: Column, hands: Column) -> Column:
    """Deal 0,1,…,h-1,h-1,…,1,0,0,1,… so that early hands are not favoured."""
    m = F.pmod(i, hands)
    return F.when(F.pmod(F.floor(i / hands), F.lit(2)) == 0, m).otherwise(hands - 1 - m)


def outer_folds(groups: DataFrame, plan: SplitPlan = SplitPlan()) -> DataFrame:
    """Test fold of every group, from largest to smallest.

    A group larger than a fold takes a fold for itself; the rest is dealt to the others.
    """
    groups = materialize(groups, "groups")
    count, total, top = groups.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    if count < plan.k:
        raise SplitError(f"{count} groups for {plan.k} folds")
    # fewer than k groups can each exceed 1/k of the rows
    whole = groups.where(F.col("n") * plan.k > total).count() if top * plan.k > total else 0
    keyed = groups.withColumn("_h", seeded_md5(plan.seed_outer, F.col("group_id")))
    ranked = exact_rank(keyed, [F.col("n").desc(), F.col("pos").desc(), F.col("_h")], "_r", rows=count)
    hand = _serpentine(F.col("_r") - whole - 1, F.lit(plan.k - whole)) + whole
    fold = F.when(F.col("_r") <= whole, F.col("_r") - 1).otherwise(hand)
    return ranked.select("group_id", "n", "pos", fold.cast("int").alias("test_fold"))


def inner_holdout(dealt: DataFrame, plan: SplitPlan = SplitPlan()) -> DataFrame:
    """Validation flag of every training group of every outer fold.

    Groups that fit (at most 1.25 of the wanted validation rows) are ranked like the outer
    folds and taken at an even stride, which fills the wanted share without overshooting.
    """
    outer = F.explode(F.sequence(F.lit(0), F.lit(plan.k - 1))).alias("outer_fold")
    side = dealt.select("group_id", "n", "pos", "test_fold", outer).where("outer_fold <> test_fold")
    # k records: broadcast by construction
    want = side.groupBy("outer_fold").agg(
        (F.sum("n") * F.lit(plan.inner_share)).alias("target"), F.sum("pos").alias("side_pos")
    )
    side = side.join(F.broadcast(want), "outer_fold").withColumn(
        "fits", F.col("n") <= F.col("target") * 1.25
    )
    side = side.withColumn("_h", seeded_md5(F.col("outer_fold") + plan.seed_inner, F.col("group_id")))
    order = [F.col("n").desc(), F.col("pos").desc(), F.col("_h")]
    rows = dealt.count() * plan.k
    side = exact_rank(side, order, "_r", within=["outer_fold", "fits"], rows=rows)
    fit = side.where("fits").groupBy("outer_fold").agg(
        F.sum("n").alias("fit_rows"), F.count("*").alias("fit_groups")
    )
    stride = F.least(F.lit(1.0), F.col("target") / F.col("fit_rows"))
    r = F.col("_r")
    taken = F.floor(r * F.col("stride")) > F.floor((r - 1) * F.col("stride"))
    lone = (r == F.col("fit_groups")) & (F.floor(F.col("fit_groups") * F.col("stride")) == 0)
    flagged = side.join(F.broadcast(fit), "outer_fold", "left").withColumn("stride", stride)
    flagged = flagged.withColumn("is_val", F.col("fits") & (taken | lone))
    flagged = materialize(
        flagged.select("group_id", "outer_fold", "n", "pos", "side_pos", "_h", "is_val"), "holdout"
    )
    sides = flagged.groupBy("outer_fold").agg(
        F.count_if("is_val").alias("n_val"),
        F.count_if(~F.col("is_val")).alias("n_fit"),
        F.coalesce(F.sum(F.when(F.col("is_val"), F.col("pos"))), F.lit(0)).alias("val_pos"),
    ).collect()  # k records
    if len(sides) < plan.k or any(s.n_val == 0 or s.n_fit == 0 for s in sides):
        raise SplitError("degenerate inner split")
    out = flagged.select("group_id", "outer_fold", "n", "is_val")
    lacking = [s.outer_fold for s in sides if s.val_pos == 0]
    if not lacking:
        return out
    # a validation side without positives gets the smallest positive group that leaves some
    spare = flagged.where("NOT is_val AND pos > 0 AND pos < side_pos").where(F.col("outer_fold").isin(lacking))
    moved = spare.groupBy("outer_fold").agg(F.min(F.struct("n", "_h", "group_id")).alias("m"))
    moved = moved.select("outer_fold", "m.group_id", F.lit(True).alias("moved"))
    out = out.join(F.broadcast(moved), ["outer_fold", "group_id"], "left")
    is_val = (F.col("is_val") | F.col("moved").isNotNull()).alias("is_val")
    return out.select("group_id", "outer_fold", "n", is_val)


def oof_parts(sides: DataFrame, plan: SplitPlan = SplitPlan(), rows: int | None = None) -> DataFrame:
    """Out-of-fold part per (outer fold, phase, group): a function of ids, groups and seed only.

    ``sides`` holds ``group_id, n, outer_fold, phase, role``; there is no label in it, so no label
    can influence the partition.
    """
    sides = sides.select("group_id", "n", "outer_fold", "phase", "role")
    seed = F.when(F.col("phase") == "inner", plan.seed_oof_inner).otherwise(plan.seed_oof_outer)
    ranked = exact_rank(
        sides.withColumn("_h", seeded_md5(seed, F.col("group_id"))), ["_h", "group_id"], "_r",
        within=["outer_fold", "phase"], rows=rows,
    )
    size = sides.groupBy("outer_fold", "phase").agg(F.count("*").alias("_g"))
    hands = F.greatest(F.lit(2), F.least(F.lit(plan.k_oof), F.col("_g")))
    part = F.pmod(F.col("_r") - 1, hands).cast("int").alias("part")
    return ranked.join(F.broadcast(size), ["outer_fold", "phase"]).select(*sides.columns, part)


def fold_uses(rows: DataFrame, plan: SplitPlan = SplitPlan()) -> DataFrame:
    """The complete split of a row set: a materialized table of uses with group sizes."""
    return uses_of(materialize(outer_folds(group_table(rows), plan), "dealt"), plan)


def uses_of(dealt: DataFrame, plan: SplitPlan = SplitPlan()) -> DataFrame:
    """Uses from the outer folds of the groups."""
    inner = inner_holdout(dealt, plan).select(
        "group_id",
        "n",
        "outer_fold",
        F.lit("inner").alias("phase"),
        F.when(F.col("is_val"), "inner_val").otherwise("inner_train").alias("role"),
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(plan.k - 1))).alias("outer_fold")
    outer = dealt.select("group_id", "n", every, "test_fold").select(
        "group_id",
        "n",
        "outer_fold",
        F.lit("outer").alias("phase"),
        F.when(F.col("outer_fold") == F.col("test_fold"), "test").otherwise("train").alias("role"),
    )
    roles = inner.unionByName(outer)
    fitting = F.col("role").isin("inner_train", "train")
    held_out = roles.where(~fitting).withColumn("part", F.lit(-1))
    rows = dealt.count() * 2 * plan.k
    return materialize(oof_parts(roles.where(fitting), plan, rows).unionByName(held_out), "uses")


def uses_by_group(uses: DataFrame) -> DataFrame:
    """One record per group with its 2k-1 uses as an array."""
    use = F.struct("outer_fold", "phase", "role", "part")
    packed = uses.groupBy("group_id").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(use)).alias("uses")
    )
    return materialize(packed, "packed")


def assign(rows: DataFrame, uses: DataFrame, spread: str = "row_id") -> DataFrame:
    """Attach the uses of its group to every row; a hot group is salted."""
    return lookup(rows, uses_by_group(uses), ["group_id"], [spread], how="inner")


def fold_fingerprint(assigned: DataFrame) -> DataFrame:
    """Order-free hash of the row ids on each side of each fold."""
    each = assigned.select("row_id", F.explode("uses").alias("_use"))
    return each.groupBy("_use.outer_fold", "_use.phase", "_use.role").agg(*set_hash(F.col("row_id")))


def split_report(uses: DataFrame, groups: DataFrame) -> DataFrame:
    """Sizes, class counts, groups and overlaps per outer fold, from group tables alone."""
    each = uses.join(groups.select("group_id", "pos"), "group_id")

    def total(column: Column, role: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("role") == role, column)), F.lit(0))

    report = []
    for role in ("train", "inner_train", "inner_val", "test"):
        n, pos = total(F.col("n"), role), total(F.col("pos"), role)
        counts = F.concat((n - pos).cast("string"), F.lit("|"), pos.cast("string"))
        report += [n.alias(f"n_{role}"), counts.alias(f"{role}_class_counts")]
    outer = F.col("phase") == "outer"
    mixed = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    report += [F.count_if(outer).alias("n_groups"), F.count_if(mixed & outer).alias("label_conflicts")]
    per_fold = each.groupBy("outer_fold").agg(*report)

    def overlap(phase: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("phase") == phase, F.col("n_overlap"))), F.lit(0))

    both = group_overlap(uses).groupBy("outer_fold").agg(
        overlap("outer").alias("train_test_group_overlap"), overlap("inner").alias("inner_group_overlap")
    )
    return per_fold.join(F.broadcast(both), "outer_fold")  # k records
