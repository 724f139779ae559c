"""Lineage of fitted states: which rows and labels each one saw, and proof of exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.functions.hashing import md5_prefix, set_hash
from foldspark.operators.cube import SIDE


class LeakageError(RuntimeError):
    """A fitted state saw rows it must not see. Always fatal."""


def idset_hash(rows: DataFrame, keys: list[str], ident: str = "row_id") -> DataFrame:
    """Order-free hash of a set of ids per key."""
    return rows.groupBy(*keys).agg(*set_hash(F.col(ident)))


def config_hash(config: DataFrame, columns: list[str]) -> DataFrame:
    """sha256 of the canonical JSON (sorted keys) of each row's configuration."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))
    return config.withColumn("config_hash", F.sha2(text, 256))


def _id_sums(assigned: DataFrame) -> DataFrame:
    """Count and exact hash sum of the row ids per (fold, phase, role, part)."""
    each = assigned.select(
        md5_prefix(F.col("row_id").cast("string")).cast("decimal(38,0)").alias("h"),
        F.explode("uses").alias("_use"),
    )
    return each.groupBy("_use.outer_fold", "_use.phase", "_use.role", "_use.part").agg(
        F.count("*").alias("n"), F.sum("h").alias("h")
    )


def records(assigned: DataFrame, artifacts: list[dict]) -> DataFrame:
    """One record per fitted state: hashes of fit rows, consumed labels and transformed rows.

    ``artifacts`` are dicts ``name, kind, supervised, config`` (config: canonical JSON text).
    All hashes are additive, so the state that excludes a part is a subtraction.
    """
    sums = _id_sums(assigned)
    held_out = F.col("part") < 0
    side = sums.groupBy(*SIDE).agg(
        F.sum(F.when(~held_out, F.col("n"))).alias("side_n"),
        F.sum(F.when(~held_out, F.col("h"))).alias("side_h"),
        F.sum(F.when(held_out, F.col("n"))).alias("held_n"),
        F.sum(F.when(held_out, F.col("h"))).alias("held_h"),
    )
    whole = side.select(
        *SIDE,
        F.lit("map").alias("state"),
        F.col("side_n").alias("fit_n"),
        F.col("side_h").alias("fit_h"),
        F.col("held_n").alias("transform_n"),
        F.col("held_h").alias("transform_h"),
    )
    without = (
        sums.where(~held_out)
        .join(F.broadcast(side), SIDE)  # 2k records
        .select(
            *SIDE,
            F.concat(F.lit("oof"), F.col("part").cast("string")).alias("state"),
            (F.col("side_n") - F.col("n")).alias("fit_n"),
            (F.col("side_h") - F.col("h")).alias("fit_h"),
            F.col("n").alias("transform_n"),
            F.col("h").alias("transform_h"),
        )
    )
    states = whole.unionByName(without)
    listed = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a["name"]).alias("name"),
                    F.lit(a["kind"]).alias("kind"),
                    F.lit(a["supervised"]).alias("supervised"),
                    F.lit(a["config"]).alias("config"),
                )
                for a in artifacts
            ]
        )
    ).alias("a")
    each = states.select("*", listed).where("a.supervised OR state = 'map'")
    role = F.concat_ws("_", "phase", "state")
    text: Column = F.coalesce(F.col("fit_h"), F.lit(0).cast("decimal(38,0)")).cast("string")
    return each.select(
        F.concat_ws("|", "a.kind", "a.name", F.concat(F.lit("f"), F.col("outer_fold")), role).alias("artifact_id"),
        F.concat_ws(":", "a.kind", "a.name").alias("artifact_type"),
        "outer_fold",
        role.alias("fit_role"),
        F.sha2("a.config", 256).alias("config_hash"),
        "fit_n",
        text.alias("fit_ids_hash"),
        F.when(F.col("a.supervised"), F.col("fit_n")).otherwise(F.lit(0)).alias("label_n"),
        F.when(F.col("a.supervised"), text).otherwise("0").alias("label_ids_hash"),
        "transform_n",
        F.col("transform_h").cast("string").alias("transform_ids_hash"),
    )


def overlaps(fit: DataFrame, forbidden: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Per ``by``: size of the fit set, and how many of its ids are forbidden."""
    bad = forbidden.select(*on).distinct().withColumn("_bad", F.lit(1))
    return (
        fit.select(*on)
        .distinct()
        .join(bad, on, "left")
        .groupBy(*by)
        .agg(F.count("*").alias("n_fit"), F.count("_bad").alias("n_overlap"))
    )


def assert_excludes(fit: DataFrame, forbidden: DataFrame, on: list[str], what: str = "outer test") -> None:
    """Raise :class:`LeakageError` when any fit id is forbidden."""
    hits = fit.join(forbidden.select(*on).distinct(), on, "left_semi").count()
    if hits:
        raise LeakageError(f"{hits} fit rows intersect the {what} rows")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference both ways, each side read once; empty when two runs agree."""
    signed = a.withColumn("_v", F.lit(1)).unionByName(b.withColumn("_v", F.lit(-1)))
    left = signed.groupBy(*a.columns).agg(F.sum("_v").alias("_v")).where("_v <> 0")
    side = F.when(F.col("_v") > 0, "left").otherwise("right").alias("side")
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("_v"))).alias("_i")
    return left.select(*a.columns, side, each).drop("_i")
