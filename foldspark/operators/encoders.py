"""Category encoders as pure functions of fitted counts.

Each takes states ``(keys…, col, level, n, pos, fit_n, fit_pos)`` and adds ``code``. ``keys``
name the state a level belongs to (empty for a plain fit).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.hashing import token_bucket, token_hash
from foldspark.operators.scan import exact_rank
from foldspark.sources.categories import Wide

# Fixed values of the encoders
TARGET_ALPHA = 20.0
ORDERED_ALPHA = 1.0
WOE_PSEUDO = 0.5
WOE_CLIP = 5.0
ONEHOT_WIDTH_CAP = 1500


def label_codes(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """1-based index of the level in sorted order; 0 is reserved for unseen levels."""
    ranked = exact_rank(states, ["level"], "code", within=[*keys, "col"])
    return ranked.withColumn("code", F.col("code").cast("double"))


def share(n: Column, pos: Column, fit_n: Column, fit_pos: Column) -> Column:
    return n / fit_n


def smoothed_mean(alpha: float) -> Callable[..., Column]:
    return lambda n, pos, fit_n, fit_pos: (pos + F.lit(alpha) * (fit_pos / fit_n)) / (n + F.lit(alpha))


# encoders whose code is a formula of the counts of its own level and state
FORMULAS = {"count": share, "target": smoothed_mean(TARGET_ALPHA), "ordered": smoothed_mean(ORDERED_ALPHA)}


def _by_formula(states: DataFrame, name: str) -> DataFrame:
    return states.withColumn("code", FORMULAS[name](*[F.col(c) for c in ("n", "pos", "fit_n", "fit_pos")]))


def count_codes(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _by_formula(states, "count")


def target_codes(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _by_formula(states, "target")


def ordered_map_codes(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What the ordered statistic gives to rows it was not fitted on."""
    return _by_formula(states, "ordered")


def woe_codes(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Log ratio of the level's share among positives to its share among negatives."""
    # one record per (state, column): bounded by folds x columns
    width = states.groupBy(*keys, "col").agg(F.count("*").alias("_k"))
    pad = F.col("_k") * WOE_PSEUDO
    among_pos = (F.col("pos") + WOE_PSEUDO) / (F.col("fit_pos") + pad)
    among_neg = (F.col("n") - F.col("pos") + WOE_PSEUDO) / (F.col("fit_n") - F.col("fit_pos") + pad)
    raw = F.log(among_pos / among_neg)
    clipped = F.greatest(F.lit(-WOE_CLIP), F.least(F.lit(WOE_CLIP), raw))
    return states.join(F.broadcast(width), [*keys, "col"]).withColumn("code", clipped).drop("_k")


@dataclass(frozen=True)
class Encoder:
    """How to fit codes, and what an unseen level gets (``None``: the prior of its state)."""

    codes: Callable[..., DataFrame]
    supervised: bool
    unseen: float | None


ENCODERS = {
    "label": Encoder(label_codes, False, 0.0),
    "count": Encoder(count_codes, False, 0.0),
    "target": Encoder(target_codes, True, None),
    "woe": Encoder(woe_codes, True, 0.0),
    "ordered": Encoder(ordered_map_codes, True, None),
}


def column_positions(columns: Sequence[str]) -> Column:
    """0-based position of the column named in ``col``."""
    return F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("col")) - 1


def onehot_slots(states: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Slot of every fitted level; each column's block ends with one slot for unseen levels."""
    indexed = label_codes(states, keys)
    blocks = onehot_blocks(states, columns, keys)
    slot = F.col("block_start") + F.col("code").cast("bigint") - 1
    return indexed.join(F.broadcast(blocks), [*keys, "col"]).withColumn("slot", slot)


def onehot_blocks(states: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per (state, column): ``block_start`` and ``unseen_slot``. One record per column."""
    width = states.groupBy(*keys, "col").agg(F.count("*").alias("levels"))
    order = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("levels") + 1).over(order), F.lit(0))
    placed = width.withColumn("_at", column_positions(columns)).withColumn("block_start", start)
    return placed.withColumn("unseen_slot", F.col("block_start") + F.col("levels")).drop("_at")


def onehot_eligibility(states: DataFrame, keys: Sequence[str], cap: int = ONEHOT_WIDTH_CAP) -> DataFrame:
    """Width of the one-hot code per state and whether it may be built."""
    width = states.groupBy(*keys, "col").agg(F.count("*").alias("levels"))
    total = width.groupBy(*keys).agg(F.sum(F.col("levels") + 1).alias("width"))
    status = F.when(F.col("width") <= cap, "ELIGIBLE").otherwise("SKIPPED_INELIGIBLE")
    return total.withColumn("status", status)


# ---- feature hashing -------------------------------------------------------------------------


def bucket_width(cardinality: Column, n_columns: int) -> Column:
    """Fixed rule: 16 / 32 / 64 buckets below 50 / 500 / 5000 levels, else min(columns, 1024)."""
    return (
        F.when(cardinality < 50, 16)
        .when(cardinality < 500, 32)
        .when(cardinality < 5000, 64)
        .otherwise(min(n_columns, 1024))
    )


def hash_width(states: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    total = states.groupBy(*keys).agg(F.count("*").alias("cardinality"))
    return total.withColumn("buckets", bucket_width(F.col("cardinality"), len(columns)))


def hash_token(column: Column, level: Column, column_aware: bool) -> Column:
    """Length-prefixed column name and value, or the bare value (column identity lost)."""
    if not column_aware:
        return level
    return F.concat(F.length(column).cast("string"), F.lit(":"), column, F.lit("="), level)


def row_hashes(columns: Sequence[str], column_aware: bool) -> Column:
    """Token hash of each column, in column order: no shuffle, no fitted table."""
    if isinstance(columns, Wide):
        return F.transform(columns.array, lambda v, i: token_hash(hash_token(i.cast("string"), v, column_aware)))
    return F.array(*[token_hash(hash_token(F.lit(c), F.col(c), column_aware)) for c in columns])


def buckets_of(hashes: Column, buckets: Column) -> Column:
    return F.transform(hashes, lambda h: F.pmod(h, buckets).cast("int"))


def with_bucket_counts(df: DataFrame, hits: Column) -> DataFrame:
    """Adds ``slots``, the occupied buckets in order, and ``counts``, how often each is hit.

    The hits are sorted once a row; a bucket is a run between two neighbouring starts.
    """
    df = df.withColumn("_sorted", F.sort_array(hits))  # numbers, never NULL: no comparison by a lambda
    size = F.size("_sorted")

    def starts(i: Column) -> Column:
        new = (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1))
        return (i >= 0) & (i < size) & new

    df = df.withColumn("_starts", F.filter(F.sequence(F.lit(0), size - 1), starts))
    length = F.transform("_starts", lambda i, k: (F.coalesce(F.get("_starts", k + 1), size) - i).cast("double"))
    return df.withColumns({"slots": F.transform("_starts", lambda i: F.get("_sorted", i)), "counts": length}).drop(
        "_sorted", "_starts"
    )


def dense_counts(slots: Column, counts: Column, width: Column) -> Column:
    """Dense vector of a sparse code whose ``slots`` ascend: zeros are laid between neighbours in one pass."""

    def piece(slot: Column, k: Column) -> Column:
        before = F.when(k == 0, F.lit(-1)).otherwise(F.get(slots, k - 1))
        return F.concat(F.array_repeat(F.lit(0.0), slot - before - 1), F.array(F.get(counts, k)))

    last = F.coalesce(F.try_element_at(slots, F.lit(-1)), F.lit(-1))
    return F.concat(F.flatten(F.transform(slots, piece)), F.array_repeat(F.lit(0.0), width - last - 1))


def sentinel_buckets(widths: DataFrame) -> DataFrame:
    """Buckets of the bare strings "0" and "1" at each width in use."""
    zero, one = (token_bucket(F.lit(s), F.col("buckets")) for s in ("0", "1"))
    return widths.withColumns({"zero_bucket": zero, "one_bucket": one}).withColumn(
        "distinct_buckets", F.col("zero_bucket") != F.col("one_bucket")
    )


def token_table(states: DataFrame, buckets: Column, column_aware: bool) -> DataFrame:
    """Distinct tokens of the fitted levels with their bucket."""
    token = hash_token(F.col("col"), F.col("level"), column_aware)
    return states.select(token.alias("token")).distinct().withColumn(
        "bucket", token_bucket(F.col("token"), buckets)
    )


def hash_collisions(tokens: DataFrame, buckets: Column) -> DataFrame:
    """Tokens, occupied buckets, colliding tokens and colliding pairs, with the expected pairs."""
    per = tokens.groupBy("bucket").agg(F.count("*").alias("c"))
    k = F.sum("c")
    pairs = F.sum(F.col("c") * (F.col("c") - 1)) / 2
    return per.agg(
        k.alias("n_tokens"),
        F.count("*").alias("n_buckets_used"),
        (k - F.count("*")).alias("n_colliding_tokens"),
        pairs.cast("bigint").alias("n_colliding_pairs"),
        F.max(buckets).alias("buckets"),
        F.round(k * (k - 1) / 2 / F.max(buckets), 9).alias("expected_pairs"),
    )


def blake2b_buckets(tokens: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Keyed 64-bit BLAKE2b bucket, computed in Arrow batches over distinct tokens only."""
    key = seed.to_bytes(8, "little")

    @F.pandas_udf("int")
    def bucket(token: pd.Series) -> pd.Series:
        def one(t: str) -> int:
            digest = hashlib.blake2b(t.encode(), digest_size=8, key=key).digest()
            return int.from_bytes(digest, "little") % buckets

        return token.map(one)

    return tokens.withColumn("bucket", bucket("token"))


# ---- ordered statistic -----------------------------------------------------------------------


def state_summary(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Levels per column, fitted rows and prior of every fitted state."""
    return states.groupBy(*keys, "col").agg(
        F.count("*").alias("n_levels"),
        F.max("fit_n").alias("fit_n"),
        F.round(F.max(F.col("fit_pos") / F.col("fit_n")), 9).alias("prior"),
    )
