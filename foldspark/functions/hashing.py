"""Deterministic hashes as column expressions (no ``rand``: it depends on partitioning)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SEED = 20260810  # fixed value: seed of the token hash
PREFIX_BITS = 48  # 12 hex digits of md5


def seeded_md5(seed, ident) -> Column:
    """Hex md5 of ``seed:ident``; its order is a seeded shuffle of the ids."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), ident.cast("string")))


def md5_prefix(text: Column) -> Column:
    """First 48 bits of md5 as BIGINT."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def unit_interval(seed, ident) -> Column:
    """Uniform value in [0, 1) from 48 bits of the seeded md5."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return md5_prefix(F.concat(seed.cast("string"), F.lit(":"), ident.cast("string"))) / F.lit(
        float(2**PREFIX_BITS)
    )


def token_hash(token: Column, seed: int = HASH_SEED) -> Column:
    """Seeded, process-independent 48-bit hash of a token."""
    return md5_prefix(F.concat(F.lit(f"{seed}:"), token))


def token_bucket(token: Column, buckets, seed: int = HASH_SEED) -> Column:
    """Bucket of a token in ``[0, buckets)``."""
    buckets = buckets if isinstance(buckets, Column) else F.lit(buckets)
    return F.pmod(token_hash(token, seed), buckets).cast("int")


def length_prefixed(columns: list[str]) -> Column:
    """Unambiguous text of a row: separators inside values cannot collide."""
    parts = [F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in columns]
    return F.concat_ws("|", *parts)


def set_hash(ident: Column) -> list[Column]:
    """Order-free hash of a set of ids: its size and the exact sum of md5 prefixes."""
    total = F.sum(md5_prefix(ident.cast("string")).cast("decimal(38,0)"))
    return [
        F.count(ident).alias("n_ids"),
        F.coalesce(total, F.lit(0).cast("decimal(38,0)")).cast("string").alias("ids_hash"),
    ]
