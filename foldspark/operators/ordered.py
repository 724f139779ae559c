"""Ordered statistic: the smoothed label mean of a level over the rows that come before, averaged over permutations.

Rows are dealt to blocks by a hash of their id, and a permutation shuffles the blocks and the rows inside each. All
permutations share the blocks, so rows that are scanned together meet in one task once for all permutations, columns and
training sides, and a row's average needs no further exchange:

1. count every (block, column, level) per side, after one exchange of plain rows by block;
2. running sums of these counts over the blocks in the order of each permutation: what precedes a block;
3. one exchange of rows and preceding counts by block; a task scans block after block.

Blocks hold about ``BLOCK_CELLS`` values at any size of the table, so the memory of a scan is bounded.

The plain statistic (:func:`whole_codes`) shuffles all rows in every permutation: its blocks are ranges of the order of one
permutation, and the permutations follow one another. A row carries the sums of its codes, so nothing but rows is exchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from foldspark.functions.hashing import md5_prefix, seeded_md5
from foldspark.operators.encoders import ORDERED_ALPHA
from foldspark.session import forget_shuffles, materialize, release
from foldspark.sources.categories import level_array

PERMUTATION_SEED = 977  # fixed values of the ordered statistic
PERMUTATIONS = 4
BLOCK_CELLS = 1_000_000  # values of a block
LEAST_BLOCKS = 64


def block_count(rows: int, columns: int) -> int:
    return max(LEAST_BLOCKS, -(-rows * columns // BLOCK_CELLS))


def block_of(row_id: Column, blocks: int, seed: int = PERMUTATION_SEED) -> Column:
    return F.pmod(md5_prefix(F.concat(F.lit(f"{seed}:"), row_id.cast("string"))), F.lit(blocks)).cast("int")


def _sums(sides: int) -> list[str]:
    return [f"n{i}" for i in range(sides)] + [f"s{i}" for i in range(sides)]


def block_counts(rows: DataFrame, sides: int) -> DataFrame:
    """``block, col, level`` with the rows and positives of every side; ``rows`` has block, y, mask, levels."""
    each = rows.repartition("block").select("block", "y", "mask", F.posexplode("levels").alias("col", "level"))
    fits = [F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(sides)]
    n = [F.count_if(f).alias(f"n{i}") for i, f in enumerate(fits)]
    s = [F.coalesce(F.sum(F.when(f, F.col("y"))), F.lit(0)).cast("bigint").alias(f"s{i}") for i, f in enumerate(fits)]
    # rows of a block are in one task already: no further exchange
    return each.groupBy("block", "col", "level").agg(*n, *s)


def preceding_counts(counts: DataFrame, sides: int, seed: int = PERMUTATION_SEED) -> DataFrame:
    """``block, perm, col, level, sums``: counts over all blocks before this one in each permutation."""
    perm = F.explode(F.sequence(F.lit(0), F.lit(PERMUTATIONS - 1)))
    each = counts.withColumn("perm", perm)
    turn = seeded_md5(F.col("perm") + seed, F.concat(F.lit("b"), F.col("block").cast("string")))
    # one record a block in a group
    before = Window.partitionBy("perm", "col", "level").orderBy(turn, "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = F.array(*[F.coalesce(F.sum(c).over(before), F.lit(0)) for c in _sums(sides)])
    return each.select("block", "perm", "col", "level", sums.alias("sums")).where(F.array_max("sums") > 0)


def _ranks(ids: list, seed: int) -> np.ndarray:
    """Place of every row in the order of a permutation inside its block."""
    keys = np.array([hashlib.md5(f"{seed}:{i}".encode()).digest() for i in ids], dtype="S16")
    out = np.empty(len(ids), dtype=np.int64)
    out[np.argsort(keys, kind="stable")] = np.arange(len(ids))
    return out


def _scan_block(block: pa.Table, priors: np.ndarray, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(side, positions of its rows, codes [rows, columns]) of one block of preceding counts and rows."""
    kinds = block.column("kind").to_numpy()
    earlier, rows = (block.filter(pa.array(kinds == k)) for k in (0, 1))
    n, sides = rows.num_rows, len(priors)
    ids = rows.column("row_id").to_pylist()
    bits = (rows.column("mask").to_numpy()[:, None] >> np.arange(sides)) & 1
    values = np.hstack([bits, bits * rows.column("y").to_numpy()[:, None]])
    ranks = [_ranks(ids, seed + p) for p in range(PERMUTATIONS)]
    flat = rows.column("levels").combine_chunks().flatten()
    width = len(flat) // n
    where = {}
    sums = np.array(earlier.column("sums").combine_chunks().flatten(), dtype=np.int64).reshape(-1, 2 * sides)
    for i, key in enumerate(zip(*(earlier.column(c).to_pylist() for c in ("perm", "col", "level")))):
        where[key] = i
    total = np.zeros((n, width, sides))
    for j in range(width):
        named = flat.take(pa.array(np.arange(n) * width + j)).dictionary_encode()
        at, levels = named.indices.to_numpy(), named.dictionary.to_pylist()
        for p in range(PERMUTATIONS):
            base = np.zeros((len(levels), 2 * sides), dtype=np.int64)
            for k, level in enumerate(levels):
                found = where.get((p, j, level))
                if found is not None:
                    base[k] = sums[found]
            order = np.lexsort((ranks[p], at))
            group = at[order]
            running = np.cumsum(values[order], axis=0) - values[order]
            first = np.searchsorted(group, np.arange(len(levels)))
            running += (base - running[first])[group]
            code = (running[:, sides:] + ORDERED_ALPHA * priors) / (running[:, :sides] + ORDERED_ALPHA)
            total[order, j] += code
    total /= PERMUTATIONS
    for i in range(sides):
        mine = np.flatnonzero(bits[:, i])
        if len(mine):
            yield i, mine, total[mine, :, i]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The records of one block after the other; the first column is the block, in ascending order."""
    held, now = [], None
    for batch in batches:
        at = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if held and at[a] != now:
                    yield pa.Table.from_batches(held)
                    held = []
                now = at[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _scan(
    batches: Iterator[pa.RecordBatch], priors: np.ndarray, seed: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        rows = block.filter(pa.array(block.column("kind").to_numpy() == 1))
        if not rows.num_rows:
            continue
        ids, y = rows.column("row_id").combine_chunks(), rows.column("y").combine_chunks()
        for side, mine, codes in _scan_block(block, priors, seed):
            ends = pa.array(np.arange(len(mine) + 1) * codes.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))
            some = pa.array(mine)
            out = [ids.take(some), y.take(some), pa.array(np.full(len(mine), side, np.int32)), lists]
            yield pa.RecordBatch.from_arrays([v.cast(t) for v, t in zip(out, schema.types)], schema=schema)


def ordered_codes(
    rows: DataFrame, columns: Sequence[str], mask: Column, priors: list[float], seed: int = PERMUTATION_SEED
) -> DataFrame:
    """``row_id, y, side, codes`` of every row in every side that it belongs to: bit i of ``mask``, with prior i."""
    sides = len(priors)
    plain = rows.select("row_id", F.col("y").cast("bigint").alias("y"), mask.cast("bigint").alias("mask"), level_array(columns).alias("levels"))
    plain = materialize(plain, "ordered").where("mask <> 0")
    blocks = block_count(plain.count(), len(columns))
    plain = plain.withColumn("block", block_of(F.col("row_id"), blocks, seed))
    earlier = materialize(preceding_counts(block_counts(plain, sides), sides, seed), "preceding")
    none = {"perm": "int", "col": "int", "level": "string", "sums": "array<bigint>"}
    gone = {"row_id": rows.schema["row_id"].dataType, "y": "bigint", "mask": "bigint", "levels": "array<string>"}
    records = plain.select(
        "block", F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], *gone
    ).unionByName(
        earlier.select("block", F.lit(0).alias("kind"), *none, *[F.lit(None).cast(t).alias(c) for c, t in gone.items()])
    )
    dealt = records.repartition("block").sortWithinPartitions("block", "kind")
    key = StructField("row_id", rows.schema["row_id"].dataType)
    schema = StructType([key, *StructType.fromDDL("y bigint, side int, codes array<double>").fields])
    arrow, start = to_arrow_schema(schema), np.array(priors, dtype=float)
    coded = dealt.mapInArrow(lambda batches: _scan(batches, start, seed, arrow), schema)
    return coded.withColumn("y", F.col("y").cast(rows.schema["y"].dataType))


# ---- all rows shuffled in every permutation --------------------------------------------------


def _scan_range(block: pa.Table, prior: float, seed: int) -> tuple[pa.Table, np.ndarray]:
    """The rows of a range of one permutation and the sums of their codes [rows, columns], this permutation included."""
    kinds = block.column("kind").to_numpy()
    earlier, rows = (block.filter(pa.array(kinds == k)) for k in (0, 1))
    n = rows.num_rows
    if not n:
        return rows, np.zeros((0, 0))
    y = rows.column("y").to_numpy()
    rank = _ranks(rows.column("row_id").to_pylist(), seed)
    place = np.argsort(rank)  # rows in the order of the permutation
    flat = rows.column("levels").combine_chunks().flatten()
    width = len(flat) // n
    sums = rows.column("sums").combine_chunks().flatten().to_numpy()
    total = sums.reshape(n, width).copy() if len(sums) else np.zeros((n, width))
    before = dict(zip(zip(earlier.column("col").to_pylist(), earlier.column("level").to_pylist()), zip(earlier.column("n").to_pylist(), earlier.column("s").to_pylist())))
    for j in range(width):
        named = flat.take(pa.array(np.arange(n) * width + j)).dictionary_encode()
        at, levels = named.indices.to_numpy(), named.dictionary.to_pylist()
        base = np.array([before.get((j, level), (0, 0)) for level in levels], dtype=np.int64)
        order = place[np.argsort(at[place], kind="stable")]
        group = at[order]
        first = np.searchsorted(group, np.arange(len(levels)))
        seen = np.arange(n) - first[group] + base[group, 0]
        running = np.cumsum(y[order]) - y[order]
        positive = running - running[first][group] + base[group, 1]
        total[order, j] += (positive + ORDERED_ALPHA * prior) / (seen + ORDERED_ALPHA)
    return rows, total


def _scan_ranges(batches: Iterator[pa.RecordBatch], prior: float, seed: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        rows, total = _scan_range(block, prior, seed)
        if rows.num_rows:
            ends = pa.array(np.arange(len(total) + 1) * total.shape[1], pa.int32())
            sums = pa.ListArray.from_arrays(ends, pa.array(total.ravel()))
            out = [*(rows.column(c).combine_chunks() for c in ("row_id", "y", "levels")), sums]
            yield pa.RecordBatch.from_arrays([v.cast(t) for v, t in zip(out, schema.types)], schema=schema)


def whole_codes(rows: DataFrame, columns: Sequence[str], prior: float, n_rows: int, seed: int = PERMUTATION_SEED) -> DataFrame:
    """``row_id, codes`` of a plain fit on all rows; each permutation is a shuffle of all ``n_rows`` by a seeded hash of their ids.

    The first bits of the hash are the range that a row is in, so ranges need no sample and are of one size.
    """
    ranges = block_count(n_rows, len(columns))
    key = StructField("row_id", rows.schema["row_id"].dataType)
    schema = StructType([key, *StructType.fromDDL("y bigint, levels array<string>, sums array<double>").fields])
    arrow, kept = to_arrow_schema(schema), schema.names
    y = F.coalesce(F.col("y"), F.lit(0)).cast("bigint").alias("y")
    held = rows.select("row_id", y, level_array(columns).alias("levels"), F.array().cast("array<double>").alias("sums"))
    held = materialize(held, "ordered")
    for p in range(PERMUTATIONS):
        turn = md5_prefix(F.concat(F.lit(f"{seed + p}:"), F.col("row_id").cast("string")))
        placed = held.withColumn("block", F.shiftright(F.shiftright(turn, 16) * ranges, 32).cast("int"))
        each = placed.select("block", "y", F.posexplode("levels").alias("col", "level"))
        counts = each.groupBy("block", "col", "level").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
        before = Window.partitionBy("col", "level").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        earlier = counts.select("block", "col", "level", *[F.sum(c).over(before).alias(c) for c in ("n", "s")]).where("n > 0")
        none = {"col": "int", "level": "string", "n": "bigint", "s": "bigint"}
        records = placed.select("block", F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], *kept).unionByName(
            earlier.select("block", F.lit(0).alias("kind"), *none, *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        )
        dealt = records.repartition("block").sortWithinPartitions("block", "kind")
        turned = materialize(dealt.mapInArrow(lambda batches, at=seed + p: _scan_ranges(batches, prior, at, arrow), schema), "ordered")
        release(held)
        forget_shuffles(held)  # else those of all permutations stay
        held = turned
    return held.select("row_id", F.transform("sums", lambda c: c / PERMUTATIONS).alias("codes"))
