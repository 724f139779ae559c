"""Homogeneity analysis: two-dimensional category quantifications as principal axes.

They are eigenvectors of the Burt matrix (co-occurrence counts of levels) in the metric of the level
counts, scaled by the root of n times their eigenvalue: the rows are read once, whatever the number of
iterations. The matrix is symmetric; its size depends on the levels, not on the rows.

The matrix stays a table, with the side (such as the training side of a fold) as a key of its joins and sums: all
sides are solved together. A cycle multiplies the residuals of ``WIDTH`` axes ``STEPS`` times and takes the best axes in the
space of the old axes and all products; what reaches the driver is one small matrix of inner products a side. A side
whose residuals are small is done and leaves the next cycle; sides left after ``cycles`` raise ``NotConvergedError``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldspark.functions.hashing import unit_interval
from foldspark.operators.skew import lookup
from foldspark.session import materialize, release

DIMENSIONS = 2  # fixed value
WIDTH = 8  # vectors iterated together
STEPS = 8  # products a cycle
CYCLES = 60
MARGIN = 1.02  # of the largest eigenvalue: products are scaled to the part of the axis that is in use
RESIDUAL = 1e-7  # of the eigenvalue
KEY = ["col", "level"]


class NotConvergedError(ArithmeticError):
    """The axes of some sides are not exact after the allowed cycles."""


def burt(rows: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys…, col_a, level_a, col_b, level_b, n`` for both orders of each pair, and the diagonal.

    Rows are first counted per distinct tuple; only tuples are paired up, m x m per tuple.
    """
    tuples = rows.groupBy(*keys, *columns).agg(F.count("*").alias("w"))
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("col_a"), F.col(a).alias("level_a"),
                F.lit(b).alias("col_b"), F.col(b).alias("level_b"),
            )
            for a in columns
            for b in columns
        ]
    )
    each = tuples.select(*keys, "w", F.explode(pairs).alias("_pair")).select(*keys, "w", "_pair.*")
    return each.groupBy(*keys, "col_a", "level_a", "col_b", "level_b").agg(F.sum("w").alias("n"))


@dataclass(frozen=True)
class _Axes:
    """Weights of all blocks in the best axes of one side and in their images under A, and their eigenvalues under A."""

    axes: np.ndarray
    images: np.ndarray
    values: np.ndarray


@dataclass
class _Scale:
    """What is known of a side: A = 2 / bound M - 1, the lengths of r, and A x = x * values + r / lengths * parts."""

    bound: float
    values: np.ndarray
    lengths: np.ndarray
    parts: np.ndarray


def _solve(inner: np.ndarray, known: _Scale) -> _Axes:
    """Best axes from the inner products of the blocks x, t0..tS, where t(k+1) = 2 A t(k) - t(k-1)."""
    size = WIDTH * (STEPS + 1)
    blocks = [slice(k * WIDTH, (k + 1) * WIDTH) for k in range(STEPS + 2)]
    space = np.eye(size + WIDTH, size)  # all blocks but the last
    image = np.zeros((size + WIDTH, size))  # A applied to it
    image[blocks[0], blocks[0]], image[blocks[1], blocks[0]] = np.diag(known.values), np.diag(known.parts)
    image[blocks[2], blocks[1]] = np.eye(WIDTH)
    for k in range(2, STEPS + 1):
        image[blocks[k + 1], blocks[k]] = image[blocks[k - 1], blocks[k]] = np.eye(WIDTH) / 2
    own, cross = space.T @ inner @ space, space.T @ inner @ image
    length = np.sqrt(np.maximum(np.diag(own), 0.0))
    unit = np.divide(1.0, length, out=np.zeros(size), where=length > 1e-100)
    w, e = np.linalg.eigh((own + own.T) / 2 * unit[:, None] * unit)
    good = w > max(w[-1] * 1e-11, 1e-300)
    white = e[:, good] / np.sqrt(w[good]) * unit[:, None]
    values, turn = np.linalg.eigh(white.T @ (cross + cross.T) @ white / 2)
    mixing = np.zeros((size, WIDTH))
    best = (white @ turn)[:, ::-1][:, :WIDTH]
    mixing[:, : best.shape[1]] = best
    top = np.full(WIDTH, -1.0)  # of M: 0
    top[: best.shape[1]] = values[::-1][:WIDTH]
    return _Axes(space @ mixing, image @ mixing, top)


def _side(row, keys: tuple[str, ...]) -> tuple:
    return tuple(row[k] for k in keys)


def _stacked(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), dtype=float)


def _inner_products(v: DataFrame, keys: tuple[str, ...]) -> dict[tuple, np.ndarray]:
    """Inner products of all blocks, per side: summed in the tasks, then one small matrix a side."""
    schema = T.StructType([*[v.schema[k] for k in keys], T.StructField("g", T.ArrayType(T.DoubleType()))])
    size = WIDTH * (STEPS + 2)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for side, rows in batch.groupby(list(keys), sort=False):
                t = _stacked(rows["t"])
                sums[side] = sums.get(side, 0) + t.T @ (t * rows["d"].to_numpy(float)[:, None])
        if sums:
            yield pd.DataFrame([(*side, g.ravel()) for side, g in sums.items()], columns=[*keys, "g"])

    def total(parts: pd.DataFrame) -> pd.DataFrame:
        return parts[[*keys, "g"]][:1].assign(g=[_stacked(parts["g"]).sum(axis=0)])  # one record a task

    summed = v.mapInPandas(partial, schema).groupBy(*keys).applyInPandas(total, schema)
    return {_side(r, keys): np.array(r.g).reshape(size, size) for r in summed.toLocalIterator()}


def _mixed(v: DataFrame, axes: dict[tuple, _Axes], keys: tuple[str, ...]) -> DataFrame:
    """The best axes x of each side and their residuals r."""
    schema = T.StructType([*[v.schema[k] for k in (*keys, *KEY, "d")], *T.StructType.fromDDL("x array<double>, r array<double>").fields])

    def mix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for side, rows in batch.groupby(list(keys), sort=False):
                best, t = axes[side], _stacked(rows["t"])
                x = t @ best.axes
                yield rows[[*keys, *KEY, "d"]].assign(x=list(x), r=list(t @ best.images - x * best.values))

    return v.mapInPandas(mix, schema)


def _means(v: DataFrame, keys: tuple[str, ...], block: str) -> DataFrame:
    """Weighted mean of a block: the trivial axis, which all counts share, is kept out of every step. One record a side."""
    means = [(F.sum(F.col("d") * F.get(block, F.lit(i))) / F.sum("d")).alias(f"m{i}") for i in range(WIDTH)]
    return F.broadcast(v.groupBy(*keys).agg(*means))


def _started(v: DataFrame, known: dict[tuple, _Scale], keys: tuple[str, ...]) -> DataFrame:
    """Blocks x and r / its length, centred, with the scale of the side."""
    state = T.StructType([*[v.schema[k] for k in keys], *T.StructType.fromDDL("scale double, unit array<double>").fields])
    units = [np.divide(1.0, k.lengths, out=np.zeros(WIDTH), where=k.lengths > 1e-14) for k in known.values()]
    rows = [(*side, 2.0 / k.bound, unit.tolist()) for (side, k), unit in zip(known.items(), units)]
    sides = F.broadcast(v.sparkSession.createDataFrame(rows, state))  # one record a side
    joined = v.join(sides, list(keys)).join(_means(v, keys, "r"), list(keys))
    r = F.array(*[(F.get("r", F.lit(i)) - F.col(f"m{i}")) * F.get("unit", F.lit(i)) for i in range(WIDTH)])
    return joined.select(*keys, *KEY, "d", "scale", F.concat("x", r).alias("t"))


def _product(v: DataFrame, matrix: DataFrame, m: int, keys: tuple[str, ...], step: int) -> DataFrame:
    """Adds the next block of products to ``t``."""
    first = (step + 1) * WIDTH
    last = v.withColumn("x", F.slice("t", first + 1, WIDTH))
    other = last.select(*keys, F.col("col").alias("col_b"), F.col("level").alias("level_b"), "x")
    sums = matrix.join(other, [*keys, "col_b", "level_b"]).groupBy(*keys, F.col("col_a").alias("col"), F.col("level_a").alias("level"))
    sums = sums.agg(*[F.sum(F.col("n") * F.get("x", F.lit(i))).alias(f"x{i}") for i in range(WIDTH)])

    def new(i: int) -> Column:
        applied = (F.col(f"x{i}") / F.col("d") - m * F.col(f"m{i}")) * F.col("scale") - F.get("t", F.lit(first + i))
        return applied if step == 0 else 2 * applied - F.get("t", F.lit(first - WIDTH + i))

    joined = v.join(sums, [*keys, *KEY]).join(_means(last, keys, "x"), list(keys))
    grown = F.concat("t", F.array(*[new(i) for i in range(WIDTH)])).alias("t")
    return materialize(joined.select(*keys, *KEY, "d", "scale", grown), "homals")


def fit(rows: DataFrame, columns: list[str], keys: Sequence[str] = (), cycles: int = CYCLES) -> DataFrame:
    """``keys…, col, level, n, theta1, theta2, q1, q2``: quantification of every fitted level, per key.

    One pass over the rows serves all keys (such as the training sides of all folds). ``theta`` are the eigenvalues.
    """
    if not keys:
        return fit(rows.withColumn("_all", F.lit(0)), columns, ("_all",), cycles).drop("_all")
    m = len(columns)
    matrix = materialize(burt(rows, columns, keys), "burt")
    levels = matrix.where("col_a = col_b AND level_a = level_b")
    ident = F.concat_ws(":", "col_a", "level_a")
    start = F.array(*[unit_interval(f"h{i}", ident) - 0.5 for i in range(WIDTH)])
    none = F.array_repeat(F.lit(0.0), WIDTH)
    v = levels.select(*keys, F.col("col_a").alias("col"), F.col("level_a").alias("level"), F.col("n").alias("d"), none.alias("x"), start.alias("r"))
    known = {_side(r, keys): _Scale(float(m), np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH)) for r in v.select(*keys).distinct().toLocalIterator()}
    solved = []
    for _ in range(cycles):
        t = materialize(_started(v, known, keys), "homals")
        for step in range(STEPS):
            t, before = _product(t, matrix, m, keys, step), t
            release(before)
        axes = {side: _solve(g, known[side]) for side, g in _inner_products(t, keys).items()}
        v = materialize(_mixed(t, axes, keys), "homals")
        release(t)
        squares = [F.sum(F.col("d") * F.pow(F.get("r", F.lit(i)), 2)).alias(f"s{i}") for i in range(WIDTH)]
        rest, left = [], {}
        for row in v.groupBy(*keys).agg(*squares).toLocalIterator():
            side = _side(row, keys)
            lengths = np.sqrt([row[f"s{i}"] for i in range(WIDTH)])
            bound, theta = known[side].bound, (axes[side].values + 1) * known[side].bound / 2
            done = bool((lengths[:DIMENSIONS] * bound / 2 <= RESIDUAL * np.maximum(theta[:DIMENSIONS], RESIDUAL)).all())
            rest.append((*side, *[max(float(x), 0.0) for x in theta[:DIMENSIONS]], done))
            if not done:
                new = max(float(theta[0]), RESIDUAL) * MARGIN
                left[side] = _Scale(new, theta * 2 / new - 1, lengths, lengths * bound / new)
        state = T.StructType([*[v.schema[k] for k in keys], *T.StructType.fromDDL("theta1 double, theta2 double, done boolean").fields])
        sides = F.broadcast(v.sparkSession.createDataFrame(rest, state))  # one record a side
        solved.append(v.join(sides.where("done"), list(keys)))
        if not left:
            return _oriented(_scaled(reduce(DataFrame.unionByName, solved), keys, m), keys)
        going = sides.where("NOT done").select(*keys)
        v, matrix, known = v.join(going, list(keys), "left_semi"), matrix.join(going, list(keys), "left_semi"), left
    raise NotConvergedError(f"{len(left)} sides are not exact after {cycles} cycles")


def _scaled(v: DataFrame, keys: tuple[str, ...], m: int) -> DataFrame:
    """Axes with squared length n times their eigenvalue."""
    total = materialize(v.groupBy(*keys).agg((F.sum("d") / m).alias("rows"), F.count("*").alias("n")), "homals")
    joined = lookup(v, total, list(keys), KEY)
    axis = [(F.get("x", F.lit(i)) * F.sqrt(F.col("rows") * F.col(f"theta{i + 1}"))).alias(f"q{i + 1}") for i in range(DIMENSIONS)]
    return materialize(joined.select(*keys, *KEY, F.col("d").alias("n"), "theta1", "theta2", *axis), "homals")


def _oriented(quants: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each dimension with its largest value positive; eigenvectors have no sign of their own.

    Among values of equal size (to nine digits) the last column and level decide.
    """
    names = [f"q{i + 1}" for i in range(DIMENSIONS)]
    leads = [F.max_by(F.col(q) < 0, F.struct(F.round(F.abs(F.col(q)), 9), *KEY)).alias(f"flip_{q}") for q in names]
    signs = materialize(quants.groupBy(*keys).agg(*leads, F.count("*").alias("weight")), "homals")
    joined = lookup(quants, signs, list(keys), KEY, weight="weight")
    turned = {q: F.when(F.col(f"flip_{q}"), -F.col(q)).otherwise(F.col(q)) for q in names}
    return joined.withColumns(turned).drop(*[f"flip_{q}" for q in names])


def audit(quants: DataFrame, matrix: DataFrame, m: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per key and dimension: levels, weighted mean, squared length and residual of the eigen-equation, all relative."""
    out = []
    for i in range(1, DIMENSIONS + 1):
        q = F.col(f"q{i}")
        other = quants.select(*keys, F.col("col").alias("col_b"), F.col("level").alias("level_b"), q.alias("x"))
        image = matrix.join(other, [*keys, "col_b", "level_b"])
        image = image.groupBy(*keys, F.col("col_a").alias("col"), F.col("level_a").alias("level")).agg(F.sum(F.col("n") * F.col("x")).alias("image"))
        each = quants.join(image, [*keys, *KEY])
        rows, theta = F.sum("n") / m, F.max(f"theta{i}")
        mean = F.sum(F.col("n") * q) / F.sum("n")
        square = F.sum(F.col("n") * q * q)
        residual = F.sqrt(F.sum(F.col("n") * F.pow(F.col("image") / F.col("n") - F.col(f"theta{i}") * q, 2)) / square) / theta
        out.append(
            each.groupBy(*keys).agg(
                F.lit(i).alias("dimension"), F.count("*").alias("n_levels"), mean.alias("mean"),
                (square / (rows * theta)).alias("length"), residual.alias("residual"),
            )
        )
    return out[0].unionByName(out[1])
