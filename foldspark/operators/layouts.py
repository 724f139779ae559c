"""Feature layouts: numeric codes of a row rendered as a small image.

Placement is fitted per key (fold, phase, encoder …) from feature correlations; its tables are
d x d, bounded by the code width, never by rows. Rendering and resizing are fused in Arrow
batches, so full-size images never leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldspark.session import materialize

# Fixed values of the layouts
MAX_PIXELS = 262_144
IMAGE_SIZE = 64
SWAP_STEPS = 2000
LAYOUT_SEED = 7
ROUNDS = 4  # of searches that exchange their best states
FAN = 16  # records of moments that meet in a task
CHUNK_PIXELS = 4_000_000  # pixels rendered at once inside a task


# ---- placement fit ---------------------------------------------------------------------------


def _moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means as a rounded value and the rest, and sums of products of the deviations from them."""
    mean = x.mean(axis=0)
    off = x - mean
    rest = off.mean(axis=0)
    return len(x), mean, rest, off.T @ off - len(x) * np.outer(rest, rest)


def _combined(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Moments of two sets of rows together; no raw sums of squares, so a large mean costs no digits."""
    n = a[0] + b[0]
    apart = (b[1] - a[1]) + (b[2] - a[2])
    return n, a[1], a[2] + apart * (b[0] / n), a[3] + b[3] + np.outer(apart, apart) * (a[0] * b[0] / n)


def feature_moments(coded: DataFrame, keys: list[str], codes: str = "codes", tasks: int | None = None) -> DataFrame:
    """``keys…, n, mean, m2``: one record a key, combined in a tree.

    ``tasks`` (two a core by default) read the rows, each any number of partitions one after the other, and give one
    record a key: what is exchanged does not grow with the partitions. ``FAN`` records meet at a time.
    """
    schema = T.StructType([*[coded.schema[k] for k in keys], *T.StructType.fromDDL("n bigint, mean array<double>, rest array<double>, m2 array<double>, part int").fields])

    def named(key) -> tuple:
        return tuple(None if pd.isna(k) else k for k in key)

    def record(key: tuple, found: tuple, part: int) -> pd.DataFrame:
        return pd.DataFrame([(*key, found[0], found[1], found[2], found[3].ravel(), part)], columns=schema.names)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}
        part = 0
        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            for key, rows in batch.groupby(keys, sort=False, dropna=False) if keys else [((), batch)]:
                if len(rows):
                    new = _moments(np.stack(rows[codes].to_numpy()).astype(float))
                    side = named(key)
                    held[side] = _combined(held[side], new) if side in held else new
        for key, found in held.items():
            yield record(key, found, part)

    def merged(records: pd.DataFrame) -> pd.DataFrame:
        out = None
        for n, mean, rest, m2 in zip(*(records[c] for c in ("n", "mean", "rest", "m2"))):
            one = (int(n), np.asarray(mean), np.asarray(rest), np.asarray(m2).reshape(len(mean), -1))
            out = one if out is None else _combined(out, one)
        return record(named(records[k].iloc[0] for k in keys), out, int(records["part"].iloc[0]) // FAN)

    tasks = tasks or 2 * coded.sparkSession.sparkContext.defaultParallelism
    found = coded.coalesce(tasks).select(*keys, codes, F.spark_partition_id().alias("part")).mapInPandas(partial, schema)
    while tasks > 1:
        found = found.groupBy(*keys, F.floor(F.col("part") / FAN).alias("_at")).applyInPandas(merged, schema)
        tasks = -(-tasks // FAN)
    whole = F.zip_with("mean", "rest", lambda a, b: a + b)
    return found.select(*keys, "n", whole.alias("mean"), "m2")


def feature_distance(coded: DataFrame, keys: list[str], codes: str = "codes") -> DataFrame:
    """``keys…, i, j, dist`` for i < j: one minus Pearson correlation; undefined gives 1.

    A column counts as constant if its deviations are no larger than the rounding of its mean.
    """
    schema = T.StructType([*[coded.schema[k] for k in keys], *T.StructType.fromDDL("i int, j int, dist double").fields])

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                mean = np.asarray(r.mean)
                m2 = np.asarray(r.m2).reshape(len(mean), -1)
                square = np.diag(m2)
                varies = square > r.n * (1e-13 * np.abs(mean)) ** 2
                root = np.sqrt(np.where(varies, square, 1.0))
                corr = np.where(varies[:, None] & varies, m2 / root[:, None] / root, 0.0)
                i, j = np.triu_indices(len(mean), k=1)
                out = pd.DataFrame({"i": i, "j": j, "dist": 1.0 - corr[i, j]})
                for name in keys:
                    out[name] = getattr(r, name)
                yield out[schema.names]

    return feature_moments(coded, keys, codes).mapInPandas(pairs, schema)


def pair_ranks(pairs: DataFrame, keys: list[str], by: str = "dist", out: str = "feature_rank") -> DataFrame:
    """0-based rank of each pair's distance inside its key; ties by position.

    The window holds the d(d-1)/2 pairs of one key.
    """
    order = Window.partitionBy(*keys).orderBy(F.round(by, 9), "i", "j")
    return pairs.withColumn(out, (F.row_number().over(order) - 1).cast("bigint"))


def grid_shape(d: Column) -> tuple[Column, Column]:
    """Height and width of the smallest near-square grid with d cells."""
    h = F.ceil(F.sqrt(d)).cast("int")
    return h, F.ceil(d / h).cast("int")


def grid_distance(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Euclidean distance of the row-major cells i and j of each pair's grid."""
    width = pairs.groupBy(*keys).agg((F.max("j") + 1).alias("_d"))
    both = pairs.join(F.broadcast(width), keys) if keys else pairs.withColumn("_d", width.scalar())
    w = grid_shape(F.col("_d"))[1]
    dy = F.floor(F.col("i") / w) - F.floor(F.col("j") / w)
    dx = F.col("i") % w - F.col("j") % w
    return both.withColumn("cell_dist", F.sqrt((dy * dy + dx * dx).cast("double"))).drop("_d")


def _packed_ranks(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """One record a key: ``keys…, d, feature, cell``, the two symmetric d x d rank matrices as int64 bytes."""
    schema = T.StructType([*[ranks.schema[k] for k in keys], *T.StructType.fromDDL("d int, feature binary, cell binary").fields])

    def pack(pairs: pd.DataFrame) -> pd.DataFrame:
        d = int(pairs["j"].max()) + 1
        i, j = pairs["i"].to_numpy(), pairs["j"].to_numpy()
        out = {k: [pairs[k].iloc[0]] for k in keys} | {"d": [d]}
        for name in ("feature", "cell"):
            full = np.zeros((d, d), np.int64)
            full[i, j] = full[j, i] = pairs[f"{name}_rank"]
            out[name] = [full.tobytes()]
        return pd.DataFrame(out)[schema.names]

    return ranks.groupBy(*keys).applyInPandas(pack, schema)


def _climb(feature: np.ndarray, cell: np.ndarray, perm: np.ndarray, error: int, swaps: np.ndarray) -> tuple[np.ndarray, int]:
    """Swaps that lower the squared gap are kept; only the two changed rows of the gap are recomputed."""
    for a, b in swaps:
        if a == b:
            continue
        new = perm.copy()
        new[a], new[b] = perm[b], perm[a]
        rows = [a, b]
        before = ((feature[perm[rows]][:, perm] - cell[rows]) ** 2).sum(axis=0)
        after = ((feature[new[rows]][:, new] - cell[rows]) ** 2).sum(axis=0)
        gain = after - before
        # symmetric matrix, zero diagonal: the pair (a, b) itself keeps its gap
        change = 2 * int(gain.sum() - gain[a] - gain[b])
        if change < 0:
            perm, error = new, error + change
    return perm, error


def search_placement(
    ranks: DataFrame, keys: list[str], seeds: list[int], steps: int = SWAP_STEPS, rounds: int = ROUNDS
) -> DataFrame:
    """Seeded swap searches per key, side by side in tasks, that exchange their best state between rounds.

    ``ranks`` has ``keys…, i, j, feature_rank, cell_rank``. Every search makes ``steps`` swaps of its own seed. After each
    round the searches that are behind go on from the best state of their key, except the first: it stays the plain
    search of its seed, so the best result is never worse than that. Returns ``keys…, seed, error, start_error, perm``.
    """
    rounds = rounds if len(seeds) > 1 else 1
    packed = materialize(_packed_ranks(ranks, keys), "ranks")
    state = T.StructType([*[ranks.schema[k] for k in keys], *T.StructType.fromDDL("seed int, error bigint, start bigint, perm array<int>, d int").fields])

    def advance(first: int, last: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.to_dict("records"):
                    d = int(r["d"])
                    feature, cell = (np.frombuffer(r[c], np.int64).reshape(d, d) for c in ("feature", "cell"))
                    perm = np.arange(d) if r["perm"] is None else np.array(r["perm"])
                    start = int(((feature - cell) ** 2).sum())
                    error = start if r["perm"] is None else int(r["error"])
                    swaps = np.random.default_rng(r["seed"]).integers(0, d, (steps, 2))[first:last]
                    perm, error = _climb(feature, cell, perm, error, swaps)
                    out = {k: [r[k]] for k in keys}
                    out |= {"seed": [r["seed"]], "error": [error], "start": [start], "perm": [perm.tolist()], "d": [d]}
                    yield pd.DataFrame(out)[state.names]

        return run

    held = packed.select(*keys, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    held = held.withColumns({"error": F.lit(None).cast("bigint"), "perm": F.lit(None).cast("array<int>")})
    for i in range(rounds):
        spread = held.join(packed, keys).repartition(*keys, "seed")  # one search a record
        held = spread.mapInPandas(advance(steps * i // rounds, steps * (i + 1) // rounds), state)
        if i + 1 == rounds:
            break
        held = materialize(held, "searches")
        best = held.groupBy(*keys).agg(F.min(F.struct("error", "seed", "perm")).alias("_best"))
        behind = (F.col("seed") != seeds[0]) & (F.col("error") > F.col("_best.error"))
        held = held.join(best, keys).select(
            *keys, "seed", *[F.when(behind, F.col(f"_best.{c}")).otherwise(F.col(c)).alias(c) for c in ("error", "perm")]
        )
    cells = F.col("d").cast("double") * F.col("d")
    return held.select(*keys, "seed", (F.col("error") / cells).alias("error"), (F.col("start") / cells).alias("start_error"), "perm")


def best_placement(found: DataFrame, keys: list[str]) -> DataFrame:
    """The search with the smallest error per key; ties by seed."""
    pick = found.groupBy(*keys).agg(F.min(F.struct("error", "seed", "start_error", "perm")).alias("m"))
    return pick.select(*keys, "m.*")


def placement_error(ranks: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys…, n_features, recomputed``: the mean squared rank gap of ``placed.perm``, pair by pair."""
    at = placed.select(*keys, F.posexplode("perm").alias("cell", "feature"))
    one, two = (at.select(*keys, F.col("feature").alias(f), F.col("cell").alias(c)) for f, c in (("i", "ci"), ("j", "cj")))
    pairs = ranks.select(*keys, "i", "j", "feature_rank").join(one, [*keys, "i"]).join(two, [*keys, "j"])
    ends = pairs.select(*keys, "feature_rank", F.least("ci", "cj").alias("i"), F.greatest("ci", "cj").alias("j"))
    gap = ends.join(ranks.select(*keys, "i", "j", "cell_rank"), [*keys, "i", "j"])
    square = F.sum(F.pow(F.col("feature_rank") - F.col("cell_rank"), 2)) * 2
    d = F.max("j") + 1
    return gap.groupBy(*keys).agg(d.alias("n_features"), (square / (d * d)).alias("recomputed"))


def placement_ranks(coded: DataFrame, keys: list[str], codes: str = "codes") -> DataFrame:
    """``keys…, i, j, feature_rank, cell_rank`` of all pairs of features."""
    pairs = materialize(feature_distance(coded, keys, codes), "pairs")
    return materialize(pair_ranks(grid_distance(pair_ranks(pairs, keys), keys), keys, "cell_dist", "cell_rank"), "pairs")


def fit_placement(
    coded: DataFrame, keys: list[str], codes: str = "codes", seeds: tuple[int, ...] = (LAYOUT_SEED,), steps: int = SWAP_STEPS
) -> DataFrame:
    """Correlation ranks, grid ranks and search in one go."""
    return best_placement(search_placement(placement_ranks(coded, keys, codes), keys, list(seeds), steps), keys)


# ---- rendering -------------------------------------------------------------------------------


def render_placement(codes: Column, perm: Column) -> Column:
    """Row-major grid image: cell i shows feature ``perm[i]``; spare cells are 0."""
    h, w = grid_shape(F.size(perm))
    shown = F.transform(perm, lambda p: F.element_at(codes, p + 1).cast("float"))
    spare = F.array_repeat(F.lit(0.0).cast("float"), h * w - F.size(perm))
    wrong = F.raise_error(F.lit("code width differs from the fitted placement")).cast("array<float>")
    return F.when(F.size(codes) == F.size(perm), F.concat(shown, spare)).otherwise(wrong)


def bar_heights(codes: Column) -> Column:
    """Bar height of each code: ``rint(z (d-1))`` after clipping to [0, 1]."""
    top = (F.size(codes) - 1).cast("double")
    return F.transform(
        codes, lambda z: F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), z)) * top).cast("int")
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def bit_patterns(codes: pd.Series) -> pd.Series:
    """32 big-endian IEEE-754 float32 bits of each code, as text."""
    if codes.empty:
        return codes
    return codes.map(lambda v: [f"{b:032b}" for b in np.asarray(v, np.float32).view(np.uint32)])


def native_pixels(layout: Column, d: Column) -> Column:
    """Pixels before resizing: grid h*w, bits 32*d, bars d*d."""
    h, w = grid_shape(d)
    pixels = F.when(layout == "placement", h * w).when(layout == "bits", d * 32).when(layout == "bars", d * d)
    return pixels.cast("bigint")


def pixel_eligibility(widths: DataFrame, layouts: tuple[str, ...] = ("placement", "bits", "bars")) -> DataFrame:
    """Which layouts of a code width may be rendered; decided before any rendering."""
    each = widths.withColumn("layout", F.explode(F.array(*[F.lit(x) for x in layouts])))
    each = each.withColumn("native_pixels", native_pixels(F.col("layout"), F.col("width")))
    status = F.when(F.col("native_pixels") > MAX_PIXELS, "SKIPPED_INELIGIBLE").otherwise("ELIGIBLE")
    return each.withColumn("status", status)


def _edges(length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(size) * length // size
    high = np.arange(1, size + 1) * length // size
    return low, np.where(high > low, high, low + 1)  # a bin narrower than a pixel shows that pixel


def times_shown(layout: str, d: int, size: int) -> np.ndarray | None:
    """How many pixels of a resized image show each native pixel of ``d`` codes; None where a pixel is a mean of several."""
    if layout == "placement":
        h = int(np.ceil(np.sqrt(d)))
        shape = (h, int(np.ceil(d / h)))
    else:
        shape = (d, 32 if layout == "bits" else d)
    if max(shape) > size:
        return None
    down, across = (np.bincount(_edges(n, size)[0], minlength=n) for n in shape)
    return np.outer(down, across).ravel()


def render_once(layout: str, times: np.ndarray, least: int):
    """Arrow UDF ``(codes, perm) -> ARRAY<FLOAT>``: native pixels, each times the root of how often the resized image shows it,
    and zeros up to ``least`` entries.

    Distances and inner products of these are those of the resized images, and so are principal components and what lies on them.
    """
    root = np.sqrt(times)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def image(codes: pd.Series, perm: pd.Series) -> pd.Series:
        out = []
        chunk = max(1, CHUNK_PIXELS // max(len(root), least))
        for at in range(0, len(codes), chunk):
            z = np.stack(codes.iloc[at : at + chunk].to_numpy()).astype(float)
            p = np.stack(perm.iloc[at : at + chunk].to_numpy()) if layout == "placement" else None
            shown = np.zeros((len(z), max(len(root), least)), np.float32)
            shown[:, : len(root)] = _render(layout, z, p).reshape(len(z), -1) * root
            out.extend(shown)
        return pd.Series(out, index=codes.index, dtype=object)

    return image


def _area_average(image: np.ndarray, size: int) -> np.ndarray:
    """Mean over integer bins along both axes, by differences of running sums."""
    for axis in (1, 2):
        lo, hi = _edges(image.shape[axis], size)
        shape = list(image.shape)
        shape[axis] = 1
        run = np.concatenate([np.zeros(shape), np.cumsum(image, axis=axis)], axis=axis)
        span = [1, 1, 1]
        span[axis] = size
        image = (run.take(hi, axis=axis) - run.take(lo, axis=axis)) / (hi - lo).reshape(span)
    return image


def _render(layout: str, z: np.ndarray, perm: np.ndarray | None) -> np.ndarray:
    n, d = z.shape
    if layout == "bits":
        octets = z.astype(">f4").view(np.uint8).reshape(n, d, 4)
        return np.unpackbits(octets, axis=2).astype(float)
    if layout == "bars":
        empty = d - np.rint(np.clip(z, 0, 1) * (d - 1)).astype(int)  # pixels above a bar
        image = np.zeros((n, d + 1, d))
        np.put_along_axis(image, empty[:, None, :], 1.0, axis=1)
        return np.maximum.accumulate(image, axis=1)[:, :d]
    h = int(np.ceil(np.sqrt(d)))
    w = int(np.ceil(d / h))
    flat = np.zeros((n, h * w))
    flat[:, :d] = np.take_along_axis(z, perm, axis=1).astype(np.float32)
    return flat.reshape(n, h, w)


def render_resized(layout: str, size: int = IMAGE_SIZE):
    """Arrow UDF ``(codes, perm) -> ARRAY<FLOAT>`` of size x size pixels, row-major.

    Rows are rendered in chunks of bounded pixels, so memory does not depend on the batch.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def image(codes: pd.Series, perm: pd.Series) -> pd.Series:
        out = []
        if len(codes):
            d = len(codes.iloc[0])
            native = {"bits": 32 * d, "bars": d * d}.get(layout, d)
            chunk = max(1, CHUNK_PIXELS // max(native, size * size))
            for at in range(0, len(codes), chunk):
                z = np.stack(codes.iloc[at : at + chunk].to_numpy()).astype(float)
                p = np.stack(perm.iloc[at : at + chunk].to_numpy()) if layout == "placement" else None
                shown = _area_average(_render(layout, z, p), size)
                out.extend(shown.reshape(len(z), -1).astype(np.float32))
        return pd.Series(out, index=codes.index, dtype=object)

    return image
