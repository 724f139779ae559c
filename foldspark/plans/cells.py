"""Running cells: encode, fit, score and evaluate, with typed outcomes.

Encodings are built once per encoder for all folds, stored by sides, and shared by its cells; the training sides of learners
that need one look at them are read in one pass for all cells. The driver only
loops over model fits, which are Spark jobs themselves; several run at a time. Predictions of
all cells go to one table and are evaluated together.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cache
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.operators import foldsafe as fs
from foldspark.operators import layouts as ly
from foldspark.operators import learners as ml
from foldspark.operators import metrics as mt
from foldspark.plans.outcomes import Outcome, protected
from foldspark.plans.runs import RunTable
from foldspark.plans.status import is_finite
from foldspark.session import materialize

FIT_ROLE = {"inner": "inner_train", "outer": "train"}
TEST_ROLE = {"inner": "inner_val", "outer": "test"}


@dataclass(frozen=True)
class Cell:
    """One run; ``layout`` is "none" for tabular cells."""

    outer_fold: int
    encoder: str
    model: str
    seed: int = 5
    layout: str = "none"
    protocol: str = "foldsafe"
    options: dict = field(default_factory=dict)
    config: str = ""  # tells cells apart that differ in their options only

    @property
    def cell_id(self) -> str:
        name = f"f{self.outer_fold}|{self.protocol}|{self.encoder}|{self.layout}|{self.model}|s{self.seed}"
        return f"{name}|{self.config}" if self.config else name


@dataclass
class Coded:
    """Scaled codes that cells share: ``rows`` by sides, and what learners that look at a training side once need of each."""

    rows: DataFrame
    gaps: Callable[[], dict[tuple[int, str], list]] | None = None


def coded_once(assigned: DataFrame, columns: list[str], encoder: str, protocol: str, cube: Callable[[], DataFrame], carry: list[str]) -> Coded:
    """For cells that all use a learner of ``ml.BY_GAPS``: training rows are coded in one pass that all of them share, only
    held-out rows are stored."""
    codes = _scaled(assigned, columns, encoder, protocol, cube, carry)
    held = codes.where(F.col("role").isin(*TEST_ROLE.values()))
    lock, made = Lock(), {}

    def gaps() -> dict[tuple[int, str], list]:
        with lock:  # the first cell makes them, under its own protection
            if not made:
                train = codes.where(F.col("role").isin(*FIT_ROLE.values()))
                sides = ml.class_gaps(train, range(len(columns)), keys=["outer_fold", "phase"]).collect()  # 2k records
                made.update({(r[0], r[1]): list(r[2:]) for r in sides})
        return made

    return Coded(materialize(held, "scaled", *fs.USE), gaps)


def scaled_codes(
    assigned: DataFrame, columns: list[str], encoder: str, protocol: str, cube: Callable[[], DataFrame] | None = None,
    carry: list[str] = [],
) -> DataFrame:
    """Scaled codes of all rows in all uses, as a shared table with a folder for each side of each fold: a cell reads its own.

    ``cube`` gives the fold cube of these rows, where cells share it; the columns of ``carry`` are passed on.
    """
    return materialize(_scaled(assigned, columns, encoder, protocol, cube, carry), "scaled", *fs.USE)


def _plain(columns: list[str], encoder: str) -> bool:
    return encoder in fs.PLAIN and len(columns) <= fs.NARROW and isinstance(columns, list)


def _scaled(
    assigned: DataFrame, columns: list[str], encoder: str, protocol: str, cube: Callable[[], DataFrame] | None, carry: list[str]
) -> DataFrame:
    plain = _plain(columns, encoder)
    width = len(columns) if plain else None
    passed = carry if plain else []
    keep = (lambda t: t) if width else (lambda t: materialize(t, "coded"))  # plain codes are looked up again sooner than read
    if protocol == "global":
        coded = keep(fs.encode_global(assigned, columns, encoder, passed).drop("protocol")).withColumn("state", F.lit("all"))
        # the contaminated scaler sees every row once: the outer phase of any one fold
        fit = (F.col("outer_fold") == 0) & (F.col("phase") == "outer")
        bounds = materialize(fs.scaler_bounds(coded, ["state"], fit, width), "bounds")
        scaled = fs.scale(coded, bounds, ["state"], width).drop("state")
    elif plain:
        scaled = fs.encode_scaled(assigned, columns, encoder, cube=cube() if cube else None, carry=passed)
    else:
        made = fs.encode_any(assigned, columns, encoder, cube=cube() if cube and encoder != "homals" else None)
        scaled = fs.scale_foldsafe(keep(made), width)
    if carry and not plain:
        scaled = scaled.join(assigned.select("row_id", *carry), "row_id")
    return scaled.select("row_id", "y", *carry, *fs.USE, F.col("scaled").alias("codes"))


def images(coded: DataFrame, cell: Cell, size: int, width: int | None = None) -> DataFrame:
    """Rendered rows of one fold; a placement is fitted per phase on its training side only.

    The global protocol fits one placement on all rows of the outer phase. Where ``width`` codes give fewer pixels than the
    resized image has, and the reader goes by principal components, a pixel is held once (``ly.render_once``).
    """
    rows = coded.where(F.col("outer_fold") == cell.outer_fold)
    render, times = ly.render_resized(cell.layout, size), ly.times_shown(cell.layout, width, size) if width else None
    if cell.model == "pca_mlp" and times is not None:
        render = ly.render_once(cell.layout, times, min(size * size, cell.options.get("components", ml.PCA_COMPONENTS)))
    if cell.layout != "placement":
        blank = F.array(F.lit(0))
        return rows.withColumn("image", render("codes", blank))
    steps = cell.options.get("steps", ly.SWAP_STEPS)
    if cell.protocol == "global":
        fit = rows.where("phase = 'outer'").withColumn("state", F.lit("all"))
        placed = ly.fit_placement(fit, ["state"], steps=steps).select("state", "perm")
        rows = rows.withColumn("state", F.lit("all")).join(F.broadcast(placed), "state").drop("state")
    else:
        fit = rows.where(F.col("role").isin("inner_train", "train"))
        placed = ly.fit_placement(fit, ["phase"], steps=steps).select("phase", "perm")
        rows = rows.join(F.broadcast(placed), "phase")
    return rows.withColumn("image", render("codes", "perm")).drop("perm")


def _fit_and_score(
    rows: DataFrame, gaps: Callable | None, cell: Cell, phase: str, column: str, table: RunTable, attempt: str
) -> None:
    """Fit on the training side, append the scores of the held-out side; scores must be finite."""
    side = rows.where(F.col("phase") == phase)
    options = {k: v for k, v in cell.options.items() if k not in ("steps", "size")}
    if gaps:
        fitted = ml.BY_GAPS[cell.model](gaps()[cell.outer_fold, phase], column, cell.seed, **options)
    else:
        learner: Callable = ml.LEARNERS[cell.model]
        fitted = learner(side.where(F.col("role") == FIT_ROLE[phase]), column, cell.seed, **options)
    scored = fitted.score(side.where(F.col("role") == TEST_ROLE[phase]))
    scored = scored.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("y").cast("int").alias("y_true"), F.col("y_score").cast("double").alias("y_score"), *table.carry)
    bad = table.write(scored, attempt, phase).where(~is_finite(F.col("y_score"))).count()
    if bad:
        raise FloatingPointError(f"{bad} scores are not finite")


def run_cell(
    spark: SparkSession, coded: Coded, cell: Cell, timeout_s: float | None, table: RunTable, attempt: str
) -> dict:
    """Both phases of one cell, appended to ``table``. Only inner outputs may inform a selection."""
    record = run_base(cell)

    def failed(stage: str, out: Outcome) -> dict:
        return record | {"status": out.status, "stage_of_failure": stage, "exception_class": out.exception_class}

    rows, column = coded.rows.where(F.col("outer_fold") == cell.outer_fold), "codes"
    if cell.layout != "none":
        width = rows.agg(F.max(F.size("codes"))).first()[0]
        pixels = spark.range(1).select(ly.native_pixels(F.lit(cell.layout), F.lit(width))).first()[0]
        if pixels > ly.MAX_PIXELS:  # decided before any rendering
            return failed("layout_eligibility", Outcome("SKIPPED_INELIGIBLE"))
        size = cell.options.get("size", ly.IMAGE_SIZE)
        out = protected(spark, lambda: materialize(images(coded.rows, cell, size, width), "images"), "LAYOUT_FAILURE", timeout_s)
        if out.status != "SUCCESS":
            return failed("layout_fit", out)
        rows, column = out.value, "image"
    for phase in ("inner", "outer"):
        out = protected(spark, lambda p=phase: _fit_and_score(rows, coded.gaps, cell, p, column, table, attempt), "TRAINING_FAILURE", timeout_s)
        if phase == "inner":
            record |= {"inner_status": out.status, "inner_elapsed_s": out.elapsed_s}
        if out.status != "SUCCESS":
            return failed(f"model_fit_{phase}", out)
    return record


def run_cells(
    assigned: DataFrame, columns: list[str], cells: list[Cell], timeout_s: float | None = None, parallel: int = 4,
    table: RunTable | None = None,
) -> DataFrame:
    """One record per cell with status, inner AUC, chosen threshold and outer metrics.

    With a ``table`` that already has records, their cells are not run again.
    """
    spark = assigned.sparkSession
    table = table or RunTable(spark)
    finished = table.finished()
    open_cells = [c for c in cells if c.cell_id not in finished]
    cube = cache(lambda: fs.fold_cube(assigned, columns))  # one for all encoders

    def coded(encoder: str, protocol: str) -> Coded:
        mine = [c for c in open_cells if (c.encoder, c.protocol) == (encoder, protocol)]
        if _plain(columns, encoder) and all(c.model in ml.BY_GAPS and c.layout == "none" for c in mine):
            return coded_once(assigned, columns, encoder, protocol, cube, table.carry)
        return Coded(scaled_codes(assigned, columns, encoder, protocol, cube, table.carry))

    encoded = {
        key: protected(spark, lambda k=key: coded(*k), "ENCODING_FAILURE", timeout_s)
        for key in dict.fromkeys((c.encoder, c.protocol) for c in open_cells)
    }

    def one(cell: Cell) -> None:
        out, attempt = encoded[(cell.encoder, cell.protocol)], table.attempt()
        if out.status == "SUCCESS":
            record = run_cell(spark, out.value, cell, timeout_s, table, attempt)
        else:
            failure = {"status": out.status, "stage_of_failure": "encoding", "exception_class": out.exception_class}
            record = run_base(cell) | failure
        table.commit(record, attempt)

    with ThreadPoolExecutor(parallel) as pool:
        list(pool.map(one, open_cells))
    wanted = spark.createDataFrame([(c.cell_id,) for c in cells], "run_id STRING")  # one name a cell
    return evaluate(*(t.join(F.broadcast(wanted), "run_id", "left_semi") for t in (table.runs(), table.predictions())))


def run_base(cell: Cell) -> dict:
    return {
        "run_id": cell.cell_id, "outer_fold": cell.outer_fold, "encoder": cell.encoder, "layout": cell.layout,
        "model": cell.model, "seed": cell.seed, "protocol": cell.protocol, "status": "SUCCESS",
        "stage_of_failure": None, "exception_class": None, "inner_status": None, "inner_elapsed_s": None,
        "config": cell.config,
    }


def evaluate(runs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Inner AUC and threshold, then outer metrics at that threshold, for all runs at once."""
    key = ["run_id"]
    inner, outer = (
        materialize(mt.histogram(predictions.where(F.col("phase") == p), key), "hist") for p in ("inner", "outer")
    )
    inner_auc = mt.ranking(inner, key).select("run_id", F.col("auc").alias("inner_auc"))
    thresholds = mt.select_threshold(inner, key).select("run_id", "threshold")
    outer = mt.panel(outer, key, thresholds).withColumnRenamed("status", "_ms")
    out = runs.join(inner_auc, key, "left").join(thresholds, key, "left").join(outer, key, "left")
    status = F.when(F.col("status") == "SUCCESS", F.coalesce("_ms", "status")).otherwise(F.col("status"))
    return out.withColumn("status", status).drop("_ms")


def contrast(assigned: DataFrame, columns: list[str], folds: list[int], encoder: str, layout: str, **options) -> DataFrame:
    """Both protocols and both arms on the same rows, folds and seeds: paired contrasts."""
    from foldspark.operators.selection import paired_contrast

    tabular = {k: v for k, v in options.items() if k == "trees"}
    image = {k: v for k, v in options.items() if k != "trees"}
    cells = [
        Cell(f, encoder, m, s, lay, p, o)
        for f in folds
        for p in ("global", "foldsafe")
        for m, s, lay, o in (("pca_mlp", 1042, layout, image), ("gbt_leaf", 5, "none", tabular))
    ]
    runs = run_cells(assigned, columns, cells)
    named = runs.select(
        "outer_fold",
        "encoder",
        F.when(F.col("protocol") == "global", "global").otherwise("safe").alias("protocol"),
        F.when(F.col("layout") == "none", "tabular").otherwise("image").alias("arm"),
        "status",
        "auc",
    )
    return paired_contrast(named, ["outer_fold", "encoder"])
