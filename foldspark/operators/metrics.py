"""Exact metrics of any number of scored runs at once, from score histograms.

``preds`` has the run keys and ``y_true, y_score``. Rows are first counted per (run, score);
everything else works on that histogram, and ordered sums use the piecewise scan, so one run
may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.operators.scan import prefix_scan
from foldspark.operators.skew import lookup
from foldspark.plans.status import is_finite
from foldspark.session import BROADCAST_ROWS, materialize, release

EPS = 1e-12  # fixed values of the metrics
DEFAULT_THRESHOLD = 0.5
MAX_THRESHOLDS = 200
LOGIT_RANGE = 1e-9
MAX_SLOPE = 1e4
NEWTON_ROUNDS = 24
STEPS_PER_TABLE = 4  # Newton steps planned as one job before the lineage is cut


def histogram(preds: DataFrame, keys: list[str]) -> DataFrame:
    return preds.groupBy(*keys, F.col("y_score").alias("score")).agg(
        F.count("*").alias("n"), F.sum("y_true").alias("pos")
    )


def _undefined(value: Column) -> Column:
    """A run with one class or with a score that is no number has no metrics: NULL, never a filler value."""
    return F.when((F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_rows")) & (F.col("_bad") == 0), value)


def _bad() -> Column:
    return F.sum(F.when(is_finite(F.col("score")), 0).otherwise(F.col("n"))).alias("_bad")


def ranking(hist: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Tie-aware ROC AUC and average precision per run; ``rows`` is the histogram's size if known."""
    scanned = prefix_scan(
        hist, [F.col("score").desc()], {"n_above": "n", "pos_above": "pos"}, within=keys, rows=rows
    )
    neg = F.col("n") - F.col("pos")
    lost = F.col("pos") * (F.col("n_above") - F.col("pos_above") + neg / 2)
    found = F.col("pos") * (F.col("pos_above") + F.col("pos")) / (F.col("n_above") + F.col("n"))
    sums = scanned.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.sum("pos").alias("n_pos"), F.sum(lost).alias("_lost"), F.sum(found).alias("_found"), _bad()
    )
    p, q = F.col("n_pos"), F.col("n_rows") - F.col("n_pos")
    return sums.select(
        *keys,
        "n_rows",
        "n_pos",
        _undefined(F.lit(1.0) - F.try_divide(F.col("_lost"), p * q)).alias("auc"),
        _undefined(F.try_divide(F.col("_found"), p)).alias("pr_auc"),
    )


def pointwise(hist: DataFrame, keys: list[str], thresholds: DataFrame | None = None) -> DataFrame:
    """Log loss, Brier, balanced accuracy and F1 per run; ``thresholds`` has ``keys, threshold``."""
    if thresholds is None:
        hist = hist.withColumn("threshold", F.lit(DEFAULT_THRESHOLD))
    else:
        sizes = hist.groupBy(*keys).agg(F.count("*").alias("_w"))
        own = materialize(sizes.join(thresholds, keys, "left"), "thresholds")
        hist = lookup(hist, own, keys, ["score"], weight="_w")
        hist = hist.withColumn("threshold", F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)))
    s, n, pos = F.col("score"), F.col("n"), F.col("pos")
    neg = n - pos
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), s))
    hit = s >= F.col("threshold")
    sums = hist.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.sum("pos").alias("n_pos"),
        F.sum(-(pos * F.log(p) + neg * F.log(1 - p))).alias("_ll"),
        F.sum(pos * (1 - s) * (1 - s) + neg * s * s).alias("_sq"),
        F.sum(F.when(hit, pos).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
        _bad(),
    )
    tp, fp, np_ = F.col("tp"), F.col("fp"), F.col("n_pos")
    nn = F.col("n_rows") - np_
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + (np_ - tp)), F.lit(0.0))
    return sums.select(
        *keys,
        "n_rows",
        "n_pos",
        _undefined(F.col("_ll") / F.col("n_rows")).alias("logloss"),
        _undefined(F.col("_sq") / F.col("n_rows")).alias("brier"),
        _undefined((F.try_divide(tp, np_) + F.try_divide(nn - fp, nn)) / 2).alias("balanced_accuracy"),
        _undefined(f1).alias("f1"),
    )


def calibration(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Slope and intercept of an unpenalized logistic fit of the label on logit(score).

    Grouped Newton: every round is one aggregation over all runs. Runs whose logits do not
    vary, or whose fit is singular, separable or not converged, get NULL.
    """
    s = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col("score")))
    x = hist.select(*keys, "n", "pos", F.log(s / (1 - s)).alias("x"))
    x = materialize(x, "logits")
    start = x.groupBy(*keys).agg(
        F.count("*").alias("_w"),
        (F.max("x") - F.min("x")).alias("_range"),
        F.sum("n").alias("n_rows"),
        F.sum("pos").alias("n_pos"),
    )
    zero = F.lit(0.0)
    fit = materialize(
        start.withColumns({"a": zero, "b": zero, "step": F.lit(float("inf"))}), "newton"
    )
    runs, old_fit = fit.count(), fit
    for _ in range(NEWTON_ROUNDS // STEPS_PER_TABLE):
        for _ in range(STEPS_PER_TABLE):
            fit = _newton_step(x, fit, keys, runs)
        fit = materialize(fit, "newton")
        release(old_fit)
        old_fit = fit
        if fit.where("step > 1e-9 AND abs(b) <= 1e6").isEmpty():
            break
    good = (
        (F.col("_range") >= LOGIT_RANGE)
        & (F.col("step") <= 1e-9)
        & (F.abs("b") <= MAX_SLOPE)
        & (F.col("n_pos") > 0)
        & (F.col("n_pos") < F.col("n_rows"))
    )
    return fit.select(
        *keys,
        F.when(good, F.col("b")).alias("calibration_slope"),
        F.when(good, F.col("a")).alias("calibration_intercept"),
    )


def _newton_step(x: DataFrame, fit: DataFrame, keys: list[str], runs: int) -> DataFrame:
    each = lookup(x, fit.select(*keys, "_w", "a", "b"), keys, ["x"], weight="_w", how="inner", rows=runs)
    each = each.withColumn("p", 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x")))))
    r = F.col("pos") - F.col("n") * F.col("p")
    w = F.col("n") * F.col("p") * (1 - F.col("p"))
    sums = each.groupBy(*keys).agg(
        F.sum(r).alias("g0"),
        F.sum(r * F.col("x")).alias("g1"),
        F.sum(w).alias("h00"),
        F.sum(w * F.col("x")).alias("h01"),
        F.sum(w * F.col("x") * F.col("x")).alias("h11"),
    )
    det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
    da = F.try_divide(F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1"), det)
    db = F.try_divide(F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0"), det)
    moved = sums.select(*keys, da.alias("da"), db.alias("db"))
    step = F.abs("da") + F.abs("db")
    return fit.join(moved, keys).select(
        *keys, "_w", "_range", "n_rows", "n_pos",
        (F.col("a") + F.col("da")).alias("a"), (F.col("b") + F.col("db")).alias("b"), step.alias("step"),
    )


def status(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Scores that are null, NaN or infinite make a run a numerical failure; one class leaves metrics undefined."""
    sums = hist.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.sum("pos").alias("n_pos"), _bad())
    one_class = (F.col("n_pos") == 0) | (F.col("n_pos") == F.col("n_rows"))
    word = F.when(F.col("_bad") > 0, "NUMERICAL_FAILURE").when(one_class, "METRIC_UNDEFINED").otherwise("SUCCESS")
    return sums.withColumn("status", word).drop("_bad")


def panel(hist: DataFrame, keys: list[str], thresholds: DataFrame | None = None) -> DataFrame:
    """All metrics in one record per run; ``hist`` should be materialized."""
    points = pointwise(hist, keys, thresholds).drop("n_rows", "n_pos")
    fitted = calibration(hist, keys)
    out = ranking(hist, keys, hist.count()).join(points, keys).join(fitted, keys)
    out = out.join(status(hist, keys).select(*keys, "status"), keys)
    failed = F.col("status") == "NUMERICAL_FAILURE"
    return out.withColumns({c: F.when(~failed, F.col(c)) for c in fitted.columns if c not in keys})


def select_threshold(hist: DataFrame, keys: list[str]) -> DataFrame:
    """First threshold with the best F1 among midpoints of the distinct scores.

    More than 200 candidates are thinned to 200 evenly spaced ones (truncated positions). One
    distinct score or one class gives the default. ``hist`` should be materialized.
    """
    totals = hist.groupBy(*keys).agg(
        F.count("*").alias("_scores"), F.sum("n").alias("n_rows"), F.sum("pos").alias("n_pos")
    )
    totals = materialize(totals, "totals")
    scanned = prefix_scan(
        hist, ["score"], {"i": F.lit(1), "n_below": "n", "pos_below": "pos"}, within=keys,
        following={"next_score": "score"}, rows=hist.count(),
    )
    usable = "_scores > 1 AND n_pos > 0 AND n_pos < n_rows"
    runs = totals.count()
    each = lookup(scanned, totals, keys, ["score"], weight="_scores", how="inner", rows=runs)
    each = each.where("next_score IS NOT NULL AND n_pos > 0 AND n_pos < n_rows")
    kept = _kept_positions(totals)  # at most 200 records per run
    kept = F.broadcast(kept) if runs * MAX_THRESHOLDS <= BROADCAST_ROWS else kept
    each = each.join(kept, [*keys, "i"], "left_semi")
    tp = F.col("n_pos") - F.col("pos_below") - F.col("pos")
    called = F.col("n_rows") - F.col("n_below") - F.col("n")
    f1 = F.round(2 * tp / (called + F.col("n_pos")), 12)
    best = each.groupBy(*keys).agg(
        F.max(F.struct(f1.alias("f1"), (-F.col("i")).alias("i"), ((F.col("score") + F.col("next_score")) / 2).alias("t"))).alias("m")
    )
    default = F.lit(DEFAULT_THRESHOLD)
    return totals.withColumn("_usable", F.expr(usable)).join(best, keys, "left").select(
        *keys, F.when(F.col("_usable"), F.col("m.t")).otherwise(default).alias("threshold"), F.col("m.f1").alias("best_f1")
    )


def _kept_positions(totals: DataFrame) -> DataFrame:
    keys = [c for c in totals.columns if c not in ("_scores", "n_rows", "n_pos")]
    last = F.col("_scores") - 2  # position of the last candidate
    spaced = F.transform(
        F.sequence(F.lit(0), F.lit(MAX_THRESHOLDS - 1)),
        lambda j: F.when(j == MAX_THRESHOLDS - 1, last).otherwise(
            F.floor(j * (last / F.lit(float(MAX_THRESHOLDS - 1))))
        ),
    )
    every = F.sequence(F.lit(0).cast("bigint"), last)
    kept = F.when(last + 1 > MAX_THRESHOLDS, F.array_distinct(spaced)).otherwise(every)
    return totals.where("_scores > 1").select(*keys, F.explode(kept).alias("i"))
