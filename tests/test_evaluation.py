"""Metrics against brute force, selection contracts, typed outcomes."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from foldspark.operators import metrics as mt
from foldspark.operators import scan
from foldspark.operators import selection as sel
from foldspark.plans import outcomes
from foldspark.plans import status as st
from foldspark.session import materialize

RUN = ["run_id"]


def preds(spark, runs: dict[str, list[tuple[int, float]]]):
    rows = [(run, y, float(s)) for run, pairs in runs.items() for y, s in pairs]
    return spark.createDataFrame(rows, "run_id STRING, y_true INT, y_score DOUBLE")


def hist(spark, runs):
    return materialize(mt.histogram(preds(spark, runs), RUN), "hist")


def brute(pairs, threshold=0.5):
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0
    for t in sorted({s for _, s in pairs}, reverse=True):
        tp = sum(p >= t for p in pos)
        ap += (tp - last) / len(pos) * tp / sum(s >= t for _, s in pairs)
        last = tp
    clip = lambda s: min(max(s, 1e-12), 1 - 1e-12)
    ll = -sum(math.log(clip(s)) if y else math.log(1 - clip(s)) for y, s in pairs) / len(pairs)
    tp, fp = sum(p >= threshold for p in pos), sum(n >= threshold for n in neg)
    f1 = 2 * tp / (2 * tp + fp + len(pos) - tp) if tp or fp or pos else 0.0
    return {
        "auc": auc, "pr_auc": ap, "logloss": ll, "brier": sum((y - s) ** 2 for y, s in pairs) / len(pairs),
        "balanced_accuracy": (tp / len(pos) + (len(neg) - fp) / len(neg)) / 2, "f1": f1,
    }


def random_run(seed, n=300, digits=2):
    rng = random.Random(seed)
    return [(y, round(min(1, max(0, rng.random() * 0.8 + 0.2 * y)), digits)) for y in (rng.randint(0, 1) for _ in range(n))]


@pytest.mark.parametrize("small_sort", [200_000, 0])
def test_panel_matches_brute_force(spark, monkeypatch, small_sort):
    monkeypatch.setattr(scan, "SINGLE_TASK_ROWS", small_sort)
    runs = {f"r{i}": random_run(i, digits=1 + i) for i in range(3)}
    out = {r.run_id: r for r in mt.panel(hist(spark, runs), RUN).collect()}
    for name, pairs in runs.items():
        for metric, value in brute(pairs).items():
            assert out[name][metric] == pytest.approx(value, abs=1e-9), (name, metric)
        assert out[name].status == "SUCCESS"


def test_constant_scores_single_class_and_extreme_threshold(spark):
    runs = {
        "constant": [(int(i % 3 == 0), 0.125) for i in range(21)],
        "single": [(0, i / 16) for i in range(11)],
        "majority": [(1, 0.75), (1, 0.5), (1, 0.25)] + [(0, 0.25)] * 6 + [(0, 0.0)] * 8,
    }
    limits = spark.createDataFrame([("majority", 0.8)], "run_id STRING, threshold DOUBLE")
    out = {r.run_id: r for r in mt.panel(hist(spark, runs), RUN, limits).collect()}
    assert out["constant"].auc == 0.5 and out["constant"].status == "SUCCESS"
    assert out["constant"].calibration_slope is None
    single = out["single"]
    assert single.status == "METRIC_UNDEFINED"
    assert all(single[m] is None for m in ("auc", "pr_auc", "logloss", "brier", "balanced_accuracy", "f1", "calibration_slope"))
    assert out["majority"].auc > 0.5 and out["majority"].f1 == 0.0


def test_calibration_recovers_the_logistic_and_rejects_separation(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(4000):
        x = rng.gauss(0, 1)
        y = int(rng.random() < 1 / (1 + math.exp(-(0.4 + 1.7 * x))))
        pairs.append((y, 1 / (1 + math.exp(-x))))
    split = [(int(s > 0.5), s) for s in (rng.random() for _ in range(200))]
    out = {r.run_id: r for r in mt.calibration(hist(spark, {"fit": pairs, "separable": split}), RUN).collect()}
    assert out["fit"].calibration_slope == pytest.approx(1.7, abs=0.15)
    assert out["fit"].calibration_intercept == pytest.approx(0.4, abs=0.15)
    assert out["separable"].calibration_slope is None


def brute_threshold(pairs):
    uniq = sorted({s for _, s in pairs})
    if len(uniq) == 1 or len({y for y, _ in pairs}) < 2:
        return 0.5
    cands = [(a + b) / 2 for a, b in zip(uniq, uniq[1:])]
    if len(cands) > 200:
        last = len(cands) - 1
        at = [int(j * (last / 199)) for j in range(199)] + [last]
        cands = [cands[i] for i in at]
    f1 = [round(brute(pairs, t)["f1"], 12) for t in cands]
    return cands[f1.index(max(f1))]


@pytest.mark.parametrize("small_sort", [200_000, 0])
def test_threshold_is_the_first_best_candidate(spark, monkeypatch, small_sort):
    monkeypatch.setattr(scan, "SINGLE_TASK_ROWS", small_sort)
    runs = {"few": random_run(1, 200, 1), "many": random_run(2, 600, 6), "one": [(i % 2, 0.4) for i in range(9)], "pure": [(1, i / 9) for i in range(9)]}
    out = {r.run_id: r.threshold for r in mt.select_threshold(hist(spark, runs), RUN).collect()}
    for name, pairs in runs.items():
        assert out[name] == pytest.approx(brute_threshold(pairs), abs=1e-12), name


# ---- selection -------------------------------------------------------------------------------

CAND = "k STRING, config_id STRING, inner_metric DOUBLE, complexity DOUBLE, fit_time_s DOUBLE, status STRING"


def chosen(spark, cands, refits):
    c = spark.createDataFrame([("k", *x) for x in cands], CAND)
    r = spark.createDataFrame([("k", *x) for x in refits], "k STRING, config_id STRING, refit_status STRING")
    return sel.select_with_fallback(c, r, ["k"]).first()


def test_only_failed_refits_are_skipped(spark):
    cands = [("a", 0.9, 1.0, 1.0, "SUCCESS"), ("b", 0.8, 1.0, 1.0, "SUCCESS"), ("c", 0.95, 1.0, 1.0, "TIMEOUT")]
    out = chosen(spark, cands, [("a", "METRIC_UNDEFINED"), ("b", "SUCCESS"), ("c", "SUCCESS")])
    assert (out.config_id, out.n_fallbacks, out.status) == ("a", 0, "METRIC_UNDEFINED")
    out = chosen(spark, cands, [("a", "TIMEOUT"), ("b", "SUCCESS")])
    assert (out.config_id, out.n_fallbacks) == ("b", 1)
    out = chosen(spark, cands, [("a", "TIMEOUT"), ("b", "TRAINING_FAILURE")])
    assert (out.config_id, out.n_fallbacks, out.status) == (None, 2, "TRAINING_FAILURE")
    out = chosen(spark, [("a", None, 1.0, 1.0, "SUCCESS")], [("a", "SUCCESS")])
    assert (out.config_id, out.n_fallbacks, out.status) == (None, 0, "TRAINING_FAILURE")


def test_tie_break_names_the_deciding_key(spark):
    def label(*tied):
        rows = [("k", f"c{i}", 0.5, float(c), float(t), "SUCCESS") for i, (c, t) in enumerate(tied)]
        return sel.tie_break(spark.createDataFrame(rows, CAND), ["k"]).first().tie_break

    assert label((1, 1)) == "none"
    assert label((1, 1), (2, 1)) == "complexity"
    assert label((1, 1), (1, 2)) == "fit_time"
    assert label((1, 1), (1, 1)) == "config_id"


def test_candidates_have_no_outer_column():
    assert "outer" not in CAND


def test_paired_reports(spark):
    rows = [
        ("d1", "global", "image", "SUCCESS", 0.9), ("d1", "global", "tabular", "SUCCESS", 0.8),
        ("d1", "safe", "image", "SUCCESS", 0.7), ("d1", "safe", "tabular", "SUCCESS", 0.75),
        ("d2", "global", "image", "LAYOUT_FAILURE", None), ("d2", "global", "tabular", "SUCCESS", 0.8),
        ("d2", "safe", "image", "SUCCESS", 0.5), ("d2", "safe", "tabular", "SUCCESS", 0.75),
    ]
    runs = spark.createDataFrame(rows, "k STRING, protocol STRING, arm STRING, status STRING, auc DOUBLE")
    out = {r.k: r for r in sel.paired_contrast(runs, ["k"]).collect()}
    assert out["d1"].b_delta == pytest.approx((0.9 - 0.8) - (0.7 - 0.75))
    assert out["d2"].b_delta is None and out["d2"].status == "PARTIAL_FAILURE" and out["d2"].notes == "global_image=LAYOUT_FAILURE"
    pairs = runs.withColumn("arm", F.concat_ws("_", "protocol", "arm"))
    reasons = {r.reason: r.n_keys for r in sel.paired_exclusions(pairs, ["k"], []).collect()}
    assert reasons == {None: 1, "global_image:LAYOUT_FAILURE": 1}
    kept = sel.status_aggregate(runs.withColumn("all", F.lit(1)), ["all"]).first()
    assert (kept.n_runs, kept.n_success) == (8, 7)


# ---- outcomes --------------------------------------------------------------------------------


def test_typed_outcomes(spark):
    def boom(e):
        def run():
            raise e

        return run

    def status(e):
        return outcomes.protected(spark, boom(e), "ENCODING_FAILURE").status

    assert status(MemoryError()) == "RESOURCE_LIMIT"
    assert status(FloatingPointError()) == "NUMERICAL_FAILURE"
    assert status(ImportError("x")) == "DEPENDENCY_UNAVAILABLE"
    assert status(ValueError("x")) == "ENCODING_FAILURE"
    divide = lambda: spark.range(3).select(F.lit(1) / F.col("id")).collect()
    assert outcomes.protected(spark, divide, "ENCODING_FAILURE").status == "NUMERICAL_FAILURE"
    out = outcomes.protected(spark, boom(ValueError(r"cannot open C:\secret\file.txt " + "z" * 500)), "TRAINING_FAILURE")
    assert "secret" not in out.message and len(out.message) <= 300


def test_timeout_returns_promptly_and_stops_the_job(spark):
    slow = F.udf(lambda x: time.sleep(30) or x)
    started = time.time()
    out = outcomes.protected(spark, lambda: spark.range(4).select(slow("id")).collect(), "TRAINING_FAILURE", timeout_s=0.3)
    assert out.status == "TIMEOUT" and time.time() - started < 2


def test_status_gate(spark):
    rows = spark.createDataFrame([("SUCCESS", 0.5), ("TIMEOUT", 0.9)], "status STRING, auc DOUBLE")
    assert [(r.auc, r.is_failure) for r in st.gate(rows, ["auc"]).collect()] == [(0.5, False), (None, True)]
    with pytest.raises(Exception, match="unknown status"):
        st.gate(rows.withColumn("status", F.lit("FINE")), ["auc"]).collect()


def test_nonfinite_guard(spark):
    rows = [("a", [0.1]), ("b", [float("nan")]), ("c", [float("inf")]), ("d", [None])]
    df = spark.createDataFrame(rows, "run_id STRING, codes ARRAY<DOUBLE>")
    out = {r.run_id: r.status for r in st.nonfinite_guard(df, ["run_id"], "codes").collect()}
    assert out == {"a": "SUCCESS", "b": "NUMERICAL_FAILURE", "c": "NUMERICAL_FAILURE", "d": "NUMERICAL_FAILURE"}


def test_a_score_that_is_no_number_fails_the_run(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), ("a", 1, float("nan")), ("b", 1, 0.9), ("b", 0, 0.1), ("c", 1, None), ("c", 0, 0.2)]
    preds = spark.createDataFrame(rows, "run string, y_true int, y_score double")
    hist = mt.histogram(preds, ["run"])
    got = {r.run: (r.status, r.auc, r.logloss is None) for r in mt.panel(hist, ["run"]).collect()}
    assert got == {"a": ("NUMERICAL_FAILURE", None, True), "b": ("SUCCESS", 1.0, False), "c": ("NUMERICAL_FAILURE", None, True)}


def test_paths_of_every_kind_leave_the_message():
    from foldspark.plans.outcomes import sanitize_text

    text = "open '/mnt/secret/user/file.txt' or D:\\x\\y or hdfs://host/p and/or nothing"
    assert sanitize_text(text) == "open '<path>' or <path> or <path> and/or nothing"
