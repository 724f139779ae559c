"""Sources, sinks, streaming apply and complete cells."""

import gzip
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from toy import COLS
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldspark.operators import cube as cb
from foldspark.operators import encoders as enc
from foldspark.operators import foldsafe as fs
from foldspark.operators import layouts as ly
from foldspark.plans import cells as cl
from foldspark.session import materialize
from foldspark.sources import categories as cat
from foldspark.sources import rowsets as rs
from foldspark.sources import sinks
from foldspark.streaming.apply import encode_stream

SF = "/root/testdata/sf0.001"


def test_delimited_sources(spark, tmp_path):
    plain = tmp_path / "boards.data"
    plain.write_text("x,o,?,positive\no,x,b,negative\n")
    df = cat.read_headerless(spark, str(plain), ["sq1", "sq2", "sq3", "outcome"])
    assert [tuple(r) for r in df.collect()] == [("x", "o", "?", "positive"), ("o", "x", "b", "negative")]
    y = df.select(cat.define_target(F.col("outcome"), "positive").alias("y")).collect()
    assert [r.y for r in y] == [1, 0]

    header = tmp_path / "mols.csv"
    header.write_text("mol,Class\nCC,1\nCO,0\n")
    schema = T.StructType([T.StructField("mol", T.StringType()), T.StructField("Class", T.IntegerType())])
    assert [tuple(r) for r in cat.read_with_header(spark, str(header), schema).collect()] == [("CC", 1), ("CO", 0)]

    packed = tmp_path / "parity.tsv.gz"
    with gzip.open(packed, "wt") as f:
        f.write("a\tb\ttarget\n0\t1\t1\n1\t1\t0\n")
    ints = T.StructType([T.StructField(c, T.IntegerType()) for c in ("a", "b", "target")])
    df = cat.normalize(cat.read_gzip_tsv(spark, str(packed), ints, 2), ["a", "b"])
    assert sorted(tuple(r) for r in df.collect()) == [("0", "1", 1), ("1", "1", 0)]
    files = cat.file_fingerprints(spark, str(packed)).first()
    assert len(files.sha256) == 64 and files.length == packed.stat().st_size


def test_fingerprint_ignores_order_but_not_content(spark, toy):
    a = cat.fingerprint(toy, COLS).first()
    assert cat.fingerprint(toy.orderBy(F.rand(1)), COLS).first() == a
    changed = toy.withColumn("a", F.when(F.col("row_id") == 3, "changed").otherwise(F.col("a")))
    assert cat.fingerprint(changed, COLS).first() != a


def test_records_predictions_folds_and_reports(spark, tmp_path, uses):
    schema = "run_id STRING, status STRING, auc DOUBLE"
    rows = spark.createDataFrame([("r1", "SUCCESS", 0.5), ("r2", "TIMEOUT", float("nan"))], schema)
    root = str(tmp_path / "records")
    sinks.append_records(rows, root, "runs")
    sinks.append_records(rows, root, "runs")
    sinks.append_records(rows, root, "other")
    back = sorted(map(tuple, sinks.read_records(spark, root, "runs", schema).collect()), key=str)
    assert back == [("r1", "SUCCESS", 0.5)] * 2 + [("r2", "TIMEOUT", None)] * 2

    preds = spark.createDataFrame([("a|b", 2**40, 1, 1 / 3), ("c", 1, 0, 1e-300)], sinks.PREDICTION_SCHEMA.replace("TINYINT", "INT"))
    path = str(tmp_path / "preds")
    sinks.write_predictions(preds, path)
    assert sorted(map(tuple, sinks.read_predictions(spark, path).collect())) == sorted(map(tuple, preds.collect()))

    folds = str(tmp_path / "folds")
    sinks.write_folds(uses, folds)
    again = sinks.read_folds(spark, folds)
    assert again.select(*uses.columns).exceptAll(uses).isEmpty() and again.count() == uses.count()

    report = str(tmp_path / "report")
    sinks.write_report(rows, report, ["run_id"])
    assert [r.run_id for r in spark.read.option("header", True).csv(report).collect()] == ["r1", "r2"]


def test_stream_codes_equal_batch_codes(spark, tmp_path):
    events = rs.table(spark, SF, "events")
    source = str(tmp_path / "events")
    events.repartition(3).write.parquet(source)
    rows = rs.event_rows(events)
    columns = rs.EVENTS_COLUMNS
    states = cb.whole_states(rows.where("hour <> '3'"), columns)  # hour 3 is unseen at fit
    codes = materialize(enc.woe_codes(states).select("col", "level", "n", "code"), "fitted")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = encode_stream(rs.event_rows(stream), codes, columns, 0.0).select("row_id", "codes")
    sink = str(tmp_path / "out")
    query = (
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .outputMode("append").trigger(availableNow=True).start(sink)
    )
    query.awaitTermination(120)
    assert query.exception() is None
    batch = fs.apply_plain(rows, codes, columns, F.lit(0.0)).select("row_id", "codes")
    got = spark.read.schema(out.schema).parquet(sink)
    assert got.count() == events.count() and got.exceptAll(batch).isEmpty()


def test_a_state_changes_between_micro_batches(spark, tmp_path):
    from foldspark.streaming.apply import VersionedState, encode_versions

    def state_of(shift):
        states = spark.createDataFrame([("user", "1", 3, 0.1 + shift), ("hour", "5", 2, 0.2 + shift)], "col STRING, level STRING, n INT, code DOUBLE")
        return states, spark.createDataFrame([("user", 0.5 + shift), ("hour", 0.6 + shift)], "col STRING, code DOUBLE")

    state = VersionedState(spark, f"{tmp_path}/state")
    assert state.current() is None
    source, schema = f"{tmp_path}/in", "row_id BIGINT, user STRING, hour STRING"
    got = {}
    for batch, rows in enumerate([[(1, "1", "5"), (2, "9", None)], [(3, "1", "5"), (4, None, "7")]]):
        assert state.publish(*state_of(float(batch))) == batch + 1
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        run = encode_versions(stream, state, ["user", "hour"], f"{tmp_path}/out", f"{tmp_path}/progress", ["row_id"])
        run.awaitTermination(120)
        assert run.exception() is None
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        got[r.row_id] = (r.version, [round(c, 6) for c in r.codes])
    assert got == {1: (1, [0.1, 0.2]), 2: (1, [0.5, 0.6]), 3: (2, [1.1, 1.2]), 4: (2, [1.5, 1.6])}


def test_a_job_after_the_timeout_never_starts(spark):
    import time

    from foldspark.plans.outcomes import protected

    state = {}

    def stage():
        state["group"] = spark.sparkContext.getLocalProperty("spark.jobGroup.id")
        try:
            time.sleep(2)  # time is up while no job runs
            state["second"] = spark.range(1000).repartition(3).count()
        except Exception as e:  # noqa: BLE001
            state["error"] = str(e)
            raise
        finally:
            state["over"] = True

    out = protected(spark, stage, "TRAINING_FAILURE", timeout_s=0.5)
    assert out.status == "TIMEOUT" and out.elapsed_s < 1.9
    for _ in range(100):
        if "over" in state:
            break
        time.sleep(0.1)
    assert "second" not in state and "cancel" in state["error"].lower()
    # other work is not touched
    assert protected(spark, lambda: spark.range(10).count(), "TRAINING_FAILURE", timeout_s=60).value == 10


def test_cells_have_typed_outcomes(spark, assigned):
    grid = [
        cl.Cell(0, "target", "logistic"),
        cl.Cell(0, "count", "mlp", options={"hidden": 0}),
        cl.Cell(0, "no_such_encoder", "logistic"),
        cl.Cell(1, "target", "pca_mlp", layout="placement", options={"size": 4, "components": 3, "hidden": 4, "iterations": 10, "steps": 50}),
    ]
    out = {r.run_id: r for r in cl.run_cells(assigned, COLS, grid).collect()}
    good = out[grid[0].cell_id]
    assert good.status == "SUCCESS" and 0 <= good.auc <= 1 and good.inner_status == "SUCCESS" and math.isfinite(good.logloss)
    assert (out[grid[1].cell_id].status, out[grid[1].cell_id].stage_of_failure) == ("TRAINING_FAILURE", "model_fit_inner")
    assert (out[grid[2].cell_id].status, out[grid[2].cell_id].stage_of_failure) == ("ENCODING_FAILURE", "encoding")
    assert out[grid[2].cell_id].auc is None
    assert out[grid[3].cell_id].status == "SUCCESS"


def test_a_restart_runs_only_what_is_not_committed(spark, assigned, tmp_path, monkeypatch):
    from foldspark.plans.runs import RunTable

    def cell(fold, last):
        return cl.Cell(fold, "target", "signed_mean", options={"last": last}, config=f"c{last}")

    grid = [cell(0, 4), cell(0, 2), cell(0, 9), cell(1, 4)]
    ran = []
    whole = cl.run_cell
    monkeypatch.setattr(cl, "run_cell", lambda spark, coded, c, *rest: ran.append(c.cell_id) or whole(spark, coded, c, *rest))
    table = RunTable(spark, f"{tmp_path}/run")
    assert table.predictions().count() == 0 and table.finished() == set()
    cl.run_cells(assigned, COLS, grid[:2], table=table)
    # an attempt that was interrupted before its record: its rows are never read
    junk = spark.createDataFrame([(1, 1, 0.5)], "row_id BIGINT, y_true INT, y_score DOUBLE")
    table.write(junk, table.attempt(), "outer")
    first = {r.run_id: r for r in cl.run_cells(assigned, COLS, grid, table=RunTable(spark, table.path)).collect()}
    assert sorted(ran) == sorted(c.cell_id for c in grid)  # none of them twice
    assert {r.status for r in first.values()} == {"SUCCESS", "TRAINING_FAILURE"}
    assert first[grid[2].cell_id].exception_class == "ValueError" and first[grid[2].cell_id].auc is None
    again = {r.run_id: r for r in cl.run_cells(assigned, COLS, grid, table=table).collect()}
    assert len(ran) == len(grid) and again == first
    alone = cl.run_cells(assigned, COLS, [grid[3]]).first()
    assert (alone.auc, alone.threshold) == (first[grid[3].cell_id].auc, first[grid[3].cell_id].threshold)


def test_signed_mean_and_finite_scores(spark):
    from foldspark.operators import learners as ml

    rows = [(i, i % 2, [0.1 * (i % 2), 0.9 - 0.5 * (i % 2), 0.3]) for i in range(10)]
    train = spark.createDataFrame(rows, "row_id BIGINT, y INT, codes ARRAY<DOUBLE>")
    fitted = ml.fit_signed_mean(train)
    assert fitted.signs == [1.0, -1.0, 1.0]
    for r in fitted.score(train).collect():
        a, b, c = r.codes
        assert r.y_score == pytest.approx(0.5 + ((a - 0.5) - (b - 0.5) + (c - 0.5)) / 3, abs=1e-9)
    with pytest.raises(ValueError):
        ml.fit_signed_mean(train, first=3)


def test_scores_that_are_not_finite_fail_the_cell(spark, assigned, monkeypatch):
    from foldspark.operators import learners as ml

    class Odd:
        def score(self, df):
            return df.withColumn("y_score", F.when(F.col("row_id") % 7 == 0, F.lit(float("nan"))).otherwise(0.5))

    monkeypatch.setitem(ml.LEARNERS, "odd", lambda train, codes="codes", seed=5: Odd())
    out = cl.run_cells(assigned, COLS, [cl.Cell(0, "count", "odd")]).first()
    assert (out.status, out.stage_of_failure, out.exception_class) == ("NUMERICAL_FAILURE", "model_fit_inner", "FloatingPointError")


def test_choice_ignores_outer_labels(spark, toy, uses):
    """Permuted test labels change outer results at most, never inner ones."""
    from foldspark.operators import splits

    grid = [cl.Cell(0, e, "logistic") for e in ("target", "count")]
    assigned = splits.assign(toy, uses)
    test = F.exists("uses", lambda u: (u["outer_fold"] == 0) & (u["role"] == "test"))
    flipped = assigned.withColumn("y", F.when(test, 1 - F.col("y")).otherwise(F.col("y")))
    a, b = ({r.run_id: r for r in cl.run_cells(materialize(d, "d"), COLS, grid).collect()} for d in (assigned, flipped))
    for run in a:
        # fits add floats in task order, so scores may differ in the last digit
        assert a[run].inner_auc == b[run].inner_auc
        assert a[run].threshold == pytest.approx(b[run].threshold, abs=1e-9)
    assert any(a[run].auc != b[run].auc for run in a)


def test_a_cell_reads_only_its_side_of_the_scaled_codes(assigned):
    for encoder, protocol in (("target", "foldsafe"), ("count", "global")):
        coded = cl.scaled_codes(assigned, COLS, encoder, protocol)
        side = coded.where("outer_fold = 1 AND phase = 'inner' AND role = 'inner_train'")
        folders = side._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("PushedFilters")[0]
        assert all(c in folders for c in fs.USE)
        assert 0 < side.count() < coded.count()


def test_narrow_codes_are_scaled_like_wide_ones(assigned):
    coded = fs.encode(assigned, COLS, "target")
    wide, narrow = (fs.scale_foldsafe(coded, w).select("row_id", *fs.USE, "codes", "scaled") for w in (None, len(COLS)))
    assert sorted(wide.collect()) == sorted(narrow.collect())


def test_bounds_from_the_cube_are_those_of_the_rows(assigned):
    for name in fs.PLAIN:
        rows = fs.scale_foldsafe(fs.encode(assigned, COLS, name)).select("row_id", *fs.USE, "scaled")
        cube = fs.encode_scaled(assigned, COLS, name).select("row_id", *fs.USE, "scaled")
        assert sorted(cube.collect()) == sorted(rows.collect())


def test_cells_share_one_pass_over_the_training_sides(spark, assigned, monkeypatch, tmp_path):
    from foldspark.operators import learners as ml
    from foldspark.plans.runs import RunTable

    kinds = [("foldsafe", 2), ("foldsafe", 4), ("global", 4)]
    grid = [cl.Cell(0, "target", "signed_mean", protocol=p, options={"last": n}, config=f"c{n}") for p, n in kinds]
    monkeypatch.setattr(cl, "evaluate", lambda runs, predictions: runs)
    passes, stored, whole, kept = [], [], ml.class_gaps, cl.coded_once
    monkeypatch.setattr(ml, "class_gaps", lambda *a, **k: passes.append(1) or whole(*a, **k))
    monkeypatch.setattr(cl, "coded_once", lambda *a: stored.append(kept(*a)) or stored[-1])
    shared = RunTable(spark, f"{tmp_path}/shared", "b STRING")
    cl.run_cells(assigned, COLS, grid, table=shared)
    assert len(passes) == 2  # one for each encoding, not one for each phase of each cell
    for coded in stored:
        assert {r.role for r in coded.rows.select("role").distinct().collect()} == {"inner_val", "test"}
    monkeypatch.setattr(ml, "BY_GAPS", {})
    alone = RunTable(spark, f"{tmp_path}/alone")
    cl.run_cells(assigned, COLS, grid, table=alone)
    names = ["run_id", "phase", "row_id", "y_true", "y_score"]
    assert sorted(shared.predictions().select(names).collect()) == sorted(alone.predictions().select(names).collect())
    carried = shared.predictions().select("row_id", "b").distinct()
    assert carried.join(assigned.select("row_id", "b"), ["row_id", "b"], "left_anti").count() == 0 < carried.count()


def test_contrast_run_takes_all_folds_and_full_presets(spark, monkeypatch):
    from foldspark.catalog import q_models

    asked = []
    monkeypatch.setattr(q_models, "assigned_orders", lambda spark, sf: None)
    monkeypatch.setattr(cl, "run_cells", lambda assigned, columns, cells: asked.extend(cells) or spark.createDataFrame([], "outer_fold int, encoder string, protocol string, layout string, status string, auc double"))
    q_models.contrast_run(spark, "")
    assert Counter((c.outer_fold, c.protocol, c.layout) for c in asked) == Counter((f, p, lay) for f in range(5) for p in ("global", "foldsafe") for lay in ("placement", "none"))
    assert all(c.options == {} for c in asked)


@pytest.mark.parametrize("layout, d, size", [("placement", 4, 8), ("placement", 5, 7), ("bits", 3, 40), ("bars", 3, 4)])
def test_pixels_held_once_have_the_products_of_resized_images(layout, d, size):
    z = np.random.default_rng(d).random((6, d))
    perm = np.tile(np.random.default_rng(1).permutation(d), (6, 1))
    whole = ly._area_average(ly._render(layout, z, perm), size).reshape(6, -1)
    times = ly.times_shown(layout, d, size)
    once = ly._render(layout, z, perm).reshape(6, -1) * np.sqrt(times)
    assert times.sum() == size * size and once @ once.T == pytest.approx(whole @ whole.T)
    assert ly.times_shown(layout, d, 1) is None
    held = ly.render_once(layout, times, 50).func(pd.Series(list(z)), pd.Series(list(perm)))
    assert np.stack(held)[:, : once.shape[1]] == pytest.approx(once, abs=1e-5) and not np.stack(held)[:, once.shape[1] :].any()
