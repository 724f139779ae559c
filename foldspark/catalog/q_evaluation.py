"""Metrics, selection, reports and run statuses."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from foldspark.catalog import blocks as B
from foldspark.catalog.q_splits import orders_uses
from foldspark.catalog.registry import query
from foldspark.operators import metrics as mt
from foldspark.operators import selection as sel
from foldspark.operators import splits
from foldspark.plans import cells as cl
from foldspark.plans import status as st
from foldspark.plans.runs import RunTable
from foldspark.session import materialize, scratch_dir
from foldspark.sources import rowsets as rs

COLS = rs.ORDERS_COLUMNS
# the grid: sign-weighted means of fold-safe codes, over all columns, the first two, the last one, and one that is not there
CONFIGS = [
    # config, branch, encoder, protocol, first and last position
    ("target_all", "supervised", "target", "foldsafe", 0, 4),
    ("target_two", "supervised", "target", "foldsafe", 0, 2),
    ("target_one", "supervised", "target", "foldsafe", 3, 4),
    ("count_all", "label_free", "count", "foldsafe", 0, 4),
    ("count_two", "label_free", "count", "foldsafe", 0, 2),
    ("count_fifth", "label_free", "count", "foldsafe", 4, 5),
    ("global_all", "contrast", "target", "global", 0, 4),
    ("global_two", "contrast", "target", "global", 0, 2),
]
RUN = ["run_id"]
FITTED = f"""WITH {B.ORDERS}, {B.splits('orders_cat')}, {B.sided(COLS, 'orders_cat')},
    cfg(config_id, branch, enc, first, last) AS (VALUES {', '.join(
        f"('{c}', '{b}', '{'global' if p == 'global' else e}', {i}, {j})" for c, b, e, p, i, j in CONFIGS)}),
    part_lv AS MATERIALIZED (
      SELECT sid, part, ci, level, count(*) AS n, sum(y) AS pos FROM slv WHERE part >= 0 GROUP BY sid, part, ci, level),
    part_fit AS MATERIALIZED (SELECT sid, part, sum(n) AS n, sum(pos) AS pos FROM part_lv WHERE ci = 0 GROUP BY sid, part),
    left_out AS (
      SELECT l.row_id, l.y, l.sid, l.role, l.ci, (f.fit_pos - coalesce(pf.pos, 0)) / (f.fit_n - coalesce(pf.n, 0)) AS prior,
        coalesce(s.n, 0) - coalesce(p.n, 0) AS n, coalesce(s.pos, 0) - coalesce(p.pos, 0) AS pos, coalesce(s.n, 0)::DOUBLE / f.fit_n AS share
      FROM slv l JOIN side_fit f USING (sid) LEFT JOIN part_fit pf ON pf.sid = l.sid AND pf.part = l.part
      LEFT JOIN side_lv s ON s.sid = l.sid AND s.ci = l.ci AND s.level = l.level
      LEFT JOIN part_lv p ON p.sid = l.sid AND p.part = l.part AND p.ci = l.ci AND p.level = l.level),
    all_lv AS MATERIALIZED (SELECT ci, level, count(*) AS n, sum(y) AS pos FROM slv WHERE sid = 1 GROUP BY ci, level),
    all_fit AS (SELECT sum(n) AS n, sum(pos) AS pos FROM all_lv WHERE ci = 0),
    codes AS MATERIALIZED (
      SELECT 'target' AS enc, row_id, y, sid, role, ci,
        CASE WHEN n > 0 THEN (pos + 20.0::DOUBLE * prior) / (n + 20.0::DOUBLE) ELSE prior END AS raw FROM left_out
      UNION ALL SELECT 'count', row_id, y, sid, role, ci, share FROM left_out
      UNION ALL SELECT 'global', l.row_id, l.y, l.sid, l.role, l.ci, (a.pos + 20.0::DOUBLE * (f.pos / f.n)) / (a.n + 20.0::DOUBLE)
        FROM slv l JOIN all_lv a USING (ci, level), all_fit f),
    bounds AS MATERIALIZED (
      SELECT enc, sid, ci, min(raw) AS lo, max(raw) AS hi FROM codes WHERE enc <> 'global' AND role IN ('inner_train', 'train') GROUP BY ALL
      UNION ALL SELECT 'global', s, ci, min(raw), max(raw) FROM codes, range(0, 10) t(s) WHERE enc = 'global' AND sid = 1 GROUP BY ALL),
    z AS MATERIALIZED (
      SELECT enc, row_id, y, sid, role, ci, CASE WHEN hi > lo THEN greatest(0, least(1, (raw - lo) / (hi - lo))) ELSE 0 END AS z
      FROM codes JOIN bounds USING (enc, sid, ci)),
    signs AS MATERIALIZED (
      SELECT enc, sid, ci, CASE WHEN avg(z) FILTER (y = 1) < avg(z) FILTER (y = 0) THEN -1 ELSE 1 END AS w
      FROM z WHERE role IN ('inner_train', 'train') GROUP BY enc, sid, ci),
    held AS MATERIALIZED (
      SELECT config_id, sid, row_id, y AS y_true, round(sum(w * (z - 0.5::DOUBLE) ORDER BY ci) / count(*) + 0.5::DOUBLE, 9) AS y_score
      FROM z JOIN signs USING (enc, sid, ci) JOIN cfg ON cfg.enc = z.enc AND ci >= first AND ci < last
      WHERE role IN ('inner_val', 'test') GROUP BY config_id, sid, row_id, y),
    preds AS (SELECT config_id AS run_id, segment, y_true, y_score FROM held JOIN orders_cat USING (row_id)
              WHERE sid % 2 = 1 AND config_id NOT LIKE 'global%')"""
PREDS = FITTED


def grid_cells():
    return [
        cl.Cell(f, e, "signed_mean", protocol=p, options={"first": i, "last": j}, config=c)
        for c, _, e, p, i, j in CONFIGS
        for f in range(5)
    ]


def run_table(spark, sf):
    """The run table of the grid over these tables; the first query of a session fills it, later ones find it finished."""
    name = hashlib.md5(f"{spark.sparkContext.applicationId}:{sf}".encode()).hexdigest()
    table = RunTable(spark, f"{scratch_dir(spark)}/foldspark/grid-{name}", "segment STRING")
    if len(table.finished()) < len(CONFIGS) * 5:
        rows, uses = orders_uses(spark, sf)
        cl.run_cells(materialize(splits.assign(rows, uses), "assigned"), COLS, grid_cells(), table=table)
    return table


def scored_rows(spark, sf):
    """Held-out predictions of all fitted cells: config, outer_fold, phase, row_id, segment, y_true, y_score."""
    table = run_table(spark, sf)
    named = table.runs().select("run_id", "config", "outer_fold", "protocol")
    return table.predictions().join(F.broadcast(named), "run_id")  # one row a cell; the segment was kept with the prediction


def predictions(spark, sf):
    """Each row scored once by every configuration, in the fold where it is tested."""
    rows = scored_rows(spark, sf).where("phase = 'outer' AND protocol = 'foldsafe'")
    return rows.select(F.col("config").alias("run_id"), "segment", "y_true", "y_score")


def hist_sql(source: str, keys: str) -> str:
    return (
        f"hist AS (SELECT {keys}, y_score AS s, count(*) AS n, sum(y_true) AS pos "
        f"FROM {source} GROUP BY {keys}, y_score)"
    )


def ranking_sql(keys: str) -> str:
    """CTE rank_metrics over hist: AUC from ranks below, AP from the top."""
    return f"""curve AS (SELECT *, coalesce(sum(n - pos) OVER lo, 0) AS neg_below,
        sum(n) OVER hi AS called, sum(pos) OVER hi AS tp,
        sum(pos) OVER (PARTITION BY {keys}) AS pp, sum(n) OVER (PARTITION BY {keys}) AS nn
      FROM hist WINDOW lo AS (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        hi AS (PARTITION BY {keys} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
    rank_metrics AS (SELECT {keys}, any_value(nn)::BIGINT AS n_rows, any_value(pp)::BIGINT AS n_pos,
        CASE WHEN any_value(pp) > 0 AND any_value(pp) < any_value(nn) THEN
          sum(pos * (neg_below + (n - pos) / 2.0::DOUBLE)) / any_value(pp * (nn - pp)) END AS auc,
        CASE WHEN any_value(pp) > 0 AND any_value(pp) < any_value(nn) THEN
          sum(pos * tp / called::DOUBLE) / any_value(pp) END AS pr_auc
      FROM curve GROUP BY {keys})"""


def point_sql(keys: str, threshold: str = "0.5::DOUBLE") -> str:
    return f"""clipped AS (SELECT *, greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, s)) AS p,
        {threshold} AS thr FROM hist),
    conf AS (SELECT {keys}, sum(n) AS nn, sum(pos) AS pp,
        sum(-(pos * ln(p) + (n - pos) * ln(1 - p))) AS ll,
        sum(pos * (1 - s) * (1 - s) + (n - pos) * s * s) AS sq,
        sum(CASE WHEN s >= thr THEN pos ELSE 0 END) AS tp, sum(CASE WHEN s >= thr THEN n - pos ELSE 0 END) AS fp
      FROM clipped GROUP BY {keys}),
    points AS (SELECT {keys}, nn::BIGINT AS n_rows, pp::BIGINT AS n_pos,
        CASE WHEN pp > 0 AND pp < nn THEN ll / nn END AS logloss,
        CASE WHEN pp > 0 AND pp < nn THEN sq / nn END AS brier,
        CASE WHEN pp > 0 AND pp < nn THEN (tp / pp + (nn - pp - fp) / (nn - pp)) / 2 END AS balanced_accuracy,
        CASE WHEN pp > 0 AND pp < nn THEN coalesce(2 * tp / nullif(tp + fp + pp, 0), 0) END AS f1
      FROM conf)"""


def newton_sql(keys: str, rounds: int = 10) -> str:
    """Unrolled Newton iterations over hist."""
    out = [
        "lg AS (SELECT *, ln(greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, s)) / "
        "(1 - greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, s)))) AS x FROM hist)",
        f"it0 AS (SELECT {keys}, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM lg GROUP BY {keys})",
    ]
    for i in range(rounds):
        out.append(
            f"""it{i + 1} AS (SELECT {keys}, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a,
                 b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM (
              SELECT {keys}, any_value(a) AS a, any_value(b) AS b, sum(pos - n * p) AS g0, sum((pos - n * p) * x) AS g1,
                 sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * x) AS h01, sum(n * p * (1 - p) * x * x) AS h11
              FROM (SELECT lg.*, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM lg JOIN it{i} USING ({keys}))
              GROUP BY {keys}))"""
        )
    out.append(
        f"calib AS (SELECT {keys}, round(b, 6) AS calibration_slope, round(a, 6) AS calibration_intercept FROM it{rounds})"
    )
    return ", ".join(out)


def rounded(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def run_hist(spark, sf):
    return mt.histogram(predictions(spark, sf), RUN)


HIST = f"{PREDS}, {hist_sql('preds', 'run_id')}"


@query("metric_auc", f"{HIST}, {ranking_sql('run_id')} SELECT run_id, round(auc, 9) AS auc FROM rank_metrics")
def metric_auc(spark, sf):
    return rounded(mt.ranking(run_hist(spark, sf), RUN).select("run_id", "auc"), "auc")


@query("metric_pr_auc", f"{HIST}, {ranking_sql('run_id')} SELECT run_id, round(pr_auc, 9) AS pr_auc FROM rank_metrics")
def metric_pr_auc(spark, sf):
    return rounded(mt.ranking(run_hist(spark, sf), RUN).select("run_id", "pr_auc"), "pr_auc")


def point_query(column):
    def run(spark, sf):
        return rounded(mt.pointwise(run_hist(spark, sf), RUN).select("run_id", column), column)

    return run


for _name, _column in {
    "metric_logloss": "logloss",
    "metric_brier": "brier",
    "metric_bal_acc": "balanced_accuracy",
    "metric_f1": "f1",
}.items():
    query(_name, f"{HIST}, {point_sql('run_id')} SELECT run_id, round({_column}, 9) AS {_column} FROM points")(
        point_query(_column)
    )


@query(
    "metric_calibration",
    f"{HIST}, {newton_sql('run_id')} SELECT run_id, calibration_slope, calibration_intercept FROM calib",
)
def metric_calibration(spark, sf):
    fit = mt.calibration(run_hist(spark, sf), RUN)
    return rounded(fit, "calibration_slope", "calibration_intercept", digits=6)


@query(
    "metric_status",
    f"""WITH {B.DOCS} SELECT source, lang, count(*)::BIGINT AS n_rows, sum(y)::BIGINT AS n_pos,
    CASE WHEN min(y) = max(y) THEN 'METRIC_UNDEFINED' ELSE 'SUCCESS' END AS status
    FROM docs_cat GROUP BY source, lang""",
)
def metric_status(spark, sf):
    """Small cells of labelled documents: many have one class."""
    docs = rs.docs_cat(spark, sf).select("source", "lang", F.col("y").alias("y_true"), F.lit(0.5).alias("y_score"))
    return mt.status(mt.histogram(docs, ["source", "lang"]), ["source", "lang"])


def threshold_sql(keys: str) -> str:
    return f"""steps AS (SELECT *, row_number() OVER w - 1 AS i, lead(s) OVER w AS nxt,
        sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS n_le, sum(pos) OVER (w ROWS UNBOUNDED PRECEDING) AS pos_le,
        sum(n) OVER (PARTITION BY {keys}) AS nn, sum(pos) OVER (PARTITION BY {keys}) AS pp,
        count(*) OVER (PARTITION BY {keys}) AS ns
      FROM hist WINDOW w AS (PARTITION BY {keys} ORDER BY s)),
    kept AS (SELECT * FROM steps WHERE nxt IS NOT NULL AND pp > 0 AND pp < nn AND (ns - 1 <= 200 OR i = ns - 2
        OR list_contains(list_transform(range(0, 199), lambda j: floor(j * ((ns - 2) / 199.0::DOUBLE))::BIGINT), i))),
    best AS (SELECT {keys}, arg_max((s + nxt) / 2, (round(2 * (pp - pos_le) / (nn - n_le + pp), 12), -i)) AS t,
        max(round(2 * (pp - pos_le) / (nn - n_le + pp), 12)) AS best_f1 FROM kept GROUP BY {keys}),
    thr AS (SELECT DISTINCT {keys}, CASE WHEN ns > 1 AND pp > 0 AND pp < nn THEN t ELSE 0.5::DOUBLE END AS threshold,
        best_f1 FROM steps LEFT JOIN best USING ({keys}))"""


@query(
    "select_threshold",
    f"""{HIST}, {threshold_sql('run_id')}
    SELECT run_id, round(threshold, 9) AS threshold, round(best_f1, 9) AS best_f1 FROM thr""",
)
def select_threshold(spark, sf):
    hist = materialize(run_hist(spark, sf), "hist")
    return rounded(mt.select_threshold(hist, RUN), "threshold", "best_f1")


PANEL = ["auc", "pr_auc", "logloss", "brier", "balanced_accuracy", "f1"]
PANEL_SQL = ", ".join(f"round({c}, 9) AS {c}" for c in PANEL)


@query(
    "metric_panel",
    f"""{HIST}, {ranking_sql('run_id')}, {threshold_sql('run_id')},
    {point_sql('run_id', '(SELECT threshold FROM thr t WHERE t.run_id = hist.run_id)')}, {newton_sql('run_id')}
    SELECT r.run_id, r.n_rows, r.n_pos, {PANEL_SQL}, calibration_slope, calibration_intercept,
           CASE WHEN auc IS NULL THEN 'METRIC_UNDEFINED' ELSE 'SUCCESS' END AS status
    FROM rank_metrics r JOIN points p ON p.run_id = r.run_id JOIN calib c ON c.run_id = r.run_id""",
)
def metric_panel(spark, sf):
    hist = materialize(run_hist(spark, sf), "hist")
    thresholds = mt.select_threshold(hist, RUN).select("run_id", "threshold")
    out = rounded(mt.panel(hist, RUN, thresholds), *PANEL)
    return rounded(out, "calibration_slope", "calibration_intercept", digits=6)


# ---- cells: every (segment, configuration, fold) is a candidate; inner_val rows select, test rows report ----

CELL = ["segment", "config", "outer_fold", "phase"]
POLICY = ["segment", "outer_fold", "branch"]
CELLS = f"""{FITTED},
    scored AS (SELECT segment, config_id, (sid // 2)::INT AS outer_fold, CASE sid % 2 WHEN 1 THEN 'outer' ELSE 'inner' END AS phase, y_true, y_score
               FROM held JOIN orders_cat USING (row_id)),
    {hist_sql('scored', 'segment, config_id, outer_fold, phase')}, {ranking_sql('segment, config_id, outer_fold, phase')},
    everyone AS (SELECT segment, config_id, branch, (last - first)::DOUBLE AS complexity, f::INT AS outer_fold
                 FROM cfg, range(0, 5) t(f), (SELECT DISTINCT segment FROM orders_cat)),
    cells AS (SELECT segment, outer_fold, branch, config_id, complexity,
        max(round(auc, 2)) FILTER (phase = 'inner') AS inner_metric, max(round(auc, 9)) FILTER (phase = 'outer') AS outer_auc,
        max(round(pr_auc, 9)) FILTER (phase = 'outer') AS outer_pr_auc
      FROM everyone LEFT JOIN rank_metrics USING (segment, config_id, outer_fold) GROUP BY ALL),
    every_cand AS (SELECT *, CASE WHEN config_id = 'count_fifth' THEN 'TRAINING_FAILURE' WHEN inner_metric IS NULL THEN 'METRIC_UNDEFINED'
        ELSE 'SUCCESS' END AS status,
        CASE WHEN config_id = 'count_fifth' THEN 'TRAINING_FAILURE' WHEN outer_auc IS NULL THEN 'METRIC_UNDEFINED' ELSE 'SUCCESS' END AS refit_status
      FROM cells),
    cands AS (SELECT * FROM every_cand WHERE branch <> 'contrast'),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY segment, outer_fold, branch
        ORDER BY inner_metric DESC, complexity, config_id) AS rank
      FROM cands WHERE status = 'SUCCESS' AND inner_metric IS NOT NULL),
    tb AS (SELECT segment, outer_fold, branch, count(*)::BIGINT AS n_tied, CASE WHEN count(*) = 1 THEN 'none'
        WHEN count(DISTINCT complexity) > 1 THEN 'complexity' ELSE 'config_id' END AS tie_break
      FROM (SELECT *, max(inner_metric) OVER (PARTITION BY segment, outer_fold, branch) AS best FROM ranked)
      WHERE inner_metric = best GROUP BY ALL),
    chosen AS (SELECT segment, outer_fold, branch, count(*)::BIGINT AS candidate_count FROM cands GROUP BY ALL),
    pick AS (SELECT segment, outer_fold, branch, min(rank) FILTER (refit_status IN ('SUCCESS', 'METRIC_UNDEFINED')) AS r,
        count(*) AS nr FROM ranked GROUP BY ALL),
    fallback AS (SELECT c.segment, c.outer_fold, c.branch, candidate_count, k.config_id,
        CASE WHEN k.config_id IS NOT NULL THEN tie_break END AS tie_break, k.inner_metric,
        coalesce(p.r - 1, nr, 0)::BIGINT AS n_fallbacks, coalesce(k.refit_status, 'TRAINING_FAILURE') AS status
      FROM chosen c LEFT JOIN pick p ON p.segment = c.segment AND p.outer_fold = c.outer_fold AND p.branch = c.branch
      LEFT JOIN ranked k ON k.segment = c.segment AND k.outer_fold = c.outer_fold AND k.branch = c.branch AND k.rank = p.r
      LEFT JOIN tb ON tb.segment = c.segment AND tb.outer_fold = c.outer_fold AND tb.branch = c.branch)"""


def every_cell(spark, sf):
    """Inner and outer AUC of every (segment, configuration, fold) of the run table, with the status of its run."""
    ranked = mt.ranking(mt.histogram(scored_rows(spark, sf), CELL), CELL)
    inner = F.col("phase") == "inner"
    wide = ranked.groupBy("segment", "config", "outer_fold").agg(
        F.round(F.max(F.when(inner, F.col("auc"))), 2).alias("inner_metric"),
        F.round(F.max(F.when(~inner, F.col("auc"))), 9).alias("outer_auc"),
        F.round(F.max(F.when(~inner, F.col("pr_auc"))), 9).alias("outer_pr_auc"),
    )
    branch = F.element_at(F.create_map(*[F.lit(x) for c in CONFIGS for x in (c[0], c[1])]), F.col("config"))
    size = F.element_at(F.create_map(*[F.lit(x) for c in CONFIGS for x in (c[0], float(c[5] - c[4]))]), F.col("config"))
    segments = rs.orders_cat(spark, sf).agg(F.collect_set("segment")).scalar()  # the levels of one column
    runs = run_table(spark, sf).runs().withColumns({"branch": branch, "complexity": size, "segment": F.explode(segments)})
    failed = F.col("status") != "SUCCESS"
    inner_failed = F.coalesce(F.col("inner_status") != "SUCCESS", F.lit(True))

    def typed(failure, metric):
        return F.when(failure, F.col("status")).when(F.col(metric).isNull(), "METRIC_UNDEFINED").otherwise("SUCCESS")

    out = runs.join(wide, ["segment", "config", "outer_fold"], "left").select(
        *POLICY, F.col("config").alias("config_id"), "protocol", "seed", "complexity",
        F.coalesce("inner_elapsed_s", F.lit(0.0)).alias("fit_time_s"), "inner_metric", "outer_auc", "outer_pr_auc",
        typed(inner_failed, "inner_metric").alias("status"), typed(failed, "outer_auc").alias("refit_status"),
    )
    return materialize(out, "cells")


def cells(spark, sf):
    return every_cell(spark, sf).where("branch <> 'contrast'")


def candidates(cell_table):
    return cell_table.select(*POLICY, "config_id", "inner_metric", "complexity", "fit_time_s", "status")


def refits(cell_table):
    return cell_table.select(*POLICY, "config_id", "refit_status")


@query(
    "grid_run",
    f"""{CELLS}, scored_n AS (SELECT config_id, outer_fold, phase, count(*) AS n FROM scored GROUP BY ALL)
    SELECT config_id, f::INT AS outer_fold, CASE WHEN config_id = 'count_fifth' THEN 'TRAINING_FAILURE' ELSE 'SUCCESS' END AS status,
      CASE WHEN config_id = 'count_fifth' THEN 'model_fit_inner' END AS stage_of_failure,
      CASE WHEN config_id = 'count_fifth' THEN 'ValueError' END AS exception_class,
      coalesce((SELECT n FROM scored_n s WHERE s.config_id = cfg.config_id AND s.outer_fold = f AND phase = 'inner'), 0)::BIGINT AS n_inner,
      coalesce((SELECT n FROM scored_n s WHERE s.config_id = cfg.config_id AND s.outer_fold = f AND phase = 'outer'), 0)::BIGINT AS n_outer
    FROM cfg, range(0, 5) t(f)""",
)
def grid_run(spark, sf):
    """Every cell of the grid, fitted on five folds, with its typed outcome and the rows that it scored."""
    table = run_table(spark, sf)
    scored = table.predictions().groupBy("run_id").agg(
        F.count_if(F.col("phase") == "inner").alias("n_inner"), F.count_if(F.col("phase") == "outer").alias("n_outer")
    )
    shown = table.runs().join(scored, "run_id", "left").withColumn("config_id", F.col("config"))
    none = F.lit(0).cast("bigint")
    return shown.select(
        "config_id", "outer_fold", "status", "stage_of_failure", "exception_class",
        F.coalesce("n_inner", none).alias("n_inner"), F.coalesce("n_outer", none).alias("n_outer"),
    )


@query(
    "rank_candidates",
    f"{CELLS} SELECT segment, outer_fold, branch, config_id, inner_metric, rank::BIGINT AS rank FROM ranked",
)
def rank_candidates(spark, sf):
    ranked = sel.rank_candidates(candidates(cells(spark, sf)), POLICY)
    return ranked.select(*POLICY, "config_id", "inner_metric", F.col("rank").cast("bigint").alias("rank"))


@query("tie_break", f"{CELLS} SELECT * FROM tb")
def tie_break(spark, sf):
    return sel.tie_break(candidates(cells(spark, sf)), POLICY)


@query("select_fallback", f"{CELLS} SELECT * FROM fallback")
def select_fallback(spark, sf):
    c = cells(spark, sf)
    return sel.select_with_fallback(candidates(c), refits(c), POLICY)


@query(
    "policy_report",
    f"""{CELLS} SELECT f.*, c.outer_auc, c.outer_pr_auc FROM fallback f LEFT JOIN cands c
    ON c.segment = f.segment AND c.outer_fold = f.outer_fold AND c.branch = f.branch AND c.config_id = f.config_id""",
)
def policy_report(spark, sf):
    c = cells(spark, sf)
    outer = c.select(*POLICY, "config_id", "outer_auc", "outer_pr_auc")
    return sel.policy_report(candidates(c), refits(c), outer, POLICY)


@query(
    "selection_churn",
    f"""{CELLS}, per AS (SELECT segment, branch, config_id, count(*) AS c FROM fallback WHERE config_id IS NOT NULL GROUP BY ALL)
    SELECT segment, branch, sum(c)::BIGINT AS n_folds, count(*)::BIGINT AS n_configs,
           round(max(c) / sum(c), 9) AS mode_share FROM per GROUP BY ALL""",
)
def selection_churn(spark, sf):
    c = cells(spark, sf)
    return sel.selection_churn(sel.select_with_fallback(candidates(c), refits(c), POLICY), ["segment", "branch"])


ARMS = ("all", "two")
CONTRAST = f"""{CELLS},
    arms AS (SELECT segment, outer_fold, 5 AS seed, CASE WHEN config_id LIKE 'global%' THEN 'global' ELSE 'safe' END || '_' ||
        string_split(config_id, '_')[2] AS cell, refit_status AS status, CASE WHEN refit_status = 'SUCCESS' THEN outer_auc END AS auc
      FROM every_cand WHERE config_id IN ('target_all', 'target_two', 'global_all', 'global_two')),
    wide AS (SELECT segment, outer_fold, seed::INT AS seed,
        max(auc) FILTER (cell = 'global_all') AS ga, max(auc) FILTER (cell = 'global_two') AS gt,
        max(auc) FILTER (cell = 'safe_all') AS sa, max(auc) FILTER (cell = 'safe_two') AS st,
        bool_and(status = 'SUCCESS') AND count(*) = 4 AS ok,
        coalesce(string_agg(cell || '=' || status, ';' ORDER BY cell) FILTER (status <> 'SUCCESS'), '') AS notes
      FROM arms GROUP BY ALL),
    contrast AS (SELECT segment, outer_fold, seed, ga AS global_all_auc, gt AS global_two_auc, sa AS safe_all_auc,
        st AS safe_two_auc, round(CASE WHEN ok THEN ga - sa END, 9) AS b_all,
        round(CASE WHEN ok THEN gt - st END, 9) AS b_two, round(CASE WHEN ok THEN (ga - gt) - (sa - st) END, 9) AS b_delta,
        CASE WHEN ok THEN 'SUCCESS' ELSE 'PARTIAL_FAILURE' END AS status, notes FROM wide)"""
PAIR = ["segment", "outer_fold", "seed"]


def arms(spark, sf):
    """Target codes of all columns and of two, fitted fold-safe and on all rows."""
    named = every_cell(spark, sf).where(F.col("config_id").isin("target_all", "target_two", "global_all", "global_two"))
    return named.select(
        *PAIR,
        F.when(F.col("protocol") == "global", "global").otherwise("safe").alias("protocol"),
        F.element_at(F.split("config_id", "_"), 2).alias("arm"),
        F.col("refit_status").alias("status"),
        F.col("outer_auc").alias("auc"),
    )


def contrasts(spark, sf):
    return rounded(sel.paired_contrast(arms(spark, sf), PAIR, ARMS), "b_all", "b_two", "b_delta")


@query("paired_contrast", f"{CONTRAST} SELECT * FROM contrast")
def paired_contrast(spark, sf):
    return contrasts(spark, sf)


@query(
    "contrast_summary",
    f"""{CONTRAST} SELECT count(*)::BIGINT AS n, count(b_delta)::BIGINT AS n_ok,
    round(quantile_cont(b_delta, 0.5), 9) AS median_delta, min(b_delta) AS min_delta, max(b_delta) AS max_delta FROM contrast""",
)
def contrast_summary(spark, sf):
    return rounded(sel.contrast_summary(contrasts(spark, sf)), "median_delta")


@query(
    "paired_exclusions",
    f"""{CONTRAST}, per AS (SELECT segment, outer_fold, seed,
        string_agg(DISTINCT cell || ':' || status, ';' ORDER BY cell || ':' || status) FILTER (status <> 'SUCCESS') AS reason
      FROM arms GROUP BY ALL)
    SELECT segment, reason, count(*)::BIGINT AS n_keys FROM per GROUP BY ALL""",
)
def paired_exclusions(spark, sf):
    named = arms(spark, sf).withColumn("arm", F.concat_ws("_", "protocol", "arm"))
    return sel.paired_exclusions(named, PAIR, ["segment"])


@query(
    "status_aggregate",
    f"""{CELLS} SELECT branch, count(*)::BIGINT AS n_runs, count(*) FILTER (refit_status = 'SUCCESS')::BIGINT AS n_success,
    round(avg(outer_auc) FILTER (refit_status = 'SUCCESS'), 9) AS mean_auc FROM cands GROUP BY branch""",
)
def status_aggregate(spark, sf):
    runs = cells(spark, sf).select("branch", F.col("refit_status").alias("status"), F.col("outer_auc").alias("auc"))
    return sel.status_aggregate(runs, ["branch"])


@query(
    "status_counts",
    f"{CELLS} SELECT branch, refit_status AS status, count(*)::BIGINT AS n_runs FROM cands GROUP BY ALL",
)
def status_counts(spark, sf):
    return sel.status_counts(cells(spark, sf).select("branch", F.col("refit_status").alias("status")), ["branch"])


@query(
    "status_gate",
    f"""{CELLS} SELECT segment, outer_fold, config_id, refit_status AS status,
    CASE WHEN refit_status = 'SUCCESS' THEN outer_auc END AS outer_auc,
    CASE WHEN refit_status = 'SUCCESS' THEN outer_pr_auc END AS outer_pr_auc,
    refit_status NOT IN ('SUCCESS', 'SKIPPED_INELIGIBLE') AS is_failure FROM cands""",
)
def status_gate(spark, sf):
    runs = cells(spark, sf).select(
        "segment", "outer_fold", "config_id", F.col("refit_status").alias("status"), "outer_auc", "outer_pr_auc"
    )
    return st.gate(runs, ["outer_auc", "outer_pr_auc"])


@query(
    "nonfinite_guard",
    f"""{PREDS} SELECT run_id, segment, count(*)::BIGINT AS n_rows, count(*) FILTER (y_score <= 0 OR y_score >= 1)::BIGINT AS n_nonfinite,
    CASE WHEN count(*) FILTER (y_score <= 0 OR y_score >= 1) > 0 THEN 'NUMERICAL_FAILURE' ELSE 'SUCCESS' END AS status
    FROM preds GROUP BY run_id, segment""",
)
def nonfinite_guard(spark, sf):
    """Log odds of the fitted scores; those of 0 and 1 are not finite."""
    odds = F.array(F.col("y_score"), F.ln(F.try_divide(F.col("y_score"), 1 - F.col("y_score"))))
    return st.nonfinite_guard(predictions(spark, sf).withColumn("codes", odds), ["run_id", "segment"], "codes")


@query(
    "sanitize_message",
    r"""SELECT doc_id, left(regexp_replace('cannot read /mnt/' || source || '/' || doc_id || '.txt or C:\data\' || source
        || ' or s3a://' || source || '/x: ' || text, '(^|[\s''"(=,])(?:[A-Za-z][\w+.-]*:)?[/\\]+[^\s''"]+', '\1<path>', 'g'), 300)
        AS message FROM documents""",
)
def sanitize_message(spark, sf):
    d = rs.table(spark, sf, "documents")
    ident = F.col("doc_id").cast("string")
    where = ["cannot read /mnt/", "/", ".txt or C:\\data\\", " or s3a://", "/x: "]
    message = F.concat(*[x for p, v in zip(where, (F.col("source"), ident, F.col("source"), F.col("source"), F.col("text"))) for x in (F.lit(p), v)])
    return d.select("doc_id", st.sanitize(message).alias("message"))
