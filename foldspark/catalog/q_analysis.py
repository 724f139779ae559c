"""Information loss, selection optimism and homogeneity analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspark.catalog import blocks as B
from foldspark.catalog.q_encoding import TARGET, bucket_sql
from foldspark.catalog.q_evaluation import rounded
from foldspark.catalog.registry import query
from foldspark.functions.hashing import unit_interval
from foldspark.operators import cube as cb
from foldspark.operators import encoders as enc
from foldspark.operators import foldsafe as fs
from foldspark.operators import homals as hm
from foldspark.operators import optimism as op
from foldspark.operators import risk as rk
from foldspark.session import materialize
from foldspark.sources import rowsets as rs
from foldspark.sources.categories import to_long

COLS = rs.ORDERS_COLUMNS
CELLS = f"""WITH {B.ORDERS}, {B.long('orders_cat', COLS, 'row_id, y')},
    x AS (SELECT {', '.join(COLS)}, count(*) AS n, sum(y) AS pos FROM orders_cat GROUP BY ALL),
    s AS (SELECT col, level, count(*) AS n, sum(y) AS pos FROM lng GROUP BY ALL),
    f AS (SELECT count(*) AS fit_n, sum(y) AS fit_pos FROM orders_cat)"""


def entropy_sql(eta: str) -> str:
    return f"CASE WHEN {eta} > 0 AND {eta} < 1 THEN -({eta} * ln({eta}) + (1 - {eta}) * ln(1 - {eta})) ELSE 0 END"


SUBSETS = {"all": COLS, "priority": ["priority"], "segment_oyear": ["segment", "oyear"]}


def raw_risk_sql() -> str:
    per = " UNION ALL ".join(
        f"SELECT '{name}' AS subset, sum(n) AS n, sum(pos) AS pos FROM x GROUP BY {', '.join(cs)}"
        for name, cs in SUBSETS.items()
    )
    return f"""{CELLS}, per AS ({per}), e AS (SELECT *, pos / n AS eta FROM per)
    SELECT subset, round(sum(n * {entropy_sql('eta')}) / sum(n), 9) AS logloss_risk,
           round(sum(n * eta * (1 - eta)) / sum(n), 9) AS brier_risk, count(*)::BIGINT AS n_cells FROM e GROUP BY subset"""


@query("risk_raw", raw_risk_sql())
def risk_raw(spark, sf):
    cells = materialize(rk.joint(rs.orders_cat(spark, sf), COLS), "joint")
    parts = [
        rk.risk(cells.withColumn("subset", F.lit(name)), columns, ["subset"]) for name, columns in SUBSETS.items()
    ]
    return rounded(fs.union_all(parts), "logloss_risk", "brier_risk")


def coded_cells(spark, sf):
    """Every distinct tuple with its code under three encodings."""
    rows = rs.orders_cat(spark, sf)
    cells = materialize(rk.joint(rows, COLS), "joint")
    states = cb.whole_states(rows, COLS)
    frames = []
    keyed = cells.withColumn("row_id", F.xxhash64(*COLS))  # only spreads hot levels
    for name in ("target", "count"):
        codes = enc.ENCODERS[name].codes(states, ())
        frames.append(fs.apply_plain(keyed, codes, COLS, F.lit(0.0)).withColumn("encoder", F.lit(name)))
    buckets = F.lit(16)
    hashed = enc.with_bucket_counts(keyed, enc.buckets_of(enc.row_hashes(COLS, False), buckets))
    dense = enc.dense_counts(F.col("slots"), F.col("counts"), buckets)
    frames.append(hashed.withColumns({"codes": dense, "encoder": F.lit("hash_shared")}))
    return materialize(fs.union_all([f.select("encoder", *COLS, "n", "pos", "codes") for f in frames]), "coded")


def codes_sql(code: str) -> str:
    """Rounded code tuple of each cell."""
    joins = "".join(
        f" JOIN (SELECT level, {code} AS c FROM s, f WHERE col = '{c}') t{i} ON t{i}.level = x.{c}"
        for i, c in enumerate(COLS)
    )
    z = ", ".join(f"round(t{i}.c, 12)" for i in range(len(COLS)))
    return f"SELECT x.*, ({z})::VARCHAR AS z FROM x{joins}"


HASH_Z = f"""SELECT x.*, list_sort([{', '.join(bucket_sql(c, '16') for c in COLS)}])::VARCHAR AS z FROM x"""
CODED = f"""{CELLS},
    coded AS (SELECT 'target' AS encoder, * FROM ({codes_sql(TARGET)})
      UNION ALL SELECT 'count', * FROM ({codes_sql('s.n::DOUBLE / f.fit_n')})
      UNION ALL SELECT 'hash_shared', * FROM ({HASH_Z})),
    fib AS (SELECT encoder, z, sum(n) AS fn, sum(pos) AS fpos FROM coded GROUP BY ALL)"""


@query(
    "risk_encoded",
    f"""{CODED}, e AS (SELECT *, fpos / fn AS eta FROM fib)
    SELECT encoder, round(sum(fn * {entropy_sql('eta')}) / sum(fn), 9) AS logloss_risk,
           round(sum(fn * eta * (1 - eta)) / sum(fn), 9) AS brier_risk, count(*)::BIGINT AS n_cells FROM e GROUP BY encoder""",
)
def risk_encoded(spark, sf):
    cells = coded_cells(spark, sf).withColumn("z", F.transform("codes", lambda v: F.round(v, rk.CODE_DIGITS)))
    return rounded(rk.risk(cells, ["z"], ["encoder"]), "logloss_risk", "brier_risk")


@query(
    "encoding_gap",
    f"""{CODED}, j AS (SELECT c.*, fpos / fn AS ez, pos / n AS ex FROM coded c JOIN fib USING (encoder, z))
    SELECT encoder, round(sum(n * ((CASE WHEN ex > 0 THEN ex * ln(ex / ez) ELSE 0 END)
             + (CASE WHEN ex < 1 THEN (1 - ex) * ln((1 - ex) / (1 - ez)) ELSE 0 END))) / sum(n), 9) AS logloss_gap,
           round(sum(n * (ex - ez) * (ex - ez)) / sum(n), 9) AS brier_gap,
           count(*)::BIGINT AS n_raw, count(DISTINCT z)::BIGINT AS n_codes FROM j GROUP BY encoder""",
)
def encoding_gap(spark, sf):
    """The oracle uses the direct forms: conditional mutual information and within-fiber variance."""
    return rounded(rk.gap(coded_cells(spark, sf), COLS, "codes", ["encoder"]), "logloss_gap", "brier_gap")


@query(
    "reachable_codes",
    f"{CODED} SELECT encoder, count(DISTINCT z)::BIGINT AS n_codes FROM coded GROUP BY encoder",
)
def reachable_codes(spark, sf):
    cells = coded_cells(spark, sf).withColumn("z", F.transform("codes", lambda v: F.round(v, rk.CODE_DIGITS)))
    return cells.groupBy("encoder", "z").agg(F.count("*").alias("c")).groupBy("encoder").agg(F.count("*").alias("n_codes"))


SEEDS = list(range(21, 31))  # fixed values: seeds of the learned-encoder samples
SAMPLE_SHARE = 0.25


@query(
    "gap_over_samples",
    f"""{CELLS},
    smp AS (SELECT seed, o.* FROM orders_cat o, range(21, 31) t(seed)
            WHERE {B.prefix48("seed || ':' || row_id")} / 281474976710656.0::DOUBLE < 0.25::DOUBLE),
    sf AS (SELECT seed, count(*) AS fit_n, sum(y) AS fit_pos FROM smp GROUP BY seed),
    ss AS (SELECT seed, nation AS level, count(*) AS n, sum(y) AS pos FROM smp GROUP BY ALL),
    xn AS (SELECT nation, sum(n) AS n, sum(pos) AS pos FROM x GROUP BY nation),
    c AS (SELECT f.seed, xn.n, xn.pos, round(coalesce({TARGET}, f.fit_pos / f.fit_n), 12) AS z
          FROM xn JOIN sf f ON true LEFT JOIN ss s ON s.seed = f.seed AND s.level = xn.nation),
    fib AS (SELECT seed, z, sum(n) AS fn, sum(pos) AS fpos FROM c GROUP BY ALL),
    j AS (SELECT c.*, fpos / fn AS ez, pos / n AS ex FROM c JOIN fib USING (seed, z)),
    g AS (SELECT seed, sum(n * ((CASE WHEN ex > 0 THEN ex * ln(ex / ez) ELSE 0 END)
             + (CASE WHEN ex < 1 THEN (1 - ex) * ln((1 - ex) / (1 - ez)) ELSE 0 END))) / sum(n) AS gap FROM j GROUP BY seed)
    SELECT count(*)::BIGINT AS n_seeds, round(avg(gap), 9) AS mean_gap,
           round(stddev_samp(gap) / sqrt(count(*)), 9) AS mcse FROM g""",
)
def gap_over_samples(spark, sf):
    """Information lost by target encoders fitted on seeded samples, measured on the full joint."""
    rows = rs.orders_cat(spark, sf).select("row_id", "nation", "y")
    seed = F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed")
    drawn = rows.select("*", seed).where(unit_interval(F.col("seed"), F.col("row_id")) < SAMPLE_SHARE)
    counts = drawn.groupBy("seed", F.col("nation").alias("level")).agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    counts = materialize(counts, "samples")
    fit = counts.groupBy("seed").agg(F.sum("n").alias("fit_n"), F.sum("pos").alias("fit_pos"))
    codes = enc.target_codes(counts.join(F.broadcast(fit), "seed")).select("seed", F.col("level").alias("nation"), "code")
    cells = rk.joint(rows, ["nation"]).select("*", seed)
    prior = fit.select("seed", (F.col("fit_pos") / F.col("fit_n")).alias("_prior"))
    coded = cells.join(codes, ["seed", "nation"], "left").join(F.broadcast(prior), "seed")
    coded = coded.withColumn("codes", F.array(F.coalesce("code", "_prior")))
    gaps = rk.gap(coded, ["nation"], "codes", ["seed"])
    out = gaps.agg(
        F.count("*").alias("n_seeds"),
        F.avg("logloss_gap").alias("mean_gap"),
        (F.stddev_samp("logloss_gap") / F.sqrt(F.count("*"))).alias("mcse"),
    )
    return rounded(out, "mean_gap", "mcse")


# ---- selection optimism ----------------------------------------------------------------------

REPLICATES = 40
RUNS = list(range(rs.RUNS))
SETS = {"k2": RUNS[:2], "k4": RUNS[:4], "k8": RUNS}


def poisson_sql(u: str) -> str:
    from math import exp, factorial

    mass, parts = 0.0, []
    for k in range(op.POISSON_CUTS):
        mass += exp(-1.0) / factorial(k)
        parts.append(f"({u} >= {mass!r}::DOUBLE)::INT")
    return " + ".join(parts)


def _weight(seed: str) -> str:
    u = f"({B.prefix48(f'{chr(39)}{seed}:{chr(39)} || r || {chr(39)}:{chr(39)} || group_id')} / 281474976710656.0::DOUBLE)"
    return f"({poisson_sql('u_' + seed)}) AS w{seed[0]}", f"{u} AS u_{seed}"


_V, _UV = _weight("val")
_T, _UT = _weight("test")
BOOT = f"""WITH {B.ORDERS}, {B.PREDS},
    hits AS (SELECT group_id, run AS candidate, count(*) AS n, sum(((y_score >= 0.5::DOUBLE)::INT = y_true)::INT) AS h
             FROM preds GROUP BY ALL),
    draw AS (SELECT r, group_id, {_UV}, {_UT} FROM (SELECT DISTINCT group_id FROM hits), range(0, {REPLICATES}) t(r)),
    wts AS (SELECT r, group_id, {_V}, {_T} FROM draw),
    scores AS (SELECT r::INT AS replicate, candidate::INT AS candidate, sum(wv * h) / sum(wv * n) AS val,
                      sum(wt * h) / sum(wt * n) AS test FROM hits JOIN wts USING (group_id) GROUP BY ALL),
    truth AS (SELECT candidate::INT AS candidate, sum(h) / sum(n) AS mu FROM hits GROUP BY ALL)"""
PANEL = f"""{BOOT},
    sets(candidate_set, top) AS (VALUES ('k2', 2), ('k4', 4), ('k8', 8)),
    ts AS (SELECT candidate_set, candidate, mu, max(mu) OVER (PARTITION BY candidate_set) AS mu_star
           FROM truth JOIN sets ON candidate < top),
    sg AS (SELECT candidate, stddev_samp(val) AS sigma FROM scores GROUP BY 1),
    ea AS (SELECT t.*, sigma, replicate, val, test, max(val) OVER w AS top_val, max(test) OVER w AS top_test
           FROM ts t JOIN scores USING (candidate) JOIN sg USING (candidate) WINDOW w AS (PARTITION BY candidate_set, replicate)),
    pr AS (SELECT candidate_set, replicate, any_value(mu_star) AS mu_star, any_value(top_test) - any_value(mu_star) AS oo,
           arg_min(mu, candidate) FILTER (val = top_val) AS mu_hat, arg_min(test, candidate) FILTER (val = top_val) AS test_hat,
           min(candidate) FILTER (val = top_val) AS winner,
           arg_min(mu, candidate) FILTER (val >= top_val - sigma) AS mu_ose FROM ea GROUP BY ALL),
    pn AS (SELECT candidate_set, count(*)::BIGINT AS n_replicates, avg(oo) AS oracle_optimism_mean,
           avg(mu_star - mu_hat) AS regret_mean, avg(test_hat - mu_hat) AS reporting_bias_mean,
           avg(test_hat) AS test_selected_mean, avg(mu_star - mu_ose) AS one_se_regret_mean,
           stddev_samp(oo) / sqrt(count(*)) AS oracle_optimism_mcse,
           stddev_samp(mu_star - mu_hat) / sqrt(count(*)) AS regret_mcse,
           stddev_samp(test_hat - mu_hat) / sqrt(count(*)) AS reporting_bias_mcse,
           avg((mu_hat = mu_star)::INT) AS p_select_best,
           stddev_samp((mu_hat = mu_star)::INT) / sqrt(count(*)) AS p_select_best_mcse FROM pr GROUP BY 1),
    wn AS (SELECT candidate_set, 1 - max(c) / sum(c) AS winner_instability
           FROM (SELECT candidate_set, winner, count(*) AS c FROM pr GROUP BY ALL) GROUP BY 1),
    bd AS (SELECT candidate_set, count(*)::BIGINT AS n_candidates, max(sigma) * sqrt(2 * ln(greatest(count(*), 2))) AS bound
           FROM ts JOIN sg USING (candidate) GROUP BY 1),
    panel AS (SELECT pn.*, winner_instability, n_candidates, bound, oracle_optimism_mean / bound AS oracle_bound_ratio
              FROM pn JOIN wn USING (candidate_set) JOIN bd USING (candidate_set))"""
MEASURES = (
    "oracle_optimism_mean regret_mean reporting_bias_mean test_selected_mean one_se_regret_mean oracle_optimism_mcse "
    "regret_mcse reporting_bias_mcse p_select_best p_select_best_mcse winner_instability bound oracle_bound_ratio"
).split()


def boot(spark, sf):
    hits = materialize(op.group_hits(rs.predictions(spark, sf), RUNS), "hits")
    return op.bootstrap_scores(hits, RUNS, REPLICATES), op.true_scores(hits, RUNS)


def panels(spark, sf):
    scores, truth = boot(spark, sf)
    scores = materialize(op.candidate_sets(scores, SETS), "scores")
    return op.panel(scores, op.candidate_sets(truth, SETS))


@query(
    "bootstrap_scores",
    f"{BOOT} SELECT replicate, candidate, round(val, 9) AS val, round(test, 9) AS test FROM scores",
)
def bootstrap_scores(spark, sf):
    return rounded(boot(spark, sf)[0], "val", "test")


@query(
    "optimism_panel",
    f"""{PANEL} SELECT candidate_set, n_replicates, n_candidates,
    {', '.join(f'round({m}, 9) AS {m}' for m in MEASURES)} FROM panel""",
)
def optimism_panel(spark, sf):
    return rounded(panels(spark, sf), *MEASURES)


@query(
    "one_se_rule",
    f"""{BOOT}, sg AS (SELECT stddev_samp(val) AS sigma FROM scores WHERE candidate = 0),
    near AS (SELECT *, max(val) OVER (PARTITION BY replicate) AS best FROM scores)
    SELECT replicate, min(candidate) AS candidate, round(arg_min(val, candidate), 9) AS score
    FROM near, sg WHERE val >= best - sigma GROUP BY replicate""",
)
def one_se_rule(spark, sf):
    from foldspark.operators.selection import one_se_rule as rule

    scores = materialize(boot(spark, sf)[0], "scores")
    sigma = scores.where("candidate = 0").agg(F.stddev_samp("val").alias("s")).scalar()
    cands = scores.select("replicate", "candidate", F.col("val").alias("score"), F.col("candidate").alias("complexity"))
    return rounded(rule(cands, ["replicate"], sigma), "score")


@query(
    "optimism_asymmetry",
    f"""{PANEL} SELECT round(l.oracle_optimism_mean - s.oracle_optimism_mean, 9) AS oracle_advantage,
    round(3 * (l.oracle_optimism_mcse + s.oracle_optimism_mcse), 9) AS tolerance,
    l.oracle_optimism_mean - s.oracle_optimism_mean >= -3 * (l.oracle_optimism_mcse + s.oracle_optimism_mcse) AS criterion_pass
    FROM panel l, panel s WHERE l.candidate_set = 'k8' AND s.candidate_set = 'k2'""",
)
def optimism_asymmetry(spark, sf):
    return rounded(op.asymmetry(panels(spark, sf), "k8", "k2"), "oracle_advantage", "tolerance")


@query(
    "monotone_check",
    f"""{PANEL} SELECT candidate_set, n_candidates, round(oracle_optimism_mean, 9) AS oracle_optimism_mean,
    coalesce(oracle_optimism_mean >= lag(oracle_optimism_mean) OVER w
      - 3 * (oracle_optimism_mcse + lag(oracle_optimism_mcse) OVER w), true) AS monotone
    FROM panel WINDOW w AS (ORDER BY n_candidates)""",
)
def monotone_check(spark, sf):
    return rounded(op.monotone_check(panels(spark, sf)), "oracle_optimism_mean")


@query(
    "criteria_table",
    f"""{PANEL}, rows AS (
      SELECT candidate_set, 'honest_unbiased' AS criterion, abs(reporting_bias_mean) AS v, 0.0::DOUBLE AS t,
             greatest(3 * reporting_bias_mcse, 1e-4::DOUBLE) AS tol FROM panel
      UNION ALL SELECT candidate_set, 'oracle_within_bound', oracle_optimism_mean, bound,
             greatest(5 * oracle_optimism_mcse, 1e-6::DOUBLE) FROM panel
      UNION ALL SELECT candidate_set, 'regret_within_bound', regret_mean, bound,
             greatest(5 * oracle_optimism_mcse, 1e-6::DOUBLE) FROM panel)
    SELECT candidate_set, criterion, round(v, 9) AS value, round(t, 9) AS theoretical, round(tol, 9) AS tolerance,
           v <= t + tol AS criterion_pass FROM rows""",
)
def criteria_table(spark, sf):
    return rounded(op.criteria(panels(spark, sf)), "value", "theoretical", "tolerance")


# ---- homogeneity analysis --------------------------------------------------------------------


@query(
    "burt_matrix",
    f"""WITH {B.LINE}, t AS (SELECT returnflag, linestatus, brand, ptype FROM line_cat),
    p AS ({' UNION ALL '.join(
        f"SELECT '{a}' AS col_a, {a} AS level_a, '{b}' AS col_b, {b} AS level_b FROM t"
        for a in rs.LINE_COLUMNS for b in rs.LINE_COLUMNS)})
    SELECT *, count(*)::BIGINT AS n FROM p GROUP BY ALL""",
)
def burt_matrix(spark, sf):
    return hm.burt(rs.line_cat(spark, sf), rs.LINE_COLUMNS)


@query("enc_homals")
def enc_homals(spark, sf):
    """Two quantifications per category of every order (iterative: no SQL form)."""
    rows = rs.orders_cat(spark, sf)
    quants = hm.fit(rows, COLS)
    table = materialize(quants, "homals")
    each = to_long(rows, COLS, ["row_id"])
    coded = fs.lookup(each, table, ["col", "level"], ["row_id"])
    return coded.select("row_id", "col", F.round("q1", 6).alias("q1"), F.round("q2", 6).alias("q2"))
