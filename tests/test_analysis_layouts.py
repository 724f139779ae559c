"""Information loss, optimism, homogeneity analysis and layouts against dense references."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.functions.hashing import unit_interval
from foldspark.operators import homals as hm
from foldspark.operators import layouts as ly
from foldspark.operators import optimism as op
from foldspark.operators import risk as rk


def test_gap_is_zero_for_injective_and_lossless_merges(spark):
    # eta depends on x1 only; z = x1 loses nothing, z = x2 loses something, z = (x1, x2) is injective
    rows = [(a, b, int(i < (2 if a == "p" else 8))) for a in "pq" for b in "uv" for i in range(10)]
    df = spark.createDataFrame(rows, "x1 STRING, x2 STRING, y INT")
    cells = rk.joint(df, ["x1", "x2"])
    one = (F.col("x1") == "p").cast("double")
    two = (F.col("x2") == "u").cast("double")
    coded = {"merge": F.array(one), "lossy": F.array(two), "both": F.array(one, two)}
    out = {}
    for name, z in coded.items():
        r = rk.gap(cells.withColumns({"e": F.lit(name), "z": z}), ["x1", "x2"], "z", ["e"]).first()
        out[name] = r
    assert out["both"].logloss_gap == pytest.approx(0, abs=1e-12) and out["merge"].brier_gap == pytest.approx(0, abs=1e-12)
    assert out["merge"].n_codes == 2 and out["both"].n_codes == 4
    h = lambda p: -(p * np.log(p) + (1 - p) * np.log(1 - p))
    assert out["lossy"].logloss_gap == pytest.approx(h(0.5) - h(0.2))
    assert out["lossy"].brier_gap == pytest.approx(0.25 - 0.16)


def test_poisson_weights_have_unit_mean_and_variance(spark):
    w = spark.range(20000).select(op.poisson_weight(unit_interval("s", F.col("id"))).alias("w"))
    mean, var = w.agg(F.avg("w"), F.var_samp("w")).first()
    assert mean == pytest.approx(1, abs=0.03) and var == pytest.approx(1, abs=0.05)


def test_optimism_panel_by_hand(spark):
    # true values 0.5, 0.7, 0.6; validation picks candidates 1, 1, 2, 0 and the one-standard-error rule 0, 1, 1, 0
    val = [(0.6, 0.8, 0.5), (0.2, 0.9, 0.5), (0.4, 0.7, 0.8), (0.8, 0.4, 0.6)]
    test = [(0.5, 0.6, 0.9), (0.4, 0.8, 0.6), (0.5, 0.7, 0.7), (0.7, 0.5, 0.6)]
    rows = [(r, c, val[r][c], test[r][c]) for r in range(4) for c in range(3)]
    scores = spark.createDataFrame(rows, "replicate INT, candidate INT, val DOUBLE, test DOUBLE").withColumn("candidate_set", F.lit("s"))
    truth = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.6)], "candidate INT, mu DOUBLE").withColumn("candidate_set", F.lit("s"))
    out = op.panel(scores, truth).first()
    assert out.oracle_optimism_mean == pytest.approx(0.775 - 0.7)  # best test scores 0.9, 0.8, 0.7, 0.7
    assert out.regret_mean == pytest.approx((0 + 0 + 0.1 + 0.2) / 4)
    assert out.reporting_bias_mean == pytest.approx((-0.1 + 0.1 + 0.1 + 0.2) / 4)
    assert out.p_select_best == pytest.approx(0.5)
    assert out.winner_instability == pytest.approx(0.5)
    # variances over the replicates: 0.2 / 3, 0.14 / 3 and 0.06 / 3
    assert out.one_se_regret_mean == pytest.approx((0.2 + 0 + 0 + 0.2) / 4)
    assert out.bound == pytest.approx((0.2 / 3) ** 0.5 * (2 * np.log(3)) ** 0.5)


# ---- homogeneity analysis --------------------------------------------------------------------


def associated_rows(n=400):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 3, n)
    noisy = lambda p: np.where(rng.random(n) < p, base, rng.integers(0, 3, n))
    return np.stack([base, noisy(0.8), noisy(0.6)], axis=1)


def test_quantifications_are_principal_axes(spark):
    x = associated_rows()
    columns = ["a", "b", "c"]
    df = spark.createDataFrame([tuple(f"v{v}" for v in row) for row in x], columns)
    out = {(r.col, r.level): (r.n, r.q1, r.q2) for r in hm.fit(df, columns).collect()}
    n, *q = np.array([out[(c, f"v{v}")] for c in columns for v in range(3)]).T
    # closed form: correspondence analysis of the indicators
    indicators = (x[:, :, None] == np.arange(3)).reshape(len(x), 9).astype(float)
    assert n == pytest.approx(indicators.sum(0))
    _, singular, axes = np.linalg.svd((indicators - indicators.mean(0)) / np.sqrt(n), full_matrices=False)
    for k in range(2):
        want = axes[k] * singular[k] * np.sqrt(len(x) / n)
        assert q[k] == pytest.approx(want * np.sign(want @ q[k]), abs=1e-6)
        assert q[k][np.abs(q[k]).argmax()] > 0 and n @ q[k] == pytest.approx(0, abs=1e-6)


def test_sides_are_solved_together_and_failure_is_typed(spark):
    """More levels than one cycle spans, close eigenvalues, and a side of its own shape; each as if it were alone."""
    rng = np.random.default_rng(11)
    big = [("big", *(f"v{v}" for v in row)) for row in rng.integers(0, 40, (800, 3))]
    small = [("small", *(f"v{v}" for v in row)) for row in associated_rows(200)]
    df = spark.createDataFrame(big + small, "side STRING, a STRING, b STRING, c STRING")
    columns = ["a", "b", "c"]
    out = hm.fit(df, columns, ("side",))
    for side, rows in (("big", big), ("small", small)):
        found = {(r.col, r.level): r for r in out.where(F.col("side") == side).collect()}
        names = sorted({(c, r[1 + j]) for r in rows for j, c in enumerate(columns)})
        z = np.array([[float(r[1 + columns.index(c)] == level) for c, level in names] for r in rows])
        n = z.sum(0)
        _, singular, axes = np.linalg.svd((z - z.mean(0)) / np.sqrt(n), full_matrices=False)
        for k in range(2):
            want = axes[k] * singular[k] * np.sqrt(len(rows) / n)
            q = np.array([found[name][f"q{k + 1}"] for name in names])
            assert q == pytest.approx(want * np.sign(want @ q), abs=1e-5)
            assert found[names[0]][f"theta{k + 1}"] == pytest.approx(singular[k] ** 2, abs=1e-9)
    checks = hm.audit(out, hm.burt(df, columns, ("side",)), 3, ("side",)).collect()
    assert len(checks) == 4
    for r in checks:
        assert r["mean"] == pytest.approx(0, abs=1e-9) and r.length == pytest.approx(1) and r.residual < 1e-6
    with pytest.raises(hm.NotConvergedError):
        hm.fit(df, columns, ("side",), cycles=1)


# ---- layouts ---------------------------------------------------------------------------------


def coded(spark, z):
    rows = [("k", i, [float(v) for v in row]) for i, row in enumerate(z)]
    return spark.createDataFrame(rows, "k STRING, row_id INT, codes ARRAY<DOUBLE>").repartition(3)


def test_distance_equals_numpy_and_constants_give_one(spark):
    z = np.random.default_rng(0).random((40, 5))
    z[:, 3] = 0.7
    pairs = {(r.i, r.j): r.dist for r in ly.feature_distance(coded(spark, z), ["k"]).collect()}
    with np.errstate(invalid="ignore"):
        want = 1 - np.nan_to_num(np.corrcoef(z.T))
    assert len(pairs) == 10
    for (i, j), d in pairs.items():
        assert d == pytest.approx(want[i, j], abs=1e-9)
        if 3 in (i, j):
            assert d == 1.0


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_correlations_keep_their_digits_at_a_large_mean(spark, tasks):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(300, 6))
    z[:, 3:] += z[:, :3]
    z += 1e8
    df = coded(spark, z).repartition(40)
    out = ly.feature_moments(df, ["k"], tasks=tasks).collect()
    assert len(out) == 1 and out[0].n == 300
    assert out[0]["mean"] == pytest.approx(z.mean(0), abs=1e-6)
    m2 = np.array(out[0].m2).reshape(6, 6)
    assert m2 == pytest.approx(np.cov(z.T) * 299, rel=1e-7, abs=1e-5)
    want = 1 - np.corrcoef(z.T)
    for r in ly.feature_distance(df, ["k"]).collect():
        assert r.dist == pytest.approx(want[r.i, r.j], abs=1e-9)


def test_moments_of_several_keys_and_none(spark):
    z = np.random.default_rng(3).random((50, 3))
    df = coded(spark, z).withColumn("k", F.when(F.col("row_id") < 20, "a").when(F.col("row_id") < 30, F.lit(None)).otherwise("b"))
    got = {r.k: r for r in ly.feature_moments(df, ["k"]).collect()}
    assert {k: r.n for k, r in got.items()} == {"a": 20, None: 10, "b": 20}
    assert got["a"]["mean"] == pytest.approx(z[:20].mean(0))
    assert ly.feature_moments(df, []).first().n == 50
    assert ly.feature_moments(df.limit(0), ["k"]).count() == 0


def test_search_improves_and_is_a_permutation(spark):
    z = np.random.default_rng(1).random((60, 12))
    z[:, 6:] = z[:, :6] + 0.05 * z[:, 6:]
    out = ly.fit_placement(coded(spark, z), ["k"], seeds=(7, 8), steps=400).first()
    assert sorted(out.perm) == list(range(12)) and out.error < out.start_error
    again = ly.fit_placement(coded(spark, z), ["k"], seeds=(7, 8), steps=400).first()
    assert again.perm == out.perm


def test_exchanging_searches_are_never_worse_than_the_first(spark):
    z = np.random.default_rng(5).random((80, 20))
    z[:, 10:] = z[:, :10] + 0.1 * z[:, 10:]
    ranks = ly.placement_ranks(coded(spark, z), ["k"])
    many = {r.seed: r for r in ly.search_placement(ranks, ["k"], [7, 8, 9], 600).collect()}
    alone = ly.search_placement(ranks, ["k"], [7], 600).first()
    assert many[7].perm == alone.perm and many[7].error == alone.error
    best = ly.best_placement(ly.search_placement(ranks, ["k"], [7, 8, 9], 600), ["k"])
    assert best.first().error <= alone.error
    check = ly.placement_error(ranks, best, ["k"]).first()
    assert check.n_features == 20 and check.recomputed == pytest.approx(best.first().error)


def test_reported_error_is_the_mean_squared_rank_gap(spark):
    z = np.random.default_rng(1).random((60, 7))
    df = coded(spark, z)
    pairs = ly.pair_ranks(ly.feature_distance(df, ["k"]), ["k"])
    both = ly.pair_ranks(ly.grid_distance(pairs, ["k"]), ["k"], "cell_dist", "cell_rank")
    out = ly.search_placement(both, ["k"], [7], 200).first()
    f, c = np.zeros((7, 7)), np.zeros((7, 7))
    for r in both.collect():
        f[r.i, r.j] = f[r.j, r.i] = r.feature_rank
        c[r.i, r.j] = c[r.j, r.i] = r.cell_rank
    p = np.array(out.perm)
    assert out.error == pytest.approx(((f[np.ix_(p, p)] - c) ** 2).mean())


def test_cell_i_shows_feature_perm_i(spark):
    df = coded(spark, [[0.1, 0.2, 0.3, 0.4, 0.5]]).withColumn("perm", F.array(*map(F.lit, [4, 2, 0, 1, 3])))
    image = df.select(ly.render_placement(F.col("codes"), F.col("perm")).alias("i")).first().i
    assert image == pytest.approx([0.5, 0.3, 0.1, 0.2, 0.4, 0.0])
    bad = df.withColumn("perm", F.array(F.lit(0)))
    with pytest.raises(Exception, match="code width"):
        bad.select(ly.render_placement(F.col("codes"), F.col("perm"))).collect()


def shown(spark, layout, z, perm, size):
    df = coded(spark, [z]).withColumn("perm", F.array(*map(F.lit, perm)))
    return df.select(ly.render_resized(layout, size)("codes", "perm").alias("i")).first().i


def test_rendering_and_resizing_by_hand(spark):
    # 1.0 is 0 01111111 0..., 0.0 has no bits: columns 0-7 hold six ones of row 0, columns 8-15 one
    assert shown(spark, "bits", [1.0, 0.0], [0, 1], 4)[:4] == pytest.approx([6 / 8, 1 / 8, 0, 0])
    assert shown(spark, "bits", [1.0, 0.0], [0, 1], 2) == pytest.approx([7 / 16, 0, 0, 0])
    # bars of 0, 3, 2 and 1 pixels of 4, standing on the lower edge
    bars = [0, 0, 0, 0, 0, 1, 0, 0, 0, 1, 1, 0, 0, 1, 1, 1]
    assert shown(spark, "bars", [0.0, 1.0, 0.7, 0.3], [0, 1, 2, 3], 4) == pytest.approx(bars)
    assert shown(spark, "bars", [0.0, 1.0, 0.7, 0.3], [0, 1, 2, 3], 2) == pytest.approx([1 / 4, 0, 1 / 2, 3 / 4])
    # six features on a 3 x 2 grid
    z, perm = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], [5, 3, 1, 0, 2, 4]
    assert shown(spark, "placement", z, perm, 1) == pytest.approx([0.35], abs=1e-6)
    # three rows in two bins: the first row alone, then the other two
    assert shown(spark, "placement", z, perm, 2) == pytest.approx([0.6, 0.4, (0.2 + 0.3) / 2, (0.1 + 0.5) / 2], abs=1e-6)


def test_pixel_cap(spark):
    widths = spark.createDataFrame([(512,), (513,)], "width BIGINT")
    out = {(r.width, r.layout): (r.native_pixels, r.status) for r in ly.pixel_eligibility(widths).collect()}
    assert out[(512, "bars")] == (262144, "ELIGIBLE")
    assert out[(513, "bars")] == (263169, "SKIPPED_INELIGIBLE")
    assert out[(513, "placement")] == (23 * 23, "ELIGIBLE") and out[(513, "bits")][0] == 513 * 32
