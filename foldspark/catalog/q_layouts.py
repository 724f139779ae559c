"""Feature layouts and experiment grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspark.catalog import blocks as B
from foldspark.catalog.q_evaluation import rounded
from foldspark.catalog.registry import query
from foldspark.operators import cube as cb
from foldspark.operators import foldsafe as fs
from foldspark.operators import layouts as ly
from foldspark.operators import splits
from foldspark.plans import grid
from foldspark.session import materialize
from foldspark.sources import rowsets as rs

ALL = ["state"]
SCALED = """WITH e AS (SELECT vec_id AS row_id, (generate_subscripts(embedding, 1) - 1)::INT AS i,
                         unnest(embedding)::DOUBLE AS v FROM embeddings),
    b AS (SELECT i, min(v) AS lo, max(v) AS hi FROM e GROUP BY 1),
    z AS (SELECT row_id, i, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END AS z FROM e JOIN b USING (i)),
    d AS (SELECT count(*)::INT AS d, ceil(sqrt(count(*)))::INT AS h,
                 ceil(count(*) / ceil(sqrt(count(*))))::INT AS w FROM b)"""
PAIRS = f"""{SCALED},
    pr AS (SELECT a.i, c.i AS j, round(1 - coalesce(nullif(corr(a.z, c.z), 'nan'::DOUBLE), 0), 9) AS dist
           FROM z a JOIN z c ON a.row_id = c.row_id AND a.i < c.i GROUP BY ALL)"""


def scaled_embeddings(spark, sf):
    """Min-max scaled embedding values of every vector."""
    coded = rs.embedding_codes(spark, sf).withColumn("state", F.lit("all"))
    bounds = fs.scaler_bounds(coded, ALL, F.lit(True))
    return fs.scale(coded, bounds, ALL).select("state", "row_id", "y", F.col("scaled").alias("codes"))


def distances(spark, sf):
    return ly.feature_distance(scaled_embeddings(spark, sf), ALL)


@query("feature_corr", f"{PAIRS} SELECT i, j, dist FROM pr")
def feature_corr(spark, sf):
    return rounded(distances(spark, sf), "dist").select("i", "j", "dist")


@query(
    "pair_ranks",
    f"{PAIRS} SELECT i, j, (row_number() OVER (ORDER BY dist, i, j) - 1)::BIGINT AS feature_rank FROM pr",
)
def pair_ranks(spark, sf):
    return ly.pair_ranks(distances(spark, sf), ALL).select("i", "j", "feature_rank")


@query(
    "grid_ranks",
    f"""{SCALED}, g AS (SELECT a.i, c.i AS j, sqrt((a.i // w - c.i // w) ** 2 + (a.i % w - c.i % w) ** 2) AS cell_dist
          FROM b a JOIN b c ON a.i < c.i, d)
    SELECT i, j, round(cell_dist, 9) AS cell_dist,
           (row_number() OVER (ORDER BY round(cell_dist, 9), i, j) - 1)::BIGINT AS cell_rank FROM g""",
)
def grid_ranks(spark, sf):
    grids = ly.grid_distance(distances(spark, sf), ALL)
    ranked = ly.pair_ranks(grids, ALL, "cell_dist", "cell_rank")
    return rounded(ranked, "cell_dist").select("i", "j", "cell_dist", "cell_rank")


SEEDS = (7, 8, 9, 10)


@query("placement_search")
def placement_search(spark, sf):
    """Four searches that exchange their best states (the placement itself has no SQL form; see placement_audit)."""
    placed = ly.fit_placement(scaled_embeddings(spark, sf), ALL, seeds=SEEDS)
    return placed.select("state", "seed", F.round("error", 6).alias("error"), F.round("start_error", 6).alias("start_error"), "perm")


@query(
    "placement_audit",
    f"""{PAIRS}, fr AS (SELECT i, j, row_number() OVER (ORDER BY dist, i, j) - 1 AS f FROM pr),
    cr AS (SELECT a.i, c.i AS j, row_number() OVER (ORDER BY
        round(sqrt((a.i // w - c.i // w) ** 2 + (a.i % w - c.i % w) ** 2), 9), a.i, c.i) - 1 AS c FROM b a JOIN b c ON a.i < c.i, d)
    SELECT 'all' AS state, max(j) + 1 AS n_features, true AS is_permutation, true AS error_holds, true AS not_above_single,
      round(sum((f - c) ** 2)::DOUBLE * 2 / ((max(j) + 1) * (max(j) + 1)), 6) AS start_error
    FROM fr JOIN cr USING (i, j)""",
)
def placement_audit(spark, sf):
    """The returned placement is a permutation, its error is that of its ranks, and no single search of the first seed is better."""
    ranks = ly.placement_ranks(scaled_embeddings(spark, sf), ALL)
    best = materialize(ly.best_placement(ly.search_placement(ranks, ALL, list(SEEDS)), ALL), "placed")
    single = ly.search_placement(ranks, ALL, [SEEDS[0]]).select("state", F.col("error").alias("single"))
    checked = best.join(ly.placement_error(ranks, best, ALL), ALL).join(single, ALL)
    order = F.transform(F.array_sort("perm"), lambda p, i: p == i)
    return checked.select(
        "state", "n_features", F.forall(order, lambda x: x).alias("is_permutation"),
        (F.abs(F.col("error") - F.col("recomputed")) < 1e-9 * F.col("start_error")).alias("error_holds"),
        (F.col("error") <= F.col("single")).alias("not_above_single"), F.round("start_error", 6).alias("start_error"),
    )


@query(
    "render_placement",
    f"""{SCALED}, m AS (SELECT i, row_number() OVER (ORDER BY round(avg(z), 6) DESC, i) - 1 AS cell FROM z GROUP BY i)
    SELECT z.row_id, m.cell::INT AS cell, round(z.z::FLOAT::DOUBLE, 6) AS v FROM z JOIN m USING (i), d
    UNION ALL SELECT row_id, c::INT, 0.0::DOUBLE FROM (SELECT DISTINCT row_id FROM z), d, range(d.d, d.h * d.w) t(c)""",
)
def render_placement(spark, sf):
    """Features placed by decreasing mean."""
    z = scaled_embeddings(spark, sf)
    means = z.select("state", F.posexplode("codes").alias("i", "v")).groupBy("state", "i").agg(F.avg("v").alias("m"))
    order = F.array_sort(F.collect_list(F.struct((-F.round("m", 6)).alias("m"), "i")))
    perm = means.groupBy("state").agg(F.transform(order, lambda e: e["i"]).alias("perm"))
    shown = z.join(F.broadcast(perm), "state").withColumn("image", ly.render_placement(F.col("codes"), F.col("perm")))
    each = shown.select("row_id", F.posexplode("image").alias("cell", "v"))
    return each.withColumn("v", F.round(F.col("v").cast("double"), 6))


@query("render_bits", f"{SCALED} SELECT row_id, i AS position, z::FLOAT::BIT::VARCHAR AS bits FROM z")
def render_bits(spark, sf):
    z = scaled_embeddings(spark, sf)
    return z.select("row_id", F.posexplode(ly.bit_patterns("codes")).alias("position", "bits"))


@query(
    "render_bars",
    f"SELECT row_id, i AS position, round_even(z * (d - 1), 0)::INT AS height FROM ({SCALED} SELECT * FROM z, d)",
)
def render_bars(spark, sf):
    z = scaled_embeddings(spark, sf)
    return z.select("row_id", F.posexplode(ly.bar_heights(F.col("codes"))).alias("position", "height"))


RESIZED = 16


@query(
    "resize_area",
    f"""{SCALED}, bits AS (SELECT row_id, i AS r, (p - 1) AS c, substr(z::FLOAT::BIT::VARCHAR, p, 1)::DOUBLE AS v
                          FROM z, range(1, 33) t(p)),
    bin AS (SELECT o, floor(o * (d / {RESIZED}.0::DOUBLE))::INT AS r0,
              greatest(floor((o + 1) * (d / {RESIZED}.0::DOUBLE))::INT, floor(o * (d / {RESIZED}.0::DOUBLE))::INT + 1) AS r1,
              floor(o * (32 / {RESIZED}.0::DOUBLE))::INT AS c0,
              greatest(floor((o + 1) * (32 / {RESIZED}.0::DOUBLE))::INT, floor(o * (32 / {RESIZED}.0::DOUBLE))::INT + 1) AS c1
            FROM d, range(0, {RESIZED}) t(o))
    SELECT row_id, (a.o * {RESIZED} + b.o)::INT AS pixel, round(avg(v), 6) AS v
    FROM bits JOIN bin a ON r >= a.r0 AND r < a.r1 JOIN bin b ON c >= b.c0 AND c < b.c1 GROUP BY ALL""",
)
def resize_area(spark, sf):
    z = scaled_embeddings(spark, sf)
    image = ly.render_resized("bits", RESIZED)("codes", F.array(F.lit(0)))
    each = z.select("row_id", F.posexplode(image).alias("pixel", "v"))
    return each.withColumn("v", F.round(F.col("v").cast("double"), 6))


# ---- grids -----------------------------------------------------------------------------------

DATASETS = {
    "orders": (rs.orders_cat, rs.ORDERS_COLUMNS, B.ORDERS, "orders_cat"),
    "events": (rs.events_cat, rs.EVENTS_COLUMNS, B.EVENTS, "events_cat"),
    "docs": (rs.docs_cat, rs.DOCS_COLUMNS, B.DOCS, "docs_cat"),
}


def widths_sql() -> str:
    """CTE w: width of each encoder's code per (dataset, fold)."""
    levels = " UNION ALL ".join(
        f"""(WITH {cte}, {B.splits(name)}, {B.assigned(name)}, {B.long('asg', cols, 'outer_fold, role')}
        SELECT '{ds}' AS dataset_id, outer_fold, count(DISTINCT (col, level)) AS k, {len(cols)} AS m
        FROM lng WHERE role = 'inner_train' GROUP BY outer_fold)"""
        for ds, (_, cols, cte, name) in DATASETS.items()
    )
    rule = "CASE WHEN k < 50 THEN 16 WHEN k < 500 THEN 32 WHEN k < 5000 THEN 64 ELSE m END"
    return f"""lv AS ({levels}),
    w AS (SELECT dataset_id, outer_fold, encoder, (CASE encoder WHEN 'label' THEN m WHEN 'target' THEN m
              WHEN 'onehot' THEN k + m ELSE {rule} END)::BIGINT AS width
          FROM lv, (VALUES ('label'), ('onehot'), ('target'), ('hash_column'), ('hash_shared')) t(encoder)),
    px AS (SELECT *, (CASE layout WHEN 'bits' THEN width * 32 WHEN 'bars' THEN width * width
              ELSE ceil(sqrt(width)) * ceil(width / ceil(sqrt(width))) END)::BIGINT AS native_pixels
           FROM w, (VALUES ('placement'), ('bits'), ('bars')) t(layout))"""


def widths(spark, sf):
    frames = []
    for name, (rows_of, columns, _, _) in DATASETS.items():
        rows = rows_of(spark, sf)
        assigned = splits.assign(rows, splits.fold_uses(rows))
        states = cb.full_states(cb.fold_cube(assigned, columns), columns[0])
        frames.append(grid.code_widths(states, columns).withColumn("dataset_id", F.lit(name)))
    return materialize(fs.union_all(frames), "widths")


@query(
    "pixel_eligibility",
    f"""WITH {widths_sql()} SELECT *, CASE WHEN native_pixels > 262144 THEN 'SKIPPED_INELIGIBLE' ELSE 'ELIGIBLE' END AS status
    FROM px""",
)
def pixel_eligibility(spark, sf):
    return ly.pixel_eligibility(widths(spark, sf))


CODES = ("label", "onehot", "target", "hash_column", "hash_shared")
RUNS = [
    *[("image", e, layout, "pca_mlp", 5) for e in CODES for layout in ("placement", "bits", "bars")],
    *[("tabular", e, "none", model, 5) for e in CODES for model in ("logistic", "gbt", "mlp")],
    ("raw", "raw", "none", "cat_gbt", 5),
]
GRID = f"""WITH {widths_sql()},
    r AS (SELECT * FROM (VALUES {", ".join(map(str, RUNS))}) v(branch, encoder, layout, model, seed)),
    f AS (SELECT DISTINCT dataset_id, outer_fold FROM w),
    c AS (SELECT f.dataset_id, f.outer_fold, r.*,
            CASE WHEN r.encoder = 'onehot' AND w.width > 1500 THEN 'onehot_width_cap'
                 WHEN px.native_pixels > 262144 THEN 'pixel_cap' ELSE 'none' END AS eligibility_rule
          FROM f CROSS JOIN r
          LEFT JOIN w ON w.dataset_id = f.dataset_id AND w.outer_fold = f.outer_fold AND w.encoder = r.encoder
          LEFT JOIN px ON px.dataset_id = f.dataset_id AND px.outer_fold = f.outer_fold
            AND px.encoder = r.encoder AND px.layout = r.layout)
    SELECT concat_ws('/', dataset_id, outer_fold, branch, encoder, layout, model, seed) AS cell_id, *,
      CASE eligibility_rule WHEN 'none' THEN 'PENDING' ELSE 'SKIPPED_INELIGIBLE' END AS status FROM c"""


@query("grid_cells", GRID)
def grid_cells(spark, sf):
    return grid.expand(widths(spark, sf), RUNS)


@query(
    "config_hash",
    f"""SELECT cell_id, sha256('{{"branch":"' || branch || '","encoder":"' || encoder || '","layout":"' || layout || '","model":"' || model
      || '","seed":' || seed || '}}') AS config_hash FROM ({GRID})""",
)
def config_hash(spark, sf):
    """Canonical-JSON hash of each grid cell's configuration."""
    from foldspark.operators.lineage import config_hash as hashed

    cells = grid.expand(widths(spark, sf), RUNS)
    names = ["branch", "encoder", "layout", "model", "seed"]
    return hashed(cells, names).select("cell_id", "config_hash")
