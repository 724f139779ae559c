"""Encoders, fold-safe composition and lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foldspark.catalog import blocks as B
from foldspark.catalog.q_splits import ORDERS_SPLIT, orders_uses
from foldspark.catalog.registry import query
from foldspark.operators import cube as cb
from foldspark.operators import encoders as enc
from foldspark.operators import foldsafe as fs
from foldspark.operators import homals as hm
from foldspark.operators import layouts as ly
from foldspark.operators import lineage as lin
from foldspark.operators import splits
from foldspark.session import materialize, scratch_dir
from foldspark.sources import rowsets as rs
from foldspark.sources.categories import Wide
from foldspark.streaming import apply as live

COLS = rs.ORDERS_COLUMNS
ASG = f"{ORDERS_SPLIT}, {B.assigned('orders_cat')}"
REFITS = f"{ASG}, {B.refits(COLS)}"
EVENTS_SPLIT = f"WITH {B.EVENTS}, {B.splits('events_cat')}, {B.assigned('events_cat')}"
POSITION = "(CASE {t}.col " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(COLS)) + " END)::INT AS position"

# codes of a state in DuckDB; s: level counts, f: fit totals, k: levels of the column
PRIOR = "(f.fit_pos / f.fit_n)"
TARGET = f"(s.pos + 20.0::DOUBLE * {PRIOR}) / (s.n + 20.0::DOUBLE)"
ORDERED_MAP = f"(s.pos + {PRIOR}) / (s.n + 1.0::DOUBLE)"
WOE = """(CASE WHEN s.n IS NOT NULL THEN greatest(-5.0::DOUBLE, least(5.0::DOUBLE, ln(
  ((s.pos + 0.5::DOUBLE) / (f.fit_pos + 0.5::DOUBLE * k.k))
  / ((s.n - s.pos + 0.5::DOUBLE) / (f.fit_n - f.fit_pos + 0.5::DOUBLE * k.k))))) END)"""


NUDGE = 1e-12  # codes are ratios of small integers: keeps exact ties of rounding apart


def flat(coded, *extra, column="codes"):
    """Long, rounded codes for comparison: one row per code position."""
    # the outer form: a plain explode would add a filter that computes the codes a second time
    each = coded.select("row_id", *extra, F.posexplode_outer(column).alias("position", "code"))
    return each.withColumn("code", F.round(F.col("code") + NUDGE, 9))


def rounded_sql(code: str) -> str:
    return f"round({code} + {NUDGE}::DOUBLE, 9)"


def assigned_orders(spark, sf):
    rows, uses = orders_uses(spark, sf)
    return splits.assign(rows, uses)


def assigned_events(spark, sf):
    rows = rs.events_cat(spark, sf)
    return splits.assign(rows, splits.fold_uses(rows))


# ---- plain fits ------------------------------------------------------------------------------

PLAIN = f"""WITH {B.ORDERS}, {B.long('orders_cat', COLS, 'row_id, y')},
    g AS (SELECT col, level, count(*) AS n, sum(y) AS pos FROM lng GROUP BY ALL),
    s AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY level) AS ix FROM g),
    f AS (SELECT count(*) AS fit_n, sum(y) AS fit_pos FROM orders_cat),
    k AS (SELECT col, count(*) AS k FROM s GROUP BY col)"""


def plain_sql(code: str) -> str:
    return f"""{PLAIN} SELECT l.row_id, {POSITION.format(t='l')}, {rounded_sql(code)} AS code
    FROM lng l JOIN s ON s.col = l.col AND s.level = l.level JOIN k ON k.col = l.col, f"""


def plain(name):
    def run(spark, sf):
        rows = rs.orders_cat(spark, sf)
        encoder = enc.ENCODERS[name]
        states = cb.whole_states(rows, COLS)
        codes = encoder.codes(states, ())
        return flat(fs.apply_plain(rows, codes, COLS, F.lit(encoder.unseen or 0.0)))

    return run


query("enc_label", plain_sql("s.ix::DOUBLE"))(plain("label"))
query("enc_count", plain_sql("s.n::DOUBLE / f.fit_n"))(plain("count"))
query("enc_target", plain_sql(TARGET))(plain("target"))
query("enc_woe", plain_sql(WOE))(plain("woe"))


@query(
    "enc_ordered",
    f"""WITH {B.ORDERS}, {B.long('orders_cat', COLS, 'row_id, y')},
    f AS (SELECT sum(y) / count(*) AS prior FROM orders_cat),
    p AS (SELECT row_id, col,
                 (coalesce(sum(y) OVER w, 0) + prior) / (count(*) OVER w + 1.0::DOUBLE) AS c
          FROM lng, f, range(0, 4) t(p)
          WINDOW w AS (PARTITION BY col, level, p ORDER BY md5((977 + p) || ':' || row_id), row_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT row_id, {POSITION.format(t='p')}, {rounded_sql('avg(c)')} AS code FROM p GROUP BY row_id, col""",
)
def enc_ordered(spark, sf):
    return flat(fs.ordered_whole_codes(rs.orders_cat(spark, sf), COLS))


@query(
    "enc_onehot",
    f"""{PLAIN},
    b AS (SELECT col, k, coalesce(sum(k + 1) OVER (ORDER BY {POSITION.format(t='k').split(' AS ')[0]}
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k)
    SELECT l.row_id, l.col, (b.start + s.ix - 1)::BIGINT AS slot, (b.start + b.k)::BIGINT AS unseen_slot
    FROM lng l JOIN s ON s.col = l.col AND s.level = l.level JOIN b ON b.col = l.col""",
)
def enc_onehot(spark, sf):
    rows = rs.orders_cat(spark, sf)
    states = cb.whole_states(rows, COLS)
    slots = enc.onehot_slots(states, COLS)
    table = materialize(slots.select("col", "level", "n", "slot", "unseen_slot"), "slots")
    long = fs.to_long(rows, COLS, ["row_id"])
    return fs.lookup(long, table, ["col", "level"], ["row_id"]).select("row_id", "col", "slot", "unseen_slot")


def bucket_sql(token: str, buckets: str) -> str:
    return f"({B.prefix48(f'(20260810 || {chr(39)}:{chr(39)} || {token})')} % {buckets})::INT"


AWARE = "length(col) || ':' || col || '=' || level"


def hash_sql(token: str) -> str:
    return f"""{PLAIN}, b AS (SELECT CASE WHEN count(*) < 50 THEN 16 WHEN count(*) < 500 THEN 32
        WHEN count(*) < 5000 THEN 64 ELSE 4 END AS b FROM s)
    SELECT row_id, {bucket_sql(token, 'b')} AS bucket, count(*)::BIGINT AS hits FROM lng, b GROUP BY ALL"""


def hashed(column_aware):
    def run(spark, sf):
        rows = rs.orders_cat(spark, sf)
        buckets = enc.hash_width(cb.whole_states(rows, COLS), COLS).select("buckets").scalar()
        each = rows.withColumn("buckets", buckets)
        hits = enc.buckets_of(enc.row_hashes(COLS, column_aware), F.col("buckets"))
        counted = enc.with_bucket_counts(each, hits)  # inside the row, no shuffle
        pairs = F.explode(F.arrays_zip("slots", "counts")).alias("p")
        return counted.select("row_id", pairs).select(
            "row_id", F.col("p.slots").alias("bucket"), F.col("p.counts").cast("bigint").alias("hits")
        )

    return run


query("enc_hash_column", hash_sql(AWARE))(hashed(True))
query("enc_hash_shared", hash_sql("level"))(hashed(False))

FULL_LEVELS = "lv AS (SELECT outer_fold, phase, col, level FROM states WHERE part = -1)"
WIDTHS = f"""{REFITS}, {FULL_LEVELS},
    widths AS (SELECT outer_fold, phase, count(*)::BIGINT AS cardinality,
      (CASE WHEN count(*) < 50 THEN 16 WHEN count(*) < 500 THEN 32 WHEN count(*) < 5000 THEN 64 ELSE 4 END)::INT AS buckets
      FROM lv GROUP BY ALL)"""


def fitted_widths(spark, sf):
    cube = cb.fold_cube(assigned_orders(spark, sf), COLS)
    return enc.hash_width(cb.full_states(cube, COLS[0]), COLS, cb.SIDE)


@query("hash_width", f"{WIDTHS} SELECT * FROM widths")
def hash_width(spark, sf):
    return fitted_widths(spark, sf)


@query(
    "sentinel_buckets",
    f"""{WIDTHS} SELECT *, {bucket_sql("'0'", 'buckets')} AS zero_bucket, {bucket_sql("'1'", 'buckets')} AS one_bucket,
    {bucket_sql("'0'", 'buckets')} <> {bucket_sql("'1'", 'buckets')} AS distinct_buckets FROM widths""",
)
def sentinel_buckets(spark, sf):
    return enc.sentinel_buckets(fitted_widths(spark, sf))


EVENT_TOKENS = f"""WITH {B.EVENTS}, {B.long('events_cat', rs.EVENTS_COLUMNS, 'row_id')},
    tok AS (SELECT DISTINCT {AWARE} AS token FROM lng),
    tb AS (SELECT token, {bucket_sql('token', '32')} AS bucket FROM tok)"""


def event_tokens(spark, sf):
    states = cb.whole_states(rs.events_cat(spark, sf), rs.EVENTS_COLUMNS)
    return enc.token_table(states, F.lit(32), True)


@query("token_bucket", f"{EVENT_TOKENS} SELECT token, bucket FROM tb")
def token_bucket(spark, sf):
    return event_tokens(spark, sf)


@query(
    "hash_collisions",
    f"""{EVENT_TOKENS}, c AS (SELECT bucket, count(*) AS c FROM tb GROUP BY 1)
    SELECT sum(c)::BIGINT AS n_tokens, count(*)::BIGINT AS n_buckets_used,
           (sum(c) - count(*))::BIGINT AS n_colliding_tokens, (sum(c * (c - 1)) / 2)::BIGINT AS n_colliding_pairs,
           32 AS buckets, round(sum(c) * (sum(c) - 1) / 2.0::DOUBLE / 32, 9) AS expected_pairs FROM c""",
)
def hash_collisions(spark, sf):
    return enc.hash_collisions(event_tokens(spark, sf), F.lit(32))


@query(
    "scale_minmax",
    """WITH e AS (SELECT vec_id AS row_id, generate_subscripts(embedding, 1) - 1 AS position,
                         unnest(embedding)::DOUBLE AS v FROM embeddings),
    b AS (SELECT position, min(v) AS lo, max(v) AS hi FROM e GROUP BY 1)
    SELECT row_id, position::INT AS position, round((CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END) + 1e-12::DOUBLE, 9) AS code
    FROM e JOIN b USING (position)""",
)
def scale_minmax(spark, sf):
    coded = rs.embedding_codes(spark, sf).withColumn("state", F.lit("all"))
    bounds = fs.scaler_bounds(coded, ["state"], F.lit(True))
    return flat(fs.scale(coded, bounds, ["state"]), column="scaled")


@query(
    "state_summary",
    f"""{REFITS} SELECT outer_fold, phase, part, col, count(*)::BIGINT AS n_levels, any_value(fit_n) AS fit_n,
    round(any_value(fit_pos / fit_n), 9) AS prior FROM states JOIN fit USING (outer_fold, phase, part) GROUP BY ALL""",
)
def state_summary(spark, sf):
    cube = cb.fold_cube(assigned_orders(spark, sf), COLS)
    return enc.state_summary(cb.all_states(cube, COLS[0]), cb.STATE)


@query(
    "onehot_eligibility",
    f"""{EVENTS_SPLIT}, {B.long('asg', rs.EVENTS_COLUMNS, 'outer_fold, role')},
    w AS (SELECT outer_fold, col, count(DISTINCT level) + 1 AS w FROM lng WHERE role = 'inner_train' GROUP BY ALL)
    SELECT outer_fold, sum(w)::BIGINT AS width,
           CASE WHEN sum(w) <= 1500 THEN 'ELIGIBLE' ELSE 'SKIPPED_INELIGIBLE' END AS status FROM w GROUP BY 1""",
)
def onehot_eligibility(spark, sf):
    cube = cb.fold_cube(assigned_events(spark, sf), rs.EVENTS_COLUMNS)
    inner = cb.full_states(cube, rs.EVENTS_COLUMNS[0]).where("phase = 'inner'")
    return enc.onehot_eligibility(inner, ["outer_fold"])


# ---- fold-safe composition -------------------------------------------------------------------


def lookup_cte(code: str, unseen: str, own_part: str) -> str:
    """Code every use of every row from its refitted state."""
    return f"""{REFITS},
    widths AS (SELECT outer_fold, phase, part, col, count(*) AS k FROM states GROUP BY ALL),
    coded AS (
      SELECT u.row_id, u.y, u.outer_fold, u.phase, u.role, {POSITION.format(t='u')}, coalesce({code}, {unseen}) AS raw
      FROM ulng u JOIN fit f ON f.outer_fold = u.outer_fold AND f.phase = u.phase AND f.part = {own_part}
      JOIN widths k ON k.outer_fold = u.outer_fold AND k.phase = u.phase AND k.part = {own_part} AND k.col = u.col
      LEFT JOIN states s ON s.outer_fold = u.outer_fold AND s.phase = u.phase AND s.part = {own_part}
           AND s.col = u.col AND s.level = u.level)"""


FLAT = f"SELECT row_id, outer_fold, phase, role, position, {rounded_sql('raw')} AS code FROM coded"
FOLDSAFE_TARGET = lookup_cte(TARGET, PRIOR, "u.part")
USE = ("outer_fold", "phase", "role")


def safe(name):
    def run(spark, sf):
        return flat(fs.encode(assigned_orders(spark, sf), COLS, name), *USE)

    return run


query("foldsafe_target", f"{FOLDSAFE_TARGET} {FLAT}")(safe("target"))
query("foldsafe_woe", f"{lookup_cte(WOE, '0.0::DOUBLE', 'u.part')} {FLAT}")(safe("woe"))
SIDED = f"{ORDERS_SPLIT}, {B.sided(COLS, 'orders_cat')}"
query(
    "foldsafe_count",
    f"""{SIDED} SELECT l.row_id, {B.side_names('l')}, l.role, l.ci::INT AS position,
    {rounded_sql('coalesce(s.n::DOUBLE / f.fit_n, 0.0::DOUBLE)')} AS code
    FROM slv l JOIN side_fit f USING (sid) LEFT JOIN side_lv s USING (sid, ci, level)""",
)(safe("count"))
query(
    "foldsafe_label",
    f"""{lookup_cte('(SELECT count(*) FROM states t WHERE t.outer_fold = s.outer_fold AND t.phase = s.phase '
                    'AND t.part = -1 AND t.col = s.col AND t.level <= s.level AND s.level IS NOT NULL)::DOUBLE',
                    '0.0::DOUBLE', '-1')} {FLAT}""",
)(safe("label"))

query(
    "foldsafe_ordered",
    f"""{SIDED}, {B.blocked('orders_cat', len(COLS))},
    scan AS (SELECT l.row_id, l.sid, l.role, l.ci,
               (coalesce(sum(y) OVER w, 0) + {PRIOR}) / (count(*) OVER w + 1.0::DOUBLE) AS c
             FROM (SELECT * FROM slv WHERE part >= 0) l JOIN turn USING (row_id) JOIN side_fit f USING (sid)
             WINDOW w AS (PARTITION BY sid, ci, level, p ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    fitted AS (SELECT row_id, sid, role, ci, avg(c) AS code FROM scan GROUP BY row_id, sid, role, ci),
    held AS (SELECT l.row_id, l.sid, l.role, l.ci, coalesce({ORDERED_MAP}, {PRIOR}) AS code
             FROM (SELECT * FROM slv WHERE part < 0) l JOIN side_fit f USING (sid) LEFT JOIN side_lv s USING (sid, ci, level)),
    every AS (SELECT * FROM fitted UNION ALL SELECT * FROM held)
    SELECT row_id, {B.side_names('every')}, role, ci::INT AS position, {rounded_sql('code')} AS code FROM every""",
)(safe("ordered"))


@query(
    "foldsafe_onehot",
    f"""{SIDED},
    ix AS MATERIALIZED (SELECT sid, ci, level, row_number() OVER (PARTITION BY sid, ci ORDER BY level) AS ix FROM side_lv),
    per AS MATERIALIZED (SELECT sid, ci, count(*) AS k FROM side_lv GROUP BY sid, ci),
    bks AS MATERIALIZED (
      SELECT sid, ci, k, sum(k + 1) OVER (PARTITION BY sid ORDER BY ci) - (k + 1) AS start, sum(k + 1) OVER (PARTITION BY sid) AS width FROM per)
    SELECT l.row_id, {B.side_names('l')}, l.role, l.ci::INT AS position, (b.start + coalesce(ix.ix - 1, b.k))::INT AS slot, b.width::INT AS width
    FROM slv l JOIN bks b USING (sid, ci) LEFT JOIN ix USING (sid, ci, level)""",
)
def foldsafe_onehot(spark, sf):
    coded = fs.encode_onehot(assigned_orders(spark, sf), COLS)
    return coded.select("row_id", *USE, "width", F.posexplode("slots").alias("position", "slot"))


def safe_hash_sql(token: str) -> str:
    return f"""{WIDTHS} SELECT u.row_id, u.outer_fold, u.phase, u.role, {bucket_sql(token, 'w.buckets')} AS position,
        count(*)::DOUBLE AS code FROM ulng u JOIN widths w ON w.outer_fold = u.outer_fold AND w.phase = u.phase
        GROUP BY ALL"""


def safe_hash(column_aware):
    def run(spark, sf):
        coded = fs.encode_hash(assigned_orders(spark, sf), COLS, column_aware)
        pairs = F.explode(F.arrays_zip("slots", "counts")).alias("p")
        each = coded.select("row_id", *USE, pairs)
        return each.select("row_id", *USE, F.col("p.slots").alias("position"), F.col("p.counts").alias("code"))

    return run


query("foldsafe_hash_column", safe_hash_sql(AWARE.replace("col", "u.col").replace("level", "u.level")))(safe_hash(True))
query("foldsafe_hash_shared", safe_hash_sql("u.level"))(safe_hash(False))


def wide_hash_sql(aware: bool) -> str:
    token = f"length(c::VARCHAR) || ':' || c || '=' || bit" if aware else "bit::VARCHAR"
    return f"""{BITS_SPLIT},
    used AS MATERIALIZED (SELECT row_id, outer_fold, phase, role, part FROM asg),
    hit AS (SELECT DISTINCT row_id, ({B.prefix48('word')} % {rs.BITS})::INT AS c FROM (
      SELECT d.doc_id AS row_id, unnest(string_split_regex(text, '[ \\t\\n\\r]+')) AS word
      FROM documents d JOIN labels USING (doc_id))),
    lv AS MATERIALIZED (
      SELECT r.row_id, i::INT AS c, (hit.c IS NOT NULL)::INT AS bit
      FROM docs_cat r, range(0, {rs.BITS}) t(i) LEFT JOIN hit ON hit.row_id = r.row_id AND hit.c = i),
    widths AS MATERIALIZED (
      SELECT outer_fold, phase, CASE WHEN k < 50 THEN 16 WHEN k < 500 THEN 32 WHEN k < 5000 THEN 64 ELSE {rs.BITS} END AS buckets
      FROM (SELECT outer_fold, phase, count(DISTINCT c * 2 + bit) AS k FROM used JOIN lv USING (row_id) WHERE part >= 0 GROUP BY ALL)),
    tok AS MATERIALIZED (
      SELECT c, bit, buckets, {bucket_sql(token, 'buckets')} AS bucket
      FROM (SELECT DISTINCT c, bit FROM lv), (SELECT DISTINCT buckets FROM widths)),
    per AS MATERIALIZED (SELECT row_id, buckets, bucket, count(*)::DOUBLE AS code FROM lv JOIN tok USING (c, bit) GROUP BY ALL)
    SELECT row_id, outer_fold, phase, role, bucket AS position, code
    FROM used JOIN widths USING (outer_fold, phase) JOIN per USING (row_id, buckets)"""


def wide_hash(column_aware):
    def run(spark, sf):
        coded = fs.encode_hash(assigned_bits(spark, sf), BITS, column_aware)
        each = coded.select("row_id", *USE, F.explode(F.arrays_zip("slots", "counts")).alias("p"))
        return each.select("row_id", *USE, F.col("p.slots").alias("position"), F.col("p.counts").alias("code"))

    return run


@query("foldsafe_homals")
def foldsafe_homals(spark, sf):
    """Quantifications fitted on each training side (iterative: no SQL form)."""
    return rounded6(flat(fs.encode_homals(assigned_orders(spark, sf), COLS), *USE))


def side_rows(assigned, *columns):
    """The rows of every training side, once a side."""
    fit = F.explode(F.filter("uses", lambda u: u["part"] >= 0)).alias("_use")
    return assigned.select(*columns, fit).select(*columns, "_use.outer_fold", "_use.phase")


@query(
    "homals_audit",
    f"""{SIDED}, k AS (SELECT sid, count(*)::BIGINT AS n_levels FROM side_lv GROUP BY sid)
    SELECT {B.side_names('k')}, d::INT AS dimension, n_levels, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS length, 0.0::DOUBLE AS residual
    FROM k, range(1, 3) t(d)""",
)
def homals_audit(spark, sf):
    """Quantifications of all training sides: centred, of squared length n times the eigenvalue, and axes of the Burt matrix."""
    rows = materialize(side_rows(assigned_orders(spark, sf), *COLS), "sides")
    quants = materialize(hm.fit(rows, COLS, cb.SIDE), "quants")
    found = hm.audit(quants, hm.burt(rows, COLS, cb.SIDE), len(COLS), cb.SIDE)
    return found.withColumns({c: F.round(F.abs(c), 5) for c in ("mean", "length", "residual")})


@query(
    "homals_pair",
    f"""{ORDERS_SPLIT}, pair AS (
      SELECT group_id, (priority <= '2-HIGH')::INT AS a, (oyear <= '1997')::INT AS b FROM orders_cat),
    cell AS (
      SELECT outer_fold, phase, count(*)::DOUBLE AS n, sum(a) AS a1, sum(b) AS b1, sum(a * b) AS ab
      FROM pair JOIN uses USING (group_id) WHERE part >= 0 GROUP BY outer_fold, phase),
    phi AS (SELECT *, (n * ab - a1 * b1) / sqrt(a1 * (n - a1) * b1 * (n - b1)) AS phi FROM cell),
    z AS (
      SELECT outer_fold, phase, phi, col, level, CASE level WHEN '1' THEN k ELSE n - k END AS n,
        CASE level WHEN '1' THEN sqrt((n - k) / k) ELSE -sqrt(k / (n - k)) END * CASE WHEN col = 'b' AND phi < 0 THEN -1 ELSE 1 END AS z
      FROM phi, LATERAL (VALUES ('a', a1), ('b', b1)) c(col, k), (VALUES ('0'), ('1')) l(level)),
    q AS (
      SELECT *, z * sqrt((1 + abs(phi)) / 2) AS q1, z * sqrt((1 - abs(phi)) / 2) * CASE col WHEN 'b' THEN -1 ELSE 1 END AS q2 FROM z),
    turned AS (
      SELECT *, CASE WHEN arg_max(q1, (round(abs(q1), 9), col, level)) OVER w < 0 THEN -q1 ELSE q1 END AS s1,
        CASE WHEN arg_max(q2, (round(abs(q2), 9), col, level)) OVER w < 0 THEN -q2 ELSE q2 END AS s2
      FROM q WINDOW w AS (PARTITION BY outer_fold, phase))
    SELECT outer_fold, phase, col, level, n::BIGINT AS n, round(1 + abs(phi), 6) AS theta1, round(1 - abs(phi), 6) AS theta2,
      round(s1, 6) AS q1, round(s2, 6) AS q2 FROM turned""",
)
def homals_pair(spark, sf):
    """Two binary columns, whose axes are known in closed form, on every training side."""
    rows, uses = orders_uses(spark, sf)
    pair = {"a": F.col("priority") <= "2-HIGH", "b": F.col("oyear") <= "1997"}
    coded = rows.withColumns({c: x.cast("int").cast("string") for c, x in pair.items()})
    quants = hm.fit(side_rows(splits.assign(coded, uses), "a", "b"), ["a", "b"], cb.SIDE)
    return quants.withColumns({c: F.round(c, 6) for c in ("theta1", "theta2", "q1", "q2")})


def rounded6(df):
    return df.withColumn("code", F.round("code", 6))


SCALED = """, b AS (SELECT outer_fold, phase, position, min(raw) AS lo, max(raw) AS hi FROM coded
      WHERE role IN ('inner_train', 'train') GROUP BY ALL)"""


@query(
    "foldsafe_scaled",
    f"""{FOLDSAFE_TARGET}{SCALED} SELECT row_id, outer_fold, phase, role, position,
    {rounded_sql('(CASE WHEN hi > lo THEN greatest(0, least(1, (raw - lo) / (hi - lo))) ELSE 0 END)')} AS code
    FROM coded JOIN b USING (outer_fold, phase, position)""",
)
def foldsafe_scaled(spark, sf):
    coded = materialize(fs.encode(assigned_orders(spark, sf), COLS, "target"), "coded")
    return flat(fs.scale_foldsafe(coded), *USE, column="scaled")


@query(
    "global_target",
    f"""{ASG}, {B.long('orders_cat', COLS, 'row_id, y')},
    s AS (SELECT col, level, count(*) AS n, sum(y) AS pos FROM lng GROUP BY ALL),
    f AS (SELECT count(*) AS fit_n, sum(y) AS fit_pos FROM orders_cat)
    SELECT l.row_id, a.outer_fold, a.phase, a.role, 'global' AS protocol, {POSITION.format(t='l')},
           {rounded_sql(TARGET)} AS code
    FROM lng l JOIN s ON s.col = l.col AND s.level = l.level JOIN asg a ON a.row_id = l.row_id, f""",
)
def global_target(spark, sf):
    return flat(fs.encode_global(assigned_orders(spark, sf), COLS, "target"), *USE, "protocol")


TRAP = ["priority", "rowkey"]
TRAP_REFITS = f"""{ORDERS_SPLIT}, rk_rows AS (SELECT *, row_id::VARCHAR AS rowkey FROM orders_cat),
    {B.assigned('rk_rows')}, {B.refits(TRAP)}"""


@query(
    "own_label_gap",
    f"""{TRAP_REFITS}, {B.long('rk_rows', TRAP, 'row_id, y')},
    safe AS (SELECT 'foldsafe' AS protocol, u.outer_fold, u.phase, u.role, u.col, u.y, coalesce({TARGET}, {PRIOR}) AS c
      FROM ulng u JOIN fit f ON f.outer_fold = u.outer_fold AND f.phase = u.phase AND f.part = u.part
      LEFT JOIN states s ON s.outer_fold = u.outer_fold AND s.phase = u.phase AND s.part = u.part
           AND s.col = u.col AND s.level = u.level),
    gs AS (SELECT col, level, count(*) AS n, sum(y) AS pos FROM lng GROUP BY ALL),
    gf AS (SELECT count(*) AS fit_n, sum(y) AS fit_pos FROM orders_cat),
    everyone AS (SELECT 'global' AS protocol, u.outer_fold, u.phase, u.role, u.col, u.y,
      {TARGET} AS c FROM ulng u JOIN gs s ON s.col = u.col AND s.level = u.level, gf f)
    SELECT protocol, outer_fold, phase, role, (CASE col WHEN 'priority' THEN 0 ELSE 1 END)::INT AS position,
           round(avg(c) FILTER (y = 1) - avg(c) FILTER (y = 0), 9) AS gap
    FROM (SELECT * FROM safe UNION ALL SELECT * FROM everyone) GROUP BY ALL""",
)
def own_label_gap(spark, sf):
    rows, uses = orders_uses(spark, sf)
    assigned = splits.assign(rows.withColumn("rowkey", F.col("row_id").cast("string")), uses)
    safe_codes = fs.encode(assigned, TRAP, "target").withColumn("protocol", F.lit("foldsafe"))
    both = safe_codes.unionByName(fs.encode_global(assigned, TRAP, "target"))
    gap = fs.own_label_gap(both, ["protocol", *USE])
    return gap.withColumn("gap", F.round("gap", 9))


# ---- wide tables and streams -----------------------------------------------------------------

BITS_SPLIT = f"WITH {B.DOCS}, {B.splits('docs_cat')}, {B.assigned('docs_cat')}"


def assigned_bits(spark, sf):
    rows = rs.docs_bits(spark, sf)
    return materialize(splits.assign(rows, splits.fold_uses(rows)), "bits")


BITS = Wide("levels", rs.BITS)


@query(
    "foldsafe_target_wide",
    f"""{BITS_SPLIT},
    w AS (SELECT d.doc_id AS row_id, unnest(string_split_regex(text, '[ \\t\\n\\r]+')) AS word
          FROM documents d JOIN labels USING (doc_id)),
    hit AS (SELECT DISTINCT row_id, ({B.prefix48('word')} % {rs.BITS})::INT AS i FROM w),
    bits AS (SELECT u.*, i, (hit.i IS NOT NULL)::INT AS bit
             FROM (SELECT *, c::INT AS ci FROM asg, range(0, {rs.BITS}) t(c)) u LEFT JOIN hit ON hit.row_id = u.row_id AND hit.i = u.ci),
    part_n AS (SELECT outer_fold, phase, part, ci, bit, count(*) AS n, sum(y) AS pos FROM bits WHERE part >= 0 GROUP BY ALL),
    wanted AS (SELECT DISTINCT outer_fold, phase, part FROM uses WHERE part >= 0 UNION SELECT DISTINCT outer_fold, phase, -1 FROM uses),
    s AS (SELECT w.outer_fold, w.phase, w.part, ci, bit, sum(n) AS n, sum(pos) AS pos FROM wanted w JOIN part_n p
          ON p.outer_fold = w.outer_fold AND p.phase = w.phase AND p.part <> w.part GROUP BY ALL),
    f AS (SELECT outer_fold, phase, part, sum(n) AS fit_n, sum(pos) AS fit_pos FROM s WHERE ci = 0 GROUP BY ALL),
    c AS (SELECT b.row_id, b.outer_fold, b.phase, b.role, b.ci, coalesce({TARGET}, {PRIOR}) AS code
          FROM bits b JOIN f ON f.outer_fold = b.outer_fold AND f.phase = b.phase AND f.part = b.part
          LEFT JOIN s ON s.outer_fold = b.outer_fold AND s.phase = b.phase AND s.part = b.part AND s.ci = b.ci AND s.bit = b.bit)
    SELECT row_id, outer_fold, phase, role, count(*)::INT AS n_codes, round(sum(code), 6) AS code_sum,
           round(max(code), 6) AS code_max FROM c GROUP BY ALL""",
)
def foldsafe_target_wide(spark, sf):
    """1,024 binary columns per document in one array; each row's codes reduced to a checksum."""
    coded = fs.encode(assigned_bits(spark, sf), BITS, "target")
    total = F.aggregate("codes", F.lit(0.0), lambda a, v: a + v)
    return coded.select(
        "row_id", *USE, F.size("codes").alias("n_codes"), F.round(total, 6).alias("code_sum"),
        F.round(F.array_max("codes"), 6).alias("code_max"),
    )


COUNTS = Wide("levels", 2 * rs.BITS)
CHECK = 97  # codes enter a checksum as integers of a millionth, weighted by position


@query(
    "foldsafe_target_blocks",
    f"""{BITS_SPLIT},
    used AS MATERIALIZED (SELECT row_id, y, outer_fold * 2 + (phase = 'outer')::INT AS sid, role, part FROM asg),
    h AS (SELECT row_id, {B.prefix48('word')} AS h FROM (
      SELECT d.doc_id AS row_id, unnest(string_split_regex(text, '[ \\t\\n\\r]+')) AS word FROM documents d JOIN labels USING (doc_id))),
    hit AS (SELECT row_id, c, count(*) AS k FROM (
      SELECT row_id, (h % {rs.BITS})::INT AS c FROM h UNION ALL SELECT row_id, ((h >> 20) % {rs.BITS} + {rs.BITS})::INT FROM h)
      GROUP BY row_id, c),
    lv AS MATERIALIZED (
      SELECT r.row_id, i::INT AS c, coalesce(hit.k, 0)::INT AS level
      FROM docs_cat r, range(0, {2 * rs.BITS}) t(i) LEFT JOIN hit ON hit.row_id = r.row_id AND hit.c = i),
    part_n AS MATERIALIZED (
      SELECT sid, part, c, level, count(*) AS n, sum(y) AS pos FROM used JOIN lv USING (row_id) WHERE part >= 0 GROUP BY ALL),
    side_n AS MATERIALIZED (SELECT sid, c, level, sum(n) AS n, sum(pos) AS pos FROM part_n GROUP BY ALL),
    fit_part AS (SELECT sid, part, sum(n) AS n, sum(pos) AS pos FROM part_n WHERE c = 0 GROUP BY ALL),
    fit AS (
      SELECT sid, -1 AS part, sum(n) AS fit_n, sum(pos) AS fit_pos FROM fit_part GROUP BY sid
      UNION ALL SELECT sid, part, sum(n) OVER (PARTITION BY sid) - n, sum(pos) OVER (PARTITION BY sid) - pos FROM fit_part),
    x AS (
      SELECT u.row_id, u.sid, u.role, lv.c, f.fit_pos / f.fit_n AS prior,
        coalesce(s.n, 0) - coalesce(p.n, 0) AS n, coalesce(s.pos, 0) - coalesce(p.pos, 0) AS pos
      FROM used u JOIN fit f USING (sid, part) JOIN lv USING (row_id)
      LEFT JOIN side_n s ON s.sid = u.sid AND s.c = lv.c AND s.level = lv.level
      LEFT JOIN part_n p ON p.sid = u.sid AND p.part = u.part AND p.c = lv.c AND p.level = lv.level)
    SELECT row_id, {B.side_names('x')}, role, count(*)::INT AS n_codes,
      sum(round((CASE WHEN n > 0 THEN (pos + 20.0::DOUBLE * prior) / (n + 20.0::DOUBLE) ELSE prior END + {NUDGE}::DOUBLE) * 1000000)::BIGINT
        * (c % {CHECK} + 1))::BIGINT AS checksum
    FROM x GROUP BY row_id, sid, role""",
)
def foldsafe_target_blocks(spark, sf):
    """2,048 counted columns with more levels than one dictionary holds; all codes of a row enter its checksum."""
    rows = materialize(rs.docs_counts(spark, sf), "counts")
    assigned = materialize(splits.assign(rows, splits.fold_uses(rows)), "counts")
    coded = fs.encode(assigned, COUNTS, "target")
    # codes are not negative: as F.round, which goes by decimal texts, at a few times its speed
    whole = F.transform("codes", lambda c, i: F.floor((c + NUDGE) * 1000000 + 0.5) * (i % CHECK + 1))
    total = F.aggregate(whole, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return coded.select("row_id", *USE, F.size("codes").alias("n_codes"), total.alias("checksum"))


query("foldsafe_hash_column_wide", wide_hash_sql(True))(wide_hash(True))
query("foldsafe_hash_shared_wide", wide_hash_sql(False))(wide_hash(False))


@query("placement_wide")
def placement_wide(spark, sf):
    """Placement of 1,024 codes on the training side of fold 0 (iterative: no SQL form)."""
    coded = fs.encode(assigned_bits(spark, sf), BITS, "target")
    side = coded.where("outer_fold = 0 AND role = 'train'").select(F.lit("f0").alias("state"), "codes")
    out = ly.fit_placement(materialize(side, "side"), ["state"])
    return out.select("state", "seed", F.round("error", 3).alias("error"), F.round("start_error", 3).alias("start_error"), "perm")


HELD_BACK = 5  # every fifth user is unknown to the state
STREAM_SQL = f"""WITH {B.EVENTS}, {B.long('events_cat', rs.EVENTS_COLUMNS, 'row_id, y, "user" AS who')},
    s AS (SELECT col, level, count(*) AS n, sum(y) AS pos FROM lng WHERE who::BIGINT % {HELD_BACK} <> 0 GROUP BY ALL),
    f AS (SELECT count(*) AS fit_n, sum(y) AS fit_pos FROM events_cat WHERE "user"::BIGINT % {HELD_BACK} <> 0)
    SELECT l.row_id, 1 AS version, (CASE l.col WHEN 'user' THEN 0 ELSE 1 END)::INT AS position, {rounded_sql(f'coalesce({TARGET}, {PRIOR})')} AS code
    FROM lng l LEFT JOIN s ON s.col = l.col AND s.level = l.level, f"""


@query("stream_apply", STREAM_SQL)
def stream_apply(spark, sf):
    """Events read as a stream and coded by a state fitted in batch on other users; the users held back get its prior."""
    events = rs.table(spark, sf, "events")
    fit = rs.event_rows(events).where(F.col("user").cast("bigint") % HELD_BACK != 0)
    states = cb.whole_states(fit, rs.EVENTS_COLUMNS)
    unseen = states.groupBy("col").agg((F.max("fit_pos") / F.max("fit_n")).alias("code"))
    folder = f"{scratch_dir(spark)}/foldspark/stream-{uuid.uuid4().hex}"
    state = live.VersionedState(spark, f"{folder}/state")
    state.publish(enc.target_codes(states), unseen)
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    run = live.encode_versions(rs.event_rows(stream), state, rs.EVENTS_COLUMNS, f"{folder}/coded", f"{folder}/progress", ["row_id"])
    run.awaitTermination()
    coded = spark.read.schema("row_id BIGINT, codes ARRAY<DOUBLE>, version INT").parquet(f"{folder}/coded")
    return flat(coded, "version")


# ---- lineage ---------------------------------------------------------------------------------

ARTIFACTS = [
    {"name": "target", "kind": "encoder", "supervised": True, "config": '{"alpha":20.0}'},
    {"name": "count", "kind": "encoder", "supervised": False, "config": "{}"},
    {"name": "minmax", "kind": "scaler", "supervised": False, "config": "{}"},
]


@query(
    "lineage_records",
    f"""{ASG},
    wanted AS (SELECT DISTINCT outer_fold, phase, part FROM uses WHERE part >= 0
               UNION SELECT DISTINCT outer_fold, phase, -1 FROM uses),
    st AS (SELECT w.outer_fold, w.phase, w.phase || '_' || CASE WHEN w.part < 0 THEN 'map' ELSE 'oof' || w.part END AS fit_role,
             w.part,
             count(*) FILTER (a.part >= 0 AND a.part <> w.part) AS fit_n,
             sum({B.prefix48('a.row_id::VARCHAR')}) FILTER (a.part >= 0 AND a.part <> w.part) AS fit_h,
             count(*) FILTER (a.part = w.part) AS transform_n,
             sum({B.prefix48('a.row_id::VARCHAR')}) FILTER (a.part = w.part) AS transform_h
           FROM wanted w JOIN asg a ON a.outer_fold = w.outer_fold AND a.phase = w.phase GROUP BY ALL),
    art(name, kind, sup, config) AS (VALUES ('target', 'encoder', true, '{{"alpha":20.0}}'),
        ('count', 'encoder', false, '{{}}'), ('minmax', 'scaler', false, '{{}}'))
    SELECT kind || '|' || name || '|f' || outer_fold || '|' || fit_role AS artifact_id, kind || ':' || name AS artifact_type,
           outer_fold, fit_role, sha256(config) AS config_hash, fit_n::BIGINT AS fit_n, fit_h::VARCHAR AS fit_ids_hash,
           (CASE WHEN sup THEN fit_n ELSE 0 END)::BIGINT AS label_n,
           CASE WHEN sup THEN fit_h::VARCHAR ELSE '0' END AS label_ids_hash,
           transform_n::BIGINT AS transform_n, transform_h::VARCHAR AS transform_ids_hash
    FROM st, art WHERE sup OR part < 0""",
)
def lineage_records(spark, sf):
    return lin.records(assigned_orders(spark, sf), ARTIFACTS)


@query(
    "idset_hash",
    f"WITH {B.ORDERS} SELECT group_id, {B.set_hash('row_id')} FROM orders_cat GROUP BY ALL",
)
def idset_hash(spark, sf):
    return lin.idset_hash(rs.orders_cat(spark, sf), ["group_id"])


@query(
    "leakage_audit",
    f"""{ASG}, fb AS (SELECT outer_fold, row_id FROM asg WHERE role = 'test'),
    ft AS (SELECT DISTINCT 'foldsafe' AS protocol, outer_fold, row_id FROM asg WHERE part >= 0
           UNION SELECT DISTINCT 'global', outer_fold, row_id FROM asg)
    SELECT protocol, outer_fold, count(*)::BIGINT AS n_fit,
           count(fb.row_id)::BIGINT AS n_overlap FROM ft LEFT JOIN fb USING (outer_fold, row_id) GROUP BY ALL""",
)
def leakage_audit(spark, sf):
    each = assigned_orders(spark, sf).select("row_id", F.explode("uses").alias("u")).select("row_id", "u.*")
    forbidden = each.where("role = 'test'")
    on = ["outer_fold", "row_id"]
    arms = {"foldsafe": each.where("part >= 0"), "global": each}
    found = [lin.overlaps(fit, forbidden, on, ["outer_fold"]).withColumn("protocol", F.lit(p)) for p, fit in arms.items()]
    return fs.union_all(found)


def _relabel(assigned, condition):
    return assigned.withColumn("y", F.when(condition, 1 - F.col("y")).otherwise(F.col("y")))


def _audit(spark, sf, name, flip, watch):
    """Encode twice, once with flipped labels; count watched rows whose codes moved."""
    assigned = materialize(assigned_orders(spark, sf), "assigned")
    kept = ["row_id", "outer_fold", "phase", "role", "codes"]
    a = fs.encode(assigned, COLS, name).where("outer_fold = 0").select(*kept)
    b = fs.encode(_relabel(assigned, flip), COLS, name).where("outer_fold = 0").select(*kept)
    own = assigned.select("row_id", F.explode(F.filter("uses", watch)).alias("u")).select(
        "row_id", "u.outer_fold", "u.phase"
    )
    watched = [x.join(own, ["row_id", "outer_fold", "phase"], "left_semi") for x in (a, b)]
    moved = lin.differences(*watched).groupBy().agg(F.count("*").alias("n_diff"))
    size = watched[0].groupBy().agg(F.count("*").alias("n")).scalar()
    return moved.select(F.lit(name).alias("encoder"), size.alias("n_watched"), "n_diff")


@query(
    "audit_label_permutation",
    f"""{ASG} SELECT 'target' AS encoder, count(*)::BIGINT AS n_watched, 0::BIGINT AS n_diff
    FROM asg WHERE outer_fold = 0""",
)
def audit_label_permutation(spark, sf):
    """Labels of the test rows of a fold cannot move any code of that fold."""
    test = F.exists("uses", lambda u: (u["outer_fold"] == 0) & (u["role"] == "test"))
    return _audit(spark, sf, "target", test, lambda u: u["outer_fold"] == 0)


@query(
    "audit_own_part",
    f"""{ASG} SELECT 'woe' AS encoder, count(*)::BIGINT AS n_watched, 0::BIGINT AS n_diff
    FROM asg WHERE outer_fold = 0 AND phase = 'outer' AND part = 0""",
)
def audit_own_part(spark, sf):
    """Labels of an out-of-fold part cannot move the codes of that part."""
    def own(u):
        return (u["outer_fold"] == 0) & (u["phase"] == "outer") & (u["part"] == 0)

    return _audit(spark, sf, "woe", F.exists("uses", own), own)


@query(
    "audit_inner_validation",
    f"""{ASG} SELECT 'woe' AS encoder, count(*)::BIGINT AS n_watched, 0::BIGINT AS n_diff
    FROM asg WHERE outer_fold = 0 AND phase = 'inner'""",
)
def audit_inner_validation(spark, sf):
    """Labels of inner-validation rows cannot move any inner code."""
    val = F.exists("uses", lambda u: (u["outer_fold"] == 0) & (u["role"] == "inner_val"))
    return _audit(spark, sf, "woe", val, lambda u: (u["outer_fold"] == 0) & (u["phase"] == "inner"))


@query("determinism_audit", "SELECT 0::BIGINT AS n_diff")
def determinism_audit(spark, sf):
    """Two independent builds of split and codes agree on every row."""
    a = fs.encode(assigned_orders(spark, sf), COLS, "target")
    b = fs.encode(assigned_orders(spark, sf), COLS, "target")
    return lin.differences(a.drop("y"), b.drop("y")).groupBy().agg(F.count("*").alias("n_diff"))
