"""Shared DuckDB building blocks of the oracle queries (independent of the Spark code paths)."""

from __future__ import annotations

ORDERS_COLUMNS = ["priority", "segment", "nation", "oyear"]

ORDERS = """orders_cat AS (
  SELECT o_orderkey AS row_id, o_custkey::VARCHAR AS group_id,
         (o_orderstatus = 'F')::INT AS y, o_orderpriority AS priority,
         c_mktsegment AS segment, c_nationkey::VARCHAR AS nation,
         year(o_orderdate)::VARCHAR AS oyear
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

EVENTS = """events_cat AS (
  SELECT event_id AS row_id, user_id::VARCHAR AS group_id,
         (event_type = 'purchase')::INT AS y, user_id::VARCHAR AS "user",
         hour(ts)::VARCHAR AS hour
  FROM events)"""

DOCS = """docs_cat AS (
  SELECT doc_id AS row_id, md5(text) AS group_id, (quality = 1)::INT AS y, lang, source,
         CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS size
  FROM labels JOIN documents USING (doc_id))"""

LINE = """line_cat AS (
  SELECT l_orderkey::VARCHAR AS group_id, (l_returnflag = 'R')::INT AS y,
         l_returnflag AS returnflag, l_linestatus AS linestatus, p_brand AS brand, p_type AS ptype
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

PREDS = """preds AS (
  SELECT 'run' || r AS run_id, r AS run, row_id, group_id, segment, y AS y_true,
         round((1.0::DOUBLE - r * 0.05::DOUBLE)
               * (('0x' || substr(md5(r || ':' || row_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)
               + r * 0.05::DOUBLE * y, 3) AS y_score
  FROM orders_cat, range(0, 8) t(r))"""


def prefix48(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 12))::BIGINT"


def set_hash(ident: str) -> str:
    return (
        f"count({ident})::BIGINT AS n_ids, "
        f"coalesce(sum({prefix48(f'{ident}::VARCHAR')}), 0)::VARCHAR AS ids_hash"
    )


def splits(rows: str, k: int = 5) -> str:
    """CTEs dealt, holdout and uses over a row set (group_id, y)."""
    return f"""grp AS (
  SELECT group_id, count(*)::BIGINT AS n, sum(y)::BIGINT AS pos FROM {rows} GROUP BY 1),
rk AS (
  SELECT *, row_number() OVER (ORDER BY n DESC, pos DESC, md5('42:' || group_id)) AS r,
         (SELECT count(*) FILTER (n * {k} > (SELECT sum(n) FROM grp)) FROM grp) AS w
  FROM grp),
dealt AS (
  SELECT group_id, n, pos,
         (CASE WHEN r <= w THEN r - 1
               WHEN ((r - w - 1) // ({k} - w)) % 2 = 0 THEN w + (r - w - 1) % ({k} - w)
               ELSE w + ({k} - w) - 1 - (r - w - 1) % ({k} - w) END)::INT AS test_fold
  FROM rk),
side AS (
  SELECT d.*, f::INT AS outer_fold,
         sum(n) OVER (PARTITION BY f) * 0.2::DOUBLE AS target,
         sum(pos) OVER (PARTITION BY f) AS side_pos
  FROM dealt d, range(0, {k}) t(f) WHERE f <> test_fold),
ranked_side AS (
  SELECT *, n <= target * 1.25::DOUBLE AS fits,
         row_number() OVER (PARTITION BY outer_fold, n <= target * 1.25::DOUBLE
                            ORDER BY n DESC, pos DESC, md5((421 + outer_fold) || ':' || group_id)) AS r
  FROM side),
strided AS (
  SELECT *, least(1.0::DOUBLE, target / sum(n) FILTER (fits) OVER (PARTITION BY outer_fold)) AS q,
         count(*) FILTER (fits) OVER (PARTITION BY outer_fold) AS fit_groups
  FROM ranked_side),
flagged AS (
  SELECT *, fits AND (floor(r * q) > floor((r - 1) * q)
                      OR (r = fit_groups AND floor(fit_groups * q) = 0)) AS is_val
  FROM strided),
valpos AS (
  SELECT *, coalesce(sum(pos) FILTER (is_val) OVER (PARTITION BY outer_fold), 0) AS val_pos,
         min((n, md5((421 + outer_fold) || ':' || group_id), group_id))
           FILTER (NOT is_val AND pos > 0 AND pos < side_pos) OVER (PARTITION BY outer_fold) AS spare
  FROM flagged),
holdout AS (
  SELECT group_id, outer_fold,
         is_val OR (val_pos = 0 AND spare IS NOT NULL AND spare[3] = group_id) AS is_val
  FROM valpos),
roles AS (
  SELECT group_id, outer_fold, 'inner' AS phase,
         CASE WHEN is_val THEN 'inner_val' ELSE 'inner_train' END AS role FROM holdout
  UNION ALL
  SELECT group_id, f::INT, 'outer', CASE WHEN f = test_fold THEN 'test' ELSE 'train' END
  FROM dealt, range(0, {k}) t(f)),
parts AS (
  SELECT group_id, outer_fold, phase,
         ((row_number() OVER (PARTITION BY outer_fold, phase ORDER BY
             md5((CASE WHEN phase = 'inner' THEN 4211 ELSE 4218 END) || ':' || group_id), group_id) - 1)
          % greatest(2, least(5, count(*) OVER (PARTITION BY outer_fold, phase))))::INT AS part
  FROM roles WHERE role IN ('inner_train', 'train')),
uses AS (
  SELECT group_id, outer_fold, phase, role, coalesce(part, -1) AS part, n, pos
  FROM roles LEFT JOIN parts USING (group_id, outer_fold, phase) JOIN grp USING (group_id))"""


def long(rows: str, columns: list[str], keep: str, name: str = "lng") -> str:
    """Long form CTE: keep…, col, level."""
    each = " UNION ALL ".join(
        f"SELECT {keep}, '{c}' AS col, \"{c}\" AS level FROM {rows}" for c in columns
    )
    return f"{name} AS ({each})"


def assigned(rows: str, name: str = "asg") -> str:
    return (
        f"{name} AS (SELECT r.*, u.outer_fold, u.phase, u.role, u.part "
        f"FROM {rows} r JOIN uses u USING (group_id))"
    )


def refits(columns: list[str], rows: str = "asg") -> str:
    """Every state by direct refit: the rows of a training side outside the excluded part."""
    return (
        long(rows, columns, "row_id, y, outer_fold, phase, role, part", "ulng")
        + """,
wanted AS (
  SELECT DISTINCT outer_fold, phase, part FROM uses WHERE part >= 0
  UNION SELECT DISTINCT outer_fold, phase, -1 FROM uses),
states AS (
  SELECT w.outer_fold, w.phase, w.part, col, level, count(*)::BIGINT AS n, sum(y)::BIGINT AS pos
  FROM wanted w JOIN ulng u ON u.outer_fold = w.outer_fold AND u.phase = w.phase
       AND u.part >= 0 AND u.part <> w.part
  GROUP BY ALL),
fit AS (
  SELECT outer_fold, phase, part, sum(n)::BIGINT AS fit_n, sum(pos)::BIGINT AS fit_pos
  FROM states WHERE col = '%s' GROUP BY ALL)"""
        % columns[0]
    )


def sided(columns: list[str], rows: str) -> str:
    """Whole-side states with small integer keys: ``sid`` = 2 * fold + (1 if outer), ``ci`` = position of the column.

    Every step is written once, so that each later join is one equality on integers and the level.
    """
    each = " UNION ALL ".join(
        f'SELECT row_id, y, sid, role, part, {i} AS ci, "{c}" AS level FROM su' for i, c in enumerate(columns)
    )
    return f"""su AS MATERIALIZED (
  SELECT r.*, u.outer_fold * 2 + (u.phase = 'outer')::INT AS sid, u.role, u.part FROM {rows} r JOIN uses u USING (group_id)),
slv AS MATERIALIZED ({each}),
side_lv AS MATERIALIZED (
  SELECT sid, ci, level, count(*)::BIGINT AS n, sum(y)::BIGINT AS pos FROM slv WHERE part >= 0 GROUP BY sid, ci, level),
side_fit AS MATERIALIZED (SELECT sid, sum(n)::BIGINT AS fit_n, sum(pos)::BIGINT AS fit_pos FROM side_lv WHERE ci = 0 GROUP BY sid)"""


def side_names(alias: str) -> str:
    return f"({alias}.sid // 2)::INT AS outer_fold, CASE {alias}.sid % 2 WHEN 1 THEN 'outer' ELSE 'inner' END AS phase"


def blocked(rows: str, n_columns: int) -> str:
    """Block of every row for the permutations of the ordered statistic."""
    return f"""blk AS MATERIALIZED (
  SELECT row_id, ({prefix48("'977:' || row_id")}
    % (SELECT greatest(64, ceil(count(*) * {n_columns} / 1000000.0)) FROM {rows})::BIGINT)::INT AS block FROM {rows}),
turn AS MATERIALIZED (
  SELECT row_id, p::INT AS p, row_number() OVER (PARTITION BY p ORDER BY md5((977 + p) || ':b' || block), block,
    md5((977 + p) || ':' || row_id), row_id) AS nth FROM blk, range(0, 4) t(p))"""
