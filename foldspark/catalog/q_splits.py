"""Sources, related-row groups and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.catalog import blocks as B
from foldspark.catalog.registry import query
from foldspark.operators import groups, splits
from foldspark.session import materialize
from foldspark.sources import categories as cat
from foldspark.sources import rowsets as rs

COLS = rs.ORDERS_COLUMNS
ORDERS_SPLIT = f"WITH RECURSIVE {B.ORDERS},\n{B.splits('orders_cat')}"
KEY = " || '|' || ".join(f"length({c}) || ':' || {c}" for c in COLS)


def orders_uses(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = rs.orders_cat(spark, sf)
    return rows, splits.fold_uses(rows)


@query("src_orders_cat", f"WITH {B.ORDERS} SELECT * FROM orders_cat")
def src_orders_cat(spark, sf):
    return rs.orders_cat(spark, sf)


@query(
    "norm_categories",
    """SELECT doc_id AS row_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
              coalesce(quality::VARCHAR, '?') AS quality, coalesce(toxic::VARCHAR, '?') AS toxic
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def norm_categories(spark, sf):
    d = rs.table(spark, sf, "documents").join(rs.table(spark, sf, "labels"), "doc_id", "left")
    names = ["lang", "source", "quality", "toxic"]
    return cat.normalize(d, names).select(F.col("doc_id").alias("row_id"), *names)


@query(
    "define_target",
    "SELECT event_id AS row_id, (event_type = 'purchase')::INT AS y FROM events",
)
def define_target(spark, sf):
    e = rs.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("row_id"), cat.define_target(F.col("event_type"), "purchase").alias("y"))


@query(
    "profile_table",
    f"""WITH {B.LINE}, {B.long('line_cat', rs.LINE_COLUMNS, 'y')},
    per AS (SELECT col, level, count(*) AS n FROM lng GROUP BY ALL)
    SELECT col, sum(n)::BIGINT AS n_rows, count(*)::BIGINT AS n_levels, max(n)::BIGINT AS top_count,
           (SELECT string_agg(DISTINCT y::VARCHAR, ',' ORDER BY y::VARCHAR) FROM line_cat) AS target_levels,
           4::BIGINT AS n_columns
    FROM per GROUP BY col""",
)
def profile_table(spark, sf):
    return cat.profile(rs.line_cat(spark, sf), rs.LINE_COLUMNS, "y")


@query(
    "table_fingerprint",
    f"""WITH {B.ORDERS} SELECT count(*)::BIGINT AS n_rows,
        sum({B.prefix48(KEY)})::VARCHAR AS content_hash FROM orders_cat""",
)
def table_fingerprint(spark, sf):
    return cat.fingerprint(rs.orders_cat(spark, sf), COLS)


@query(
    "dup_groups",
    f"WITH {B.ORDERS} SELECT row_id, (dense_rank() OVER (ORDER BY {KEY}) - 1)::BIGINT AS dup_id FROM orders_cat",
)
def dup_groups(spark, sf):
    return groups.duplicate_groups(rs.orders_cat(spark, sf), COLS, ["row_id"]).select("row_id", "dup_id")


@query(
    "union_groups",
    f"""WITH RECURSIVE {B.ORDERS},
    ties AS (SELECT DISTINCT 'c' || group_id AS a, 'd' || priority || '/' || nation AS b FROM orders_cat),
    edges AS (SELECT a AS u, b AS v FROM ties UNION ALL SELECT b, a FROM ties),
    reach AS (SELECT DISTINCT u AS node, u AS hit FROM edges
              UNION SELECT r.node, e.v FROM reach r JOIN edges e ON e.u = r.hit),
    comp AS (SELECT node, min(hit) AS root FROM reach GROUP BY node),
    firsts AS (SELECT row_id, min(row_id) OVER (PARTITION BY root) AS first
               FROM orders_cat JOIN comp ON node = 'c' || group_id)
    SELECT row_id, (dense_rank() OVER (ORDER BY first) - 1)::BIGINT AS component_id FROM firsts""",
)
def union_groups(spark, sf):
    rows = rs.orders_cat(spark, sf)
    same = {"customer": F.col("group_id"), "tuple": cat.length_prefixed(["priority", "nation"])}
    return groups.connected_groups(rows, same, "row_id").select("row_id", "component_id")


@query(
    "label_conflicts",
    f"""WITH {B.ORDERS}, g AS (SELECT {KEY} AS k, count(*) AS n, min(y) AS lo, max(y) AS hi
                              FROM orders_cat GROUP BY 1)
    SELECT count(*)::BIGINT AS n_groups, count(*) FILTER (lo < hi)::BIGINT AS n_conflicts,
           coalesce(sum(n) FILTER (lo < hi), 0)::BIGINT AS n_conflict_rows FROM g""",
)
def label_conflicts(spark, sf):
    return groups.label_conflicts(rs.orders_cat(spark, sf), groups.duplicate_key(COLS))


@query(
    "group_overlap",
    f"""{ORDERS_SPLIT},
    sides AS (SELECT DISTINCT outer_fold, phase, group_id, role IN ('inner_val', 'test') AS held FROM uses),
    per AS (SELECT outer_fold, phase, group_id, count(*) AS c FROM sides GROUP BY ALL)
    SELECT outer_fold, phase, count(*)::BIGINT AS n_groups, count(*) FILTER (c > 1)::BIGINT AS n_overlap
    FROM per GROUP BY ALL""",
)
def group_overlap(spark, sf):
    return groups.group_overlap(orders_uses(spark, sf)[1])


@query(
    "key_groups",
    """WITH keyed AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS k0 FROM pages),
    k AS (SELECT page_id, CASE WHEN k0 IS NULL THEN '__INVALID__' WHEN k0 = '' THEN '__EMPTY__' ELSE k0 END AS key_text
          FROM keyed),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY key_text) AS first FROM k)
    SELECT page_id AS row_id, key_text, (dense_rank() OVER (ORDER BY first) - 1)::BIGINT AS key_group FROM f""",
)
def key_groups(spark, sf):
    pages = rs.table(spark, sf, "pages").select(F.col("page_id").alias("row_id"), "url")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return groups.key_groups(pages, host, "row_id").select("row_id", "key_text", "key_group")


@query("outer_folds", f"{ORDERS_SPLIT} SELECT group_id, n, pos, test_fold FROM dealt")
def outer_folds(spark, sf):
    return splits.outer_folds(splits.group_table(rs.orders_cat(spark, sf)))


@query("inner_split", f"{ORDERS_SPLIT} SELECT group_id, outer_fold, is_val FROM holdout")
def inner_split(spark, sf):
    dealt = splits.outer_folds(splits.group_table(rs.orders_cat(spark, sf)))
    return splits.inner_holdout(materialize(dealt, "dealt")).drop("n")


@query("oof_folds", f"{ORDERS_SPLIT} SELECT group_id, outer_fold, phase, role, part, n FROM uses")
def oof_folds(spark, sf):
    return orders_uses(spark, sf)[1].select("group_id", "outer_fold", "phase", "role", "part", "n")


@query(
    "fold_fingerprint",
    f"""{ORDERS_SPLIT}, {B.assigned('orders_cat')}
    SELECT outer_fold, phase, role, {B.set_hash('row_id')} FROM asg GROUP BY ALL""",
)
def fold_fingerprint(spark, sf):
    rows, uses = orders_uses(spark, sf)
    return splits.fold_fingerprint(splits.assign(rows, uses))


def _report_sql() -> str:
    parts = []
    for role in ("train", "inner_train", "inner_val", "test"):
        parts.append(f"sum(n) FILTER (role = '{role}')::BIGINT AS n_{role}")
        parts.append(
            f"(sum(n - pos) FILTER (role = '{role}'))::BIGINT || '|' || "
            f"(sum(pos) FILTER (role = '{role}'))::BIGINT AS {role}_class_counts"
        )
    return ", ".join(parts)


@query(
    "split_report",
    f"""{ORDERS_SPLIT},
    ov AS (SELECT outer_fold, phase, group_id, count(DISTINCT role IN ('inner_val', 'test')) AS c
           FROM uses GROUP BY ALL),
    o2 AS (SELECT outer_fold, count(*) FILTER (phase = 'outer' AND c > 1)::BIGINT AS train_test_group_overlap,
                  count(*) FILTER (phase = 'inner' AND c > 1)::BIGINT AS inner_group_overlap FROM ov GROUP BY 1)
    SELECT outer_fold, {_report_sql()}, count(*) FILTER (phase = 'outer')::BIGINT AS n_groups,
           any_value(train_test_group_overlap) AS train_test_group_overlap,
           any_value(inner_group_overlap) AS inner_group_overlap,
           count(*) FILTER (phase = 'outer' AND pos > 0 AND pos < n)::BIGINT AS label_conflicts
    FROM uses JOIN o2 USING (outer_fold) GROUP BY outer_fold""",
)
def split_report(spark, sf):
    dealt = materialize(splits.outer_folds(splits.group_table(rs.orders_cat(spark, sf))), "dealt")
    return splits.split_report(splits.uses_of(dealt), dealt)
