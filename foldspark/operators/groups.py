"""Related-row groups: exact duplicates, unions of constraints, conflicts, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.functions.hashing import length_prefixed
from foldspark.operators.scan import exact_rank
from foldspark.operators.skew import lookup
from foldspark.session import materialize, release


def duplicate_key(columns: list[str]) -> Column:
    """Label-free key of exact feature duplicates; md5 of it is a group id without a shuffle."""
    return length_prefixed(columns)


def duplicate_groups(rows: DataFrame, columns: list[str], spread: list[str]) -> DataFrame:
    """Dense 0-based id per distinct feature tuple, in the order of the keys."""
    keyed = rows.withColumn("_key", duplicate_key(columns))
    keys = keyed.groupBy("_key").agg(F.count("*").alias("n"))
    ids = exact_rank(keys, ["_key"], out="dup_id").withColumn("dup_id", F.col("dup_id") - 1)
    return lookup(keyed, materialize(ids, "dup"), ["_key"], spread).drop("_key")


def connected_groups(
    rows: DataFrame, constraints: dict[str, Column], row_id: str, max_rounds: int = 64
) -> DataFrame:
    """Connected components of rows that share a value under any constraint.

    Works on the graph of constraint values, not of rows: rows only contribute the
    distinct pairs of values they tie together. Each round hooks every node to its
    smallest neighbour, flattens the hooks by pointer jumping and contracts the graph,
    so the number of nodes at least halves. Returns ``rows`` with ``component_id``, the
    0-based rank of the component's smallest row id.
    """
    names = list(constraints)
    nodes = {
        # a missing value ties a row to no other: it is a node of its own
        n: F.md5(F.coalesce(F.concat(F.lit(f"{i}:"), c.cast("string")), F.concat(F.lit(f"null{i}:"), F.col(row_id).cast("string"))))
        for i, (n, c) in enumerate(constraints.items())
    }
    tied = rows.withColumns({f"_k{i}": nodes[n] for i, n in enumerate(names)})
    keys = [f"_k{i}" for i in range(len(names))]
    weighted = materialize(
        tied.groupBy(*keys).agg(F.count("*").alias("n"), F.min(row_id).alias("first_row")), "ties"
    )
    links = [F.struct(F.col(keys[0]).alias("u"), F.col(k).alias("v")) for k in keys[1:]]
    edges = weighted.select(F.explode(F.array(*links)).alias("e")).select("e.u", "e.v").distinct()
    root = weighted.select(F.explode(F.array(*keys)).alias("node")).distinct()
    root = materialize(root.withColumn("root", F.col("node")), "root")
    edges = materialize(edges, "edges")

    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        parent = _flatten(_hooks(edges))
        old_edges, old_root = edges, root
        edges = materialize(_contract(edges, parent), "edges")
        cluster = root.groupBy("root").agg(F.count("*").alias("n"))
        to = parent.select(F.col("node").alias("root"), F.col("parent").alias("_to"))
        moved = materialize(cluster.join(to, "root"), "moved")
        held = lookup(root, moved, ["root"], ["node"])
        root = materialize(held.select("node", F.coalesce("_to", "root").alias("root")), "root")
        release(old_edges, old_root, moved, parent)
    else:
        raise RuntimeError("connected_groups did not converge")

    sized = weighted.groupBy(F.col(keys[0]).alias("node")).agg(
        F.sum("n").alias("n"), F.min("first_row").alias("first_row")
    )
    labelled = materialize(sized.join(root, "node"), "labelled")
    ranked = exact_rank(labelled.groupBy("root").agg(F.min("first_row").alias("first")), ["first"], "component_id")
    final = labelled.join(ranked.select("root", F.col("component_id") - 1), "root").select(
        F.col("node").alias(keys[0]), "n", F.col("(component_id - 1)").alias("component_id")
    )
    return lookup(tied, materialize(final, "components"), [keys[0]], [row_id]).drop(*keys)


def _hooks(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.groupBy(F.col("u").alias("node")).agg(
        F.min("v").alias("least"), F.count("*").alias("degree")
    )
    return near.select("node", F.least("node", "least").alias("parent"), "degree")


def _flatten(parent: DataFrame) -> DataFrame:
    """Pointer jumping until every parent is a root; hook chains shrink by half each step."""
    parent = materialize(parent, "hooks")
    while True:
        # children per parent, so that a parent with very many children is salted
        fan = parent.groupBy(F.col("parent").alias("_p")).agg(F.count("*").alias("_fan"))
        up = parent.select(F.col("node").alias("_p"), F.col("parent").alias("_up"))
        grand = materialize(
            fan.join(up, "_p").select(F.col("_p").alias("parent"), "_up", "_fan"), "jump"
        )
        if grand.where("_up <> parent").isEmpty():
            release(grand)
            return parent
        jumped = lookup(parent, grand, ["parent"], ["node"], weight="_fan")
        old = parent
        parent = materialize(
            jumped.select("node", F.coalesce("_up", "parent").alias("parent"), "degree"), "hooks"
        )
        release(old, grand)


def _contract(edges: DataFrame, parent: DataFrame) -> DataFrame:
    for side, other in (("u", "v"), ("v", "u")):
        to = parent.select(F.col("node").alias(side), F.col("parent").alias("_to"), "degree")
        moved = lookup(edges, to, [side], [other], weight="degree")
        edges = moved.select(F.col("_to").alias(side), other)
    return edges.where("u <> v").distinct()


def key_groups(rows: DataFrame, key: Column, row_id: str) -> DataFrame:
    """Group by a derived key: a missing key and an empty key have reserved groups.

    Ids are 0-based in the order of first occurrence.
    """
    filled = F.when(key.isNull(), F.lit("__INVALID__")).when(key == "", F.lit("__EMPTY__")).otherwise(key)
    keyed = rows.withColumn("key_text", filled)
    first = keyed.groupBy("key_text").agg(F.min(row_id).alias("_first"), F.count("*").alias("n"))
    ids = exact_rank(first, ["_first"], "key_group")
    ids = ids.select("key_text", "n", (F.col("key_group") - 1).alias("key_group"))
    return lookup(keyed, materialize(ids, "keys"), ["key_text"], [row_id])


def label_conflicts(rows: DataFrame, group: Column, y: str = "y") -> DataFrame:
    """How many groups exist and how many carry both labels (reported, never deleted)."""
    seen = rows.groupBy(group.alias("g")).agg(
        F.count("*").alias("n"), F.min(y).alias("lo"), F.max(y).alias("hi")
    )
    conflict = F.col("lo") < F.col("hi")
    return seen.agg(
        F.count("*").alias("n_groups"),
        F.count_if(conflict).alias("n_conflicts"),
        F.coalesce(F.sum(F.when(conflict, F.col("n"))), F.lit(0)).alias("n_conflict_rows"),
    )


def group_overlap(uses: DataFrame) -> DataFrame:
    """Per fold and phase: groups standing on both sides (must be 0)."""
    held_out = F.col("role").isin("inner_val", "test")
    sides = uses.groupBy("outer_fold", "phase", "group_id").agg(
        F.min(held_out).alias("lo"), F.max(held_out).alias("hi")
    )
    return sides.groupBy("outer_fold", "phase").agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("lo") != F.col("hi")).alias("n_overlap")
    )
