"""Connected classes of rows that share blocks, without comparing all pairs of a block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.tables import bounded, settle
from foldspark.session import release


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b); the root is the smallest node of its component.

    Every round hooks nodes to their smallest neighbour, flattens the hooks by pointer jumping and
    contracts the graph, which at least halves the nodes that still have edges.
    """
    edges = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        parent = _flatten(settle(hooks.select("node", F.least("node", "root").alias("root")), "hooks"))
        rounds.append(parent)
        side = bounded(parent)
        moved = edges
        for c, other in (("a", "b"), ("b", "a")):
            to = side.select(F.col("node").alias(c), F.col("root").alias("_to"))
            moved = moved.join(to, c).select(F.col("_to").alias(c), other)
        edges = settle(moved.where("a <> b").distinct(), "edges", edges)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    result = rounds[0]
    for later in rounds[1:]:
        to = bounded(later).select(F.col("node").alias("root"), F.col("root").alias("_to"))
        result = result.join(to, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return settle(result, "components")


def _flatten(parent: DataFrame) -> DataFrame:
    while True:
        # only roots that point further matter for the next jump
        up = parent.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("_up"))
        up = settle(up.join(parent.select("root").distinct(), "root", "left_semi"), "jump")
        if up.isEmpty():
            return parent
        jumped = parent.join(bounded(up), "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
        parent = settle(jumped, "hooks", parent)


def shared_blocks(members: DataFrame) -> DataFrame:
    """(id, blocks, weight) for the ids of ``members`` (block, id; each pair once) that have blocks in common with other
    ids: these blocks, and in how large ones the id is altogether. The centre of a group of copies shares most blocks
    with most of them. One row an id keeps its blocks small on disk and in the joins of ``link``."""
    sizes = members.groupBy("block").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size"))
    shared = settle(sizes.where("low < high").select("block", "size"), "shared")
    live = members.join(bounded(shared), "block").groupBy("id")
    return settle(live.agg(F.collect_set("block").alias("blocks"), F.sum("size").alias("weight")), "live", shared)


def link(
    live: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    facts: DataFrame,
    possible: Callable[[str, str], Column],
    pivots: int = 2,
    rest: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Components (node, root) of the ids in ``live`` (see ``shared_blocks``; deleted) under verified links.

    ``verify`` keeps the pairs (a, b) that are similar. ``facts`` holds a row for each id in ``live``, and
    ``possible(prefix, prefix)`` says from their columns whether two ids can be similar at all. Each pivot round
    compares one member of a block with those not yet connected to it, the most central one first, so a block of
    many copies closes after a few linear rounds. What is left are blocks whose members stayed in different
    components. From their members (id, label), ``rest`` makes the pairs (a, b) of different labels to look at, at
    least all similar ones; by default these are all possible pairs inside each block. So no link between ids that
    share a block is lost.
    """
    found, classes = None, None
    labels = live.withColumn("label", F.col("id"))
    for step in range(pivots + 1):
        each = labels.select(F.explode("blocks").alias("block"), "id", "weight", "label")
        ends = each.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high"), _pivot(step).alias("p"))
        still = settle(ends.where("low < high").select("block", "p.*"), "open")
        if still.isEmpty():
            break
        if step < pivots:
            pairs = each.join(bounded(still), "block").where("label <> pivot_label").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
            made = _in_order(pairs)
        elif rest is not None:
            left = each.join(bounded(still.select("block")), "block", "left_semi").select("id", "label").distinct()
            left = settle(left, "open-members", labels, still)
            made = _in_order(rest(left))
        else:
            members = each.join(bounded(still.select("block")), "block").select("block", "id", "label")
            members = settle(members.join(facts, "id"), "open-members", labels)
            one, two = (members.select(*[F.col(c).alias(f"{side}_{c}") for c in members.columns]) for side in "xy")
            apart = (F.col("x_block") == F.col("y_block")) & (F.col("x_label") < F.col("y_label")) & possible("x_", "y_")
            made = _in_order(one.join(two, apart).select(F.col("x_id").alias("a"), F.col("y_id").alias("b")))
            release(members)
        release(still)
        one, two = (facts.select(*[F.col(c).alias(f"{side}_{c}") for c in facts.columns]) for side in "xy")
        ordered = made.join(one, F.col("a") == F.col("x_id")).join(two, F.col("b") == F.col("y_id"))
        ordered = settle(ordered.where(possible("x_", "y_")).select("a", "b"), "possible", made)
        similar = settle(verify(ordered).select("a", "b"), "similar", ordered)
        if similar.isEmpty():
            continue
        found = similar if found is None else settle(found.unionByName(similar), "links", found, similar)
        classes = components(found)
        if step == pivots:
            break
        to = bounded(classes).select(F.col("node").alias("id"), F.col("root").alias("_to"))
        moved = labels.drop("label").join(to, "id", "left").withColumn("label", F.coalesce("_to", "id")).drop("_to")
        labels = settle(moved, "labels", labels)
    if classes is None:
        return facts.select(F.col("id").alias("node"), F.col("id").alias("root")).where("node is null")
    return classes


def _in_order(pairs: DataFrame) -> DataFrame:
    return settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def _pivot(step: int) -> Column:
    """The most central member first, the same for many blocks; later ones by a hash."""
    order = F.struct(F.col("weight"), F.col("id")) if step == 0 else F.struct(F.xxhash64("id", F.lit(step)), F.col("id"))
    return F.max_by(F.struct(F.col("id").alias("pivot"), F.col("label").alias("pivot_label")), order)
