"""Groups and folds: contracts of the split and its typed errors."""

import random
from collections import Counter, defaultdict

import pytest
from toy import TOY_ROWS
from pyspark.sql import functions as F

from foldspark.operators import groups, scan, splits
from foldspark.session import materialize


def dup_ids(spark, rows, columns):
    df = spark.createDataFrame(rows, ["row_id", *columns])
    return {r.row_id: r.dup_id for r in groups.duplicate_groups(df, columns, ["row_id"]).collect()}


def test_separators_cannot_collide(spark):
    ids = dup_ids(spark, [(0, "x|1", "y"), (1, "x", "1|y"), (2, "x", "1|y")], ["a", "b"])
    assert ids[0] != ids[1] and ids[1] == ids[2]


def component_sets(df):
    sets = defaultdict(set)
    for r in df.collect():
        sets[r.component_id].add(r.row_id)
    return sorted(map(sorted, sets.values())), {min(s): c for c, s in sets.items()}


def test_union_of_constraints(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 2, 2), (4, 3, 3)], "row_id INT, g1 INT, g2 INT")
    out = groups.connected_groups(df, {"g1": F.col("g1"), "g2": F.col("g2")}, "row_id")
    sets, firsts = component_sets(out)
    assert sets == [[0, 1, 2], [3], [4]] and firsts == {0: 0, 3: 1, 4: 2}


def test_union_of_a_long_chain_and_a_hot_value(spark):
    n = 200
    chain = [(i, f"l{i}", f"l{i + 1}") for i in range(n)]
    hot = [(n + i, "hot", f"h{i}") for i in range(100)]
    df = spark.createDataFrame(chain + hot, "row_id INT, u STRING, v STRING")
    # a chain shares values between its columns, so both constraints use the same node space
    ids = {"u": F.col("u"), "v": F.col("v")}
    linked = df.select("row_id", "u", "v").union(df.where("u <> 'hot'").select(F.col("row_id") + 1000, "v", "v"))
    sets, _ = component_sets(groups.connected_groups(linked, ids, "row_id"))
    assert [len(s) for s in sets if 0 in s] == [2 * n]
    assert [len(s) for s in sets if n in s] == [100]


def test_key_groups_reserve_missing_and_empty(spark):
    df = spark.createDataFrame([(0, None), (1, "k"), (2, ""), (3, "k"), (4, None)], "row_id INT, k STRING")
    out = {r.row_id: (r.key_text, r.key_group) for r in groups.key_groups(df, F.col("k"), "row_id").collect()}
    assert out == {0: ("__INVALID__", 0), 1: ("k", 1), 2: ("__EMPTY__", 2), 3: ("k", 1), 4: ("__INVALID__", 0)}


def test_conflicts_are_counted_not_removed(spark):
    df = spark.createDataFrame([("g", 0), ("g", 1), ("h", 1)], "g STRING, y INT")
    assert tuple(groups.label_conflicts(df, F.col("g")).first()) == (2, 1, 2)


def make_rows(spark, sizes, share=0.3, seed=3):
    rng = random.Random(seed)
    rows, i = [], 0
    for g, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i, f"g{g}", int(rng.random() < share)))
            i += 1
    return spark.createDataFrame(rows, "row_id INT, group_id STRING, y INT")


def check_contract(rows, uses, k=5):
    members = Counter(r.group_id for r in rows.collect())
    test = defaultdict(set)
    for r in uses.collect():
        if r.role == "test":
            test[r.group_id].add(r.outer_fold)
    assert set(test) == set(members) and all(len(f) == 1 for f in test.values())
    assert groups.group_overlap(uses).agg(F.sum("n_overlap")).first()[0] == 0
    sizes = Counter()
    for g, f in test.items():
        sizes[next(iter(f))] += members[g]
    assert len(sizes) == k
    return sizes


@pytest.mark.parametrize("small_sort", [200_000, 0])
def test_folds_are_disjoint_and_balanced(spark, monkeypatch, small_sort):
    monkeypatch.setattr(scan, "SINGLE_TASK_ROWS", small_sort)
    rng = random.Random(1)
    rows = make_rows(spark, [rng.randint(1, 9) for _ in range(150)])
    uses = splits.fold_uses(rows)
    sizes = check_contract(rows, uses)
    assert max(sizes.values()) - min(sizes.values()) <= 12
    val = {r.outer_fold: r.s for r in uses.where("role = 'inner_val'").groupBy("outer_fold").agg(F.sum("n").alias("s")).collect()}
    total = sum(sizes.values())
    for f in range(5):
        side = total - sizes[f]
        assert 0.12 * side <= val[f] <= 0.25 * side


def test_a_hot_group_gets_a_fold_for_itself(spark):
    rows = make_rows(spark, [300] + [2] * 100)
    uses = splits.fold_uses(rows)
    sizes = check_contract(rows, uses)
    assert sorted(sizes.values()) == [50, 50, 50, 50, 300]
    # it is never validation: it would overshoot the wanted share
    assert uses.where("group_id = 'g0' AND role = 'inner_val'").count() == 0


def test_impossible_splits_are_typed_errors(spark):
    with pytest.raises(splits.SplitError):
        splits.fold_uses(make_rows(spark, [5, 5, 5]))
    # one giant group and four single rows: no training side can hold out a fifth
    with pytest.raises(splits.SplitError):
        splits.fold_uses(make_rows(spark, [10, 10], seed=1), splits.SplitPlan(k=2))


def test_validation_without_positives_gets_the_smallest_positive_group(spark):
    rows = [(i, f"g{i // 4}", int(i // 4 in (0, 1, 2, 3, 4, 5, 6))) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id INT, group_id STRING, y INT")
    uses = splits.fold_uses(df)
    pos = {f"g{g}" for g in range(7)}
    held = uses.where("role = 'inner_val'").collect()
    for f in range(5):
        assert pos & {r.group_id for r in held if r.outer_fold == f}


def test_oof_parts_ignore_labels(spark, toy):
    dealt = materialize(splits.outer_folds(splits.group_table(toy)), "dealt")
    flipped = dealt.withColumn("pos", F.col("n") - F.col("pos"))
    a, b = (splits.uses_of(d).where("phase = 'outer' AND part >= 0").drop("n") for d in (dealt, flipped))
    assert a.exceptAll(b).isEmpty()
    parts = a.groupBy("outer_fold", "part").count().collect()
    assert len(parts) == 25
    by_fold = defaultdict(list)
    for r in parts:
        by_fold[r.outer_fold].append(r["count"])
    assert all(max(c) - min(c) <= 1 for c in by_fold.values())


def test_split_report(spark, toy):
    dealt = materialize(splits.outer_folds(splits.group_table(toy)), "dealt")
    for r in splits.split_report(splits.uses_of(dealt), dealt).collect():
        assert r.n_train + r.n_test == TOY_ROWS and r.n_inner_train + r.n_inner_val == r.n_train
        assert r.train_test_group_overlap == 0 and r.inner_group_overlap == 0


def test_a_missing_constraint_ties_nothing(spark):
    rows = [(1, None, "x"), (2, None, "y"), (3, "a", "x"), (4, "a", "z"), (5, None, "z"), (6, "b", None), (7, "c", None)]
    df = spark.createDataFrame(rows, "row_id int, g string, h string")
    out = groups.connected_groups(df, {"g": F.col("g"), "h": F.col("h")}, "row_id")
    found = {r.row_id: r.component_id for r in out.collect()}
    assert found == {1: 0, 3: 0, 4: 0, 5: 0, 2: 1, 6: 2, 7: 3}
