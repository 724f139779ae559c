"""Exact ranks, prefix sums and salted lookups against plain Python."""

import random

from pyspark.sql import functions as F

from foldspark.operators import scan, skew
from foldspark.operators.lineage import differences
from foldspark.operators.skew import lookup, salted_lookup
from foldspark.session import materialize


def keyed(spark, n=500):
    rng = random.Random(5)
    return [(i, "hot" if i % 3 == 0 else rng.choice("pqrs"), rng.random(), rng.randint(0, 9)) for i in range(n)]


def expected(rows):
    want, sums, ranks, last = {}, {}, {}, {}
    for i, g, v, w in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = (ranks.get(g, 0) + 1, sums.get(g, 0))
        ranks[g], sums[g] = ranks.get(g, 0) + 1, sums.get(g, 0) + w
        if g in last:
            want[last[g]] = (*want[last[g]], v)
        last[g] = i
    return {i: t if len(t) == 3 else (*t, None) for i, t in want.items()}


def test_scan_in_pieces_equals_one_sorted_pass(spark):
    rows = keyed(spark)
    df = spark.createDataFrame(rows, "i INT, g STRING, v DOUBLE, w INT")
    for options in ({"pieces": 7}, {"pieces": 1}, {"rows": len(rows)}):
        out = scan.prefix_scan(
            df, ["v"], {"r": F.lit(1), "s": "w"}, within=["g"], following={"nxt": "v"}, **options
        ).collect()
        assert {r.i: (r.r + 1, r.s, r.nxt) for r in out} == expected(rows), options


def test_rank_without_groups_is_dense_over_pieces(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    ranked = scan.exact_rank(df, [F.col("k").desc()], "r", pieces=6).collect()
    assert {r.k: r.r for r in ranked} == {k: 1000 - k for k in range(1000)}


def test_salted_lookup_equals_join_for_a_hot_key(spark):
    left = spark.createDataFrame(keyed(spark), "i INT, g STRING, v DOUBLE, w INT")
    counts = left.groupBy("g").agg(F.count("*").alias("n")).where("g <> 's'")
    right = materialize(counts.withColumn("x", F.upper("g")), "right")
    plain = sorted(left.join(right.drop("n"), "g", "left").select("i", "x").collect())
    salted = salted_lookup(left, right, ["g"], ["i"], hot_share=0.2, salts=8)
    assert sorted(salted.select("i", "x").collect()) == plain
    assert sorted(lookup(left, right, ["g"], ["i"], rows=10**9).select("i", "x").collect()) == plain
    assert sorted(lookup(left, right, ["g"], ["i"]).select("i", "x").collect()) == plain


def test_no_single_partition_exchange_on_rows(spark):
    df = spark.range(1000).withColumn("k", F.md5(F.col("id").cast("string")))
    plan = scan.exact_rank(df, ["k"], "r", pieces=4)._jdf.queryExecution().executedPlan().toString()
    window = plan.index("Window")
    assert "hashpartitioning(_piece" in plan[window:]


def test_large_values_in_small_files_are_not_broadcast(spark):
    left = spark.range(4000).select((F.col("id") % 2000).alias("g"), F.col("id").alias("i"))
    packed = spark.range(2000).select(F.col("id").alias("g"), F.lit(2).alias("n"), F.array_repeat(F.lit(1.0), 2000).alias("x"))
    right = materialize(packed, "right")  # 32 MB of equal values, a few KB in the file
    joined = lookup(left, right, ["g"], ["i"]).select("i", F.size("x").alias("k"))
    assert joined.where("k = 2000").count() == 4000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") <= 1  # the list of hot keys


def test_differences_count_both_ways(spark):
    a, b = (spark.createDataFrame([(x, [0.5, None]) for x in text], "k STRING, c ARRAY<DOUBLE>") for text in ("aabc", "abbd"))
    found = sorted((r.k, r.side) for r in differences(a, b).collect())
    assert found == [("a", "left"), ("b", "right"), ("c", "left"), ("d", "right")]


def test_large_sides_of_small_files_are_merged(spark, monkeypatch):
    """Equal arrays take little room in files and much in memory: Spark by itself would send them to the driver."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 100)
    uses = F.array(*[F.struct(F.lit(i).alias("outer_fold"), F.lit("outer").alias("phase")) for i in range(9)])
    right = materialize(spark.range(1_000).select(F.col("id").alias("g"), F.lit(1).alias("n"), uses.alias("uses")))
    left = materialize(spark.range(5_000).select(F.col("id").alias("row_id"), (F.col("id") % 1_000).alias("g")))
    found = skew.lookup(left, right, ["g"], ["row_id"], how="inner")
    assert found.count() == 5_000
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
