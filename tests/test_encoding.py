"""Encoders and fold-safe composition: closed forms, unseen levels, metamorphic invariants."""

import hashlib
import math
from collections import defaultdict
from pathlib import Path

import pytest
from toy import COLS, TOY_ROWS
from pyspark.sql import functions as F

from foldspark.operators import cube as cb
from foldspark.operators import encoders as enc
from foldspark.operators import foldsafe as fs
from foldspark.operators import lineage as lin
from foldspark.operators import ordered, skew, splits
from foldspark.session import materialize, scratch_dir
from foldspark.sources.categories import Wide, normalize


def plain_map(spark, rows, name, columns=("a",)):
    df = spark.createDataFrame(rows, ["a", "y"] if columns == ("a",) else None)
    states = cb.whole_states(df, list(columns))
    return {r.level: r.code for r in enc.ENCODERS[name].codes(states, ()).collect()}


ROWS = [("p", 1), ("p", 0), ("q", 1), ("q", 1), ("q", 0), ("r", 0)]


def test_closed_forms(spark):
    prior = 0.5
    target = plain_map(spark, ROWS, "target")
    assert target["q"] == pytest.approx((2 + 20 * prior) / 23)
    count = plain_map(spark, ROWS, "count")
    assert count == pytest.approx({"p": 2 / 6, "q": 3 / 6, "r": 1 / 6})
    woe = plain_map(spark, ROWS, "woe")
    assert woe["r"] == pytest.approx(math.log((0.5 / 4.5) / (1.5 / 4.5)))
    assert plain_map(spark, ROWS, "label") == {"p": 1, "q": 2, "r": 3}
    extreme = plain_map(spark, [("p", 1)] * 900 + [("q", 0)] * 900, "woe")
    assert extreme == {"p": 5.0, "q": -5.0}


def test_unseen_levels_and_literal_sentinel(spark):
    fit = spark.createDataFrame([("__UNSEEN__", 1), ("b", 0)], "a STRING, y INT")
    states = enc.label_codes(cb.whole_states(fit, ["a"]))
    rows = spark.createDataFrame([(0, "__UNSEEN__"), (1, "b"), (2, "zz")], "row_id INT, a STRING")
    out = {r.row_id: r.codes[0] for r in fs.apply_plain(rows, states, ["a"], F.lit(0.0)).collect()}
    assert out[0] != 0 and out[1] != 0 and out[2] == 0


def test_null_is_a_level_and_empty_stays_its_own(spark):
    df = spark.createDataFrame([(None,), ("",), ("?",)], "a STRING")
    assert [r.a for r in normalize(df, ["a"]).collect()] == ["?", "", "?"]


def test_hash_tokens_and_widths(spark):
    one = spark.createDataFrame([("x", "y"), ("y", "x")], "p STRING, q STRING")
    aware = one.select(enc.row_hashes(["p", "q"], True).alias("h")).collect()
    bare = one.select(enc.row_hashes(["p", "q"], False).alias("h")).collect()
    assert sorted(aware[0].h) != sorted(aware[1].h)
    assert sorted(bare[0].h) == sorted(bare[1].h)
    token = lambda c, v: enc.hash_token(F.lit(c), F.lit(v), True)
    a, b = one.limit(1).select(token("a=b", "c"), token("a", "b=c")).first()
    assert a != b
    widths = spark.createDataFrame([(10,), (100,), (1000,), (10000,)], "k INT")
    got = [r.b for r in widths.select(enc.bucket_width(F.col("k"), 10).alias("b")).collect()]
    assert got == [16, 32, 64, 10]


def test_bucket_counts_are_runs_of_the_sorted_hits(spark):
    rows = [([3, 1, 3, 3, 0],), ([7],), ([],), ([5, 5],), (list(range(8)),)]
    df = spark.createDataFrame(rows, "h ARRAY<INT>")
    out = enc.with_bucket_counts(df, F.col("h")).withColumn("dense", enc.dense_counts(F.col("slots"), F.col("counts"), F.lit(8)))
    for r in out.collect():
        want = [float(r.h.count(b)) for b in range(8)]
        assert r.dense == want and r.slots == sorted(set(r.h)) and r.counts == [want[b] for b in r.slots]


def test_blake2b_family(spark):
    import hashlib

    tokens = spark.createDataFrame([("0",), ("1",), ("ä|b",)], "token STRING")
    got = {r.token: r.bucket for r in enc.blake2b_buckets(tokens, 32, 20260810).collect()}
    for t, bucket in got.items():
        h = hashlib.blake2b(t.encode(), digest_size=8, key=(20260810).to_bytes(8, "little"))
        assert bucket == int.from_bytes(h.digest(), "little") % 32


def codes(df):
    return {(r.row_id, r.outer_fold, r.phase): tuple(round(c, 9) for c in r.codes) for r in df.collect()}


def brute_target(rows, uses, alpha=20.0):
    """Direct refit of every state in plain Python."""
    of = defaultdict(list)
    for u in uses.collect():
        of[u.group_id].append(u)
    each = [(r, u) for r in rows.collect() for u in of[r.group_id]]
    out = {}
    for r, u in each:
        fit = [x for x, v in each if (v.outer_fold, v.phase) == (u.outer_fold, u.phase) and v.part >= 0 and v.part != u.part]
        prior = sum(x.y for x in fit) / len(fit)
        code = []
        for c in COLS:
            same = [x.y for x in fit if x[c] == r[c]]
            code.append(round((sum(same) + alpha * prior) / (len(same) + alpha), 9))
        out[(r.row_id, u.outer_fold, u.phase)] = tuple(code)
    return out


def test_target_equals_direct_refit_on_every_path(spark, toy, uses, assigned, monkeypatch):
    sample = materialize(toy.where("row_id < 60"), "sample")
    small = splits.fold_uses(sample)
    rows = materialize(splits.assign(sample, small), "rows")
    want = brute_target(sample, small)
    assert codes(fs.encode(rows, COLS, "target")) == want
    wide_rows = rows.withColumn("levels", F.array(*COLS))
    wide = Wide("levels", 4)
    assert codes(fs.encode(wide_rows, wide, "target")) == want
    monkeypatch.setattr(fs, "BLOCK_SLOTS", 6)  # five, three, four and two levels: a block each, and one of two columns
    assert codes(fs.encode(rows, COLS, "target")) == want
    assert codes(fs.encode(wide_rows, wide, "target")) == want
    monkeypatch.setattr(fs, "COLUMN_LEVELS", 0)
    assert codes(fs.encode(rows, COLS, "target")) == want
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_SHARE", 0.1)
    assert codes(fs.encode(rows, COLS, "target")) == want
    assert codes(fs.encode(wide_rows, wide, "target")) == want


def test_a_level_inside_one_part_is_unseen_there(spark):
    rows = [(i, f"g{i}", "rare" if i == 0 else "ab"[i % 2], i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id INT, group_id STRING, a STRING, y INT")
    assigned = materialize(splits.assign(df, splits.fold_uses(df)), "vanish")
    states = cb.all_states(cb.fold_cube(assigned, ["a"]), "a")
    assert states.where("n = 0").count() == 0
    own = fs.encode(assigned, ["a"], "woe").where("row_id = 0").collect()
    assert {r.codes[0] for r in own} == {0.0}  # unseen in every state that may code it
    onehot = fs.encode_onehot(assigned, ["a"]).where("row_id = 0 AND role = 'test'").first()
    assert onehot.slots == [onehot.width - 1]


def test_own_label_gap_of_unique_levels(spark):
    rows = [(i, f"g{i}", f"u{i}", i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id INT, group_id STRING, u STRING, y INT")
    assigned = materialize(splits.assign(df, splits.fold_uses(df)), "unique")
    use = ["outer_fold", "phase", "role"]
    train = "role = 'train'"
    glob = fs.own_label_gap(fs.encode_global(assigned, ["u"], "target").where(train), use).collect()
    safe = fs.own_label_gap(fs.encode(assigned, ["u"], "target").where(train), use).collect()
    assert all(r.gap == pytest.approx(1 / 21, abs=1e-6) for r in glob)
    assert all(r.gap < 0.5 / 21 for r in safe)


def relabel(assigned, condition):
    return assigned.withColumn("y", F.when(condition, 1 - F.col("y")).otherwise(F.col("y")))


@pytest.mark.parametrize("name", ["target", "woe", "ordered"])
def test_test_labels_never_reach_codes(assigned, name):
    test = F.exists("uses", lambda u: (u["outer_fold"] == 0) & (u["role"] == "test"))
    kept = ["row_id", "phase", "codes"]
    a, b = (fs.encode(d, COLS, name).where("outer_fold = 0").select(*kept) for d in (assigned, relabel(assigned, test)))
    assert lin.differences(a, b).isEmpty()


def test_own_label_never_reaches_own_code(assigned):
    for name, bound in (("target", 0.0), ("ordered", 2 / 100)):
        before = codes(fs.encode(assigned, COLS, name))
        after = codes(fs.encode(relabel(assigned, F.col("row_id") == 7), COLS, name))
        own = [k for k in before if k[0] == 7]
        fit = [k for k in own if (k[0], k[1], k[2]) in after]
        roles = {(r.outer_fold, r.phase): r.part for r in assigned.where("row_id = 7").selectExpr("inline(uses)").collect()}
        for k in fit:
            if roles[(k[1], k[2])] >= 0:
                assert all(abs(x - y) <= bound + 1e-9 for x, y in zip(before[k], after[k]))
        assert any(before[k] != after[k] for k in before if k[0] != 7)


def test_ordered_codes_depend_on_the_permutation_seed(assigned):
    a = codes(fs.encode(assigned, COLS, "ordered"))
    b = codes(fs.encode(assigned, COLS, "ordered", permutation_seed=1))
    assert a != b and a.keys() == b.keys()


def test_features_of_held_out_rows_do_not_change_eligibility(assigned):
    held = F.exists("uses", lambda u: (u["outer_fold"] == 0) & (u["part"] < 0))
    changed = assigned.withColumn("a", F.when(held, F.concat(F.lit("m"), "row_id")).otherwise(F.col("a")))

    def width(d):
        states = cb.full_states(cb.fold_cube(d, COLS), "a").where("phase = 'inner' AND outer_fold = 0")
        return enc.onehot_eligibility(states, ["outer_fold"]).first()

    assert width(assigned).width == width(changed).width


def test_scaling_is_fitted_on_training_codes_and_clips(assigned):
    scaled = fs.scale_foldsafe(fs.encode(assigned, COLS, "target"))
    values = [(r.role, c) for r in scaled.collect() for c in r.scaled]
    assert all(0 <= c <= 1 for _, c in values)
    train = [c for role, c in values if role == "train"]
    assert min(train) == 0 and max(train) == 1


def test_constant_codes_scale_to_zero(spark):
    df = spark.createDataFrame([(1, [2.0, 1.0]), (2, [2.0, 3.0])], "row_id INT, codes ARRAY<DOUBLE>").withColumn("s", F.lit(1))
    out = fs.scale(df, fs.scaler_bounds(df, ["s"], F.lit(True)), ["s"]).collect()
    assert [r.scaled for r in sorted(out)] == [[0.0, 0.0], [0.0, 1.0]]


def test_hash_codes_count_every_column(assigned):
    out = fs.encode_hash(assigned, COLS, True).collect()
    assert all(sum(r.counts) == 4 and r.buckets == 16 and max(r.slots) < 16 for r in out)


def test_two_runs_agree(assigned):
    a, b = (fs.encode(assigned, COLS, "woe") for _ in range(2))
    assert lin.differences(a, b).isEmpty()


def test_lineage_and_leakage(assigned):
    records = lin.records(assigned, [{"name": "target", "kind": "encoder", "supervised": True, "config": "{}"}]).collect()
    assert len(records) == 5 * 2 * 6
    each = assigned.select("row_id", F.explode("uses").alias("u")).select("row_id", "u.*")
    on = ["outer_fold", "row_id"]
    fit, test = each.where("part >= 0"), each.where("role = 'test'")
    lin.assert_excludes(fit, test, on)
    with pytest.raises(lin.LeakageError):
        lin.assert_excludes(fit.unionByName(test.limit(3)), test, on)


def test_every_encoder_gives_dense_codes_of_constant_width(assigned):
    widths = {"label": 4, "count": 4, "homals": 8, "hash_column": 16, "hash_shared": 16}
    for name, width in widths.items():
        coded = fs.encode_any(assigned, COLS, name)
        assert [r[0] for r in coded.select(F.size("codes")).distinct().collect()] == [width], name
        assert coded.count() == TOY_ROWS * 9
    onehot = fs.encode_any(assigned, COLS, "onehot").selectExpr("aggregate(codes, 0D, (a, v) -> a + v) AS s").distinct()
    assert [r.s for r in onehot.collect()] == [4.0]


def test_foldsafe_quantifications_equal_a_fit_on_the_side(assigned):
    from foldspark.operators import homals as hm

    side = assigned.where(F.exists("uses", lambda u: (u["outer_fold"] == 2) & (u["role"] == "train")))
    alone = {(r.col, r.level): (r.q1, r.q2) for r in hm.fit(side, COLS).collect()}
    rows = {r.row_id: r for r in assigned.collect()}
    for r in fs.encode_homals(assigned, COLS).where("outer_fold = 2 AND phase = 'outer'").collect():
        want = [q for c in COLS for q in alone[(c, rows[r.row_id][c])]]
        assert r.codes == pytest.approx(want, abs=1e-9)


def test_one_hot_cap_is_a_typed_skip(spark, assigned, monkeypatch):
    from foldspark.plans.outcomes import protected

    monkeypatch.setattr(enc, "ONEHOT_WIDTH_CAP", 5)
    monkeypatch.setattr(enc.onehot_eligibility, "__defaults__", (5,))
    out = protected(spark, lambda: fs.encode_any(assigned, COLS, "onehot"), "ENCODING_FAILURE")
    assert out.status == "SKIPPED_INELIGIBLE"


def test_plain_ordered_codes_shuffle_every_row(toy):
    rows = toy.select("row_id", "y", COLS[0]).collect()
    prior, want = sum(r.y for r in rows) / len(rows), {r.row_id: 0.0 for r in rows}
    for p in range(4):
        seen = {}
        for r in sorted(rows, key=lambda r: (hashlib.md5(f"{977 + p}:{r.row_id}".encode()).hexdigest(), r.row_id)):
            n, pos = seen.get(r[COLS[0]], (0, 0))
            want[r.row_id] += (pos + prior) / (n + 1) / 4
            seen[r[COLS[0]]] = (n + 1, pos + r.y)
    found = {r.row_id: r.codes[0] for r in fs.ordered_whole_codes(toy, COLS).collect()}
    assert found == pytest.approx(want)


def test_plain_ordered_codes_write_rows_not_values(spark, toy):
    folder = Path(scratch_dir(spark).removeprefix("file://")) / "foldspark"
    before = set(folder.iterdir())
    assert fs.ordered_whole_codes(toy, COLS).count() == toy.count()
    left = set(folder.iterdir()) - before
    # one table of rows is left, none with a record for each row, column and permutation
    assert sum(spark.read.parquet(str(p)).count() for p in left) == toy.count()


def test_plain_ordered_codes_over_many_ranges(toy, monkeypatch):
    want = {r.row_id: r.codes for r in fs.ordered_whole_codes(toy, COLS).collect()}
    monkeypatch.setattr(ordered, "LEAST_BLOCKS", 1)
    assert {r.row_id: pytest.approx(r.codes) for r in fs.ordered_whole_codes(toy, COLS).collect()} == want


def test_wide_cube_counts_in_tasks(spark, assigned, monkeypatch):
    import pyarrow as pa

    wide = assigned.select("row_id", "y", "uses", F.array(*COLS).alias("levels"))
    monkeypatch.setattr(cb, "to_long", None)  # no record for each value and use
    found = cb.fold_cube(wide, Wide("levels", len(COLS)))
    monkeypatch.undo()
    plain = cb.fold_cube(assigned, COLS).withColumn("col", enc.column_positions(COLS).cast("string"))
    assert found.columns == plain.columns and found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    # rows of different widths, a NULL level, and cells that are handed on early
    batch = pa.RecordBatch.from_pylist([{"y": 1, "fits": [7, 9], "levels": ["a", None]}, {"y": 0, "fits": [7], "levels": ["a"]}, {"y": 1, "fits": [], "levels": ["b", "c"]}])
    for cells in (cb.HELD_CELLS, 1):
        monkeypatch.setattr(cb, "HELD_CELLS", cells)
        out = defaultdict(lambda: [0, 0])
        for part in cb._count_wide(iter([batch, batch])):
            for r in part.to_pylist():
                out[r["state"], r["col"], r["level"]][0] += r["n"]
                out[r["state"], r["col"], r["level"]][1] += r["pos"]
        assert out == {(7, 0, "a"): [4, 2], (7, 1, None): [2, 2], (9, 0, "a"): [2, 2], (9, 1, None): [2, 2]}


def test_wide_columns_of_many_levels_stay_in_dictionaries(spark, monkeypatch):
    states = spark.range(600).select(
        F.lit(0).alias("outer_fold"), F.lit("inner").alias("phase"), F.lit(-1).alias("part"), (F.col("id") % 2).cast("string").alias("col"),
        F.floor(F.col("id") / 2).cast("string").alias("level"), F.col("id").alias("n"), (F.col("id") / 7).alias("code"),
    )
    codes = materialize(states, "states")
    use = "array(named_struct('outer_fold', 0, 'phase', 'inner', 'role', 'inner_val', 'part', -1)) AS uses"
    rows = spark.range(301).selectExpr("id AS row_id", "0 AS y", "array(string(id), string(300 - id)) AS levels", use)
    wide = Wide("levels", 2)
    assert fs._blocks(codes, wide) is not None
    found = {r.row_id: r.codes for r in fs.code_rows(materialize(rows, "rows"), codes, wide, splits.SplitPlan(), 0.5, True).collect()}
    code = lambda c, level: (2 * level + c) / 7 if level < 300 else 0.5
    assert found == {i: [code(0, i), code(1, 300 - i)] for i in range(301)}


def test_columns_of_many_levels_write_one_record_a_level(toy, assigned, monkeypatch):
    want = {name: codes(fs.encode(assigned, COLS, name)) for name in ("target", "count")}
    monkeypatch.setattr(fs, "COLUMN_LEVELS", 2)
    written = []

    def counted(table, *args):
        out = materialize(table, *args)
        written.append(out.count())
        return out

    for module in (fs, cb):
        monkeypatch.setattr(module, "materialize", counted)
    assert {name: codes(fs.encode(assigned, COLS, name)) for name in ("target", "count")} == want
    keyed = assigned.withColumn("u", F.col("row_id").cast("string"))
    written.clear()
    fs.encode(keyed, ["u", "a"], "target").count()
    assert max(written) <= TOY_ROWS + 5  # states and codes had up to 60 records a level
