"""Selection optimism measured on real predictions by a grouped bootstrap.

A replicate gives every group a Poisson(1) weight from a hash of (seed, replicate, group), so
related rows move together and no random state is needed. Validation and test replicates use
different seeds. Scores are weighted accuracies, hence sums: rows are reduced to one record
per group before replicates are formed.
"""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.hashing import unit_interval

POISSON_CUTS = 12  # weights above 12 have probability below 1e-10


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw from a uniform value by its inverse distribution function."""
    mass, cuts = 0.0, []
    for k in range(POISSON_CUTS):
        mass += exp(-1.0) / factorial(k)
        cuts.append(mass)
    draw = F.lit(0)
    for cut in cuts:
        draw = draw + (u >= F.lit(cut)).cast("int")
    return draw


def group_hits(preds: DataFrame, candidates: list[int], threshold: float = 0.5) -> DataFrame:
    """Rows and correct predictions of every candidate per group: ``group_id, n, hits[]``."""
    right = ((F.col("y_score") >= threshold).cast("int") == F.col("y_true")).cast("int")
    hits = [F.sum(F.when(F.col("run") == c, right).otherwise(0)) for c in candidates]
    rows = F.count_if(F.col("run") == candidates[0])
    return preds.groupBy("group_id").agg(rows.alias("n"), F.array(*hits).alias("hits"))


def true_scores(hits: DataFrame, candidates: list[int]) -> DataFrame:
    """Score of each candidate on all rows."""
    sums = hits.agg(
        F.sum("n").alias("n"), *[F.sum(F.col("hits")[i]).alias(f"c{i}") for i in range(len(candidates))]
    )
    return _unpack(sums, candidates, lambda i: {"mu": F.col(f"c{i}") / F.col("n")}, [])


def bootstrap_scores(hits: DataFrame, candidates: list[int], replicates: int) -> DataFrame:
    """``replicate, candidate, val, test``: weighted accuracy under two independent draws."""
    rep = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    each = hits.select("group_id", "n", "hits", rep)
    ident = F.concat(F.col("replicate").cast("string"), F.lit(":"), F.col("group_id"))
    each = each.withColumns(
        {"wv": poisson_weight(unit_interval("val", ident)), "wt": poisson_weight(unit_interval("test", ident))}
    )
    sums = []
    for w in ("wv", "wt"):
        sums.append(F.sum(F.col(w) * F.col("n")).alias(f"{w}_n"))
        sums += [F.sum(F.col(w) * F.col("hits")[i]).alias(f"{w}_{i}") for i in range(len(candidates))]
    # the shuffle carries one record per replicate and task
    per = each.groupBy("replicate").agg(*sums)

    def scores(i: int) -> dict[str, Column]:
        return {
            "val": F.try_divide(F.col(f"wv_{i}"), F.col("wv_n")),
            "test": F.try_divide(F.col(f"wt_{i}"), F.col("wt_n")),
        }

    return _unpack(per, candidates, scores, ["replicate"])


def _unpack(df: DataFrame, candidates: list[int], fields, keep: list[str]) -> DataFrame:
    each = [
        F.struct(F.lit(c).alias("candidate"), *[e.alias(n) for n, e in fields(i).items()])
        for i, c in enumerate(candidates)
    ]
    return df.select(*keep, F.explode(F.array(*each)).alias("s")).select(*keep, "s.*")


def candidate_sets(df: DataFrame, sets: dict[str, list[int]]) -> DataFrame:
    """Repeat each candidate's records for every set that contains it."""
    member = [F.when(F.col("candidate").isin(*cs), F.lit(s)) for s, cs in sets.items()]
    return df.withColumn("candidate_set", F.explode(F.array_compact(F.array(*member))))


def panel(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Optimism panel per ``candidate_set``; complexity is the candidate's index.

    Both inputs carry ``candidate_set``. Sigma of a candidate is the spread of its validation
    score over the replicates.
    """
    by = ["candidate_set"]
    sigma = scores.groupBy(*by, "candidate").agg(F.stddev_samp("val").alias("sigma"))
    top = truth.groupBy(*by).agg(F.max("mu").alias("mu_star"))
    known = truth.join(sigma, [*by, "candidate"]).join(top, by)  # one record per candidate
    each = scores.join(F.broadcast(known), [*by, "candidate"])
    rep = [*by, "replicate"]
    first = -F.col("candidate")  # ties go to the lowest index
    own = F.struct("mu", "test", "candidate")
    best = each.groupBy(*rep).agg(
        F.max(F.struct("val", first.alias("o"), own.alias("c"))).alias("v"),
        F.max("test").alias("top_test"),
        F.max("mu_star").alias("mu_star"),
        F.max("val").alias("top_val"),
    )
    near = each.join(best.select(*rep, "top_val"), rep).where(F.col("val") >= F.col("top_val") - F.col("sigma"))
    ose = near.groupBy(*rep).agg(F.min(F.struct("candidate", "mu")).alias("s"))
    per = best.join(ose, rep).select(
        *rep,
        F.col("v.c.candidate").alias("winner"),
        (F.col("top_test") - F.col("mu_star")).alias("oracle_optimism"),
        (F.col("mu_star") - F.col("v.c.mu")).alias("regret"),
        (F.col("v.c.mu") == F.col("mu_star")).cast("double").alias("picked_best"),
        (F.col("v.c.test") - F.col("v.c.mu")).alias("reporting_bias"),
        F.col("v.c.test").alias("test_selected"),
        (F.col("mu_star") - F.col("s.mu")).alias("one_se_regret"),
    )
    r = F.count("*")

    def mcse(c: str) -> Column:
        return F.stddev_samp(c) / F.sqrt(r)

    means = per.groupBy(*by).agg(
        r.alias("n_replicates"),
        *[F.avg(c).alias(f"{c}_mean") for c in ("oracle_optimism", "regret", "reporting_bias", "test_selected", "one_se_regret")],
        *[mcse(c).alias(f"{c}_mcse") for c in ("oracle_optimism", "regret", "reporting_bias")],
        F.avg("picked_best").alias("p_select_best"),
        mcse("picked_best").alias("p_select_best_mcse"),
    )
    wins = per.groupBy(*by, "winner").agg(F.count("*").alias("w"))
    unstable = wins.groupBy(*by).agg((1 - F.max("w") / F.sum("w")).alias("winner_instability"))
    k = F.count("*")
    bound = known.groupBy(*by).agg(
        k.alias("n_candidates"), (F.max("sigma") * F.sqrt(2 * F.log(F.greatest(k, F.lit(2))))).alias("bound")
    )
    out = means.join(unstable, by).join(bound, by)
    return out.withColumn("oracle_bound_ratio", F.try_divide("oracle_optimism_mean", "bound"))


def monotone_check(panels: DataFrame) -> DataFrame:
    """Optimism may not fall with more candidates by more than three Monte Carlo errors."""
    # one record per candidate set
    w = Window.orderBy("n_candidates", "candidate_set")
    slack = 3 * (F.col("oracle_optimism_mcse") + F.lag("oracle_optimism_mcse").over(w))
    before = F.lag("oracle_optimism_mean").over(w)
    ok = F.coalesce(F.col("oracle_optimism_mean") >= before - slack, F.lit(True))
    return panels.select("candidate_set", "n_candidates", "oracle_optimism_mean", ok.alias("monotone"))


def asymmetry(panels: DataFrame, large: str, small: str) -> DataFrame:
    """Oracle optimism of the large set minus that of the small one, and whether it holds."""
    def of(s: str, c: str) -> Column:
        return F.max(F.when(F.col("candidate_set") == s, F.col(c)))

    advantage = of(large, "oracle_optimism_mean") - of(small, "oracle_optimism_mean")
    slack = 3 * (of(large, "oracle_optimism_mcse") + of(small, "oracle_optimism_mcse"))
    return panels.agg(
        advantage.alias("oracle_advantage"), slack.alias("tolerance"), (advantage >= -slack).alias("criterion_pass")
    )


def criteria(panels: DataFrame) -> DataFrame:
    """Acceptance rows: value, theoretical value, tolerance and verdict per criterion."""
    bias_tol = F.greatest(3 * F.col("reporting_bias_mcse"), F.lit(1e-4))
    bound_tol = F.greatest(5 * F.col("oracle_optimism_mcse"), F.lit(1e-6))
    rows = [
        ("honest_unbiased", F.abs("reporting_bias_mean"), F.lit(0.0), bias_tol),
        ("oracle_within_bound", F.col("oracle_optimism_mean"), F.col("bound"), bound_tol),
        ("regret_within_bound", F.col("regret_mean"), F.col("bound"), bound_tol),
    ]
    each = [
        F.struct(
            F.lit(n).alias("criterion"),
            v.alias("value"),
            t.alias("theoretical"),
            tol.alias("tolerance"),
            (v <= t + tol).alias("criterion_pass"),
        )
        for n, v, t, tol in rows
    ]
    return panels.select("candidate_set", F.explode(F.array(*each)).alias("c")).select("candidate_set", "c.*")
