"""Quality rules whose cutoffs are certified on labelled documents.

Each statistic of a text is cut into integer levels on a fixed grid, higher meaning worse, and a rule
rejects levels from a cutoff upwards. Labelled good documents of a stratum are the holdout: a cutoff is
certified when the exact binomial tail shows that it falsely rejects at most ``alpha / statistics`` of
the good ones. Along one grid cutoffs are tested from the loosest on, where the tail only grows
(a fixed sequence needs no correction); over strata and statistics the error ``delta`` is divided
(Bonferroni). With probability 1 - ``delta``, no stratum loses more than ``alpha`` of its good documents
to the rules. Among certified cutoffs the most useful is taken; a stratum with too few labels has none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.tables import settle
from foldspark.llm.text import with_word_stats

LEVELS = 50


def _share(part: str, whole: str) -> Column:
    share = F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))
    return F.least(F.floor(share * LEVELS), F.lit(LEVELS)).cast("int")


def _mean_length() -> Column:
    mean = F.coalesce(F.col("word_chars") / F.nullif(F.col("n_words"), F.lit(0)), F.lit(0.0))
    return F.least(F.floor(mean * 2), F.lit(LEVELS)).cast("int")


RULES: dict[str, Callable[[], Column]] = {
    "symbols": lambda: _share("n_symbols", "word_chars"),
    "dup_lines": lambda: _share("n_dup_lines", "n_lines"),
    "repeats": lambda: _share("n_repeat_words", "n_words"),
    "long_words": _mean_length,
    "short_words": lambda: F.lit(LEVELS) - _mean_length(),
}


def log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by seven; relative error below 1e-11 for x >= 1."""
    y = x + 7
    shift = F.log(x * (x + 1) * (x + 2)) + F.log((x + 3) * (x + 4) * (x + 5)) + F.log(x + 6)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), exact to rounding; 1 where k is not below the mean.

    Terms are summed downwards from k; those further below than 40 deviations vanish in a double.
    """
    kd, nd = k.cast("double"), n.cast("double")
    top = log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1)
    top = top + kd * F.log(F.lit(rate)) + (nd - kd) * F.log(F.lit(1 - rate))
    last = F.greatest(F.lit(1).cast("bigint"), (kd - 40 * F.sqrt(nd * rate) - 100).cast("bigint"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def lower(acc: Column, j: Column) -> Column:
        term = acc["term"] * j * (1 - rate) / ((nd - j + 1) * rate)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(k >= last, F.sequence(k, last, F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, start, lower, lambda acc: acc["total"])
    return F.when(kd >= nd * rate, 1.0).otherwise(F.exp(top) * total)


def certify(levels: DataFrame, alpha: float = 0.05, delta: float = 0.1, cost: int = 10) -> DataFrame:
    """Cutoffs per stratum from labelled levels (stratum, quality, one level a rule).

    Every certified cutoff is valid, so the choice among them is free: the one that rejects most bad
    documents less ``cost`` times the good ones, the loosest of equals. Returns stratum and one cutoff
    a rule, null where none is certified or useful.
    """
    names = [c for c in levels.columns if c in RULES]
    rate = alpha / len(names)
    long = levels.select(
        "stratum", "quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in names])).alias("x")
    ).select("stratum", "quality", "x.*")
    counts = long.groupBy("stratum", "rule", "level").agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")
    )
    strata = counts.select("stratum").distinct()
    empty = strata.select(
        "stratum",
        F.explode(F.array(*map(F.lit, names))).alias("rule"),
        F.lit(0).cast("bigint").alias("good"),
        F.lit(0).cast("bigint").alias("bad"),
        F.lit(LEVELS).alias("_top"),
    )
    grid = empty.select("stratum", "rule", F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("level"), "good", "bad")
    full = grid.unionByName(counts.select(*grid.columns)).groupBy("stratum", "rule", "level").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad")
    )
    # at most LEVELS + 1 rows a window
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("level"))
    whole = Window.partitionBy("stratum", "rule")
    run = full.select(
        "stratum",
        "rule",
        "level",
        F.sum("good").over(above).alias("k"),
        F.sum("bad").over(above).alias("hits"),
        F.sum("good").over(whole).alias("n"),
    )
    tests = len(names) * max(1, strata.count())
    tested = run.where("level > 0 and n > 0")
    safe = tested.where(binomial_tail(F.col("k"), F.col("n"), rate) <= F.lit(delta / tests))
    gain = F.col("hits") - cost * F.col("k")
    chosen = safe.where(gain > 0).groupBy("stratum", "rule").agg(F.max_by("level", F.struct(gain, "level")).alias("cut"))
    return chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in names])


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str | None = "lang",
    alpha: float = 0.05,
    delta: float = 0.1,
) -> DataFrame:
    """One row a document: doc_id, base statistics, base_failed, kept.

    Null and empty texts have no words and fail the base rule. A missing stratum is a stratum of its own.
    A document labelled several times counts as bad if one label says so; null labels do not count.
    Repeated rows are judged each. Other columns of ``docs`` are ignored.
    """
    group = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    slim = docs.select("doc_id", "text", group.alias("stratum"))
    rows = with_word_stats(slim).drop("text", "ws")
    rows = settle(rows.withColumns({r: f() for r, f in RULES.items()}), "rules-stats")
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cuts = settle(certify(rows.select("doc_id", "stratum", *RULES).join(marks, "doc_id"), alpha, delta), "rules-cuts")
    short = F.col("n_words") < 10
    base_failed = short | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(r) >= F.col(f"cut_{r}"), F.lit(False))
    return rows.join(cuts, "stratum", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & ~rejected).alias("kept"),
    )
