"""Quality classifier: a sparse ensemble of rules.

A small forest is grown on text statistics of labelled documents; every path from a root to a node is a rule, the
conjunction of its conditions. A logistic model with lasso penalty weighs the rules, most weights become zero, and
the rest are compiled into one Spark column expression, so that scoring is a projection.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.tables import attach, bounded, fold_of, settle
from foldspark.llm.text import with_word_stats

# statistic -> expression over the columns of with_word_stats and the counts of ``statistics``
SHARES = {
    "mean_word": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "shouts": ("n_shouts", "n_words"),
    "bars": ("n_bars", "n_words"),
    "stops": ("n_stops", "n_words"),
    "line_words": ("n_words", "n_lines"),
}
FEATURES = ["log_words", *SHARES]
COUNTS = {"n_upper": r"\p{Lu}", "n_digits": r"[0-9]", "n_shouts": "!", "n_bars": r"\|", "n_stops": r"[.,;:?]"}

Rule = tuple[tuple[int, float, bool], ...]  # (feature, threshold, at most it)


def statistics(docs: DataFrame) -> DataFrame:
    """Replace ``text`` by the numbers of ``FEATURES``; a share of nothing is 0."""
    counted = with_word_stats(docs)
    text = F.coalesce("text", F.lit(""))
    counts = {c: F.regexp_count(text, F.lit(p)) for c, p in COUNTS.items()}
    counted = counted.withColumns(counts | {"n_distinct": F.size(F.array_distinct("ws"))}).drop("ws", "text")
    shares = {f: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)) for f, (a, b) in SHARES.items()}
    counted = counted.withColumns(shares | {"log_words": F.log1p("n_words")})
    return counted.select(*[c for c in docs.columns if c != "text"], *FEATURES)


def paths(node, above: Rule = ()) -> Iterator[Rule]:
    """Rules of a fitted tree below ``node`` (the JVM node of a Spark tree)."""
    if above:
        yield above
    if node.subtreeDepth() > 0:
        split = node.split()
        feature, threshold = split.featureIndex(), split.threshold()
        yield from paths(node.leftChild(), (*above, (feature, threshold, True)))
        yield from paths(node.rightChild(), (*above, (feature, threshold, False)))


def simplify(rule: Rule) -> Rule:
    """The tightest condition of each feature and side, in a fixed order."""
    tight: dict[tuple[int, bool], float] = {}
    for feature, threshold, below in rule:
        old = tight.get((feature, below), threshold)
        tight[feature, below] = min(old, threshold) if below else max(old, threshold)
    return tuple((f, t, b) for (f, b), t in sorted(tight.items()))


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for feature, threshold, below in rule:
        column = F.col(FEATURES[feature])
        out = out & (column <= threshold if below else column > threshold)
    return out


def fit(labelled: DataFrame, trees: int = 20, depth: int = 3, penalty: float = 0.002) -> Column:
    """Score expression from rows with ``FEATURES`` and ``quality`` (0 or 1)."""
    seen = {r.quality: r.n for r in labelled.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:  # nothing to tell apart
        return F.lit((seen.get(1, 0) + 1) / (sum(seen.values()) + 2))
    rows = labelled.withColumn("x", array_to_vector(F.array(*FEATURES))).withColumn("y", F.col("quality").cast("double"))
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, minInstancesPerNode=5,
        featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=7,
    )
    grown = forest.fit(rows.select("x", "y"))
    rules = list(dict.fromkeys(simplify(r) for tree in grown.trees for r in paths(tree._java_obj.rootNode())))
    if not rules:
        return F.lit((seen[1] + 1) / (sum(seen.values()) + 2))
    fired = rows.select("y", array_to_vector(F.array(*[condition(r).cast("double") for r in rules])).alias("fired"))
    lasso = LogisticRegression(featuresCol="fired", labelCol="y", elasticNetParam=1.0, regParam=penalty, maxIter=60)
    model = lasso.fit(settle(fired, "rules-fired"))
    score = F.lit(float(model.intercept))
    for rule, weight in zip(rules, model.coefficients.toArray(), strict=True):
        if weight:
            score = score + F.when(condition(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-score))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, folds: int = 3, held_out: int = 1) -> DataFrame:
    """One row a document: k, doc_id, held_out, score, predicted.

    Labels are learned from documents outside the held-out fold (crc32 of the id); about ``max_rows`` of them,
    drawn by a hash of the id, fit the model. Null and empty texts have statistics of zero and a score like any other.
    Null labels are ignored, a document labelled twice counts as bad if one label says so, null ids are never
    learned from. Without labels of both kinds the score is constant. Repeated rows are scored each.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k"), "doc_id", "text")
    numbers = settle(statistics(keyed), "rule-statistics")
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    usable = marks.where(fold_of(F.col("doc_id"), folds) != held_out)
    share = min(1.0, max_rows / max(1, usable.count()))
    drawn = usable.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("rules")), F.lit(1_000_000)) < int(share * 1_000_000))
    train = settle(numbers.join(drawn, "doc_id").select("quality", *FEATURES), "rule-labelled")
    score = fit(train)
    out = numbers.select("k", "doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """``docs`` without those predicted to be bad, all columns kept."""
    bad = quality_scores(docs, labels, **parameters).where("predicted = 0").select("k", "doc_id", F.lit(True).alias("bad"))
    return attach(docs, bounded(settle(bad.distinct(), "rule-rejected"))).where("bad is null").select("row.*")
