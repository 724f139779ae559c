"""Mixing sources to target weights.

Weights are the sources' token shares raised to an exponent in [0, 1] and normalised. Entropy falls and the
number of repetitions of the smallest source falls as the exponent grows; bisection finds the largest exponent
that keeps a target entropy and the smallest that keeps a repetition limit, and the limit wins. A source's quota
is its weight times the token budget. Quotas are realised as epochs of block permutations: documents are dealt
to blocks by a hash, every epoch orders the blocks anew, whole blocks are taken while they fit, and the documents
of the one block that crosses the quota are taken in hash order while they fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.hashing import seeded_md5
from foldspark.llm.tables import bounded, join_documents, packed, settle
from foldspark.llm.text import words

STEPS = 32  # bisection steps; the exponent is exact to 2**-32
AT_ONCE = 4  # steps decided by one job


def token_shares(rows: DataFrame) -> DataFrame:
    """(source, tokens, docs, share) of sources that have tokens."""
    sums = rows.groupBy("source").agg(F.sum("n_words").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0")
    sums = settle(sums, "mix-tokens")
    total = sums.agg(F.sum("tokens").alias("t")).first().t
    return sums.withColumn("share", F.col("tokens") / F.lit(total))


def _measure(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, largest weight / share) at each exponent, in one job."""
    stats = []
    for i, e in enumerate(exponents):
        power = F.pow("share", F.lit(e))
        stats += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(power)).alias(f"a{i}")]
        stats.append(F.max(F.pow("share", F.lit(e - 1))).alias(f"r{i}"))
    row = shares.agg(*stats).first()
    return [(math.log(row[f"z{i}"]) - row[f"a{i}"] / row[f"z{i}"], row[f"r{i}"] / row[f"z{i}"]) for i in range(len(exponents))]


def bisect_exponent(shares: DataFrame, holds, keep_low: bool) -> float:
    """Where ``holds(entropy, ratio)`` changes on [0, 1]: the largest exponent that holds if ``keep_low``
    (it holds at 0), else the smallest (it holds at 1). Each job decides ``AT_ONCE`` halvings."""
    low, high = 0.0, 1.0
    for _ in range(STEPS // AT_ONCE):
        parts = 2**AT_ONCE
        at = [low + (high - low) * i / parts for i in range(1, parts)]
        held = [holds(*m) for m in _measure(shares, at)]
        first = 0
        for step in range(AT_ONCE):
            middle = first + 2 ** (AT_ONCE - 1 - step)
            if held[middle - 1] == keep_low:
                first = middle
        low, high = low + (high - low) * first / parts, low + (high - low) * (first + 1) / parts
    return low if keep_low else high


def temperature(shares: DataFrame, budget_ratio: float, entropy_share: float | None, max_epochs: float) -> float:
    """The exponent; ``entropy_share`` is the target as a share of the largest possible entropy."""
    (flat, flat_ratio), (natural, _) = _measure(shares, [0.0, 1.0])
    repeats = 0.0
    if budget_ratio * flat_ratio > max_epochs:
        # at 1 every source is read budget_ratio times: if that is too often, nothing helps and 1 is best
        repeats = 1.0 if budget_ratio > max_epochs else bisect_exponent(shares, lambda h, r: budget_ratio * r <= max_epochs, False)
    spread = 0.0
    if entropy_share is not None:
        target = entropy_share * flat
        spread = 1.0 if natural >= target else bisect_exponent(shares, lambda h, r: h >= target, True)
    return max(repeats, spread)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def mixture(
    docs: DataFrame,
    entropy_share: float | None = 0.97,
    max_epochs: float = 4.0,
    budget_tokens: int | None = None,
    block_tokens: int = 1_000_000,
    seed: int = 17,
) -> DataFrame:
    """One row per document and epoch in which it is taken: doc_id, k, source, n_words, epoch, block_pos.

    The budget defaults to the tokens of ``docs``. Null and empty sources are one source; a source without tokens
    has no weight and is not taken, null or empty texts (no tokens) are taken with their block. Rows equal in id,
    text and source are one document. ``block_pos`` is the rank of the document's block in that epoch of its source.
    """
    rows = docs.select(
        F.xxhash64("doc_id", "text", "source").alias("k"),
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.size(words(F.col("text"))).cast("bigint").alias("n_words"),
    )
    rows = settle(rows.groupBy("k", "doc_id", "source").agg(F.max("n_words").alias("n_words")), "mix-rows")
    shares = token_shares(rows)
    if shares.isEmpty():
        return rows.select(
            "doc_id", "k", "source", "n_words", F.lit(0).cast("bigint").alias("epoch"), F.lit(0).cast("bigint").alias("block_pos")
        ).where("n_words < 0")
    total = shares.agg(F.sum("tokens").alias("t")).first().t
    budget = total if budget_tokens is None else budget_tokens
    power = F.pow("share", F.lit(temperature(shares, budget / total, entropy_share, max_epochs)))
    z = float(shares.agg(F.sum(power)).first()[0])
    quota = F.floor(F.round(power / z, 9) * budget).cast("bigint")
    blocks_of = F.ceil(F.col("tokens") / block_tokens).cast("bigint")
    plan = shares.select("source", "tokens", quota.alias("quota"), blocks_of.alias("n_blocks"))
    plan = settle(plan, "mix-plan")

    dealt = rows.join(bounded(plan.select("source", "n_blocks")), "source")
    block = _number(seeded_md5(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))) % F.col("n_blocks")
    dealt = dealt.select("k", "doc_id", "source", "n_words", block.alias("block"))
    sums = dealt.groupBy("source", "block").agg(F.sum("n_words").alias("size"))
    epochs = F.sequence(F.lit(0).cast("bigint"), F.expr("quota div tokens"))
    blocks = sums.join(bounded(plan), "source").withColumn("epoch", F.explode(epochs))
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", "block", "source"))
    order = Window.partitionBy("source", "epoch").orderBy(turn, "block")  # one row a block of a source
    blocks = blocks.withColumns(
        {"block_pos": F.row_number().over(order).cast("bigint"), "before": F.sum("size").over(order) - F.col("size")}
    )
    room = F.when(F.col("epoch") < F.expr("quota div tokens"), F.col("tokens")).otherwise(F.expr("quota % tokens"))
    blocks = blocks.withColumn("room", room - F.col("before")).where("room > 0")
    blocks = settle(blocks.select("source", "block", "epoch", "block_pos", "size", "room"), "mix-blocks")

    taken = dealt.join(bounded(blocks), ["source", "block"])
    whole = taken.where("size <= room")
    # one block a source crosses its quota
    inside = Window.partitionBy("source", "epoch").orderBy(
        F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), "k"
    )
    part = taken.where("size > room").withColumn("upto", F.sum("n_words").over(inside)).where("upto <= room").drop("upto")
    return whole.unionByName(part).select("doc_id", "k", "source", "n_words", "epoch", "block_pos")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """Rows of ``docs`` as often as the mixture takes them, with ``epoch`` and ``block_pos`` added."""
    taken = settle(mixture(docs, **parameters).select("k", "doc_id", "epoch", "block_pos"), "mix-taken")
    keyed = packed(docs, k=F.xxhash64("doc_id", "text", "source"), doc_id=F.col("doc_id"))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("epoch", "block_pos")]
    return join_documents(keyed, taken, "inner").select(*kept, "epoch", "block_pos")
