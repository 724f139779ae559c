"""Shards that all hold the mixture: proportional stratified interleaving.

The rows of every source are shuffled by a seeded hash and ranked; a row's fractional rank is (rank - 1/2) / rows of
its source, so that the rows of each source lie evenly on [0, 1]. All rows in the order of their fractional ranks are
cut into runs of equal length: any two shards differ by at most one row, and each shard has its share of every
source, rounded. Both ranks are prefix sums over range-partitioned pieces of narrow rows: no source and no shard
is sorted by one task, and texts are not exchanged to find the places.

Null and empty sources are one source. Null ids, null and empty texts and repeated rows each get a place of their own;
among rows equal in source, id, size and checksum either may have either place. An empty table has no places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.tables import settle
from foldspark.operators.scan import exact_rank
from foldspark.operators.skew import lookup
from foldspark.session import release

LAW = "rows"  # shards are equal in rows, not in bytes


def _narrow(docs: DataFrame, *extra: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        *extra,
    )


def _place(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), name, F.col("text_crc32")))
    rows = settle(rows.withColumn("turn", turn), "shard-rows")
    counts = settle(rows.groupBy("source").agg(F.count("*").alias("n")).withColumn("of", F.col("n")), "shard-counts")
    total = counts.agg(F.sum("n").alias("n")).first().n or 0

    ranked = exact_rank(rows, ["turn", "doc_id", "size"], "nth", ["source"])
    share = (F.col("nth") - F.lit(0.5)) / F.col("of")
    spaced = lookup(ranked, counts, ["source"], ["turn"], how="inner").withColumn("share", share).drop("nth", "of", "turn")
    spaced = settle(spaced, "shard-shares", rows)
    ordered = exact_rank(spaced, ["share", "source"], "at").withColumn("at", F.col("at") - 1)
    shard = F.expr(f"at * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    placed = ordered.withColumn("shard", shard).withColumn("slot", F.col("at") - first)
    placed = settle(placed.withColumn("shard", F.col("shard").cast("int")).drop("at", "share"), "shard-places", spaced)
    release(counts)
    return placed


def placements(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size (UTF-8 bytes + 1), text_crc32, shard, slot (from 0 in each shard)."""
    return _place(_narrow(docs), shards, seed)


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot``; columns of these names are replaced.

    The rows are numbered in a written table, so that repeated rows find each its own place again.
    """
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    numbered = settle(docs.select(whole, F.monotonically_increasing_id().alias("uid")), "shard-numbered")
    named = numbered.select("row.doc_id", "row.source", "row.text", "uid")
    places = _place(_narrow(named, "uid"), shards, seed).select("uid", "shard", "slot")
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return numbered.join(places, "uid").select(*kept, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 17) -> None:
    """One folder ``shard=N`` a shard, its rows sorted by slot over one or more files."""
    placed = shard_documents(docs, shards, seed).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.write.partitionBy("shard").parquet(path)
