"""The trie of conversation prefixes, with a count-min sketch that keeps unshared tails out of the shuffle.

A turn is a 128-bit digest of role and text with its number of words; a prefix is the digest of its parent prefix and
its last turn. Texts are not exchanged.

1. Tasks read the turns of each conversation in order and chain their digests.
2. A count-min sketch counts the prefixes; its cells stop at two and are kept as two bit planes, so it has a fixed size. Each
   task fills its own, blocks of cells are merged by Spark, and the cells that reached two go to all tasks.
3. A prefix of estimate one has one member: its node is written at once. Only possibly shared prefixes are exchanged,
   grouped by digest and counted exactly, so an estimate that is too high costs work, not truth.
4. Sums over subtrees need no walk by depth: each node is counted at its smallest member, members sum the nodes that are
   theirs from the end of the conversation upwards, and a node's sums are those of its members.
5. The members that end in a node are listed in order in pieces of range-partitioned rows; pieces are hashed in order.

Turns are taken by ``turn`` (nulls first; turns of one number by digest), null roles and texts are empty. Rows without a
conv_id are one conversation without a number: a member that neither names a node nor is listed. Equal turns, repeated
rows and long conversations are turns like any other. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from foldspark.llm.tables import settle
from foldspark.llm.text import words
from foldspark.operators.skew import lookup

SKETCH_ROWS = 4
SKETCH_BITS = (16, 24)  # log2 of the least and greatest width; at 24 the sent plane has 8 MB
BLOCK = 1 << 13  # cells of a merged block
BATCH = 8192
PIECE = 10_000  # members listed in one record
ROOT = bytes(16)
NO_ENDS = hashlib.sha256().hexdigest()


def _typed(table: DataFrame, ddl: str, *own: str) -> StructType:
    fields = [StructField(c, table.schema[c].dataType) for c in own]
    return StructType([*fields, *StructType.fromDDL(ddl).fields])


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, part (0), turn, mark (16 bytes), n_words of every row, and a row without a mark for every conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.select(
        "conv_id", F.lit(0).alias("part"), F.col("turn").cast("bigint").alias("turn"), mark.alias("mark"),
        F.size(words(text)).cast("bigint").alias("n_words"),
    )
    none = {"part": F.lit(-1), "turn": F.lit(None).cast("bigint"), "mark": F.lit(None).cast("binary"), "n_words": F.lit(0).cast("bigint")}
    return turns.unionByName(conversations.select("conv_id").distinct().withColumns(none))


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """The turns (``turn_digests``) of conversations that begin like another: the first h turns of conversation c are
    those of c - c % ``every`` (all if it has fewer, none if it is absent), then follow its own after the first h; h is the
    CRC-32 of the decimal c, modulo ``heads``. A conversation without a number stays as it is."""
    turns = settle(turns, "trie-turns")
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads, F.lit(0))
    ids = turns.where("part < 0")
    order = Window.partitionBy("conv_id").orderBy("turn", "mark")
    placed = turns.where("part = 0").withColumn("at", F.row_number().over(order) - 1)
    own = placed.where(F.col("at") >= h).drop("at")
    first = turns.where(f"part = 0 AND conv_id % {every} = 0").withColumn("at", F.row_number().over(order) - 1)
    first = first.where(F.col("at") < heads - 1).withColumnRenamed("conv_id", "base")
    borrowers = ids.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")).where("h > 0")
    # a base has at most ``every`` borrowers and ``heads - 1`` turns
    lent = borrowers.join(first, "base").where("at < h").select("conv_id", F.lit(-1).alias("part"), "turn", "mark", "n_words")
    return ids.unionByName(lent).unionByName(own)


def _chain(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One record a prefix of every conversation: conv_id, depth, prefix, parent, n_words, last."""

    def prefixes() -> Iterator[tuple]:
        for conv, rows in groupby(_records(batches), key=lambda r: r[0]):
            depth, prefix, parent, n_words = 0, ROOT, None, 0
            for _, mark, n in rows:
                if mark is not None:
                    yield conv, depth, prefix, parent, n_words, False
                    depth, parent, n_words = depth + 1, prefix, n
                    prefix = hashlib.blake2b(parent + mark, digest_size=16).digest()
            yield conv, depth, prefix, parent, n_words, True

    return _batched(prefixes(), schema)


def chained(turns: DataFrame) -> DataFrame:
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "mark")
    schema = _typed(turns, "depth int, prefix binary, parent binary, n_words bigint, last boolean", "conv_id")
    arrow = to_arrow_schema(schema)
    return dealt.select("conv_id", "mark", "n_words").mapInArrow(lambda batches: _chain(batches, arrow), schema)


# ---- count-min sketch ------------------------------------------------------------------------


def cells(digests: pa.Array, bits: int) -> np.ndarray:
    """Cell of every digest in each row of the sketch: double hashing of the digest's two halves."""
    halves = np.frombuffer(b"".join(digests.to_pylist()), dtype="<u8").reshape(-1, 2)
    row = np.arange(SKETCH_ROWS, dtype=np.uint64)[:, None]
    at = (halves[:, 0][None, :] + row * (halves[:, 1] | np.uint64(1))[None, :]) >> np.uint64(64 - bits)
    return at + (row << np.uint64(bits))


def _fill(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of this task's sketch that are not empty, as bit planes of the cells above 0 and above 1."""
    counts = np.zeros(SKETCH_ROWS << bits, dtype=np.uint8)
    for batch in batches:
        if batch.num_rows:
            found, n = np.unique(cells(batch.column(0), bits), return_counts=True)
            counts[found] = np.minimum(counts[found] + np.minimum(n, 2), 2)
    blocks = counts.reshape(-1, BLOCK)
    for i in np.flatnonzero(blocks.any(axis=1)):
        some, more = (np.packbits(blocks[i] > k).tobytes() for k in (0, 1))
        yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "some": [some], "more": [more]})


def _merge(blocks):
    some, more = (np.frombuffer(b"".join(blocks[c]), np.uint8).reshape(len(blocks), -1) for c in ("some", "more"))
    seen, twice = some[0], more[0]
    for s, m in zip(some[1:], more[1:]):
        twice = twice | m | (seen & s)
        seen = seen | s
    import pandas as pd

    return pd.DataFrame({"block": blocks["block"][:1], "twice": [twice.tobytes()]})


def shared_cells(prefixes: DataFrame, bits: int) -> np.ndarray:
    """Bit plane of the cells that count two or more prefixes: SKETCH_ROWS * 2**bits bits, whatever the data."""
    filled = prefixes.select("prefix").mapInArrow(lambda b: _fill(b, bits), "block int, some binary, more binary")
    merged = filled.groupBy("block").applyInPandas(_merge, "block int, twice binary")  # a record of 2 KB a task
    plane = np.zeros((SKETCH_ROWS << bits) // BLOCK * (BLOCK // 8), dtype=np.uint8).reshape(-1, BLOCK // 8)
    for row in merged.toLocalIterator():
        plane[row.block] = np.frombuffer(row.twice, np.uint8)
    return plane.ravel()


def _screen(batches: Iterator[pa.RecordBatch], plane: np.ndarray, bits: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Add whether the estimates of a prefix and of its parent are above one; a root's always is."""

    def above_one(digests: pa.Array) -> np.ndarray:
        filled = digests.fill_null(ROOT)
        at = cells(filled, bits)
        hit = (plane[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1
        roots = np.asarray(pa.compute.equal(filled, pa.scalar(ROOT, filled.type)))
        return hit.all(axis=0) | roots

    for batch in batches:
        if batch.num_rows:
            flags = [pa.array(above_one(batch.column(c))) for c in ("prefix", "parent")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *flags], schema=schema)


def screened(prefixes: DataFrame, bits: int | None = None) -> DataFrame:
    """``prefixes`` with ``shared`` and ``parent_shared``; the width follows the counted prefixes up to a bound."""
    if bits is None:
        bits = min(max(prefixes.count().bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    plane = prefixes.sparkSession.sparkContext.broadcast(shared_cells(prefixes, bits))
    schema = StructType([*prefixes.schema.fields, *StructType.fromDDL("shared boolean, parent_shared boolean").fields])
    arrow = to_arrow_schema(schema)
    return prefixes.mapInArrow(lambda batches: _screen(batches, plane.value, bits, arrow), schema)


# ---- nodes -----------------------------------------------------------------------------------


def _list(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Runs of the members of a node in a sorted partition, joined by commas."""

    def runs() -> Iterator[tuple]:
        for prefix, rows in groupby(_records(batches), key=lambda r: r[0]):
            held = []
            for _, conv in rows:
                if len(held) == PIECE:
                    yield prefix, held[0], ",".join(map(str, held))
                    held = []
                held.append(conv)
            yield prefix, held[0], ",".join(map(str, held))

    return _batched(runs(), schema)


def _digest(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def nodes() -> Iterator[tuple]:
        for prefix, pieces in groupby(_records(batches), key=lambda r: r[0]):
            digest, comma = hashlib.sha256(), b""
            for _, listed in pieces:
                digest.update(comma + listed.encode())
                comma = b","
            yield prefix, digest.hexdigest()

    return _batched(nodes(), schema)


def end_hashes(ends: DataFrame) -> DataFrame:
    """``prefix, ends_sha256`` of (prefix, conv_id): the members in order, comma-joined.

    A node's members are listed by as many tasks as they need; one task reads the pieces of a node one by one.
    """
    ranged = ends.repartitionByRange("prefix", "conv_id").sortWithinPartitions("prefix", "conv_id")
    listed_schema = StructType([*StructType.fromDDL("prefix binary").fields, StructField("first", ends.schema["conv_id"].dataType), *StructType.fromDDL("listed string").fields])
    arrow = to_arrow_schema(listed_schema)
    listed = ranged.select("prefix", "conv_id").mapInArrow(lambda b: _list(b, arrow), listed_schema)
    schema = StructType.fromDDL("prefix binary, ends_sha256 string")
    out = to_arrow_schema(schema)
    pieces = listed.repartition("prefix").sortWithinPartitions("prefix", "first").select("prefix", "listed")
    return pieces.mapInArrow(lambda b: _digest(b, out), schema)


def trie_of(turns: DataFrame, bits: int | None = None) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prefixes = settle(chained(turns), "trie-prefixes")
    tried = settle(screened(prefixes, bits), "trie-screened", prefixes)

    # tails: nodes with one member, known without an exchange unless the parent may be shared
    alone = tried.where("NOT shared")
    text = F.when(F.col("last") & F.col("conv_id").isNotNull(), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NO_ENDS)
    one = F.lit(1).cast("bigint")
    single = {
        "n_convs": one, "n_children": F.when(F.col("last"), 0).otherwise(1).cast("bigint"), "n_leaves": one,
        "saved_tokens": F.lit(0).cast("bigint"), "ends_sha256": text,
    }
    keep = ["conv_id", "depth", "parent_conv_id", *single]
    tails = alone.where("NOT parent_shared").withColumn("parent_conv_id", F.col("conv_id")).withColumns(single).select(*keep)

    # exact counts of what may be shared
    shared = tried.where("shared")
    exact = shared.groupBy("prefix").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("first"), F.sum(F.col("last").cast("bigint")).alias("n_ends")
    )
    exact = settle(exact.withColumn("n", F.col("n_convs")), "trie-exact")
    known = lookup(shared.drop("shared"), exact, ["prefix"], ["conv_id"], how="inner")
    stubs = alone.where("parent_shared").drop("shared").withColumns({"n_convs": one, "first": F.col("conv_id"), "n_ends": F.lit(None).cast("bigint")})
    rows = known.unionByName(stubs).withColumn("stub", F.col("n_ends").isNull())

    conv = Window.partitionBy("conv_id")
    by_depth = conv.orderBy("depth")
    below = conv.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    mine = F.col("first").eqNullSafe(F.col("conv_id"))
    next_here = F.lead("depth").over(by_depth) == F.col("depth") + 1
    at_end = F.col("last") & ~F.col("stub") & mine & (F.col("n_convs") == F.col("n_ends"))
    rows = rows.withColumn("mine", mine)
    rows = rows.withColumns(
        {
            "parent_conv_id": F.when(F.col("parent_shared"), F.lag("first").over(by_depth)).otherwise(F.col("conv_id")),
            "child": (next_here & F.lead("mine").over(by_depth)).cast("bigint"),
            # one leaf at most: the end of the conversation, if no other has it first or goes on from it
            "leaf": F.max((F.col("stub") | at_end).cast("bigint")).over(conv),
            "saved": F.sum(F.when(F.col("mine"), (F.col("n_convs") - 1) * F.col("n_words")).otherwise(0)).over(below),
        }
    )
    rows = settle(rows.drop("parent", "parent_shared", "n_ends", "n_words"), "trie-rows", exact)

    heads = rows.where("stub").withColumns(single).select(*keep)
    own = F.col("mine")
    nodes = rows.where("NOT stub").groupBy("prefix").agg(
        F.min("first").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.max(F.when(own & (F.col("depth") > 0), F.col("parent_conv_id"))).alias("parent_conv_id"),
        F.first("n_convs").alias("n_convs"),
        F.coalesce(F.sum("child"), F.lit(0)).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    ends = end_hashes(rows.where("NOT stub AND last AND conv_id IS NOT NULL").select("prefix", "conv_id"))
    nodes = nodes.join(ends, "prefix", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    out = tails.unionByName(heads).unionByName(nodes.select(*keep))
    out = settle(out.withColumn("depth", F.col("depth").cast("bigint")), "trie-nodes", rows, tried)
    return out


def prefix_trie(conversations: DataFrame, bits: int | None = None) -> DataFrame:
    """The trie of ``conversations`` as they are."""
    return trie_of(turn_digests(conversations), bits)


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Role and text of each node's last turn, read from its smallest member; the root has none."""
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    free = {c: F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")}
    turns = conversations.select("conv_id", "turn", "role", "text").withColumns(free)
    order = Window.partitionBy("conv_id").orderBy("turn", key)
    named = turns.withColumn("depth", F.row_number().over(order)).select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth"), "role", "text")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("depth") == F.col("_depth"))
    return nodes.join(named, same, "left").drop("_conv", "_depth")
