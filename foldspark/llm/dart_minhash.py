"""Near-duplicate documents by DartMinHash over weighted word shingles.

A shingle that occurs x times is a region of height x, cut into cells of height one. Hashed darts fall on every
cell at the arrival times of a Poisson process (their ranks) and each hits one of ``k`` coordinates; a dart above
the height of a partial cell misses. A document keeps the earliest dart of each coordinate: two documents agree in
a coordinate with probability equal to their weighted Jaccard similarity. Only darts with rank below
k (ln k + 4) / weight are thrown, about as many for a long text as for a short one; where a coordinate stays empty,
the bound is raised. Coordinates are joined in bands, and candidate pairs are verified exactly on their cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.linking import link, shared_blocks
from foldspark.llm.tables import attach, bounded, join_documents, settle, with_key
from foldspark.llm.text import span_hashes, words
from foldspark.session import release

SHINGLE = 5
SIZES = 1.05  # ratio of neighbouring classes of set sizes
CHUNK = 400_000  # cells worked on at once (a single longer text is worked on alone)


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / 2**53


def unit_cells(owner: np.ndarray, element: np.ndarray) -> np.ndarray:
    """A cell for every occurrence of an element: the j-th occurrence in a text has the same cell everywhere.

    ``owner`` ascends; cells come back in the order of the owners.
    """
    order = np.lexsort((element, owner))
    e, o = element[order], owner[order]
    at = np.arange(len(e))
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (o[1:] != o[:-1])
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix64(e.view(np.uint64) ^ mix64(nth, 7))


def dart_signatures(
    owner: np.ndarray, cell: np.ndarray, owners: int, k: int, height: np.ndarray | None = None
) -> np.ndarray:
    """Array (owners, k) of the earliest dart of each coordinate. Every owner has a cell of positive height.

    ``height`` in (0, 1] holds the part of each cell inside the weight; whole cells by default.
    """
    signature = np.zeros((owners, k), np.uint64)
    total = np.bincount(owner, height, owners) if height is not None else np.bincount(owner, minlength=owners)
    bound = k * (math.log(k) + 4) / np.maximum(total, 1e-300)
    todo = np.ones(owners, bool)
    while todo.any():
        pick = todo[owner]
        o, c, h = owner[pick], cell[pick], None if height is None else height[pick]
        rank, thrown = np.zeros(len(o)), []
        n = 0
        while len(o):
            seed = mix64(c, 3 * n + 11)
            rank = rank - np.log(unit(seed))
            alive = rank < bound[o]
            o, c, rank, seed = o[alive], c[alive], rank[alive], seed[alive]
            h = None if h is None else h[alive]
            dart = mix64(seed, 1)
            hit = slice(None) if h is None else unit(mix64(seed, 2)) <= h
            thrown.append((o[hit], rank[hit], dart[hit]))
            n += 1
        to, ranks, darts = (np.concatenate(x) for x in zip(*thrown, strict=True))
        place = to * k + (darts % np.uint64(k)).astype(np.int64)
        order = np.lexsort((ranks, place))
        place, darts = place[order], darts[order]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        full = np.bincount(place[first] // k, minlength=owners) == k
        done = first & full[place // k]
        signature.reshape(-1)[place[done]] = darts[done]
        todo &= ~full
        bound = bound * 4
    return signature


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key a band from its coordinates."""
    rows = signature.reshape(len(signature), bands, -1)
    key = np.broadcast_to(mix64(np.arange(bands), 5), rows.shape[:2])
    for r in range(rows.shape[2]):
        key = mix64(key ^ rows[:, :, r], r)
    return key.view(np.int64)


def _chunks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > CHUNK or i - start >= 1000:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths):
        yield start, len(lengths)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("h")
    offsets = column.offsets.to_numpy()
    return offsets, column.values.to_numpy(zero_copy_only=False)


def _signer(k: int, bands: int):
    def sign(batches):
        for batch in batches:
            offsets, values = _lists(batch)
            lengths = np.diff(offsets)
            keys = []
            for start, end in _chunks(lengths):
                owner = np.repeat(np.arange(end - start), lengths[start:end])
                cell = unit_cells(owner, values[offsets[start] : offsets[end]])
                keys.append(band_keys(dart_signatures(owner, cell, end - start, k), bands))
            flat = np.concatenate(keys).reshape(-1) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, bands, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "bands"])

    return sign


def _celled(batches):
    for batch in batches:
        offsets, values = _lists(batch)
        lengths = np.diff(offsets)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        cells = unit_cells(owner, values[offsets[0] : offsets[-1]]).view(np.int64)
        lists = pa.ListArray.from_arrays((offsets - offsets[0]).astype(np.int32), cells)
        yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "cells"])


def _shingled(rows: DataFrame) -> DataFrame:
    """(k, doc_id, id, n, h): the id of the word sequence, its number of words and its shingle hashes."""
    cut = rows.withColumn("ws", words(F.lower("text"))).withColumn("n", F.size("ws"))
    whole: Column = F.when(F.col("n") > 0, F.array(F.xxhash64("ws"))).otherwise(F.array().cast("array<bigint>"))
    spans = F.when(F.col("n") >= SHINGLE, span_hashes("ws", "n", SHINGLE)).otherwise(whole)
    return cut.select("k", "doc_id", F.xxhash64("ws").alias("id"), "n", spans.alias("h"))


def prefix_pairs(cells: DataFrame, left: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the ids in ``left`` (id, label) with different labels, among them all that are similar.

    Cells are ordered from the rarest to the commonest. Similar sets share one of their first cells, as many as may
    be missing from the intersection; so only rare cells are joined, and those common to a whole group of copies are
    not, unless the two sets can still be similar from there on. The longer set of a pair is looked up in every class
    of sizes that the shorter one may have, with the first cells that this class asks for.
    """
    part = similarity / (1 + similarity)

    def common(x, y) -> Column:
        return F.ceil((x + y) * F.lit(part) - 1e-6).cast("int")

    def size_class(n) -> Column:
        return F.floor(F.log(n) / math.log(SIZES) + 1e-9).cast("int")

    mine = cells.join(bounded(left), "id").select("id", "label", F.size("cells").alias("n"), F.explode("cells").alias("cell"))
    often = settle(mine.groupBy("cell").agg(F.count("*").alias("f")).where("f > 1"), "cell-counts")
    sets = mine.join(often, "cell").groupBy("id", "label", "n").agg(F.sort_array(F.collect_list(F.struct("f", "cell"))).alias("c"))
    # cells of no other set come first; nothing can meet there
    sets = settle(sets.withColumn("alone", F.col("n") - F.size("c")), "cell-order", often)

    def firsts(least: Column) -> Column:
        """(cell, place) of the first cells if at least ``least`` must be in common."""
        some = F.slice("c", 1, F.greatest(F.col("n") - least + 1 - F.col("alone"), F.lit(0)))
        return F.transform(some, lambda x, i: F.struct(x["cell"].alias("cell"), (i + F.col("alone")).alias("p")))

    shorter = sets.select("id", "label", "n", size_class(F.col("n")).alias("s"), F.explode(firsts(common(F.col("n"), F.col("n")))).alias("x"))
    low = F.ceil(F.col("n") * similarity - 1e-6).cast("int")
    longer = sets.select("*", F.explode(F.sequence(size_class(low), size_class(F.col("n")))).alias("s"))
    least = F.greatest(low, F.floor(F.pow(F.lit(SIZES), F.col("s"))).cast("int"))
    longer = longer.select("id", "label", "n", "s", F.explode(firsts(common(F.col("n"), least))).alias("x"))
    one = shorter.select(F.col("id").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), "s", "x.cell", F.col("x.p").alias("pa"))
    two = longer.select(F.col("id").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("s").alias("sb"), F.col("x.cell").alias("cb"), F.col("x.p").alias("pb"))
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= common(F.col("na"), F.col("nb"))
    met = (F.col("cell") == F.col("cb")) & (F.col("s") == F.col("sb")) & (F.col("la") != F.col("lb"))
    return one.join(two, met & order & reach).select("a", "b")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = 16, rows: int = 4) -> DataFrame:
    """One row a document: k, doc_id, class_id, class_size, first.

    Documents whose lower-cased words are equal are copies; others are linked when the weighted Jaccard similarity
    of their 5-word shingles (weight: occurrences; a text of fewer words is one shingle) is at least ``similarity``.
    Classes are the connected groups; ``class_id`` is the smallest doc_id in the class (a null id comes last) and
    ``first`` marks that document. Texts without words (null, empty) are classes of their own. Rows equal in id and
    text are one document and all marked. A pair of similarity s shares a band with probability
    1 - (1 - s**rows)**bands: 0.9998 at 0.8 by default.
    """
    keyed = with_key(docs)
    shingled = _shingled(keyed)
    names = settle(shingled.select("k", "doc_id", "id", "n"), "dart-ids")
    signed = shingled.where("n > 0").select("id", "h").mapInArrow(_signer(bands * rows, bands), "id bigint, bands array<bigint>")
    signed = settle(signed, "dart-bands")
    signed = settle(signed.groupBy("id").agg(F.any_value("bands").alias("bands")), "dart-texts-bands", signed)
    live = shared_blocks(signed.select(F.explode("bands").alias("block"), "id"))
    release(signed)

    texts = names.where("n > 0").groupBy("id").agg(F.min(_order()).alias("first"), F.count("*").alias("copies"))
    texts = settle(texts.select("id", "first.*", "copies"), "dart-texts")
    wanted = texts.join(bounded(settle(live.select("id"), "dart-live")), "id", "left_semi")
    wanted = bounded(settle(wanted.select("k", "doc_id"), "dart-wanted"))
    lists = _shingled(join_documents(keyed, wanted, "left_semi")).dropDuplicates(["id"]).select("id", "h")
    cells = settle(lists.mapInArrow(_celled, "id bigint, cells array<bigint>"), "dart-cells")

    # cells that no other candidate has can be in no intersection
    own = cells.select("id", F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"), F.any_value("id").alias("id"))
    own = settle(own.where("n = 1").groupBy("id").agg(F.count("*").alias("own")), "dart-own")
    facts = cells.select("id", F.size("cells").alias("n")).join(own, "id", "left")
    facts = settle(facts.select("id", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common")), "dart-facts")

    def possible(x: str, y: str) -> Column:
        most = F.least(f"{x}common", f"{y}common")
        return most >= similarity * (F.col(f"{x}n") + F.col(f"{y}n") - most)

    def verify(pairs: DataFrame) -> DataFrame:
        one = cells.select(F.col("id").alias("a"), F.col("cells").alias("x"))
        two = cells.select(F.col("id").alias("b"), F.col("cells").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        joined = pairs.join(two, "b").join(one, "a")
        return joined.where(both >= similarity * (F.size("x") + F.size("y") - both))

    def rest(left: DataFrame) -> DataFrame:
        return prefix_pairs(cells, left, similarity)

    classes = link(live, verify, facts, possible, rest=rest)
    reps = texts.join(bounded(classes).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    firsts = reps.groupBy("root").agg(F.min(_order()).alias("first"), F.sum("copies").alias("class_size"))
    # a class of one text needs no second look
    by_text = settle(reps.select("id", "root").join(firsts.select("root", "first", "class_size"), "root"), "dart-classes")
    by_text = by_text.select("id", F.col("first.k").alias("first_k"), F.col("first.doc_id").alias("class_id"), "class_size")
    found = names.where("n > 0").join(by_text, "id")
    first = (F.col("k") == F.col("first_k")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    found = found.select("k", "doc_id", "class_id", "class_size", first.alias("first"))
    alone = names.where("n = 0").select("k", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(True).alias("first"))
    return found.unionByName(alone)


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("k"))


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with the first document of every class, all columns kept; of repeated rows one stays."""
    found = settle(near_duplicates(docs, **parameters), "dart-found")
    gone = settle(found.where("not first").select("k", "doc_id", F.lit(True).alias("gone")).distinct(), "dart-gone")
    kept = attach(docs, bounded(gone)).where("gone is null").select("row.*")
    firsts = found.where("first and class_size > 1").groupBy("k", "doc_id").agg(F.count("*").alias("c"))
    if firsts.where("c > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])
