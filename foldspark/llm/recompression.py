"""Repeated passages across documents by recompression.

Each round names maximal runs of a symbol and then pairs of a left and a right symbol, starting from words. Names are
64-bit hashes of what they stand for, so equal runs and pairs have one name in every document and partition without
an exchange of dictionaries. What is named inside a substring depends on few words around it: every symbol carries the
words it depends on, and two occurrences of a substring hold the same symbols wherever those words lie inside.

A window of ``span`` words is represented by one such symbol of the highest level that fits (of several, the one of
smallest name), together with the words it depends on. Equal windows have equal representatives; one that occurs in
several documents reveals possible repeats, and only the windows it stands for are verified, by hashes of all their words.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.dart_minhash import mix64
from foldspark.llm.tables import bounded, join_documents, settle, with_key
from foldspark.llm.text import bind, words
from foldspark.session import release

SPAN = 13
LEVELS = 2  # higher symbols depend on more words: fewer windows hold one whole, more are needed
CHUNK = 500_000  # words worked on at once (a single longer text is worked on alone)
PARTS = 3  # shares of the window hashes compared one after the other, which divides the disk of their exchanges
BASE = np.uint64(0x9E3779B97F4A7C55)  # odd

Level = tuple[np.ndarray, np.ndarray, np.ndarray]  # name, first and last + 1 word it depends on


def name_runs(level: Level) -> Level:
    """Replace every maximal run of a symbol by one; a run depends on the symbols beside it."""
    name, low, high = level
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    first = np.nonzero(new)[0]
    last = np.concatenate([first[1:], [len(name)]]) - 1
    length = last - first + 1
    named = np.where(length > 1, mix64(name[first] ^ mix64(length, 21), 22), name[first])
    return named, low[np.maximum(first - 1, 0)], high[np.minimum(last + 1, len(name) - 1)]


def name_pairs(level: Level, number: int) -> Level:
    """Replace a left symbol and the right symbol after it by one; a symbol's side is a bit of its hash.

    A left symbol that is not followed by a right one stays, which depends on the next symbol, and the reverse.
    """
    name, low, high = level
    right = (mix64(name, 31 + number) & np.uint64(1)).astype(bool)
    pair = np.zeros(len(name), bool)
    pair[:-1] = ~right[:-1] & right[1:]
    keep = np.ones(len(name), bool)
    keep[1:] = ~pair[:-1]
    at = np.nonzero(keep)[0]
    after, before = np.minimum(at + 1, len(name) - 1), np.maximum(at - 1, 0)
    paired = pair[at]
    named = np.where(paired, mix64(mix64(name[at], 23) ^ name[after], 24), name[at])
    new_low = np.where(~paired & right[at], low[before], low[at])
    return named, new_low, np.where(paired | ~right[at], high[after], high[at])


def prefix_hashes(words_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of all prefixes and the powers of the base, modulo 2**64."""
    with np.errstate(over="ignore"):
        power = np.concatenate([[np.uint64(1)], np.full(len(words_), BASE)]).astype(np.uint64)
        power = np.multiply.accumulate(power)
        inverse = np.uint64(pow(int(BASE), -1, 2**64))
        back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words_), inverse)]).astype(np.uint64))
        # sum of word * base**-i, scaled back when a piece is read
        sums = np.concatenate([[np.uint64(0)], np.add.accumulate(mix64(words_, 41) * back[1:])]).astype(np.uint64)
    return sums, power


def piece_hash(prefix: tuple[np.ndarray, np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of the words from ``low`` to ``high``, whatever their place."""
    sums, power = prefix
    with np.errstate(over="ignore"):
        return mix64((sums[high] - sums[low]) * power[low] + (high - low).astype(np.uint64), 42)


def representatives(stream: np.ndarray, starts: np.ndarray, span: int = SPAN, levels: int = LEVELS) -> np.ndarray:
    """Name of the representative of the window at each of ``starts``.

    ``stream`` holds the texts' words with a symbol of its own between texts, which no window contains.
    """
    at = np.arange(len(stream))
    level: Level = (stream, at, at + 1)
    stack = [level]
    for number in range(levels):
        level = name_pairs(name_runs(level), number)
        stack.append(level)
    prefix = prefix_hashes(stream)
    result = np.zeros(len(starts), np.uint64)
    todo = np.arange(len(starts))
    for name, low, high in reversed(stack):
        if not len(todo):
            break
        i = starts[todo]
        first = np.searchsorted(low, i)  # both bounds ascend with the symbols
        last = np.searchsorted(high, i + span, side="right") - 1
        fits = first <= last
        todo_now, first, last = todo[fits], first[fits], last[fits]
        full = mix64(piece_hash(prefix, low, high) ^ mix64(name, 51), 52)
        best = full[first] if len(first) else np.zeros(0, np.uint64)
        reach = int((last - first).max(initial=0))
        for step in range(1, reach + 1):
            other = full[np.minimum(first + step, last)]
            best = np.minimum(best, other)
        result[todo_now] = best
        todo = todo[~fits]
    return result


def _stream(values: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stream with separators, window starts in it, text of each window, place in its text)."""
    lengths = np.diff(offsets)
    n = len(lengths)
    owner = np.repeat(np.arange(n), lengths)
    stream = np.empty(len(values) + n + 1, np.uint64)
    begin = offsets[:-1] - offsets[0] + np.arange(n) + 1
    place = np.arange(len(values)) + owner + 1
    stream[place] = values.view(np.uint64)
    gaps = np.concatenate([[0], begin + lengths])
    stream[gaps] = mix64(np.arange(n + 1), 61)
    count = np.maximum(lengths - span + 1, 0)
    text = np.repeat(np.arange(n), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return stream, begin[text] + within, text, within


def _chunks(offsets: np.ndarray):
    start = 0
    for i in range(len(offsets) - 1):
        if i > start and offsets[i + 1] - offsets[start] > CHUNK:
            yield start, i
            start = i
    if len(offsets) > 1:
        yield start, len(offsets) - 1


def _namer(span: int, levels: int):
    """(k, doc_id, names): the different representatives of each text's windows."""

    def run(batches):
        for batch in batches:
            column = batch.column("h")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            flat, sizes = [], []
            for a, b in _chunks(offsets):
                stream, starts, text, _ = _stream(values[offsets[a] : offsets[b]], offsets[a : b + 1], span)
                names = representatives(stream, starts, span, levels)
                order = np.lexsort((names, text))
                names, text = names[order], text[order]
                new = np.ones(len(names), bool)
                new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
                flat.append(names[new])
                sizes.append(np.bincount(text[new], minlength=b - a))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else [])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, (np.concatenate(flat) if flat else np.zeros(0, np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("doc_id"), lists], names=["k", "doc_id", "names"])

    return run


def _windower(span: int, levels: int):
    """(k, doc_id, at, w, v): places and two hashes of the windows whose representative is among ``names``."""

    def run(batches):
        for batch in batches:
            column, wanted = batch.column("h"), batch.column("names")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            bounds, asked = wanted.offsets.to_numpy(), wanted.values.to_numpy(zero_copy_only=False).view(np.uint64)
            places, first, second, sizes = [], [], [], []
            for a, b in _chunks(offsets):
                stream, starts, text, within = _stream(values[offsets[a] : offsets[b]], offsets[a : b + 1], span)
                names = representatives(stream, starts, span, levels)
                # pairs (text, name) that were asked for
                owner = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
                keys = np.sort(mix64(asked[bounds[a] : bounds[b]] ^ mix64(owner, 71), 72))
                mine = mix64(names ^ mix64(text, 71), 72)
                near = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
                found = keys[near] == mine if len(keys) else np.zeros(len(mine), bool)
                prefix, other = prefix_hashes(stream), prefix_hashes(mix64(stream, 81))
                s = starts[found]
                places.append(within[found].astype(np.int32))
                first.append(piece_hash(prefix, s, s + span).view(np.int64))
                second.append((piece_hash(other, s, s + span) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                sizes.append(np.bincount(text[found], minlength=b - a))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else [])]).astype(np.int32)
            join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            lists = [pa.ListArray.from_arrays(ends, join(x, t)) for x, t in ((places, np.int32), (first, np.int64), (second, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("doc_id"), *lists], names=["k", "doc_id", "at", "w", "v"])

    return run


def repeated_windows(docs: DataFrame, span: int = SPAN, levels: int = LEVELS) -> DataFrame:
    """(k, doc_id, at): places of the windows that also start in a document with a smaller id.

    Documents with a null id are neither smaller nor larger than others: nothing is taken from them or for them.
    """
    keyed = with_key(docs).where("doc_id is not null")
    word_hashes = F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("h")
    hashed = keyed.select("k", "doc_id", word_hashes)
    kind = dict(docs.dtypes)["doc_id"]
    named = hashed.mapInArrow(_namer(span, levels), f"k long, doc_id {kind}, names array<long>")
    named = settle(named.withColumn("row", F.monotonically_increasing_id()), "names")  # stable once written
    single = named.select("row", "doc_id", F.explode("names").alias("name"))
    ends = single.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    shared = settle(ends.select("name"), "shared-names")
    asked = single.select("row", "name").join(bounded(shared), "name", "left_semi").groupBy("row").agg(F.collect_set("name").alias("names"))
    asked = settle(asked, "asked-rows", shared)
    asked = settle(named.select("row", "k", "doc_id").join(asked, "row").drop("row"), "asked", named, asked)
    # texts are exchanged, not their hashes: they compress
    again = join_documents(keyed, asked, "inner").select("k", "doc_id", "names", word_hashes)
    windows = again.mapInArrow(_windower(span, levels), f"k long, doc_id {kind}, at array<int>, w array<long>, v array<int>")
    windows = settle(windows, "windows", asked)
    each = windows.select("k", "doc_id", F.explode(F.arrays_zip("at", "w", "v")).alias("x")).select("k", "doc_id", "x.*")
    found = []
    for part in range(PARTS):
        some = each.where(F.pmod("w", F.lit(PARTS)) == part)
        first = some.groupBy("w", "v").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
        first = settle(first.select("w", "v", "low"), "first-windows")
        later = some.join(bounded(first), ["w", "v"]).where("doc_id > low")
        found.append(settle(later.groupBy("k", "doc_id").agg(F.collect_set("at").alias("at")), "repeats-part", first))
    release(windows)
    # a place has one hash, so the parts of a text have no place in common
    together = reduce(DataFrame.unionByName, found).groupBy("k", "doc_id").agg(F.flatten(F.collect_list("at")).alias("at"))
    return settle(together, "repeats", *found)


def remove_repeats(docs: DataFrame, span: int = SPAN, levels: int = LEVELS) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept (the words that stay, joined by a space).

    Null texts have no words. Rows equal in id and text are one document; rows of one id with different
    texts are judged each and never against each other. Other columns are ignored.
    """
    found = repeated_windows(docs, span, levels)
    # the places of one document; broadcast only when all of them together are few
    few = found.agg(F.coalesce(F.sum(F.size("at")), F.lit(0)).alias("n")).first().n <= 1_000_000
    rows = join_documents(with_key(docs), F.broadcast(found) if few else found)
    covered = F.flatten(F.transform(F.coalesce("at", F.array().cast("array<int>")), lambda p: F.sequence(p, p + span - 1)))
    rows = rows.select("doc_id", words(F.col("text")).alias("ws"), F.array_distinct(covered).alias("gone"))

    def rest(ws: Column) -> Column:
        places = F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.array_except(places, F.col("gone")), lambda i: F.get(ws, i))

    kept = F.when(F.size("gone") == 0, F.col("ws")).otherwise(bind(F.col("ws"), rest))
    return rows.select(
        "doc_id",
        F.size("ws").cast("bigint").alias("n_words"),
        F.size("gone").cast("bigint").alias("n_removed"),
        F.array_join(kept, " ").alias("kept"),
    )
