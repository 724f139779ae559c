"""Log-likelihood of whole documents under a recurrent language model.

Texts are cut into words once, and their hashes kept for the steps that follow. Counts are gathered from all learned
texts. The commonest words are the symbols of the model; any other word is the symbol for unknown words times its
share among them, so every text has a probability. Tasks train copies of the model
on their documents and the weights are averaged by tokens, for ``PASSES`` rounds that share out all learned documents. Rare words, whose number grows
with the corpus, are joined with their counts; only a bounded number of common ones is sent to the tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm import gru
from foldspark.llm.tables import fold_of, settle
from foldspark.llm.text import ascii_lower, words

SYMBOLS = 2_000  # words of the model
COMMON = 65_536  # words whose counts are sent to the tasks
CLASSES = 40
PASSES = 2  # each learned document trains the network in one of them
LEAST_TOKENS = 200_000  # a task repeats its documents until it has read so many
PIECE = 4_096  # weights averaged as one vector
LEAD = 20  # first bits of a hash that say where among the common words it would be


def _words() -> Column:
    return words(ascii_lower(F.coalesce("text", F.lit(""))))


def _tokens(docs: DataFrame) -> DataFrame:
    """(k, doc_id, h): hashes of the words; k tells documents apart when training ones are drawn."""
    return docs.select(F.xxhash64("doc_id", "text").alias("k"), "doc_id", F.transform(_words(), lambda x: F.xxhash64(x)).alias("h"))


def class_cuts(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Bounds of the classes: the end and the unknown word alone, then words by equal sums of root counts."""
    root = np.sqrt(counts[2:])
    inner = np.zeros(0, np.int64)
    if len(root):
        level = np.cumsum(root) / root.sum()
        inner = 2 + np.unique(np.searchsorted(level, np.arange(1, classes) / classes))
    return np.unique(np.concatenate([[0, 1, 2], inner, [len(counts)]]))


class Vocabulary:
    """Hashes of common words in ascending order, their counts, and their symbols (1: not in the model)."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, texts: int, tokens: int, distinct: int):
        symbols = min(SYMBOLS, len(hashes))
        self.symbol_counts = np.concatenate([[texts, max(0, tokens - texts - counts[:symbols].sum())], counts[:symbols]]).astype(float)
        self.cuts = class_cuts(self.symbol_counts)
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.symbols = np.where(order < symbols, order + 2, 1).astype(np.int32)
        self.weights = np.log10(self.counts + 0.1)
        leads = np.arange(-(1 << (LEAD - 1)), (1 << (LEAD - 1)) + 1)
        self.starts = np.searchsorted(self.hashes >> (64 - LEAD), leads).astype(np.int32)
        self.alike = int(np.diff(self.starts).max())  # most words with one lead
        self.texts, self.tokens = texts, tokens
        self.norm = math.log10(tokens + 0.1 * (distinct + 1))
        rest = distinct - (texts > 0) - symbols
        self.rest_norm = math.log10(self.symbol_counts[1] + 0.1 * (rest + 1))

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, log10 of the smoothed count, whether it is common) of each hash; the second is 0 where it is not."""
        if not len(self.hashes):
            return np.ones(len(h), np.int32), np.zeros(len(h)), np.zeros(len(h), bool)
        lead = (h >> (64 - LEAD)) + (1 << (LEAD - 1))
        at = np.minimum(self.starts[lead], np.int32(len(self.hashes) - 1))
        common = self.hashes[at] == h
        for i in range(1, self.alike):  # words with the lead of an earlier one
            left = np.flatnonzero(~common)
            here = self.starts[lead[left]] + i
            more = here < self.starts[lead[left] + 1]
            left, here = left[more], here[more]
            found = self.hashes[here] == h[left]
            at[left[found]], common[left[found]] = here[found], True
        return np.where(common, self.symbols[at], np.int32(1)), np.where(common, self.weights[at], 0.0), common


def _joined(lists) -> tuple[np.ndarray, np.ndarray]:
    """(flat hashes, lengths)"""
    lengths = np.array([len(x) for x in lists], np.int64)
    return (np.concatenate(list(lists)).astype(np.int64, copy=False) if len(lists) else np.zeros(0, np.int64)), lengths


def _ended(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The symbols of the texts, each followed by 0."""
    out = np.zeros(len(symbols) + len(lengths), np.int32)
    word = np.ones(len(out), bool)
    word[np.cumsum(lengths + 1) - 1] = False
    out[word] = symbols
    return out


def _trainer(vocabulary: Vocabulary, net: gru.Net):
    def learn(batches):
        parts = []
        for frame in batches:
            h, lengths = _joined(frame["h"])
            parts.append(_ended(vocabulary.look_up(h)[0], lengths))
        stream = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        if len(stream):
            repeats = -(-LEAST_TOKENS // len(stream))
            trained = gru.flat(gru.train(net, vocabulary.cuts, np.tile(stream, repeats)))
            for i in range(0, len(trained), PIECE):
                yield pd.DataFrame({"piece": [i], "tokens": [float(len(stream))], "w": [trained[i : i + PIECE].astype(float)]})

    return learn


def _train(tokens: DataFrame, vocabulary: Vocabulary) -> gru.Net:
    net = gru.start(vocabulary.symbol_counts, vocabulary.cuts)
    for number in range(PASSES):
        turn = F.pmod(F.xxhash64("k", F.lit("pass")), F.lit(PASSES)) == number
        trained = tokens.where(turn).select("h").mapInPandas(_trainer(vocabulary, net), "piece long, tokens double, w array<double>")
        mean = Summarizer.mean(array_to_vector("w"), F.col("tokens"))
        averaged = trained.groupBy("piece").agg(vector_to_array(mean).alias("w")).orderBy("piece").collect()  # one model
        if averaged:
            net = gru.shaped(np.concatenate([r.w for r in averaged]), net)
    return net


def _scorer(vocabulary: Vocabulary, net: gru.Net):
    def score(batches):
        for frame in batches:
            h, lengths = _joined(frame["h"])
            symbols, weight, common = vocabulary.look_up(h)
            n = len(lengths)
            owner = np.repeat(np.arange(n, dtype=np.int32), lengths)
            rare = np.split(h[~common], np.cumsum(np.bincount(owner[~common], minlength=n))[:-1]) if n else []
            del h  # a batch has millions of words
            model = gru.score(net, vocabulary.cuts, _ended(symbols, lengths), lengths + 1) / math.log(10)
            unknown = symbols == 1
            end = math.log10(vocabulary.texts + 0.1)
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    "n_tokens": lengths + 1,
                    "common": np.bincount(owner, common, n).astype(np.int64) + (vocabulary.texts > 0),
                    "base": np.bincount(owner, weight, n) + end - (lengths + 1) * vocabulary.norm,
                    "model": model + np.bincount(owner, weight * unknown, n) - np.bincount(owner, unknown, n) * vocabulary.rest_norm,
                    "rare": rare,
                }
            )

    return score


def score_documents(docs: DataFrame, folds: int = 10, held_out: int = 0) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words with A-Z lower-cased and one end; null texts are empty. Documents outside the held-out fold
    (crc32 of the id; null ids belong to fold 0) are learned from. Repeated rows count as often as they occur and get the
    same scores. If nothing can be learned, every word is unknown.
    """
    fold = fold_of(F.col("doc_id"), folds) == held_out
    tokens = settle(_tokens(docs), "lm-tokens")
    learned = tokens.where(~fold)
    counts = settle(learned.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("c")), "lm-counts")
    texts = learned.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(COMMON).toPandas()
    total = int(sums.n) + texts
    vocabulary = Vocabulary(top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64), texts, total, int(sums.v) + (texts > 0))
    net = _train(learned, vocabulary)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, common long, base double, model double, rare array<long>"
    scored = tokens.drop("k").mapInPandas(_scorer(vocabulary, net), schema)
    scored = settle(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored", tokens)  # stable once written
    rare = scored.select("row", F.explode("rare").alias("h")).join(counts, "h", "left")
    known = F.coalesce("c", F.lit(0))
    weight = F.sum(F.log10(known + F.lit(0.1)))
    parts = rare.groupBy("row").agg(weight.alias("w"), F.count_if(known > 0).alias("seen"))
    joined = scored.drop("rare").join(parts, "row", "left")
    w = F.coalesce("w", F.lit(0.0))
    return joined.select(
        "doc_id",
        (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "n_tokens",
        (F.col("common") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + w).alias("base_score"),
        (F.col("model") + w).alias("score"),
    )
