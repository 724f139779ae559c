"""Languages of a document as a mixture.

Every language is a distribution of character n-grams in hashed buckets, counted over all learned texts (through their
distinct words, so that a word is cut once). A document's words are drawn from a mixture of languages, each word
wholly from one; expectation-maximisation estimates the proportions from the words' n-gram likelihoods. Among the
nested sets of languages in the order of their proportions, the one with the best likelihood, penalised by
half a logarithm of the number of words for every further language, is selected.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.tables import fold_of
from foldspark.llm.text import words

GRAM = 3
BUCKETS = 1 << 15
ROUNDS = 12
CHUNK = 4_000_000  # characters worked on at once (a single longer text is worked on alone)


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word, start) of the n-grams of all words, maximal runs of letters in lower case.

    A word is framed by breaks, so that its beginning and end are in its n-grams; ``start`` holds the position
    of every word.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    code = np.where(letter, points, 0).astype(np.uint32)
    first = np.nonzero(letter[1:] & ~letter[:-1])[0] + 1
    number = np.cumsum(letter & ~np.concatenate([[True], letter[:-1]])) - 1
    # an n-gram belongs to the word of its middle letter
    middle = np.nonzero(letter)[0]
    h = code[middle - 1] * np.uint32(0x9E3779B1) ^ code[middle] * np.uint32(0x85EBCA6B) ^ code[middle + 1] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h = h * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17)).astype(np.int64) % BUCKETS, number[middle], first


def _counted(batches):
    """Counts of (lang, bucket) over distinct words with their numbers of occurrences."""
    for frame in batches:
        for lang, part in frame.groupby("lang"):
            # a word of mixed characters may hold several runs of letters; every run counts as often as the word
            joined = "\n".join(part["word"])
            bucket, _, _ = grams(joined)
            lowered = f" {joined.lower()} "
            points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
            line = np.cumsum(points == 10)
            weight = part["n"].to_numpy()[np.minimum(line[_letters()[points]], len(part) - 1)]
            total = np.bincount(bucket, weight, BUCKETS)
            at = np.nonzero(total)[0]
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at].astype(np.int64)})


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their log probabilities (BUCKETS, languages) from rows (text, lang).

    The table grows with the number of languages only.
    """
    told = rows.where("lang is not null").select("lang", F.explode(words(F.col("text"))).alias("word"))
    distinct = told.groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = distinct.mapInPandas(_counted, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most BUCKETS rows a language
    langs = sorted(found["lang"].unique())
    table = np.zeros((BUCKETS, len(langs)))
    index = {x: i for i, x in enumerate(langs)}
    table[found["bucket"].to_numpy(), found["lang"].map(index).to_numpy(dtype=int)] = found["n"].to_numpy()
    table = (table + 0.05) / (table + 0.05).sum(axis=0)
    return langs, np.log(table).astype(np.float32)


def mixtures(likelihood: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (owners, languages), zero outside the selected set, and the size of the set.

    ``likelihood`` holds the log likelihood of each word under each language; ``owner`` ascends.
    """
    count = np.bincount(owner, minlength=owners)
    top = likelihood.max(axis=1, keepdims=True)
    relative = np.exp(likelihood - top)
    base = np.bincount(owner, top[:, 0], owners)
    langs = likelihood.shape[1]
    single = np.stack([np.bincount(owner, likelihood[:, j], owners) for j in range(langs)], axis=1)
    chosen = np.zeros((owners, langs))
    chosen[np.arange(owners), single.argmax(axis=1)] = 1.0
    best = single.max(axis=1)
    if langs == 1:
        return chosen, np.ones(owners, int)

    def climb(rows: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log likelihood of the documents ``rows`` within the ``allowed`` languages."""
        place = np.full(owners, -1)
        place[rows] = np.arange(len(rows))
        mine = place[owner] >= 0
        r, o = relative[mine], place[owner[mine]]
        share = allowed / allowed.sum(axis=1, keepdims=True)
        n = np.maximum(count[rows], 1)[:, None]
        for _ in range(ROUNDS):
            joint = r * share[o]
            joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
            share = np.stack([np.bincount(o, joint[:, j], len(rows)) for j in range(langs)], axis=1) / n
        mixed = np.log(np.maximum((r * share[o]).sum(axis=1), 1e-300))
        return share, base[rows] + np.bincount(o, mixed, len(rows))

    penalty = 0.5 * np.log(np.maximum(count, 2))
    size = np.ones(owners, int)
    rows = np.nonzero(count > 1)[0]
    # no mixture is likelier than the best language of every word
    rows = rows[base[rows] - best[rows] > penalty[rows]]
    if len(rows):
        full, ceiling = climb(rows, np.ones((len(rows), langs)))
        order = np.argsort(-full, axis=1, kind="stable")
        worth = ceiling - best[rows] > penalty[rows] - 1  # the climb may end a little below its limit
        rows, order = rows[worth], order[worth]
        score = best.copy()
        for m in range(2, langs + 1):
            if not len(rows):
                break
            allowed = np.zeros((len(rows), langs))
            np.put_along_axis(allowed, order[:, :m], 1.0, axis=1)
            share, value = climb(rows, allowed)
            value = value - (m - 1) * penalty[rows]
            better = value > score[rows]
            at = rows[better]
            chosen[at], score[at], size[at] = share[better], value[better], m
    return chosen, size


def _predictor(langs: list[str], table: np.ndarray):
    def of(texts: list[str | None]) -> pd.DataFrame:
        joined = "\n".join(x or "" for x in texts)
        bucket, word, first = grams(joined)
        pred = np.full(len(texts), "und", object)
        score, size, mix = np.zeros(len(texts)), np.zeros(len(texts), int), np.full(len(texts), "", object)
        if len(first) and langs:
            # lower-casing may change the length of a text
            ends = np.cumsum([len((x or "").lower()) + 1 for x in texts])
            owner = np.searchsorted(ends, first - 1, side="right")
            starts = np.concatenate([[0], np.nonzero(np.diff(word))[0] + 1])
            likelihood = np.add.reduceat(table[bucket], starts, axis=0).astype(np.float64)
            used, at = np.unique(owner, return_inverse=True)
            share, m = mixtures(likelihood, at, len(used))
            top = share.argmax(axis=1)
            pred[used] = np.array(langs, object)[top]
            score[used], size[used] = share.max(axis=1), m
            mix[used] = [",".join(f"{langs[j]}:{s[j]:.4f}" for j in np.argsort(-s, kind="stable") if s[j] > 0) for s in share]
        return pd.DataFrame({"lang_pred": pred, "score": np.minimum(score, 1.0), "n_langs": size, "mixture": mix})

    def predict(batches):
        for frame in batches:
            texts, start, total = frame["text"].tolist(), 0, 0
            for i, x in enumerate([*texts, None]):
                n = len(x or "")
                if i == len(texts) or (total and total + n > CHUNK):
                    if i > start:
                        out = of(texts[start:i])
                        out.insert(0, "doc_id", frame["doc_id"].iloc[start:i].to_numpy())
                        yield out
                    start, total = i, 0
                total += n

    return predict


def languages(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, n_langs, mixture ("lang:share", largest first).

    Learned from texts with a language outside the held-out fold (crc32 of the id, null ids belong to fold 0).
    ``und`` with score 0 stands for texts that are null or have no letter, and for all texts if nothing could be
    learned. The score is the share of the predicted language. Repeated rows are judged each.
    """
    fold = fold_of(F.col("doc_id"), folds)
    langs, table = learn(docs.where(fold != held_out).select("text", "lang"))
    held = docs.select("doc_id", "text")
    columns = "doc_id long, lang_pred string, score double, n_langs long, mixture string"
    kind = dict(docs.dtypes)["doc_id"]
    out = held.mapInPandas(_predictor(langs, table), columns.replace("doc_id long", f"doc_id {kind}"))
    return out.select("doc_id", (fold == held_out).alias("held_out"), "lang_pred", "score", "n_langs", "mixture")
