"""Conversation structure repair: the cheapest edits that give every conversation legal roles.

Rows of a conversation are taken by turn (nulls first; rows of one turn by a digest of role and text). A row's first fault
counts: blank, duplicate (role and text seen earlier), truncated (no end mark). Edits are Keep, Rerole, Delete and Insert;
see ``repair_grammar`` for costs and the grammar of roles.

1. Narrow rows (no texts) are exchanged by conversation; a task reads them in order and spells each
   conversation as a string of symbols, in segments of bounded length.
2. Re-Pair: Spark counts adjacent symbols over all distinct spellings, weighted by their conversations, and the most
   frequent pairs that do not overlap become rules, round after round. The grammar is bounded by rounds x pairs a
   round; what it does not cover stays as single symbols, so it only decides how much work is shared.
3. Texts are exchanged once. A task reads the spellings of a conversation before its rows, multiplies the matrices of the
   rules, and applies the edits to the rows as they come. It holds one conversation's audit and one batch of rows.

Null roles and texts are one space: such roles cannot be kept, such texts are blank. Rows without a conv_id are one
conversation. A conversation without rows has no edits. An empty table has no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from foldspark.llm.repair_grammar import FIRST_RULE, MUST_GO, Grammar, Repair, chosen_pairs, new_roles
from foldspark.llm.tables import settle
from foldspark.session import release

ROUNDS = 12  # a rule spells at most 2**ROUNDS rows
PAIRS_A_ROUND = 32
SEGMENT = 4096  # symbols of a conversation in one record
BATCH = 4096  # records a task gives at once
LEGAL = {"su", "ua", "au"}  # adjacent role initials
BLANKS = " \t\n\x0b\x0c\r"
NAME, SPELLED, ROW = range(3)  # kinds of records of a conversation, in the order in which they are read
STATS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def _rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls, and ``mark``, the digest of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), mark.alias("mark"))


def _faults() -> tuple[Column, Column]:
    ended = F.rtrim(F.col("text"), F.lit(BLANKS))
    return F.length(ended) == 0, ~F.right(ended, F.lit(1)).isin(".", "!", "?")


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


class _Spelling:
    """Symbols and counts of the conversation that is being read."""

    def __init__(self) -> None:
        self.symbols, self.segment, self.before = [], 0, None
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, blank: bool, repeated: bool, cut: bool) -> None:
        kind = initial if initial in ("s", "u", "a") else "o"
        if blank or repeated:
            self.blank += blank
            self.duplicate += not blank
            kind = MUST_GO
        elif cut:
            self.truncated += 1
            kind = kind.upper()
        self.symbols.append(kind)
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
            self.turns += 1

    def counts(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


def _spell(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def segments() -> Iterator[tuple]:
        open_, conv = None, None
        for conv_id, turn, initial, blank, repeated, cut in _records(batches):
            if open_ is None or conv_id != conv:
                if open_ is not None:
                    yield conv, open_.segment, "".join(open_.symbols), open_.counts()
                open_, conv = _Spelling(), conv_id
            elif len(open_.symbols) == SEGMENT:
                yield conv, open_.segment, "".join(open_.symbols), None
                open_.symbols, open_.segment = [], open_.segment + 1
            open_.add(turn, initial, blank, repeated, cut)
        if open_ is not None:
            yield conv, open_.segment, "".join(open_.symbols), open_.counts()

    return _batched(segments(), schema)


def spelled(rows: DataFrame) -> DataFrame:
    """``conv_id, segment, symbols, counts``; the counts of a conversation are in its last segment."""
    blank, cut = _faults()
    narrow = rows.select("conv_id", "turn", "mark", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut.alias("cut"))
    # dealt once by conversation: the window, the order and the reading all stay in place
    dealt = narrow.repartition("conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "mark").orderBy("turn")) > 1
    ordered = dealt.withColumn("repeated", earlier).sortWithinPartitions("conv_id", "turn", "mark", "repeated")
    ordered = ordered.select("conv_id", "turn", "initial", "blank", "repeated", "cut")
    schema = _schema(rows, "segment int, symbols string, counts array<bigint>")
    arrow = to_arrow_schema(schema)
    return ordered.mapInArrow(lambda batches: _spell(batches, arrow), schema)


def _schema(rows: DataFrame, more: str) -> StructType:
    return StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *StructType.fromDDL(more).fields])


def pair_rules(spellings: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS_A_ROUND) -> list[tuple[str, str]]:
    """Rules ``(pair, symbol)`` of the pairs found most often in ``symbols``; at most ``rounds * pairs`` of them."""
    words = settle(spellings.groupBy("symbols").agg(F.count("*").alias("n")).where(F.length("symbols") > 1), "repair-words")
    rules, read = [], F.col("symbols")
    for _ in range(rounds):
        words = words.withColumn("symbols", read) if rules else words
        at = F.explode(F.sequence(F.lit(1), F.length("symbols") - 1))
        seen = words.where(F.length("symbols") > 1).select("symbols", "n", at.alias("i"))
        counted = seen.groupBy(F.substring(F.col("symbols"), F.col("i"), F.lit(2)).alias("pair")).agg(F.sum("n").alias("n"))
        counted = counted.where("n > 1").orderBy(F.desc("n"), "pair").limit(4 * pairs).collect()
        chosen = chosen_pairs([tuple(r) for r in counted], pairs)
        if not chosen:
            break
        new = [(pair, chr(FIRST_RULE + len(rules) + i)) for i, pair in enumerate(chosen)]
        rules += new
        read = F.col("symbols")
        for pair, symbol in new:
            read = F.replace(read, F.lit(pair), F.lit(symbol))
        shorter = settle(words.groupBy(read.alias("symbols")).agg(F.sum("n").alias("n")), "repair-words", words)
        words, read = shorter, F.col("symbols")
    release(words)
    return rules


def _edited(records: Iterator[tuple], grammar: Grammar) -> Iterator[tuple]:
    """(role, text, edit, turn) of every row after repair; returns the counts, the cost and the audit."""
    repair, counts = Repair(grammar), [0] * len(STATS)
    cost, audit, edits, write = 0, "", iter(()), None
    for _, kind, turn, symbols, counted, role, text in records:
        if kind == SPELLED:
            repair.read(symbols)
            counts = counted or counts
        elif kind == ROW:
            if write is None:
                cost, audit = repair.done()
                edits, write = iter(audit), new_roles()
            edit = next(edits)
            while edit == "I":
                yield write(None), "", edit, None
                edit = next(edits)
            if edit != "D":
                yield write(role if edit == "K" else None), text, edit, turn
    for edit in edits:
        yield write(None), "", edit, None
    return counts, cost, audit


def _walk(batches: Iterator[pa.RecordBatch], rules: list, lines: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Repair the conversations of a sorted partition: their new rows if ``lines``, else one record each."""
    grammar = Grammar(rules)

    def results() -> Iterator[tuple]:
        for conv, records in groupby(_records(batches), key=lambda r: r[0]):
            edited = _edited(records, grammar)
            if lines:
                yield from ((conv, n, *row) for n, row in enumerate(edited))
                continue
            digest, line = hashlib.sha256(), "{}:{}"
            while True:
                try:
                    role, text, *_ = next(edited)
                except StopIteration as end:
                    counts, cost, audit = end.value
                    break
                digest.update(line.format(role, text).encode())
                line = "\n{}:{}"
            yield conv, *counts, cost, audit, digest.hexdigest()

    return _batched(results(), schema)


def _repaired(conversations: DataFrame, ids: DataFrame | None, lines: bool, schema: StructType, rounds: int) -> DataFrame:
    rows = _rows(conversations)
    spellings = settle(spelled(rows), "repair-spelled")
    rules = pair_rules(spellings, rounds)
    conv = F.col("conv_id")

    def record(kind: int, **given) -> list[Column]:
        types = {"segment": "int", "turn": "bigint", "mark": "binary", "symbols": "string", "counts": "array<bigint>", "role": "string", "text": "string"}
        return [conv, F.lit(kind).alias("kind"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()]]

    names = ids if ids is not None else conversations.select("conv_id")
    parts = names.select("conv_id").distinct().select(*record(NAME))
    parts = parts.unionByName(spellings.select(*record(SPELLED, segment=F.col("segment"), symbols=F.col("symbols"), counts=F.col("counts"))))
    own = {c: F.col(c) for c in ("turn", "mark", "role", "text")}
    parts = parts.unionByName(rows.select(*record(ROW, **own)))
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "segment", "turn", "mark")
    ordered = ordered.select("conv_id", "kind", "turn", "symbols", "counts", "role", "text")
    arrow = to_arrow_schema(schema)
    return ordered.mapInArrow(lambda batches: _walk(batches, rules, lines, arrow), schema)


def repair_report(conversations: DataFrame, ids: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row a conversation (of ``ids``, if given, also those without rows): ``STATS``, cost, audit, repaired_sha256."""
    counts = "".join(f"{c} bigint, " for c in (*STATS, "cost"))
    return _repaired(conversations, ids, False, _schema(conversations, counts + "audit string, repaired_sha256 string"), rounds)


def repaired_turns(conversations: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The rows after repair: conv_id, line (from 0), role, text, edit (K, R or I), turn (null for inserted rows)."""
    schema = _schema(conversations, "line bigint, role string, text string, edit string, turn bigint")
    return _repaired(conversations, None, True, schema, rounds)


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults dealt by the CRC-32 of ``conv_id:turn``; nulls are one space."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")
