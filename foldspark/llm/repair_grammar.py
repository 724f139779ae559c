"""Cheapest repairs of role/fault sequences as min-plus products over a grammar of frequent pairs.

A row is one symbol: its role's initial s, u, a or o (any other) if it is sound, in capitals if it is truncated, x if it
must go. A repair reads the symbols and writes role initials that form ``(s?(ua)+)?``; its state is what was
written so far. A symbol is a 4 x 4 matrix whose entry [p][q] has the least cost of going from state p to q and
the audit (the edits' initials) of that way, least in ASCII order among equals. Products take sums of costs and
join audits, so a rule of the grammar is the product of its two parts, computed once for all its places.

Least audits may be chosen part by part: of two audits of the same rows and cost neither is a beginning of the
other, because what one had in addition would be insertions, which cost.
"""

from __future__ import annotations

from functools import lru_cache
from os.path import commonprefix

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs; the last for a truncated row that stays
MUST_GO = "x"
# state after a role is written; others are not allowed
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
# rows of insertions, by state before and after: the fewest that lead there
INSERTED = [{START: 0, USER: 1, ASSISTANT: 2}, {SYSTEM: 0, USER: 1, ASSISTANT: 2}, {USER: 0, ASSISTANT: 1}, {ASSISTANT: 0, USER: 1}]
TO_END = [0, 2, 1, 0]  # rows to insert at the end
FIRST_RULE = 0xE000  # rules are written in the private-use area, 6,400 of them at most


def flat(rope: str | tuple) -> str:
    """The text of a rope: an audit as a tree of its parts, pairs of ropes that rules share."""
    out, stack = [], [rope]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            stack += (part[1], part[0])
    return "".join(out)


def _joined(left, right):
    return right if left == "" else left if right == "" else (left, right)


def _least(ways: list):
    """The (cost, rope) of least cost, and of least text among those; texts are written out only for ties."""
    if not ways:
        return None
    cost = min(w[0] for w in ways)
    best = [w[1] for w in ways if w[0] == cost]
    return (cost, best[0]) if len(best) == 1 else (cost, min(best, key=flat))


def terminal(symbol: str) -> list[list]:
    """Matrix of one row: insertions before it, then what is done with it."""
    kind, extra = symbol.lower(), TRUNCATED * symbol.isupper()
    ways = [[[] for _ in range(4)] for _ in range(4)]
    for p in range(4):
        for mid, k in INSERTED[p].items():
            before, paid = "I" * k, INSERT * k
            ways[p][mid].append((paid + DELETE, before + "D"))
            if kind == MUST_GO:
                continue
            for role, q in NEXT[mid].items():
                if role == kind:
                    ways[p][q].append((paid + KEEP + extra, before + "K"))
                if role != "s":
                    ways[p][q].append((paid + REROLE + extra, before + "R"))
    return [[_least(w) for w in row] for row in ways]


def product(left: list[list], right: list[list]) -> list[list]:
    def entry(p: int, q: int):
        return _least(
            [(a[0] + b[0], _joined(a[1], b[1])) for m in range(4) if (a := left[p][m]) and (b := right[m][q])]
        )

    return [[entry(p, q) for q in range(4)] for p in range(4)]


class Grammar:
    """Rules ``[(pair, symbol), ...]`` in the order in which they were made, with one matrix each."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules = rules
        self.matrix = {s: terminal(s) for s in "suaoSUAO" + MUST_GO}
        for pair, symbol in rules:  # bottom-up: parts are older than the rule
            self.matrix[symbol] = product(self.matrix[pair[0]], self.matrix[pair[1]])
        self.coded = lru_cache(100_000)(self._coded)

    def _coded(self, spelled: str) -> str:
        for pair, symbol in self.rules:
            spelled = spelled.replace(pair, symbol)
        return spelled


class Repair:
    """The cheapest repair of one conversation, read in segments of symbols."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar = grammar
        self.settled: list[str] = []  # what the audits of all states begin with
        self.ways: list = [(0, ""), None, None, None]

    def read(self, spelled: str) -> None:
        for symbol in self.grammar.coded(spelled):
            step = self.grammar.matrix[symbol]
            self.ways = product([self.ways, *[[None] * 4] * 3], step)[0]
        texts = [w and (w[0], flat(w[1])) for w in self.ways]
        shared = commonprefix([w[1] for w in texts if w])
        self.settled.append(shared)
        self.ways = [w and (w[0], w[1][len(shared) :]) for w in texts]

    def done(self) -> tuple[int, str]:
        """Cost and audit, with the insertions at the end."""
        ends = [(w[0] + INSERT * k, _joined(w[1], "I" * k)) for w, k in zip(self.ways, TO_END) if w]
        cost, rest = _least(ends)
        return cost, "".join(self.settled) + flat(rest)


def new_roles():
    """A function that tells the role of the next written row, given the role that it had if it is kept."""
    names = ("user", "assistant")
    turn = 0

    def write(kept: str | None) -> str:
        nonlocal turn
        role = names[turn % 2] if kept is None else kept
        turn += not role.startswith("s")
        return role

    return write


def chosen_pairs(counted: list[tuple[str, int]], most: int) -> list[str]:
    """The most frequent pairs that can be replaced in one round: none begins with what another ends with."""
    firsts, lasts, out = set(), set(), []
    for pair, _ in counted:
        if len(out) < most and pair[0] not in lasts and pair[1] not in firsts:
            firsts.add(pair[0])
            lasts.add(pair[1])
            out.append(pair)
    return out
