"""Conversation operators and sharding against plain Python."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foldspark.llm import conversation_repair as cr
from foldspark.llm import repair_grammar as rg
from foldspark.llm.prefix_trie import prefix_trie, rebuilt, trie_of, turn_digests, with_turns
from foldspark.llm.sharding import placements, shard_documents, write_shards

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, mark string"


def talks(seed=5, n=60):
    """Conversations that share beginnings: odd roles, nulls, blanks, repeated rows and turns, a long one."""
    rng = random.Random(seed)
    words = ["yes.", "no", "why?", "go on!", "so be it.", " ", "", None]
    rows = []
    for c in range(n):
        turn = rng.choice([0, 0, 3])
        for i in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            if i < 3 and rng.random() < 0.6:
                role, text = ("user", "assistant", "user")[i], "hello there."
            else:
                text = rng.choice(words)
            rows.append((c, turn, role, text, 1, "m"))
            turn += rng.choice([1, 1, 1, 0, 3])
    rows += [rows[5], rows[5]]
    rows += [(n, None, "user", "no turn", 1, "m"), (n, 2, "assistant", "a turn.", 1, "m"), (n, None, "system", "either", 1, "m")]
    rows += [(n + 1, i, ("user", "assistant")[i % 2 if i != 77 else 0], f"line {i}.", 1, "m") for i in range(5000)]
    rows += [(c, i, "user", f"same {i}", 1, "m") for c in range(n + 2, n + 30) for i in range(4)]
    rows += [(None, 0, "user", "nobody.", 1, "m"), (None, 1, "assistant", "here", 1, "m")]
    return rows


@pytest.fixture(scope="module")
def convs(spark):
    return spark.createDataFrame(talks(), SCHEMA).repartition(5)


def mark(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def ordered(rows, empty):
    """(turn, role, text) of each conversation, in order, with nulls replaced."""
    out = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        out[c].append((turn, empty if role is None else role, empty if text is None else text))
    for rs in out.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1], r[2])))
    return out


# ---- sharding --------------------------------------------------------------------------------


def test_shards_are_even_and_hold_the_mixture(docs, corpus):
    got = placements(docs, shards=7).collect()
    assert len(got) == len(corpus)
    per = Counter(r.shard for r in got)
    assert set(per) == set(range(7)) and max(per.values()) - min(per.values()) <= 1
    for s, n in per.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    sources = Counter(r.source for r in got)
    for (source, _), n in Counter((r.source, r.shard) for r in got).items():
        assert abs(n - sources[source] / 7) <= 2
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_shards_equal_a_plain_sort(docs, corpus):
    groups = defaultdict(list)
    for i, t, _, source in corpus:
        body = (t or "").encode()
        crc = zlib.crc32(body)
        turn = hashlib.md5(f"17:{'null' if i is None else i}:{crc}".encode()).hexdigest()
        groups[source or ""].append((turn, -1 if i is None else i, len(body) + 1, i))
    line = sorted(((k + 0.5) / len(g), s, i) for s, g in groups.items() for k, (*_, i) in enumerate(sorted(g, key=lambda x: x[:3])))
    n = len(line)
    want = Counter((i, at * 16 // n, at - -(-(at * 16 // n) * n // 16)) for at, (_, _, i) in enumerate(line))
    assert Counter((r.doc_id, r.shard, r.slot) for r in placements(docs).collect()) == want


def test_shard_files_and_columns(docs, corpus, tmp_path, spark):
    clash = docs.withColumn("shard", F.lit("mine")).withColumn("turn", F.lit(1)).withColumn("of", F.lit(2))
    whole = shard_documents(clash, shards=3)
    assert whole.columns == [c for c in clash.columns if c != "shard"] + ["shard", "slot"]
    assert whole.count() == len(corpus) and whole.select("shard", "slot").distinct().count() == len(corpus)
    write_shards(docs, f"{tmp_path}/shards", shards=3)
    read = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter(r.doc_id for r in read.collect()) == Counter(r[0] for r in corpus)


def test_sharding_of_nothing_and_of_less_than_shards(no_docs, docs):
    assert placements(no_docs).count() == 0
    assert shard_documents(no_docs).count() == 0
    few = placements(docs.where("doc_id = 4"), shards=16).collect()
    assert len(few) == 1 and few[0].slot == 0


# ---- prefix trie -----------------------------------------------------------------------------


def plain_trie(sequences):
    """{(conv, depth): ...} of {conversation: [(role, text), ...]} by walking all members of every prefix."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    name = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len([w for w in re.split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = own + sum(saved[k] for k in kids[p])
    out = Counter()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if c is not None and len(sequences[c]) == len(p)))
        parent = name[p[:-1]] if p else None
        out[name[p], len(p), parent, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def nodes_of(df):
    return Counter(
        (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in df.collect()
    )


@pytest.fixture(scope="module")
def short():
    """Without the conversation of 5,000 turns, whose prefixes are too many for the plain walk."""
    return [r for r in talks() if r[0] != 61]


def test_trie_equals_plain_walk(spark, short):
    want = plain_trie({c: [r[1:] for r in rs] for c, rs in ordered(short, "").items()})
    df = spark.createDataFrame(short, SCHEMA).repartition(4)
    assert nodes_of(prefix_trie(df)) == want
    # a sketch so narrow that most estimates are too high
    assert nodes_of(prefix_trie(df, bits=11)) == want


def test_narrow_sketch_changes_nothing(convs):
    wide = nodes_of(prefix_trie(convs))
    assert nodes_of(prefix_trie(convs, bits=11)) == wide
    assert sum(n[3] for n in wide if n[1] == 0) == len({r[0] for r in talks()})


def test_rebuilt_conversations(spark, short):
    plain = ordered(short, "")
    sequences = {}
    for c, rows in plain.items():
        if c is None:
            sequences[c] = [r[1:] for r in rows]
            continue
        h = zlib.crc32(str(c).encode()) % 4
        sequences[c] = [r[1:] for r in plain.get(c - c % 20, [])[:h] + rows[h:]]
    df = spark.createDataFrame(short, SCHEMA).repartition(4)
    assert nodes_of(trie_of(rebuilt(turn_digests(df)))) == plain_trie(sequences)


def test_trie_texts_and_empty(spark, short):
    df = spark.createDataFrame(short, SCHEMA)
    named = with_turns(prefix_trie(df), df).where("depth > 0 AND conv_id IS NOT NULL")
    assert named.where("role IS NULL").count() == 0
    hello = named.where("text = 'hello there.' AND depth = 1").first()
    assert hello.role == "user" and hello.n_convs > 5
    assert prefix_trie(df.limit(0)).count() == 0


# ---- repair ----------------------------------------------------------------------------------


def cheapest(kinds):
    """Cost and least audit of a sequence of (initial, fault) by search over (rows read, roles written so far)."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    queue, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, at, last = heapq.heappop(queue)
        if at == len(kinds) and last in ("", "a"):
            return cost, audit
        if (at, last) in done:
            continue
        done.add((at, last))

        def push(more, edit, step, role):
            heapq.heappush(queue, (cost + more, audit + edit, at + step, role))

        for role in legal[last]:
            if role != "s":
                push(2, "I", 0, role)
        if at < len(kinds):
            initial, fault = kinds[at]
            push(3, "D", 1, last)
            if fault in ("", "truncated"):
                extra = fault == "truncated"
                if initial and initial in legal[last]:
                    push(extra, "K", 1, initial)
                for role in legal[last]:
                    if role != "s":
                        push(2 + extra, "R", 1, role)


def plain_repair(rows):
    seen, kinds, counts = set(), [], Counter()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        counts[fault] += 1
        kinds.append((role[:1], fault))
    cost, audit = cheapest(kinds)
    out, at, turn = [], 0, 0
    for edit in audit:
        if edit == "I":
            out.append((("user", "assistant")[turn % 2], ""))
            turn += 1
            continue
        _, role, text = rows[at]
        at += 1
        if edit == "K":
            out.append((role, text))
            turn += role[0] != "s"
        elif edit == "R":
            out.append((("user", "assistant")[turn % 2], text))
            turn += 1
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    lines = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()), out


@pytest.mark.parametrize("rounds", [0, 12])
def test_repair_equals_search(convs, rounds):
    want = {c: plain_repair(rows)[0] for c, rows in ordered(talks(), " ").items()}
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair_report(convs, rounds=rounds).collect()}
    assert got == want


def test_repaired_rows(convs):
    want = {c: plain_repair(rows)[1] for c, rows in ordered(talks(), " ").items()}
    got = defaultdict(list)
    for r in cr.repaired_turns(convs).orderBy("conv_id", "line").collect():
        assert r.line == len(got[r.conv_id])
        got[r.conv_id].append((r.role, r.text))
    assert dict(got) == {c: rows for c, rows in want.items() if rows}


def test_grammar_does_not_change_the_least_audit():
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 9)))
        kinds = [("" if s in "xo" else s.lower(), "blank" if s == "x" else "truncated" if s.isupper() else "") for s in word]
        pairs = [word[i : i + 2] for i in range(0, len(word) - 1, 3)]
        rules = [(p, chr(rg.FIRST_RULE + i)) for i, p in enumerate(dict.fromkeys(pairs))]
        for grammar in (rg.Grammar([]), rg.Grammar(rules)):
            repair = rg.Repair(grammar)
            for part in (word[:4], word[4:]):
                repair.read(part)
            assert repair.done() == cheapest(kinds)


def test_damage_and_conversations_without_rows(spark, convs):
    rows = [(c, t, "user", "a. b!", 1, "m") for c in range(40) for t in range(3)] + [(None, None, None, None, 1, "m")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = Counter()
    for c, t, role, text, *_ in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = role or " ", " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        want[c, t, "user" if kind == 4 else role, text] += {0: 0, 3: 2}.get(kind, 1)
    assert Counter(tuple(r) for r in cr.damage(df).collect()) == +want
    none = cr.repair_report(df.limit(0), df.select("conv_id")).collect()
    empty = hashlib.sha256().hexdigest()
    assert {tuple(r)[1:] for r in none} == {(0, 0, 0, 0, 0, 0, "", empty)} and len(none) == 41
    assert cr.repair_report(df.limit(0)).count() == 0
