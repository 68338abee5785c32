"""The conversation trie against its definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from fairway.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, every=100, kinds=6):
    """Every node, by its whole sequence of turns."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            label = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, label), (role, text)))
    convs = {c: [t for _, t in sorted(x, key=lambda y: y[0])] for c, x in convs.items()}
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % kinds
        rebuilt[c] = convs.get(c - c % every, [])[:h] + turns[h:]
    return nodes(rebuilt)


def nodes(rebuilt):
    members, ends = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {k: set() for k in members}
    for k in members:
        if k:
            children[k[:-1]].add(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], sha(ends.get(k, []))) for k, m in members.items())


def made(seed, n=260, words=3, longest=9):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(400), n):
        for t in range(rnd.randrange(1, longest)):
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", "bot", None]), rnd.choice([None, "", *("né" * k for k in range(1, words))])))
    return rows


def found(df, **options):
    return sorted(map(tuple, trie.conversation_trie(df, **options).collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("limit", [None, 1, 7, 60])
def test_random(spark, limit):
    rows = made(1)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), limit=limit) == brute(rows)


@pytest.mark.parametrize("limit", [1, 20])
def test_long_conversations_in_slices(spark, monkeypatch, limit):
    """Copies of long conversations, which cross the slices of numbering, of keys and of chains."""
    monkeypatch.setattr(trie, "SLICE", 8)
    monkeypatch.setattr(trie, "BUILT", 5)
    rows = [(c, t, "u", f"t{t}" if t < 60 or c < 3 else f"x{c}") for c in (1, 2, 150, 151, 152) for t in range(90)]
    rows += [(7, None, "u", str(k)) for k in range(30)] + made(3, 40)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4), limit=limit) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "u", "x"), (3, 0, None, None), (3, 0, None, None), (100, None, "", ""), (130, 5, "u", "a"), (130, -5, "ua", ""), (-7, 0, "u", "a"), (2**40, 1, "u", "é")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == brute(rows)
    clash = df.selectExpr("*", "1 AS d", "2 AS i", "'x' AS label", "3 AS p0", "4 AS total", "5 AS part")
    assert found(clash) == brute(rows)
    assert found(df.where("false")) == []
    assert found(spark.createDataFrame([(101, 0, "u", "a")], SCHEMA)) == brute([(101, 0, "u", "a")])  # turnless


def test_plain_conversations(spark):
    rows = [(c, t, "u", f"{'same' if t < 2 else c % 2}") for c in range(10) for t in range(3 + c % 2)]
    turns, convs = trie.plain_turns(spark.createDataFrame(rows, SCHEMA))
    got = sorted(map(tuple, trie.prefix_trie(turns, convs, limit=4).collect()), key=lambda r: (r[0], r[1]))
    assert got == nodes({c: [("u", "same"), ("u", "same")] + [("u", str(c % 2))] * (1 + c % 2) for c in range(10)})


def test_ids_of_a_node_in_chunks(spark):
    rows = [(c, 0, "u", "same") for c in range(0, 70_000_000, 100_000)]
    turns, convs = trie.plain_turns(spark.createDataFrame(rows, SCHEMA))
    got = {r.depth: r for r in trie.prefix_trie(turns, convs).collect()}
    assert got[1].ends_sha256 == hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()
    assert (got[0].n_convs, got[0].n_children, got[0].n_leaves, got[0].saved_tokens) == (700, 1, 1, 699 * 4)


def test_level_order():
    """Root a with children b, c; b has d."""
    own, above = np.array([[4, 0], [1, 0], [3, 0], [2, 0]]), np.array([[2, 0], [9, 9], [1, 0], [1, 0]])
    places, louds, starts = trie.level_order(own, above, np.array([5, 6, 8, 7]))
    assert places.tolist() == [1, 3, 2, 0] and starts.tolist() == [0, 1, 3, 4]
    assert louds.bits.astype(int).tolist() == [1, 0, 1, 1, 0, 1, 0, 0, 0]
    assert louds.parents().tolist() == [-1, 0, 0, 1] and louds.degrees().tolist() == [2, 1, 0, 0]
    assert trie.roll_up(louds, starts, np.array([1, 10, 100, 1000])).tolist() == [1111, 1010, 100, 1000]
