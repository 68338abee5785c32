"""Both matchers on the fixture dictionary and against their rules in plain Python."""

import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest

from fairway.operators import match

PORTS = [(1, "南京港", ["南京", "宁港"]), (2, "武汉港", ["汉口", "武汉"]), (3, "上海港", ["上海", "申港"])]


def entities(spark, rows=PORTS):
    return spark.createDataFrame(rows, "id long, name string, aliases array<string>")


def ranked(spark, text, rows=PORTS, **options):
    df = match.match_entities(spark.createDataFrame([(text,)], "text string"), entities(spark, rows), **options)
    return [(r.id, r.score, r.via) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("南京港", [(1, 100, "exact")]),
        ("汉口", [(2, 95, "alias_exact")]),
        ("武汉码头", [(2, 80, "alias_contains")]),
        ("", []),
        (None, []),
        ("南京港口", [(1, 85, "contains")]),
        ("武港", [(2, 80, "fuzzy")]),
        ("上海市港", [(3, 80, "alias_contains")]),
        ("港", [(1, 85, "contains"), (2, 85, "contains"), (3, 85, "contains")]),
        (" ", [(1, 85, "contains"), (2, 85, "contains"), (3, 85, "contains")]),
    ],
)
def test_entities(spark, text, expected):
    assert ranked(spark, text) == expected


def test_threshold(spark):
    assert ranked(spark, "完全不存在的地名XYZ", threshold=90) == []


def names(spark, texts):
    e = spark.createDataFrame([(i, n, 1) for i, n, _ in PORTS], "id long, name string, status int")
    rows = [(i * 10 + k, i, a, 10 if a == "申港" else 0, 1) for i, _, al in PORTS for k, a in enumerate(al)]
    a = spark.createDataFrame(rows, "id long, node_id long, alias_name string, priority int, status int")
    got = match.match_names(spark.createDataFrame([(t,) for t in texts], "text string"), e, a, "node_id").orderBy("text", "rank").collect()
    out = {t: [] for t in texts}
    for r in got:
        out[r.text].append((r.id, r.matched, r.score, r.priority))
    return out


def test_names(spark):
    got = names(spark, ["南京港", "汉口", "武汉码头", "港", "武港", "申港区", "XYZ", "", " "])
    assert got == {
        "南京港": [(1, "南京港", 100, 5)],
        "汉口": [(2, "汉口", 100, 0)],
        "武汉码头": [(2, "武汉", 85, 0)],
        "港": [(3, "申港", 85, 10), (2, "武汉港", 85, 5), (1, "宁港", 85, 0)],
        "武港": [(2, "武汉港", 80, 5), (3, "申港", 50, 10), (1, "宁港", 50, 0)],
        "申港区": [(3, "申港", 85, 10)],
        "XYZ": [],
        "": [],
        " ": [(1, "南京", 85, 0), (2, "汉口", 85, 0), (3, "上海", 85, 0)],
    }


def rules(text, rows, threshold=60, k=3):
    """The first matcher's rules, one pair at a time."""
    ratio = lambda a, b: int(SequenceMatcher(None, a, b).ratio() * 100) if a and b else 0
    found = []
    t = text.strip().lower()
    for i, name, aliases in rows:
        n, al = name.lower(), [a.lower() for a in aliases]
        if t == n:
            s = (100, "exact")
        elif t in al:
            s = (95, "alias_exact")
        elif t in n or n in t:
            s = (85, "contains")
        elif any(t in a or a in t for a in al):
            s = (80, "alias_contains")
        else:
            s = max([(ratio(t, n), 1, "fuzzy"), *[(ratio(t, a), 0, "alias_fuzzy") for a in al]], key=lambda x: (x[0], x[1]))
            s = (s[0], s[2])
        if s[0] >= threshold:
            found.append((i, *s))
    return sorted(found, key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("shard_rows", [100_000, 4])
def test_entities_against_rules(spark, monkeypatch, shard_rows):
    """Also with a dictionary of several shards."""
    monkeypatch.setattr(match, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(match, "TOGETHER", 7)
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcD ") for _ in range(rnd.randint(1, n))).strip() or "b"
    rows = [(i, word(9), [word(7) for _ in range(rnd.randint(0, 3))]) for i in range(25)]
    texts = sorted({word(10) for _ in range(400)} | {" ", "\u3000"})
    df = match.match_entities(spark.createDataFrame([(t,) for t in texts], "text string"), entities(spark, rows))
    got = {t: [] for t in texts}
    for r in df.orderBy("text", "rank").collect():
        got[r.text].append((r.id, r.score, r.via))
    assert got == {t: rules(t, rows) for t in texts}


def test_texts_that_resemble_the_whole_shard(monkeypatch):
    """Few pairs are held at a time, however many candidates the texts have."""
    monkeypatch.setattr(match, "PAIRS", 2_000, raising=False)
    held, real = [], match.FormIndex.ratios
    monkeypatch.setattr(match.FormIndex, "ratios", lambda self, texts, found: held.append(sum(map(len, found))) or real(self, texts, found))
    rows = [(i, f"Supplier#{i:09}", [f"S{i}"]) for i in range(300)]
    texts = [f"supplier#{i:09}" for i in range(1_000, 1_060)]
    t = pa.table({"id": [r[0] for r in rows], "name": [r[1] for r in rows], "__n": [r[1].lower() for r in rows], "__a": [[a.lower() for a in r[2]] for r in rows]})
    got = list(match._entities(60, 3, True, 0.6 - 1e-9)(t)(texts))
    assert [[(i, s, via) for i, _, s, via in g] for g in got] == [rules(text, rows) for text in texts]
    assert sum(held) > 15_000 and max(held) < 2_700  # all were one array


def test_shards_follow_the_forms(spark, monkeypatch):
    """Few entities of many aliases are several shards too."""
    monkeypatch.setattr(match, "SHARD_ROWS", 20)
    made, real = [], match._cells
    monkeypatch.setattr(match, "_cells", lambda *a: made.append(real(*a)) or made[-1])
    rows = [(i, f"n{i}", [f"a{i}-{k}" for k in range(9)]) for i in range(10)]
    df = match.match_entities(spark.createDataFrame([("a7-3",)], "text string"), entities(spark, rows))
    assert [shards for _, shards in made] == [5] and tuple(df.orderBy("rank").first())[:4] == ("a7-3", 7, "n7", 95)


def names_by_rules(text, entities, aliases, threshold=0.5, k=5):
    """The second matcher's rules, one row at a time: aliases first, then names."""
    if not text:
        return []
    t = text.strip().lower()

    def score(form):
        m = form.strip().lower()
        if form == "":
            return 0.0
        if t == m:
            return 1.0
        if t in m or m in t:
            return 0.85
        return SequenceMatcher(None, t, m).ratio() if t and m else 0.0

    name = {i: n for i, n, status in entities if status == 1}
    rows = [(e, form, priority) for _, e, form, priority, status in sorted(aliases) if status == 1 and e in name]
    rows += [(i, n, 5) for i, n in sorted(name.items())]
    seen = {}
    for place, (i, form, priority) in enumerate(rows):
        if (s := score(form)) >= threshold:
            percent = round(s * 100)
            if i not in seen:
                seen[i] = (percent, priority, place, form)
            elif percent > seen[i][0]:
                seen[i] = (percent, priority, seen[i][2], form)
    top = sorted(seen.items(), key=lambda x: (-x[1][0], -x[1][1], x[1][2]))[:k]
    return [(i, form, min(percent, 100), priority) for i, (percent, priority, _, form) in top]


@pytest.mark.parametrize("prune, shard_rows", [(True, 100_000), (False, 100_000), (True, 4)])
def test_names_against_rules(spark, monkeypatch, prune, shard_rows):
    """Also with a dictionary of several shards."""
    monkeypatch.setattr(match, "SHARD_ROWS", shard_rows)
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcD ") for _ in range(rnd.randint(1, n))).strip() or rnd.choice(["b", " "])
    entities = [(i, word(9), rnd.randint(0, 4) and 1) for i in range(20)]
    aliases = [(100 - k, rnd.randrange(20), word(7), rnd.randint(0, 9), rnd.randint(0, 4) and 1) for k in range(30)]
    texts = sorted({word(10) for _ in range(300)})
    e = spark.createDataFrame(entities, "id long, name string, status int")
    a = spark.createDataFrame(aliases, "id long, node_id long, alias_name string, priority int, status int")
    got = {t: [] for t in texts}
    for r in match.match_names(spark.createDataFrame([(t,) for t in texts], "text string"), e, a, "node_id", prune=prune).orderBy("text", "rank").collect():
        got[r.text].append((r.id, r.matched, r.score, r.priority))
    assert got == {t: names_by_rules(t, entities, aliases) for t in texts}


def test_dictionary_and_candidates(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    a = spark.createDataFrame([(5, 1, "y"), (4, 1, "x")], "id long, node_id long, alias_name string")
    assert {r.id: r.aliases for r in match.dictionary(e, a, "node_id").collect()} == {1: ["x", "y"], 2: []}
    m = match.match_entities(spark.createDataFrame([("港",)], "text string"), entities(spark))
    r = match.candidates(m).first()
    assert (r.matched_id, r.confidence, [c.id for c in r.candidates]) == (1, 85, [1, 2, 3])
