"""Exact dedup and SimHash near-dedup against brute force, with odd inputs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from fairway.llm import exact_dedup, simhash, warc
from fairway.llm.common import bounded

SCHEMA = "doc_id long, text string, n int, h string"  # n and h: other columns whose names the operators use inside


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**40), min_size=1, max_size=300), st.integers(0, 36))
def test_rice_round_trip(values, k):
    v = np.array(sorted(values), np.uint64)
    if int(v[-1]) >> k < 10**5:
        assert (exact_dedup.rice_decode(exact_dedup.rice_encode(v, k), len(v), k) == v).all()


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aAbÉé ") for _ in range(rnd.randint(0, 4))) for _ in range(300)] + [None, "", None, "x" * 200_000, "X" * 200_000]
    rows = [(i, t, i % 3, "z") for i, t in enumerate(texts)]
    rows += [(7, texts[7], 0, "again"), (None, texts[8], 0, "no id"), (None, "only without id", 0, "a"), (None, "ONLY without id", 0, "b")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_exact_groups(odd):
    rows, df = odd
    groups = defaultdict(list)
    for i, t, _, _ in rows:
        groups[lower(t)].append(i)
    want = Counter()
    for i, t, _, _ in rows:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        want[i, keep, len(g), i == keep] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect())
    assert got == want


def test_exact_dedup_keeps_one_row_of_each_text(odd):
    rows, df = odd
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns
    got = {lower(r.text): r.doc_id for r in out.collect()}
    assert out.count() == len(got) == len({lower(t) for _, t, _, _ in rows})
    for t, i in got.items():
        assert i == max((x for x, y, _, _ in rows if lower(y) == t and x is not None), default=None)


def test_texts_of_unsuspected_rows_do_not_move(spark, odd):
    """The table that holds the rows is on no side of an exchange, for exact copies and for WARC payloads."""
    bounded(spark)
    pages = spark.createDataFrame([(i, "u", "p" * 1000 + str(i % 7)) for i in range(50)], "page_id long, url string, html string")
    for out in (exact_dedup.exact_dedup(odd[1]), warc.with_revisits(pages)):
        out.collect()
        plan = out._jdf.queryExecution().explainString(out.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        lines = plan.split("AdaptiveSparkPlan")[1].split("\n")
        depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
        scan = next(i for i, x in enumerate(lines) if "Bucketed: true" in x)
        above, d = [], depth(lines[scan])
        for x in reversed(lines[:scan]):
            if x.strip() and depth(x) < d:
                above.append(x)
                d = depth(x)
        assert above and not [x for x in above if "Exchange" in x], plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("exact_rows", "warc_pages"))]


def test_large_sides_are_joined_without_broadcasts(spark, odd, monkeypatch):
    for m in (exact_dedup, warc, simhash):
        monkeypatch.setattr(m, "small", lambda df, rows=-1: df)
    test_exact_groups(odd)
    test_exact_dedup_keeps_one_row_of_each_text(odd)


def test_clashing_names(spark):
    names = ["__id", "__norm", "__sha", "__keep", "__n", "__gone", "__digest", "sender", "rid", "sha", "h", "row", "id", "norm", "digest", "keep", "n"]
    df = spark.createDataFrame([(1, "a b"), (2, "A b"), (3, None)], "doc_id long, text string")
    for c in names:
        df = df.withColumn(c, F.lit(f"own {c}"))
    for out in (exact_dedup.exact_dedup(df), simhash.near_dedup(df)):
        assert out.columns == df.columns
        assert {r["doc_id"] for r in out.collect()} in ({2, 3}, {1, 3})
        assert all(r[c] == f"own {c}" for r in out.collect() for c in names)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert simhash.simhash_components(none).count() == 0
    assert simhash.near_dedup(none).count() == 0


def fingerprint(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    s = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows, bits=4):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                root[find(a)] = find(b)
    low = defaultdict(lambda: 10**9)
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low[find(i)], doc)
    return {(doc, f"{fps[i]:016x}", low[find(i)]) for i, (doc, _) in enumerate(rows)}


@pytest.fixture(scope="module")
def similar():
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    rows = []
    for g in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 40, 90]))]
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary).upper()
            rows.append(" \n".join(copy))
    rows += ["", " \t", "one two", "a é　b\x1cc"]
    rnd.shuffle(rows)
    return list(enumerate(rows, 100))


def components_of(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA).repartition(3)
    return {(r.id, f"{r.fp & (2**64 - 1):016x}", r.component) for r in simhash.simhash_components(df).collect()}


def test_components(spark, similar):
    assert components_of(spark, similar) == brute_components(similar)


@pytest.mark.parametrize("chunk", [2, 30])
def test_components_of_large_buckets(spark, similar, monkeypatch, chunk):
    """Buckets dealt out as pairs of chunks, and dense ones walked breadth first."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "blocks_for", lambda n, bits: bits + 1)
    assert components_of(spark, similar) == brute_components(similar)


def test_nulls_and_repeats(spark):
    rows = [(5, None), (3, "  "), (None, "a b"), (None, "zz yy"), (9, "a b"), (9, "a b")]
    got = Counter((r.id, r.component) for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(5, 3), (3, 3), (None, 9), (None, None), (9, 9), (9, 9)])


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4), st.integers(5, 9))
def test_close_fingerprints_share_a_block(fp, flips, blocks):
    other = fp ^ sum(1 << b for b in flips)
    assert any(fp & m == other & m for m in simhash.block_masks(blocks, 4))


def test_near_dedup(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows, near, clean = [], set(), set()
    for i in range(60):
        base = [word() for _ in range(rnd.randint(120, 400))]
        rows.append((3 * i, " ".join(base)))
        if i % 2:
            copy = list(base)
            copy[rnd.randrange(len(copy))] = word()
            rows.append((3 * i + 1, " ".join(copy)))
            near.add(3 * i + 1)
        else:  # half of it is another text: no near duplicate
            rows.append((3 * i + 1, " ".join(base[: len(base) // 2] + [word() for _ in range(len(base) // 2)])))
            clean.add(3 * i + 1)
    left = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA)).collect()}
    assert left == {i for i, _ in rows} - near
    assert clean <= left


def shingle_set(text, words=5):
    w = re.findall(r"[^\W_]+", lower(text))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def linked(spark, pairs):
    """Which pairs of texts near_duplicates() links."""
    rows = [(2 * i + j, t, 0, "") for i, p in enumerate(pairs) for j, t in enumerate(p)]
    c = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    return [c[2 * i] == c[2 * i + 1] for i in range(len(pairs))]


def test_near_duplicates_with_other_passages(spark):
    """Passages of other words of the same vocabulary, appended, cut off or replaced as a block, against brute force."""
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    pairs, kinds = [], []
    for kind in ("appended", "cut off", "replaced"):
        for similarity in (0.8, 0.82, 0.85, 0.9, 0.95, 0.3):
            for n in [100, 300, 1000] * 13:
                base, part = words(n), round(n * (1 - similarity))
                if kind == "appended":
                    copy = base + words(round(n / similarity) - n)
                elif kind == "cut off":
                    copy = base[: n - part]
                else:
                    part, at = round(n * (1 - similarity) / (1 + similarity)), rnd.randrange(n // 2)
                    copy = base[:at] + words(part) + base[at + part :]
                pairs.append((" ".join(base), " ".join(copy)))
                kinds.append(kind)
    got = linked(spark, pairs)
    true = [jaccard(*p) for p in pairs]
    for kind in ("appended", "cut off", "replaced"):
        for low, high, least in ((0.8, 0.84, 0.9), (0.84, 0.88, 0.95), (0.88, 1, 0.99)):
            found = [g for g, t, k in zip(got, true, kinds) if k == kind and low <= t < high]
            assert len(found) >= 20 and sum(found) >= least * len(found), (kind, low, sum(found), len(found))
    assert not [t for g, t in zip(got, true) if g and t < 0.8]


def test_no_pair_below_the_similarity_is_linked(spark):
    rnd = random.Random(18)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    pairs = []
    for _ in range(400):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([60, 200, 600]))]
        copy = list(base)
        for _ in range(rnd.randint(1, len(base) // 12)):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
        pairs.append((" ".join(base), " ".join(copy)))
    true = [jaccard(*p) for p in pairs]
    assert sum(0.6 <= t < 0.8 for t in true) > 80 and sum(t >= 0.8 for t in true) > 60
    assert linked(spark, pairs) == [t >= 0.8 for t in true]


@pytest.mark.parametrize("few, meeting", [(16, 1 << 19), (2, 700), (1, 1 << 19)])
def test_near_duplicates_in_large_buckets(spark, monkeypatch, few, meeting):
    """Groups of texts that drift apart, so that the first of a bucket doesn't settle all, against brute force."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "MEETING", meeting)
    rnd = random.Random(20)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    texts = []
    for size in (70, 30, 8):
        base = [rnd.choice(vocabulary) for _ in range(150)]
        for _ in range(size):
            base = list(base)
            base[rnd.randrange(len(base))] = rnd.choice(vocabulary)
            texts.append(" ".join(base))
    rnd.shuffle(texts)
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert {r.id: r.component for r in simhash.near_duplicates(df).collect()} == {i: find(i) for i in range(len(texts))}


def test_texts_without_words_are_alone(spark):
    rows = [(1, "###"), (2, "$$$ !!!"), (3, None), (4, ""), (5, "one two"), (6, "One  TWO."), (7, "one three")]
    got = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}


def test_bands_retrieve_nearly_all():
    assert simhash.retrieval_probability(0.8) > 0.999


def test_repeated_lines_count_once(spark):
    rnd = random.Random(12)
    words = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    same, other = [], []
    for _ in range(8):
        for n, times in ((300, 5), (300, 10), (300, 20), (300, 40), (1000, 20), (1000, 60)):
            base = words(n)
            at = rnd.randrange(n - 12)
            same.append((" ".join(base), " ".join(base[: at + 12] + base[at : at + 12] * times + base[at + 12 :])))
        line = words(12) * 20
        other.append((" ".join(words(300) + line), " ".join(words(300) + line)))
    assert all(jaccard(*p) > 0.95 for p in same) and all(jaccard(*p) < 0.1 for p in other)
    assert all(linked(spark, same)) and not any(linked(spark, other))
    texts = pa.RecordBatch.from_pydict({"id": [0, 1], "text": list(other[0]), "digest": [0, 1]})
    wide = [np.array(x, np.int64) for b in simhash._wide(5)(iter([texts])) for x in b.column("wide").to_pylist()]
    assert np.bitwise_count(wide[0] ^ wide[1]).sum() > simhash.expected_bits(0.8, 64 * simhash.LANES)


def test_near_dedup_of_rows_that_share_an_id(spark):
    rnd = random.Random(14)
    words = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    base = words(300)
    unique, one, copy = " ".join(words(300)), " ".join(base), " ".join(base[:-1] + ["zz"])
    rows = [(3, one), (5, copy), (5, unique), (5, unique), (None, copy), (9, None), (9, unique.upper()), (7, " ")]
    out = simhash.near_dedup(spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter([(3, one), (5, unique), (5, unique), (None, copy), (9, None), (7, " ")])
