"""Batched similarities against difflib, and the index against all pairs."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fairway.functions.similarity import FormIndex, block_ratios, common_subsequence

LATIN, CHINESE = "abcde ", "武汉南京上海港口码头长江一二三"


def words(seed, letters, n, longest):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("letters, longest", [(LATIN, 12), (LATIN, 70), (CHINESE, 9), ("ab", 64), ("ab", 260)])
def test_equals_difflib(letters, longest):
    a, b = words(1, letters, 400, longest), words(2, letters, 400, longest)
    b[:50] = a[:50]
    assert block_ratios(a, b).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc\U0001f600", max_size=20), st.text("abcd\U0001f600", max_size=20)), max_size=5))
def test_equals_difflib_at_random(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert block_ratios(a, b).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in pairs]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(row[j], above[j + 1]))
    return row[-1]


def test_common_subsequence():
    forms, texts = [w for w in words(3, LATIN, 60, 20) if w], [w for w in words(4, LATIN + "z", 30, 64) if w]
    index = FormIndex(dict.fromkeys(forms))
    for t in texts:
        pattern = np.array([index.letters.code.get(c, -1) for c in t], np.int64)
        assert common_subsequence(pattern, index.table, len(index.letters.code)).tolist() == [subsequence(t, f) for f in index.forms]


@pytest.mark.parametrize("letters, longest, least", [(LATIN, 10, 0.6), (CHINESE, 6, 0.5), ("ab", 80, 0.8), (LATIN, 10, 0.0)])
def test_index_finds_what_all_pairs_find(letters, longest, least):
    index = FormIndex(dict.fromkeys(words(5, letters, 300, longest)))
    texts = words(6, letters, 60, longest) + ["", "zz"]
    found, related = [], []
    for t in texts:
        equal, inside, count = index.related(t)
        assert equal == (index.forms.index(t) if t in index.forms else None)
        assert inside.tolist() == [k for k, f in enumerate(index.forms) if t in f or f in t]
        related.append(set(inside.tolist()))
        found.append(index.candidates(t, count, least, inside))
    for t, cand, inside, got in zip(texts, found, related, index.ratios(texts, found)):
        ratio = {k: SequenceMatcher(None, t, f).ratio() for k, f in enumerate(index.forms) if t and f and k not in inside}
        assert {k: r for k, r in zip(cand.tolist(), got.tolist()) if r >= least} == {k: r for k, r in ratio.items() if r >= least}


def test_few_pairs_are_verified():
    """Names of some ten letters at 0.6: the filters leave less than one pair in a hundred."""
    rnd = random.Random(9)
    part = [w for w in words(8, "aeioubcdfghlmnprst", 400, 7) if len(w) > 2]
    index = FormIndex(dict.fromkeys(f"{rnd.choice(part)} {rnd.choice(part)}" for _ in range(20_000)))
    texts = [f"{rnd.choice(part)} {rnd.choice(part)}" for _ in range(40)]
    found = [index.candidates(t, index.shared(t), 0.6, np.zeros(0, np.int64)) for t in texts]
    index.ratios(texts, found)
    assert index.seen == 40 * len(index.forms) and 0 < index.verified < 0.05 * index.seen
