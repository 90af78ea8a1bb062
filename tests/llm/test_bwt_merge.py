import random

import numpy as np
import pytest

from lotwise.llm import bwt_merge as B

from .conftest import prose, table
from .test_suffix_trees import covered, joined, passages


@pytest.mark.parametrize("seed,symbols", [(0, 1 << 19), (1, 20), (2, 7)])
def test_repeats_lie_in_those_of_brute_force_and_reach_their_ends(spark, seed, symbols):
    """symbols: small shards, so that every merge spans many of them."""
    docs = passages(seed)
    df = table(spark, [" ".join(w) for w in docs])
    got = joined({(r.doc_id, r.start_word, r.end_word) for r in B.repeats(spark, df, symbols).collect()})
    want = joined(covered(docs, False))
    for d, a, b in got:
        assert any(e == d and x <= a and b <= y for e, x, y in want), (d, a, b)
    for d, a, b in want:
        inside = [(x, y) for e, x, y in got if e == d and a <= x and y <= b]
        assert inside and min(x for x, _ in inside) <= a + B.WINDOW - 1 and max(y for _, y in inside) >= b - B.WINDOW + 1, (d, a, b, inside)


@pytest.mark.parametrize("seed", range(4))
def test_shard_suffixes_are_sorted(seed):
    rng = np.random.default_rng(seed)
    strings = [rng.integers(0, 3, rng.integers(1, 12)).tolist() for _ in range(15)]
    flat = np.concatenate(strings).astype(np.uint64)
    last = np.zeros(len(flat), bool)
    last[np.cumsum([len(s) for s in strings]) - 1] = True
    r = B.sort_suffixes(flat, last)
    suffix = [tuple(s[i:]) for s in strings for i in range(len(s))]
    order = [suffix[i] for i in np.argsort(r)]
    assert sorted(r.tolist()) == list(range(len(flat))) and order == sorted(suffix)


def test_odd_rows(spark, odd, empty):
    assert {r.doc_id for r in B.repeats(spark, odd).collect()} <= {1, 5}
    assert B.repeats(spark, empty).count() == 0
    alone = table(spark, [" ".join(prose(random.Random(1), 200))])
    assert B.repeats(spark, alone).count() == 0


def test_frequent_hashes_give_the_same(spark, monkeypatch):
    docs = passages(5, 60) + [[], []]
    texts = [" ".join(w) for w in docs]
    df = table(spark, [*texts[:-2], (None, texts[3]), (None, texts[3])])
    want = sorted(map(str, B.repeats(spark, df).collect()))
    monkeypatch.setattr(B, "MOST_PLACES", 3)
    assert sorted(map(str, B.repeats(spark, df).collect())) == want and any("doc_id=None" in r for r in want)


@pytest.mark.parametrize("seed,symbols", [(0, 1 << 19), (1, 20), (2, 7), (3, 1 << 19), (4, 50)])
def test_repeats_are_those_of_brute_force(spark, seed, symbols):
    """Runs end at the word, also in periodic text whose copies overlap."""
    rng = random.Random(seed)
    docs = passages(seed)
    docs += [prose(rng, rng.randrange(60)) + (prose(rng, period) * 60)[:n] + prose(rng, rng.randrange(60)) for period, n in ((1, 51), (2, 53), (3, 54), (5, 55), (7, 57), (18, 69), (19, 70), (20, 90), (30, 81), (49, 100), (49, 98), (60, 150))]
    df = table(spark, [" ".join(w) for w in docs])
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in B.repeats(spark, df, symbols).collect())
    assert got == sorted(covered(docs, False))
