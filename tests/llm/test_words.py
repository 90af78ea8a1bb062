import random

import numpy as np
import pyarrow as pa
import pytest

from lotwise.llm import words as W


def plain(text):
    import re

    out = []
    for m in re.findall(rb"(?:[0-9A-Za-z]|[\x80-\xff])+", text.encode()):
        out.append(m.decode().lower() if all(ord(c) < 0x180 for c in m.decode()) else m.decode())
    return out


@pytest.mark.parametrize("most", [1, 64, 1 << 20])
def test_words_are_those_of_a_plain_split(most):
    texts = ["Hello, World! hello", None, "", "Élan ÉLAN élan", "a", "x-y_z 12.5", "tail\n", "é" * 5000, "¡Año! ÑU ñu"]
    seen, at = {}, 0
    for w in W.split(pa.array(texts, pa.string()), most):
        for d in range(w.docs):
            got = [w.raw[a:b].tobytes().decode() for a, b in zip(w.start[w.at[d] : w.at[d + 1]], w.end[w.at[d] : w.at[d + 1]])]
            want = plain(texts[w.first + d] or "")
            assert [g.lower() for g in got] == want
            for g, h in zip(want, w.h[w.at[d] : w.at[d + 1]].tolist()):
                assert seen.setdefault(g, h) == h
            at += 1
    assert at == len(texts) and len(set(seen.values())) == len(seen)


def test_grams_depend_on_their_words_alone():
    w = next(W.split(pa.array(["a b c d e", "x a b c y", "c"])))
    g, ok = W.gram_hash(w, 3)
    assert g[0] == g[6] and len({int(x) for x in g[ok]}) == 5
    p = W.prefix_hash(w.h)
    assert W.range_hash(p, np.array([0]), np.array([3])) == g[0]


@pytest.mark.parametrize("seed", range(4))
def test_winnowing_leaves_no_window_without_an_anchor(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(n)) for n in (0, 3, 9, 10, 30, 200)] + ["same " * 100]
    k, window = 4, 7
    for w in W.split(pa.array(texts)):
        p, h = W.winnow(w, k, window)
        g, ok = W.gram_hash(w, k)
        assert (g[p] == h).all() and ok[p].all()
        for d in range(w.docs):
            a, n = w.at[d], w.at[d + 1] - w.at[d] - k + 1
            own = {int(x) for x in p if a <= x < w.at[d + 1]}
            for i in range(a, a + n - window + 1):
                assert own & set(range(i, i + window)), (d, i)
            assert n <= 0 or own


def test_shared_words_share_an_anchor():
    rng = random.Random(5)
    shared = [str(rng.random()) for _ in range(10)]
    texts = [" ".join([str(rng.random()) for _ in range(n)] + shared + [str(rng.random()) for _ in range(m)]) for n, m in ((0, 5), (17, 0), (40, 3))]
    w = next(W.split(pa.array(texts)))
    _, h = W.winnow(w, 4, 2 * 10 - 4 + 1)  # a number has two words: 20 words are shared
    p, h = W.winnow(w, 4, 17)
    d = np.searchsorted(w.at, p, "right") - 1
    assert set.intersection(*[{int(x) for x in h[d == i]} for i in range(3)])


def test_heavy_hitters_are_counted_over_all_rows(spark):
    from lotwise.llm.common import heavy_hitters

    rows = spark.range(3 * 5000).selectExpr("id as k", "id % 3 + if(id < 3, 10, 0) as h").union(spark.range(3).selectExpr("7L as k", "0L as h"))
    assert sorted(heavy_hitters(rows, lambda d: d, 5000).tolist()) == [0]
    one = spark.range(5001).selectExpr("1L as k", "id * 0 + 4 as h")
    assert heavy_hitters(one, lambda d: d, 5000).tolist() == [4]
