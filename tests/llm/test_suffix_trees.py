import random

import numpy as np
import pytest

from lotwise.llm import suffix_trees as S

from .conftest import prose, table

L = S.MIN_WORDS


def passages(seed, docs=30):
    """Prose with passages of 30 to 130 words that stand in several documents, and some near copies."""
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (30, 49, 50, 51, 60, 75, 100, 130)]
    out = []
    for i in range(docs):
        words = prose(rng, rng.randrange(0, 150))
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            at = rng.randrange(len(words) + 1)
            words[at:at] = p
        if out and rng.random() < 0.3:
            words = list(rng.choice(out))
            for _ in range(rng.randrange(3)):
                words[rng.randrange(max(1, len(words))) :][:1] = ["edit"] if words else []
                if words:
                    words[rng.randrange(len(words))] = f"e{rng.random()}".replace(".", "")
        out.append(words)
    return out


def covered(docs, earlier):
    """Runs of words in windows of L words that stand elsewhere (earlier: that stand before)."""
    seen = {}
    for d, words in enumerate(docs):
        for i in range(len(words) - L + 1):
            seen.setdefault(tuple(words[i : i + L]), []).append((d, i))
    out = set()
    for d, words in enumerate(docs):
        mark = [False] * len(words)
        for i in range(len(words) - L + 1):
            at = seen[tuple(words[i : i + L])]
            if (min(at) < (d, i)) if earlier else len(at) > 1:
                mark[i : i + L] = [True] * L
        i = 0
        while i < len(mark):
            if mark[i]:
                j = i
                while j < len(mark) and mark[j]:
                    j += 1
                out.add((d + 1, i, j))
                i = j
            i += 1
    return out


def joined(spans):
    out = []
    for d, a, b in sorted(spans):
        if out and out[-1][0] == d and a <= out[-1][2]:
            out[-1] = (d, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((d, a, b))
    return set(out)


@pytest.mark.parametrize("seed,max_group", [(0, 100_000), (1, 100_000), (2, 100_000), (3, 2), (4, 2), (5, 1)])
def test_repeats_are_those_of_brute_force(spark, seed, max_group):
    docs = passages(seed)
    df = table(spark, [" ".join(w) for w in docs])
    rows = S.report(spark, df, max_group).collect()
    for earlier in (False, True):
        got = {(r.doc_id, r.start_word, r.end_word) for r in rows if r.removable == earlier}
        assert joined(got) == joined(covered(docs, earlier)), earlier


def test_long_copies_are_joined(spark):
    rng = random.Random(9)
    long = prose(rng, 3000, 10**6)
    docs = [long, prose(rng, 40) + long + prose(rng, 10), long[500:2500]]
    rows = S.report(spark, table(spark, [" ".join(w) for w in docs])).where("removable").collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in rows} == {(2, 40, 3040), (3, 0, 2000)}


def test_words_are_compared_whole(spark):
    """Words that agree in some of their hash's bits, or in their first letters, are different words."""
    rng = random.Random(5)
    p = prose(rng, 60, 10**6)
    docs = [p + ["k192"], p + ["k245"], p + ["k1924"]]
    rows = S.report(spark, table(spark, [" ".join(prose(rng, 20) + d + prose(rng, 9)) for d in docs])).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.removable) for r in rows} == {(1, 20, 80, False), (2, 20, 80, False), (3, 20, 80, False), (2, 20, 80, True), (3, 20, 80, True)}


@pytest.mark.parametrize("seed", range(6, 10))
def test_large_groups_give_the_same_rows(spark, seed):
    """Counts included, whether a task holds the group or aggregates count its prefixes."""
    docs = passages(seed, 60)
    df = table(spark, [" ".join(w) for w in docs])
    want = sorted(map(tuple, S.report(spark, df).collect()))
    assert want and sorted(map(tuple, S.report(spark, df, 2).collect())) == want
    assert max(r[3] for r in want) > 2


def test_rows_without_an_id_are_searched_last(spark):
    rng = random.Random(6)
    p = prose(rng, 70)
    df = table(spark, [(None, " ".join(p + prose(rng, 20))), (9, " ".join(prose(rng, 20) + p))])
    rows = S.report(spark, df).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in rows if r.removable} == {(None, 0, 70)}
    assert sorted(len(r.text.split()) for r in S.stage(spark, df, "").collect()) == [20, 90]


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError, match="integer"):
        S.report(spark, spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("seed", range(5))
def test_tree_of_sorted_suffixes(seed):
    rng = random.Random(seed)
    s = sorted("".join(rng.choice(["a ", "b ", "ab "]) for _ in range(rng.randrange(1, 9))).encode() for _ in range(30))
    lcp = S.common_prefixes(s)

    def common(a, b):
        a, b, n = a.split(), b.split(), 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    occ = list(range(len(s)))
    rng.shuffle(occ)
    depth, leaves = S.read_tree(lcp, 2)
    best = S._earlier_depths(lcp, occ)
    for i in range(len(s)):
        all_ = [common(s[i], s[j]) for j in range(len(s)) if j != i]
        assert depth[i] == (max(all_) if max(all_) >= 2 else 0)
        if depth[i]:
            assert leaves[i] == 1 + sum(c >= depth[i] for c in all_)
        assert best[i] == max([common(s[i], s[j]) for j in range(len(s)) if occ[j] < occ[i]], default=0)


def test_stage_cuts_later_copies_only(spark):
    rng = random.Random(3)
    p = prose(rng, 80)
    docs = [["Start,"] + p + ["end."], prose(rng, 20) + p + prose(rng, 20), list(p), prose(rng, 60)]
    df = table(spark, [" ".join(w) for w in docs])
    got = {r.doc_id: r for r in S.stage(spark, df, "").collect()}
    assert set(got) == {1, 2, 4}  # nothing is left of 3
    assert got[1].text == " ".join(docs[0]) and got[2].text.split() == docs[1][:20] + docs[1][100:]
    assert got[2].n_chars == len(got[2].text) and got[4].n_chars == len(" ".join(docs[3]))


def test_odd_rows(spark, odd, empty):
    rows = S.report(spark, odd).collect()
    assert {r.doc_id for r in rows} <= {1, 5}  # a repeated row is no copy; periodic text repeats itself
    out = S.stage(spark, odd, "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {(r.doc_id, r.text is None) for r in out.collect()} >= {(2, True), (None, True), (None, False), (8, False), (3, False)}
    assert S.report(spark, empty).count() == 0 and S.stage(spark, empty, "").count() == 0


def test_a_large_group_in_one_document_is_counted(spark, monkeypatch):
    """One document of all holds more places of an anchor than a group may have; a sample of documents missed it, and its repeats were lost."""
    monkeypatch.setattr(S, "MAX_GROUP", 4096)
    rows = S.report(spark, table(spark, ["again and " * 60_000, "no repeat here"]), 4096).where("not removable").collect()
    assert [r.doc_id for r in rows] == [1] and rows[0].start_word <= S.WINDOW and rows[0].end_word >= 120_000 - L - S.WINDOW
