import random

import pytest

from lotwise.llm import positional_index as I

from .conftest import prose, table

ITEMS = "item_id bigint, text string"


def brute(docs, items):
    """(doc, item, place in the document, place in the item, words) of the longest run on each diagonal that is long enough."""
    out = set()
    for d, x in docs:
        for i, t in items:
            if len(t) < I.LEAST:
                continue
            need = min(I.PHRASE, len(t))
            for s in range(-len(t), len(x)):
                best, run = (0, 0), 0
                for j in range(len(t)):
                    run = run + 1 if 0 <= s + j < len(x) and x[s + j] == t[j] else 0
                    if run > best[0]:
                        best = (run, j + 1)
                if best[0] >= need:
                    out.add((d, i, s + best[1] - best[0], best[1] - best[0], best[0]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_phrases_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, n, 60)) for i, n in enumerate([3, 4, 7, 8, 9, 20, 40])]
    docs = []
    for d in range(40):
        w = prose(rng, rng.randrange(0, 80), 60)
        if rng.random() < 0.6:
            t = rng.choice(items)[1]
            a = rng.randrange(len(t))
            w[rng.randrange(len(w) + 1) :][:0] = []
            at = rng.randrange(len(w) + 1)
            w[at:at] = t[a : a + rng.randrange(4, 30)]
        docs.append((d + 1, w))
    got = I.matches(spark, table(spark, [(d, " ".join(w)) for d, w in docs]), spark.createDataFrame([(i, " ".join(t)) for i, t in items], ITEMS)).collect()
    phrases = {(r.doc_id, r.item_id, r.doc_word, r.item_word, r.n_words) for r in got if r.kind == "phrase"}
    assert phrases == brute(docs, items)


def test_edited_items_match_by_proximity(spark):
    rng = random.Random(8)
    item = prose(rng, 30)
    edited = list(item)
    for i in range(5, 30, 6):  # no 8 words in a row are left
        edited[i] = f"other{i}"
    moved = item[:3] + ["filler"] + item[3:7] + ["more"] + edited[7:]
    half = item[:6] + prose(rng, 20) + item[20:26]
    docs = [" ".join(prose(rng, 20) + x + prose(rng, 20)) for x in (edited, moved, half, [])]
    rows = I.matches(spark, table(spark, docs), spark.createDataFrame([(7, " ".join(item))], ITEMS)).collect()
    assert {r.doc_id for r in rows} == {1, 2} and {r.kind for r in rows} == {"proximity"} and all(r.share >= I.SHARE for r in rows)


def brute_near(docs, items):
    """(doc, item) where, seen from some word at its own place, enough of the item's words lie near theirs."""
    out = set()
    for d, x in docs:
        at = {}
        for p, w in enumerate(x):
            at.setdefault(w, []).append(p)
        for i, t in items:
            if len(t) < I.LEAST:
                continue
            for begin in {p - o for o, w in enumerate(t) for p in at.get(w, [])}:
                near = sum(any(abs(p - begin - o) <= I.SLACK for p in at.get(w, [])) for o, w in enumerate(t))
                if near >= I.SHARE * len(t):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_proximity_is_that_of_brute_force(spark, seed):
    rng = random.Random(100 + seed)
    items = [(i, prose(rng, n, 400)) for i, n in enumerate([4, 9, 15, 30, 60])]
    docs = []
    for d in range(60):
        x = list(rng.choice(items)[1])
        for _ in range(rng.randrange(len(x) // 2 + 1)):
            j = rng.randrange(len(x))
            x[j : j + 1] = rng.choice([[], [f"other{rng.randrange(99)}"], [x[j], "more"]])
            x = x or ["none"]
        docs.append((d + 1, prose(rng, rng.randrange(9), 400) + x + prose(rng, rng.randrange(9), 400)))
    got = I.matches(spark, table(spark, [(d, " ".join(w)) for d, w in docs]), spark.createDataFrame([(i, " ".join(t)) for i, t in items], ITEMS)).collect()
    want = {(d, i) for d, i, *_ in brute(docs, items)} | brute_near(docs, items)
    found = {(r.doc_id, r.item_id) for r in got}
    assert found <= want and len(found) >= 0.97 * len(want) and len(want) > 20
    assert {(r.doc_id, r.item_id) for r in got if r.kind == "proximity"} <= brute_near(docs, items)


def test_an_index_of_all_terms_gives_the_same(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(prose(rng, 12))) for i in range(5)]
    docs, bench = table(spark, [t + " " + " ".join(prose(rng, 9)) for _, t in items]), spark.createDataFrame(items, ITEMS)
    some = {tuple(r) for r in I.matches(spark, docs, bench).collect()}
    monkeypatch.setattr(I, "MAX_TERMS", 3)
    assert I.vocabulary_of(bench, 3) is None and {tuple(r) for r in I.matches(spark, docs, bench).collect()} == some and len(some) >= 5


def test_documents_without_an_id_and_texts_of_one_id(spark, tmp_path):
    rng = random.Random(4)
    item, clean = " ".join(prose(rng, 20)), " ".join(prose(rng, 30))
    docs = table(spark, [(None, clean + " " + item), (None, clean), (5, item), (5, clean), (6, clean)])
    bench = spark.createDataFrame([(1, item, "x")], "item_id bigint, text string, doc_id string")
    assert sorted(str(r.doc_id) for r in I.matches(spark, docs, bench).collect()) == ["5", "None"]
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((str(r.doc_id), r.text) for r in I.stage(spark, docs, f"file://{tmp_path}").collect()) == sorted([("None", clean), ("5", clean), ("6", clean)])


def test_shorter_items_match_where_they_are_asked_for(spark):
    docs, bench = table(spark, ["we say no to it", "yes"]), spark.createDataFrame([(1, "no"), (2, "say no")], ITEMS)
    assert I.matches(spark, docs, bench).count() == 0
    assert {(r.doc_id, r.item_id, r.doc_word) for r in I.matches(spark, docs, bench, least=1).collect()} == {(1, 1, 2), (1, 2, 1)}


def test_anchors_are_the_rarest_of_their_windows():
    items = I.read_items([(1, "a b c d e f g h i j"), (2, "x y"), (3, "a a b b")])
    assert items.ids == [1, 3]
    df = list(range(len(items.vocabulary)))
    import numpy as np

    got = I.anchors(items, np.array(df))
    for i in range(2):
        t = items.term[items.at[i] : items.at[i + 1]]
        n = min(I.PHRASE, len(t))
        own = {o for j, o, _ in got if j == i}
        for a in range(len(t) - n + 1):
            assert min(range(a, a + n), key=lambda o: (t[o], o)) in own


def test_batches_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join(prose(rng, 12))) for i in range(9)]
    docs = table(spark, [t + " " + " ".join(prose(rng, 9)) for _, t in items])
    bench = spark.createDataFrame(items, ITEMS)
    one = {tuple(r) for r in I.matches(spark, docs, bench).collect()}
    monkeypatch.setattr(I, "MAX_WORDS", 30)
    assert {tuple(r) for r in I.matches(spark, docs, bench).collect()} == one and len(one) >= 9


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta alpha beta gamma delta"), (1, "alpha beta gamma delta alpha beta gamma delta"), (2, None), (3, ""), (None, "the same word the same word the same word"), (4, "no")], ITEMS)
    rows = I.matches(spark, odd, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (5, None)}
    assert len({tuple(r) for r in rows}) == len(rows)
    assert I.matches(spark, empty, bench).count() == 0 and I.matches(spark, odd, bench.limit(0)).count() == 0
