import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lotwise.llm import simhash_dedup as S
from lotwise.llm import words as W
from lotwise.llm.common import whole_groups

from .conftest import prose, table


def triples(t):
    w = t.split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def near(a, b):
    a, b = triples(a), triples(b)
    return bool(a and b) and len(a & b) / len(a | b) >= S.JACCARD


def corpus(seed, groups=12, singles=80):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = prose(rng, rng.randrange(40, 200))
        for _ in range(rng.choice([2, 3, 8, 40])):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 15))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(w))
    out += [" ".join(prose(rng, rng.randrange(1, 200))) for _ in range(singles)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_pairs_of_brute_force_are_found_and_groups_are_linked(spark, seed):
    texts = corpus(seed)
    rows = {r.doc_id: r for r in S.groups(spark, table(spark, texts)).collect()}
    assert set(rows) == set(range(1, len(texts) + 1))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if near(texts[i], texts[j])]
    found = sum(rows[i + 1].group_id == rows[j + 1].group_id for i, j in pairs)
    assert pairs and found >= 0.95 * len(pairs)
    # every group is connected by pairs that are near copies
    label = list(range(len(texts)))
    for i, j in pairs:
        a, b = label[i], label[j]
        if a != b:
            label = [a if x == b else x for x in label]
    groups = {}
    for i, r in rows.items():
        groups.setdefault(r.group_id, []).append(i)
    for g, members in groups.items():
        assert g == min(members) and len({label[i - 1] for i in members}) == 1
        assert all(rows[i].copies == len(members) and rows[i].keep == (i == g) for i in members)


def cloud(seed, n, copies):
    rng = np.random.default_rng(seed)
    code = rng.integers(0, 2**64, n, dtype=np.uint64)
    for i in range(n - copies, n):
        flip = rng.choice(64, rng.integers(0, 11), replace=False)
        code[i] = code[rng.integers(0, max(1, (n - copies) // 4))] ^ np.bitwise_or.reduce(np.uint64(1) << flip.astype(np.uint64), initial=np.uint64(0))
    return rng.permutation(code)


@pytest.mark.parametrize("n,copies", [(1, 0), (2, 1), (24, 9), (25, 10), (400, 60), (1500, 1000)])
def test_graph_search_has_its_recall(n, copies):
    code = cloud(n, n, copies)
    got = set()
    for a, b in S.neighbours(code):
        got |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    d = S.distance(code[:, None], code[None, :])
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(d <= S.RADIUS, 1)))}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_saturated_queries_lose_no_partner():
    code = np.full(300, 5, np.uint64)
    seen = {i: set() for i in range(300)}
    for a, b in S.neighbours(code):
        for x, y in zip(a.tolist(), b.tolist()):
            seen[x].add(y)
    assert all(len(v) == 299 for v in seen.values())


def test_codes_are_majorities():
    w = next(W.split(pa.array(["a b c a b", "", "one"])))
    c = S.codes(w)
    h, ok = W.gram_hash(w, 2)
    own = sorted({int(x) for i, x in enumerate(h.tolist()) if ok[i] and i < 4})
    bits = np.unpackbits(np.array(own, np.uint64).view(np.uint8).reshape(-1, 8), axis=1).sum(0)
    assert c[0] == np.packbits(2 * bits > len(own)).view(np.uint64)[0] and c[1] == 0


def test_recall_against_exact_search_of_the_table(spark):
    df = table(spark, corpus(9))
    group = {r.doc_id: r.group_id for r in S.groups(spark, df).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    hits = [(r.doc_id, r.partner) for r in S.audit(df, 64).collect()]
    verified = [(a, b) for a, b in hits if near(texts[a], texts[b])]
    assert verified and sum(group[a] == group[b] for a, b in verified) >= 0.9 * len(verified)


def test_shards_in_parts_find_the_same_groups(spark, monkeypatch):
    df = table(spark, corpus(4))
    whole = {r.doc_id: r.group_id for r in S.groups(spark, df).collect()}
    for most in (2, 6):
        monkeypatch.setattr(S, "MOST_MEMBERS", most)
        assert {r.doc_id: r.group_id for r in S.groups(spark, df).collect()} == whole


def test_all_pairs_of_a_large_shard_meet_in_small_ones(spark):
    rows = spark.createDataFrame([(s, i) for s, n in ((1, 5), (2, 30), (3, 8)) for i in range(n)], "shard bigint, id bigint")
    got = {}
    for r in S.in_parts(rows, rows.groupBy("shard").agg(S.F.count("*").alias("n")), 8).collect():
        got.setdefault(r.shard, set()).add(r.id)
    meet = {(i, j) for m in got.values() for i in m for j in m if i < j}
    assert meet == {(i, j) for j in range(30) for i in range(j)} and got[1] == set(range(5)) and got[3] == set(range(8))
    assert max(len(m) for m in got.values()) <= 14  # parts are drawn by hash


def test_an_audit_needs_partners(monkeypatch):
    """A graph that finds only the queries themselves must not pass the audit; in the end the shard is compared exactly."""
    code = cloud(1, 400, 12)
    monkeypatch.setattr(S.SmallWorld, "search", lambda self, q, beam, n=None: (lambda at: (at[:, None].astype(np.int32), np.zeros((len(at), 1), np.int32)) if beam < 400 else (np.tile(np.arange(400, dtype=np.int32), (len(q), 1)), S.distance(q[:, None], code[None, :])))(np.array([int(np.flatnonzero(code == x)[0]) for x in q])))
    monkeypatch.setattr(S.SmallWorld, "__init__", lambda self, code: setattr(self, "code", code))
    got = {(min(x, y), max(x, y)) for a, b in S.neighbours(code) for x, y in zip(a.tolist(), b.tolist())}
    d = S.distance(code[:, None], code[None, :])
    assert got == {(i, j) for i, j in zip(*np.nonzero(np.triu(d <= S.RADIUS, 1)))} and got


def test_labels_are_classes():
    rng = random.Random(3)
    known, plain = S.Labels(60), list(range(60))
    for _ in range(90):
        x, y = rng.randrange(60), rng.randrange(60)
        if known.label[x] != known.label[y]:
            known.unite(x, y)
        plain = [plain[x] if v == plain[y] else v for v in plain]
    assert all((known.label[i] == known.label[j]) == (plain[i] == plain[j]) for i in range(60) for j in range(60))


def test_a_cluster_is_connected_without_all_its_pairs():
    rng = np.random.default_rng(4)
    code = np.uint64(12345) ^ np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 3).astype(np.uint64)) for _ in range(4000)], np.uint64)
    known, pairs = S.Labels(4000), 0
    for a, b in S.neighbours(code, label=known.label):
        pairs += len(a)
        for x, y in zip(a.tolist(), b.tolist()):
            if known.label[x] != known.label[y]:
                known.unite(x, y)
    assert len(np.unique(known.label)) == 1 and pairs < 4000 * 400


def test_pairs_that_share_hot_passages_only_are_found(spark, monkeypatch):
    """Two passages in a pair, each in many other documents: every shard in which a pair meets is a large one."""
    rng = random.Random(12)
    passages = [prose(rng, 40, 10**6) for _ in range(24)]
    texts = []
    for i in range(24):
        for j in range(i):
            texts += [" ".join(passages[i] + passages[j] + prose(rng, 16, 10**6)) for _ in range(2)]
    monkeypatch.setattr(S, "MOST_MEMBERS", 6)
    group = {r.doc_id: r.group_id for r in S.groups(spark, table(spark, texts)).collect()}
    pairs = [(i, i + 1) for i in range(0, len(texts), 2) if near(texts[i], texts[i + 1])]
    assert len(pairs) == 276 and sum(group[i + 1] == group[j + 1] for i, j in pairs) >= 0.97 * len(pairs)


def hot(seed, n):
    """Codes and sets of triples of n documents that share 25 triples; a few have near copies."""
    rng = np.random.default_rng(seed)
    shared, grams = rng.integers(0, 2**64, 25, dtype=np.uint64), []
    for _ in range(n):
        if grams and rng.random() < 0.05:
            g = grams[rng.integers(len(grams))].copy()
            other = rng.random(len(g)) < 0.1
            g[other] = rng.integers(0, 2**64, int(other.sum()), dtype=np.uint64)
        else:
            g = np.concatenate([shared, rng.integers(0, 2**64, rng.integers(14, 60), dtype=np.uint64)])
        grams.append(g)
    code = [np.packbits(2 * np.unpackbits(g.view(np.uint8).reshape(-1, 8), axis=1).sum(0) > len(g)).view(np.uint64)[0] for g in grams]
    return np.array(code), [np.unique((g >> np.uint64(32)).astype(np.uint32)) for g in grams]


def near_pairs(member):
    return [(i, j) for i in range(len(member)) for j in range(i) if S.jaccard(member[i], member[j]) >= S.JACCARD]


def test_a_shared_passage_is_not_verified_by_all_its_pairs(monkeypatch):
    code, member = hot(1, 1200)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(1200, np.int64)), pa.array(np.arange(1200)), pa.array(code.view(np.int64)), pa.array([m.tobytes() for m in member], pa.binary())], ["shard", "id", "code", "triples"])
    pairs, calls, jaccard = near_pairs(member), [], S.jaccard
    monkeypatch.setattr(S, "jaccard", lambda a, b: calls.append(1) or jaccard(a, b))
    edges = [(x, y) for b in S._edges(iter([batch])) for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist())]
    assert len(calls) < 10 * 1200
    assert set(edges) <= set(pairs) | {(y, x) for x, y in pairs}
    known = S.Labels(1200)
    for x, y in edges:
        known.unite(x, y)
    pairs = [(x, y) for x, y in pairs if S.distance(code[x], code[y]) <= S.RADIUS]
    assert len(pairs) > 20 and sum(known.label[x] == known.label[y] for x, y in pairs) >= 0.97 * len(pairs)


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()


def test_memory_of_a_shard_is_bounded():
    """Codes are compared and triples sorted a bounded number at a time, whatever the shard's size."""
    rng = np.random.default_rng(5)
    far = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    assert peak_mb(lambda: [*S.neighbours(far, radius=4)]) < 30  # without partners, all of them are audited
    code = np.uint64(12345) ^ np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 3).astype(np.uint64)) for _ in range(4000)], np.uint64)
    got = [(a.astype(np.int64) * 4000 + b) for a, b in S.neighbours(code, label=np.repeat([0, 1], 2000))]
    assert max(len(x) for x in got) <= 1 << 18
    i, j = np.divmod(np.concatenate(got), 4000)
    assert len(np.unique((i * 4000 + j)[(i < 2000) & (j >= 2000)])) == 2000 * 2000
    member = [np.unique(rng.integers(0, 2**32, 1500, dtype=np.uint32)) for _ in range(3000)]
    assert peak_mb(lambda: S.split(member)) < 130


def test_a_whole_group_is_held_once():
    """While a group of many batches is read, its batches are let go."""
    batches = (pa.RecordBatch.from_arrays([pa.array(np.full(1000, k // 40)), pa.array(np.arange(k * 1000, k * 1000 + 1000))], ["g", "x"]) for k in range(80))
    before, held, got = pa.total_allocated_bytes(), [], []
    for t in whole_groups((b.take(pa.array(np.arange(1000))) for b in batches), "g", 1):  # take() copies into Arrow's memory
        got.append((t["g"].unique().to_pylist(), t.num_rows, t["x"].to_pylist()))
        held.append((pa.total_allocated_bytes() - before) / t.nbytes)
    assert [x[:2] for x in got] == [([0], 40_000), ([1], 40_000)] and got[0][2] + got[1][2] == list(range(80_000))
    assert max(held) < 1.3


@pytest.mark.parametrize("seed", range(6))
def test_split_and_sketches_keep_every_near_pair(seed):
    rng = np.random.default_rng(seed)
    member = hot(seed, 150)[1] + [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint32)) for _ in range(150)]
    member += [np.arange(20, dtype=np.uint32), np.arange(11, dtype=np.uint32), np.arange(10, dtype=np.uint32)]  # 11 of 20 is exactly JACCARD
    pairs = near_pairs(member)
    of = {i: c for c, part in enumerate(S.split(member)) for i in part.tolist()}
    assert pairs and all(i in of and of[i] == of.get(j) for i, j in pairs)
    i, j = np.array(pairs).T
    assert (301, 300) in pairs and S._sifted(i, j, S.sketches(member), np.array([len(m) for m in member])).all()


def test_odd_rows(spark, odd, empty):
    rows = S.groups(spark, odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "3", "4", "5", "6", "7", "8", "8", "None", "None"])
    assert all(r.group_id == r.doc_id and r.keep and r.copies == 1 for r in rows)
    out = S.stage(spark, odd, "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted([*"123456788", "None", "None"])
    assert S.groups(spark, empty).count() == 0 and S.stage(spark, empty, "").count() == 0
    twins = table(spark, [(5, "same words here now"), (2, "Same words, here now!"), (9, "same words here now")])
    assert {(r.doc_id, r.group_id, r.copies) for r in S.groups(spark, twins).collect()} == {(2, 2, 3), (5, 2, 3), (9, 2, 3)}


def test_texts_of_one_id_are_documents_each(spark):
    a, b = " ".join(prose(random.Random(1), 60)), " ".join(prose(random.Random(2), 60))
    df = table(spark, [(7, a), (7, b), (3, b), (None, a), (None, "only here")])
    rows = {(r.doc_id, r.group_id, r.copies, r.keep) for r in S.groups(spark, df).collect()}
    assert rows == {(7, 7, 2, True), (7, 3, 2, False), (3, 3, 2, True), (None, 7, 2, False), (None, None, 1, True)}
    assert {(r.doc_id, r.text) for r in S.stage(spark, df, "").collect()} == {(7, a), (3, b), (None, "only here")}
    again = spark.createDataFrame([(1, a, "x", "s", 1), (1, a, "b", "t", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r.lang for r in S.stage(spark, again, "").collect()] == ["b"]
