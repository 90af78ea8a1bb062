import random
from collections import Counter

import pyarrow as pa
import pytest

from lotwise.llm import sharding as H
from lotwise.llm.common import Scratch

from .conftest import prose, table


def families(seed, groups=25, size=8):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = prose(rng, 150, 10**6)
        for _ in range(size):
            w = list(base)
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("most", [100_000, 2])
def test_links_are_those_of_brute_force(spark, monkeypatch, most):
    """Every pair of documents and the number of grams that both have, whether a task sees a gram's documents or aggregates count them."""
    monkeypatch.setattr(H, "MOST_HELD", most)
    rng = random.Random(1)
    base = prose(rng, 120, 10**6)
    texts = [" ".join(base), " ".join(prose(rng, 30) + base), " ".join(prose(rng, 120, 10**6)), *families(7, groups=5, size=4), " ".join(base)]
    df = table(spark, texts)
    nodes, links = H.graph(spark, df, Scratch(spark))
    key = [r.k for r in df.select("doc_id", H.doc_key().alias("k")).orderBy("doc_id").collect()]
    g = grams_of(texts)
    want = {}
    for i in range(len(texts)):
        for j in range(i):
            if g[i] & g[j]:
                want[tuple(sorted((key[i], key[j])))] = len(g[i] & g[j])
    assert {(r.a, r.b): r.weight for r in links.collect()} == want and len(want) > 30 and nodes.count() == len(texts)


def plain_rounds(spark, size, links, shards, rounds, slack):
    """The propagation in loops; hashes come from Spark."""
    keys = sorted(size)
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint")
    hashed = lambda *c: {r.k: r.h for r in rows.select("k", H.F.xxhash64(*c).alias("h")).collect()}
    own = hashed("k")
    shard = {k: own[k] % shards for k in keys}
    near = {k: [] for k in keys}
    for a, b, w in links:
        near[a].append((b, w))
        near[b].append((a, w))
    room = sum(size.values()) / shards * (1 + slack)
    for r in range(rounds):
        active = hashed("k", H.F.lit(r))
        moves = []
        for k in keys:
            if near[k] and active[k] % 2 == 0:
                votes = Counter({shard[k]: 0})
                for o, w in near[k]:
                    votes[shard[o]] += w
                w, minus = max((w, -s) for s, w in votes.items())
                if w > votes[shard[k]] and -minus != shard[k]:
                    moves.append((shard[k], -minus, w - votes[shard[k]], k >> (64 - H.CLASS_BITS), k))
        flow = Counter()
        for s, t, *_, k in moves:
            flow[s, t] += size[k]
        load = Counter()
        for k in keys:
            load[shard[k]] += size[k]
        more = {p: flow[p] - min(flow[p], flow[p[1], p[0]]) for p in flow}
        quota = {}
        for (s, t), m in more.items():
            into = sum(v for (_, x), v in more.items() if x == t)
            free = max(room - load[t], 0.0)
            quota[s, t] = flow[s, t] - m + (min(m, free * m / into) if into else 0)
        new = dict(shard)
        for p in flow:
            total = 0
            mine = sorted((m for m in moves if m[:2] == p), key=lambda m: (-m[2], m[3]))
            for at, m in enumerate(mine):
                if at == 0 or m[2:4] != mine[at - 1][2:4]:
                    total += sum(size[o[4]] for o in mine if o[2:4] == m[2:4])
                if total <= quota[p]:
                    new[m[4]] = p[1]
        shard = new
    return shard


@pytest.mark.parametrize("seed,rounds", [(0, 1), (1, 4)])
def test_rounds_are_those_of_a_plain_propagation(spark, seed, rounds):
    scratch = Scratch(spark)
    nodes, links = H.graph(spark, table(spark, families(seed, groups=12)), scratch)
    size = {r.k: r.size for r in nodes.collect()}
    got = {r.k: r.shard for r in H.propagate(nodes, links, scratch, shards=4, rounds=rounds, slack=0.1).collect()}
    assert got == plain_rounds(spark, size, [tuple(r) for r in links.select("a", "b", "weight").collect()], 4, rounds, 0.1)


@pytest.mark.parametrize("seed", range(2))
def test_labels_cut_fewer_links_and_stay_even(spark, seed):
    df = table(spark, families(seed))
    scratch = Scratch(spark)
    nodes, links = H.graph(spark, df, scratch)
    before = H.propagate(nodes, links, scratch, shards=4, rounds=0)
    after = H.propagate(nodes, links, scratch, shards=4, rounds=10, slack=0.1)
    a, b = H.cut(links, before).first(), H.cut(links, after).first()
    # the cut by brute force
    shard = {r.k: r.shard for r in after.collect()}
    assert b["cut"] == sum(r.weight for r in links.collect() if shard[r.a] != shard[r.b])
    assert a["weight"] == b["weight"] and b["cut"] < 0.6 * a["cut"]
    load, start = Counter(), Counter()
    for r in after.collect():
        load[r.shard] += r.size
    for r in before.collect():
        start[r.shard] += r.size
    mean = sum(load.values()) / 4
    assert sum(load.values()) == sum(start.values())
    assert max(load.values()) <= max(1.1 * mean, max(start.values())) + 160


def test_large_groups_of_copies_come_together(spark):
    rng = random.Random(4)
    base = [" ".join(prose(rng, 100, 10**6)) for _ in range(8)]
    texts = [base[i % 8] for i in range(8 * 60)]
    shard = {r.doc_id: r.shard for r in H.assign(spark, table(spark, texts), shards=4, rounds=10, slack=0.1).collect()}
    apart = sum(shard[i] != shard[j] for i in shard for j in shard if i < j and i % 8 == j % 8)
    assert apart <= 0.35 * 8 * 60 * 59 / 2  # 0.75 by hash


def test_cut_by_hub_is_that_of_all_pairs(spark):
    df, scratch = table(spark, families(5, groups=6)), Scratch(spark)
    nodes, members = H.hubs(spark, df, scratch)
    links = H.graph(spark, df, scratch)[1].collect()
    state = H.propagate(nodes, members, scratch, shards=4, rounds=2)
    shard = {r.k: r.shard for r in state.collect()}
    got = H.cut(members, state).first()
    assert len(links) >= 6 * 28 - 6 and got["weight"] == sum(r.weight for r in links)
    assert got["cut"] == sum(r.weight for r in links if shard[r.a] != shard[r.b])


def grams_of(texts):
    """The grams of each text, as _scan gives them."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["k", "text"])
    out = {i: set() for i in range(len(texts))}
    for b in H._scan([batch]):
        for k, h in zip(b["k"].to_pylist(), b["h"].to_pylist()):
            if h is not None:
                out[k].add(h)
    return out


def test_passages_of_51_words_and_edited_copies_are_linked():
    rng = random.Random(8)
    texts, want = [], set()
    for _ in range(300):
        passage = prose(rng, 51, 10**6)
        texts += [" ".join(prose(rng, rng.randrange(100), 10**6) + passage + prose(rng, rng.randrange(100), 10**6)) for _ in range(2)]
        want.add((len(texts) - 2, len(texts) - 1))
    passages = len(want)
    for _ in range(300):
        base = prose(rng, 160, 10**6)
        texts += [" ".join(base), " ".join(f"x{rng.randrange(10**6)}" if i % 12 == 5 else x for i, x in enumerate(base))]
        want.add((len(texts) - 2, len(texts) - 1))
    # brute force: a common run of 50 words, or triples alike
    runs = [{tuple(t.split()[i : i + 50]) for i in range(len(t.split()) - 49)} for t in texts]
    threes = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    assert all(runs[a] & runs[b] or len(threes[a] & threes[b]) >= 0.55 * len(threes[a] | threes[b]) for a, b in want)
    g = grams_of(texts)
    linked = {(a, b) for a, b in want if g[a] & g[b]}
    assert sum(a < 2 * passages for a, _ in linked) == passages and len(linked) >= 0.97 * len(want)
    assert not any(g[a] & g[b] for a in range(len(texts)) for b in range(a) if (b, a) not in want)


def test_odd_rows(spark, odd, empty):
    rows = H.assign(spark, odd, shards=3, rounds=2).collect()
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted([("1", 120), ("2", 0), ("3", 0), ("None", 5), ("None", 0), ("4", 1), ("5", 60_000), ("6", 0), ("7", 1), ("8", 1), ("8", 6)])
    assert all(0 <= r.shard < 3 for r in rows)
    assert H.assign(spark, empty, rounds=1).count() == 0


def test_rounds_send_nothing_through_the_driver(spark):
    """Every broadcast costs the driver MBs however small its table is, and those of all rounds add up."""
    ran = spark._jsparkSession.sharedState().statusStore()
    before = ran.executionsCount()
    H.assign(spark, table(spark, families(2, groups=4)), shards=4, rounds=2, slack=0.1).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    new = ran.executionsList(before, 1000)
    plans = [new.apply(i).physicalPlanDescription() for i in range(new.size())]
    assert len(plans) > 8 and any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)
