import random

import numpy as np
import pyarrow as pa

from lotwise.llm import byte_cnn as C
from lotwise.llm import words as W

from .conftest import prose, table
from .test_quality_rules import corpus


def random_net(seed):
    rng = np.random.default_rng(seed)
    return C.Network(rng.normal(size=(C.WIDTH * C.DIM, C.FILTERS)).astype(np.float32), rng.normal(size=C.FILTERS).astype(np.float32), rng.normal(size=2 * C.FILTERS), 0.1)


def plain_features(net, text):
    raw = text.encode() + bytes(C.WIDTH)
    n = len(text.encode())
    z = np.array([C.VECTORS[np.frombuffer(raw[i : i + C.WIDTH], np.uint8)].ravel() @ net.w for i in range(n)])
    chunks = [np.maximum(z[a : a + C.CHUNK].max(0) + net.c, 0) for a in range(0, n, C.CHUNK)]
    return np.concatenate([np.max(chunks, 0), np.mean(chunks, 0)])


def test_every_place_of_every_text_counts():
    rng = random.Random(1)
    texts = ["a", "", "Ünï", " ".join(prose(rng, 30)), " ".join(prose(rng, 900)), "x" * C.CHUNK, "y" * (C.CHUNK + 1), "z" * (2 * C._BLOCK + 5) + "!"]
    net = random_net(0)
    raw, off = W.text_buffers(pa.array(texts))
    got = C.features(net, raw, off)
    for t, f in zip(texts, got):
        if t:
            assert np.allclose(f, plain_features(net, t), atol=1e-3), t[:10]
        else:
            assert not f.any()


def test_responses_are_the_plain_maximum_over_several_blocks():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, 3 * C._BLOCK + 700).astype(np.uint8)
    # at each block's last place, the only one where the filter responds
    for block in (1, 2, 3):
        text[block * C._BLOCK - 1] = ord("!")
    net = random_net(2)
    net.w[:] = 0
    net.w[5] = 1
    spread, begin = C._spread(text, np.array([0, len(text)]))
    for begin, size in ((begin, np.array([len(text)])), (np.array([100]), np.array([len(text) - 100]))):
        first, end, _ = C.chunks_of(size, begin)
        z = C.VECTORS[spread[: len(text)]][:, 5]
        want = np.array([z[a:e].max() for a, e in zip(first, end)])
        assert np.allclose(C.responses(net, spread, first, end), want[:, None])


def test_gradients_are_those_of_differences():
    rng = random.Random(7)
    raws = [" ".join(prose(rng, n)).encode() for n in (3, 40, 500, 900)]
    clean, weight = np.array([True, False, True, False]), np.array([0.7, 1.3, 0.7, 1.3])
    net = random_net(5)
    params = [net.w.astype(np.float64) * 0.2, net.c.astype(np.float64), net.out * 0.1, np.array([0.1])]
    loss, grads = C.loss_and_gradients(params, raws, clean, weight)
    x = C.features(C._network(params), np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])])) @ params[2] + 0.1
    assert abs(loss - np.mean(weight * np.where(clean, np.log1p(np.exp(-x)), np.log1p(np.exp(x))))) < 1e-4
    checked = 0
    for i, p in enumerate(params):
        for at in np.random.default_rng(i).permutation(p.size)[:25]:
            step, pair = 1e-2 if i == 0 else 1e-3, []
            for sign in (1, -1):
                moved = [q.copy() for q in params]
                moved[i].ravel()[at] += sign * step
                pair.append(C.loss_and_gradients(moved, raws, clean, weight)[0])
            slope = (pair[0] - pair[1]) / (2 * step)
            assert abs(slope - grads[i].ravel()[at]) <= 2e-4 + 0.05 * abs(slope), (i, at)
            checked += abs(slope) > 1e-4
    assert checked > 20


def test_the_threshold_is_right_for_most():
    rng = np.random.default_rng(2)
    clean = rng.random(200) < 0.7
    p = np.clip(rng.normal(np.where(clean, 0.7, 0.3), 0.2), 0, 1).round(2)
    right = lambda t: (p[clean] >= t).mean() + (p[~clean] < t).mean()
    assert right(C.best_threshold(p, clean)) >= max(right(t) for t in np.linspace(0, 1, 1001)) - 1e-9


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    texts, labels = corpus(rng, 700)
    docs, lab = table(spark, texts), spark.createDataFrame(labels[:450], "doc_id bigint, quality int, toxic int")
    rows = {r.doc_id: r for r in C.classify(docs, C.fit(docs, lab)).collect()}
    held = [(rows[i].keep, q == 1 and t == 0) for i, q, t in labels[450:]]
    assert np.mean([a == b for a, b in held]) >= 0.9
    assert np.mean([a for a, b in held if b]) >= 0.95


def test_odd_rows(spark, odd, empty):
    lab = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (8, 0, 1), (None, 0, 0), (7, None, None)], "doc_id bigint, quality int, toxic int")
    none = spark.createDataFrame([], lab.schema)
    rows = C.classify(odd, C.fit(odd, lab)).collect()
    assert len(rows) == odd.count() and all(r.probability == 0 and not r.keep for r in rows if r.doc_id in (2, 3))
    assert all(0 <= r.probability <= 1 for r in rows)
    assert {r.probability for r in C.classify(odd, C.fit(odd, none)).collect()} == {0.0, 1.0}
    assert C.classify(empty, C.fit(empty, lab)).count() == 0
