"""Operator 8, quality classifier: a byte-level convolutional network in numpy.

Every byte becomes a small vector (its folded letter, whether it is a capital, whether it is a symbol); FILTERS learned filters of
WIDTH bytes slide over the whole text. The text is covered by chunks of CHUNK places that overlap by WIDTH - 1 bytes; in each chunk
each filter's greatest response is kept, and over the chunks the greatest and the mean go into one logistic probability of being
clean (good quality and not toxic). Training is Adam on a bounded sample of labelled documents. One in HELD_OUT of them is held out:
training stops when their loss hasn't fallen for PATIENCE epochs, the network of least loss counts, and the threshold of keep is
the one that is right for most of them, both classes weighing the same.

Defined results: (doc_id, probability, keep) for every row. A null or empty text has probability 0. Repeated rows are scored
each; a null doc_id is scored too; null labels count as good quality and as not toxic; without labels, or with one class only, every
text that isn't empty has the share of clean labels (1 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import documents, table
from .quality_rules import STEM, learn_lexicon, stem_hash

DIM = 6
WIDTH = 8
FILTERS = 24
CHUNK = 2048
#: Labelled documents that training reads at most, those of least hash, and bytes of one training text per step.
MAX_TRAIN = 6000
EPOCHS = 24
HELD_OUT = 5
PATIENCE = EPOCHS
_BLOCK = 1 << 13
#: Columns of one matrix product: too few for the linear algebra library to start threads of its own, which would fight the other tasks for the cores.
_COLUMNS = 200


def _vectors() -> np.ndarray:
    """The vector of each byte; 0, which pads, is the zero vector."""
    rng = np.random.default_rng(7)
    v = np.zeros((256, DIM), np.float32)
    v[:, :4] = rng.normal(size=(256, 4))[W._FOLD]
    v[:, :4] /= np.linalg.norm(v[:, :4], axis=1, keepdims=True)
    upper = np.arange(65, 91)
    v[upper, 4] = 0.7
    symbol = ~W._IS_WORD
    symbol[[0, 9, 10, 13, 32]] = False
    v[symbol, 5] = 0.7
    v[0] = 0
    return v


VECTORS = _vectors()


@dataclass
class Network:
    w: np.ndarray  # (WIDTH * DIM, FILTERS)
    c: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,): greatest over chunks, mean over chunks
    bias: float
    constant: float | None = None
    threshold: float = 0.5


def chunks_of(size: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, end, document) of the chunks of texts of `size` bytes that begin at `begin`; an empty text has none."""
    n = -(-size // CHUNK)
    doc = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = begin[doc] + k * CHUNK
    return first, np.minimum(first + CHUNK, begin[doc] + size[doc]), doc


def _spread(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with WIDTH zeros behind each, and where they begin."""
    size = np.diff(off)
    begin = off[:-1] - off[0] + WIDTH * np.arange(len(size))
    out = np.zeros(int(size.sum()) + WIDTH * (len(size) + 1), np.uint8)
    out[np.repeat(begin - (off[:-1] - off[0]), size) + np.arange(size.sum())] = raw[off[0] : off[-1]]
    return out, begin


_ROWS = np.ascontiguousarray(VECTORS.T)


def convolve(w: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """(FILTERS, places) responses of the filters (WIDTH * DIM, FILTERS) at each place of the bytes that has WIDTH bytes from it on."""
    n = len(raw) - WIDTH + 1
    v, x, z = _ROWS[:, raw], np.empty((WIDTH * DIM, n), np.float32), np.empty((FILTERS, n), np.float32)
    for j in range(WIDTH):
        x[j * DIM : (j + 1) * DIM] = v[:, j : j + n]
    w = np.ascontiguousarray(w.T, np.float32)
    for a in range(0, n, _COLUMNS):
        z[:, a : a + _COLUMNS] = w @ x[:, a : a + _COLUMNS]
    return z


def responses(net: Network, spread: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The greatest response of each filter in each chunk."""
    best = np.full((len(first), FILTERS), -np.inf, np.float32)
    if not len(first):
        return best
    for x in range(0, len(spread) - WIDTH + 1, _BLOCK):
        y = min(x + _BLOCK, len(spread) - WIDTH + 1)
        a, b = np.searchsorted(end, x, "right"), np.searchsorted(first, y, "left")
        if a >= b:
            continue
        z = np.concatenate([convolve(net.w, spread[x : y + WIDTH - 1]), np.full((FILTERS, 1), -np.inf, np.float32)], 1)  # a last place, so that a chunk may end at the block's end
        lo, hi = np.maximum(first[a:b], x) - x, np.minimum(end[a:b], y) - x
        cut = np.stack([lo, hi], 1).ravel()
        best[a:b] = np.maximum(best[a:b], np.maximum.reduceat(z, cut, axis=1)[:, ::2].T)
    return best


def features(net: Network, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    spread, begin = _spread(raw, off)
    first, end, doc = chunks_of(np.diff(off), begin)
    r = np.maximum(responses(net, spread, first, end) + net.c, 0)
    out = np.zeros((len(off) - 1, 2 * FILTERS), np.float32)
    if len(doc):
        a = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[a], :FILTERS] = np.maximum.reduceat(r, a, axis=0)
        out[doc[a], FILTERS:] = np.add.reduceat(r, a, axis=0) / np.diff(np.append(a, len(doc)))[:, None]
    return out


def score(net: Network, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The probability of each text."""
    size = np.diff(off)
    if net.constant is not None:
        return np.where(size > 0, net.constant, 0.0)
    x = features(net, raw, off).astype(np.float64) @ net.out + net.bias
    return np.where(size > 0, 1 / (1 + np.exp(-np.clip(x, -40, 40))), 0.0)


def _windows_at(spread: np.ndarray, at: np.ndarray) -> np.ndarray:
    return VECTORS[spread[at[:, None] + np.arange(WIDTH)[None, :]]].reshape(len(at), -1)


def _first_filters(texts: list[str], clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters to begin with: stems that are typical of documents that aren't clean, and places of such documents."""
    rng = np.random.default_rng(11)
    rows = []
    lexicon = learn_lexicon(texts, ~clean)
    strength = dict(zip(lexicon.stems.tolist(), lexicon.weights.tolist()))
    seen: dict[int, bytes] = {}
    for w in W.split(pa.array([t for t, c in zip(texts, clean) if not c], pa.large_string())):
        h = stem_hash(w)
        for i in np.flatnonzero(lexicon.score(h) > 0).tolist():
            seen.setdefault(int(h[i]), w.folded[w.start[i] : min(w.end[i], w.start[i] + min(STEM, WIDTH))].tobytes())
    for h in sorted(seen, key=lambda x: -strength[x])[: FILTERS - 6]:
        b = np.zeros(WIDTH, np.uint8)
        b[1 : 1 + len(seen[h][: WIDTH - 1])] = np.frombuffer(seen[h][: WIDTH - 1], np.uint8)
        rows.append(VECTORS[b].ravel())
    bad = [t.encode() for t, c in zip(texts, clean) if not c and len(t) > WIDTH]
    while len(rows) < FILTERS:
        if not bad:
            rows.append(rng.normal(size=WIDTH * DIM).astype(np.float32))
            continue
        raw = np.frombuffer(bad[int(rng.integers(len(bad)))], np.uint8)
        at = int(rng.integers(len(raw) - WIDTH + 1))
        rows.append(VECTORS[raw[at : at + WIDTH]].ravel())
    w = np.stack(rows, 1).astype(np.float32)
    norm = np.linalg.norm(w, axis=0)
    return w / norm, (-0.75 * norm).astype(np.float32)


def _peaks(w: np.ndarray, spread: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, response) of each filter's greatest response in each chunk."""
    top, best = np.zeros((len(first), FILTERS), np.int64), np.zeros((len(first), FILTERS), np.float32)
    every = np.arange(FILTERS)
    for j, (a, b) in enumerate(zip(first.tolist(), end.tolist())):
        z = convolve(w, spread[a : b + WIDTH - 1])
        k = z.argmax(1)
        top[j], best[j] = a + k, z[every, k]
    return top, best


def loss_and_gradients(params: list[np.ndarray], raws: list[bytes], clean: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The weighted mean cross-entropy of a batch of texts that aren't empty, and its gradient by filters, their offsets, output weights and bias."""
    raw = np.frombuffer(b"".join(raws), np.uint8)
    spread, begin = _spread(raw, np.concatenate([[0], np.cumsum([len(r) for r in raws])]))
    first, end, doc = chunks_of(np.array([len(r) for r in raws]), begin)
    top, best = _peaks(params[0], spread, first, end)
    r = np.maximum(best + params[1], 0).astype(np.float64)
    n = np.bincount(doc, minlength=len(raws))
    a = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    feat = np.concatenate([np.maximum.reduceat(r, a, axis=0), np.add.reduceat(r, a, axis=0) / n[:, None]], 1)
    x = np.clip(feat @ params[2] + params[3][0], -40, 40)
    loss = float((weight * np.where(clean, np.logaddexp(0, -x), np.logaddexp(0, x))).mean())
    g = (1 / (1 + np.exp(-x)) - clean) * weight / len(raws)
    is_top = (r == feat[doc][:, :FILTERS]) & (r > 0)
    dr = g[doc][:, None] * (is_top * params[2][:FILTERS] + params[2][FILTERS:] / n[doc][:, None]) * (r > 0)
    gw = np.zeros_like(params[0])
    for f in range(FILTERS):
        on = np.flatnonzero(dr[:, f])
        if len(on):
            gw[:, f] = dr[on, f] @ _windows_at(spread, top[on, f])
    return loss, [gw, dr.sum(0), feat.T @ g, np.array([g.sum()])]


def _network(params: list[np.ndarray]) -> Network:
    return Network(params[0].astype(np.float32), params[1].astype(np.float32), params[2].copy(), float(params[3][0]))


def best_threshold(p: np.ndarray, clean: np.ndarray) -> float:
    """The probability midway between two neighbours that is right for most, both classes weighing the same; the middle one of the best."""
    o = np.argsort(p, kind="stable")
    q, c = p[o], clean[o]
    right = np.concatenate([[0], np.cumsum(~c)]) / max(1, (~c).sum()) + np.concatenate([np.cumsum(c[::-1])[::-1], [0]]) / max(1, c.sum())
    between = np.concatenate([[0], (q[1:] + q[:-1]) / 2, [1]])
    real = np.concatenate([[True], q[1:] != q[:-1], [True]])
    best = np.flatnonzero(real & (right >= right[real].max() - 1e-12))
    return float(between[best[len(best) // 2]])


def train(texts: list[str], clean: np.ndarray, epochs: int = EPOCHS, batch: int = 24, rate: float = 0.05) -> Network:
    """A network by Adam; both classes weigh the same in the loss."""
    if not len(texts) or clean.all() or not clean.any():
        return Network(np.zeros((WIDTH * DIM, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), 0.0, float(clean.mean()) if len(texts) else 1.0, 0.35)
    held = np.arange(len(texts)) % HELD_OUT == HELD_OUT - 1
    if not all(clean[part].any() and not clean[part].all() for part in (held, ~held)):
        held[:] = False  # too few to spare
    w, c = _first_filters([t for t, h in zip(texts, held) if not h], clean[~held])
    raws = [t.encode() for t in texts]
    weight = np.where(clean, 0.5 / clean.mean(), 0.5 / (1 - clean.mean()))
    rng = np.random.default_rng(3)
    params = [w.astype(np.float64), c.astype(np.float64), np.full(2 * FILTERS, -0.1), np.array([0.5])]
    moment, square, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    own, judge = np.flatnonzero(~held), np.flatnonzero(held if held.any() else ~held)
    judged, off = np.frombuffer(b"".join(raws[i] for i in judge), np.uint8), np.concatenate([[0], np.cumsum([len(raws[i]) for i in judge])])
    least, best, since, p = np.inf, _network(params), 0, np.zeros(len(judge))
    for epoch in range(epochs):
        order = rng.permutation(own)
        for x in range(0, len(order), batch):
            idx = order[x : x + batch]
            _, grads = loss_and_gradients(params, [raws[i] for i in idx], clean[idx], weight[idx])
            grads[2] += 1e-4 * params[2]
            t += 1
            step = rate * (0.5 ** (epoch / max(1, epochs / 3)))
            for i, d in enumerate(grads):
                moment[i] = 0.9 * moment[i] + 0.1 * d
                square[i] = 0.99 * square[i] + 0.01 * d * d
                scale = step if i >= 2 else step * 0.3
                params[i] = params[i] - scale * (moment[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.99**t)) + 1e-8)
        net = _network(params)
        q = np.clip(score(net, judged, off), 1e-9, 1 - 1e-9)
        loss = float((weight[judge] * -np.log(np.where(clean[judge], q, 1 - q))).mean())
        since += 1
        if loss < least - 1e-4:
            least, best, since, p = loss, net, 0, q
        if since >= PATIENCE:
            break
    best.threshold = best_threshold(p, clean[judge])
    return best


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Network:
    picked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"), F.max("toxic").alias("_toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text <> ''").select("text", "_quality", "_toxic", F.xxhash64("doc_id", "text").alias("_o")).orderBy("_o", "_quality", "_toxic").toArrow()
    clean = np.array([q != 0 and t != 1 for q, t in zip(rows["_quality"].to_pylist(), rows["_toxic"].to_pylist())], bool)
    return train(rows["text"].to_pylist(), clean)


def classify(docs: DataFrame, net: Network, threshold: float | None = None) -> DataFrame:
    threshold = net.threshold if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = W.text_buffers(b["text"])
            p = [score(net, raw, off[a : e + 1]) for a, e in W.slices(off, 1 << 20)]
            p = np.concatenate(p) if p else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(p), pa.array(p >= threshold)], ["doc_id", "probability", "keep"])

    return documents(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, probability double, keep boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
