"""Operator 10, SimHash near-dedup: navigable small-world graphs over Hamming distance per shard.

A document's 64-bit SimHash comes from its distinct word pairs. Codes of unrelated texts lie about 32 bits apart
whatever the corpus, so distance alone can't route a query; shards are therefore routed by content: a document goes to one
shard for each of ROUTES smallest-hash word triples, and near copies meet in some shard almost surely. In each shard a
navigable small-world graph over Hamming distance is grown by insertion, every member of the shard is broadcast to the
whole shard as a query, and its beam grows until it reaches beyond the radius (so a query's partners are never capped) and until an
audit of queries against exact search has the wished recall. Pairs within the radius are verified on their whole sets
of word triples (32-bit hashes), and verified pairs are united by connected components. Pairs that are connected already need no
verification, and saturated queries are compared with what isn't connected to them only.

Documents that share a passage and little else lie within the radius of each other and are no near copies; their pairs would grow with
the square of the shard. Before its graph a shard is therefore split, and before their verification pairs are sifted, both by bounds that
no pair of a Jaccard of JACCARD and more fails: split() leaves out members of whose triples the shard shares too few and parts those whose
rarest triples (as many as make sure of a common one) have no chain of common ones, and sketches of triples bound from below how many two sets differ in.

A shard of a passage that more than MOST_MEMBERS documents share is cut into parts of half that size; every two parts make one shard,
so its members are broadcast to all parts, all pairs still meet and no task holds more than MOST_MEMBERS documents.

Defined results: a document is a distinct (doc_id, text); each gets one output row (doc_id, group_id, copies, keep). The one
to keep is that of least doc_id in its group (without doc_id last, then by hash), and group_id is its doc_id. Documents without words
(null or empty text) are alike only to themselves: each is its own group. A null doc_id is kept as null. Of rows that repeat doc_id and
text the pipeline stage keeps the one of least other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import DOC_COLUMNS, Scratch, components, doc_key, documents, int64, ranked_id, released, runs, small_batches, table, whole_groups

SHINGLE = 3
ROUTES = 6
RADIUS = 20
JACCARD = 0.55
RECALL = 0.95
DEGREE = 12
WIDEST = 64
_STEP = 256
BLOCK = 512
#: Members of a shard beyond which it is cut into parts, and beyond which fewer than BLOCK queries go at a time.
MOST_MEMBERS = 20_000
MANY_MEMBERS = 8192
#: Pairs of codes that are compared, and triples of a shard that are sorted, at a time.
MOST_PAIRS = 1 << 18
MOST_TRIPLES = 1 << 20
#: Probes that must have partners before an audit counts.
LEAST_PROBES = 8
_SALT = [W.mix(np.array([0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1)], np.uint64))[0] for i in range(ROUTES)]


def _grams(w: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-grams with their documents; a shorter document's words count as one gram."""
    g, ok = W.gram_hash(w, k)
    doc = w.doc_of_word()
    at = np.flatnonzero(ok)
    n = np.diff(w.at)
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return g[at], doc[at]
    p = W.prefix_hash(w.h)
    h = np.concatenate([g[at], W.range_hash(p, w.at[short], w.at[short + 1])])
    d = np.concatenate([doc[at], short])
    o = np.argsort(d, kind="stable")
    return h[o], d[o]


def _distinct(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.lexsort((h, d))
    h, d = h[o], d[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def codes(w: W.Words) -> np.ndarray:
    """SimHash of each document of the slice: bit b is set where most of its distinct word pairs have bit b set."""
    h, d = _distinct(*_grams(w, 2))
    out = np.zeros(w.docs, np.uint64)
    a, b = runs(d)
    step = 1 << 17
    for i, j, doc in zip(a.tolist(), b.tolist(), d[a].tolist()):
        on = sum(np.unpackbits(h[x : min(x + step, j)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for x in range(i, j, step))
        out[doc] = np.packbits(2 * on > j - i).view(np.uint64)[0]
    return out


def routes(h: np.ndarray, d: np.ndarray, docs: int) -> np.ndarray:
    """(docs, ROUTES) shard keys from triples sorted by document."""
    out = np.zeros((docs, ROUTES), np.uint64)
    a, _ = runs(d)
    if len(a):
        for r in range(ROUTES):
            out[d[a], r] = np.minimum.reduceat(W.mix(h ^ _SALT[r]), a) ^ np.uint64(r)
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, own = b["doc_id"].to_numpy(), b["k"].to_numpy()
        for w in W.split(b["text"]):
            h, d = _grams(w, SHINGLE)
            key = routes(h, d, w.docs)
            p = W.prefix_hash(w.h)
            body = W.range_hash(p, w.at[:-1], w.at[1:]) ^ W.mix(np.diff(w.at).astype(np.uint64))
            some = np.flatnonzero(np.diff(w.at) > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[w.first + some]),
                    pa.array(own[w.first + some]),
                    pa.array(int64(body[some])),
                    pa.array(int64(codes(w)[some])),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * ROUTES), pa.array(int64(key[some].ravel()))),
                ],
                ["doc_id", "k", "body", "code", "shards"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, k, body, code, shards) of documents with words; body is a hash of all their words, k their key, and doc_id ranks them."""
    rows = documents(docs, "doc_id", "text").select(ranked_id().alias("doc_id"), doc_key().alias("k"), "text")
    return rows.mapInArrow(released(_signatures), "doc_id bigint, k bigint, body bigint, code bigint, shards array<bigint>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct word triples of whole texts as sorted 32-bit hashes."""
    for b in batches:
        ids = b["id"].to_numpy(zero_copy_only=False)
        for w in W.split(b["text"]):
            h, d = _grams(w, SHINGLE)
            h, d = _distinct(h >> np.uint64(32), d)
            n = np.bincount(d, minlength=w.docs)
            data = h.astype(np.uint32)
            off = np.concatenate([[0], np.cumsum(n)]).astype(np.int64) * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids[w.first : w.first + w.docs]), pa.Array.from_buffers(pa.large_binary(), w.docs, [None, pa.py_buffer(off), pa.py_buffer(data.tobytes())]).cast(pa.binary())], ["id", "triples"])


def block_of(n: int) -> int:
    """Queries that go at a time in a shard of n members."""
    return max(1, min(BLOCK, BLOCK * MANY_MEMBERS // max(n, 1)))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int32)


def within(code: np.ndarray, q: np.ndarray, other: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, other) of all pairs within the radius but those with itself, MOST_PAIRS compared at a time."""
    step = max(1, MOST_PAIRS // max(len(other), 1))
    for x in range(0, len(q), step):
        i, j = np.nonzero(np.bitwise_count(code[q[x : x + step], None] ^ code[other][None, :]) <= radius)
        i, j = q[x + i], other[j]
        yield i[i != j], j[i != j]


class SmallWorld:
    """A navigable small-world graph over Hamming distance. Nodes are inserted in growing batches; each links to the
    DEGREE nearest nodes that a beam search finds, and they link back. Early links stay, they are the long ones."""

    def __init__(self, code: np.ndarray, beam: int = 32):
        self.code, n = code, len(code)
        self.links = np.full((n, 3 * DEGREE + 2), -1, np.int32)
        self.used = np.zeros(n, np.int32)
        first = min(n, DEGREE + 1)
        i, j = np.nonzero(~np.eye(first, dtype=bool))
        self._link(i, j)
        at = first
        while at < n:
            to = min(n, at + max(DEGREE, at // 2), at + 8 * block_of(at))
            found, dist = self.search(code[at:to], min(beam, at), at)
            near = np.take_along_axis(found, np.argsort(dist, axis=1, kind="stable"), 1)[:, :DEGREE]
            new = np.arange(at, to)
            self.links[at:to, : near.shape[1]] = near
            self.used[at:to] = near.shape[1]
            src, dst = near.ravel(), np.repeat(new, near.shape[1])
            ok = src >= 0
            self._link(src[ok], dst[ok])
            self._link(new - 1, new)  # the chain keeps the graph connected
            self._link(new, new - 1)
            at = to

    def _link(self, src: np.ndarray, dst: np.ndarray) -> None:
        """Links src[i] to dst[i]. A node without a free slot gives up one of its last third, chosen by the new neighbour;
        chain links are never given up."""
        o = np.argsort(src, kind="stable")
        src, dst = src[o], dst[o]
        a, e = runs(src)
        slot = self.used[src] + np.arange(len(src)) - np.repeat(a, e - a)
        width = self.links.shape[1] - 2
        spare = 2 * DEGREE + dst % (width - 2 * DEGREE)
        slot = np.where(slot < width, slot, spare)
        chain = np.abs(src - dst) == 1
        slot[chain] = width + (dst[chain] > src[chain])
        self.links[src, slot] = dst
        grown = np.bincount(src[~chain], minlength=len(self.used))
        self.used = np.minimum(self.used + grown, width).astype(np.int32)

    def search(self, q: np.ndarray, beam: int, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest of nodes 0..n-1 that each query finds (-1 pads) and their distances; queries go in step."""
        n = len(self.code) if n is None else n
        m, big = len(q), np.int32(99)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        entry = np.unique(np.linspace(0, n - 1, min(n, 4)).astype(np.int32))
        ids = np.full((m, beam + len(entry)), n, np.int32)
        ids[:, : len(entry)] = entry
        dist = np.full(ids.shape, big, np.int32)
        dist[:, : len(entry)] = distance(q[:, None], self.code[entry][None, :])
        done = ids == n
        seen[:, entry] = True
        ids, dist, done = self._best(ids, dist, done, beam)
        act = np.arange(m)
        while len(act):
            open_d = np.where(done[act], big, dist[act])
            k = min(2, beam)
            pick = np.argpartition(open_d, k - 1, axis=1)[:, :k] if beam > k else np.tile(np.arange(beam), (len(act), 1))
            live = np.take_along_axis(open_d, pick, 1) < big
            go = live.any(1)
            act, pick, live = act[go], pick[go], live[go]
            if not len(act):
                break
            node = np.where(live, ids[act[:, None], pick], n)
            done[act[:, None], pick] = True
            ext = np.where(node[:, :, None] < n, self.links[np.minimum(node, n - 1)], -1).reshape(len(act), -1)
            ext = np.where((ext >= 0) & (ext < n), ext, n)
            ext.sort(axis=1)
            ext[:, 1:][ext[:, 1:] == ext[:, :-1]] = n
            ext[seen[act[:, None], ext]] = n
            seen[act[:, None], ext] = True
            d = np.where(ext < n, distance(q[act][:, None], self.code[np.minimum(ext, n - 1)]), big)
            ids[act], dist[act], done[act] = self._best(np.concatenate([ids[act], ext], 1), np.concatenate([dist[act], d], 1), np.concatenate([done[act], ext == n], 1), beam)
        return np.where(ids == n, -1, ids), dist

    @staticmethod
    def _best(ids: np.ndarray, dist: np.ndarray, done: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if ids.shape[1] > beam:
            o = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
            ids, dist, done = (np.take_along_axis(x, o, 1) for x in (ids, dist, done))
        return ids, dist, done


def neighbours(code: np.ndarray, radius: int = RADIUS, recall: float = RECALL, audit: int = 48, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, partner) within the radius in one shard, in blocks of queries. Up to 2 * DEGREE codes the graph is complete, so
    all are compared. Beyond, an audit of evenly spread queries against exact search doubles the beam until, on average over the
    queries that have partners, the recall is reached; with few of them more queries are audited, all in the end. A beam that
    is wide enough for all nodes is exact. A query whose whole beam lies within the radius is asked again with twice the beam until it
    reaches beyond; past WIDEST it is compared with the whole shard, which is exact. `label`, which the caller may change between
    blocks, says what is connected already: saturated queries leave out what has their own label."""
    n = len(code)
    if n <= 2 * DEGREE:
        d = distance(code[:, None], code[None, :])
        a, b = np.nonzero(np.triu(d <= radius, 1))
        yield a, b
        return
    g = SmallWorld(code)

    def ask(q: np.ndarray, beam0: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, partner) pairs, and the queries that were compared exactly."""
        beam = beam0
        a, b, rest = [], [], q
        while len(rest) and beam <= max(WIDEST, beam0):
            ids, dist = g.search(code[rest], min(beam, n))
            near = (dist <= radius) & (ids >= 0)
            full = near.all(1) & (beam < n)
            use = near if beam * 2 > max(WIDEST, beam0) else near & ~full[:, None]  # pairs of saturated queries connect much of a cluster at once
            i, j = np.nonzero(use)
            a.append(rest[i])
            b.append(ids[i, j].astype(np.int64))
            rest, beam = rest[full], beam * 2
        return np.concatenate(a), np.concatenate(b), rest

    beam, probes, block = 32, audit, block_of(n)
    while beam < n:
        probe = np.unique(np.linspace(0, n - 1, min(n, probes)).astype(np.int64))
        have = np.zeros(len(probe), np.int64)
        for a, _ in within(code, probe, np.arange(n), radius):
            have += np.bincount(np.searchsorted(probe, a), minlength=len(probe))
        if (have > 0).sum() < LEAST_PROBES and len(probe) < n:
            probes *= 4
            continue
        found, open_ = np.zeros(len(probe), np.int64), have > 0
        for x in range(0, len(probe), block):
            a, b, saturated = ask(probe[x : x + block], beam)
            found += np.bincount(np.searchsorted(probe, a[a != b]), minlength=len(probe))
            open_[np.searchsorted(probe, saturated)] = False
        if not open_.any() or (found[open_] / have[open_]).mean() >= recall:
            break
        beam *= 2
    for x in range(0, n, block):
        a, b, rest = ask(np.arange(x, min(n, x + block)), beam)
        yield a[a != b], b[a != b]
        for one in np.unique(label[rest]).tolist() if label is not None else [None] * bool(len(rest)):
            # the label may have changed since: what was asked for stays a superset
            q = rest if one is None else rest[label[rest] == one]
            other = np.arange(n) if one is None else np.flatnonzero(label != one)
            yield from within(code, q, other, radius)


class Labels:
    """Connected members: label[i] is the same for all that are; the smaller class takes the label of the larger one."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {}

    def unite(self, x: int, y: int) -> None:
        a, b = int(self.label[x]), int(self.label[y])
        of_a, of_b = self.members.get(a) or [a], self.members.get(b) or [b]
        if len(of_a) < len(of_b):
            a, b, of_a, of_b = b, a, of_b, of_a
        self.label[of_b] = a
        self.members[a] = of_a + of_b if len(of_a) < 2 else of_a
        if len(of_a) >= 2:
            of_a.extend(of_b)
        self.members.pop(b, None)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    if min(len(a), len(b)) < JACCARD * max(len(a), len(b)):
        return 0.0
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _shared(member: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(triple, member) where several members hold the triple, by triple and member, and the number of such triples. Ranges of hashes
    go one after the other, so that triples of one member take little."""
    h, who = np.concatenate(member), np.repeat(np.arange(len(member), dtype=np.uint32), size)
    parts = max(1, -(-len(h) // MOST_TRIPLES))
    grams, docs, n = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
    for p in range(parts):
        own = (h >= (p << 32) // parts) & (h <= ((p + 1 << 32) // parts - 1))
        key = h[own].astype(np.uint64) << np.uint64(32) | who[own]
        key.sort()
        held = np.diff(np.append(np.flatnonzero(np.diff(key >> np.uint64(32), prepend=~np.uint64(0))), len(key)))
        shared = held > 1
        docs.append((key[np.repeat(shared, held)] & np.uint64(0xFFFFFFFF)).astype(np.int32))
        grams.append(np.repeat(np.arange(n, n + shared.sum(), dtype=np.int32), held[shared]))
        n += int(shared.sum())
    return np.concatenate(grams), np.concatenate(docs), n


def split(member: list[np.ndarray]) -> list[np.ndarray]:
    """Members of a shard by their sets of triples in classes that hold every pair of a Jaccard of JACCARD and more; members without
    a partner are in none. Both ends of such a pair hold JACCARD of their own triples in common, so a member goes when fewer are shared with
    any that are left; and with its triples in one order of all, the rarest first, at least one common triple is among the first
    size - need + 1 of each end."""
    n = len(member)
    size = np.array([len(m) for m in member], np.int64)
    need = np.maximum(np.ceil(JACCARD * size - 1e-6).astype(np.int64), 1)  # without the rounding of JACCARD
    gram, doc, grams = _shared(member, size)
    held = np.bincount(gram, minlength=grams)
    while True:
        shared = held[gram] > 1
        gram, doc = gram[shared], doc[shared]
        count = np.bincount(doc, minlength=n)
        left = (count >= need)[doc]
        if left.all():
            break
        gram, doc = gram[left], doc[left]
        held = np.bincount(gram, minlength=grams)
    o = np.lexsort((gram, held[gram], doc))
    gram, doc = gram[o], doc[o]
    first, end = runs(doc)
    rank = np.arange(len(doc)) - np.repeat(first, end - first)
    use = rank < (count - need + 1)[doc]  # triples that nobody shares come before these
    gram, doc = gram[use], doc[use]
    o = np.argsort(gram, kind="stable")
    gram, doc = gram[o], doc[o]
    a, e = runs(gram)
    label = np.arange(n)
    while len(a):
        low = np.repeat(np.minimum.reduceat(label[doc], a), e - a)
        new = label.copy()
        np.minimum.at(new, label[doc], low)
        np.minimum.at(new, doc, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    of = np.unique(doc)
    of = of[np.argsort(label[of], kind="stable")]
    return [of[x:y] for x, y in zip(*runs(label[of])) if y - x > 1]


def sketches(member: list[np.ndarray]) -> np.ndarray:
    """(members, words) bits, each the parity of the triples that fall on it: two sets differ in as many triples at least as their
    sketches in bits. About sixteen bits a triple of the median member, so that few fall together."""
    bits = 1 << int(np.clip(np.ceil(np.log2(16 * np.median([len(m) for m in member]) + 1)), 8, 12))
    out = np.zeros((len(member), bits // 64), np.uint64)
    for i, m in enumerate(member):
        odd = np.bincount(W.mix(m.astype(np.uint64)).astype(np.int64) & (bits - 1), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    return out


def _sifted(q: np.ndarray, p: np.ndarray, sketch: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which pairs may have a Jaccard of JACCARD: those that differ in no more triples than it allows, as far as the sketches show."""
    step = max(1, (1 << 18) // sketch.shape[1])
    most = (size[q] + size[p]) * ((1 - JACCARD) / (1 + JACCARD)) + 1e-6
    out = np.empty(len(q), bool)
    for i in range(0, len(q), step):
        x, y = q[i : i + step], p[i : i + step]
        out[i : i + step] = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int32) <= most[i : i + step]
    return out


def shard_edges(code: np.ndarray, member: list[np.ndarray]) -> list[tuple[int, int]]:
    """Verified edges that connect the near copies of a shard."""
    out: list[tuple[int, int]] = []
    for of in split(member) if len(code) > 2 * DEGREE else [np.arange(len(code))]:
        sets, known = [member[i] for i in of.tolist()], Labels(len(of))
        some = len(of) > 2 * DEGREE
        sketch, size = sketches(sets) if some else None, np.array([len(s) for s in sets])
        for qs, ps in neighbours(code[of], label=known.label):
            if some:
                apart = known.label[qs] != known.label[ps]
                qs, ps = qs[apart], ps[apart]
                near = _sifted(qs, ps, sketch, size)
                qs, ps = qs[near], ps[near]
            for i in range(0, len(qs), _STEP):
                q, p = qs[i : i + _STEP], ps[i : i + _STEP]
                apart = known.label[q] != known.label[p]
                for x, y in zip(q[apart].tolist(), p[apart].tolist()):
                    if known.label[x] != known.label[y] and jaccard(sets[x], sets[y]) >= JACCARD:
                        known.unite(x, y)
                        out.append((int(of[x]), int(of[y])))
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified edges of each shard. A pair whose ends are already connected in the shard needs no check of its own."""
    for t in whole_groups(batches, "shard", 1 << 12):
        shard, ids = t["shard"].to_numpy(), t["id"].to_numpy()
        new = np.ones(len(ids), bool)  # a repeated row is no member of its own
        new[1:] = (ids[1:] != ids[:-1]) | (shard[1:] != shard[:-1])
        t = t.filter(pa.array(new))
        shard, ids, code = t["shard"].to_numpy(), t["id"].to_numpy(), t["code"].to_numpy().view(np.uint64)
        sets = t["triples"].combine_chunks()
        sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
        out: list[tuple[int, int]] = []
        for a, b in zip(*(x.tolist() for x in runs(shard))):
            member = [np.frombuffer(sets[i].as_buffer(), np.uint32) for i in range(a, b)]
            out += [(ids[a + x], ids[a + y]) for x, y in shard_edges(code[a:b], member)]
        if out:
            e = np.array(out, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])


def in_parts(placed: DataFrame, size: DataFrame, most: int) -> DataFrame:
    """placed(shard, id, ...) with its size n per shard: shards of more than `most` members become one shard for every two of their parts."""
    parts = F.ceil(F.col("n") * 2 / most).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("_parts")).cast("int")
    other = F.explode(F.when(F.col("_parts") > 1, F.array_except(F.sequence(F.lit(0), F.col("_parts") - 1), F.array("_own"))).otherwise(F.array(F.lit(0))))
    cut = placed.join(size, "shard").withColumn("_parts", F.when(F.col("n") > most, parts).otherwise(1)).withColumn("_own", own).withColumn("_other", other)
    shard = F.when(F.col("_parts") > 1, F.xxhash64("shard", F.least("_own", "_other"), F.greatest("_own", "_other"))).otherwise(F.col("shard"))
    return cut.withColumn("shard", shard).drop("n", "_parts", "_own", "_other")


def kept(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(k, first, copies) of the documents that have near copies: first(doc_id, k) is the one of the group that is kept."""
    scratch = Scratch(spark)
    docs = documents(docs, "doc_id", "text")
    sig = scratch.save(signatures(docs))
    # texts of the same words are one node, the first of them
    heads = sig.groupBy("body").agg(F.min(F.struct("doc_id", "k"))["k"].alias("id"), F.min("code").alias("code"), F.min("shards").alias("shards"))
    same = sig.join(heads.select("body", "id"), "body").where("k <> id").select(F.col("k").alias("a"), F.col("id").alias("b"))
    placed = heads.select(F.explode("shards").alias("shard"), F.xxhash64("id", "body").alias("_n"), "id", "code")
    size = placed.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.col("_n").cast("decimal(20,0)")).alias("_who")).where("n > 1")
    once = size.groupBy("_who", "n").agg(F.min("shard").alias("shard")).select("shard", "n")  # shards of the same members count once
    placed = scratch.save(in_parts(placed.select("shard", "id", "code"), once, MOST_MEMBERS))
    wanted = placed.select("id").distinct().join(docs.select(doc_key().alias("k"), "text"), F.col("id") == F.col("k")).select("id", "text")
    sets = wanted.mapInArrow(released(_sets), "id bigint, triples binary")
    members = placed.join(sets, "id").select("shard", "id", "code", "triples")
    edges = members.repartition("shard").sortWithinPartitions("shard", "id").mapInArrow(released(_edges), "a bigint, b bigint")
    comp = components(spark, edges.union(same.distinct()), scratch)
    named = scratch.save(comp.join(sig.select(F.col("k").alias("node"), "doc_id").distinct(), "node"))
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", F.col("node").alias("k"))).alias("first"), F.count("*").alias("copies"))
    out = scratch.save(named.join(first, "component").select(F.col("node").alias("k"), "first", "copies"))
    scratch.drop(sig, placed, named)
    return out


def groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, copies, keep) of every document."""
    docs = documents(docs, "doc_id", "text")
    of = kept(spark, docs).select(F.col("k").alias("_k"), "first", "copies")
    rows = docs.select("doc_id", doc_key().alias("k")).distinct().join(of, F.col("k") == F.col("_k"), "left")
    first = rows.select("k", "doc_id", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"), F.coalesce("first.k", "k").alias("_first"), F.when(F.col("first").isNull(), F.col("doc_id")).when(F.col("first.k").bitwiseAND(F.lit(1)) == 0, F.col("first.doc_id")).alias("group_id"))
    return first.select("doc_id", "group_id", "copies", (F.col("k") == F.col("_first")).alias("keep"))


def audit(docs: DataFrame, queries: int = 64, radius: int = RADIUS) -> DataFrame:
    """(doc_id, partner) within the radius by exact search of the whole table for the `queries` documents of least hash:
    what the recall of the graphs is measured against."""
    sig = signatures(docs)
    q = sig.select(F.col("doc_id").alias("query"), F.col("code").alias("query_code")).distinct().orderBy(F.xxhash64("query"), "query").limit(queries)
    hit = sig.join(F.broadcast(q), (F.bit_count(F.col("code").bitwiseXOR(F.col("query_code"))) <= radius) & (F.col("doc_id") != F.col("query")))
    return hit.select(F.col("query").alias("doc_id"), F.col("doc_id").alias("partner")).distinct()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, and of repeated rows one, that of least (lang, source, n_chars)."""
    small_batches(spark)
    docs = documents(docs, *DOC_COLUMNS)
    keyed = docs.withColumn("_k", doc_key())
    drop = kept(spark, docs).where("k <> first.k").select("k")
    again = Scratch(spark).save(keyed.groupBy("_k").count().where("count > 1").select("_k"))
    left = keyed.join(drop, F.col("_k") == F.col("k"), "left_anti")
    single = left.join(again, "_k", "left_anti").select(*DOC_COLUMNS)
    if again.isEmpty():
        return single
    several = left.join(again, "_k", "left_semi").groupBy("_k").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("_r"))
    return single.union(several.select(*(F.col(f"_r.{c}").alias(c) for c in DOC_COLUMNS)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, table(spark, sf_dir, "documents"))
