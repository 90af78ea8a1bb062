"""Operator 4, substring dedup: prefix-partitioned suffix trees over words.

A repeat is a run of at least MIN_WORDS words that stands at two places. Suffixes are taken where winnowing anchors a
PREFIX-word gram: of any MIN_WORDS words in a row at least one gram is an anchor, whatever stands around them, so every repeat
has an anchor in all its copies. Only suffixes at anchors that occur twice are kept, and of those only the ones that can
start a maximal repeat: the preceding anchor differs between copies (or the STEP-th on from such a one). A suffix goes on until
the next one that is taken is well under way, so the pieces of a long repeat overlap and are joined. Suffixes are the folded words
themselves, so what is compared is text. The anchor's gram is the prefix by which suffixes are split into groups; in each group the
suffixes are sorted and the tree is read off the common prefixes of neighbours: internal nodes of depth MIN_WORDS and more are the
maximal repeats, and the deepest one that holds an earlier copy (by doc_id, then place) says how far a suffix repeats it. Words
that stand left of the anchor are compared window by window.

A group of more than MAX_GROUP suffixes is never brought to one task. Its prefixes grow instead: every suffix has the hashes of its
prefixes of MIN_WORDS words and more, counts and first copies of prefixes are Spark aggregates, and a search over the prefix lengths
finds the same nodes in a few rounds. Anchors that are held that often are counted first, over all documents, and bypass the shuffle by anchor.

Defined results: repeats count over words as words.py defines them, so case and punctuation don't matter. A row with a null text is
no document here; one with a null doc_id is, and ranks after all others; rows that repeat doc_id and text are one. Texts below
MIN_WORDS words have no repeats. Copies that overlap each other inside periodic text are found from the next anchor on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import DOC_COLUMNS, Scratch, doc_key, documents, heavy_hitters, int64, own_id, ranked_id, released, runs, small_batches, table, whole_groups

MIN_WORDS = 50
PREFIX = 25
WINDOW = MIN_WORDS - PREFIX + 1
STEP = 16
#: Words that a suffix goes on past the next one taken.
OVERLAP = MIN_WORDS + PREFIX
MAX_GROUP = 20_000
BACK = MIN_WORDS - PREFIX
_STEPS = (81, 9, 1)


def _long_anchors(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the slice, hash, document) of the anchors of documents of MIN_WORDS words and more."""
    p, h = W.winnow(w, PREFIX, WINDOW)
    d = np.searchsorted(w.at, p, "right") - 1
    long = np.diff(w.at)[d] >= MIN_WORDS if len(d) else np.zeros(0, bool)
    return p[long], h[long], d[long]


def _anchors(only: np.ndarray | None = None, without: np.ndarray | None = None):
    """A scan for anchors: their hash, document, place and a hash of what stands before them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b["k"].to_numpy()
            for w in W.split(b["text"]):
                p, h, d = _long_anchors(w)
                if not len(p):
                    continue
                k = key[w.first + d]
                head = np.ones(len(p), bool)
                head[1:] = d[1:] != d[:-1]
                # all words from the anchor before on: two anchors may leave a word between their grams
                left = W.range_hash(W.prefix_hash(w.h), np.where(head, p, np.concatenate([p[:1], p[:-1]])), p)
                left[head] = W.mix(k[head].view(np.uint64))
                cols = [int64(h), k, (p - w.at[d]).astype(np.int32), int64(left)]
                if only is not None or without is not None:
                    use = np.isin(cols[0], only) if only is not None else ~np.isin(cols[0], without)
                    cols = [c[use] for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "k", "pos", "before"])

    return scan


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted anchors, those that stand at two places; diverse: what precedes them differs."""
    for t in whole_groups(batches, "h", 1 << 17):
        h, k, pos, left = t["h"].to_numpy(), t["k"].to_numpy(), t["pos"].to_numpy(), t["before"].to_numpy()
        place = W.mix(k.view(np.uint64) ^ W.mix(pos.astype(np.uint64)))
        a, e = runs(h)
        repeated = np.repeat(np.minimum.reduceat(place, a) != np.maximum.reduceat(place, a), e - a)
        diverse = np.repeat(np.minimum.reduceat(left, a) != np.maximum.reduceat(left, a), e - a)
        n = np.repeat(e - a, e - a)
        yield pa.RecordBatch.from_arrays([pa.array(x[repeated]) for x in (k, pos, diverse, n)], ["k", "pos", "diverse", "n"])


def folded_words(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """The folded words of a slice with a space behind each, and where each begins."""
    size = w.end - w.start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1], 32, np.uint8)
    i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at[:-1], size) + i] = w.folded[np.repeat(w.start, size) + i]
    return out, at


def _taken(b: pa.RecordBatch) -> Iterator[tuple]:
    """For each slice of texts with marks: the words and, of the suffixes that are taken, anchor, first word, document, where the
    document begins, where the suffix ends and how many places its anchor has."""
    first = b["marks"].offsets.to_numpy()
    inner = b["marks"].values
    m_pos, m_div, m_n = (inner.field(f).to_numpy(zero_copy_only=False) for f in ("pos", "diverse", "n"))
    for w in W.split(b["text"]):
        p, h, d = _long_anchors(w)
        if not len(p):
            continue
        a, e = first[w.first], first[w.first + w.docs]
        owner = np.repeat(np.arange(w.docs), np.diff(first[w.first : w.first + w.docs + 1]))
        at = np.searchsorted(p, m_pos[a:e] + w.at[owner])
        rep, div, n = np.zeros(len(p), bool), np.zeros(len(p), bool), np.zeros(len(p), np.int64)
        rep[at], div[at], n[at] = True, m_div[a:e], m_n[a:e]
        # near its end a repeat can hold an anchor that its copies lack: a window over the end chose it, so the end is near
        stop = np.where(rep, np.int64(1 << 60), p + MIN_WORDS - 1)
        stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], w.at[d + 1])
        i = np.arange(len(p))
        since = i - np.maximum.accumulate(np.where(div, i, -1))
        take = np.flatnonzero(rep & (since % STEP == 0))
        then = np.append(p[take[1:]], len(w.h)) + OVERLAP  # copies have the same next one, or end before it does
        yield w, h[take], p[take], d[take], w.at[d[take]], np.minimum(stop[take], then), n[take]


def _suffixes(max_group: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, ids = b["k"].to_numpy(), b["doc_id"].to_numpy()
            for w, h, p, d, begin, stop, n in _taken(b):
                cold = n <= max_group
                h, p, d, begin, stop = (x[cold] for x in (h, p, d, begin, stop))
                text, at = folded_words(w)
                raw = memoryview(text.tobytes())
                left = [raw[x:y] for x, y in zip(at[np.maximum(begin, p - BACK)].tolist(), at[p].tolist())]
                right = [raw[x:y] for x, y in zip(at[p].tolist(), at[stop].tolist())]
                head = at[np.minimum(stop, p + MIN_WORDS)] - at[p]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(int64(h)), pa.array(ids[w.first + d]), pa.array(key[w.first + d]), pa.array((p - begin).astype(np.int32)), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(head.astype(np.int32))],
                    ["g", "doc_id", "k", "pos", "before", "after", "head"],
                )

    return emit


def _hot_suffixes(max_group: int):
    """Of the suffixes in groups that are too large: the hashes of the windows of MIN_WORDS words that reach back over the anchor, by
    words back from it, and of the prefixes of MIN_WORDS words and more."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, ids = b["k"].to_numpy(), b["doc_id"].to_numpy()
            for w, g, p, d, begin, stop, n in _taken(b):
                hot = n > max_group
                g, p, d, begin, stop = (x[hot] for x in (g, p, d, begin, stop))
                prefix = W.prefix_hash(w.h)
                first = p[:, None] - np.arange(1, BACK + 1)[None, :]
                ok = (first >= begin[:, None]) & (first + MIN_WORDS <= stop[:, None])
                size = np.maximum(stop - p - MIN_WORDS + 1, 0)
                at = np.repeat(p, size)
                end = at + MIN_WORDS + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
                first[~ok] = 0
                # a window over two anchors is one of each
                window = int64((W.range_hash(prefix, first, np.minimum(first + MIN_WORDS, len(w.h))) ^ W.mix(g)[:, None]).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[w.first + d]),
                        pa.array(key[w.first + d]),
                        pa.array((p - begin).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array((np.arange(len(p) + 1) * BACK).astype(np.int32)), pa.array(window, mask=~ok.ravel())),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(int64(W.range_hash(prefix, at, end)))),
                    ],
                    ["doc_id", "k", "pos", "windows", "prefixes"],
                )

    return emit


def common_prefixes(s: list[bytes]) -> np.ndarray:
    """Words that each sorted suffix shares with the one before it; the first shares none."""
    out = np.zeros(len(s), np.int64)
    for i in range(1, len(s)):
        a, b = s[i - 1], s[i]
        m = min(len(a), len(b))
        if a[:m] != b[:m]:
            m = int(np.argmax(np.frombuffer(a, np.uint8, m) != np.frombuffer(b, np.uint8, m)))
        out[i] = a.count(b" ", 0, m)
    return out


def read_tree(lcp: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    """For each leaf of the suffix tree of sorted suffixes with these common prefixes: depth and leaves of its deepest
    internal node of depth `least` and more (0 without)."""
    n = len(lcp)
    depth, leaves = [0] * n, [0] * n
    free = list(range(n + 1))  # next leaf without a node

    def next_free(i: int) -> int:
        while free[i] != i:
            free[i] = free[free[i]]
            i = free[i]
        return i

    stack: list[tuple[int, int]] = [(0, 0)]
    for i, v in enumerate([*lcp[1:].tolist(), 0], 1):
        begin = i - 1
        while stack[-1][0] > v:
            d, begin = stack.pop()
            if d >= least:
                j = next_free(begin)
                while j < i:
                    depth[j], leaves[j] = d, i - begin
                    free[j] = j + 1
                    j = next_free(j)
        if stack[-1][0] < v:
            stack.append((v, begin))
    return depth, leaves


def _earlier_depths(lcp: np.ndarray, occ: list[int]) -> list[int]:
    """For each sorted suffix the longest common prefix with any suffix of smaller occurrence number."""
    n = len(lcp)
    best = [0] * n
    for forward in (True, False):
        stack: list[tuple[int, int]] = []  # (occurrence, common prefix with the entry below or with what it displaced)
        for i in range(n) if forward else range(n - 1, -1, -1):
            m = int(lcp[i]) if forward else (int(lcp[i + 1]) if i + 1 < n else 0)
            while stack and stack[-1][0] > occ[i]:
                m = min(m, stack.pop()[1])
            if stack:
                best[i] = max(best[i], m)
                stack.append((occ[i], m))
            else:
                stack.append((occ[i], 0))
    return best


def _windows(group: np.ndarray, occ: np.ndarray, left: list[bytes], right: list[bytes], head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(repeated, has an earlier copy, copies) by row and words back from the anchor, of windows of MIN_WORDS words; head is how
    many bytes of the suffix its first MIN_WORDS words take."""
    n, width = len(group), BACK + MIN_WORDS
    parts = [x for i in range(n) for x in (left[i], right[i][: head[i]])]
    raw = b"".join(parts)
    w = W.words_of(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]))
    count = np.diff(w.at)
    nl, nr = count[::2], count[1::2]
    size = nl + nr
    x = np.zeros((n, width), np.uint64)
    begin = np.repeat(BACK - nl, size) + np.arange(len(w.h)) - np.repeat(np.cumsum(size) - size, size)
    x[np.repeat(np.arange(n), size), begin] = w.h
    up, down = W._gram_powers(width + 1)
    h = np.zeros((n, width + 1), np.uint64)
    np.cumsum(x * up[:-1], axis=1, out=h[:, 1:], dtype=np.uint64)
    rep, old = np.zeros((n, BACK + 1), bool), np.zeros((n, BACK + 1), bool)
    copies = np.zeros((n, BACK + 1), np.int64)
    for back in range(BACK + 1):
        s = BACK - back
        ok = np.flatnonzero((nl >= back) & (nr >= MIN_WORDS - back))
        if len(ok) < 2:
            continue
        key = W.mix((h[ok, s + MIN_WORDS] - h[ok, s]) * down[s]) ^ group[ok]
        o = np.argsort(key, kind="stable")
        a, e = runs(key[o])
        many = np.repeat(e - a, e - a)
        row = ok[o]
        lead = np.repeat(np.minimum.reduceat(occ[row], a), e - a)
        rep[row, back] = many > 1
        old[row, back] = occ[row] > lead
        copies[row, back] = many
    return rep, old, copies


def _row_runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of set flags along each row."""
    pad = np.zeros((len(flag), flag.shape[1] + 2), np.int8)
    pad[:, 1:-1] = flag
    step = np.diff(pad, axis=1)
    r, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return r, a, b - 1


def _group_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, "g", 1 << 12):
        g, ids, k, pos, head = (t[c].to_numpy() for c in ("g", "doc_id", "k", "pos", "head"))
        order = np.lexsort((pos, k, ids))
        occ = np.empty(len(g), np.int64)
        occ[order] = np.arange(len(g))
        same = np.zeros(len(g), bool)  # a repeated row is no copy
        o1 = order[1:]
        same[o1] = (k[o1] == k[order[:-1]]) & (pos[o1] == pos[order[:-1]]) & (g[o1] == g[order[:-1]])
        a, e = runs(g)
        use = np.flatnonzero(~same & (np.repeat(e - a, e - a) > 1))
        g, ids, k, pos, head, occ = g[use], ids[use], k[use], pos[use].astype(np.int64), head[use].tolist(), occ[use]
        left, right = t["before"].take(use).to_pylist(), t["after"].take(use).to_pylist()
        a, e = runs(g)
        rows, start, end, copies, earlier = [], [], [], [], []
        rep, old, many = _windows(W.mix(g.view(np.uint64)), occ, left, right, head)
        most = np.append(many.ravel(), 0)
        for flag, is_old in ((rep, False), (old, True)):
            r, x, y = _row_runs(flag)
            c = np.maximum.reduceat(most, np.stack([r * (BACK + 1) + x, r * (BACK + 1) + y + 1], 1).ravel())[::2] if len(r) else r
            rows.append(r), start.append(pos[r] - y), end.append(pos[r] - x + MIN_WORDS), copies.append(c), earlier.append(np.full(len(r), is_old))
        found: list[tuple[int, int, int, bool]] = []
        for i, j in zip(a.tolist(), e.tolist()):
            if j - i < 2:
                continue
            by = sorted(range(i, j), key=right.__getitem__)
            lcp = common_prefixes([right[x] for x in by])
            if lcp.max() < MIN_WORDS:
                continue
            depth, leaves = read_tree(lcp, MIN_WORDS)
            before = _earlier_depths(lcp, occ[by].tolist())
            for x, d, n, q in zip(by, depth, leaves, before):
                if d:
                    found.append((x, d, n, False))
                if q >= MIN_WORDS:
                    found.append((x, q, n, True))
        if found:
            x, d, n, q = (np.array(v) for v in zip(*found))
            rows.append(x), start.append(pos[x]), end.append(pos[x] + d), copies.append(n), earlier.append(q)
        r = np.concatenate(rows)
        if len(r):
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[r]), pa.array(ids[r]), pa.array(np.concatenate(start).astype(np.int32)), pa.array(np.concatenate(end).astype(np.int32)), pa.array(np.concatenate(copies).astype(np.int64)), pa.array(np.concatenate(earlier).astype(bool))],
                ["k", "doc_id", "start", "end", "copies", "earlier"],
            )


def _hot_spans(scratch: Scratch, hot: DataFrame) -> DataFrame:
    """The spans of groups that no task could hold. Whether a prefix or window is repeated, or repeats an earlier one, is seen from an
    aggregate over its hash. Prefixes are counted at every _STEPS[0] words first; where fewer suffixes share the next one, so that the
    tree branches between, the lengths between are counted in smaller steps. All suffixes of a branching node do so, so counts are whole."""
    hot = scratch.save(hot.dropDuplicates(["k", "pos"]).withColumnRenamed("pos", "start"))
    place = F.struct("doc_id", "k", "start")

    def judged(keys: DataFrame) -> DataFrame:
        of = keys.groupBy("key").agg(F.count("*").alias("copies"), F.min(place).alias("_first"))
        return keys.join(of, "key").withColumn("later", F.col("_first") < place).drop("_first", "key")

    windows = hot.select("doc_id", "k", "start", F.posexplode("windows").alias("_back", "key")).where("key is not null")
    windows = judged(windows.select("doc_id", "k", (F.col("start") - F.col("_back") - 1).alias("start"), "key")).withColumn("end", F.col("start") + MIN_WORDS)

    def at_lengths(suffixes: DataFrame, lengths: F.Column) -> DataFrame:
        key = F.transform(lengths, lambda i: F.struct(i.alias("at"), F.element_at("prefixes", i + 1).alias("key")))
        return scratch.save(judged(suffixes.select("doc_id", "k", "start", F.size("prefixes").alias("size"), F.inline(key))))

    suffixes = hot.where("size(prefixes) > 0")
    known = at_lengths(suffixes, F.sequence(F.lit(0), F.size("prefixes") - 1, F.lit(_STEPS[0])))
    w = Window.partitionBy("k", "start").orderBy("at")
    for step in _STEPS[1:]:
        ends = known.withColumn("_next", F.coalesce(F.lead("at").over(w), F.col("size"))).withColumn("_left", F.coalesce(F.lead("copies").over(w), F.lit(0)))
        first = (F.floor(F.col("at") / step) + 1).cast("int") * step
        between = ends.where((F.col("copies") > 1) & (F.col("_left") != F.col("copies")) & (first < F.col("_next"))).select("k", "start", F.sequence(first, F.col("_next") - 1, F.lit(step)).alias("_at"))
        between = between.groupBy("k", "start").agg(F.flatten(F.collect_list("_at")).alias("_at"))
        known = known.union(at_lengths(suffixes.join(between, ["k", "start"]), F.col("_at")))
    longest = known.where("copies > 1").groupBy("k", "start").agg(F.first("doc_id").alias("doc_id"), F.max("at").alias("at"), F.max(F.when(F.col("later"), F.col("at"))).alias("at_later"), F.max("copies").alias("copies"))
    both = lambda later: F.explode(F.when(later, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("earlier")
    out = windows.where("copies > 1").select("k", "doc_id", "start", "end", "copies", both(F.col("later")))
    found = longest.select("k", "doc_id", "start", "at", "at_later", "copies", both(F.col("at_later").isNotNull()))
    return out.union(found.select("k", "doc_id", "start", F.col("start") + MIN_WORDS + F.when(F.col("earlier"), F.col("at_later")).otherwise(F.col("at")), "copies", "earlier"))


def spans(spark: SparkSession, docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(k, doc_id, start, end, copies, earlier): runs of words that repeat, joined where they touch; earlier ones are those
    parts of which a copy stands before."""
    docs = documents(docs, "doc_id", "text").where("text is not null").select(ranked_id().alias("doc_id"), "text", doc_key().alias("k"))
    texts, anchor = docs.select("k", "text"), "h bigint, k bigint, pos int, before bigint"
    often = heavy_hitters(texts, lambda d: d.mapInArrow(released(_anchors()), anchor), max_group)
    marks = texts.mapInArrow(released(_anchors(without=often) if len(often) else _anchors()), anchor).repartition("h").sortWithinPartitions("h").mapInArrow(released(_repeated), "k bigint, pos int, diverse boolean, n bigint")
    if len(often):
        held = texts.mapInArrow(released(_anchors(only=often)), anchor)
        facts = held.groupBy("h").agg(F.count("*").alias("n"), (F.min("before") != F.max("before")).alias("diverse"), (F.min(F.struct("k", "pos")) != F.max(F.struct("k", "pos"))).alias("_two"))
        marks = marks.union(held.select("h", "k", "pos").join(F.broadcast(facts.where("_two")), "h").select("k", "pos", "diverse", "n"))  # at most as many as heavy_hitters() returns
    marks = marks.groupBy("k").agg(F.collect_set(F.struct("pos", "diverse", "n")).alias("marks"))
    scratch = Scratch(spark)
    if len(often) or max_group < MAX_GROUP:
        marks = scratch.save(marks)
    marked = docs.join(marks, "k").select("k", "doc_id", "text", "marks")
    rows = marked.mapInArrow(released(_suffixes(max_group)), "g bigint, doc_id bigint, k bigint, pos int, before binary, after binary, head int")
    raw = rows.repartition("g").sortWithinPartitions("g").mapInArrow(released(_group_spans), "k bigint, doc_id bigint, start int, end int, copies bigint, earlier boolean")
    if len(often) or max_group < MAX_GROUP:
        hot = marked.where(F.exists("marks", lambda m: m["n"] > max_group))
        raw = raw.union(_hot_spans(scratch, hot.mapInArrow(released(_hot_suffixes(max_group)), "doc_id bigint, k bigint, pos int, windows array<bigint>, prefixes array<bigint>")))
    w = Window.partitionBy("k", "earlier").orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = raw.withColumn("_new", F.when(far >= F.col("start"), 0).otherwise(1)).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = part.groupBy("k", "earlier", "_part").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("copies").alias("copies"))
    return merged.select("k", own_id().alias("doc_id"), "start", "end", "copies", "earlier")


def report(spark: SparkSession, docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(doc_id, start_word, end_word, copies, removable): each maximal run of repeated words (removable false), and each
    run that repeats words standing earlier (removable true); copies is the most places that MIN_WORDS words of the run have."""
    s = spans(spark, docs, max_group)
    return s.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "copies", F.col("earlier").alias("removable"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = list(b["text"].to_pylist())
        drops = b["cuts"].to_pylist()
        todo = [i for i, x in enumerate(drops) if x]
        for i in todo:
            raw = text[i].encode()
            w = W.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            kept, at = [], 0
            for c in sorted(drops[i], key=lambda c: c["start"]):
                kept.append(raw[at : int(w.start[c["start"]])])
                at = int(w.start[c["end"]]) if c["end"] < len(w.start) else len(raw)
            text[i] = b"".join([*kept, raw[at:]]).decode().strip()
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(text, pa.string()), b["lang"], b["source"], b["n_chars"], pa.array([bool(x) for x in drops])], [*DOC_COLUMNS, "was_cut"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: runs of words that repeat earlier ones are cut out of the texts and n_chars follows; a document
    of which no word is left goes. Rows with a null text stay as they are."""
    small_batches(spark)
    docs = documents(docs, *DOC_COLUMNS)
    cuts = spans(spark, docs).where("earlier").groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    joined = docs.withColumn("_k", F.when(F.col("text").isNotNull(), doc_key())).join(cuts, F.col("_k") == F.col("k"), "left").select(*DOC_COLUMNS, "cuts")
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    done = joined.mapInArrow(released(_cut), ", ".join(f"{c} {fields[c]}" for c in DOC_COLUMNS) + ", was_cut boolean")
    left = done.where("not was_cut or text rlike '[0-9A-Za-z\\\\x{80}-\\\\x{10FFFF}]'")
    return left.withColumn("n_chars", F.when(F.col("was_cut"), F.length("text").cast(fields["n_chars"])).otherwise(F.col("n_chars"))).select(*DOC_COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, table(spark, sf_dir, "documents"))
