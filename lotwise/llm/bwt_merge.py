"""Operator 5, suffix-array dedup: merged Burrows-Wheeler transforms of shards.

Texts become strings of anchors: winnowed GRAM-word grams, chosen by content alone, of which any MIN_WORDS words in a row hold at
least one. Anchors that stand once can't repeat and end the strings. Each shard of documents sorts its own suffixes once and
stores its transform: for every suffix the symbol before it (anchor hash and distance) and its LF target, the rank of the suffix one
anchor to the left. The shards are then merged without sorting suffixes again, by interleave refinement: the interleaving by d
symbols follows from the one by d - 1 symbols by a stable distribution of the entries by their preceding symbol, moved along
LF. A block border that first shows in round d has a common prefix of d - 1 symbols; suffixes alone in their block leave. Rounds
end when every block that is left shares at least MIN_WORDS words. Blocks that stop short and the ends of runs are decided by words: a window
of MIN_WORDS words belongs to the least of its grams, an anchor wherever the window stands, and an anchor over which any document has a window outside
its runs has its windows compared in all documents.

Defined results: (doc_id, start_word, end_word, copies), one row per joined run of words in repeats of at least
MIN_WORDS words: all words of windows of MIN_WORDS words that stand at two places, also where these overlap. Words are those of
words.py. Rows with a null text are no documents, a null doc_id is kept as null; repeated rows are one; shorter texts have no repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, doc_key, documents, heavy_hitters, int64, runs, table, whole_groups

MIN_WORDS = 50
GRAM = 32
WINDOW = MIN_WORDS - GRAM + 1
SHARD_SYMBOLS = 1 << 19
MOST_PLACES = 100_000


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of documents of MIN_WORDS words and more. Of those that winnowing thins out in periodic text the first of each row of them
    stays as a mark (its place below zero) that its hash stands twice."""
    for b in batches:
        key = b["k"].to_numpy()
        for w in W.split(b["text"]):
            p, h = W.winnow(w, GRAM, WINDOW, thin=False)
            d = np.searchsorted(w.at, p, "right") - 1
            use = np.diff(w.at)[d] >= MIN_WORDS if len(d) else np.zeros(0, bool)
            p, h, d = p[use], h[use], d[use]
            keep = W.thinned(p, h, d, WINDOW)
            mark = ~keep
            mark[1:] &= keep[:-1]
            pos = np.where(keep, p - w.at[d], w.at[d] - p - 1).astype(np.int32)
            use = keep | mark
            yield pa.RecordBatch.from_arrays([pa.array(int64(h[use])), pa.array(key[w.first + d[use]]), pa.array(pos[use])], ["h", "k", "pos"])


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted places of hashes, those of hashes that stand at two places; a repeated row counts once."""
    for t in whole_groups(batches, "h", 1 << 16):
        h, k, pos = (t[c].to_numpy() for c in ("h", "k", "pos"))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1]) | (pos[1:] != pos[:-1])
        h, k, pos = h[new], k[new], pos[new]
        a, e = runs(h)
        n = np.repeat(e - a, e - a)
        use = n > 1
        yield pa.RecordBatch.from_arrays([pa.array(h[use]), pa.array(k[use]), pa.array(pos[use]), pa.array(n[use])], ["h", "k", "pos", "n"])


def standing_twice(texts: DataFrame, scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], most: int = MOST_PLACES, scratch: Scratch | None = None) -> DataFrame:
    """(h, k, pos, n) of the hashes in a scan of texts(k, ...) that stand at two places. Hashes of more than `most` places don't come
    to one task; Spark aggregates count them. With `scratch` the scan is saved, else it is made for each pass."""
    places = "h bigint, k bigint, pos int"
    found = texts.mapInArrow(scan, places)
    found = scratch.save(found) if scratch else found
    often = heavy_hitters(found, lambda d: d, most)
    if not len(often):
        return found.repartition("h").sortWithinPartitions("h", "k", "pos").mapInArrow(_twice, places + ", n bigint")
    hot = F.broadcast(texts.sparkSession.createDataFrame([(h,) for h in often.tolist()], "h bigint"))  # bounded by the corpus over `most`
    rest = found.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h", "k", "pos").mapInArrow(_twice, places + ", n bigint")
    held = found.join(hot, "h", "left_semi").distinct()
    return rest.union(held.join(F.broadcast(held.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")), "h").select("h", "k", "pos", "n"))


def sort_suffixes(symbol: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of strings laid end to end, by prefix doubling; `last` marks the strings' last symbols,
    after which a suffix ends (before all that go on)."""
    n = len(symbol)
    rank = np.unique(symbol, return_inverse=True)[1].astype(np.int64)
    end = np.repeat(np.flatnonzero(last), np.diff(np.concatenate([[-1], np.flatnonzero(last)])))
    step, i = 1, np.arange(n)
    while True:
        after = np.where(i + step <= end, rank[np.minimum(i + step, n - 1)] + 1, 0)
        key = rank * (n + 2) + after
        new = np.unique(key, return_inverse=True)[1]
        if new.max(initial=0) == rank.max(initial=0) or step > n:
            break
        rank, step = new, step * 2
    out = np.empty(n, np.int64)
    out[np.argsort(new, kind="stable")] = i
    return out


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The transform of each shard: r is a suffix's rank in it, lf the rank of the suffix one symbol to the left."""
    for t in whole_groups(batches, "shard", 1):
        shard, k, pos, h = (t[c].to_numpy() for c in ("shard", "k", "pos", "h"))
        for a, e in zip(*(x.tolist() for x in runs(shard))):
            ks, ps, hs = k[a:e], pos[a:e].astype(np.int64), h[a:e]
            gap = np.zeros(e - a, np.int64)
            gap[:-1] = np.where((ks[1:] == ks[:-1]) & (ps[1:] - ps[:-1] <= WINDOW), ps[1:] - ps[:-1], 0)
            r = sort_suffixes(W.mix(hs.view(np.uint64)) ^ W.mix(gap.astype(np.uint64)), gap == 0)
            lf, ch, cgap = np.full(e - a, -1, np.int64), np.zeros(e - a, np.int64), np.zeros(e - a, np.int64)
            on = np.flatnonzero(gap[:-1] > 0)
            lf[on + 1], ch[on + 1], cgap[on + 1] = r[on], hs[on], gap[on]
            o = np.argsort(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[a:e][o].astype(np.int32)), pa.array(r[o].astype(np.int32)), pa.array(lf[o].astype(np.int32)), pa.array(hs[o]), pa.array(ch[o]), pa.array(cgap[o].astype(np.int32)), pa.array(ks[o]), pa.array(ps[o].astype(np.int32))],
                ["shard", "r", "lf", "h", "ch", "cgap", "k", "pos"],
            )


def _new_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the blocks of sorted entries in their order, and drops blocks of one suffix."""
    number = TaskContext.get().partitionId() << 40
    for t in whole_groups(batches, "ch", 1 << 14):
        ch, gap, block = (t[c].to_numpy() for c in ("ch", "cgap", "block"))
        new = np.ones(len(ch), bool)
        new[1:] = (ch[1:] != ch[:-1]) | (gap[1:] != gap[:-1]) | (block[1:] != block[:-1])
        a = np.flatnonzero(new)
        e = np.append(a[1:], len(ch))
        n = np.repeat(e - a, e - a)
        ids = number + np.cumsum(new)
        number = int(ids[-1])
        use = n > 1
        yield pa.RecordBatch.from_arrays([pa.array(t[c].to_numpy()[use]) for c in ("shard", "r", "core")] + [pa.array(ids[use]), pa.array(n[use])], ["shard", "r", "core", "block", "n"])


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the sorted anchors of documents, with the words that they share, the joined runs (h null) and the hashes of anchors over which a window
    lies outside them."""
    for t in whole_groups(batches, "k", 1 << 14):
        k, pos, h = t["k"].to_numpy(), t["pos"].to_numpy().astype(np.int64), t["h"].to_numpy()
        core, n = pc.fill_null(t["core"], 0).to_numpy(), pc.fill_null(t["n"], 0).to_numpy()
        # documents one after the other, further apart than anything reaches
        a, e = runs(k)
        base = np.zeros(len(a), np.int64)
        np.cumsum((np.maximum.reduceat(pos + core, a) + 2 * MIN_WORDS)[:-1], out=base[1:])
        base = np.repeat(base, e - a)
        on = np.flatnonzero(core > 0)
        start, end = (base + pos)[on], (base + pos + core)[on]
        far = np.maximum.accumulate(end)
        first = np.flatnonzero(np.concatenate([[True], start[1:] > far[:-1]])) if len(on) else on
        start, end = start[first], far[np.append(first[1:], len(on)) - 1] if len(on) else end
        if len(first):
            of = on[first]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(of), pa.int64()), pa.array(k[of]), pa.array((start - base[of]).astype(np.int32)), pa.array((end - base[of]).astype(np.int32)), pa.array(np.maximum.reduceat(n[on], first))], ["h", "k", "start", "end", "n"])
        left, right = base + np.maximum(pos - WINDOW + 1, 0), base + pos + MIN_WORDS
        run = np.searchsorted(start, left, "right") - 1
        inside = (run >= 0) & (right <= end[np.maximum(run, 0)]) if len(first) else np.zeros(len(k), bool)
        open_ = np.unique(h[~inside])
        none = pa.nulls(len(open_), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(open_), pa.nulls(len(open_), pa.int64()), none, none, pa.nulls(len(open_), pa.int64())], ["h", "k", "start", "end", "n"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows of MIN_WORDS words whose least gram is one of the given anchors, each window once."""
    for b in batches:
        key, first, anchors = b["k"].to_numpy(), b["anchors"].offsets.to_numpy(), b["anchors"].values.to_numpy().view(np.uint64)
        for w in W.split(b["text"]):
            if len(w.h) < MIN_WORDS:
                continue
            g, _ = W.gram_hash(w, GRAM)
            least = W._sliding(g, WINDOW, np.minimum)
            inside = np.arange(len(least)) + MIN_WORDS <= np.repeat(w.at[1:], np.diff(w.at))[: len(least)]
            s = np.flatnonzero(inside & np.isin(least, anchors[first[w.first] : first[w.first + w.docs]]))
            d = np.searchsorted(w.at, s, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(int64(W.range_hash(W.prefix_hash(w.h), s, s + MIN_WORDS))), pa.array(key[w.first + d]), pa.array((s - w.at[d]).astype(np.int32))], ["h", "k", "pos"])


def repeats(spark: SparkSession, docs: DataFrame, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """(doc_id, start_word, end_word, copies)."""
    scratch = Scratch(spark)
    docs = documents(docs, "doc_id", "text").where("text is not null").withColumn("k", doc_key())
    marked = scratch.save(standing_twice(docs.select("k", "text"), _anchors, MOST_PLACES))
    symbols = marked.where("pos >= 0")
    shards = max(1, -(-symbols.count() // shard_symbols))
    placed = symbols.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int"))
    bwt = scratch.save(placed.repartition("shard").sortWithinPartitions("shard", "k", "pos").mapInArrow(_transform, "shard int, r int, lf int, h bigint, ch bigint, cgap int, k bigint, pos int"))
    # the interleaving by one symbol: a block for each anchor
    moves = bwt.where("lf >= 0").select("shard", "r", "lf", "ch", "cgap")
    entries = moves.join(bwt.select("shard", "r", F.col("h").alias("block")), ["shard", "r"]).select("shard", F.col("lf").alias("r"), "ch", "cgap", "block", (F.lit(GRAM) + F.col("cgap")).alias("core"))
    rounds, long = [], []
    while True:
        state = scratch.save(entries.repartitionByRange("ch", "cgap", "block").sortWithinPartitions("ch", "cgap", "block").mapInArrow(_new_blocks, "shard int, r int, core int, block bigint, n bigint"))
        rounds.append(state)
        long.append(state.where(F.col("core") >= MIN_WORDS).select("shard", "r", "core", "n"))
        short = state.where(F.col("core") < MIN_WORDS).select("shard", "r")
        # one symbol more is needed only where the suffix to the left is still short, so only its right neighbours go on
        need = moves.join(short.withColumnRenamed("r", "lf"), ["shard", "lf"])
        entries = need.join(state.select("shard", "r", "core", "block"), ["shard", "r"]).select("shard", F.col("lf").alias("r"), "ch", "cgap", "block", (F.col("core") + F.col("cgap")).alias("core"))
        if short.isEmpty():
            break
        entries = scratch.save(entries)
        rounds.append(entries)
        if entries.isEmpty():
            break
    found = long[0]
    for x in long[1:]:
        found = found.union(x)
    found = scratch.save(found.groupBy("shard", "r").agg(F.min("core").alias("core"), F.max("n").alias("n")))
    scratch.drop(*rounds)
    at = bwt.select("shard", "r", "h", "k", "pos").join(found, ["shard", "r"], "left")
    runs_and_open = scratch.save(at.select("h", "k", "pos", F.col("core").cast("bigint").alias("core"), F.col("n").cast("bigint").alias("n")).repartition("k").sortWithinPartitions("k", "pos").mapInArrow(_covered, "h bigint, k bigint, start int, end int, n bigint"))
    scratch.drop(bwt, found)
    sure = runs_and_open.where("h is null").select("k", "start", "end", F.col("n").alias("copies"))
    open_h = runs_and_open.where("h is not null").select("h").union(marked.where("pos < 0").select("h")).distinct()
    anchors = marked.join(open_h, "h").groupBy("k").agg(F.collect_set("h").alias("anchors"))
    windows = standing_twice(docs.select("k", "text").join(anchors, "k").select("k", "text", "anchors"), _windows, MOST_PLACES, scratch)
    sure = sure.union(windows.select("k", F.col("pos").alias("start"), F.col("pos") + MIN_WORDS, "n"))
    w = Window.partitionBy("k").orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = sure.withColumn("_new", F.when(far >= F.col("start"), 0).otherwise(1)).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = part.groupBy("k", "_part").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.max("copies").alias("copies"))
    ids = docs.select("k", "doc_id").distinct()
    return merged.join(ids, "k").select("doc_id", "start_word", "end_word", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark, table(spark, sf_dir, "documents"))
