"""Operator 9, benchmark decontamination: a distributed positional inverted index.

One scan of all training texts stores, for every segment of documents, the postings (document, place) of each term as one row of a
table in the shared folder: of the terms that any test item has, or of all terms where the items have more than MAX_TERMS.
In every window of PHRASE words of an item the terms of least document frequency are anchors: so many that a document which lacks
as many words as a proximity match may lack still has one; a segment's posting lists of the anchors, moved back by their offsets, give
the places where the item can start, and the lists of its other terms are intersected there. An exact match is a run of at
least PHRASE words of the item (all of it if it is shorter); a proximity match has at least SHARE of the item's words within SLACK words
of their places, relative to an anchor at its own place.

Defined results: one row per document, item and place, of the longest run there; repeated rows give no further ones; null or empty texts
match nothing; a null doc_id or item_id is kept as null. Items of fewer than `least` words match nothing: a phrase of three words
is no leak but language, and reporting its places would report the corpus; callers who want them lower the parameter. Items go in batches
of at most MAX_WORDS words, so that what is broadcast stays bounded; all batches read the one index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import DOC_COLUMNS, Scratch, doc_key, documents, int64, own_id, ranked_id, released, runs, small_batches, table

PHRASE = 8
LEAST = 4
SHARE = 0.8
SLACK = 5
MAX_WORDS = 1_000_000
#: Distinct terms of all items beyond which the index takes every term, so that no vocabulary is broadcast.
MAX_TERMS = 4_000_000
SEGMENT_BYTES = 2 << 20
_POSTINGS = "docs binary, keys binary, terms binary, df binary, starts binary, doc binary, pos binary"


@dataclass
class Items:
    """Test items: item i has the terms term[at[i]:at[i + 1]], numbers of the sorted vocabulary."""

    ids: list
    at: np.ndarray
    term: np.ndarray
    vocabulary: np.ndarray


def read_items(rows: list[tuple], least: int = LEAST) -> Items:
    ids, parts = [], []
    for w in W.split(pa.array([t for _, t in rows], pa.large_string())):
        for d in range(w.docs):
            h = w.h[w.at[d] : w.at[d + 1]]
            if len(h) >= max(1, least):
                ids.append(rows[w.first + d][0])
                parts.append(h)
    all_h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    vocabulary, term = np.unique(all_h, return_inverse=True)
    return Items(ids, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), term.astype(np.int64), vocabulary)


def batches_of(benchmark: DataFrame, least: int = LEAST) -> Iterator[Items]:
    held, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").distinct().toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1]) // 2 + 1
        if size >= MAX_WORDS:
            yield read_items(held, least)
            held, size = [], 0
    if held:
        yield read_items(held, least)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w in W.split(b["text"]):
            yield pa.RecordBatch.from_arrays([pa.array(int64(np.unique(w.h)))], ["term"])


def vocabulary_of(benchmark: DataFrame, most: int) -> np.ndarray | None:
    """The sorted terms of all items; None where there are more than `most`."""
    terms = benchmark.select("text").where("text is not null").mapInArrow(released(_terms), "term bigint").distinct().limit(most + 1).toArrow()
    return None if terms.num_rows > most else np.sort(terms["term"].to_numpy().view(np.uint64))


def _index(vocabulary: np.ndarray | None):
    low = np.zeros(1 << 16, bool)
    if vocabulary is not None:
        low[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b["doc_id"].to_numpy(), b["k"].to_numpy()
            for w in W.split(b["text"], SEGMENT_BYTES):
                if vocabulary is None:
                    at, words = np.arange(len(w.h)), np.unique(w.h)
                    t = np.searchsorted(words, w.h)
                elif len(vocabulary):
                    words = vocabulary
                    may = np.flatnonzero(low[(w.h & np.uint64(0xFFFF)).astype(np.int64)])
                    t = np.minimum(np.searchsorted(vocabulary, w.h[may]), len(vocabulary) - 1)
                    hit = vocabulary[t] == w.h[may]
                    at, t = may[hit], t[hit]
                else:
                    continue
                if not len(at):
                    continue
                d = np.searchsorted(w.at, at, "right") - 1
                o = np.argsort(t.astype(np.uint16) if len(words) < 1 << 16 else t, kind="stable")
                t, d, pos = t[o], d[o], (at - w.at[d])[o]
                a, e = runs(t)
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
                df = np.add.reduceat(new.astype(np.int32), a)
                narrow = np.uint16 if max(w.docs, int(pos.max()) + 1) < 1 << 16 else np.uint32
                cols = [ids[w.first : w.first + w.docs], keys[w.first : w.first + w.docs], words[t[a]], df.astype(np.int32), np.append(a, len(t)).astype(np.int32), d.astype(narrow), pos.astype(narrow)]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], ["docs", "keys", "terms", "df", "starts", "doc", "pos"])

    return scan


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """A row for each segment of documents: their ranks and keys, and the postings of its terms (those of the vocabulary, or all),
    sorted by term, document, place."""
    rows = documents(docs, "doc_id", "text").where("text is not null").select(ranked_id().alias("doc_id"), doc_key().alias("k"), "text")
    return rows.mapInArrow(released(_index(vocabulary)), _POSTINGS)


def _of(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers in `terms` of those in the vocabulary, their numbers in the vocabulary)."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    own = np.flatnonzero(vocabulary[at] == terms)
    return own, at[own]


def _frequencies(vocabulary: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for t, f in zip(b["terms"], b["df"]):
                own, number = _of(vocabulary, np.frombuffer(t.as_buffer(), np.uint64))
                total[number] += np.frombuffer(f.as_buffer(), np.int32)[own]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "df"])

    return add


def anchors(items: Items, df: np.ndarray) -> list[tuple[int, int, int]]:
    """(item, offset, term): in each window of PHRASE words of an item the rarest terms, the first of equals. A proximity match
    lacks at most (1 - SHARE) of the words, so of the windows that lie side by side one lacks no more than their mean;
    one anchor more than that is there."""
    out = []
    for i in range(len(items.ids)):
        t = items.term[items.at[i] : items.at[i + 1]]
        n = min(PHRASE, len(t))
        lacking = int((1 - SHARE) * len(t) / max(1, len(t) // PHRASE) + 1e-9)
        seen = {int(a + o) for a in range(len(t) - n + 1) for o in np.argsort(df[t[a : a + n]], kind="stable")[: 1 + lacking]}
        out += [(i, o, int(t[o])) for o in sorted(seen)]
    return out


def probes(items: Items, df: np.ndarray) -> list[np.ndarray]:
    """For each item its rarest offsets, two more than a proximity match may lack: where all but one are missing, it is none."""
    out = []
    for i in range(len(items.ids)):
        t = items.term[items.at[i] : items.at[i + 1]]
        out.append(np.argsort(df[t], kind="stable")[: int((1 - SHARE) * len(t) + 1e-9) + 2])
    return out


def _best_runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the longest run of set flags in each row."""
    run = np.zeros(len(hit), np.int64)
    best, end = np.zeros(len(hit), np.int64), np.zeros(len(hit), np.int64)
    for j in range(hit.shape[1]):
        run = np.where(hit[:, j], run + 1, 0)
        better = run > best
        best[better], end[better] = run[better], j + 1
    return end - best, best


def match_segment(items: Items, anchor: list[tuple[int, int, int]], probe: list[np.ndarray], ids: np.ndarray, terms: np.ndarray, starts: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> list[tuple]:
    """(doc_id, item number, kind, place in the document, place in the item, words, share) of one segment."""
    n_docs, wide = len(ids), int(pos.max()) + 2 * SLACK + 2
    slot = np.full(len(items.vocabulary), -1, np.int64)
    slot[terms] = np.arange(len(terms))
    posting = (np.repeat(terms.astype(np.int64), np.diff(starts)) * n_docs + doc) * wide + pos + SLACK
    out: list[tuple] = []
    by_item: dict[int, list[np.ndarray]] = {}
    for i, o, t in anchor:
        s = slot[t]
        if s >= 0:
            a, e = starts[s], starts[s + 1]
            by_item.setdefault(i, []).append(doc[a:e] * (1 << 40) + (pos[a:e] - o + (1 << 30)))
    def look(d: np.ndarray, begin: np.ndarray, t: np.ndarray, offsets: np.ndarray, slack: int) -> np.ndarray:
        """Whether the item's words at these offsets stand within `slack` of their places, for items that begin at `begin`."""
        at = begin[:, None] + offsets[None, :]
        base = (t[offsets][None, :] * n_docs + d[:, None]) * wide + SLACK
        lo = base + np.clip(at - slack, -SLACK, wide - 2 * SLACK)
        hi = base + np.clip(at + slack, -SLACK, wide - SLACK - 1)
        j = np.searchsorted(posting, lo)
        return (posting[np.minimum(j, len(posting) - 1)] <= hi) & (j < len(posting)) & (hi >= lo)

    for i, lists in by_item.items():
        place = np.unique(np.concatenate(lists))
        t = items.term[items.at[i] : items.at[i + 1]]
        size, step = len(t), max(1, (1 << 21) // len(t))
        need, every = min(PHRASE, size), np.arange(size)
        for x in range(0, len(place), step):
            d, begin = place[x : x + step] >> 40, (place[x : x + step] & ((1 << 40) - 1)) - (1 << 30)
            # a run of `need` offsets has one of each remainder, and a proximity match lacks few of the rarest words
            run = look(d, begin, t, np.arange(0, size, need), 0).any(1)
            run[run] = look(d[run], begin[run], t, np.arange(need // 2, size, need), 0).any(1)
            lacks = (~look(d, begin, t, probe[i], SLACK)).sum(1)
            keep = run | (lacks <= (1 - SHARE) * size + 1e-9)
            d, begin = d[keep], begin[keep]
            if not len(d):
                continue
            hit = look(d, begin, t, every, 0)
            first, length = _best_runs(hit)
            for r in np.flatnonzero(length >= need).tolist():
                out.append((int(ids[d[r]]), i, "phrase", int(begin[r] + first[r]), int(first[r]), int(length[r]), float(hit[r].mean())))
            rest = np.flatnonzero(length < need)
            near = look(d[rest], begin[rest], t, every, SLACK)
            share = near.mean(1)
            for r in np.flatnonzero(share >= SHARE).tolist():
                q = rest[r]
                out.append((int(ids[d[q]]), i, "proximity", int(max(0, begin[q])), 0, int(near[r].sum()), float(share[r])))
    return out


def _match(items: Items, anchor: list[tuple[int, int, int]], probe: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, keys, terms, starts, doc, pos = (np.frombuffer(b[c][r].as_buffer(), kind) for c, kind in (("docs", np.int64), ("keys", np.int64), ("terms", np.uint64), ("starts", np.int32), ("doc", np.uint8), ("pos", np.uint8)))
                narrow = np.uint16 if len(doc) == 2 * starts[-1] else np.uint32
                own, number = _of(items.vocabulary, terms)
                if not len(own):
                    continue
                size = np.diff(starts)[own].astype(np.int64)
                use = np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                rows = match_segment(items, anchor, probe, np.arange(len(ids)), number, np.concatenate([[0], np.cumsum(size)]), doc.view(narrow)[use].astype(np.int64), pos.view(narrow)[use].astype(np.int64))
                if rows:
                    d, i, kind, p, q, n, s = zip(*rows)
                    d = np.array(d)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[d]), pa.array(keys[d]), pa.array([items.ids[x] for x in i], pa.int64()), pa.array(kind), pa.array(p, pa.int32()), pa.array(q, pa.int32()), pa.array(n, pa.int32()), pa.array(s, pa.float64())],
                        ["doc_id", "k", "item_id", "kind", "doc_word", "item_word", "n_words", "share"],
                    )

    return run


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """(k, doc_id, item_id, kind, doc_word, item_word, n_words, share); k is the document's key."""
    scratch = Scratch(spark)
    schema = "doc_id bigint, k bigint, item_id bigint, kind string, doc_word int, item_word int, n_words int, share double"
    index, out = None, spark.createDataFrame([], schema)
    for items in batches_of(benchmark, least):
        if not items.ids:
            continue
        if index is None:
            index = scratch.save(build_index(docs, vocabulary_of(benchmark, MAX_TERMS)))
        df = np.zeros(len(items.vocabulary), np.int64)
        for r in index.select("terms", "df").mapInArrow(released(_frequencies(items.vocabulary)), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
            df[r["term"]] = r["df"]
        out = out.union(index.select("docs", "keys", "terms", "starts", "doc", "pos").mapInArrow(released(_match(items, anchors(items, df), probes(items, df))), schema))
    return out.withColumn("doc_id", own_id()).select("k", "doc_id", "item_id", "kind", "doc_word", "item_word", "n_words", "share").distinct()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents (distinct doc_id and text) that no test item matches."""
    small_batches(spark)
    docs = documents(docs, *DOC_COLUMNS)
    bad = matches(spark, docs, table(spark, sf_dir, "benchmark")).select("k").distinct()
    return docs.withColumn("_k", doc_key()).join(bad, F.col("_k") == F.col("k"), "left_anti").select(*DOC_COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k").distinct()
