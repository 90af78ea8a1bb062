"""Operator 1, best-fit packing: the sum-of-squares rule.

A bin holds CAPACITY words. A document longer than that is cut into full pieces, each a bin of its own, and a rest. Each
rest goes, in hash order, where the sum of the squared counts of open bins per residual gap becomes smallest: into an open bin of some
gap, or into a new bin; of equal choices into the smallest gap. The rule looks at all open bins of its group; groups
hold about GROUP_WORDS words each, so what is open at a group's end is a vanishing share of the bins.

Groups are hash classes of documents, so that packing has as many tasks as the corpus has groups; within a
group the rule sees every open bin. On the given documents a group of GROUP_WORDS words leaves 0.2 % of its bins' room free at most.

Defined results: one row per piece (doc_id, piece, first_word, n_words, bin_id, bin_start); a document without words (null
or empty text included) has one row with n_words 0 and no bin; a null doc_id is packed like any other; repeated rows are
packed each. The pipeline's stage adds the text of each piece: from its first word to the next piece's, all of the
document's bytes, so that the texts of a document's pieces in a row are its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, documents, released, runs, small_batches, table, whole_groups

CAPACITY = 2048
GROUP_WORDS = 1 << 24


def count_words(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Words of each text, without hashing them."""
    out = np.zeros(len(off) - 1, np.int64)
    for a, b in W.slices(off):
        inside = W._IS_WORD[raw[off[a] : off[b]]]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = off[a:b] - off[a]
        head = at[at < len(inside)]
        first[head] = inside[head]
        c = np.concatenate([[0], np.cumsum(first)])
        out[a:b] = c[off[a + 1 : b + 1] - off[a]] - c[at]
    return out


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, off = W.text_buffers(b["text"])
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["o"], pa.array(count_words(raw, off))], ["doc_id", "o", "n"])


def pack(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, start in the bin) of each item by the sum-of-squares rule; sizes are 1 to capacity."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; 0 and capacity stay 0
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, start, n = [], [], 0
    for s in sizes:
        gaps = np.flatnonzero(count[s:]) + s
        fresh = 0 if s == capacity else 2 * int(count[capacity - s]) + 1
        best, gap = fresh, capacity
        if len(gaps):
            d = 2 - 2 * count[gaps] + 2 * count[gaps - s]
            if gaps[0] == s:
                d[0] = 1 - 2 * count[s]
            k = int(np.argmin(d))
            if d[k] <= fresh:
                best, gap = int(d[k]), int(gaps[k])
        if gap < capacity:
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            b, n = n, n + 1
        where.append(b)
        start.append(capacity - gap)
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return where, start


def _pack_groups(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "g"):
            g, n, o = t["g"].to_numpy(), t["n"].to_numpy(), t["o"].to_numpy()
            for a, e in zip(*(x.tolist() for x in runs(g))):
                own = n[a:e]
                full, rest = own // capacity, own % capacity
                has = rest > 0
                piece_of = np.repeat(np.arange(e - a), np.maximum(1, full + has))
                piece = np.arange(len(piece_of)) - np.repeat(np.cumsum(np.maximum(1, full + has)) - np.maximum(1, full + has), np.maximum(1, full + has))
                size = np.where(piece < full[piece_of], capacity, rest[piece_of])
                bins, start = np.full(len(size), -1, np.int64), np.zeros(len(size), np.int64)
                part = (size > 0) & (size < capacity)
                where, begin = pack(size[part].tolist(), capacity)
                bins[part], start[part] = where, begin
                whole = size == capacity
                bins[whole] = (max(where) + 1 if where else 0) + np.arange(whole.sum())
                none = pa.array(size == 0)
                ids = t["doc_id"].combine_chunks().slice(a, e - a).take(pa.array(piece_of))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids if isinstance(ids, pa.Array) else ids.combine_chunks(),
                        pa.array(o[a:e][piece_of]),
                        pa.array(piece.astype(np.int32)),
                        pa.array(piece * capacity),
                        pa.array(size),
                        pa.array(np.int64(g[a]) * (1 << 36) + bins, mask=size == 0),
                        pa.array(start.astype(np.int32), mask=size == 0),
                    ],
                    ["doc_id", "o", "piece", "first_word", "n_words", "bin_id", "bin_start"],
                )

    return run


def _groups(spark: SparkSession, docs: DataFrame, capacity: int, group_words: int) -> DataFrame:
    """The packing of docs(doc_id, text, o), in the order of a hash of o; the column o stays."""
    scratch = Scratch(spark)
    sizes = scratch.save(docs.mapInArrow(released(_lengths), "doc_id bigint, o bigint, n bigint"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    n_groups = max(1, -(-total // group_words))
    rows = sizes.withColumn("h", F.xxhash64("o")).withColumn("g", F.pmod("h", F.lit(n_groups)))
    return rows.repartition("g").sortWithinPartitions("g", "h", "o", "doc_id", "n").mapInArrow(released(_pack_groups(capacity)), "doc_id bigint, o bigint, piece int, first_word bigint, n_words bigint, bin_id bigint, bin_start int")


def packed(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, group_words: int = GROUP_WORDS) -> DataFrame:
    return _groups(spark, documents(docs, "doc_id", "text").withColumn("o", F.xxhash64("text", "doc_id")), capacity, group_words).drop("o")


def _piece_texts(fields: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = b["pieces"].values.field("first_word").to_numpy()
            at = b["pieces"].offsets.to_numpy()
            for w in W.split(b["text"]):
                held, texts = np.arange(at[w.first], at[w.first + w.docs]), []
                doc = np.repeat(np.arange(w.docs), np.diff(at[w.first : w.first + w.docs + 1]))
                for j, d in zip(held.tolist(), doc.tolist()):
                    own, end = first[at[w.first + d] : at[w.first + d + 1]], w.byte_at[d + 1]
                    later = own[own > first[j]]
                    stop = w.start[w.at[d] + later.min()] if len(later) else end
                    begin = w.start[w.at[d] + first[j]] if first[j] else w.byte_at[d]
                    texts.append(w.raw[begin:stop].tobytes())
                rows = pa.array(w.first + doc)
                inner = b["pieces"].values
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(rows), *(inner.field(f).take(pa.array(held)) for f in fields), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", *fields, "text"])

    return cut


def packed_texts(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, group_words: int = GROUP_WORDS) -> DataFrame:
    """packed() and each piece's text. The texts are shuffled once, to the pieces' rows; of equal rows each gets pieces of its own."""
    # written, so that a recomputed task can't number its rows anew
    numbered = Scratch(spark).save(documents(docs, "doc_id", "text").withColumn("o", F.monotonically_increasing_id()))
    fields = ["piece", "first_word", "n_words", "bin_id", "bin_start"]
    pieces = _groups(spark, numbered, capacity, group_words).groupBy("o").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("pieces"))
    joined = numbered.withColumnRenamed("o", "_o").join(pieces, F.col("_o") == F.col("o")).select("doc_id", "text", "pieces")
    return joined.mapInArrow(released(_piece_texts(fields)), "doc_id bigint, piece int, first_word bigint, n_words bigint, bin_id bigint, bin_start int, text string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packing of the documents and the text of each piece, so that bins can be read from its rows alone."""
    small_batches(spark)
    return packed_texts(spark, docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, table(spark, sf_dir, "documents"))
