"""Operator 6, sharding: balanced label propagation.

Documents are linked by shared passages and as near copies: a gram links all documents that have it, and a link weighs as many grams
as two documents share. Grams are winnowed ones of GRAM words, of which any GRAM + WINDOW - 1 = 50 equal words share one, and a
document's smallest-hash word triples (one for each of six hashes, as in operator 10), which survive edits. Pairs are never listed: grams of the same documents become one hub, a hub counts its members in each shard, and
a document sums over its hubs, so that all partners vote at linear cost. Documents begin in hash shards. In each round half
of them (by a hash of document and round, so that two neighbours don't just swap places) look for the shard that holds most of their
neighbours' weight; Spark joins count the votes, and moves are admitted in order of gain (of equal ones by classes of their keys), within quotas: flows between two shards may
cancel out, and beyond that a shard takes what its capacity (SLACK above the mean) leaves.

Defined results: one row per document (doc_id, shard, size), size being its words; a document is a distinct (doc_id, text),
so repeated rows count once. Documents without words have size 0 and keep their hash shard, as do unlinked ones; a null doc_id is
kept as null. Sizes stay within (1 + SLACK) of the mean but for what hashing put above it at the start and a largest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, documents, heavy_hitters, int64, runs, table, whole_groups
from .simhash_dedup import ROUTES, SHINGLE, routes
from .simhash_dedup import _grams as triples

SHARDS = 16
ROUNDS = 8
SLACK = 0.03
#: Documents of a gram that come to one task at most, about.
MOST_HELD = 100_000
CLASS_BITS = 10
GRAM = 12
WINDOW = 39


def doc_key() -> F.Column:
    return F.xxhash64("doc_id", "text")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document a row with its size (gram null), its winnowed grams and its smallest-hash triples."""
    for b in batches:
        key = b["k"].to_numpy()
        for w in W.split(b["text"]):
            p, h = W.winnow(w, GRAM, WINDOW)
            d = np.searchsorted(w.at, p, "right") - 1
            n = np.diff(w.at)
            none = pa.nulls(w.docs, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key[w.first : w.first + w.docs]), none, pa.array(n)], ["k", "h", "size"])
            some = np.flatnonzero(n > 0)
            d = np.concatenate([d, np.repeat(some, ROUTES)])
            h = np.concatenate([h, routes(*triples(w, SHINGLE), w.docs)[some].ravel()])
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(key[w.first + d]), pa.array(int64(h)), pa.nulls(len(h), pa.int64())], ["k", "h", "size"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted grams the documents of each that several have, each once; who is the same for grams of the same documents, first is 1 once a gram."""
    for t in whole_groups(batches, "h", 1 << 16):
        h, k = t["h"].to_numpy(), t["k"].to_numpy()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
        h, k = h[new], k[new]
        a, e = runs(h)
        n = e - a
        who = W.mix(np.add.reduceat(W.mix(k.view(np.uint64)), a) ^ W.mix(n.astype(np.uint64)))
        several = np.repeat(n > 1, n)
        first = np.zeros(len(h), np.int64)
        first[a] = 1
        yield pa.RecordBatch.from_arrays([pa.array(h[several]), pa.array(k[several]), pa.array(int64(np.repeat(who, n)[several])), pa.array(first[several])], ["h", "k", "who", "first"])


def _shared_often(found: DataFrame) -> DataFrame:
    """The same of grams with too many documents for one task, by aggregates."""
    held = found.distinct()
    sums = held.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.xxhash64("k").cast("decimal(20,0)")).alias("s"), F.min("k").alias("least")).where("n > 1")
    return held.join(F.broadcast(sums), "h").select("h", "k", F.xxhash64("s", "n").alias("who"), (F.col("k") == F.col("least")).cast("bigint").alias("first"))


def hubs(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes(k, size), members(g, k, weight)): a hub g stands for the weight grams that exactly its documents k share."""
    keyed = documents(docs, "doc_id", "text").withColumn("k", doc_key())
    found = scratch.save(keyed.select("k", "text").mapInArrow(_scan, "k bigint, h bigint, size bigint"))
    nodes = found.where("h is null").groupBy("k").agg(F.max("size").alias("size"))
    grams = found.where("h is not null").select("h", "k")
    often = heavy_hitters(grams, lambda d: d, MOST_HELD)
    hot = F.broadcast(spark.createDataFrame([(h,) for h in often.tolist()], "h bigint"))  # bounded by the corpus over MOST_HELD
    cold = grams.join(hot, "h", "left_anti") if len(often) else grams
    shared = cold.repartition("h").sortWithinPartitions("h", "k").mapInArrow(_shared, "h bigint, k bigint, who bigint, first bigint")
    shared = scratch.save(shared.union(_shared_often(grams.join(hot, "h", "left_semi"))) if len(often) else shared)
    one = shared.where("first = 1").groupBy("who").agg(F.min("h").alias("g"), F.count("*").alias("weight"))
    members = shared.select("h", "k").hint("merge").join(one.select("g", "weight"), F.col("h") == F.col("g")).select("g", "k", "weight")
    out = scratch.save(nodes), scratch.save(members)
    scratch.drop(found, shared)
    return out


def graph(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes(k, size), links(a, b, weight) with a < b): every pair of each hub, so for small tables only."""
    nodes, members = hubs(spark, docs, scratch)
    pairs = members.toDF("g", "a", "weight").join(members.select("g", F.col("k").alias("b")), "g").where("a < b")
    return nodes, scratch.save(pairs.groupBy("a", "b").agg(F.sum("weight").alias("weight")))


def _members(links: DataFrame) -> DataFrame:
    """Links as hubs of two documents; members stay as they are."""
    return links if "g" in links.columns else links.select(F.xxhash64("a", "b").alias("g"), F.explode(F.array("a", "b")).alias("k"), "weight")


def _quotas(flow: np.ndarray, load: np.ndarray, room_of: float) -> np.ndarray:
    """The size that may move between every two shards: what cancels out, and a share of the room that the target has left."""
    even = np.minimum(flow, flow.T)
    more = flow - even
    into = more.sum(0)
    room = np.maximum(room_of - load, 0.0)
    return even + np.minimum(more, room * more / np.maximum(into, 1))


def propagate(nodes: DataFrame, links: DataFrame, scratch: Scratch, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """(k, size, shard); links are those of graph() or the members of hubs(). Of each round the driver sees a row for every two shards
    only, and what it decides goes back as arrays of that length. Joins are asked to be merged: a broadcast costs the driver MBs however small it is, and
    those of all rounds add up."""
    members = scratch.save(_members(links))
    state = scratch.save(nodes.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int")))
    total = state.agg(F.sum("size")).first()[0] or 0
    pair = F.col("shard") * shards + F.col("there")
    for r in range(rounds):
        placed = members.hint("merge").join(state, "k")
        held = placed.groupBy("g", "shard").agg(F.count("*").alias("n")).groupBy("g").agg(F.collect_list(F.struct(F.col("shard").alias("there"), "n")).alias("held"))
        active = placed.where(F.pmod(F.xxhash64("k", F.lit(r)), F.lit(2)) == 0)
        votes = active.hint("merge").join(held, "g").select("k", "size", "shard", "weight", "held").repartition("k").select("k", "size", "shard", "weight", F.inline("held"))
        own = (F.col("there") == F.col("shard")).cast("int")  # a document is no partner of its own
        votes = votes.groupBy("k", "size", "shard", "there").agg(F.sum(F.col("weight") * (F.col("n") - own)).alias("w"))
        best = votes.groupBy("k", "size", "shard").agg(F.max(F.struct("w", (-F.col("there")).alias("minus"))).alias("top"), F.sum(F.when(F.col("there") == F.col("shard"), F.col("w")).otherwise(0)).alias("stay"))
        moves = best.select("k", "size", "shard", (-F.col("top.minus")).alias("there"), (F.col("top.w") - F.col("stay")).alias("gain")).where("gain > 0 and there <> shard")
        moves = scratch.save(moves)
        flow = np.zeros((shards, shards))
        # loads are flows of a shard to itself here
        for x in moves.select("shard", "there", "size").union(state.select("shard", F.col("shard").alias("there"), "size")).groupBy("shard", "there").agg(F.sum("size").alias("flow")).collect():
            flow[x["shard"], x["there"]] = x["flow"]
        load = flow.diagonal().copy()
        np.fill_diagonal(flow, 0)
        quota = F.lit(_quotas(flow, load, float(total) / shards * (1 + slack)).ravel())
        # moves of one gain go in classes of their keys' leading bits, so that what is ordered is a short table of sums
        classed = moves.withColumn("class", F.shiftright("k", 64 - CLASS_BITS))
        rank = Window.partitionBy("shard", "there").orderBy(F.desc("gain"), "class").rowsBetween(Window.unboundedPreceding, 0)
        sums = classed.groupBy("shard", "there", "gain", "class").agg(F.sum("size").alias("_of")).withColumn("_sum", F.sum("_of").over(rank))
        # sums grow, so what a quota admits ends at one gain and class
        last = sums.where(F.col("_sum") <= F.get(quota, pair)).groupBy("shard", "there").agg(F.max(F.struct((-F.col("gain")).alias("minus"), "class")).alias("last"))
        minus, end = np.full(shards * shards, np.iinfo(np.int64).min), np.zeros(shards * shards, np.int64)
        for x in last.collect():
            minus[x["shard"] * shards + x["there"]], end[x["shard"] * shards + x["there"]] = x["last"]
        before = -F.col("gain") < F.get(F.lit(minus), pair)
        same = -F.col("gain") == F.get(F.lit(minus), pair)
        admitted = classed.where(before | same & (F.col("class") <= F.get(F.lit(end), pair))).select("k", F.col("there").alias("_to"))
        new = scratch.save(state.hint("merge").join(admitted, "k", "left").select("k", "size", F.coalesce("_to", "shard").alias("shard")))
        scratch.drop(moves, state)
        state = new
    return state


def cut(links: DataFrame, state: DataFrame) -> DataFrame:
    """One row: the weight of all links and of those between shards, counted by hub."""
    n = _members(links).join(state.select("k", "shard"), "k").groupBy("g", "shard").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))
    hub = n.groupBy("g").agg(F.max("weight").alias("weight"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    pairs = lambda x: F.sum(F.col("weight") * x / 2).cast("bigint")
    return hub.agg(pairs(F.col("all") * (F.col("all") - 1)).alias("weight"), pairs(F.col("all") * F.col("all") - F.col("inside")).alias("cut"))


def assign(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    scratch = Scratch(spark)
    nodes, members = hubs(spark, docs, scratch)
    state = propagate(nodes, members, scratch, shards, rounds, slack)
    ids = documents(docs, "doc_id", "text").select("doc_id", doc_key().alias("k")).distinct()
    return ids.hint("merge").join(state, "k").select("doc_id", "shard", "size")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark, table(spark, sf_dir, "documents"))
