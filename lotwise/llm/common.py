"""What the operators of this subpackage share: tables in the shared folder, whole groups from sorted batches, edges
to connected components, and the columns that they read."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Buckets by which places are counted before their values are.
BUCKET_BITS = 16
#: Bytes of an Arrow batch. Spark's own limits (64 MB, 10,000 rows) let every task hold several tens of MB on either side of its pipe.
#: Two segments of positional_index fit.
BATCH_BYTES = 15 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a local session (tests) gets a
    temporary one; a cluster is refused, as its executors would not share such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES for the session's Python workers, from here on; a smaller limit stays. A row is never cut."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def released(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The kernel; what it freed goes back to the system when it ends, as its worker waits a minute for another task and others run beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            _give_back()

    return run


class Scratch:
    """Tables of one run, written as Parquet into the shared folder, so that a lost executor loses none of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)  # results may be read until the driver ends

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, doc_id as bigint. Ids of another kind than integers are refused, as they would not survive the cast."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"doc_id must be an integer column, not {kind.simpleString()}")
    return docs.select(*(F.col(c).cast("bigint").alias(c) if c == "doc_id" else F.col(c) for c in columns))


def doc_key() -> F.Column:
    """A document is a distinct (doc_id, text); rows that repeat both are one document. Without a doc_id, when the text alone
    counts, the last bit is set."""
    return F.xxhash64("doc_id", "text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("bigint"))


def ranked_id() -> F.Column:
    """The doc_id by which documents are ordered; those without one come last."""
    return F.coalesce("doc_id", F.lit((1 << 63) - 1))


def own_id(key: str = "k") -> F.Column:
    """The doc_id that ranked_id() stands for, by the last bit of the document's key."""
    return F.when(F.col(key).bitwiseAND(F.lit(1)) == 0, F.col("doc_id"))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(1 << BUCKET_BITS, np.int64)
    for b in batches:
        n += np.bincount(_bucket(b["h"].to_numpy()), minlength=len(n))
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])


def _in_buckets(buckets: np.ndarray):
    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = np.zeros(1 << BUCKET_BITS, bool)
        use[buckets] = True
        for b in batches:
            h = b["h"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(h[use[_bucket(h)]])], ["h"])

    return only


def heavy_hitters(docs: DataFrame, scan: Callable[[DataFrame], DataFrame], limit: int) -> np.ndarray:
    """Values of h in scan(docs(k, ...)) that stand more than `limit` times, all rows counted; they take the way for large groups. Rows are
    counted by buckets of values first, and by value only in buckets over `limit`, as no other bucket can hold such a value. There are at
    most as many as the corpus has places over `limit`."""
    found = scan(docs).select("h")
    full = found.mapInArrow(released(_by_bucket), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    buckets = np.array([r["bucket"] for r in full.select("bucket").toLocalIterator()], np.int64)
    if not len(buckets):
        return buckets
    seen = found.mapInArrow(released(_in_buckets(buckets)), "h bigint").groupBy("h").count().where(F.col("count") > limit)
    return np.array([r["h"] for r in seen.select("h").toLocalIterator()], np.int64)


def int64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def uint64(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64) if isinstance(col, pa.Array) else col.to_numpy().astype(np.int64, copy=False).view(np.uint64)


def _whole(held: list[pa.Table]) -> pa.Table:
    """One table of those, which are let go: who reads it holds no second copy."""
    t = pa.concat_tables(held).combine_chunks()
    held.clear()
    return t


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, least: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables in which every run of equal keys is complete, from batches in which equal keys stand together."""
    held: list[pa.Table] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        k = t[key].to_numpy()
        change = np.flatnonzero(k[1:] != k[:-1])
        if held and held[-1][key][-1].as_py() != k[0] and rows >= least:
            yield _whole(held)
            rows = 0
        if len(change) and rows + change[-1] + 1 >= least:
            cut = int(change[-1]) + 1
            held.append(t.slice(0, cut))
            yield _whole(held)
            held, rows = [t.slice(cut)], t.num_rows - cut
        else:
            held.append(t)
            rows += t.num_rows
    if held:
        yield _whole(held)


def runs(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of equal values."""
    if not len(k):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
    return a, np.concatenate([a[1:], [len(k)]])


def find(parent: np.ndarray | dict, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each partition reduced to (node, least node of its component there)."""
    parent: dict[int, int] = {}
    for b in batches:
        for a, c in zip(b["a"].to_pylist(), b["b"].to_pylist()):
            for x in (a, c):
                parent.setdefault(x, x)
            ra, rc = find(parent, a), find(parent, c)
            if ra != rc:
                parent[max(ra, rc)] = min(ra, rc)
    out = [(x, find(parent, x)) for x in parent]
    out = [(x, r) for x, r in out if x != r]
    if out:
        a = np.array(out, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of edges(a bigint, b bigint); component is the least node reachable.

    Each partition first shrinks its edges to a forest, then alternating star steps run until nothing changes: every
    node links its larger neighbours to the least node it knows. The rounds grow with the logarithm of the longest path.
    Null ends are dropped; without edges the result is empty."""
    e = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a is not null and b is not null and a <> b")
    cur = scratch.save(e.mapInArrow(released(_forest), "a bigint, b bigint").distinct())
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        large = scratch.save(large)
        down = large.where("a > b")
        m = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(m.select("a", F.col("m").alias("b"))).distinct()
        new = scratch.save(small)
        same = new.count() == cur.count() and new.exceptAll(cur).isEmpty()
        scratch.drop(large, cur)
        cur = new
        if same:
            break
    stars = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
