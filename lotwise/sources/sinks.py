"""Sinks: JSON lines with sorted keys, tables, CSV, SQL exports, vector tables and append-only manifests.

Parquet and JSON writes are atomic by Spark's commit protocol; row counts come from an observation of the same job."""

from __future__ import annotations

import json
import os
import re
import sqlite3

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> int:
    """One JSON object per line, keys sorted, nulls kept; gives the number of rows."""
    seen = Observation()
    sorted_df = df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    sorted_df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return seen.get["n"]


def json_line(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json(data: object, path: str) -> None:
    """A small summary, written beside and moved into place."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".part", "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2, sort_keys=True, default=str)
    os.replace(path + ".part", path)


def write_table(df: DataFrame, name: str, bucket: str = "card_id", buckets: int = 16) -> None:
    """A managed table, bucketed and sorted by its lookup column, so that later joins on it need no shuffle of this side."""
    df.write.mode("overwrite").bucketBy(buckets, bucket).sortBy(bucket).saveAsTable(name)


_SQL_TYPES = {"int": "INTEGER", "bigint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL"}


def write_sqlite(df: DataFrame, path: str, table: str = "cards", indexes: tuple[str, ...] = ("game", "source", "card_id", "card_code", "set_id")) -> int:
    """An export for single-machine tools: declared types, indexes, full rebuild, rows streamed partition by partition."""
    kinds = dict(df.dtypes)
    part = path + ".part"
    if os.path.exists(part):
        os.remove(part)
    db = sqlite3.connect(part)
    db.execute(f"CREATE TABLE {table} ({', '.join(f'{c} {_SQL_TYPES.get(k, "TEXT")}' for c, k in kinds.items())})")
    rows = df.select(*[F.col(c).cast("int").alias(c) if k == "boolean" else F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(c) for c, k in kinds.items()])
    n = db.executemany(f"INSERT INTO {table} VALUES ({','.join('?' * len(kinds))})", map(tuple, rows.toLocalIterator(prefetchPartitions=True))).rowcount if kinds else 0
    for c in indexes:
        if c in kinds:
            db.execute(f"CREATE INDEX idx_{table}_{c} ON {table} ({c})")
    db.commit()
    db.close()
    os.replace(part, path)
    return n


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    df.select(*fields).write.mode("overwrite").option("header", True).csv(path)


def write_vectors(df: DataFrame, path: str, parts: int = 16) -> None:
    """vectors(index_name, row_id, embedding, ...), one folder per index, so that a search reads only its indexes; up to `parts` tasks
    write an index."""
    df.repartition("index_name", F.pmod(F.xxhash64("row_id"), F.lit(parts))).write.mode("overwrite").partitionBy("index_name").parquet(path)


def append_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Writes only where there are rows; an older file of a run without rows goes."""
    spark = df.sparkSession
    if df.isEmpty():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return False
    df.write.mode("overwrite").json(path)
    return True


def rewrite_parts(df: DataFrame, path: str, key: str) -> None:
    """Replaces only the partitions of the keys that df holds: partial results of a long run."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def safe_report_name(product_id: str, stamp: str) -> str:
    return f"{re.sub(r'[^A-Za-z0-9_.-]', '_', product_id).strip('.') or 'report'}-{re.sub(r'[^0-9A-Za-z]', '', stamp)}.md"


def report_path(folder: str, name: str) -> str:
    """Path of a report, refused outside its folder."""
    full = os.path.realpath(os.path.join(folder, name))
    if os.path.commonpath([full, os.path.realpath(folder)]) != os.path.realpath(folder):
        raise ValueError(f"outside the report folder: {name}")
    return full
