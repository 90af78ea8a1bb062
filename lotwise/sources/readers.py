"""Readers: JSON lines, JSON, CSV, Parquet, pictures, HTML files, vector tables and small configuration tables.

Nothing is inferred on a production path: a schema is always given. Where first or last wins later, `ordinal` gives the place
of a row in its input, by file order and line."""

from __future__ import annotations

import csv
import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import filled, first_filled

PICTURES = (".jpg", ".jpeg", ".png", ".webp")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist, in order, on whatever file system they are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(p: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(conf).exists(path)

    return [p for p in paths if there(p)]


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str, ordinal: bool = True, strict: bool = True) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a bad line fails the read (strict) or is left out. ordinal is (file, line
    offset) in one number per file, so its order is that of the lines."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = raw.where(F.trim("value") != "")
    parsed = F.from_json("value", T.StructType([*kind.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.withColumn("_r", parsed)
    bad = F.col("_r._bad").isNotNull() | F.col("_r").isNull()
    if strict:
        message = F.concat(F.lit("malformed JSON line in "), "_file", F.lit(": "), F.substring("value", 1, 200))
        rows = rows.withColumn("_r", F.when(bad, F.raise_error(message).cast(rows.schema["_r"].dataType)).otherwise(F.col("_r")))
    else:
        rows = rows.where(~bad)
    # partitions of a scan are file blocks in reading order, so block and running number order the lines of a file
    place = [F.struct("_file", "_block", "_line").alias("ordinal")] if ordinal else []
    return rows.select(*[F.col(f"_r.{f.name}").alias(f.name) for f in kind.fields], *place)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def sniff(sample: str) -> str:
    """Delimiter of a CSV sample, a comma where it can't be told."""
    try:
        return csv.Sniffer().sniff(sample, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """CSV with header, all columns as text, names trimmed and in lower case; a byte order mark is dropped and the delimiter found
    in the first 4096 signs."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(20).collect())[:4096]
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("delimiter", delimiter or sniff(head)).csv(path)
    return df.toDF(*[c.replace("﻿", "").strip().lower() for c in df.columns])


def single_csv(folder: str) -> str:
    """The one CSV file below a folder; none or several are an error."""
    found = sorted(glob.glob(os.path.join(folder, "**", "*.csv"), recursive=True))
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'several'} CSV files under {folder}: {found}")
    return found[0]


def read_pictures(spark: SparkSession, root: str, recursive: bool = True, content: bool = True) -> DataFrame:
    """(path, modified, length[, content]) of picture files; without content, no file is opened."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    df = df.where(F.lower("path").rlike(r"\.(jpe?g|png|webp)$"))
    return df.select("path", F.col("modificationTime").alias("modified"), "length", *(["content"] if content else []))


def picture_paths(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Distinct sorted paths of files and of a manifest's local_image_path."""
    out = files.select("path")
    if manifest is not None:
        out = out.union(manifest.where("local_image_path <> ''").select("local_image_path"))
    return out.distinct().orderBy("path")


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of saved pages, one file a row."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def read_vectors(spark: SparkSession, path: str, index: list[str] | None = None) -> DataFrame:
    """vectors(index_name, row_id, embedding, manifest...), pruned to the wanted indexes; one that is missing is an error."""
    df = spark.read.parquet(path)
    if index is None:
        return df
    have = {r[0] for r in df.select("index_name").distinct().collect()}
    missing = [i for i in index if i not in have]
    if missing:
        raise ValueError(f"no such index: {missing}")
    return df.where(F.col("index_name").isin(index))


def read_flags(df: DataFrame, order: str = "ordinal") -> DataFrame:
    """Mapping flags, the last row of each product."""
    from ..operators.records import keep_last

    return keep_last(df.where("product_id <> ''"), "product_id", order).drop("replaced")


CERT_KEYS = ["cert", "psa_cert", "certificate", "certificate_number", "barcode", "barcode_text"]


def read_certs(df: DataFrame) -> DataFrame:
    """Rows keyed by the first filled certificate column, in compared form; rows without one go."""
    from ..functions.text import cert_key

    have = [c for c in CERT_KEYS if c in df.columns]
    return df.withColumn("cert_key", cert_key(first_filled(*have))).where("cert_key is not null")


def with_source(df: DataFrame) -> DataFrame:
    """Adds source_name = catalog:<file stem>."""
    from ..functions.values import stem_of

    return df.withColumn("source_name", F.concat(F.lit("catalog:"), stem_of(F.col("_metadata.file_path"))))


def read_search_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached result pages that are usable; data stays the payload's JSON text."""
    from ..operators.matching import valid_pages

    return valid_pages(spark.read.schema("keyword string, page int, per_page int, url string, status_code int, fetched_at string, data string").option("multiLine", True).json(path))


def cache_name(keyword: Column, page: Column, per_page: Column) -> Column:
    return F.concat(F.sha2(F.concat_ws("|", keyword, page.cast("string"), per_page.cast("string")), 256), F.lit(".json"))


def named_paths(text: str | None) -> dict[str, str]:
    """a=/p,b=/q as a mapping; parts without a name or path are skipped."""
    out = {}
    for part in (text or "").split(","):
        name, _, path = part.partition("=")
        if name.strip() and path.strip():
            out[name.strip()] = path.strip()
    return out


def split_bad(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable rows, dead letters with their error)."""
    return images.where("is_valid_image"), images.where("not coalesce(is_valid_image, false)").select("path", "image_error")


def trades_of(payloads: DataFrame) -> DataFrame:
    """Trades of landed history payloads (product_id, histories, data, error): the first array that is given, in feed order."""
    rows = payloads.where(F.col("error").isNull()).select("product_id", F.posexplode(F.coalesce("histories", "data")).alias("ordinal", "_t"))
    t = lambda c: F.col(f"_t.{c}")
    return rows.select("product_id", "ordinal", t("condition").alias("condition"), t("price").alias("price"), first_filled(t("priceFormat"), t("price_format"), t("formattedPrice"), t("formatted_price")).alias("price_format"), F.coalesce(filled(t("currency")), t("priceCurrency")).alias("currency"), t("tradedAt").alias("traded_at"))
