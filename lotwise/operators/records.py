"""Catalog records: the unified schema, coercion, first- and last-wins dedup, price enrichment, repair, counts.

Order matters for first- and last-wins operators, so every one takes explicit order columns; nulls of a key compare
equal, as window partitions do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import col, filled, lenient_int, text_int, truthy

UNIFIED = ["game", "source", "source_license", "card_id", "card_code", "set_id", "language", "name", "name_en", "name_ja", "rarity", "variant", "image_url", "local_image_path", "image_sha256", "width", "height", "is_watermarked", "is_sample", "market_match_status", "market_product_id", "market_product_name", "market_url", "market_min_price", "market_min_price_format", "market_candidate_count", "market_matched_at", "created_at", "updated_at"]
INTS = ["width", "height", "market_candidate_count"]
FLAGS = ["is_watermarked", "is_sample"]
MARKET = [c for c in UNIFIED if c.startswith("market_")]
KEY_WITH_PATH = ["game", "source", "local_image_path"]
KEY_WITHOUT = ["game", "source", "language", "card_id", "card_code", "variant"]


def _type(name: str) -> str:
    return "int" if name in INTS else "boolean" if name in FLAGS else "double" if name == "market_min_price" else "string"


def coerce(df: DataFrame, extras: bool = False, **defaults: Column) -> DataFrame:
    """The unified columns: absent ones are null or their default, flags never null, whole numbers lenient. Other columns go
    unless extras are asked for."""
    kinds = {f.name: f.dataType for f in df.schema}
    out = []
    for c in UNIFIED:
        have = F.col(c) if c in kinds else defaults.get(c, F.lit(None))
        if c in defaults and c in kinds:
            have = F.coalesce(have, defaults[c])
        if c in FLAGS:
            kind = kinds.get(c)
            have = truthy(have, "string" if isinstance(kind, T.StringType) else "boolean" if isinstance(kind, T.BooleanType) else "number") if c in kinds else F.coalesce(have.cast("boolean"), F.lit(False))
        elif c in INTS:
            have = text_int(have) if isinstance(kinds.get(c), T.StringType) else lenient_int(have)
        else:
            have = have.cast(_type(c))
        out.append(have.alias(c))
    return df.select(*out, *[c for c in df.columns if extras and c not in UNIFIED])


def union_manifests(*dfs: DataFrame) -> DataFrame:
    """All rows under all columns, absent ones null, with input (0, 1, ...) telling where a row is from."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("input", F.lit(i)) for i, d in enumerate(dfs)])


def catalog_key() -> Column:
    """Identity of a catalog row: by image path where there is one, else by six fields."""
    return F.when(truthy("local_image_path"), F.array(F.lit("path"), *KEY_WITH_PATH)).otherwise(F.array(F.lit("card"), *KEY_WITHOUT))


def split_first(df: DataFrame, key: list[Column | str], order: list[Column | str]) -> tuple[DataFrame, DataFrame]:
    """(first row of each key, all later rows)."""
    w = Window.partitionBy(*[col(k) for k in key]).orderBy(*[col(o) for o in order])
    numbered = df.withColumn("_n", F.row_number().over(w))
    return numbered.where("_n = 1").drop("_n"), numbered.where("_n > 1").drop("_n")


def keep_first(df: DataFrame, key: list[Column | str], order: list[Column | str]) -> DataFrame:
    return split_first(df, key, order)[0]


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key with the number of rows it replaced, by one hash aggregation."""
    others = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_last"), (F.count("*") - 1).alias("replaced"))
    return last.select(key, "_last.*", "replaced")


def first_with_count(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key with the number of later rows that it stands for, by one hash aggregation."""
    others = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("_first"), (F.count("*") - 1).alias("skipped"))
    return first.select(*key, "_first.*", "skipped")


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    """One row: how many distinct values each column has, nulls left out."""
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])


def catalog_sort(df: DataFrame) -> DataFrame:
    return df.orderBy(*[F.coalesce(F.col(c), F.lit("")) for c in ("game", "source", "language", "set_id", "card_code", "card_id")])


def build_catalog(*manifests: DataFrame, order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(catalog, duplicates) of manifests with an ordinal column: coerced, first row of each key kept."""
    rows = union_manifests(*[coerce(m, extras=True) for m in manifests])
    kept, rest = split_first(rows.withColumn("_key", catalog_key()), ["_key"], ["input", order])
    return catalog_sort(kept.select(*UNIFIED)), rest.select("input", F.col("_key").alias("key"), F.struct(*UNIFIED).alias("record"))


def enrich_prices(catalog: DataFrame, price_map: DataFrame, order: str = "ordinal", game: str = "pokemon", language: str = "ja") -> DataFrame:
    """Left join of the last map row of each card; only rows of one game and language match, eight columns are replaced on a match."""
    names = {"match_status": "market_match_status", "product_id": "market_product_id", "product_name": "market_product_name", "url": "market_url", "min_price": "market_min_price", "min_price_format": "market_min_price_format", "candidate_count": "market_candidate_count", "matched_at": "market_matched_at"}
    last = keep_last(price_map.where(truthy("card_id")), "card_id", order)
    last = last.select(F.col("card_id").alias("_id"), F.struct(*[F.col(a).alias(b) for a, b in names.items()]).alias("_map"))
    on = (F.col("card_id") == F.col("_id")) & (F.col("game") == game) & (F.col("language") == language)
    joined = catalog.join(last, on, "left")
    return joined.select(*[F.when(F.col("_map").isNotNull(), F.col(f"_map.{c}")).otherwise(F.col(c)).alias(c) if c in MARKET else F.col(c) for c in catalog.columns])


def counts(df: DataFrame, *columns: str) -> DataFrame:
    """(column, value, n): independent counts of several columns in one pass."""
    sets = df.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"))
    width = len(columns)
    which = F.coalesce(*[F.when(F.col("_g") == (2**width - 1) - 2 ** (width - 1 - i), F.lit(c)) for i, c in enumerate(columns)])
    value = F.coalesce(*[F.when(F.col("_g") == (2**width - 1) - 2 ** (width - 1 - i), F.col(c).cast("string")) for i, c in enumerate(columns)])
    return sets.select(which.alias("column"), value.alias("value"), "n")


def missing_counts(df: DataFrame, first: str = "set_id", second: str = "card_code") -> DataFrame:
    a, b = ~truthy(F.col(first).cast("string")), ~truthy(F.col(second).cast("string"))
    return df.agg(F.count("*").alias("records"), F.count_if(a).alias(f"missing_{first}"), F.count_if(b).alias(f"missing_{second}"), F.count_if(a | b).alias("missing_either"))


def for_repair(df: DataFrame, source: str, missing_code: bool = False) -> DataFrame:
    """Rows of the source with an official id whose set (or, if asked for, code) is missing."""
    gone = ~truthy("set_id")
    return df.where((F.col("source") == source) & truthy("official_card_id") & ((gone | ~truthy("card_code")) if missing_code else gone))


def repair_rows(df: DataFrame) -> DataFrame:
    name = F.coalesce(filled("name_ja"), F.col("name"))
    return df.select(F.col("official_card_id").alias("id"), F.col("image_url").alias("thumb"), name.alias("view_name"), name.alias("alt_name"))


def repair(df: DataFrame, repaired: DataFrame, key: str = "official_card_id") -> DataFrame:
    """Whole rows whose key was fetched anew are replaced, all others stay."""
    new = repaired.select(F.col(key).alias("_k"), F.struct(*df.columns).alias("_new"))
    joined = df.join(new, F.col(key) == F.col("_k"), "left").select(F.coalesce("_new", F.struct(*df.columns)).alias("_r"))
    return joined.select("_r.*")


def attach_details(rows: DataFrame, details: DataFrame, key: str, order: str) -> DataFrame:
    """Details beside their rows in the rows' order; rows without details have nulls and error "missing_detail"."""
    d = details.withColumn("_have", F.lit(True))
    return rows.join(d, key, "left").withColumn("error", F.when(F.col("_have").isNull(), "missing_detail")).drop("_have").orderBy(order)


def mode_first_seen(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, n): the most frequent value, of equals the one seen first."""
    n = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = n.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", (-F.col("_first")).alias("f"))).alias("_b"))
    return best.select(key, f"_b.{value}", "_b.n")


def parity(rows: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, parsed, expected, count_matches): rows per key against what a page announced."""
    n = rows.groupBy(key).agg(F.count("*").alias("parsed"))
    j = expected.select(key, "expected").join(n, key, "left").withColumn("parsed", F.coalesce("parsed", F.lit(0)))
    return j.select(key, "parsed", "expected", F.col("expected").eqNullSafe(F.col("parsed")).alias("count_matches"))


def diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): reuse where the digest is the same, replace where it changed, add, remove."""
    o = old.select(F.col(key).alias("_ok"), F.col(digest).alias("_od"))
    n = new.select(F.col(key).alias("_nk"), F.col(digest).alias("_nd"))
    j = o.join(n, F.col("_ok") == F.col("_nk"), "full")
    return j.select(F.coalesce("_ok", "_nk").alias(key), F.when(F.col("_ok").isNull(), "add").when(F.col("_nk").isNull(), "remove").when(F.col("_od").eqNullSafe(F.col("_nd")), "reuse").otherwise("replace").alias("action"))


def rewrite_paths(path: Column | str, rules: list[tuple[str, str]]) -> Column:
    """The first rule whose prefix the path has replaces it."""
    p = col(path)
    out = None
    for a, b in rules:
        made = F.concat(F.lit(b), F.substring(p, len(a) + 1, 1 << 20))
        out = F.when(p.startswith(a), made) if out is None else out.when(p.startswith(a), made)
    return p if out is None else out.otherwise(p)


def mounted_url(path: Column | str, roots: list[tuple[str, str]]) -> Column:
    """URL below the mount whose root holds the path, null outside all."""
    p = col(path)
    return F.coalesce(F.lit(None).cast("string"), *[F.when(p.startswith(r.rstrip("/") + "/"), F.concat(F.lit(u.rstrip("/")), F.substring(p, len(r.rstrip("/")) + 1, 1 << 20))) for r, u in roots])
