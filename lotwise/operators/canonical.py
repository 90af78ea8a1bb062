"""Entity collapse over overlapping sources and exact image dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import filled, has_value, truthy
from .quality import index_eligible
from .records import MARKET, UNIFIED

PRIORITY = {"pokemon_card_official_ja": 10, "tcgdex": 20, "tcgdex_image": 30}
METADATA = ["name", "name_ja", "rarity", "set_id", "card_code", "variant", "official_card_id", "illustrator", "number_total", "pokemon_no", "pokemon_species", "hp"]
IMAGE = ["image_url", "local_image_path", "image_sha256", "width", "height", "image_format", "is_valid_image"]
SUMMARY = ["source", "source_license", "card_id", "card_code", "set_id", "official_card_id", "image_url", "local_image_path", "image_sha256", "width", "height", "image_format", "is_valid_image", "rarity", "variant"]


def priority(source: Column | str, table: dict[str, int] = PRIORITY, unknown: int = 99) -> Column:
    c = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(unknown))


def canonical_key() -> Column:
    return (
        F.when(truthy("set_id") & truthy("card_code"), F.concat_ws("-", "set_id", "card_code"))
        .when(truthy("official_card_id"), F.concat(F.lit("official:"), F.col("official_card_id")))
        .otherwise(F.concat(F.coalesce("source", F.lit("unknown")), F.lit(":"), F.coalesce("card_id", F.lit("unknown"))))
    )


def _id() -> Column:
    return F.coalesce(filled("official_card_id"), filled("card_id"), F.lit(""))


def metadata_score(order: str, fields: list[str]) -> Column:
    """Least is best: source priority, most filled fields, both key parts, id, input order."""
    n = sum((has_value(F.col(f)).cast("int") for f in fields), F.lit(0))
    return F.struct(priority("source").alias("p"), (-n).alias("n"), (-(truthy("set_id") & truthy("card_code")).cast("int")).alias("k"), _id().alias("i"), F.col(order).alias("o"))


def image_score(order: str, least_width: int = 200, least_height: int = 280) -> Column:
    """Least is best: eligible, source priority, largest area, id, input order."""
    area = F.coalesce(F.col("width").cast("bigint"), F.lit(0)) * F.coalesce(F.col("height").cast("bigint"), F.lit(0))
    return F.struct((~index_eligible(least_width, least_height)).cast("int").alias("e"), priority("source").alias("p"), (-area).alias("a"), _id().alias("i"), F.col(order).alias("o"))


def collapse(rows: DataFrame, order: str = "ordinal", source: str = "canonical", license_: str = "mixed") -> DataFrame:
    """One row per canonical key: fields of the best metadata row, picture of the best picture row, and the other rows as
    duplicate_sources. One shuffle by the key; argmins are hash aggregates and the leftovers are filtered by row order."""
    have = set(rows.columns)
    need = sorted(set(UNIFIED + METADATA + IMAGE) - have)
    types = {"width": "int", "height": "int", "is_valid_image": "boolean", "is_sample": "boolean", "is_watermarked": "boolean"}
    df = rows.select("*", *[F.lit(None).cast(types.get(c, "string")).alias(c) for c in need]).withColumn("canonical_key", canonical_key())
    picture = truthy("local_image_path") & truthy("image_sha256")
    everything = F.struct(*dict.fromkeys([*UNIFIED, *METADATA, *IMAGE, order]))
    summary = F.struct(F.col(order).alias("_order"), F.struct(*SUMMARY, F.coalesce(filled("name_ja"), F.col("name")).alias("name_ja")).alias("row"))
    g = df.groupBy("canonical_key").agg(
        F.min_by(everything, metadata_score(order, METADATA)).alias("m"),
        F.min_by(F.when(picture, everything), F.when(picture, image_score(order))).alias("i"),
        F.collect_list(summary).alias("_all"),
        F.count("*").alias("source_record_count"),
    )
    matchable = truthy(F.col("m.set_id")) & truthy(F.col("m.card_code"))
    rest = F.filter(F.array_sort("_all"), lambda x: (x["_order"] != F.col(f"m.{order}")) & ~x["_order"].eqNullSafe(F.col(f"i.{order}")))
    fields = {c: F.col(f"m.{c}") for c in [*UNIFIED, *METADATA]} | {c: F.col(f"i.{c}") for c in IMAGE}
    fields["card_id"] = F.when(matchable, F.concat_ws("-", "m.set_id", "m.card_code")).otherwise(F.col("m.card_id"))
    fields["source"], fields["source_license"] = F.lit(source), F.lit(license_)
    out = g.select(
        F.concat(F.lit(f"{source}:"), F.col("canonical_key")).alias("canonical_id"),
        "canonical_key",
        F.col("m.source").alias("canonical_source"),
        F.col("m.card_id").alias("primary_card_id"),
        priority(F.col("m.source")).alias("canonical_priority"),
        F.col("i.source").alias("image_source"),
        matchable.alias("matchable_by_set_card"),
        "source_record_count",
        F.transform(rest, lambda x: x["row"]).alias("duplicate_sources"),
        *[v.alias(k) for k, v in fields.items()],
    )
    return out.withColumn("duplicate_source_count", F.size("duplicate_sources")).withColumn("has_index_image", index_eligible())


def price_fallback(canonical: DataFrame, price_map: DataFrame) -> DataFrame:
    """Price fields by the rewritten card id; where its status stays null, by the primary row's own id. The map has one row
    per card_id with the market_ columns."""
    m = F.struct(*MARKET)
    a = price_map.select(F.col("card_id").alias("_a"), m.alias("_ma"))
    b = price_map.select(F.col("card_id").alias("_b"), m.alias("_mb"))
    j = canonical.join(a, F.col("card_id") == F.col("_a"), "left").join(b, F.col("primary_card_id") == F.col("_b"), "left")
    use = F.when(F.col("_ma.market_match_status").isNotNull(), F.col("_ma")).otherwise(F.coalesce("_mb", "_ma"))
    return j.select(*[c for c in canonical.columns if c not in MARKET], *[F.coalesce(use[c], F.col(c)).alias(c) for c in MARKET])


def select_images(canonical: DataFrame) -> DataFrame:
    """Of the rows with one picture hash the best is selected and lists the others, which are marked as duplicates. Hashes are
    aggregated, not windowed, and only the selected row of a hash gets its list, so that a picture of many rows stays linear."""
    score = [(~(truthy("set_id") & truthy("card_code"))).cast("int"), (~truthy("set_id")).cast("int"), priority("canonical_source"), priority("image_source"), F.col("canonical_id")]
    use = F.col("has_index_image") & truthy("image_sha256")
    fields = ["canonical_id", "canonical_key", "canonical_source", "card_id", "card_code", "set_id", "name_ja", "image_source", "local_image_path", "image_sha256"]
    good = canonical.where(use).withColumn("_score", F.struct(*[c.alias(f"s{i}") for i, c in enumerate(score)]))
    best = good.groupBy(F.col("image_sha256").alias("_hash")).agg(F.min("_score").alias("_best"))
    good = good.join(best, F.col("image_sha256") == F.col("_hash")).withColumn("_first", F.col("_score") == F.col("_best"))
    losers = good.where("not _first").groupBy(F.col("image_sha256").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("_score", F.struct(*fields).alias("row")))).alias("_l")).select("_of", F.transform("_l", lambda x: x["row"]).alias("_others"))
    none = F.array().cast(losers.schema["_others"].dataType)
    first = F.col("_first")
    good = good.join(losers, first & (F.col("image_sha256") == F.col("_of")), "left").withColumn("_others", F.coalesce("_others", none))
    good = good.select(*canonical.columns, first.alias("index_image_selected"), F.when(~first, "duplicate_image_sha256").alias("excluded_from_index_reason"), F.size("_others").alias("duplicate_image_count"), F.col("_others").alias("duplicate_image_records"))
    rest = canonical.where(~F.coalesce(use, F.lit(False))).withColumn("index_image_selected", F.lit(False)).withColumn("excluded_from_index_reason", F.lit(None).cast("string")).withColumn("duplicate_image_count", F.lit(0)).withColumn("duplicate_image_records", none)
    return good.unionByName(rest)


def canonical_sort(df: DataFrame) -> DataFrame:
    return df.orderBy(*[F.coalesce(F.col(c), F.lit("")) for c in ("set_id", "card_code", "name", "canonical_id")])
