"""Source adapters: rows of each source as unified catalog records, source fields kept beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import filled, first_filled
from ..operators.records import UNIFIED, coerce

LICENSES = {"tcgdex": "MIT (API), images third party", "onepiece_kaggle": "see dataset", "optcg_hf_cards": "see dataset", "pokemon_kaggle_images": "see dataset", "pokemon_card_official_ja": "official site, internal use", "onepiece_official_ja_catalog": "official site, internal use"}


def _unified(df: DataFrame, now: Column, fields: dict[str, Column], extra: list[Column] | None = None) -> DataFrame:
    out = df.select(*[fields[c].alias(c) for c in UNIFIED if c in fields], *(extra or []))
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return coerce(out, extras=True, created_at=stamp, updated_at=stamp)


def _base(game: str, source: str, language: Column) -> dict[str, Column]:
    return {"game": F.lit(game), "source": F.lit(source), "source_license": F.lit(LICENSES.get(source)), "language": language}


def api_cards(df: DataFrame, language: str, now: Column, level: str = "full") -> DataFrame:
    """Cards of the card API (id, localId, name, rarity, image, updated, set.id, variants)."""
    en, ja = X.split_name(F.lit(language), "name")
    return _unified(df, now, _base("pokemon", "tcgdex", F.lit(language)) | {"card_id": F.col("id"), "card_code": F.col("localId"), "set_id": F.coalesce(filled("set.id"), X.set_from_card_id("id")), "name": F.col("name"), "name_en": en, "name_ja": ja, "rarity": F.col("rarity"), "variant": X.flatten_variants("variants"), "image_url": F.col("image"), "updated_at": filled("updated")}, [F.lit(level).alias("detail_level")])


def api_sets(df: DataFrame, language: str) -> DataFrame:
    return df.select(F.lit("pokemon").alias("game"), F.lit("tcgdex").alias("source"), F.lit(language).alias("language"), F.col("id").alias("set_id"), "name", F.col("logo").alias("logo_url"), F.col("symbol").alias("symbol_url"), F.col("cardCount.official").alias("card_count_official"), F.col("cardCount.total").alias("card_count_total"))


def _aliased(df: DataFrame, *names: str) -> Column:
    have = {c.strip().lower(): c for c in df.columns}
    found = [F.col(f"`{have[n]}`") for n in names if n in have]
    return first_filled(*found) if found else F.lit(None).cast("string")


def csv_cards(df: DataFrame, now: Column) -> DataFrame:
    """Cards of a CSV whose columns go by several names."""
    code, variant = _aliased(df, "card_code", "code"), _aliased(df, "card_art_variant", "art_variant", "variant")
    image, name = _aliased(df, "card_image", "image", "image_url"), _aliased(df, "card_name", "name")
    card_id = F.coalesce(_aliased(df, "card_id", "id"), F.when(code.isNotNull() & variant.isNotNull(), F.concat_ws("-", code, variant)).otherwise(code))
    flags = X.sample_flags(image)
    extra = [flags["reasons"].alias("url_flag_reasons"), *[_aliased(df, f"card_{k}", k).alias(f"card_{k}") for k in ("type", "color", "effect", "trigger", "banned")]]
    return _unified(df, now, _base("onepiece", "onepiece_kaggle", F.lit("en")) | {"card_id": card_id, "card_code": code, "set_id": X.set_from_prefix(code, _aliased(df, "card_expansion", "expansion", "set_name")), "name": name, "name_en": name, "rarity": _aliased(df, "card_rarity", "rarity"), "variant": variant, "image_url": image, "is_watermarked": flags["is_watermarked"], "is_sample": flags["is_sample"]}, extra)


def dataset_cards(df: DataFrame, now: Column) -> DataFrame:
    """Cards of the columnar dataset (id, code, set_code, pack_id, language, name, rarity, ...)."""
    language = F.coalesce(filled("language"), F.lit("en"))
    extra = [F.col(c) for c in ("card_type", "colors", "effect_text", "trigger_text", "keywords", "set_name") if c in df.columns]
    return _unified(df, now, _base("onepiece", "optcg_hf_cards", language) | {"card_id": F.col("id"), "card_code": F.col("code"), "set_id": first_filled("set_code", "pack_id"), "name": F.col("name"), "name_en": F.when(language == "en", F.col("name")), "rarity": F.col("rarity"), "variant": X.variant_from_id("id")}, extra)


def picture_cards(df: DataFrame, now: Column) -> DataFrame:
    """Inspected picture files (path, width, height, image_format, is_valid_image, image_error, image_sha256); the hash counts only
    for valid pictures."""
    f = X.file_fields("path")
    extra = [f["rule"].alias("filename_rule"), f["parsed"].alias("filename_parsed"), f["name_slug"].alias("name_slug"), F.col("is_valid_image"), F.col("image_format"), F.col("image_error")]
    return _unified(df, now, _base("pokemon", "pokemon_kaggle_images", f["language"]) | {"card_id": f["card_id"], "card_code": f["card_code"], "set_id": f["set_id"], "variant": f["variant"], "local_image_path": F.col("path"), "image_sha256": F.when(F.col("is_valid_image"), F.col("image_sha256")), "width": F.col("width"), "height": F.col("height")}, extra)


def official_cards(df: DataFrame, now: Column) -> DataFrame:
    """Parsed detail pages (official_card_id, name_ja, set_id, card_code, ...)."""
    matchable = filled("set_id").isNotNull() & filled("card_code").isNotNull()
    card_id = F.when(matchable, F.concat_ws("-", "set_id", "card_code")).otherwise(F.concat(F.lit("official_"), "official_card_id"))
    extra = [F.col(c) for c in ("official_card_id", "illustrator", "number_total", "pokemon_no", "pokemon_species", "hp") if c in df.columns]
    return _unified(df, now, _base("pokemon", "pokemon_card_official_ja", F.lit("ja")) | {"card_id": card_id, "card_code": F.col("card_code"), "set_id": F.col("set_id"), "name": F.col("name_ja"), "name_ja": F.col("name_ja"), "rarity": F.col("rarity"), "image_url": F.col("image_url")}, extra)


def with_pictures(cards: DataFrame, pictures: DataFrame) -> DataFrame:
    """Cards whose picture is on disk (pictures: image_url, path, width, height, image_sha256, is_valid_image), as rows of the image
    source."""
    p = pictures.select(F.col("image_url").alias("_u"), F.col("path").alias("_p"), F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("image_sha256").alias("_s"), F.col("is_valid_image").alias("_v"))
    j = cards.join(p, F.col("image_url") == F.col("_u"))
    swap = {"local_image_path": F.col("_p"), "width": F.col("_w"), "height": F.col("_h"), "image_sha256": F.when(F.col("_v"), F.col("_s")), "source": F.concat("source", F.lit("_image"))}
    return j.select(*[swap.get(c, F.col(c)).alias(c) for c in cards.columns], F.col("_v").alias("is_valid_image"))


def download_candidates(df: DataFrame, source: str, language: str | None = None, limit: int | None = None, order: str = "card_id") -> DataFrame:
    out = df.where((F.col("source") == source) & filled("image_url").isNotNull())
    if language:
        out = out.where(F.col("language") == language)
    return out if limit is None else out.orderBy(order).limit(limit)


def detail_fields(pages: DataFrame, base: str, html: str = "html") -> DataFrame:
    """Adds the fields of a card detail page: name, picture, set, number and total, rarity, illustrator, species and hit points."""
    from ..functions.unicode import unescape

    h = F.col(html)

    def get(pattern: str, group: int = 1, of: Column = h) -> Column:
        return filled(F.regexp_extract(of, pattern, group))

    picture = r'(?s)<img[^>]*class="[^"]*fit[^"]*"[^>]*src="([^"]+)"[^>]*alt="([^"]*)"'
    under = F.coalesce(get(r'(?s)<div[^>]*class="[^"]*subtext[^"]*"[^>]*>(.*?)</div>'), F.lit(""))
    plain = X.strip_tags(under)
    number = r"([A-Za-z0-9-]+)\s*/\s*([A-Za-z0-9-]+)"
    src, alt = get(picture), unescape(get(picture, 2))
    from_page = filled(F.trim(unescape(get(r'(?s)class="[^"]*img-regulation[^"]*"[^>]*alt="([^"]+)"', 1, under))))
    from_path = X.set_from_image_path(src)
    rarity = get(r'(/assets/images/card/rarity/[^"]+)', 1, under)
    species = r"<h4>No\.([0-9]+)\s*([^<]+)</h4>"
    return pages.select(
        "*",
        F.coalesce(filled(X.strip_tags(get(r'(?s)<h1[^>]*class="[^"]*Heading1[^"]*"[^>]*>(.*?)</h1>'))), alt).alias("name_ja"),
        X.absolute_url(base, src).alias("image_url"),
        F.coalesce(from_page, from_path).alias("set_id"),
        F.when(from_page.isNotNull(), "detail_subtext").when(from_path.isNotNull(), "image_path").alias("set_id_source"),
        get(number, 1, plain).alias("card_code"),
        get(number, 2, plain).alias("number_total"),
        X.rarity_from_path(rarity).alias("rarity"),
        X.strip_tags(get(r"(?s)<h4>イラストレーター</h4>\s*<a[^>]*>(.*?)</a>")).alias("illustrator"),
        get(species).alias("pokemon_no"),
        filled(X.strip_tags(get(species, 2))).alias("pokemon_species"),
        filled(X.strip_tags(get(r'(?s)<span class="hp">HP</span>\s*<span class="hp-num">([^<]+)</span>'))).alias("hp"),
    )


def suppressed_hit(hits: DataFrame, flags: DataFrame, suppress: bool = True) -> DataFrame:
    """Hits with a nested market struct; products on the flag table lose their market fields where that is wished."""
    f = F.broadcast(flags.select(F.col("product_id").alias("_f"), F.col("severity").alias("_severity"))) if len(flags.take(100_001)) <= 100_000 else flags.select(F.col("product_id").alias("_f"), F.col("severity").alias("_severity"))
    j = hits.join(f, F.col("market_product_id") == F.col("_f"), "left")
    hide = F.col("_f").isNotNull() & F.lit(suppress)

    def shown(c: str) -> Column:
        return F.when(~hide, F.col(c))

    market = F.struct(
        F.when(hide, "suppressed_suspicious_mapping").otherwise(F.col("market_match_status")).alias("match_status"),
        shown("market_product_id").alias("product_id"),
        F.coalesce(filled(shown("market_product_id")).isNotNull(), F.lit(False)).alias("has_product_id"),
        shown("market_product_name").alias("product_name"),
        shown("market_url").alias("url"),
        shown("market_min_price").alias("min_price"),
        F.col("_severity").alias("mapping_status"),
        hide.alias("mapping_suppressed"),
        F.when(hide, F.col("market_product_id")).alias("suppressed_product_id"),
    )
    return j.select(*hits.columns, market.alias("market"))
