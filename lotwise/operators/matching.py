"""Linking cards to marketplace products by strict rules, with the reason of every acceptance and rejection.

Both candidate joins keep an equality (set or code) in the join condition, so that Spark plans a hash or merge join and
checks the pattern on its survivors only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import filled, strip_zeros, truthy
from .records import mode_first_seen


#: What is read of an item of a search page, under the names that it has in the payload.
_ITEM = {"id": "string", "name": "string", "thumbnailUrl": "string", "imageUrl": "string", "image": "string", "minPrice": "double", "minPriceFormat": "string", "listingCount": "bigint", "allListingCount": "bigint", "offerCount": "bigint", "isTradingCard": "boolean"}


def page_items(data: Column | str) -> tuple[Column, Column]:
    """(items, total) of a result page (JSON text): both item arrays one after the other, the first count that is given. What isn't an array is
    none, fields of another kind and a total that is no number are null."""
    page = F.try_parse_json(F.col(data) if isinstance(data, str) else data)
    none = F.array().cast("array<variant>")
    both = F.concat(*[F.coalesce(F.try_variant_get(page, f"$.{k}", "array<variant>"), none) for k in ("streetwears", "products")])
    both = F.filter(both, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    items = F.transform(both, lambda x: F.struct(*[F.try_variant_get(x, f"$.{k}", kind).alias(k) for k, kind in _ITEM.items()]))
    count = F.coalesce(*[F.try_variant_get(page, f"$.{k}", "string") for k in ("streetwearCount", "productCount")])
    return items, count.try_cast("double").cast("bigint")


def valid_pages(pages: DataFrame) -> DataFrame:
    """Cached pages that can be used: status 200 and an object as data."""
    return pages.where((F.col("status_code") == 200) & F.col("data").rlike(r"^\s*\{"))


def products_of(pages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Products of result pages: trading cards (or unmarked) with id and name, the first row of each id within the keys."""
    items, _ = page_items("data")
    rows = valid_pages(pages).select(*keys, *[o for o in order if o not in keys], F.posexplode(items).alias("_pos", "_item"))
    item = lambda c: F.col(f"_item.{c}")
    rows = rows.withColumn("product_id", F.trim(item("id"))).withColumn("product_name", F.trim(item("name")))
    rows = rows.where(~item("isTradingCard").eqNullSafe(F.lit(False)) & truthy("product_id") & truthy("product_name"))
    w = Window.partitionBy(*keys, "product_id").orderBy(*order, "_pos")
    first = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return first.select(
        *keys, "product_id", "product_name", F.coalesce(filled(item("thumbnailUrl")), filled(item("imageUrl")), filled(item("image")), F.lit("")).alias("thumbnail_url"),
        item("minPrice").alias("min_price"), item("minPriceFormat").alias("min_price_format"), item("listingCount").alias("listing_count"), item("allListingCount").alias("all_listing_count"), item("offerCount").alias("offer_count"),
    )


def page_totals(pages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, pages_seen, cache_hits, errors, total_count, rows): what a search saw; total_count is that of the last page that gives one."""
    items, total = page_items("data")
    usable = (F.col("status_code") == 200) & F.col("data").rlike(r"^\s*\{")
    cached = F.coalesce("from_cache", F.lit(False)) if "from_cache" in pages.columns else F.lit(False)
    p = pages.select(*keys, F.struct(*order).alias("_o"), cached.cast("int").alias("_hit"), usable.alias("_ok"), F.when(usable, total).alias("_total"), F.when(usable, F.size(items)).otherwise(0).alias("_n"))
    return p.groupBy(*keys).agg(F.count("*").alias("pages_seen"), F.sum("_hit").alias("cache_hits"), F.count_if(~F.coalesce("_ok", F.lit(False))).alias("errors"), F.max_by("_total", F.when(F.col("_total").isNotNull(), F.col("_o"))).alias("total_count"), F.sum("_n").alias("rows"))


def first_keyword_with_hits(hits: DataFrame, key: str = "card_code", rank: str = "keyword_rank", product: str = "product_id", order: str = "ordinal") -> DataFrame:
    """Products of the first keyword of each code that found any, each product once."""
    best = hits.where(F.col(product).isNotNull()).groupBy(key).agg(F.min(rank).alias("_best"))
    use = hits.join(best, key).where((F.col(rank) == F.col("_best")) & F.col(product).isNotNull())
    w = Window.partitionBy(key, product).orderBy(order)
    return use.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_best")


def search_keywords(cards: DataFrame) -> DataFrame:
    """(card_code, keyword_rank, keyword, kind): the code itself, then "<name> [<code>]" of each distinct name by card id."""
    name = X.search_name(F.coalesce(filled("name"), F.col("name_en")))
    named = cards.select("card_code", name.alias("_name"), F.coalesce("card_id", F.lit("")).alias("_id")).where("_name <> ''").groupBy("card_code", "_name").agg(F.min("_id").alias("_id"))
    w = Window.partitionBy("card_code").orderBy("_id", "_name")
    more = named.select("card_code", F.row_number().over(w).alias("keyword_rank"), F.concat("_name", F.lit(" ["), "card_code", F.lit("]")).alias("keyword"), F.lit("name_code_fallback").alias("kind"))
    return cards.select("card_code").distinct().select("card_code", F.lit(0).alias("keyword_rank"), F.col("card_code").alias("keyword"), F.lit("card_code").alias("kind")).union(more)


def search_summary(metas: DataFrame, key: str = "card_code") -> DataFrame:
    """Sums over the searches of a code; total_count stays null where no search knew it."""
    return metas.groupBy(key).agg(
        F.count("*").alias("queries"),
        F.sum("pages_seen").alias("pages_seen"),
        F.sum("cache_hits").alias("cache_hits"),
        F.sum("total_count").alias("total_count"),
        F.coalesce(F.bool_or(F.col("kind") != "card_code"), F.lit(False)).alias("fallback_used"),
    )


def _product_struct() -> Column:
    return F.struct(F.lower(F.coalesce("product_name", F.lit(""))).alias("_sort"), "product_id", "product_name", "thumbnail_url", "min_price", "min_price_format", F.col("_reasons").alias("reasons"))


def _status(n: Column) -> Column:
    return F.when(n == 1, "matched").when(n > 1, "multiple_verified_matches").otherwise("no_verified_match")


def _selected(out: DataFrame, cards: list[str], more: list[Column]) -> DataFrame:
    """_n verified products, the first of them in _one, all in _verified. The list is apart from its number, so that Spark doesn't make it where
    only the number is asked for."""
    n = F.coalesce("_n", F.lit(0)).cast("int")
    one = F.when(n == 1, F.col("_one"))
    verified = F.coalesce("_verified", F.array().cast(out.schema["_verified"].dataType))
    shown = F.transform(verified, lambda v: F.struct(v["product_id"].alias("product_id"), v["product_name"].alias("product_name"), v["reasons"].alias("reasons")))
    return out.select(
        *cards,
        _status(n).alias("match_status"),
        one["product_id"].alias("product_id"),
        one["product_name"].alias("product_name"),
        F.when(n == 1, F.concat(F.lit("/apparels/"), one["product_id"])).alias("url"),
        one["thumbnail_url"].alias("thumbnail_url"),
        one["min_price"].alias("min_price"),
        one["min_price_format"].alias("min_price_format"),
        n.alias("candidate_count"),
        shown.alias("verified_candidates"),
        *more,
    )


def match_by_reference(cards: DataFrame, products: DataFrame) -> DataFrame:
    """Cards (card_id, set_id, card_code) against the products found for their set: the title must hold set, number and total
    in this order and no foreign language mark. Candidates are sorted by title and id."""
    c = cards.where(truthy("set_id") & truthy("card_code"))
    # a match needs its number right before a slash, so the numerators of a title are a join key beside the set
    tops = F.array_distinct(F.transform(F.regexp_extract_all("product_name", F.lit(r"(\d+)\s*/"), F.lit(1)), strip_zeros))
    p = products.withColumnRenamed("set_id", "_set").where(~X.foreign_language("product_name")).withColumn("_refs", X.title_refs("product_name")).withColumn("_top", F.explode(tops))
    ref = X.title_ref("product_name", "set_id", "card_code", F.col("_refs"))
    # cards of one set and code have the same candidates, which are looked for once
    asked = c.select("set_id", "card_code").distinct().withColumn("_number", X.number_parts("card_code")[0])
    pairs = asked.join(p.hint("merge"), (F.col("set_id") == F.col("_set")) & (F.col("_number") == F.col("_top"))).withColumn("_ref", ref).where("_ref.ok").withColumn("_reasons", F.array("_ref.reason"))
    found = pairs.groupBy("set_id", "card_code").agg(F.count("*").alias("_n"), F.min(_product_struct()).alias("_one"), F.array_sort(F.collect_list(_product_struct())).alias("_verified"))
    return _selected(c.join(found.hint("merge"), ["set_id", "card_code"], "left"), ["card_id", "set_id", "card_code"], [])


def gates(kind: Column, local: Column, remote: Column, title: Column) -> Column:
    """Reasons of the variant gate and whether it is passed: struct (ok, reasons)."""
    modifier, descriptor = title["modifier"], F.lower(F.coalesce(title["descriptor"], F.lit("")))
    special = F.coalesce(modifier.isin("SP", "SPC"), F.lit(False)) | F.contains(descriptor, F.lit("comic parallel"))
    parallel = F.coalesce(modifier.isin("P", "PL"), F.lit(False)) | (title["is_parallel"] & ~special)
    exact = F.coalesce(local == remote, F.lit(False))
    suffix = F.concat(F.lit("thumbnail_suffix:"), remote)

    def no(*reason: Column | str) -> Column:
        return F.struct(F.lit(False).alias("ok"), F.array(F.concat(*[F.lit(r) if isinstance(r, str) else r for r in reason])).alias("reasons"))

    def yes(*reasons: Column | str) -> Column:
        return F.struct(F.lit(True).alias("ok"), F.array(*[F.lit(r) if isinstance(r, str) else r for r in reasons]).alias("reasons"))

    plain = modifier.isNull() & title["descriptor"].isNull() & ~title["is_parallel"]
    return (
        F.when(local.isNotNull() & (local != "base") & ~exact, no("thumbnail_suffix_mismatch:", local, "!=", F.coalesce(remote, F.lit("unknown"))))
        .when((kind == "regular") & plain & exact, yes(suffix, "regular_class"))
        .when((kind == "regular") & plain, yes("regular_class"))
        .when(kind == "regular", no("regular_variant_mismatch"))
        .when((kind == "printed_variant") & exact, yes(suffix))
        .when(kind == "printed_variant", no("missing_thumbnail_suffix:", F.coalesce(local, F.lit("unknown"))))
        .when((kind == "parallel") & exact & parallel, yes(suffix, F.concat(F.lit("parallel_class:"), F.coalesce(modifier, F.lit("parallel")))))
        .when(kind == "parallel", no(F.when(exact, "parallel_class_mismatch").otherwise("parallel_variant_mismatch")))
        .when(exact & special, yes(suffix, F.concat(F.lit("special_class:"), F.coalesce(modifier, F.lit("comic_parallel")))))
        .otherwise(no(F.when(exact, "special_class_mismatch").otherwise("special_variant_mismatch")))
    )


def base_rarities(cards: DataFrame, order: str = "ordinal") -> DataFrame:
    """(card_code, base_rarity): the most frequent rarity of a code but for special ones, of equals the first seen."""
    r = cards.select("card_code", X.normalize_rarity("rarity").alias("base_rarity"), order).where(truthy("card_code") & (F.col("base_rarity") != "SP CARD"))
    return mode_first_seen(r, "card_code", "base_rarity", order).select("card_code", "base_rarity")


def _judged_by(cards: DataFrame, order: str) -> DataFrame:
    """Cards with what the gates look at."""
    base = base_rarities(cards, order).withColumnRenamed("card_code", "_bcode")
    c = cards.join(base.hint("merge"), F.col("card_code") == F.col("_bcode"), "left").withColumn("_rarity", X.normalize_rarity("rarity"))
    expected = F.when(F.col("_rarity") == "SP CARD", F.col("base_rarity")).otherwise(F.col("_rarity"))
    c = c.withColumn("_expected", expected).withColumn("_kind", X.variant_kind("rarity", "name", "image_url")).withColumn("_local", X.image_suffix("image_url"))
    return c.withColumn("_name", X.normalize_name(F.coalesce(filled("name"), F.col("name_en")))).withColumn("_en", F.lower("language").eqNullSafe("en"))


def _judged(products: DataFrame) -> DataFrame:
    """Products with what the gates look at."""
    return products.withColumnRenamed("card_code", "_code").withColumn("_t", X.parse_title("product_name", "_code")).withColumn("_remote", X.thumbnail_suffix("thumbnail_url")).withColumn("_seen", X.thumbnail_language("thumbnail_url"))


def _language_gate(en: Column) -> Column:
    return F.when(~en, "language_not_constrained").when(F.col("_t.language") == "en", "title_language_en").when(F.col("_seen") == "en", "thumbnail_language_en")


def _verdict(named: Column) -> tuple[Column, Column]:
    """(reasons of the first gate that fails, null without one; reasons of what passes): columns of a card beside those of a product."""
    t, variant = F.col("_t"), gates(F.col("_kind"), F.col("_local"), F.col("_remote"), F.col("_t"))
    language, rarity_ok = _language_gate(F.col("_en")), F.coalesce(t["base_rarity"] == F.col("_expected"), F.lit(False))
    failed = (
        F.when(~t["code_exact"], F.array(F.concat(F.lit("code_mismatch:"), "card_code")))
        .when(language.isNull(), F.array(F.lit("missing_en_marker")))
        .when(~named, F.array(F.lit("name_mismatch")))
        .when(~rarity_ok, F.array(F.concat(F.lit("rarity_mismatch:"), F.coalesce("_expected", F.lit("unknown")), F.lit("!="), F.coalesce(t["base_rarity"], F.lit("unknown")))))
        .when(~variant["ok"], variant["reasons"])
    )
    passed = F.concat(F.array(F.concat(F.lit("code_exact:"), "card_code"), language, F.lit("name_exact_normalized"), F.concat(F.lit("rarity_base:"), "_expected")), variant["reasons"])
    return failed, passed


def judge_candidates(cards: DataFrame, products: DataFrame, order: str = "ordinal") -> DataFrame:
    """Every card beside every product found for its code, with ok and reasons: five gates in order, the first that fails
    gives the reason."""
    # what depends on one side only is worked out before the pairing
    j = _judged_by(cards, order).join(_judged(products), F.col("card_code") == F.col("_code"))
    failed, passed = _verdict((F.col("_name") != "") & (F.col("_name") == F.col("_t.name_prefix_normalized")))
    return j.withColumn("_failed", failed).select(*cards.columns, "_kind", "_local", "product_id", "product_name", "thumbnail_url", "min_price", "min_price_format", F.col("_failed").isNull().alias("ok"), F.coalesce("_failed", passed).alias("_reasons"))


#: Rejected products that a card shows.
EXAMPLES = 5


def _product_classes(products: DataFrame) -> DataFrame:
    """Products of a code that no gate can tell apart as one row: their number (_m), the first of them, the EXAMPLES first and all."""
    p = _judged(products)
    d = F.lower(F.col("_t.descriptor"))
    t = F.col("_t").dropFields("name_prefix").withField("descriptor", F.when(F.contains(d, F.lit("comic parallel")), "comic parallel").when(d.isNotNull(), "other"))
    own = F.struct(F.lower(F.coalesce("product_name", F.lit(""))).alias("_sort"), "product_id", "product_name", "thumbnail_url", "min_price", "min_price_format")
    p = p.select("_code", t.alias("_t"), "_remote", F.when(F.col("_seen") == "en", "en").alias("_seen"), own.alias("_p"))
    keys = ["_code", "_t", "_remote", "_seen"]
    p = p.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("_p")))
    g = p.groupBy(*keys).agg(F.count("*").alias("_m"), F.min("_p").alias("_first"), F.array_sort(F.collect_list(F.when(F.col("_i") <= EXAMPLES, F.col("_p")))).alias("_some"), F.collect_list("_p").alias("_all"))
    return g.withColumn("_label", F.col("_t.name_prefix_normalized"))


def _summed() -> list[Column]:
    """Sums over classes of products."""
    return [F.sum("_m").alias("_m"), F.min("_first").alias("_first"), F.slice(F.array_sort(F.flatten(F.collect_list("_some"))), 1, EXAMPLES).alias("_some")]


def _other_names(classes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _m, _names): of products that pass the gates before that of the name, the number by code and the first names with their first
    products, as many as hold the EXAMPLES first products that haven't a certain name."""
    named = classes.groupBy(*keys, "_label").agg(*_summed())
    w = Window.partitionBy(*keys)
    ranked = named.withColumn("_i", F.row_number().over(w.orderBy("_first")))
    return ranked.groupBy(*keys).agg(F.sum("_m").alias("_open"), F.collect_list(F.when(F.col("_i") <= EXAMPLES + 1, F.struct("_label", "_first", "_some"))).alias("_names"))


def _rejections(asked: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products that pass, rejected ones by reason) for each class of cards (asked, with its number _class). Cards meet products of their own
    name only; what fails by code, language or name is counted by code."""
    both = classes.withColumn("_flag", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("_stage", F.when(~F.col("_t.code_exact"), "code").when(_language_gate(F.col("_flag")).isNull(), "language").otherwise("open"))
    early = both.where("_stage <> 'open'").groupBy("_code", "_flag", "_stage").agg(*_summed())
    same = [F.col("card_code") == F.col("_code"), F.col("_en") == F.col("_flag")]
    reason = F.when(F.col("_stage") == "code", F.concat(F.lit("code_mismatch:"), "card_code")).otherwise("missing_en_marker")
    wide = ["_class", "_reason", "_m", "_first", "_some"]
    bad = asked.join(early.hint("merge"), same).withColumn("_reason", reason).select(*wide)
    open_ = both.where("_stage = 'open'")
    own = asked.where("_name <> ''").join(open_.hint("merge"), [*same, F.col("_name") == F.col("_label")])
    failed, passed = _verdict(F.lit(True))
    own = own.withColumn("_failed", failed).withColumn("_passed", F.when(F.col("_failed").isNull(), passed))
    held = own.groupBy("_class").agg(F.sum("_m").alias("_held"))
    others = asked.join(_other_names(open_, ["_code", "_flag"]).hint("merge"), same).join(held.hint("merge"), "_class", "left")
    rest = F.filter("_names", lambda x: (x["_label"] != F.col("_name")) | (F.col("_name") == ""))
    others = others.withColumn("_m", F.col("_open") - F.coalesce("_held", F.lit(0))).where("_m > 0").withColumn("_rest", rest)
    others = others.select("_class", F.lit("name_mismatch").alias("_reason"), "_m", F.array_min(F.transform("_rest", lambda x: x["_first"])).alias("_first"), F.slice(F.array_sort(F.flatten(F.transform("_rest", lambda x: x["_some"]))), 1, EXAMPLES).alias("_some"))
    late = own.where("_failed is not null").withColumn("_reason", F.get("_failed", F.lit(0))).groupBy("_class", "_reason").agg(*_summed()).select(*wide)
    return own.where("_failed is null"), bad.union(others.select(*wide)).union(late)


def match_by_gates(cards: DataFrame, products: DataFrame, searches: DataFrame | None = None, order: str = "ordinal") -> DataFrame:
    """One row per card: status, the product if exactly one is verified, reject reasons counted, the first five rejected
    candidates, and why nothing matched. searches (card_code, failed) marks codes whose search had errors. Cards and products that the gates
    can't tell apart are judged once."""
    keys = ["card_code", "_en", "_name", "_expected", "_kind", "_local"]
    c = _judged_by(cards, order)
    asked = c.where("card_code is not null").select(*keys).distinct().withColumn("_class", F.struct(*keys))
    good, bad = _rejections(asked, _product_classes(products))
    product = lambda v, reasons: F.struct(*[v[f].alias(f) for f in ("_sort", "product_id", "product_name", "thumbnail_url", "min_price", "min_price_format")], reasons.alias("reasons"))
    passed = good.groupBy("_class").agg(
        F.sum("_m").alias("_n"),
        F.min(product(F.col("_first"), F.col("_passed"))).alias("_one"),
        F.array_sort(F.flatten(F.collect_list(F.transform("_all", lambda v: product(v, F.col("_passed")))))).alias("_verified"),
    )
    by_reason = F.struct("_reason", F.col("_m").alias("n"), "_first")
    rejected = bad.groupBy("_class").agg(
        F.sum("_m").alias("_bad"),
        F.array_sort(F.collect_list(by_reason)).alias("_reasons"),
        F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("_some", lambda v: product(v, F.array("_reason")))))), 1, EXAMPLES).alias("_examples"),
    )
    out = c.withColumn("_class", F.struct(*keys)).join(passed.hint("merge"), "_class", "left").join(rejected.hint("merge"), "_class", "left")
    reasons = F.coalesce("_reasons", F.array().cast(rejected.schema["_reasons"].dataType))
    groups = F.array_sort(F.array_distinct(F.transform(reasons, lambda r: F.substring_index(r["_reason"], ":", 1))))
    of = lambda g: F.aggregate(F.filter(reasons, lambda r: F.substring_index(r["_reason"], ":", 1) == g), F.lit(0).cast("bigint"), lambda s, r: s + r["n"])
    out = out.withColumn("reject_reason_counts", F.map_from_entries(F.transform(reasons, lambda r: F.struct(r["_reason"], r["n"]))))
    out = out.withColumn("reject_reason_group_counts", F.map_from_entries(F.transform(groups, lambda g: F.struct(g, of(g)))))
    found = products.groupBy("card_code").agg(F.count_distinct("product_id").alias("_found"))
    out = out.join(found.hint("merge"), "card_code", "left")
    failed = F.lit(False)
    if searches is not None:
        out = out.join(searches.select("card_code", F.col("failed").alias("_failed")), "card_code", "left")
        failed = F.coalesce("_failed", F.lit(False))
    n = F.coalesce("_n", F.lit(0)).cast("int")
    # the most frequent reason, of equals the one that comes first among the rejected products
    most = F.array_max(F.transform(reasons, lambda r: r["n"]))
    top = F.array_min(F.transform(F.filter(reasons, lambda r: r["n"] == most), lambda r: F.struct(r["_first"].alias("f"), r["_reason"].alias("v"))))["v"]
    detail = F.when(n > 1, F.concat(F.lit("verified_candidate_count:"), n)).when(n == 0, F.when(failed, "search_errors_present").when(F.coalesce("_found", F.lit(0)) == 0, "search_returned_no_exact_code_products").otherwise(top))
    why = F.when(n > 1, "multiple_verified_candidates").when(n == 0, F.when(failed, "search_error").when(F.coalesce("_found", F.lit(0)) == 0, "no_exact_code_products").otherwise(F.coalesce(F.substring_index(top, ":", 1), F.lit("no_verified_candidate"))))
    examples = F.transform(F.coalesce("_examples", F.array().cast(rejected.schema["_examples"].dataType)), lambda r: F.struct(r["product_id"].alias("product_id"), r["product_name"].alias("product_name"), r["reasons"].alias("reasons")))
    return _selected(
        out,
        ["card_id", "set_id", "card_code", "language", "name", "rarity"],
        [X.image_suffix("image_url").alias("image_suffix"), X.variant_kind("rarity", "name", "image_url").alias("variant_kind"), why.alias("unmatched_reason"), detail.alias("unmatched_reason_detail"), F.coalesce("_bad", F.lit(0)).cast("int").alias("rejected_count"), F.col("reject_reason_counts"), F.col("reject_reason_group_counts"), examples.alias("rejected_examples")],
    )


def best_overlap(texts: DataFrame, items: DataFrame, key: str, item: str, cells: int = 64_000_000) -> DataFrame:
    """(key, item, shared, similarity): for each row of texts(key, words) the row of items(item, words) that shares the greatest part of the smaller
    word set, of equals the least item; words are arrays of distinct words, and rows that share none give none. Items go in
    blocks of at most about `cells` cells of word and item, each a matrix that goes along with one pass over the texts."""
    spark = texts.sparkSession
    size, terms = items.agg(F.count("*"), F.sum(F.size("words"))).first()
    n = max(1, -(-size * (terms or 0) // cells)) if size else 0
    blocks = 1
    while blocks * blocks < n:  # a block has fewer words as well as fewer items
        blocks += 1
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((texts, key), (items, item))}
    schema = f"{key} {kinds[key]}, {item} {kinds[item]}, shared bigint, similarity double"
    out = spark.createDataFrame([], schema)
    for b in range(blocks if size else 0):
        t = items.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == b).select(item, "words").orderBy(item).toArrow()
        if t.num_rows:
            out = out.union(texts.select(key, "words").mapInArrow(_overlaps(t, key, item), schema))
    if blocks == 1:
        return out
    best = out.groupBy(key).agg(F.max_by(F.struct(item, "shared", "similarity"), F.struct("similarity", (-F.col(item)).alias("i"))).alias("_b"))
    return best.select(key, "_b.*")


#: Cells of word and item that are gathered at once.
HELD = 2_000_000


def _counts(cell: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of some rows of a matrix, by parts of HELD cells."""
    step = max(1, HELD // cell.shape[1])
    return sum(cell[at[x : x + step]].sum(0) for x in range(0, len(at), step))


def _overlaps(items: pa.Table, key: str, item: str):
    held = items["words"].combine_chunks()
    words = pc.unique(held.flatten())
    ids = items[item].combine_chunks()
    length = pc.list_value_length(held).fill_null(0).to_numpy(zero_copy_only=False)
    cell = np.zeros((len(words) + 1, len(ids)), np.float32)  # the last row is for words that no item has
    cell[pc.index_in(held.flatten(), words).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), length)] = 1
    cell[-1] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pc.list_value_length(b["words"]).fill_null(0).to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(b["words"].flatten(), words), len(words)).to_numpy(zero_copy_only=False)
            seen = at < len(words)  # most words of a text are no item's
            doc, at = np.repeat(np.arange(len(own)), own)[seen], at[seen]
            begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
            ends = np.append(begin, len(doc))[1:]
            x = 0
            while x < len(begin):  # as many texts at once as have HELD cells, or one
                y = max(x + 1, int(np.searchsorted(ends, begin[x] + HELD // len(ids), "right")))
                shared = np.stack([_counts(cell, at[begin[i] : ends[i]]) for i in range(x, y)])
                row = doc[begin[x:y]]
                share = np.round(shared.astype(np.float64) / np.minimum(own[row][:, None], np.maximum(length, 1)[None, :]), 9)
                k = share.argmax(1)
                n = shared[np.arange(len(row)), k].astype(np.int64)
                yield pa.RecordBatch.from_arrays([b[key].take(pa.array(row)), ids.take(pa.array(k)), pa.array(n), pa.array(share[np.arange(len(row)), k])], [key, item, "shared", "similarity"])
                x = y

    return run


def tally(values: Column | str) -> Column:
    """Map of each distinct text of an array to its number, sorted by text."""
    a = F.col(values) if isinstance(values, str) else values
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(a)), lambda v: F.struct(v, F.size(F.filter(a, lambda x: x == v)).cast("bigint"))))


def most_common(values: Column | str) -> Column:
    """The most frequent text of an array, of equals the one that comes first."""
    a = F.col(values) if isinstance(values, str) else values
    ranked = F.transform(F.array_distinct(a), lambda v: F.struct(F.size(F.filter(a, lambda x: x == v)).alias("n"), (-F.array_position(a, v)).alias("p"), v.alias("v")))
    return F.array_max(ranked)["v"]


def summarize(matches: DataFrame, top: int = 25) -> DataFrame:
    """(kind, value, n): matches by status, variant kind and reason, and the reject reasons of unmatched cards."""
    parts = [matches.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "value", "n") for k, c in (("status", "match_status"), ("variant_kind", "variant_kind"))]
    parts.append(matches.groupBy(F.coalesce("unmatched_reason", F.lit("matched")).alias("value")).agg(F.count("*").alias("n")).select(F.lit("unmatched_reason").alias("kind"), "value", "n"))
    bad = matches.where(F.col("match_status") == "no_verified_match")
    for k, c, limit in (("reject_group", "reject_reason_group_counts", None), ("reject_reason", "reject_reason_counts", top)):
        s = bad.select(F.explode(c).alias("value", "_n")).groupBy("value").agg(F.sum("_n").alias("n"))
        parts.append((s.orderBy(F.desc("n"), "value").limit(limit) if limit else s).select(F.lit(k).alias("kind"), "value", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
