"""Queries of the text, date, money and source functions: whole driver tables, turned into texts of many shapes, with the SQL of what the
functions must read from them. Tables are read whole; second tables made from them (flags, pictures) lack some keys, so that both
outcomes of a join occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as X
from ..functions.values import text_int
from ..operators import lookup, matching
from ..sources import adapters, readers
from .catalog_queries import query, table

_NOW = "2024-03-01 12:00:00"


def _now() -> Column:
    return F.lit(_NOW).cast("timestamp")


def cases(k: Column, *values: object) -> Column:
    """The k-th value, null past the last."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, v in enumerate(values):
        out = out.when(k == i, v if isinstance(v, Column) else F.lit(v))
    return out


def _pad(c: Column | str, n: int) -> Column:
    return F.lpad((F.col(c) if isinstance(c, str) else c).cast("string"), n, "0")


def _text(*parts: Column | str) -> Column:
    """Parts one after the other; plain texts are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# dates, money


@query(
    f"""WITH t AS (SELECT event_id, event_id % 7 AS k, (event_id % 50 + 1)::INT AS n, ts FROM events)
SELECT event_id, strftime(CASE k WHEN 0 THEN TIMESTAMP '{_NOW}' - to_days(n) WHEN 1 THEN TIMESTAMP '{_NOW}' - to_hours(n) WHEN 2 THEN TIMESTAMP '{_NOW}' - to_minutes(n) WHEN 6 THEN TIMESTAMP '{_NOW}' ELSE date_trunc('day', ts) END, '%Y-%m-%d %H:%M') AS at FROM t"""
)
def q51_loose_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 50 + 1
    day = lambda pattern: F.date_format("ts", pattern)
    text = cases(F.col("event_id") % 7, _text(n, "日前"), _text(n, "時間前"), _text(n, "分前"), day("yyyy-M-d"), day("yyyy/M/d"), day("MMM d, yyyy"), "soon")
    return e.select("event_id", F.date_format(M.loose_time(text, _now()), "yyyy-MM-dd HH:mm").alias("at"))


@query(
    f"""WITH t AS (SELECT event_id, ts, event_id % 120 AS d FROM events)
SELECT event_id, strftime(CASE WHEN event_id % 7 = 6 THEN TIMESTAMP '{_NOW}' ELSE ts END, '%Y/%m/%d') AS day,
CASE WHEN event_id % 2 = 0 THEN CASE WHEN d = 0 THEN ' (24h)' WHEN d < 30 THEN ' (last ' || d || ' days)' WHEN d <= 60 THEN ' (last 1 month)' ELSE ' (last ' || round_even(d / 30.0, 0)::INT || ' months)' END
ELSE CASE WHEN d < 30 THEN ' (近' || d || '天)' WHEN d <= 60 THEN ' (近1个月)' ELSE ' (近' || round_even(d / 30.0, 0)::INT || '个月)' END END AS span FROM t"""
)
def q52_date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    iso = F.when(F.col("event_id") % 7 == 6, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    language = F.when(F.col("event_id") % 2 == 0, "en").otherwise("zhs")
    return e.select("event_id", M.date_label(iso, _now()).alias("day"), M.span_label(language, F.col("event_id") % 120).alias("span"))


@query(
    """SELECT o_orderkey, round(o_totalprice, 6) AS number, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE round_even(o_totalprice, 0)::BIGINT END AS prize, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE 'a' || o_orderkey END AS shown,
CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey::INT END AS whole, '¥' || format('{:,}', round_even(o_totalprice, 0)::BIGINT) AS yen, '$' || printf('%.2f', o_totalprice) AS dollars, round_even(o_totalprice * 150.0, 0)::BIGINT AS jpy FROM orders"""
)
def q53_lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.round(X.first_number(_text("about ", F.format_number(price, 2), " yen or 7")), 6).alias("number"),
        M.prize_yen(F.when(k % 2 != 0, price.cast("string")), _text("no. ", k, " pt")).alias("prize"),
        M.price_text(F.when(k % 3 == 0, ""), F.when(k % 3 != 2, _text("a", k))).alias("shown"),
        text_int(cases(k % 4, _text(k), _text(" ", k, " "), _text(k, ".5"), "x")).alias("whole"),
        M.yen(price).alias("yen"),
        M.dollars(price).alias("dollars"),
        M.jpy_from_usd(price.cast("string"), F.lit(150.0)).alias("jpy"),
    )


@query(
    """SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 2 OR c_acctbal <= 0 THEN 150 ELSE c_acctbal END, 6)::DOUBLE AS rate, CASE WHEN c_custkey % 3 = 0 THEN 'override' WHEN c_custkey % 3 = 1 AND c_acctbal > 0 THEN 'live' ELSE 'fallback' END AS status,
c_custkey AS total, 0::BIGINT AS ten, round(c_acctbal, 6) AS gem_rate FROM customer"""
)
def q54_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, money = F.col("c_custkey"), F.col("c_acctbal")
    r = M.resolve_rate(F.when(k % 3 == 0, money), F.when(k % 3 == 1, money))
    p = M.population(F.create_map(F.lit("total_population"), k.cast("string"), F.lit("psa10_count"), F.lit("many"), F.lit("gem_mint_rate"), money.cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(r["rate"], 6).alias("rate"), r["status"].alias("status"), p["total_population"].alias("total"), p["psa10_count"].alias("ten"), F.round(p["gem_mint_rate"], 6).alias("gem_rate"))


# interface and label texts


@query(
    """WITH t AS (SELECT o_orderkey AS k, split_part(o_orderpriority, '-', 2) AS w FROM orders), u AS (SELECT *, w IN ('HIGH', 'MEDIUM', 'LOW') AS known FROM t)
SELECT k AS o_orderkey, CASE WHEN k % 11 <> 0 AND known THEN upper(w[1]) || lower(w[2:]) ELSE 'N/A' END AS level, CASE WHEN k % 11 = 0 THEN 'Insufficient data' WHEN known THEN k::VARCHAR ELSE w || ': ' || k END AS text,
CASE WHEN k % 11 = 0 OR NOT known THEN 0 WHEN w = 'HIGH' THEN 90 WHEN w = 'MEDIUM' THEN 60 ELSE 30 END AS width, CASE k % 5 WHEN 0 THEN 'a' WHEN 1 THEN '가' WHEN 2 THEN '乙' ELSE '甲' END AS chosen, k || '/' || CASE WHEN k % 3 = 0 THEN '' ELSE w END AS made FROM u"""
)
def q55_interface_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, word = F.col("o_orderkey"), F.substring_index("o_orderpriority", "-", -1)
    level = X.level_and_text(F.when(k % 11 == 0, "n/a").otherwise(_text(word, ": ", k)))
    language = X.interface_language(cases(k % 5, "EN-us", "ko", " zh-CN ", "fr"))
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", level["level"].alias("level"), level["text"].alias("text"), level["width"].alias("width"), X.choose_text(language, "甲", "a", "가", "乙").alias("chosen"), X.fill_template("{{k}}/{{w}}", {"k": k, "w": F.when(k % 3 != 0, word)}).alias("made"))


@query(
    """WITH t AS (SELECT c_custkey AS k, c_custkey % 6 AS i FROM customer)
SELECT k AS c_custkey, CASE i WHEN 0 THEN lpad(k::VARCHAR, 8, '0') WHEN 1 THEN 'AB-CD' WHEN 2 THEN k::VARCHAR WHEN 3 THEN lpad(k::VARCHAR, 8, '0') WHEN 4 THEN '1' || lpad(k::VARCHAR, 5, '0') END AS cert, CASE i WHEN 2 THEN 'url' WHEN 3 THEN 'numeric_cert_like' WHEN 4 THEN 'numeric_other_length' ELSE 'other_text' END AS kind, CASE WHEN i = 2 THEN 'psa' END AS grader FROM t"""
)
def q56_cert_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = cases(k % 6, _text("PSA ", _pad(k, 8)), "ab-cd", _text("https://www.psacard.com/cert/", k), _pad(k, 8), _text("1", _pad(k, 5)))
    return table(spark, sf_dir, "customer").select("c_custkey", X.cert_key(text).alias("cert"), X.barcode_kind(text).alias("kind"), X.grader_hint(text).alias("grader"))


@query(
    """WITH t AS (SELECT p_partkey, p_name AS n, lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS c, p_partkey % 2 = 0 AS p FROM part)
SELECT p_partkey, c AS number, upper(n) AS subject, 'EXPANSION PACK ' || CASE WHEN p THEN 'SV-P PROMO' ELSE 'B' END AS title, 'ja' AS language, CASE WHEN p THEN 'SV-P' END AS set_id FROM t"""
)
def q57_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of graded cards: year, game and set on the first line, then subject, number, grade and certificate."""
    number = _pad(F.col("p_partkey") % 1000, 3)
    first = _text("2021 POKEMON JAPANESE EXPANSION PACK ", F.when(F.col("p_partkey") % 2 == 0, "SV-P PROMO").otherwise("B"))
    p = X.parse_label(_text(first, "\n", F.col("p_name"), "\n#", number, "\nGEM MT\n", _pad("p_partkey", 8)), by_line=True)
    t = table(spark, sf_dir, "part").select("p_partkey", p.alias("p"))
    return t.select("p_partkey", F.col("p.card_number").alias("number"), F.col("p.subject").alias("subject"), F.col("p.set_title").alias("title"), F.col("p.language").alias("language"), F.col("p.set_id").alias("set_id"))


@query(
    """WITH t AS (SELECT c_custkey AS k, c_custkey % 4 AS i, c_custkey % 3 AS j FROM customer)
SELECT k AS c_custkey, CASE WHEN i = 0 THEN 'en' WHEN i = 1 AND j = 0 THEN 'ja' WHEN j = 1 THEN 'en' WHEN i = 1 AND j = 2 THEN NULL WHEN j = 0 THEN 'ja' END AS wanted, CASE i WHEN 0 THEN 'ja' WHEN 1 THEN 'en' WHEN 2 THEN 'en' END AS candidate, CASE i WHEN 0 THEN 'onepiece' WHEN 1 THEN 'pokemon' WHEN 2 THEN 'pokemon' WHEN 3 THEN 'onepiece' END AS family FROM t"""
)
def q58_languages_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language asked for, else of the hint, else of the label; a candidate's language and family by its fields, else by its index."""
    k = F.col("c_custkey")
    i, j = k % 4, k % 3
    wanted = X.requested_language(F.when(i == 0, "ENG"), F.when(j == 0, "ピカチュウ"), F.when(j == 1, "English card"))
    candidate = X.candidate_language(F.when(i == 1, "English"), cases(i, "pokemon_ja_canonical", "pokemon_ja", "cards_en", "onepiece"))
    family = X.candidate_family([cases(i, "One Piece", None)], cases(i, "pokemon_ja", "pokemon_en", "x"), [cases(i, "tcgdex", "optcg", "pokemon_kaggle_images", "optcg_hf_cards")])
    return table(spark, sf_dir, "customer").select("c_custkey", wanted.alias("wanted"), candidate.alias("candidate"), family.alias("family"))


# names, codes, titles, addresses


@query(
    """WITH t AS (SELECT *, p_partkey % 3 AS k, lpad(p_size::VARCHAR, 2, '0') AS s FROM part)
SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') || CASE WHEN k = 1 THEN 'co' ELSE '' END AS compared, p_name || CASE WHEN k = 1 THEN ' &amp; Co' ELSE '' END AS searched, k = 0 AS parallel, 'sv' || p_size AS set_of_id, 'OP' || s AS set_of_code, 'OP' || s AS set_of_prefix, CASE WHEN k = 2 THEN 'p1' END AS variant,
CASE WHEN p_partkey % 6 = 0 THEN 'holo,normal' WHEN p_partkey % 2 = 0 THEN 'normal' WHEN p_partkey % 3 = 0 THEN 'holo' END AS variants, CASE WHEN k = 0 THEN p_name END AS name_en, CASE WHEN k = 1 THEN p_name END AS name_ja, p_name || ' x' AS clean FROM t"""
)
def q59_names_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("p_partkey"), F.col("p_name")
    k = key % 3
    code = _text("OP", _pad("p_size", 2), "-", _pad(key, 3))
    long = _text(name, cases(k, " (Parallel)", " &amp; Co", ""))
    en, ja = X.split_name(cases(k, "en", "ja", "ko"), name)
    flags = F.create_map(F.lit("normal"), key % 2 == 0, F.lit("holo"), k == 0, F.lit("reverse"), F.lit(None).cast("boolean"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.normalize_name(long).alias("compared"), X.search_name(long).alias("searched"), X.is_parallel(long).alias("parallel"),
        X.set_from_card_id(_text("sv", F.col("p_size"), "-", key)).alias("set_of_id"), X.set_from_code(code).alias("set_of_code"), X.set_from_prefix(code, F.lit("?")).alias("set_of_prefix"),
        X.variant_from_id(F.when(k == 2, _text(code, "_p1")).otherwise(code)).alias("variant"), X.flatten_variants(flags).alias("variants"), en.alias("name_en"), ja.alias("name_ja"), X.clean_text(_text("  ", name, " \n\t x ")).alias("clean"),
    )


@query(
    """WITH t AS (SELECT p_partkey, p_partkey % 4 AS k, lpad(p_size::VARCHAR, 3, '0') AS p, p_size AS n FROM part)
SELECT p_partkey, k < 3 AS ok, CASE k WHEN 0 THEN 'fraction_numerator:' || p || '/165' WHEN 1 THEN 'standalone_padded' WHEN 2 THEN 'standalone_clean' ELSE 'number_mismatch' END AS reason, p_partkey % 2 = 0 AS in_set FROM t"""
)
def q60_title_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("p_partkey"), F.col("p_size")
    title = _text("Card ", F.substring_index("p_brand", "#", 0), cases(key % 4, _text(_pad(n, 3), "/165"), _text("No ", _pad(n, 3)), _text("No ", n, "!"), "999"))
    found = X.title_number(title, n.cast("string"))
    number = F.substring_index("p_brand", "#", -1)
    return table(spark, sf_dir, "part").select("p_partkey", found["ok"].alias("ok"), found["reason"].alias("reason"), X.mentions_set(_text("x sv", number, F.when(key % 2 == 0, " y").otherwise("0 y")), _text("SV", number)).alias("in_set"))


@query(
    r"""WITH t AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS p, page_id % 4 AS k FROM pages)
SELECT page_id, CASE k WHEN 0 THEN url WHEN 1 THEN 'https://shop.example/a/' || page_id WHEN 2 THEN 'https://shop.example/list/b' || page_id ELSE 'https://cdn.example/c' END AS absolute, CASE k WHEN 0 THEN '.png' WHEN 1 THEN '.webp' ELSE '.jpg' END AS ext,
CASE WHEN k = 0 THEN 'https://i.example/front/' || page_id || ',https://i.example/200_280/' || page_id || ',https://i.example/100_140/' || page_id WHEN k = 1 THEN 'https://i.example/' || page_id ELSE '' END AS variants, regexp_replace(p, '[^A-Za-z0-9_.-]', '_', 'g') AS safe, 'SV' || page_id AS set_id, CASE WHEN k < 2 THEN 'sr' || page_id END AS rarity FROM t"""
)
def q61_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("page_id") % 4, F.col("page_id")
    link = cases(k, F.col("url"), _text("/a/", n), _text("b", n), "//cdn.example/c")
    picture = cases(k, _text("https://i.example/100_140/", n), _text("https://i.example/", n), " ")
    return table(spark, sf_dir, "pages").select(
        "page_id", X.absolute_url("https://shop.example/list/index.html", link).alias("absolute"), X.url_extension(cases(k, _text("https://x.example/", n, ".PNG?a=b"), _text("https://x.example/", n, ".webp"), "https://x.example/y.gif")).alias("ext"),
        F.array_join(X.image_variants(picture), ",").alias("variants"), X.safe_part(F.regexp_replace("url", r"[?#].*$", "")).alias("safe"),
        X.set_from_image_path(_text("/assets/card_images/large/SV", n, "/1.jpg")).alias("set_id"), X.rarity_from_path(F.when(k < 2, _text("/assets/rarity/ic_rare_sr", n, ".gif"))).alias("rarity"),
    )


@query(r"SELECT doc_id, md5(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]', '', 'g')) AS key FROM documents")
def q62_folded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.lookup_key("text")).alias("key"))


@query("SELECT event_id, (props::JSON->>'k') AS shallow, (props::JSON->>'k') AS deep, CASE WHEN event_id % 2 = 0 THEN 'e' || event_id END AS name FROM events")
def q63_json_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.unicode import json_find

    deep = _text('{"a": [1, {"B-b": ', F.col("props"), '}], "Cert No": "', F.when(F.col("event_id") % 2 == 0, _text("e", F.col("event_id"))).otherwise(""), '"}')
    name = json_find("deep", "certno", "cert")
    e = table(spark, sf_dir, "events").withColumn("deep", deep)
    return e.select("event_id", json_find("props", "K").alias("shallow"), json_find("deep", "k").alias("deep"), F.when(name != "", name).alias("name"))


# sources


@query(
    """SELECT p_partkey, 'sv' || p_size || '-' || p_partkey AS card_id, CASE WHEN p_partkey < 1000 THEN lpad(p_partkey::VARCHAR, 3, '0') ELSE p_partkey::VARCHAR END AS card_code, CASE WHEN p_partkey % 3 = 0 THEN 'sv' || p_size ELSE p_brand END AS set_id, p_name AS name_ja, NULL::VARCHAR AS name_en, CASE WHEN p_partkey % 2 = 0 THEN 'holo' END AS variant,
CASE WHEN p_partkey % 4 = 0 THEN '2024-03-01T12:00:00+00:00' ELSE 'day ' || p_partkey END AS updated_at, false AS is_sample FROM part"""
)
def q64_api_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.values import zero_fill

    key = F.col("p_partkey")
    api = table(spark, sf_dir, "part").select(
        _text("sv", F.col("p_size"), "-", key).alias("id"), zero_fill(key.cast("string"), 3).alias("localId"), F.col("p_name").alias("name"), F.col("p_type").alias("rarity"), F.lit(None).cast("string").alias("image"), F.when(key % 4 != 0, _text("day ", key)).alias("updated"),
        F.struct(F.when(key % 3 == 0, "").otherwise(F.col("p_brand")).alias("id")).alias("set"), F.create_map(F.lit("holo"), key % 2 == 0).alias("variants"),
    )
    c = adapters.api_cards(api, "ja", _now())
    return c.select(F.substring_index("card_id", "-", -1).cast("bigint").alias("p_partkey"), "card_id", "card_code", "set_id", "name_ja", "name_en", "variant", "updated_at", "is_sample")


@query(
    """SELECT p_partkey, 'OP' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '-alt' ELSE '' END AS card_id, 'OP' || p_partkey AS card_code, p_brand AS set_id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'alt' END AS variant, 'en' AS language, p_partkey % 5 = 0 AS is_sample, p_partkey % 5 = 0 AS is_watermarked, 'red' AS card_color FROM part"""
)
def q65_csv_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    sheet = table(spark, sf_dir, "part").select(_text("OP", key).alias(" Code"), F.when(key % 2 == 0, "alt").alias("art_variant"), F.col("p_name").alias("name"), _text("https://x.example/", F.when(key % 5 == 0, "sample/").otherwise(""), key).alias("image"), F.col("p_brand").alias("expansion"), F.col("p_type").alias("rarity"), F.lit("red").alias("Color"))
    c = adapters.csv_cards(sheet, _now())
    return c.select(F.regexp_extract("card_code", r"\d+", 0).cast("bigint").alias("p_partkey"), "card_id", "card_code", "set_id", "name", "variant", "language", "is_sample", "is_watermarked", "card_color")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'official_' || p_partkey ELSE 'sv' || p_size || '-' || p_partkey END AS card_id, p_name AS name_ja, 'pokemon_card_official_ja' || CASE WHEN p_partkey % 2 = 0 THEN '_image' ELSE '' END AS source, CASE WHEN p_partkey % 2 = 0 THEN '/img/' || p_partkey END AS local_image_path, CASE WHEN p_partkey % 4 = 0 THEN md5(p_partkey::VARCHAR) END AS image_sha256 FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'official_' || p_partkey ELSE 'sv' || p_size || '-' || p_partkey END, p_name, 'pokemon_card_official_ja', NULL, NULL FROM part"""
)
def q66_official_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail pages as catalog rows, and once more with their pictures where those were loaded."""
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    details = p.select(key.cast("string").alias("official_card_id"), F.col("p_name").alias("name_ja"), F.when(key % 3 != 0, _text("sv", F.col("p_size"))).alias("set_id"), key.cast("string").alias("card_code"), F.lit("R").alias("rarity"), _text("https://x.example/", key).alias("image_url"))
    cards = adapters.official_cards(details, _now())
    wanted = adapters.download_candidates(cards, "pokemon_card_official_ja", "ja")
    pictures = p.where(key % 2 == 0).select(_text("https://x.example/", key).alias("image_url"), _text("/img/", key).alias("path"), F.lit(200).alias("width"), F.lit(280).alias("height"), F.md5(key.cast("string")).alias("image_sha256"), (key % 4 == 0).alias("is_valid_image"))
    both = adapters.with_pictures(wanted, pictures).drop("is_valid_image").unionByName(cards)
    return both.select(F.col("official_card_id").cast("bigint").alias("p_partkey"), "card_id", "name_ja", "source", "local_image_path", "image_sha256")


@query(
    """WITH t AS (SELECT p_partkey, p_partkey % 3 <> 0 AS sold, p_partkey % 10 = 0 AND p_partkey % 3 <> 0 AS hidden FROM part)
SELECT p_partkey, CASE WHEN hidden THEN 'suppressed_suspicious_mapping' ELSE 'matched' END AS match_status, CASE WHEN sold AND NOT hidden THEN 'P' || p_partkey END AS product_id, sold AND NOT hidden AS has_product_id, hidden AS mapping_suppressed, CASE WHEN hidden THEN 'P' || p_partkey END AS suppressed_product_id, CASE WHEN hidden THEN 'last' END AS mapping_status FROM t"""
)
def q67_suppressed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits whose product stands on the flag table lose it; of several flags of a product the last row counts."""
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    product = F.when(key % 3 != 0, _text("P", key))
    hits = p.select("p_partkey", F.lit("matched").alias("market_match_status"), product.alias("market_product_id"), F.col("p_name").alias("market_product_name"), F.lit("/x").alias("market_url"), F.col("p_retailprice").alias("market_min_price"))
    flags = p.where(key % 10 == 0).select(_text("P", key).alias("product_id"), F.explode(F.array(F.struct(F.lit(1).alias("ordinal"), F.lit("first").alias("severity")), F.struct(F.lit(2).alias("ordinal"), F.lit("last").alias("severity")))).alias("f")).select("product_id", "f.*")
    out = adapters.suppressed_hit(hits, readers.read_flags(flags))
    return out.select("p_partkey", *[F.col(f"market.{c}").alias(c) for c in ("match_status", "product_id", "has_product_id", "mapping_suppressed", "suppressed_product_id", "mapping_status")])


@query(
    """SELECT p_size AS keyword, p_partkey::VARCHAR AS product_id, p_name AS product_name, CASE WHEN p_partkey % 3 = 0 THEN 'i' || p_partkey ELSE '' END AS thumbnail_url, p_retailprice AS min_price, p_partkey % 9 AS listing_count FROM part WHERE p_partkey % 7 <> 0 AND p_size % 5 <> 0"""
)
def q68_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products read from the JSON text of result pages: two item arrays, marked cards only, pages without success left out."""
    key = F.col("p_partkey")
    item = F.struct(key.cast("string").alias("id"), F.col("p_name").alias("name"), F.when(key % 3 == 0, _text("i", key)).alias("imageUrl"), F.col("p_retailprice").alias("minPrice"), (key % 9).alias("listingCount"), F.when(key % 7 == 0, False).when(key % 2 == 0, True).alias("isTradingCard"))
    pages = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("keyword")).agg(F.to_json(F.struct(F.collect_list(F.when(key % 2 == 0, item)).alias("streetwears"), F.collect_list(F.when(key % 2 == 1, item)).alias("products"), F.count("*").alias("streetwearCount"))).alias("data"))
    pages = pages.withColumn("status_code", F.when(F.col("keyword") % 5 == 0, 500).otherwise(200)).withColumn("page", F.lit(1))
    return matching.products_of(pages, ["keyword"], ["page"]).select("keyword", "product_id", "product_name", "thumbnail_url", "min_price", "listing_count")


@query(
    """SELECT p_size AS keyword, 1::BIGINT AS pages_seen, p_size % 2 AS cache_hits, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS errors, CASE WHEN p_size % 5 <> 0 THEN count(*) END AS total_count, CASE WHEN p_size % 5 <> 0 THEN count(*) ELSE 0 END AS rows FROM part GROUP BY p_size"""
)
def q69_search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    pages = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("keyword")).agg(F.to_json(F.struct(F.collect_list(item).alias("products"), F.count("*").alias("productCount"))).alias("data"))
    pages = pages.select("keyword", "data", F.lit(1).alias("page"), (F.col("keyword") % 2 == 1).alias("from_cache"), F.when(F.col("keyword") % 5 == 0, 500).otherwise(200).alias("status_code"))
    t = matching.page_totals(pages, ["keyword"], ["page"])
    return t.select("keyword", *[F.col(c).cast("bigint").alias(c) for c in ("pages_seen", "cache_hits", "errors", "total_count", "rows")])


@query(
    """SELECT user_id, event_id, event_type AS condition, value AS price, CASE WHEN event_id % 2 = 0 THEN 'US $' || event_id END AS price_format, CASE WHEN event_id % 3 = 0 THEN 'USD' ELSE 'JPY' END AS currency FROM events WHERE user_id % 9 <> 0"""
)
def q70_trade_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades read from history payloads, one per user, under either array's name; payloads with an error give none."""
    k = F.col("event_id")
    trade = F.struct(F.col("event_type").alias("condition"), F.col("value").alias("price"), F.lit("").alias("priceFormat"), F.when(k % 2 == 0, _text("US $", k)).alias("price_format"), F.lit(None).cast("string").alias("formattedPrice"), F.lit(None).cast("string").alias("formatted_price"), F.when(k % 3 == 0, "USD").otherwise("").alias("currency"), F.lit("JPY").alias("priceCurrency"), k.cast("string").alias("tradedAt"))
    g = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("product_id")).agg(F.collect_list(trade).alias("all"))
    even = F.col("product_id") % 2 == 0
    payloads = g.select("product_id", F.when(even, F.col("all")).alias("histories"), F.when(~even, F.col("all")).alias("data"), F.when(F.col("product_id") % 9 == 0, "http_error").alias("error"))
    return readers.trades_of(payloads).select(F.col("product_id").alias("user_id"), F.col("traded_at").cast("bigint").alias("event_id"), "condition", "price", "price_format", "currency")


@query(
    """WITH a AS (SELECT 'SV' || n_nationkey AS set_id, n_name, replace(n_name, '_', '') AS k FROM nation WHERE n_nationkey % 5 <> 0),
t AS (SELECT s_suppkey, 'FROM' || replace(n_name, '_', '') || 'X' AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey),
j AS (SELECT s_suppkey, set_id, n_name, k, row_number() OVER (PARTITION BY s_suppkey ORDER BY length(k) DESC, k DESC) AS r FROM t JOIN a ON contains(x, k))
SELECT s_suppkey, set_id, n_name AS alias, k AS alias_key FROM j WHERE r = 1"""
)
def q71_alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    aliases = lookup.alias_table(n.select(F.col("n_name").alias("alias"), _text("SV", F.col("n_nationkey")).alias("set_id"), F.lit("").alias("source"), F.lit(None).cast("string").alias("confidence"), F.when(F.col("n_nationkey") % 5 == 0, " No ").otherwise("yes").alias("enabled")))
    t = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("label", _text("from ", F.lower("n_name"), ", x"))
    return lookup.match_alias(t, aliases, "s_suppkey", "label").select("s_suppkey", "set_id", "alias", "alias_key")


@query(
    """WITH c AS (SELECT DISTINCT p_size, p_name FROM part), m AS (SELECT p_size, p_name, min(lpad(p_partkey::VARCHAR, 9, '0')) AS i FROM part GROUP BY ALL)
SELECT 'OP' || p_size AS card_code, row_number() OVER (PARTITION BY p_size ORDER BY i, p_name) AS keyword_rank, p_name || ' [OP' || p_size || ']' AS keyword, 'name_code_fallback' AS kind FROM m UNION ALL SELECT DISTINCT 'OP' || p_size, 0, 'OP' || p_size, 'card_code' FROM part"""
)
def q72_search_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cards = p.select(_text("OP", F.col("p_size")).alias("card_code"), _pad("p_partkey", 9).alias("card_id"), _text(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, " (Parallel)").otherwise("")).alias("name"), F.lit(None).cast("string").alias("name_en"))
    return matching.search_keywords(cards).select("card_code", F.col("keyword_rank").cast("bigint").alias("keyword_rank"), "keyword", "kind")
