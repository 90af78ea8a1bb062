"""Queries of the record, picture, geometry, rerank and recognition operators over whole driver tables, with their SQL.

The main table of a query is read whole; where an operator joins it with a second table made from it (prices, pictures, a later manifest),
that one lacks some of the keys, so that both outcomes occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import canonical, geometry, market, matching, quality, records, rerank, vectors
from . import catalog_queries as C
from .catalog_queries import query, table

_ORDER = "l_orderkey, l_linenumber, l_shipdate, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


def _desc(columns: str) -> str:
    return ", ".join(f"{c} DESC" for c in columns.split(", "))


# records


@query(
    f"""WITH m AS (SELECT l_partkey, l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY {_desc(_ORDER)}) AS k FROM lineitem),
p AS (SELECT p_partkey, p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AS fits FROM part)
SELECT p_partkey, CASE WHEN l_partkey IS NOT NULL THEN l_returnflag ELSE 'old' END AS status, CASE WHEN l_partkey IS NOT NULL THEN l_extendedprice END AS price FROM p LEFT JOIN m ON fits AND p_partkey = l_partkey AND k = 1"""
)
def q73_price_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of the last map row of each card, for one game and language only."""
    key, none = F.col("p_partkey"), F.lit(None).cast("string")
    cards = records.coerce(table(spark, sf_dir, "part").select(F.when(key % 3 == 0, "onepiece").otherwise("pokemon").alias("game"), F.when(key % 4 == 0, "en").otherwise("ja").alias("language"), key.cast("string").alias("card_id"), F.lit("old").alias("market_match_status")))
    line = table(spark, sf_dir, "lineitem")
    prices = line.select(F.col("l_partkey").cast("string").alias("card_id"), F.col("l_returnflag").alias("match_status"), none.alias("product_id"), none.alias("product_name"), none.alias("url"), F.col("l_extendedprice").alias("min_price"), none.alias("min_price_format"), F.lit(1).alias("candidate_count"), none.alias("matched_at"), F.struct(*_ORDER.split(", ")).alias("ordinal"))
    out = records.enrich_prices(cards, prices)
    return out.select(F.col("card_id").cast("bigint").alias("p_partkey"), F.col("market_match_status").alias("status"), F.col("market_min_price").alias("price"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_brand WHEN p_partkey % 5 <> 0 THEN 'new' END AS set_id, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 5 <> 0 THEN 'repaired' ELSE 'kept' END AS name FROM part"""
)
def q74_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a set are fetched anew and replaced whole; those of another source stay as they are."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(key.cast("string").alias("official_card_id"), F.when(key % 5 == 0, "other").otherwise("official").alias("source"), F.when(key % 7 != 0, F.col("p_brand")).alias("set_id"), F.lit("1").alias("card_code"), F.lit("kept").alias("name"), F.lit("").alias("name_ja"), F.lit("u").alias("image_url"))
    wanted = records.repair_rows(records.for_repair(rows, "official"))
    fetched = wanted.select(F.col("id").alias("official_card_id"), F.lit("official").alias("source"), F.lit("new").alias("set_id"), F.lit("1").alias("card_code"), F.lit("repaired").alias("name"), F.col("view_name").alias("name_ja"), F.col("thumb").alias("image_url"))
    return records.repair(rows, fetched).select(F.col("official_card_id").cast("bigint").alias("p_partkey"), "set_id", "name")


@query("SELECT o_orderkey, count(l_orderkey) AS lines, CASE WHEN count(l_orderkey) = 0 THEN 'missing_detail' END AS error FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def q75_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    return records.attach_details(table(spark, sf_dir, "orders").select("o_orderkey"), details, "o_orderkey", "o_orderkey").withColumn("lines", F.coalesce("lines", F.lit(0)))


@query(
    """WITH r AS (SELECT 0 AS input, p_partkey AS k, p_brand AS b, p_size AS n, p_partkey % 4 = 0 AS pic FROM part UNION ALL SELECT 1, p_partkey, p_brand, p_size, p_partkey % 4 = 0 FROM part WHERE p_partkey % 2 = 0),
x AS (SELECT *, row_number() OVER (PARTITION BY pic, CASE WHEN pic THEN k::VARCHAR ELSE b || '-' || n END ORDER BY input, k) AS c FROM r)
SELECT input, k AS p_partkey, c = 1 AS kept FROM x"""
)
def q76_catalog_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two manifests as one catalog: the identity is the picture's path where there is one, else the card's fields; later rows are duplicates."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.lit("pokemon").alias("game"), F.lit("s").alias("source"), F.lit("ja").alias("language"), F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("card_id"), F.lit("1").alias("card_code"), F.when(key % 4 == 0, key.cast("string")).alias("local_image_path"), key.alias("ordinal"), key.cast("string").alias("source_license"))
    kept, rest = records.build_catalog(rows.withColumn("name", F.lit("0")), rows.where(key_even("ordinal")).withColumn("name", F.lit("1")))
    out = kept.select("name", "source_license", F.lit(True).alias("kept")).union(rest.select("record.name", "record.source_license", F.lit(False)))
    return out.select(F.col("name").cast("int").alias("input"), F.col("source_license").cast("bigint").alias("p_partkey"), "kept")


def key_even(c: str) -> Column:
    return F.col(c) % 2 == 0


@query(
    """WITH n AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(c, 0) AS parsed, (o_orderkey % 6)::INT AS expected, coalesce(c, 0) = o_orderkey % 6 AS count_matches FROM orders LEFT JOIN n ON o_orderkey = l_orderkey"""
)
def q77_series_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return records.parity(line, table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).cast("int").alias("expected")), "o_orderkey")


@query("SELECT count(DISTINCT p_brand) AS p_brand, count(DISTINCT p_size) AS p_size, count(DISTINCT p_name) AS p_name FROM part")
def q78_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.distinct_counts(table(spark, sf_dir, "part"), "p_brand", "p_size", "p_name")


@query("SELECT p_brand, p_size, min(p_partkey) AS p_partkey, count(*) - 1 AS skipped FROM part GROUP BY 1, 2")
def q79_first_with_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.first_with_count(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey"), ["p_brand", "p_size"], "p_partkey")


@query(
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/data/b/' || page_id WHEN 1 THEN '/data/a/' || page_id ELSE '/else/' || page_id END AS moved, CASE page_id % 3 WHEN 0 THEN '/img/b/' || page_id WHEN 1 THEN '/img/a/' || page_id END AS url FROM pages"""
)
def q80_mounted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "/old/b/").when(F.col("page_id") % 3 == 1, "/old/a/").otherwise("/else/"), n)
    p = table(spark, sf_dir, "pages").select("page_id", records.rewrite_paths(path, [("/old", "/data")]).alias("moved"))
    return p.select("page_id", "moved", records.mounted_url("moved", [("/data/", "/img/")]).alias("url"))


# marketplace, report rows


@query(
    """WITH t AS (SELECT event_id, value, ts FROM events) SELECT event_id, strftime(ts, '%Y/%m/%d') AS date, 'PSA 10' AS grade, round_even(value * 150.0, 0)::BIGINT AS price, 'market' AS source FROM t"""
)
def q81_poster_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("traded_at"), F.lit(None).cast("string").alias("price_format"), F.col("value").cast("string").alias("price"), F.lit("USD").alias("currency"))
    t = market.price_trades(e, 150.0)
    # the id goes along in the price's place of order
    rows = market.poster_records(t.withColumn("jpy", F.struct("event_id", "jpy")), "PSA 10", F.lit("2024-03-01").cast("timestamp"))
    return rows.select(F.col("price.event_id").alias("event_id"), "date", "grade", F.col("price.jpy").alias("price"), "source")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 2 = 0 THEN 'N' || c_custkey ELSE 'Unknown Card' END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'N' || c_custkey WHEN c_custkey % 3 = 0 THEN c_name ELSE 'Unknown Card' END AS local_name, c_custkey::VARCHAR AS number, 'Unknown' AS set_code, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'TCG' END AS category FROM customer"""
)
def q82_card_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    hits = table(spark, sf_dir, "customer").select(k.alias("query_id"), F.when(k % 3 == 0, F.col("c_name")).alias("name"), F.lit("").alias("name_en"), F.when(k % 2 == 0, F.concat(F.lit("N"), k.cast("string"))).alias("name_ja"), k.cast("string").alias("card_code"), F.lit("").alias("set_id"), F.lit("").alias("rarity"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("variant"), F.lit("ja").alias("language"), F.lit(None).cast("string").alias("image_url"))
    return market.card_data(hits).select(F.col("query_id").alias("c_custkey"), "name", "local_name", "number", "set_code", "category")


_GATES = C.SQL["q21_reject_reasons"]


@query(
    f"""WITH g AS ({_GATES}), b AS (SELECT * FROM g WHERE match_status = 'no_verified_match')
SELECT 'status' AS kind, match_status AS value, count(*) AS n FROM g GROUP BY 2
UNION ALL SELECT 'variant_kind', 'regular', count(*) FROM g
UNION ALL SELECT 'reject_group', k, sum(c) FROM (SELECT unnest(['name_mismatch', 'rarity_mismatch', 'regular_variant_mismatch']) AS k, unnest([bad_name, bad_rarity, bad_variant]) AS c FROM b) WHERE c > 0 GROUP BY 2"""
)
def q83_match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the strict matching's run, but for its single reasons, which hold rarities."""
    p = table(spark, sf_dir, "part")
    code, none = F.concat_ws("-", "p_brand", F.col("p_size").cast("string")), F.lit(None).cast("string")
    cards = p.select(F.col("p_partkey").cast("string").alias("card_id"), F.col("p_brand").alias("set_id"), code.alias("card_code"), F.lit("ja").alias("language"), F.col("p_name").alias("name"), none.alias("name_en"), F.expr(C._RARITY).alias("rarity"), none.alias("image_url"), F.col("p_partkey").alias("ordinal"))
    title = F.concat("p_name", F.lit(" "), F.expr(C._SHORT), F.when(F.col("p_partkey") % 11 == 0, "-P").otherwise(""), F.lit(" ["), code, F.lit("]"))
    products = p.select(code.alias("card_code"), F.col("p_partkey").cast("string").alias("product_id"), title.alias("product_name"), none.alias("thumbnail_url"), F.lit(None).cast("double").alias("min_price"), none.alias("min_price_format"))
    return matching.summarize(matching.match_by_gates(cards, products)).where("kind in ('status', 'variant_kind', 'reject_group')")


@query(
    """SELECT p_partkey, p_partkey % 2 = 0 OR p_partkey % 3 = 0 AS ok, CASE WHEN p_partkey % 2 = 0 THEN 'title_language_en' WHEN p_partkey % 3 = 0 THEN 'thumbnail_language_en' ELSE 'missing_en_marker' END AS reason FROM part"""
)
def q84_language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English cards, each with one product that is right but for its language mark."""
    key, none = F.col("p_partkey"), F.lit(None).cast("string")
    p = table(spark, sf_dir, "part")
    code = F.concat(F.lit("OP01-"), key.cast("string"))
    cards = p.select(key.cast("string").alias("card_id"), F.lit("OP01").alias("set_id"), code.alias("card_code"), F.lit("EN").alias("language"), F.col("p_name").alias("name"), none.alias("name_en"), F.lit("Rare").alias("rarity"), none.alias("image_url"), key.alias("ordinal"))
    products = p.select(code.alias("card_code"), key.cast("string").alias("product_id"), F.concat("p_name", F.lit(" R ["), code, F.lit("]"), F.when(key % 2 == 0, "[EN]").otherwise("")).alias("product_name"), F.when(key % 3 == 0, "https://x.example/OPC-EN-TCG/a.png").alias("thumbnail_url"), F.lit(None).cast("double").alias("min_price"), none.alias("min_price_format"))
    j = matching.judge_candidates(cards, products)
    return j.select(F.col("card_id").cast("bigint").alias("p_partkey"), "ok", F.get("_reasons", F.when(F.col("ok"), 1).otherwise(0)).alias("reason"))


@query(
    """SELECT l_orderkey, arg_min(l_extendedprice, k) AS price FROM (SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY (CASE l_returnflag WHEN 'A' THEN 4 WHEN 'R' THEN 3 ELSE 0 END) DESC, l_quantity DESC, l_extendedprice) AS k FROM lineitem) GROUP BY 1"""
)
def q85_best_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per photo the reading of best quality, then of most confidence, then the first."""
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "A", "strict").when(F.col("l_returnflag") == "R", "swsh_promo").otherwise("trailing_set").alias("quality"), F.col("l_quantity").alias("confidence"), F.col("l_extendedprice").alias("price"))
    return rerank.best_attempt(a, "l_orderkey", X.code_rank("quality"), "price").select("l_orderkey", "price")


# pictures, geometry


@query(
    """WITH t AS (SELECT p_partkey AS k, 150 + p_partkey % 200 AS w, 250 + p_partkey % 300 AS h, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS v, p_partkey % 5 = 0 AS s, p_partkey % 6 <> 0 AS d FROM part)
SELECT k AS p_partkey, coalesce(v, false) AND NOT s AND d AND w >= 200 AND h >= 280 AS clean, v IS DISTINCT FROM false AND NOT s AND d AND w >= 200 AND h >= 280 AS eligible, NOT coalesce(v, false) OR w < 200 OR h < 280 AS small FROM t"""
)
def q86_clean_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select("p_partkey", (150 + k % 200).alias("width"), (250 + k % 300).alias("height"), F.when(k % 4 == 1, False).when(k % 4 > 1, True).alias("is_valid_image"), (k % 5 == 0).alias("is_sample"), F.lit(None).cast("boolean").alias("is_watermarked"), F.when(k % 6 != 0, "/p").alias("local_image_path"), F.lit("h").alias("image_sha256"))
    return t.select("p_partkey", quality.clean().alias("clean"), quality.index_eligible().alias("eligible"), quality.too_small().alias("small"))


@query(
    """SELECT page_id, page_id % 3 = 0 AS is_sample, page_id % 3 IN (0, 1) AS is_watermarked FROM pages WHERE page_id % 3 < 2"""
)
def q87_flagged_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://x.example/"), F.when(k % 3 == 0, "sample/").when(k % 3 == 1, "watermark/").otherwise("plain/"), k.cast("string")).alias("image_url"))
    return quality.flagged_urls(p).select("page_id", "is_sample", "is_watermarked")


@query(
    """WITH b AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, q, q || ',' || l_linenumber::DOUBLE AS first, (q + 10) || ',' || (l_linenumber + 20)::DOUBLE AS third, round(greatest(0, q + 5 - 5 * (sqrt(125) + 4) / sqrt(125)), 6) AS grown_left, round(least(99, l_linenumber + 10 + 10 * (sqrt(125) + 4) / sqrt(125)), 6) AS grown_bottom FROM b"""
)
def q88_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled corners of boxes put in order, and the boxes grown by four within a picture of 200 by 100."""
    x, y = F.col("q"), F.col("l_linenumber").cast("double")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q")).distinct()
    mixed = F.array(F.array(x + 10, y + 20), F.array(x, y), F.array(x, y + 20), F.array(x + 10, y))
    o = geometry.order_corners(mixed)
    g = geometry.expand_polygon(geometry.box_polygon(x, y, x + 10, y + 20), 4.0, F.lit(200), F.lit(100))
    text = lambda p: F.concat_ws(",", p[0].cast("string"), p[1].cast("string"))
    li, o, g = li.withColumns({"_o": o, "_g": g}), F.col("_o"), F.col("_g")  # each is used more than once
    return li.select("l_orderkey", "l_linenumber", "q", text(o[0]).alias("first"), text(o[2]).alias("third"), F.round(g[0][0], 6).alias("grown_left"), F.round(g[2][1], 6).alias("grown_bottom"))


@query(
    """WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity / 50 AS c FROM lineitem)
SELECT l_orderkey, confidence_rank, ordinal FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, l_extendedprice) AS confidence_rank, l_extendedprice AS ordinal FROM d WHERE c >= 0.2) WHERE confidence_rank <= 3"""
)
def q89_confident_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("photo_id"), F.col("l_extendedprice").alias("ordinal"), (F.col("l_quantity") / 50).alias("confidence"))
    results = d.groupBy("photo_id").agg(F.collect_list(F.struct("confidence", F.col("ordinal").alias("place"))).alias("detections"))
    flat = geometry.explode_detections(results).drop("ordinal").withColumnRenamed("place", "ordinal")
    return geometry.most_confident(flat, 3, 0.2).select(F.col("photo_id").alias("l_orderkey"), F.col("confidence_rank").cast("bigint").alias("confidence_rank"), "ordinal")


@query(
    """WITH e AS (SELECT vec_id, unnest(embedding) > 0 AS b, generate_subscripts(embedding, 1) AS i FROM embeddings),
g AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id, b ORDER BY i) AS r FROM e), x AS (SELECT vec_id, r, count(*) AS n FROM g WHERE b GROUP BY 1, 2)
SELECT v.vec_id, coalesce(round(max(n) / 64.0, 6), 0)::DOUBLE AS longest, count(n) AS runs FROM embeddings v LEFT JOIN x USING (vec_id) GROUP BY 1"""
)
def q90_flag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.transform("embedding", lambda x: x > 0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(geometry.longest_run(flags), 6).alias("longest"), F.size(geometry.true_runs(flags)).cast("bigint").alias("runs"))


# vectors, recognition

_BLEND = "round(list_dot_product(a.embedding[{0}:{1}]::DOUBLE[], b.embedding[{0}:{1}]::DOUBLE[]), 9)"


@query("SELECT vec_id, round(list_aggregate(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), 'sum') / list_aggregate(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), 'sum'), 6) AS length, round(embedding[1]::DOUBLE / sqrt(list_aggregate(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), 'sum')), 6) AS head FROM embeddings")
def q91_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").select("vec_id", vectors.normalize("embedding").alias("n"))
    return n.select("vec_id", F.round(vectors.dot("n", "n"), 6).alias("length"), F.round(F.col("n")[0], 6).alias("head"))


@query(
    f"""WITH {C._HITS},
v AS (SELECT h.*, {_BLEND.format(1, 8)} AS hsv, {_BLEND.format(9, 16)} AS rgb, {_BLEND.format(17, 24)} AS reg, {_BLEND.format(25, 32)} AS gray, {_BLEND.format(33, 40)} AS edge FROM h JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = row_id),
c AS (SELECT *, CASE WHEN row_id % 4 > 0 THEN 0.5 * (0.45 * hsv + 0.25 * rgb + 0.25 * reg + 0.05 * greatest(0, 1 - abs(query_id % 50 - row_id % 50) / 100.0)) + 0.5 * (0.45 * gray + 0.30 * edge + 0.25 * (1 - bit_count(xor(query_id, row_id)) / 64.0)) END AS visual FROM v),
b AS (SELECT query_id, row_id, rank AS old, visual IS NOT NULL AS applied, round(CASE WHEN visual IS NULL THEN score ELSE 0.7 * score + 0.3 * visual END, 6) AS score FROM c)
SELECT query_id, row_id, applied, score FROM b"""
)
def q92_visual_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven similarities of two signatures blended into the score of hits that have one."""
    def signature(id_: str) -> DataFrame:
        part = lambda a: F.slice("embedding", a, 8)
        k = F.col("vec_id")
        s = F.struct(part(1).alias("hsv"), part(9).alias("rgb"), F.array(part(17)).alias("regions"), part(25).alias("gray"), part(33).alias("edge"), k.alias("dhash"), (k % 50).cast("double").alias("colorfulness"))
        return table(spark, sf_dir, "embeddings").select(k.alias(id_), s.alias(f"_{id_}"))

    h = C._hits(spark, sf_dir).join(signature("query_id"), "query_id").join(signature("row_id"), "row_id")
    visual = F.when(F.col("row_id") % 4 > 0, rerank.visual_similarity(F.col("_query_id"), F.col("_row_id"))["visual"])
    return rerank.visual_blend(h, visual, 0.3).select("query_id", "row_id", F.col("visual_applied").alias("applied"), F.round("score", 6).alias("score"))


@query(
    f"""WITH s AS ({C._PAIRS}),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id, index_name ORDER BY score DESC, row_id) AS index_rank FROM s),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, index_name, index_rank, row_id) AS rank FROM i WHERE index_rank <= 25),
b1 AS (SELECT *, score + CASE WHEN row_id % 7 = query_id % 7 AND index_name % 2 = 0 THEN 0.1 ELSE 0 END AS s1 FROM m WHERE rank <= 25),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, rank) AS k1 FROM b1),
f AS (SELECT *, first_value(index_name % 2) OVER (PARTITION BY query_id ORDER BY k1) AS top FROM r1),
b2 AS (SELECT *, s1 + CASE WHEN top = 0 AND index_name % 2 = 0 AND row_id % 2 = query_id % 2 THEN 0.08 ELSE 0 END AS s2 FROM f),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, k1) AS k2 FROM b2),
x AS (SELECT r2.*, {C._SECOND} AS z FROM r2 JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = row_id),
n AS (SELECT *, CASE WHEN max(z) OVER w - min(z) OVER w > 1e-9 THEN (z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w) ELSE 0 END AS norm FROM x WINDOW w AS (PARTITION BY query_id)),
r3 AS (SELECT *, 0.6 * s2 + 0.4 * norm AS s3, row_number() OVER (PARTITION BY query_id ORDER BY 0.6 * s2 + 0.4 * norm DESC, k2) AS k3 FROM n),
b4 AS (SELECT *, s3 + CASE WHEN row_id % 5 = query_id % 5 AND index_name % 2 = 0 THEN 0.12 ELSE 0 END AS s4 FROM r3),
r4 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s4 DESC, k3) AS k4 FROM b4)
SELECT query_id, row_id, round(s4, 6) AS score, k4 AS rank FROM r4 WHERE k4 <= 5"""
)
def q93_recognize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole photo query: merged search, code of a hint, language, second model, read code, cut."""
    e = table(spark, sf_dir, "embeddings")
    code = lambda c, n: F.concat(F.lit("A"), F.lpad((F.col(c) % n + 10).cast("string"), 3, "0"))
    language = lambda c: F.when(F.col(c) % 2 == 0, "ja").otherwise("en")
    cards = e.select(F.col("label").alias("index_name"), F.col("vec_id").alias("row_id"), "embedding", F.lit("SV2a").alias("set_id"), code("vec_id", 35).alias("card_code"), language("vec_id").alias("language"), F.when(F.col("label") % 2 == 0, "pokemon").otherwise("onepiece").alias("game"))
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), language("vec_id").alias("hint_language"))
    tail = F.slice("embedding", 33, 32)
    second = lambda hits: hits.join(e.select(F.col("vec_id").alias("query_id"), tail.alias("_a")), "query_id").join(e.select(F.col("vec_id").alias("row_id"), tail.alias("_b")), "row_id").withColumn("second", F.round(vectors.dot("_a", "_b"), 6)).drop("_a", "_b")
    hinted = lambda h: F.col("row_id") % 7 == F.col("query_id") % 7
    read = lambda h: F.col("row_id") % 5 == F.col("query_id") % 5
    out = rerank.recognize(cards, q, language=True, hint=hinted, second=second, ocr=read)
    return out.select("query_id", "row_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("SELECT count(DISTINCT label) AS indexes, count(*) AS rows, 64 AS dimensions FROM embeddings")
def q94_one_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "index_name")
    return vectors.one_model(e).select("indexes", "rows", "dimensions")


@query(
    """WITH c AS (SELECT p_partkey, p_partkey % 2 = 0 AS a, p_partkey % 3 = 0 AS b FROM part)
SELECT p_partkey, CASE WHEN a THEN 'own' WHEN b THEN 'primary' END AS status FROM c"""
)
def q95_price_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by a canonical card's id, else by that of its best row."""
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    cards = records.coerce(p.select(F.concat(F.lit("c"), key.cast("string")).alias("card_id"), key.cast("string").alias("primary_card_id")), extras=True)
    marks = p.where(key % 2 == 0).select(F.concat(F.lit("c"), key.cast("string")).alias("card_id"), F.lit("own").alias("market_match_status")).union(p.where(key % 3 == 0).select(key.cast("string"), F.lit("primary")))
    out = canonical.price_fallback(cards, records.coerce(marks))
    return out.select(F.col("primary_card_id").cast("bigint").alias("p_partkey"), F.col("market_match_status").alias("status"))
