import json
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.functions import text as X
from lotwise.operators import canonical, geometry, lookup, market, matching, quality, records, rerank, vectors


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


# records


def test_first_wins_and_duplicates(spark):
    a = spark.createDataFrame([("pokemon", "s", "/p/1", "x", "5", 0), ("pokemon", "s", "/p/1", "y", "6.5", 1), ("pokemon", "s", None, "z", None, 2)], "game string, source string, local_image_path string, card_id string, width string, ordinal int")
    b = spark.createDataFrame([("pokemon", "s", None, "z", "false", 0)], "game string, source string, local_image_path string, card_id string, is_sample string, ordinal int")
    kept, dup = records.build_catalog(a, b)
    assert rows(kept, "card_id", "width", "is_sample") == [("x", 5, False), ("z", None, False)]
    assert [(r.input, r.record.card_id, r.record.is_sample) for r in dup.orderBy("input").collect()] == [(0, "y", False), (1, "z", True)]
    assert kept.columns == records.UNIFIED and kept.count() + dup.count() == 4
    again, none = records.build_catalog(kept.withColumn("ordinal", F.lit(0)))
    assert again.count() == kept.count() and none.count() == 0


def test_last_wins_enrichment(spark):
    cat = records.coerce(spark.createDataFrame([("pokemon", "ja", "a"), ("pokemon", "en", "a"), ("pokemon", "ja", "b"), ("pokemon", "ja", None)], "game string, language string, card_id string"))
    m = spark.createDataFrame([("a", "matched", "1", 0), ("a", "multiple", None, 1), ("", "x", "2", 2)], "card_id string, match_status string, product_id string, ordinal int")
    m = m.selectExpr("*", "'n' product_name", "'u' url", "1.0 min_price", "'f' min_price_format", "2 candidate_count", "'t' matched_at")
    out = records.enrich_prices(cat, m)
    assert rows(out, "language", "card_id", "market_match_status", "market_product_id") == sorted([("ja", "a", "multiple", None), ("en", "a", None, None), ("ja", "b", None, None), ("ja", None, None, None)], key=str)
    assert rows(records.keep_last(m.where("card_id <> ''").select("card_id", "ordinal"), "card_id", "ordinal"), "replaced") == [(1,)]


def test_counts_modes_repair_and_diff(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "x", 3)], "c string, d string, o int")
    assert rows(records.counts(df, "c", "d")) == sorted([("c", "a", 2), ("c", "b", 1), ("d", "x", 2), ("d", None, 1)], key=str)
    assert rows(records.missing_counts(df, "c", "d")) == [(3, 0, 1, 1)]
    m = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "a", 3), ("k", "b", 4), ("k", None, 0)], "k string, v string, o int")
    assert rows(records.mode_first_seen(m, "k", "v", "o")) == [("k", "b", 2)]
    old = spark.createDataFrame([("1", "p"), ("2", "p"), ("3", None)], "official_card_id string, set_id string")
    new = spark.createDataFrame([("2", "q")], "official_card_id string, set_id string")
    assert rows(records.repair(old, new)) == sorted([("1", "p"), ("2", "q"), ("3", None)], key=str)
    assert rows(records.for_repair(old.withColumn("source", F.lit("s")).withColumn("card_code", F.lit(None).cast("string")), "s"), "official_card_id") == [("3",)]
    assert rows(records.diff(old, new, "official_card_id", "set_id")) == [("1", "remove"), ("2", "replace"), ("3", "remove")]
    e = spark.createDataFrame([("a", 2), ("b", 5), ("z", 0)], "c string, expected int")
    assert rows(records.parity(df, e, "c")) == [("a", 2, 2, True), ("b", 1, 5, False), ("z", 0, 0, True)]


def test_paths(spark):
    df = spark.createDataFrame([("/old/a",), ("/x",)], "p string")
    assert rows(df.select(records.rewrite_paths("p", [("/old", "/new")]))) == [("/new/a",), ("/x",)]
    assert rows(df.select(records.mounted_url("p", [("/old", "/img")]))) == [("/img/a",), (None,)]


# quality and canonical


def test_clean_and_reasons(spark):
    df = spark.createDataFrame([("p", "h", 200, 280, True, None, None), ("p", "h", 199, 280, True, False, False), (None, "h", 300, 300, True, True, True), ("p", "h", 300, 300, None, False, False), ("p", "h", 300, 300, True, True, True)], "local_image_path string, image_sha256 string, width int, height int, is_valid_image boolean, is_sample boolean, is_watermarked boolean")
    assert [r[0] for r in df.select(quality.clean()).collect()] == [True, False, False, False, False]
    assert [r[0] for r in df.select(quality.index_eligible()).collect()] == [True, False, False, True, False]
    good, bad = quality.split_eligible(df)
    assert good.count() == 3 and rows(bad) == [("missing_local_image_path", 1), ("sample", 1)]
    assert [r[0] for r in df.select(quality.too_small()).collect()] == [False, True, False, True, False]


def test_collapse(spark):
    data = [
        ("pokemon_card_official_ja", "o1", "S1", "001", "N", None, None, None, None, 0, "7"),
        ("tcgdex", "t1", "S1", "001", "N", "R", None, None, None, 1, None),
        ("tcgdex_image", "i1", "S1", "001", None, None, "/p", "h", 300, 2, None),
        ("tcgdex", "t2", None, "001", "M", None, None, None, None, 3, None),
        ("pokemon_card_official_ja", "o2", None, None, "M", None, None, None, None, 4, "9"),
    ]
    df = spark.createDataFrame(data, "source string, card_id string, set_id string, card_code string, name string, rarity string, local_image_path string, image_sha256 string, width int, ordinal int, official_card_id string").withColumn("height", F.col("width"))
    c = {r.canonical_key: r for r in canonical.collapse(df).collect()}
    assert set(c) == {"S1-001", "tcgdex:t2", "official:9"}
    a = c["S1-001"]
    assert (a.canonical_source, a.image_source, a.card_id, a.rarity, a.local_image_path, a.source_record_count) == ("pokemon_card_official_ja", "tcgdex_image", "S1-001", None, "/p", 3)
    assert [d.card_id for d in a.duplicate_sources] == ["t1"] and a.duplicate_source_count == 1 and a.has_index_image
    assert sum(r.source_record_count for r in c.values()) == len(data)
    m = spark.createDataFrame([("o1", "matched")], "card_id string, market_match_status string")
    for x in records.MARKET:
        if x not in m.columns:
            m = m.withColumn(x, F.lit(None).cast("double" if "min_price" == x[7:] else "int" if x.endswith("count") else "string"))
    assert rows(canonical.price_fallback(canonical.collapse(df), m).where("canonical_key = 'S1-001'"), "market_match_status") == [("matched",)]


# matching


def cards_and_products(spark):
    cards = spark.createDataFrame(
        [("c1", "S", "OP01-001", "ja", "Nami", "R", "a/OP01-001.png", 0), ("c2", "S", "OP01-001", "ja", "Nami (Parallel)", "R", "a/OP01-001_p1.png", 1), ("c3", "S", "OP01-001", "en", "Nami", "SP CARD", "a/OP01-001_p2.png", 2), ("c4", "S", "OP09-001", "ja", "Zoro", "SR", "a/x.png", 3)],
        "card_id string, set_id string, card_code string, language string, name string, rarity string, image_url string, ordinal int",
    ).withColumn("name_en", F.lit(None).cast("string"))
    products = spark.createDataFrame(
        [("OP01-001", "1", "Nami R [OP01-001]", "t/x.png"), ("OP01-001", "2", "Nami R-P [OP01-001]", "t/x_p1.png"), ("OP01-001", "3", "Nami R-SP [OP01-001][EN]", "t/x_p2.png"), ("OP01-001", "4", "Robin R [OP01-001]", "t/x.png"), ("OP01-001", "5", "Nami SR [OP01-001]", "t/x.png"), ("OP01-001", "6", "Nami R [OP01-002]", "t/x.png")],
        "card_code string, product_id string, product_name string, thumbnail_url string",
    ).selectExpr("*", "1.0 min_price", "'f' min_price_format")
    return cards, products


def test_gates(spark):
    cards, products = cards_and_products(spark)
    searches = spark.createDataFrame([("OP09-001", True)], "card_code string, failed boolean")
    m = {r.card_id: r for r in matching.match_by_gates(cards, products, searches).collect()}
    assert [m[c].product_id for c in ("c1", "c2", "c3", "c4")] == ["1", "2", "3", None]
    assert m["c1"].verified_candidates[0].reasons == ["code_exact:OP01-001", "language_not_constrained", "name_exact_normalized", "rarity_base:R", "thumbnail_suffix:base", "regular_class"]
    assert m["c1"].reject_reason_counts == {"code_mismatch:OP01-001": 1, "name_mismatch": 1, "rarity_mismatch:R!=SR": 1, "regular_variant_mismatch": 2}
    assert m["c3"].reject_reason_group_counts["missing_en_marker"] == 4 and m["c3"].variant_kind == "special"
    assert (m["c4"].match_status, m["c4"].unmatched_reason) == ("no_verified_match", "search_error") and m["c4"].rejected_count == 0
    s = matching.summarize(matching.match_by_gates(cards, products))
    assert ("status", "matched", 3) in rows(s) and ("unmatched_reason", "no_exact_code_products", 1) in rows(s)


def test_reference_match(spark):
    cards = spark.createDataFrame([("a", "SV8a", "200"), ("b", "SV8a", "1"), ("c", None, "1")], "card_id string, set_id string, card_code string")
    p = spark.createDataFrame([("SV8a", "9", "z [SV8a 200/187]"), ("SV8a", "8", "Y [sv8a 0200/187]"), ("SV8a", "7", "q [SV8a 001/187][EN]")], "set_id string, product_id string, product_name string").selectExpr("*", "'t' thumbnail_url", "1.0 min_price", "'f' min_price_format")
    m = {r.card_id: r for r in matching.match_by_reference(cards, p).collect()}
    assert set(m) == {"a", "b"} and m["a"].match_status == "multiple_verified_matches" and [v.product_id for v in m["a"].verified_candidates] == ["8", "9"]
    assert m["b"].match_status == "no_verified_match"


def test_pages_keywords_and_tallies(spark):
    one = json.dumps({"streetwearCount": None, "productCount": "4", "streetwears": [{"id": 1, "name": "a", "minPrice": 1}, {"id": "2", "name": "b", "isTradingCard": False}, "none"], "products": [{"id": "1", "name": "c", "isTradingCard": True}, {"id": " 3 ", "name": "d", "thumbnailUrl": "", "imageUrl": "/x", "minPrice": 5.5, "minPriceFormat": "¥5", "listingCount": 2, "offerCount": 7}, {"id": 4, "name": " "}]})
    pages = spark.createDataFrame([("k", 1, 200, one, True), ("k", 2, 500, None, False), ("k", 3, 200, "[1]", False), ("k", 4, 200, '{"streetwears": 5, "productCount": "many"}', False)], "keyword string, page int, status_code int, data string, from_cache boolean")
    got = matching.products_of(pages, ["keyword"], ["page"])
    assert rows(got, "product_id", "product_name") == [("1", "a"), ("3", "d")]
    assert rows(got, "thumbnail_url", "min_price", "min_price_format", "listing_count", "offer_count") == [("", 1.0, None, None, None), ("/x", 5.5, "¥5", 2, 7)]
    assert tuple(matching.page_totals(pages, ["keyword"], ["page"]).first()) == ("k", 4, 1, 2, 4, 5)
    cards = spark.createDataFrame([("C", "2", "Nami (parallel)"), ("C", "1", "Robin"), ("C", "3", "Nami")], "card_code string, card_id string, name string").withColumn("name_en", F.lit(None).cast("string"))
    assert rows(matching.search_keywords(cards), "keyword_rank", "keyword") == [(0, "C"), (1, "Robin [C]"), (2, "Nami [C]")]
    df = spark.createDataFrame([(["b", "a", "b", "a"],), ([],)], "v array<string>")
    assert [r[0] for r in df.select(matching.tally("v")).collect()] == [{"a": 2, "b": 2}, {}]
    assert [r[0] for r in df.select(matching.most_common("v")).collect()] == ["b", None]


# vectors and rerank


@pytest.mark.parametrize("seed", range(2))
def test_search_is_that_of_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(-2, 3, (60, 4)).astype(float)
    data = [(int(i % 3), i, v[i].tolist()) for i in range(60)] + [(0, 99, None)]
    df = spark.createDataFrame(data, "index_name int, row_id bigint, embedding array<float>").repartition(4)
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(10)], "query_id bigint, vector array<float>")
    hits = vectors.search(df, q, 3)
    want = []
    for a in range(10):
        for x in range(3):
            best = sorted((-float(v[a] @ v[i]), i) for i in range(60) if i % 3 == x)[:3]
            want += [(a, x, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    assert rows(hits, "query_id", "index_name", "row_id", "score", "index_rank") == sorted(want, key=str)
    top = vectors.merge(hits, 4, ["2", "0", "1"])
    assert {r.rank for r in top.collect()} == {1, 2, 3, 4}
    assert vectors.candidate_window(5, 10, hint=True) == (25, 25) and vectors.candidate_window(5, 10) == (10, 5)
    assert rows(vectors.inventory(df.where("embedding is not null"), "index_name"))[0] == (0, 20, 4, 1)


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], 5, 3)], "v array<double>, a bigint, b bigint")
    r = df.select(vectors.normalize("v").alias("n"), vectors.dot("v", "v").alias("d"), vectors.hamming_similarity("a", "b").alias("h")).first()
    assert r.n == [0.6, 0.8] and r.d == 25.0 and r.h == 0.96875


def test_blends_and_boosts(spark):
    h = spark.createDataFrame([(1, 1, 0.9, 0.2, "a"), (1, 2, 0.8, 0.6, "b"), (1, 3, 0.7, None, "c")], "query_id int, rank int, score double, s double, card_id string")
    out = rerank.minmax_blend(h, F.col("s"))
    assert [(r[0], round(r[1], 6)) for r in out.orderBy("rank").select("card_id", "score").collect()] == [("b", 0.88), ("a", 0.54), ("c", 0.42)]
    out = rerank.boost(h, F.col("card_id") == "c", 0.3, "code", F.lit("pokemon"))
    assert [r[0] for r in out.orderBy("rank").select("card_id").collect()] == ["c", "a", "b"]
    out = rerank.language_boost(h, F.lit("ja"), F.lit("ja"), F.lit("onepiece"))
    assert [r.score for r in out.orderBy("rank").collect()] == [0.9, 0.8, 0.7]
    out = rerank.visual_blend(h, F.col("s"), 0.5)
    assert [(r.card_id, round(r.score, 6), r.visual_applied) for r in out.orderBy("rank").collect()] == [("b", 0.7, True), ("c", 0.7, False), ("a", 0.55, True)]
    assert rerank.boost(h, F.lit(True), -1.0, "x", F.lit("pokemon")).where("score <> pre_x_score").count() == 0


def test_ambiguity(spark):
    h = spark.createDataFrame([(1, 1, 0.9, "a", "s", False), (1, 2, 0.88, "b", "s", True), (1, 3, 0.87, "c", "t", False), (1, 4, 0.5, "d", "s", False), (2, 1, 0.6, "a", "s", False), (2, 2, 0.6, "b", "s", False), (3, 1, 0.9, "a", "s", False), (3, 2, 0.89, "b", "s", False)], "query_id int, rank int, score double, card_id string, subj string, sig boolean")
    out = {r.query_id: r for r in rerank.select_ambiguous(h, F.col("subj"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("sig")).collect()}
    assert set(out) == {1, 3}
    assert (out[1].status, out[1].recommended_id, out[1].candidates) == ("resolved_by_card_code", "b", ["a", "b"])
    assert (out[3].status, out[3].recommended_id) == ("needs_user_choice", "a")
    t = spark.createDataFrame([("k", "loose", 0.9, 0), ("k", "strict", 0.5, 1), ("k", "strict", 0.5, 2)], "k string, quality string, confidence double, o int")
    from lotwise.functions.text import code_rank

    assert rows(rerank.best_attempt(t, "k", code_rank("quality"), "o"), "o") == [(1,)]


def test_recognition(spark):
    v = spark.createDataFrame([("pokemon_en", 1, [1.0, 0.0], "a", "SV1", "001", "en"), ("pokemon_ja", 2, [0.99, 0.1], "b", "SV2A", "002", "ja")], "index_name string, row_id bigint, embedding array<float>, card_id string, set_id string, card_code string, language string")
    q = spark.createDataFrame([(7, [1.0, 0.0], "SV2a", "002", "ja")], "query_id bigint, vector array<float>, hint_set string, hint_code string, hint_language string")
    assert [r.card_id for r in rerank.recognize(v, q).orderBy("rank").collect()] == ["a", "b"]
    assert [r.card_id for r in rerank.recognize(v, q, hint=True).orderBy("rank").collect()] == ["b", "a"]
    assert [r.card_id for r in rerank.recognize(v, q, language=True).orderBy("rank").collect()] == ["b", "a"]


# lookup


def test_aliases_and_lookup(spark, monkeypatch):
    a = spark.createDataFrame([("Shiny Pack", "SV4a", "x", "high", None), ("Pack", "SV1", None, None, "true"), ("Old", "SV2", None, None, "no"), ("x", "SV3", None, None, None)], "alias string, set_id string, source string, confidence string, enabled string")
    names = spark.createDataFrame([("SV9", None, None, "Journey Name", "Evidence Name", None)], "mapped_set_id string, set_id string, confidence string, set_name string, evidence_name string, evidence_source string")
    t = lookup.alias_table(a, names)
    assert {r.alias_key for r in t.collect()} == {"SHINYPACK", "PACK", "JOURNEYNAME", "EVIDENCENAME"}
    texts = spark.createDataFrame([(1, "2023 Shiny-Pack no 5"), (2, "the pack"), (3, "nothing"), (4, "journey name")], "id int, text string")
    want = [(1, "SV4a"), (2, "SV1"), (4, "SV9")]
    assert rows(lookup.match_alias(texts, t, "id", "text"), "id", "set_id") == want
    monkeypatch.setattr(lookup, "MOST_BROADCAST", 1)
    assert rows(lookup.match_alias(texts, t, "id", "text"), "id", "set_id") == want


# market


@pytest.mark.parametrize("prices", [[1, 2, 4, 10], [10, 11, 12, 13, 100], [5, 500, 1], [3]])
def test_iqr(spark, prices):
    df = spark.createDataFrame([("A", float(p), i, f"d{i}") for i, p in enumerate(prices)], "condition string, usd double, ordinal int, traded_at string")
    r = market.iqr_summary(df, ["condition"], "ordinal").first()
    q1, q3 = (statistics.quantiles(sorted(prices), n=4, method="inclusive")[::2]) if len(prices) >= 4 else (min(prices), max(prices))
    kept = [p for p in prices if q1 - 1.5 * (q3 - q1) <= p <= q3 + 1.5 * (q3 - q1)]
    assert (r.q1, r.q3, r.kept_count, r.dropped_count, r.latest, r.median) == (q1, q3, len(kept), len(prices) - len(kept), kept[0], statistics.median(kept))
    assert abs(r.average - sum(kept) / len(kept)) < 1e-9 and r.latest_at == f"d{prices.index(kept[0])}"


def test_trend(spark):
    d = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-03-15", 2.0), ("a", "2024-03-15", 4.0), ("b", "2024-01-01", 1.0), ("b", "2024-01-20", 2.0)], "k string, traded_at string, usd double")
    t = market.trend(d, ["k"])
    assert [(str(r.day), r.average, r.volume) for r in t.where("k = 'a'").orderBy("day").collect()] == [("2024-03-14", 3.0, 0), ("2024-03-15", 3.0, 2), ("2024-03-16", 3.0, 0)]
    assert t.where("k = 'b'").count() == 2


def test_arbitrage_and_grades(spark):
    pc = spark.createDataFrame([("PSA 10", "1100"), ("Ungraded", "200")], "grade string, price string")
    yen = spark.createDataFrame([("A", "30000")], "grade string, price string")
    r = market.arbitrage(pc, yen, 150.0).first()
    assert (r.average_10, r.average_raw, r.max_10, round(r.profit, 6)) == (1100.0, 200.0, 1100.0, 755.0)
    g = spark.createDataFrame([("PSA 10",), ("PSA10",), ("A",), (None,)], "g string")
    assert [x[0] for x in g.select(market.in_grade(F.col("g"), "PSA 10", True)).collect()] == [True, True, False, False]
    assert [x[0] for x in g.select(market.in_grade(F.col("g"), "Ungraded", False)).collect()] == [False, True, True, True]
    rec = spark.createDataFrame([("p", "PSA 10", 1), ("p", "A", 2), ("q", "A", 1)], "k string, grade string, o int")
    assert rows(market.table_rows(rec, ["k"], "PSA 10", "o"), "k", "grade") == [("p", "PSA 10"), ("q", "A")]


def test_report(spark):
    hits = spark.createDataFrame([(1, 1, "9", "Nami", "S", "001", "ja", None), (2, 1, None, "x", None, None, None, None)], "query_id int, rank int, market_product_id string, name string, set_id string, card_code string, language string, variant string")
    trades = spark.createDataFrame([("9", "A", 0, "$10", None, None, "2024-01-02"), ("9", "A", 1, "¥3000", None, None, "bad")], "product_id string, condition string, ordinal int, price_format string, price string, currency string, traded_at string")
    fx = spark.createDataFrame([(150.0,)], "usd_jpy double")
    out = {r.product_id: r for r in market.market_report(hits, trades, fx, F.lit("2024-05-05").cast("timestamp")).collect()}
    assert out[None].status == "missing_product_id" and out[None].report is None
    text = out["9"].report.split("\n")
    assert text[2] == "Nami #001" and "| Raw / A | $10 | $15.00 | $15 | $10 | $20 | 2/2 | 0 |" in text
    assert text[-6:] == ["## Raw / A", "- 2024/01/02  $10.00 USD", "- 2024/05/05  $20.00 USD", "", "## PSA 10", "no trades"]


# geometry


def test_polygons(spark):
    df = spark.createDataFrame([([[10.0, 20.0], [50.0, 20.0], [50.0, 80.0], [10.0, 80.0]],)], "p array<array<double>>")
    g = df.select(geometry.polygon_geometry("p", F.lit(100), F.lit(100)).alias("g")).first().g
    assert (g.left, g.bottom, g.width, g.center_x, g.center_y, g.area_ratio, g.right_ratio) == (10, 80, 40, 30, 50, 0.24, 0.5)
    mixed = spark.createDataFrame([([[50.0, 80.0], [10.0, 20.0], [10.0, 80.0], [50.0, 20.0]],)], "p array<array<double>>")
    assert mixed.select(geometry.order_corners("p")).first()[0] == [[10, 20], [50, 20], [50, 80], [10, 80]]
    out = df.select(geometry.expand_polygon("p", 1000.0, F.lit(100), F.lit(100))).first()[0]
    assert out == [[0, 0], [99, 0], [99, 99], [0, 99]]
    box = spark.createDataFrame([((0, 0, 100, 50),)], "b struct<left:int,top:int,right:int,bottom:int>")
    assert tuple(box.select(geometry.trim_box("b", F.lit(200), F.lit(200), 1.0)).first()[0]) == (25, 0, 75, 50)
    assert tuple(box.select(geometry.expand_box("b", F.lit(200), F.lit(200), 0.1)).first()[0]) == (0, 0, 110, 55)


def test_reading_order_and_suppression(spark):
    d = spark.createDataFrame([(1, 0, 50.0, 12.0, 40.0), (1, 1, 10.0, 10.0, 40.0), (1, 2, 10.0, 100.0, 40.0), (2, 0, 1.0, 1.0, 1.0)], "photo_id int, ordinal int, center_x double, center_y double, height double")
    assert rows(geometry.reading_order(d)) == [(1, 0, 2, 1), (1, 1, 1, 1), (1, 2, 3, 2), (2, 0, 1, 1)]
    rng = random.Random(0)
    boxes = [(rng.random(), *(lambda x, y: (x, y, x + 10, y + 10))(rng.randrange(30), rng.randrange(30))) for _ in range(40)]
    b = spark.createDataFrame([(1, i, c, float(l), float(t), float(r), float(m)) for i, (c, l, t, r, m) in enumerate(boxes)], "photo_id int, ordinal int, confidence double, left double, top double, right double, bottom double")

    def iou(a, c):
        w, h = max(0, min(a[3], c[3]) - max(a[1], c[1])), max(0, min(a[4], c[4]) - max(a[2], c[2]))
        return w * h / (200 - w * h)

    kept = []
    for x in sorted((x for x in boxes if x[0] >= 0.1), reverse=True):
        if all(iou(x, k) <= 0.1 for k in kept):
            kept.append(x)
    assert rows(geometry.suppress_overlaps(b), "confidence") == sorted(((k[0],) for k in kept[:20]), key=str)
    top = geometry.most_confident(b, 3)
    assert sorted(r.confidence for r in top.collect()) == sorted(x[0] for x in boxes)[-3:]


def test_runs_and_signatures(spark):
    df = spark.createDataFrame([([True, True, False, True],), ([],), ([False],)], "f array<boolean>")
    assert [r[0] for r in df.select(geometry.longest_run("f")).collect()] == [0.5, 0.0, 0.0]
    assert [[tuple(x) for x in r[0]] for r in df.select(geometry.true_runs("f")).collect()] == [[(0, 2), (3, 4)], [], []]
    rng = np.random.default_rng(0)
    a = geometry.signature(rng.integers(0, 256, (60, 40, 3)).astype(np.uint8))
    assert len(a["hsv"]) == 864 and len(a["rgb"]) == 96 and len(a["gray"]) == 44 * 32 and len(a["regions"]) == 3
    assert abs(np.linalg.norm(a["hsv"]) - 1) < 1e-6 and -(2**63) <= a["dhash"] < 2**63
    flat = np.arange(48).reshape(8, 6).astype(float)
    assert np.allclose(geometry.shrink(flat, 4, 3), flat.reshape(4, 2, 3, 2).mean((1, 3)))
    s = spark.createDataFrame([(a, a)], spark.createDataFrame([], geometry.SIGNATURE and __import__("pyspark.sql.types", fromlist=["T"]).StructType([]).add("q", geometry.SIGNATURE).add("c", geometry.SIGNATURE)).schema)
    v = s.select(rerank.visual_similarity(F.col("q"), F.col("c")).alias("v")).first().v
    assert abs(v.visual - 1) < 1e-6 and abs(v.color - 1) < 1e-6


def test_best_overlap_is_that_of_a_plain_search(spark):
    rng = random.Random(1)
    bag = lambda n: rng.sample([f"w{i}" for i in range(60)], n)
    texts, items = [(i, bag(rng.randrange(0, 20))) for i in range(300)] + [(300, None)], [(i, bag(rng.randrange(0, 9))) for i in range(40)] + [(40, None)]
    want = {}
    for i, t in texts:
        found = [(round(len(set(t or ()) & set(u)) / min(len(t), len(u)), 9), -j, len(set(t) & set(u))) for j, u in items if t and u and set(t) & set(u)]
        if found:
            s, j, n = max(found)
            want[i] = (-j, n, s)
    a, b = spark.createDataFrame(texts, "doc bigint, words array<string>"), spark.createDataFrame(items, "item bigint, words array<string>")
    for cells in (64_000_000, 900):
        assert {r.doc: (r.item, r.shared, r.similarity) for r in matching.best_overlap(a, b, "doc", "item", cells).collect()} == want
    assert matching.best_overlap(a, b.limit(0), "doc", "item").count() == 0


def test_vector_blocks_find_the_same(spark, monkeypatch):
    rng = random.Random(2)
    v = spark.createDataFrame([(f"i{i % 3}", i, [float(rng.randrange(-3, 4)) for _ in range(8)] if i % 11 else None) for i in range(200)], "index_name string, row_id bigint, embedding array<double>")
    q = spark.createDataFrame([(i, [float(rng.randrange(-3, 4)) for _ in range(8)] if i % 7 else None) for i in range(60)], "query_id bigint, vector array<double>")
    want = sorted(map(tuple, vectors.search(v, q, 4).collect()))
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 160)
    assert sorted(map(tuple, vectors.search(v, q, 4).collect())) == want and len(want) == 51 * 12


@pytest.mark.parametrize("seed", range(2))
def test_contained_names_are_the_same_for_long_lists(spark, monkeypatch, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    texts = spark.createDataFrame([(i, word(rng.randrange(0, 12))) for i in range(80)], "id int, t string")
    names = spark.createDataFrame([(n,) for n in {word(rng.randrange(0, 6)) for _ in range(40)}], "name string")
    want = {}
    for r in texts.collect():
        held = [n.name for n in names.collect() if n.name and n.name in r.t]
        if held:
            want[r.id] = max(held, key=lambda n: (len(n), n))
    for most in (100_000, 1):
        monkeypatch.setattr(lookup, "MOST_BROADCAST", most)
        assert {r.id: r.name for r in lookup.longest_contained(texts, names, "id", "t", "name").collect()} == want


def test_title_references_by_lookup_are_those_of_the_pattern(spark):
    rng = random.Random(3)
    sets = ["SV1", "sv-p", "P", "S8", "SV8a", "1", "x y", "-P", "M+"]
    part = lambda: rng.choice(["", "[", "x", "-", "/"]) + rng.choice(["SV1", "SV-P", "S8", "SV8a", "P", "x y", "M+"]) + rng.choice([" ", "\t ", "", "-"]) + rng.choice(["001", "1", "12", "000"]) + rng.choice(["/", " /", "/ ", " "]) + rng.choice(["060", "SV-P", "]"])
    titles = ["".join(part() + rng.choice(["", " "]) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    pairs = [(t, s, c) for t in titles for s in sets for c in ("1", "012", "000")]
    df = spark.createDataFrame([*pairs, (None, "SV1", "1"), ("SV1 1/2", None, "1")], "t string, s string, c string")
    got = df.select("t", "s", X.title_ref("t", "s", "c")["reason"].alias("a"), X.title_ref("t", "s", "c", X.title_refs("t"))["reason"].alias("b"))
    assert got.where("not (a <=> b)").limit(3).collect() == [] and got.where("a like 'set_card_ref:%'").count() > 50


def test_lookups_by_name_score_as_all_pairs_do(spark):
    """Without a set, names, their parts and their words lead to the same hits as scoring every record for every lookup."""
    rng = random.Random(4)
    name = lambda: " ".join(rng.choice(["Fire", "Fox", "Foxfire", "Ice", "Icefox", "Old", "Bo"]) for _ in range(rng.randrange(0, 4)))
    rec = [(f"P{i % 40}" if i % 3 else None, f"C{i % 50}", f"K{i % 60}", rng.choice(["SV1", "SV2", None]), str(rng.randrange(1, 4)), name(), name() if i % 2 else None, None, name(), rng.choice(["pokemon_ja", "pokemon_en"]), "ja", i) for i in range(90)]
    r = spark.createDataFrame(rec, "product_id string, canonical_id string, card_id string, set_id string, card_code string, name string, name_en string, name_ja string, product_name string, index_name string, language string, row_id bigint")
    look = [(i, f"P{i}" if i % 9 == 0 else None, f"C{i}" if i % 11 == 0 else None, None, "SV1" if i % 4 == 0 else None, str(rng.randrange(1, 4)) if i % 7 else None, name(), name() if i % 3 == 0 else None, "ja", i % 2 == 0) for i in range(70)]
    q = spark.createDataFrame(look, "lookup_id bigint, product_id string, canonical_id string, card_id string, set_id string, card_code string, subject string, title string, language string, label boolean")
    got = {(h.lookup_id, h.row_id): h.score for h in lookup.lookup(r, q, 1000).collect()}
    folded = lambda d, s, *cs: d.select(*[F.col(c).alias(f"{s}_{c}") for c in d.columns], *[lookup.filled(X.lookup_key(c)).alias(f"_k_{c}") for c in cs])
    a = folded(r, "r", "name", "name_en", "name_ja").withColumns({"_tr": X.tokens("r_name", "r_name_en", "r_name_ja", "r_product_name"), "_sr": X.tokens("r_set_id", "r_product_name", "r_card_id")})
    b = folded(q, "q", "subject").withColumns({"_tq": X.tokens("q_subject"), "_sq": X.tokens("q_title")})
    keys = lambda *cs: F.array_compact(F.array(*[f"_k_{c}" for c in cs]))
    names = X.subject_similarity(keys("subject"), keys("name", "name_en", "name_ja"), F.col("_tq"), F.col("_tr"))
    titles = X.overlap(F.col("_sq"), F.col("_sr"))
    side = lambda s: {c: F.col(f"{s}_{c}") for c in ("product_id", "canonical_id", "card_id")} | {"set_key": X.match_set(f"{s}_set_id"), "number": X.card_number(f"{s}_card_code")}
    every = a.crossJoin(b).withColumn("score", F.round(lookup.lookup_score(side("r"), side("q"), names, titles, lookup.truthy("q_title"), F.coalesce("q_label", F.lit(False))), 4)).where("score > 0")
    want = {(h.q_lookup_id, h.r_row_id): h.score for h in every.collect()}
    assert got == want and len({s for s in want.values()}) >= 4
