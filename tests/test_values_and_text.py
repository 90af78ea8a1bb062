import pytest
from pyspark.sql import functions as F

from lotwise.functions import money as M
from lotwise.functions import text as X
from lotwise.functions import unicode as U
from lotwise.functions import values as V


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())] if cols else [(1,)], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for k, v in cols.items()) or "x int")
    r = df.select(expr.alias("r")).first()["r"]
    return r.asDict(True) if hasattr(r, "asDict") else r


def check(spark, f, cases):
    """f of one text column against expected values, in one job."""
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v string")
    got = {r.i: r.r for r in df.select("i", f("v").alias("r")).collect()}
    for i, (v, want) in enumerate(cases):
        r = got[i]
        assert (tuple(r) if isinstance(r, tuple) else r) == want, v


def test_emptiness(spark):
    check(spark, V.truthy, [("", False), (None, False), ("false", True), ("0", True)])
    check(spark, V.has_value, [("", False), (None, False), ("0", True)])
    check(spark, V.text_int, [("", None), (" 12 ", 12), ("12.0", None), ("x", None), (None, None), ("-7", -7)])
    assert one(spark, V.lenient_int("v"), v=12.7) == 12
    check(spark, lambda c: V.zero_fill(c, 3), [("1", "001"), ("1234", "1234")])
    check(spark, V.strip_zeros, [("000", "0"), ("009", "9"), ("100", "100")])
    check(spark, lambda c: V.half_even(F.col(c).cast("double")), [("0.5", 0.0), ("1.5", 2.0), ("2.5", 2.0)])
    check(spark, V.squeeze, [(" a \n\t b　c ", "a b c")])


def test_names(spark):
    check(spark, X.normalize_name, [("Luffy (Parallel)", "luffy"), ("A &amp; B", "ab"), (None, ""), ("Nami (Alternate PARALLEL art) X", "namix")])
    check(spark, X.search_name, [("Luffy (Parallel)", "Luffy"), ("A  (parallel) B", "A B"), (None, "")])
    check(spark, X.normalize_rarity, [("Super Rare", "SR"), (" sp card ", "SP CARD"), ("LEADER", "L"), ("", None), ("secretrare", "SEC"), ("special", "SP CARD")])
    check(spark, X.image_suffix, [("https://a/b/OP01-001_p1.png", "p1"), ("https://a/b/OP01-001.png?x=_q", "base"), (None, None), ("", None), ("/x/a_B.PNG", "b")])
    check(spark, X.thumbnail_suffix, [("https://a/OP01-001_p2-of-3.png", "p2"), ("https://a/OP01_R1.png", "r1"), ("https://a/x_y.png", "base"), (None, None)])
    check(spark, X.set_from_code, [("OP01-001", "OP01"), ("P-001", "P"), ("001", None), (None, None)])
    check(spark, X.set_from_card_id, [("sv3-5-001", "sv3-5"), ("abc", None), (None, None)])
    check(spark, X.variant_from_id, [("OP01-001_p1_x", "p1_x"), ("OP01-001", None)])
    assert one(spark, X.flatten_variants(F.create_map(F.lit("normal"), F.lit(True), F.lit("holo"), F.lit(True), F.lit("reverse"), F.lit(False)))) == "holo,normal"
    for rarity, name, url, kind in (("SP CARD", "x", None, "special"), ("R", "Nami (Parallel)", None, "parallel"), ("R", "Nami", "a/x_p1.png", "printed_variant"), ("R", "Nami", "a/x.png", "regular")):
        assert one(spark, X.variant_kind("r", "n", "u"), r=rarity, n=name, u=url) == kind


def test_titles(spark):
    ref = X.title_ref("t", "s", "c")
    assert one(spark, ref, t="X [SV8a 200/187]", s="SV8a", c="200") == {"ok": True, "reason": "set_card_ref:SV8a 200"}
    assert not one(spark, ref, t="X S9/S12 001", s="S12", c="001")["ok"]
    assert one(spark, ref, t="x", s="", c="1")["reason"] == "missing_set_id" and one(spark, ref, t="x", s="S1", c=None)["reason"] == "missing_card_code"
    assert one(spark, ref, t="x [s.1 01/2]", s="S.1", c="1")["ok"] and not one(spark, ref, t="x [sa1 01/2]", s="S.1", c="1")["ok"]
    number = X.title_number("t", "c")
    for t, c, want in (("a 012/100", "12", "fraction_numerator:012/100"), ("a 012 b", "12", "standalone_padded"), ("a 12 b", "12", "standalone_clean"), ("a 112", "12", "number_mismatch"), ("a", None, "no_number_constraint")):
        assert one(spark, number, t=t, c=c)["reason"] == want
    assert [one(spark, p, c="001") for p in X.number_parts("c")] == ["1", "001"] and [one(spark, p, c="TG12") for p in X.number_parts("c")] == ["12", "012"]
    check(spark, X.foreign_language, [("Pikachu [EN]", True), ("Pikachu English version", True), ("韓国語 x", True), ("Pikachu", False), (None, False)])
    check(spark, X.title_language, [("x [en]", "en"), ("x【KR】", "ko"), ("x [CN]", "zh"), ("x", None)])
    check(spark, X.thumbnail_language, [("https://a/EN/b", "en"), ("https://a/opc-en-tcg", "en"), ("https://a", None)])
    assert one(spark, X.mentions_set("t", "s"), t="a SV1 b", s="sv1") and not one(spark, X.mentions_set("t", "s"), t="a SV1a b", s="sv1")


def test_codes_and_sets(spark):
    check(spark, X.card_number, [("A123", "123"), ("TG12", "TG12"), ("009/100", "9"), ("G05", "G05"), ("", None), ("000", "0")])
    check(spark, X.match_set, [("sv_p", "SV-P"), ("SWSH", "PROMO-SWSH"), ("XY-P", "XYP"), ("s 12a", "S12A"), (None, None)])
    check(spark, X.ocr_text, [("svla 1O1／165", "SV1A 101/165"), ("a  |  b", "A 1 B"), (None, "")])
    check(spark, X.ocr_set, [("s p", "S-P"), ("SWSH", "PROMO-SWSH"), ("sv--2a", "SV-2A"), ("", None)])
    code = one(spark, X.card_code("v"), v="Japanese, S11a 091/068")
    assert (code["quality"], code["set_id"], code["card_number"], code["total"]) == ("strict", "S11A", "91", "68")
    assert one(spark, X.code_rank("v"), v="trailing_set") == 0 and one(spark, X.code_rank("v"), v="strict") == 4
    assert one(spark, X.hint_payload("v"), v="SWSH 039")["status"] == "ok" and one(spark, X.hint_payload("v"), v=" ")["status"] == "skipped"
    check(spark, X.cert_key, [(" PSA 123-45 ", "12345"), ("abc", "ABC"), (" ", None)])
    check(spark, X.barcode_kind, [("12345678", "numeric_cert_like"), ("123", "numeric_other_length"), ("HTTPS://x", "url"), ("x1", "other_text")])
    check(spark, X.grader_hint, [("https://www.psacard.com/1", "psa"), ("cgccards.com", "cgc"), ("x", None)])


def test_languages(spark):
    check(spark, X.language_of, [("JPN", "ja"), ("英文", "en"), ("fr", None), (None, None)])
    r = one(spark, X.infer_language("v"), v="Japanese, S11a 091/068")
    assert (r["language"], r["confidence"], r["signals"]) == ("ja", 0.98, ["explicit_japanese", "japanese_set_code"])
    assert one(spark, X.requested_language("a", "b", "c"), a=None, b="x", c="English") == "en"
    assert one(spark, X.candidate_language("a", "b"), a=None, b="pokemon_ja") == "ja"
    check(spark, X.game_family, [("One Piece TCG", "onepiece"), ("Pokemon", "pokemon"), ("x", None)])
    assert one(spark, X.candidate_family(["a"], "b", ["c"]), a=None, b="idx", c="pokemon_x") == "pokemon"


def test_labels(spark):
    got = one(spark, X.tokens("v"), v="The 20thANNIV Coll of Frosted ShinyPack")
    assert {"anniversary", "20th", "collection", "frost", "shine", "shiny", "pack"} <= set(got) and "the" not in got
    check(spark, X.lookup_key, [("Pokémon-X!", "pokemonx"), (None, "")])
    check(spark, X.label_set, [("JAPANESE SV-P PIKACHU", "SV-P"), ("XY-P PROMOS", "XYP"), ("x", None)])
    check(spark, X.alias_key, [("20th Champi0n & Co", "20THCHAMPIONANDCO")])
    r = one(spark, X.parse_label("v"), v="#025 PIKACHU")
    assert r["card_number"] == "025" and r["subject"] == "#025 PIKACHU"
    r = one(spark, X.parse_label("v", True), v="2023 POKEMON JAPANESE\nPIKACHU\nSHINY COLLECTION SERIES\n#025\nGEM MT\n10\n12345678")
    assert (r["card_number"], r["subject"], r["language"]) == ("025", "PIKACHU", "ja") and "SHINY COLLECTION SERIES" in r["set_title"]


def test_small_parsers(spark):
    check(spark, X.strip_tags, [("<b>a</b> &amp;\n<i>b</i>", "a & b")])
    check(spark, X.set_from_image_path, [("/assets/card_images/large/SV1/x.jpg", "SV1"), ("/x", None)])
    check(spark, X.rarity_from_path, [("/a/ic_rare_sr.gif", "sr"), (None, None)])
    check(spark, X.safe_part, [("a b/ü.png", "a_b_ü.png"), ("", "unknown")])
    check(spark, lambda c: X.absolute_url("https://h.example/a/b.html", c), [("/x", "https://h.example/x"), ("y", "https://h.example/a/y"), ("//z/q", "https://z/q"), ("http://o", "http://o"), (None, None)])
    check(spark, X.first_number, [("¥15,000", 15000.0), ("a -1.5 b", -1.5), ("x", None), (None, None)])
    assert one(spark, X.level_and_text("v"), v="HIGH: strong") == {"level": "High", "text": "strong", "width": 90}
    assert one(spark, X.level_and_text("v"), v="unknown")["text"] == "Insufficient data"
    check(spark, X.image_variants, [("https://h/100_140/x.jpg", ["https://h/front/x.jpg", "https://h/200_280/x.jpg", "https://h/100_140/x.jpg"]), ("https://h/x.jpg", ["https://h/x.jpg"]), (None, [])])
    assert one(spark, X.fill_template("a {{x}} {{y}}", {"x": F.lit(1), "y": F.lit(None)})) == "a 1 "
    check(spark, lambda c: U.json_find(c, "Cert Number"), [('{"a": [{"cert_number": 5}]}', "5"), ('{"x": 1}', None), ("bad", None), (None, None)])
    check(spark, lambda c: U.subject_key(F.col(c)), [("Ｐｉｋａ-chu ", "pikachu"), ("--", None), (None, None)])
    check(spark, X.url_extension, [("https://a/b.PNG?x", ".png"), ("https://a/b", ".jpg")])


@pytest.mark.parametrize("text,price,currency,usd,jpy", [("¥15,000", None, None, 100.0, 15000), ("US $99.50", None, None, 99.5, 14925), (None, "3000", "JPY", 20.0, 3000), ("about 5", "7", None, 7.0, 1050), (None, None, None, 0.0, 0)])
def test_prices(spark, text, price, currency, usd, jpy):
    assert one(spark, M.price_usd("t", "p", "c", F.lit(150.0)), t=text, p=price, c=currency) == usd
    assert one(spark, M.price_jpy("t", "p", "c", F.lit(150.0)), t=text, p=price, c=currency) == jpy


def test_dates_and_money(spark):
    now = F.lit("2024-03-10 12:00:00").cast("timestamp")
    day = lambda c: F.date_format(M.loose_time(c, now), "yyyy-MM-dd HH")
    check(spark, day, [("3日前", "2024-03-07 12"), ("5時間前", "2024-03-10 07"), ("2024/1/5", "2024-01-05 00"), ("2024-01-05", "2024-01-05 00"), ("Jan 5, 2024", "2024-01-05 00"), ("soon", "2024-03-10 12"), (None, "2024-03-10 12")])
    check(spark, lambda c: M.date_label(c, now), [("2024-01-02T03:04:05Z", "2024/01/02"), ("x", "2024/03/10")])
    for days, want in ((0, " (24h)"), (5, " (last 5 days)"), (45, " (last 1 month)"), (75, " (last 2 months)"), (105, " (last 4 months)")):
        assert one(spark, M.span_label(F.lit("en"), "d"), d=days) == want
    assert one(spark, M.yen("v"), v="1234.5") == "¥1,234" and one(spark, M.dollars("v", 0), v=12.0) == "$12"
    assert one(spark, M.prize_yen("p", "t"), p=None, t="1,200円") == 1200
    r = one(spark, M.resolve_rate(F.lit(None).cast("double"), F.lit(151.5)))
    assert r == {"rate": 151.5, "status": "live"} and one(spark, M.resolve_rate(F.lit(-1.0), F.lit(151.5))) == {"rate": 150.0, "status": "override"}
    assert one(spark, M.positive_rate("v"), v="x") == 150.0
