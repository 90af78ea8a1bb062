import json
import os
import pathlib
import sqlite3

import pytest
from pyspark.sql import functions as F

from lotwise.sources import adapters, html_cards, paged, readers, sinks
from lotwise.streaming import manifests

def now():
    return F.lit("2024-01-02 03:04:05").cast("timestamp")


def test_json_lines(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    open(p, "w", encoding="utf-8").write('{"a": "x", "b": 1}\n\n{"a": "é", "zz": 2}\n{"a": "y"}\n')
    df = readers.read_jsonl(spark, p, "a string, b int")
    assert [r.a for r in df.orderBy("ordinal").collect()] == ["x", "é", "y"]
    open(p, "a").write("{bad\n")
    assert readers.read_jsonl(spark, p, "a string, b int", strict=False).count() == 3
    with pytest.raises(Exception, match="malformed"):
        readers.read_jsonl(spark, p, "a string, b int").collect()
    out = str(tmp_path / "out")
    assert sinks.write_jsonl(spark.createDataFrame([(1, None)], "b int, a string"), out) == 1
    assert spark.read.text(out).first()[0] == '{"a":null,"b":1}'


def test_csv_and_discovery(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    p = folder / "c.csv"
    p.write_text('﻿Card_ID;Name ;Card_Code\n1;"a\nb";OP01-001\n', encoding="utf-8")
    df = readers.read_csv(spark, str(p))
    assert df.columns == ["card_id", "name", "card_code"] and df.first().name == "a\nb"
    assert readers.single_csv(str(folder)) == str(p)
    (folder / "e.csv").write_text("x")
    with pytest.raises(ValueError):
        readers.single_csv(str(folder))
    assert readers.existing(spark, [str(p), str(tmp_path / "none")]) == [str(p)]
    assert readers.named_paths("a=/p, b=/q,c,=x") == {"a": "/p", "b": "/q"}


def test_adapters(spark):
    api = spark.createDataFrame([("sv3-5-001", "001", "Pika", "img", "R", None, ("sv3-5",), {"normal": True, "holo": False})], "id string, localId string, name string, image string, rarity string, updated string, set struct<id:string>, variants map<string,boolean>")
    r = adapters.api_cards(api, "ja", now()).first()
    assert (r.card_id, r.set_id, r.name_ja, r.name_en, r.variant, r.is_sample, r.updated_at) == ("sv3-5-001", "sv3-5", "Pika", None, "normal", False, "2024-01-02T03:04:05+00:00")
    c = spark.createDataFrame([("OP01-001", "Nami", "p1", "https://a/sample.png")], "code string, name string, art_variant string, image string")
    r = adapters.csv_cards(c, now()).first()
    assert (r.card_id, r.set_id, r.variant, r.is_sample, r.url_flag_reasons) == ("OP01-001-p1", "OP01", "p1", True, ["url_contains_sample", "url_watermark_hint"])
    d = spark.createDataFrame([("OP01-001_p1", "OP01-001", "", "569", None, "Nami", "R")], "id string, code string, set_code string, pack_id string, language string, name string, rarity string")
    r = adapters.dataset_cards(d, now()).first()
    assert (r.set_id, r.language, r.name_en, r.variant) == ("569", "en", "Nami", "p1")
    o = spark.createDataFrame([("7", "名", None, "001", "R", "u")], "official_card_id string, name_ja string, set_id string, card_code string, rarity string, image_url string")
    assert adapters.official_cards(o, now()).first().card_id == "official_7"
    p = spark.createDataFrame([("/r/x/sv3-5_en_001_std.jpg", 10, 20, "JPEG", False, "e", "h")], "path string, width int, height int, image_format string, is_valid_image boolean, image_error string, image_sha256 string")
    r = adapters.picture_cards(p, now()).first()
    assert (r.card_id, r.language, r.variant, r.image_sha256, r.filename_rule) == ("sv3-5-001", "en", "std", None, "modern_underscore")
    pics = spark.createDataFrame([("img", "/p", 1, 2, "h", True)], "image_url string, path string, width int, height int, image_sha256 string, is_valid_image boolean")
    r = adapters.with_pictures(adapters.api_cards(api, "ja", now()), pics).first()
    assert (r.source, r.local_image_path, r.image_sha256) == ("tcgdex_image", "/p", "h")


def test_detail_pages(spark):
    page = '<h1 class="Heading1 x">ピカ <b>V</b></h1><img class="fit" src="/assets/card_images/large/SV1/9.jpg" alt="alt"><div class="subtext"> 001 / 078 <img src="/assets/images/card/rarity/ic_rare_rr.gif"></div><h4>イラストレーター</h4> <a href="x">A&amp;B</a><h4>No.025　ピカチュウ</h4><span class="hp">HP</span> <span class="hp-num">60</span>'
    r = adapters.detail_fields(spark.createDataFrame([(page,), ("",)], "html string"), "https://h.example/").orderBy(F.length("html").desc()).first()
    assert (r.name_ja, r.set_id, r.set_id_source, r.card_code, r.number_total, r.rarity, r.illustrator, r.pokemon_no, r.pokemon_species, r.hp, r.image_url) == ("ピカ V", "SV1", "image_path", "001", "078", "rr", "A&B", "025", "ピカチュウ", "60", "https://h.example/assets/card_images/large/SV1/9.jpg")


def test_list_pages(spark):
    dl = '<dl class="modalCol" id="{i}"><dt><div class="infoCol"><span>OP01-00{n}</span>|<span>R</span>|<span>CHARACTER</span></div><div class="cardName">Na<br>mi</div></dt><dd><div class="frontCol"><img data-src="../img/OP01-00{n}_p1.png?1"></div><div class="backCol"><div class="cost"><h3>Cost</h3>3</div><div class="attribute"><img alt="Slash"></div><div class="getInfo"><h3>Got</h3>Pack</div></div></dd></dl>'
    html = '<select name="series"><option value="">ALL</option><option value="1">Set &lt;br class="spInline"&gt;One</option></select><div class="countCol"><span>3</span></div>' + dl.format(i="a", n=1) + dl.format(i="a", n=1) + dl.format(i="b", n=2) + '<dl class="modalCol" id="c"><dt></dt></dl>'
    pages = spark.createDataFrame([("1", "One", "https://h.example/list/?s=1", html)], "series_id string, series_name string, url string, html string")
    rows = html_cards.list_cards(pages).orderBy("card_id").collect()
    assert [(r.card_id, r.card_code, r.set_id, r.variant, r.name, r.card_cost, r.card_attribute, r.card_get_info, r.image_url) for r in rows] == [("a-ja", "OP01-001", "OP01", "p1", "Na mi", "3", "Slash", "Pack", "https://h.example/img/OP01-001_p1.png?1"), ("b-ja", "OP01-002", "OP01", "p1", "Na mi", "3", "Slash", "Pack", "https://h.example/img/OP01-002_p1.png?1")]
    assert [tuple(r) for r in html_cards.expected_counts(pages).collect()] == [("1", 3)]
    spark.udtf.register("opts", html_cards.series_options())
    pages.createOrReplaceTempView("opt_pages")
    assert [tuple(r) for r in spark.sql("select o.* from opt_pages p, lateral opts(p.html) o").collect()] == [("1", "Set One")]


def test_paged_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"page-{i}.json").write_text(json.dumps({"total": 5, "rows": [{"v": i * 2 + j} for j in range(2)]}))
    spark.dataSource.register(paged.PagedJson)
    df = spark.read.format("paged_json").option("folder", str(tmp_path)).option("pagesize", "2").load()
    assert sorted((r.ordinal, json.loads(r.row)["v"]) for r in df.collect()) == [(i, i) for i in range(5)]
    assert spark.read.format("paged_json").option("folder", str(tmp_path)).option("pagesize", "2").option("limit", "3").load().count() == 3


def test_flags_certs_trades(spark):
    f = spark.createDataFrame([("1", "low", 0), ("1", "high", 1), ("", "x", 2)], "product_id string, severity string, ordinal int")
    flags = readers.read_flags(f)
    assert [(r.product_id, r.severity) for r in flags.collect()] == [("1", "high")]
    hits = spark.createDataFrame([("1", "matched", "n", "u", 1.0), ("2", "matched", "n", "u", 1.0)], "market_product_id string, market_match_status string, market_product_name string, market_url string, market_min_price double")
    m = {r.market_product_id: r.market for r in adapters.suppressed_hit(hits, flags).collect()}
    assert m["1"].mapping_suppressed and m["1"].product_id is None and m["1"].suppressed_product_id == "1" and m["2"].product_id == "2"
    c = spark.createDataFrame([(None, "12-34"), ("", None)], "cert string, barcode string")
    assert [r.cert_key for r in readers.read_certs(c).collect()] == ["1234"]
    t = "array<struct<condition:string,price:string,priceFormat:string,price_format:string,formattedPrice:string,formatted_price:string,currency:string,priceCurrency:string,tradedAt:string>>"
    p = spark.createDataFrame([("9", None, [("A", "1", "", "x", None, None, None, "JPY", "d")], None), ("8", None, None, "http_error")], f"product_id string, histories {t}, data {t}, error string")
    assert [(r.product_id, r.ordinal, r.price_format, r.currency) for r in readers.trades_of(p).collect()] == [("9", 0, "x", "JPY")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, True, [1]), ("b", None, False, None)], "card_id string, width int, is_sample boolean, tags array<int>")
    p = str(tmp_path / "c.sqlite")
    assert sinks.write_sqlite(df, p) == 2
    db = sqlite3.connect(p)
    assert db.execute("select card_id, width, is_sample, tags from cards order by 1").fetchall() == [("a", 1, 1, "[1]"), ("b", None, 0, None)]
    assert ("idx_cards_card_id",) in db.execute("select name from sqlite_master where type = 'index'").fetchall()
    assert sinks.write_if_any(df.limit(0), str(tmp_path / "e")) is False and sinks.write_if_any(df, str(tmp_path / "e")) is True
    assert sinks.write_if_any(df.limit(0), str(tmp_path / "e")) is False and not os.path.exists(tmp_path / "e")
    sinks.append_manifest(df.select("card_id"), str(tmp_path / "m"))
    sinks.append_manifest(df.select("card_id"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 4
    sinks.rewrite_parts(df.select("card_id", "width"), str(tmp_path / "r"), "card_id")
    sinks.rewrite_parts(spark.createDataFrame([("a", 9)], "card_id string, width int"), str(tmp_path / "r"), "card_id")
    assert sorted((r.card_id, r.width or 0) for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [("a", 9), ("b", 0)]
    with pytest.raises(ValueError):
        sinks.report_path(str(tmp_path), "../x")
    assert sinks.safe_report_name("../a b", "2024-01-02") == "_a_b-20240102.md"
    v = spark.createDataFrame([("i", 1, [1.0]), ("j", 2, [1.0])], "index_name string, row_id bigint, embedding array<float>")
    sinks.write_vectors(v, str(tmp_path / "v"))
    assert readers.read_vectors(spark, str(tmp_path / "v"), ["i"]).count() == 1
    with pytest.raises(ValueError):
        readers.read_vectors(spark, str(tmp_path / "v"), ["none"])


def test_stream_and_batch_agree(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string").write.mode("append").json(str(src))
    for _ in range(2):
        manifests.append(manifests.follow(spark, str(src), "i int, s string"), out, str(tmp_path / "state"), lambda b: b.withColumn("t", F.upper("s"))).awaitTermination()
        spark.createDataFrame([(3, "c")], "i int, s string").write.mode("append").json(str(src)) if _ == 0 else None
    got = sorted((r.i, r.t) for r in spark.read.parquet(f"{out}/*").collect())
    assert got == [(1, "A"), (2, "B"), (3, "C")] == sorted((r.i, r.s.upper()) for r in spark.read.schema("i int, s string").json(str(src)).collect())


def test_entry_points_without_the_llm_folders(tmp_path):
    """The driver deletes the training-data operators; the rest must import and run."""
    import shutil
    import subprocess
    import sys

    root = str(pathlib.Path(__file__).resolve().parents[1])
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) >= 40 and set(s) <= set(q); assert not any(k.startswith('op') or k == 'pipeline' for k in q); print('ok', len(q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert got.stdout.startswith("ok"), got.stderr
