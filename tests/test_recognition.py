"""The composed photo query, the choice among look-alikes, several cards on a photo, and the checks of indexes."""

import pytest
from pyspark.sql import functions as F

from lotwise.operators import canonical, records, rerank, vectors
from lotwise.sources import sinks


@pytest.fixture(scope="module")
def cards(spark):
    rows = [("pokemon_ja", 1, [1.0, 0.0], "a", "SV1", "001", "ja", "pokemon", "Mew"), ("pokemon_ja", 2, [0.99, 0.1], "b", "SV1", "002", "ja", "pokemon", "MEW"), ("pokemon_en", 1, [0.9, 0.4], "c", "SV2", "003", "en", "pokemon", "Eevee"), ("onepiece", 1, [0.0, 1.0], "d", "OP01", "001", "en", "onepiece", "Nami")]
    return spark.createDataFrame(rows, "index_name string, row_id bigint, embedding array<double>, card_id string, set_id string, card_code string, language string, game string, name string")


def query(spark, **more):
    names = ", ".join(f"{c} string" for c in more)
    return spark.createDataFrame([(7, [1.0, 0.0], *more.values())], "query_id bigint, vector array<double>" + (", " + names if names else ""))


def order(hits):
    return [r.card_id for r in hits.orderBy("rank").collect()]


def test_stages_follow_each_other(spark, cards):
    assert order(rerank.recognize(cards, query(spark))) == ["a", "b", "c", "d"]
    hinted = rerank.recognize(cards, query(spark, hint_set="SV2", hint_code="3/100"), hint=True, hint_by=0.2)
    assert order(hinted)[0] == "c"
    read = rerank.recognize(cards, query(spark, hint_set="SV2", hint_code="3", ocr_set="SV1", ocr_code="002"), hint=True, hint_by=0.2, ocr=True, ocr_by=0.3)
    assert order(read)[:2] == ["b", "c"] and {"pre_hint_code_score", "pre_ocr_code_score"} <= set(read.columns)
    assert order(rerank.recognize(cards, query(spark, hint_language="en"), language=True, language_by=0.5))[0] == "c"
    second = rerank.recognize(cards, query(spark), second=lambda h: h.withColumn("second", F.when(F.col("card_id") == "d", 1.0).otherwise(0.0)), weight=1.0)
    assert order(second)[0] == "d"
    visual = rerank.recognize(cards, query(spark), visual=lambda h: h.withColumn("visual", F.when(F.col("card_id") == "a", 0.0)), weight=0.9)
    assert order(visual) == ["b", "c", "a", "d"]
    assert order(rerank.recognize(cards, query(spark), top_k=2)) == ["a", "b"]


def test_choice_names_look_alikes_and_codes_settle_it(spark, cards):
    open_ = rerank.choose(rerank.recognize(cards, query(spark))).collect()
    assert [(r.status, r.recommended_id, r.candidates) for r in open_] == [("needs_user_choice", "a", ["a", "b"])]
    settled = rerank.choose(rerank.recognize(cards, query(spark, ocr_set="SV1", ocr_code="002"), ocr=True, ocr_by=0.001)).collect()
    assert [(r.status, r.recommended_id) for r in settled] == [("resolved_by_card_code", "b")]


def test_cards_of_a_photo_are_queries_of_their_own(spark, cards):
    d = spark.createDataFrame([(5, 0, 0.9, 300.0, 50.0, 60.0, [0.0, 1.0]), (5, 1, 0.8, 100.0, 50.0, 60.0, [1.0, 0.0]), (5, 2, 0.1, 100.0, 400.0, 60.0, [1.0, 0.0])], "photo_id bigint, ordinal int, confidence double, center_x double, center_y double, height double, vector array<double>")
    got = {(r.photo_id, r.card_index, r.confidence_rank, r.card_id) for r in rerank.recognize_cards(d, cards, least=0.5, top_k=1).collect()}
    assert got == {(5, 2, 1, "d"), (5, 1, 2, "a")}


def test_indexes_of_two_models_are_refused(spark, cards):
    assert vectors.one_model(cards).first().asDict() == {"indexes": 3, "rows": 4, "dimensions": 2}
    with pytest.raises(Exception, match="several models"):
        vectors.one_model(cards.withColumn("embedding", F.slice("embedding", 1, F.when(F.col("row_id") == 2, 1).otherwise(2)))).collect()
    with pytest.raises(Exception, match="several models"):
        vectors.one_model(cards.withColumn("model_name", F.col("game"))).collect()


def test_only_the_selected_picture_lists_the_others(spark):
    rows = spark.range(50).select(F.concat(F.lit("canonical:"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("canonical_id"), F.col("id").cast("string").alias("canonical_key"), F.lit("tcgdex").alias("canonical_source"), F.lit("c").alias("card_id"), F.lit("1").alias("card_code"), F.when(F.col("id") > 0, "s").alias("set_id"), F.lit(None).cast("string").alias("name_ja"), F.lit("tcgdex").alias("image_source"), F.lit("/p").alias("local_image_path"), F.when(F.col("id") < 48, "h").alias("image_sha256"), F.lit(True).alias("has_index_image"))
    out = {r.canonical_key: r for r in canonical.select_images(rows).collect()}
    assert len(out) == 50
    first = out["1"]
    assert first.index_image_selected and first.duplicate_image_count == 47
    assert [r.canonical_key for r in first.duplicate_image_records] == [str(i) for i in [*range(2, 48), 0]]
    assert all(not r.index_image_selected and r.duplicate_image_count == 0 and r.duplicate_image_records == [] for k, r in out.items() if k != "1")
    assert out["2"].excluded_from_index_reason == "duplicate_image_sha256" and out["49"].excluded_from_index_reason is None


def test_first_rows_are_counted(spark):
    d = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), (None, 3, "z"), (None, 4, "w")], "k string, o int, v string")
    assert {(r.k, r.o, r.v, r.skipped) for r in records.first_with_count(d, ["k"], "o").collect()} == {("a", 1, "x", 1), (None, 3, "z", 1)}
    assert records.distinct_counts(d, "k", "v").first().asDict() == {"k": 1, "v": 4}


def test_vectors_and_exports_are_written_whole(spark, cards, tmp_path):
    import sqlite3

    sinks.write_vectors(cards, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 4
    assert sinks.write_sqlite(cards.drop("embedding"), str(tmp_path / "c.db"), indexes=("card_id",)) == 4
    assert sqlite3.connect(tmp_path / "c.db").execute("select count(*) from cards").fetchone() == (4,)
    assert sinks.write_sqlite(cards.drop("embedding").limit(0), str(tmp_path / "e.db")) == 0
