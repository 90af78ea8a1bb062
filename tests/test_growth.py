"""Steps whose cost must follow the rows that go in, not the pairs of their copies."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotwise.functions import text as X
from lotwise.operators import geometry, lookup, matching, vectors
from lotwise.plans import catalog_queries


def joined_rows(spark, df):
    """(rows, the most rows that a join of the run gave)."""
    found = df.collect()
    store = spark._jsparkSession.sharedState().statusStore()
    run = store.executionsList().last().executionId()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    values, most = store.executionMetrics(run), 0
    nodes = store.planGraph(run).allNodes()
    for n in (nodes.apply(i) for i in range(nodes.size())):
        if "Join" in n.name():
            for m in (n.metrics().apply(i) for i in range(n.metrics().size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return found, most


def _catalog(spark, copies):
    rec = [(f"P{i}", None, None, f"SV{i % 2}", "5", ("Fire Fox", "Ice Fox")[i // 2 % 2], None, None, None, "pokemon_ja", "ja", i) for i in range(4 * copies)]
    r = spark.createDataFrame(rec, "product_id string, canonical_id string, card_id string, set_id string, card_code string, name string, name_en string, name_ja string, product_name string, index_name string, language string, row_id bigint")
    look = [(i, f"P{i}" if i % 3 == 0 else None, None, None, f"SV{i % 2}" if i % 3 == 1 else None, "5" if i % 3 else None, "Fox Ice" if i % 3 == 2 else None, None, "ja", False) for i in range(3 * copies)]
    return r, spark.createDataFrame(look, "lookup_id bigint, product_id string, canonical_id string, card_id string, set_id string, card_code string, subject string, title string, language string, label boolean")


def test_lookups_of_copies_are_answered_once(spark):
    copies = 100
    r, q = _catalog(spark, copies)
    got, most = joined_rows(spark, lookup.lookup(r, q))
    want = set()
    for i in range(3 * copies):
        fit = {0: lambda x, i=i: x == i, 1: lambda x, i=i: x % 2 == i % 2, 2: lambda x: x // 2 % 2 == 1}[i % 3]
        score = (1.0, 0.96, 0.72)[i % 3]
        want |= {(i, n + 1, score, x) for n, x in enumerate([x for x in range(4 * copies) if fit(x)][:5])}
    assert {(h.lookup_id, h.rank, h.score, h.row_id) for h in got} == want
    assert most <= 5 * 3 * copies


def test_lookups_are_not_broadcast(spark, tmp_path):
    """A compressed table looks small enough, and what is made of it isn't."""
    r, q = _catalog(spark, 5)
    r.write.parquet(f"{tmp_path}/r")
    q.write.parquet(f"{tmp_path}/q")
    plan = lookup.lookup(spark.read.parquet(f"{tmp_path}/r"), spark.read.parquet(f"{tmp_path}/q"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_of_one_id_every_path_gives_a_record_once(spark):
    """What is found by its id as well as by set and number or by name stands once, at its best score."""
    rec = [("P1", None, "K", "SV1", "5", "Fox", None, None, "Fox", "pokemon_ja", "ja", i) for i in range(7)] + [("P2", None, "", "SV1", "5", "Fox", None, None, "Fox", "pokemon_ja", "ja", 9)]
    r = spark.createDataFrame(rec, "product_id string, canonical_id string, card_id string, set_id string, card_code string, name string, name_en string, name_ja string, product_name string, index_name string, language string, row_id bigint")
    look = [(1, "P2", None, "", "SV1", "5", None, None, "ja", False), (2, "P2", None, "", None, "5", "Fox", None, "ja", False), (3, None, None, "", None, "5", "Fox", "Fox", "ja", False)]
    q = spark.createDataFrame(look, "lookup_id bigint, product_id string, canonical_id string, card_id string, set_id string, card_code string, subject string, title string, language string, label boolean")
    got = sorted((h.lookup_id, h.rank, h.score, h.row_id) for h in lookup.lookup(r, q).collect())
    first = lambda i, s: [(i, 1, 1.0, 9), *[(i, n + 2, s, n) for n in range(4)]]
    assert got == [*first(1, 0.96), *first(2, 0.72), *[(3, n + 1, 0.92, n) for n in range(5)]]


def test_polygon_values_are_worked_out_once(spark):
    """The expression that makes a polygon, and the sums over it, stand once in the plan."""
    df = spark.createDataFrame([([[10.0, 20.0], [50.0, 20.0], [50.0, 80.0], [10.0, 80.0]],)], "p array<array<double>>")
    p = F.reverse("p")
    for made, sums in ((geometry.order_corners(p), 0), (geometry.expand_polygon(p, 4.0, F.lit(200), F.lit(100)), 2), (geometry.polygon_geometry(p, F.lit(200), F.lit(100)), 3)):
        plan = df.select(made.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("reverse(") == 1 and plan.count("aggregate(") == sums


def _gated(spark, seed, n):
    rng = random.Random(seed)
    pick = rng.choice
    url = lambda: pick([None, "https://x.example/a.png", "https://x.example/OPC-EN-TCG/a_p1.png", "https://x.example/a_r2.png"])
    cards = [(f"c{i}", "S", pick(["A-1", "A-2", "A-3", None]), pick(["en", "ja"]), pick(["Fox", "Ice", "fox!", "", "Fox (Parallel)"]), None, pick(["R", "SR", "SP CARD"]), url(), i) for i in range(n)]
    title = lambda c: f"{pick(['Fox', 'FOX', 'Ice', 'Old', '', 'Bo', 'Cy', 'Di', 'Eve'])} {pick(['R', 'SR', 'C', 'none'])}{pick(['', '-P', '-SP'])}{pick(['', ': Comic Parallel', ' more', ' Parallel'])} [{pick([c, c, c, 'B-9'])}]{pick(['', '[EN]', '[KR]'])}"
    products = [(c, f"p{rng.randrange(n)}", title(c), url(), pick([1.0, None]), "f") for c in (pick(["A-1", "A-2"]) for _ in range(4 * n))]
    return (
        spark.createDataFrame(cards, "card_id string, set_id string, card_code string, language string, name string, name_en string, rarity string, image_url string, ordinal int"),
        spark.createDataFrame(products, "card_code string, product_id string, product_name string, thumbnail_url string, min_price double, min_price_format string"),
    )


@pytest.mark.parametrize("seed", range(2))
def test_classes_match_as_single_pairs_do(spark, seed):
    cards, products = _gated(spark, seed, 60)
    judged = {}
    for j in matching.judge_candidates(cards, products).collect():
        judged.setdefault(j.card_id, []).append(j)
    place = lambda j: [(v is not None, v) for v in ((j.product_name or "").lower(), j.product_id, j.product_name, j.thumbnail_url, j.min_price, j.min_price_format)]
    whys = set()
    for m in matching.match_by_gates(cards, products).collect():
        own = sorted(judged.get(m.card_id, []), key=place)
        good, bad = [j for j in own if j.ok], [j for j in own if not j.ok]
        reasons = [r for j in bad for r in j._reasons]
        assert [(v.product_id, v.product_name, v.reasons) for v in m.verified_candidates] == [(j.product_id, j.product_name, j._reasons) for j in good]
        assert (m.candidate_count, m.rejected_count, m.reject_reason_counts) == (len(good), len(bad), {r: reasons.count(r) for r in reasons})
        assert m.reject_reason_group_counts == {g: sum(r.split(":")[0] == g for r in reasons) for g in {r.split(":")[0] for r in reasons}}
        assert [(v.product_id, v.product_name, v.reasons) for v in m.rejected_examples] == [(j.product_id, j.product_name, j._reasons) for j in bad[:5]]
        assert m.product_id == (good[0].product_id if len(good) == 1 else None)
        top = max(dict.fromkeys(reasons), key=reasons.count, default=None)
        want = f"verified_candidate_count:{len(good)}" if len(good) > 1 else None if good else top or "search_returned_no_exact_code_products"
        assert m.unmatched_reason_detail == want
        whys.add(m.unmatched_reason)
    assert len(whys) >= 4


def test_copies_are_judged_once(spark):
    cards, products = _gated(spark, 2, 20)
    copies = F.explode(F.sequence(F.lit(1), F.lit(40)))
    again = lambda df, key: df.withColumn("_i", copies).withColumn(key, F.concat(key, F.lit("x"), F.col("_i").cast("string"))).drop("_i")
    many = matching.match_by_gates(again(cards, "card_id"), again(products, "product_id")).select("card_id", "match_status", "candidate_count", "rejected_count", "reject_reason_counts")
    found, most = joined_rows(spark, many)
    one = {r.card_id: r for r in matching.match_by_gates(cards, products).collect()}
    assert len(found) == 800 and all((r.candidate_count, r.rejected_count) == (40 * one[c].candidate_count, 40 * one[c].rejected_count) for r in found for c in [r.card_id.split("x")[0]])
    assert most <= 1600


def test_references_of_copies_are_found_once(spark):
    cards = spark.createDataFrame([(f"c{i}", "SV1", str(i % 2 + 1)) for i in range(200)], "card_id string, set_id string, card_code string")
    p = spark.createDataFrame([("SV1", f"p{i}", f"x [SV1 00{i % 3}/060]") for i in range(300)], "set_id string, product_id string, product_name string").selectExpr("*", "'t' thumbnail_url", "1.0 min_price", "'f' min_price_format")
    found, most = joined_rows(spark, matching.match_by_reference(cards, p).select("card_id", "candidate_count", "match_status"))
    assert {(r.candidate_count, r.match_status) for r in found} == {(100, "multiple_verified_matches")} and len(found) == 200
    assert most <= 300
    whole = matching.match_by_reference(cards.limit(2), p).collect()
    assert [len(r.verified_candidates) for r in whole] == [100, 100]


def test_titles_keep_what_is_no_named_entity(spark, tmp_path):
    """As the query's SQL has it: an entity ends with its semicolon."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["a&amp", "a &amp; b", "&amp;lt;", "&nbsp;x&nbsp;&nbsp;y ", "&eacute;&#39;&#65;", "x\u00a0 \u3000y\t\nz", "\u000bq", " &lt;b&gt; ", "", "&copy 1"]
    pages = [(i, "u", f'<html lang="en"><title>{t}</title></html>') for i, t in enumerate(texts)] + [(90, "u", None), (91, "u", "<p>")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in catalog_queries.q22_html_fields(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(db.execute(catalog_queries.SQL["q22_html_fields"]).fetchall()) and got[0][2] == "a&amp"


@pytest.mark.parametrize("block", [64, 10**6])
@pytest.mark.parametrize("reach", [1, 30])
def test_merged_hits_need_no_more_of_an_index(spark, monkeypatch, block, reach):
    """With ties in plenty (reach 1), and in steps smaller than the tables."""
    rng = np.random.default_rng(5)
    v = rng.integers(-reach, reach + 1, (300, 4)).astype(float)
    df = spark.createDataFrame([(int(i % 3), i, v[i].tolist()) for i in range(300)], "index_name int, row_id bigint, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(40)], "query_id bigint, vector array<float>")
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", block)
    got = sorted(map(tuple, vectors.merge(vectors.search(df, q, 5, most=7), 7).select("query_id", "rank", "index_name", "row_id", "score", "index_rank").collect()))
    want = []
    for a in range(40):
        of = lambda x, a=a: sorted((-float(v[a] @ v[i]), x, i) for i in range(300) if i % 3 == x)[:5]
        hits = sorted((s, x, n + 1, i) for x in range(3) for n, (s, x, i) in enumerate(of(x)))
        want += [(a, n + 1, x, i, -s, r) for n, (s, x, r, i) in enumerate(hits[:7])]
    assert got == sorted(want)


@pytest.mark.parametrize("most", [None, 12])
def test_search_keeps_little_in_memory(most):
    rng = np.random.default_rng(6)
    m, q = rng.standard_normal((20_000, 16)), rng.standard_normal((1500, 16))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(20_000) % 2), pa.array(np.arange(20_000)), pa.array(list(m.astype(np.float32)))], ["index_name", "row_id", "embedding"])
    run = vectors._scan(np.arange(1500), q, 10, most)
    tracemalloc.start()
    got = [r for b in run([batch]) for r in zip(*[c.to_pylist() for c in b.columns])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    s = m.astype(np.float32).astype(float) @ q.T
    for a in range(0, 1500, 97):
        own = {(x, r) for i, x, r, _ in got if i == a}
        best = [sorted(((s[r, a], x, r) for r in range(x, 20_000, 2)), reverse=True)[:10] for x in range(2)]
        need = sorted(best[0] + best[1], reverse=True)[:most]
        assert {(x, r) for _, x, r in need} <= own and len(own) <= 30


def test_labels_are_parsed_in_one_pass(spark):
    """The label's text is repaired once for the whole and once for its lines, not once for each field that is read of it."""
    df = spark.createDataFrame([("2021 POKEMON JAPANESE PACK SV-P PROMO\nFOX EX\n#012\nGEM MT\n12345678",), (None,)], "t string")
    made = df.select(X.parse_label(F.reverse(F.reverse("t")), by_line=True).alias("p"))
    assert made._jdf.queryExecution().analyzed().toString().count("reverse(") == 4
    got = [r.p for r in made.collect()]
    assert (got[0].card_number, got[0].subject, got[0].set_title, got[0].language, got[0].set_id) == ("012", "FOX EX", "PACK SV-P PROMO", "ja", "SV-P")
    assert got[1].subject is None and got[1].card_number is None


def test_overlaps_gather_little_at_once():
    """Long texts, that hold every word of many items."""
    every = [f"w{i}" for i in range(2000)]
    items = pa.table({"item": list(range(300)), "words": [every[6 * i : 6 * i + 40] for i in range(300)]})
    batch = pa.RecordBatch.from_pydict({"key": list(range(128)), "words": [every[i:] for i in range(127)] + [["none"]]})
    run = matching._overlaps(items, "key", "item")
    tracemalloc.start()
    got = [r for b in run([batch]) for r in zip(*[c.to_pylist() for c in b.columns])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(i, -(-i // 6), 40, 1.0) for i in range(127)] and peak < 60e6


def test_nearest_codes_are_those_of_all_pairs(spark):
    """With ties in plenty and labels smaller than the number wanted; no pair becomes a row."""
    rng = random.Random(8)
    codes = [(i, 0 if i < 400 else 1 + i % 5, rng.getrandbits(62) & 0xFF00FF) for i in range(412)]
    found, most = joined_rows(spark, vectors.hamming_top(spark.createDataFrame(codes, "vec_id bigint, label int, code bigint"), 3))
    want = []
    for i, label, code in codes:
        near = sorted((bin(code ^ c).count("1"), x) for x, own, c in codes if own == label and x != i)[:3]
        want += [(i, x, 1 - d / 64, n + 1) for n, (d, x) in enumerate(near)]
    assert sorted((r.query_id, r.row_id, r.similarity, r.rank) for r in found) == sorted(want)
    assert most <= 420 * 30
