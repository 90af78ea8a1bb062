import random
import re

import pyarrow as pa

import corpus_pipeline as P
from lotwise.llm import common, license_scan, packing, simhash_dedup, suffix_trees

from .conftest import prose, table
from .test_quality_rules import corpus as labelled


def small_tables(spark, folder):
    rng = random.Random(12)
    texts, labels = labelled(rng, 400)
    n = len(texts)
    passage, item = prose(rng, 70), prose(rng, 40)
    clean = [" ".join(prose(rng, 90)) for _ in range(20)]
    copies = [clean[0], clean[0].replace(clean[0].split()[40], "edited"), clean[1]]
    shared = [" ".join(prose(rng, 50) + passage + prose(rng, 50)) for _ in range(3)]
    leaks = [" ".join(prose(rng, 50) + item + prose(rng, 50))]
    more = clean + copies + shared + leaks
    docs = table(spark, texts + more)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    at = {"clean": range(n + 1, n + 21), "copies": range(n + 21, n + 24), "shared": range(n + 24, n + 27), "leaks": range(n + 27, n + 28)}
    return docs, labels, at, passage


def test_every_stage_takes_effect(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs, labels, at, passage = small_tables(spark, folder)
    seen, df = [], docs
    for name, stage in P.STAGES:
        out = stage(spark, df, folder)
        path = f"{folder}/stage-{name}"
        out.write.parquet(path)
        df = spark.read.parquet(path)
        seen.append(df)
        if name != "packing":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"] and df.count() < docs.count()
    rules, near, cut, clean, packed = seen
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    bad = {i for i, q, t in labels if q == 0 or t == 1}
    good = {i for i, q, t in labels if q == 1 and t == 0}
    assert len(bad - ids[0]) >= 0.95 * len(bad) and len(good & ids[0]) >= 0.98 * len(good)
    assert set(at["clean"]) <= ids[1] and not set(at["copies"]) & ids[1]
    text = {r.doc_id: r.text for r in cut.collect()}
    assert sum(" ".join(passage) in text[i] for i in at["shared"]) == 1
    assert all(len(text[i].split()) in (100, 170) for i in at["shared"])
    assert not set(at["leaks"]) & ids[3] and set(at["clean"]) <= ids[3]
    words = {r.doc_id: len(re.findall("[0-9A-Za-z]+", r.text)) for r in clean.collect()}
    got = {}
    for r in packed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_words
    assert got == words
    rows = P.run(spark, folder).collect()
    assert {(r.doc_id, r.piece, r.n_words, r.text) for r in rows} == {(r.doc_id, r.piece, r.n_words, r.text) for r in packed.collect()}
    # the result alone gives back the cleaned texts and what is in each bin
    whole, bins = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        whole[r.doc_id] = whole.get(r.doc_id, "") + r.text
        assert len(re.findall("[0-9A-Za-z]+", r.text)) == r.n_words
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append((r.bin_start, r.n_words))
    assert whole == {r.doc_id: r.text for r in clean.collect()}
    for b in bins.values():
        assert all(x + n == y for (x, n), (y, _) in zip(sorted(b), sorted(b)[1:]))


def test_stages_of_an_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}"
    table(spark, []).write.parquet(f"{folder}/documents.parquet") if False else spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert P.run(spark, folder).count() == 0


def test_registry_names_each_operator_once():
    from lotwise.llm import registry

    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES) == list(range(1, 11)) and license_scan.TEMPLATES


def test_python_workers_hold_little(spark, monkeypatch):
    """A stage's batches are small, a smaller limit stays, and a kernel's worker gives its memory back, also when it is closed early."""
    key, docs = "spark.sql.execution.arrow.maxBytesPerBatch", table(spark, ["x" * (1 << 20)] * 12).coalesce(1)
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "2m")
        simhash_dedup.stage(spark, docs, "")
        assert spark.conf.get(key) == "2m"
        spark.conf.set(key, "64m")
        for stage in (simhash_dedup.stage, suffix_trees.stage, packing.stage):
            spark.conf.set(key, "64m")
            stage(spark, docs, "")
            sizes = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n bigint").collect()
            assert len(sizes) > 1 and max(r.n for r in sizes) <= common.BATCH_BYTES + (1 << 20) + 64
    finally:
        spark.conf.set(key, before)
    calls = []
    monkeypatch.setattr(common, "_give_back", lambda: calls.append(1))
    assert [*common.released(lambda batches: (2 * b for b in batches))(iter([1, 2]))] == [2, 4] and len(calls) == 1
    some = common.released(lambda batches: batches)(iter([1, 2]))
    next(some)
    some.close()
    assert len(calls) == 2
