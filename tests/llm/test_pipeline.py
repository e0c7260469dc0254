"""Each stage against a brute-force version of it, and the whole run on tables of its own."""

import random

import pytest
from llm import brute
from llm.conftest import altered, prose

import corpus_pipeline
from stationcare.llm import quality


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, labels and benchmark with nulls, repeated rows, junk, copies, passages and leaks."""
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randint(60, 200))) for i in range(80)]
    rows += [(100 + i, "!!! $$$ ### &&& " * rng.randint(5, 40)) for i in range(40)]
    rows += [(200 + i, rows[i][1]) for i in range(6)] + [(210 + i, altered(rng, rows[20 + i][1], 0.005)) for i in range(6)]
    passage, item = prose(rng, 80), prose(rng, 25)
    rows += [(300 + i, prose(rng, 50) + " " + passage + " " + prose(rng, 50)) for i in range(4)]
    rows += [(400 + i, prose(rng, 50) + " " + item + " " + prose(rng, 50)) for i in range(3)]
    rows += [(500, None), (501, ""), (None, prose(rng, 50)), (None, None), (7, rows[7][1]), (7, rows[7][1])]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, "en", None if (i or 0) % 5 == 0 else "s", None if t is None else len(t), "x", "y") for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, _id string, "
                                "text_hash string").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if 100 <= i < 140 else 1, 0) for i in [*range(0, 80, 2), *range(100, 140)]] + [(None, 1, 0), (1, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def _docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def _rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_quality_drops_what_the_model_rejects(spark, tables):
    folder, _ = tables
    docs = _docs(spark, folder)
    got = corpus_pipeline.quality(spark, docs, folder)
    assert got.columns == docs.columns
    scored, model = quality.judge(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {(r["doc_id"], r["text_hash"]) for r in scored.collect() if r["predicted"] == 0}
    want = [(r["doc_id"], r["text"]) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
            if (r["doc_id"], r["h"]) not in bad]
    assert model is not None and _rows(got) == sorted(want, key=str)
    ids = {r["doc_id"] for r in got.collect()}
    assert not ids & set(range(100, 140)) and set(range(80)) <= ids


def test_near_duplicates_keep_one_of_each_group(spark, tables):
    folder, _ = tables
    docs = _docs(spark, folder)
    got = corpus_pipeline.near_duplicates(spark, docs, folder)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    classes = brute.classes({(i, t) for i, t in rows if i is not None})
    want = {(i, t) for i, t in rows if i is not None and classes[i][0] == i}
    assert got.columns == docs.columns
    assert _rows(got) == sorted([*want, *[(i, t) for i, t in rows if i is None]], key=str)


def test_passages_go_from_later_documents(spark, tables):
    folder, _ = tables
    docs = _docs(spark, folder).filter("doc_id >= 300 and doc_id < 400 or doc_id < 80 or doc_id >= 500 or doc_id is null")
    got = corpus_pipeline.repeated_passages(spark, docs, folder)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r for r in got.collect()}
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert set(after) == set(before)
    for i, r in after.items():
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        if i is not None and 301 <= i < 304:
            assert len(r["text"]) < len(before[i]) - 200
        elif i is not None:
            assert r["text"] == before[i]


def test_contaminated_documents_go(spark, tables):
    folder, item = tables
    docs = _docs(spark, folder)
    got = corpus_pipeline.benchmark_passages(spark, docs, folder)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    hit = {(r[0], t) for r, (_, t) in zip(brute.contamination(rows, [(1, item)]), rows, strict=True) if r[5]}
    assert {i for i, _ in hit} == {400, 401, 402} and got.columns == docs.columns
    assert _rows(got) == sorted([x for x in rows if x not in hit], key=str)


def test_run_equals_the_stages(spark, tables):
    folder, _ = tables
    docs = _docs(spark, folder)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    want = {r["doc_id"] for r in docs.select("doc_id").collect()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == want
    assert not want & set(range(100, 140)) and not want & {400, 401, 402, 200, 210}
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert all(total[r["doc_id"]] == r["doc_tokens"] for r in got if r["doc_id"] is not None)


def test_empty_tables(spark, tables, tmp_path):
    folder, _ = tables
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stage_list():
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None


def test_other_texts_of_a_doc_id_are_no_duplicates(spark):
    rng = random.Random(33)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(1, a), (2, b), (2, a), (3, c), (3, d), (3, d), (None, a)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert _rows(got) == sorted([(1, a), (2, b), (3, c), (3, d), (None, a)], key=str)
