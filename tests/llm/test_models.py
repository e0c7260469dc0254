import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm.conftest import prose

from stationcare.llm import language, quality
from stationcare.llm.text import buffers

SF = "/root/testdata/sf0.01"


def test_statistics_do_not_depend_on_the_batch(rows):
    texts = [t for _, t in rows]
    whole = quality.statistics(*buffers(pa.array(texts)))
    assert np.isfinite(whole).all() and whole.shape == (len(texts), len(quality.FEATURES))
    for k in (0, 60, len(texts) - 3, len(texts) - 1):
        alone = quality.statistics(*buffers(pa.array([texts[k]], pa.string())))
        assert np.allclose(alone[0], whole[k])


def test_shrunk_factors_and_margin():
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (300, 4)), rng.normal(0.5, 2, (500, 4))]
    counts = np.array([300.0, 500.0])
    means, factors = quality.shrunk(counts, np.stack([a.sum(axis=0) for a in x]), np.stack([a.T @ a for a in x]), 0, 0)
    for k in (0, 1):
        cov = np.cov(x[k].T, bias=True) + quality.RIDGE * np.eye(4)
        assert np.allclose(factors[k] @ factors[k].T, cov)
    model = quality.Discriminant(means, factors, np.log(5 / 3), 1.0)
    point = rng.normal(0, 1, (7, 4))

    def density(k):
        cov = factors[k] @ factors[k].T
        z = point - means[k]
        return -0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1]

    assert np.allclose(model.margin(point), density(1) - density(0) + np.log(5 / 3))


def test_quality_on_held_out_rows(spark):
    from __spark_entry__ import queries

    got = {r["doc_id"]: r for r in queries()["op3_quality_classifier"](spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()
              if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(got[r["doc_id"]]["held_out"] for r in labels)
    right = [got[r["doc_id"]]["predicted"] == r["quality"] for r in labels]
    assert np.mean(right) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_quality_of_odd_tables(spark, docs, rows):
    labels = spark.createDataFrame([(0, 1), (None, 1), (9999, 0), (1, None), (2, 5)], "doc_id long, quality int")
    scored, model = quality.judge(docs, labels)
    got = scored.collect()
    assert model is None and len(got) == len(rows) and {r["score"] for r in got} == {0.5}
    scored, _ = quality.judge(docs.limit(0), labels)
    assert scored.collect() == []
    rng = random.Random(2)
    many = spark.createDataFrame([(i, prose(rng, 30) if i % 2 else "!!! $$$ " * 20) for i in range(60)]
                                 + [(None, None), (61, ""), (61, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality long")
    scored, model = quality.judge(many, marks)
    got = scored.collect()
    assert model is not None and len(got) == 63 and not any(np.isnan(r["score"]) for r in got)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 60)


def test_language_on_held_out_rows(spark):
    from __spark_entry__ import queries

    got = {r["doc_id"]: r for r in queries()["op8_language_id"](spark, SF).collect()}
    truth = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()
             if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in truth) and len(truth) < len(got)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in truth]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_odd_texts(spark):
    train = spark.createDataFrame([(1, "the quick brown fox and the lazy dog " * 9, "en"), (2, None, "en"),
                                   (3, "der schnelle braune fuchs und der faule hund " * 9, "de"), (4, "x", None),
                                   (None, "", "fr")], "doc_id long, text string, lang string")
    model = language.fit(train)
    assert sorted(model.texts) == ["de", "en"]
    odd = [(1, None), (2, ""), (3, "123 ² Ⅷ !!!"), (4, "The lazy dog and the quick fox"),
           (None, "der faule Hund und der braune Fuchs"), (4, "日本語"), (5, "the dog " * 40_000)]
    got = language.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    said = [r["lang_pred"] for r in sorted(got, key=lambda r: str(r["doc_id"]))]
    assert len(got) == 7 and said.count("und") == 3 and "de" in said and said.count("en") >= 2
    assert all(r["score"] == 0 and r["rejected"] for r in got if r["lang_pred"] == "und")
    none = language.fit(train.limit(0))
    assert {r["lang_pred"] for r in language.predict(spark.createDataFrame(odd, "doc_id long, text string"),
                                                     none).collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 3])
def test_dictionaries_are_bounded(spark, n):
    rng = random.Random(4)
    rows = [(i, prose(rng, 400), "aa" if i % 2 else "bb") for i in range(40)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), texts=n)
    assert all(0 < len(t) <= n * (language.SAMPLE_CHARS + 1) * 2 for t in model.texts.values())


def test_draw_spreads_over_texts_of_one_doc_id(spark):
    rng = random.Random(6)
    rows = [(None, prose(rng, 300), "aa") for _ in range(3000)] + [(7, "the same text again " * 20, "bb")] * 5000
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.drawn(table).collect()
    counts = {k: sum(r["lang"] == k for r in got) for k in ("aa", "bb")}
    assert counts == {"aa": language.SAMPLE_TEXTS, "bb": 1}
    whole = {t for _, t, lang in rows if lang == "aa"}
    aa = [r["text"] for r in got if r["lang"] == "aa"]
    assert all(len(t) <= language.SAMPLE_CHARS for t in aa)
    assert sum(any(t.startswith(x) for t in whole) for x in aa[:40]) < 20
    model = language.fit(table)
    room = language.PARTS * language.DICTIONARY_BYTES
    share = room // language.SAMPLE_TEXTS - 1
    assert len(model.texts["aa"]) <= room and all(language.fold(t)[:share] in model.texts["aa"] for t in aa)


def test_prediction_equals_plain_sizes(spark):
    """Sizes of 50 texts, recomputed one by one with coders made here."""
    import zstandard

    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(table.select("doc_id", "text", "lang"))
    some = [r for r in table.select("doc_id", "text").orderBy("doc_id").limit(50).collect() if r["text"]]
    extra = spark.createDataFrame([(r["doc_id"], r["text"], "x", 1.0) for r in some],
                                  "doc_id long, text string, lang_pred string, score double")
    got = {r["doc_id"]: r for r in language.predict(extra, model).collect()}
    assert len(got) == len(some)
    size = language.DICTIONARY_BYTES

    def plain(raw, level, parts):
        sums = {}
        for lang, text in model.texts.items():
            sums[lang] = 0
            for k in range(parts):
                content = text[k * size:(k + 1) * size]
                known = zstandard.ZstdCompressionDict(content if len(content) >= size // 2 else text[:size],
                                                      dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                for at in range(0, len(raw), language.BLOCK_BYTES):
                    coder = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False,
                                                     write_checksum=False, write_dict_id=False)
                    sums[lang] += len(coder.compress(raw[at:at + language.BLOCK_BYTES]))
        first, second = sorted(sums.values())[:2]
        return min(sorted(sums), key=sums.get), (second - first) / second

    for r in some:
        raw = language.fold(r["text"])
        lang, margin = plain(raw, language.LEVEL, 1)
        if margin < language.NARROW or len(raw) < language.SHORT_BYTES:
            lang, margin = plain(raw, language.SECOND_LEVEL, language.PARTS)
        assert got[r["doc_id"]]["margin"] == pytest.approx(margin, abs=0.002)
        assert got[r["doc_id"]]["lang_pred"] == lang or margin < 0.002
    assert language.predict(extra.limit(0), model).collect() == []
