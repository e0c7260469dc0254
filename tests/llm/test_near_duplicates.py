import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from llm import brute
from pyspark.sql import functions as F

from stationcare.llm import fingerprint, jaccard_join
from stationcare.llm.components import connected
from stationcare.llm.text import Permutations, buffers, shingle_hashes


def test_shingles_follow_the_word_rule():
    texts = ["One two, three four five SIX.", "one two", None, "", "...", "straße ÉTÉ 5x", "a a a a a a a"]
    hashes, at = shingle_hashes(*buffers(pa.array(texts)))
    sets = [set(hashes[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [len(s) for s in sets] == [len(brute.shingles(t)) for t in texts]
    again, _ = shingle_hashes(*buffers(pa.array(["one TWO"])))
    assert set(again.tolist()) == sets[1]
    other, _ = shingle_hashes(*buffers(pa.array(["straße été 5x"])))
    assert not set(other.tolist()) & sets[5], "letters beyond A-Z keep their case"


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1600], rng.integers(0, 2**64, 400, dtype=np.uint64)])
    sig = Permutations(512).signatures(np.concatenate([a, b]), np.array([0, 2000, 4000]))
    assert abs((sig[0] == sig[1]).mean() - 1600 / 2400) < 0.08


def test_bands_reach_the_recall():
    plan = jaccard_join.bands_for(0.8, 0.9999, 192)
    assert plan.chance(0.8) >= 0.9999 and plan.bands * plan.rows <= 192
    assert jaccard_join.Bands(192 // (plan.rows + 1), plan.rows + 1).chance(0.8) < 0.9999
    with pytest.raises(ValueError):
        jaccard_join.bands_for(0.1, 0.999999, 2)


@pytest.mark.parametrize("tile", [256, 3])
def test_classes_equal_all_pairs(docs, rows, tile):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_classes(docs, tile=tile).collect()}
    assert got == brute.classes(rows)


def test_fingerprint_bands_find_the_same(docs, rows):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in fingerprint.near_duplicates(docs).collect()}
    assert got == brute.classes(rows)


def test_chance_meetings_do_not_chain_groups(spark, docs, rows):
    """With one row a band nearly all texts meet: groups hold those in reach of the threshold all the same."""
    loose = jaccard_join.Bands(96, 1)
    signed = jaccard_join.set_signatures(docs.select("doc_id", "text"), loose, 5).cache()
    reps = signed.groupBy("hi", "lo").agg(F.min_by(F.struct("doc_id", "bands"), "doc_id").alias("r")).select(
        F.col("r.doc_id").alias("rep"), "r.bands")
    for tile in (256, 3):
        groups = {r["node"]: r["root"] for r in jaccard_join.near_groups(reps, signed, 0.8, tile).collect()}
        assert len(set(groups.values())) > 1
        sets = {i: brute.shingles(t) for i, t in rows}
        for a, b in itertools.combinations([r["rep"] for r in reps.select("rep").collect()], 2):
            likeness = brute.jaccard(sets[a], sets[b])
            if likeness >= 0.8:
                assert groups[a] == groups[b]
            elif likeness < 0.2 and groups.get(a, -1) == groups.get(b, -2):
                near = [c for c in sets if groups.get(c) == groups[a] and c not in (a, b)
                        and brute.jaccard(sets[a], sets[c]) > 0.3]
                assert near, f"{a} and {b} met by chance only"
    signed.unpersist()


def test_links_among_others_than_the_smallest_member_are_kept(spark):
    """A bucket whose smallest member resembles nobody still links the others."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    odd = " ".join(rng.choices(words, k=300))
    body = rng.choices(words, k=300)
    rows = [(0, odd)] + [(10 + k, " ".join(body[:150 + k] + ["x"] + body[150 + k:])) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = jaccard_join.set_signatures(df, jaccard_join.Bands(4, 48), 5)
    # all in one bucket, as a chance collision would have it
    reps = signed.select(F.col("doc_id").alias("rep"), F.array(F.lit(1).cast("long")).alias("bands"))
    for tile in (256, 4, 2):
        groups = {r["node"]: r["root"] for r in jaccard_join.near_groups(reps, signed, 0.8, tile).collect()}
        assert {k: v for k, v in groups.items() if k != v} == {10 + k: 10 for k in range(1, 6)}
        assert 0 not in groups or groups[0] == 0


def test_classes_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_classes(none).collect() == []
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b"), (2, "c"), (3, None), (4, "")],
                                "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_classes(odd).collect()),
                 key=str)
    assert got == sorted([(None, None, 0), (None, None, 0), (1, 1, 1), (1, 1, 1), (2, 2, 0), (3, 3, 1), (4, 3, 1)],
                         key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (300, 301)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 300: 300, 301: 300}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("buckets", [None, 5])
def test_edited_fingerprints(docs, rows, buckets):
    import hashlib

    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(docs, buckets=buckets).collect()}
    order = sorted(rows, reverse=True)
    assert set(got) == {i for i, _ in rows}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        truth = brute.jaccard(brute.shingles(text), brute.shingles(edited))
        if brute.shingles(text) and brute.shingles(edited):
            assert abs(got[i]["near_edited"] - truth) < 0.2
        same = [a == b for a, b in zip(*[[x[j:j + 4] for j in range(0, 512, 4)] for x in
                (got[i]["fingerprint"], got[order[(k + 1) % len(order)][0]]["fingerprint"])], strict=True)]
        assert got[i]["near_next"] == sum(same) / len(same)
    prints = {}
    for i, text in rows:
        assert prints.setdefault(text or "", got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_edited_fingerprints_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert fingerprint.edited_fingerprints(spark.createDataFrame([], schema)).collect() == []
    one = fingerprint.edited_fingerprints(spark.createDataFrame([(5, "abcd")], schema)).collect()
    import hashlib

    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one[0]["near_next"] == 1.0
    odd = spark.createDataFrame([(None, "x y"), (None, None), (3, "a"), (3, "a"), (3, "b")], schema)
    assert len(fingerprint.edited_fingerprints(odd, buckets=3).collect()) == 5


def test_texts_of_one_hot_doc_id_spread_over_buckets(spark):
    from stationcare.operators.ordered import bucketed

    rows = [(7 if i % 3 else i, f"text number {i} of many") for i in range(900)] + [(None, f"nameless {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = [r["count"] for r in bucketed(df.selectExpr("doc_id", "xxhash64(text) AS h"), ["doc_id", "h"], buckets=12)
             .groupBy("_bucket").count().collect()]
    assert max(sizes) < 300
    one, many = (sorted(map(tuple, fingerprint.edited_fingerprints(df, buckets=n).collect()), key=str) for n in (1, 12))
    assert one == many and len(one) == 1200
