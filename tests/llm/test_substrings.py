import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from llm import brute

from stationcare.llm import chunk_dedup, suffix_dedup
from stationcare.llm.text import buffers


def _answers(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect())


@pytest.mark.parametrize("most", [20_000, 2, 0])
def test_repeated_bytes_equal_brute_force(docs, rows, most):
    assert _answers(suffix_dedup.without_repeated_bytes(docs, most)) == sorted(brute.repeated_bytes(rows))


def test_repeated_bytes_at_the_limits(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = [base[:200] + "X", "Y" + base[:199] + "Z", base[100:420] + "!" + base[421:700], base[50:250], base,
             "é" * 150, "é" * 150 + "q", "aab" * 200, None, "", base[:199]]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    df = spark.createDataFrame([*rows, (None, base)], "doc_id long, text string")
    want = brute.repeated_bytes([*rows, (-1, base)])
    got = [(-1 if i is None else i, *rest) for i, *rest in
           [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
            for r in suffix_dedup.without_repeated_bytes(df).collect()]]
    assert sorted(got) == sorted(want)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.without_repeated_bytes(none).collect() == []


def test_deep_shallow_order_sorts():
    rng = random.Random(1)
    for shallow in (0, 8, 64):
        for _ in range(30):
            stem = bytes(rng.choices(b"ab", k=rng.randint(0, 90)))
            strings = [stem[:rng.randint(0, 90)] + bytes(rng.choices(b"abc", k=rng.randint(0, 12)))
                       for _ in range(rng.randint(1, 40))]
            strings += strings[:2]
            order = suffix_dedup.deep_shallow_order(strings, shallow)
            assert sorted(order) == list(range(len(strings)))
            assert [strings[i] for i in order] == sorted(strings)


def test_many_classes_of_one_gram_agree_with_pairs():
    rng = random.Random(2)
    gram = bytes(rng.choices(b"abcd", k=64))
    rights = [gram + bytes(rng.choices(b"a", k=rng.randint(60, 136))) + bytes(rng.choices(b"ab", k=3)) for _ in range(40)]
    lefts = [b"a" * rng.randint(0, 130) + bytes(rng.choices(b"ab", k=rng.randint(0, 6))) for _ in range(40)]
    near = [max(0, 200 - len(r)) for r in rights]
    keep = [i for i in range(40) if near[i] <= len(lefts[i])]
    args = [[x[i] for i in keep] for x in (rights, lefts)]
    few, suffix_dedup.PAIRWISE = suffix_dedup.PAIRWISE, 1000
    try:
        pairs = suffix_dedup.shared_windows(*args, [1] * len(keep), [near[i] for i in keep])
    finally:
        suffix_dedup.PAIRWISE = few
    assert suffix_dedup.shared_windows(*args, [1] * len(keep), [near[i] for i in keep]) == pairs
    assert any(pairs)


def _chunks(text):
    data, offsets = buffers(pa.array([text]))
    ends = chunk_dedup.chunk_ends(data, offsets)[0]
    raw = text.encode()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def test_gear_hash_is_the_rolling_sum():
    data = np.frombuffer(bytes(range(200)), np.uint8)
    want = 0
    got = chunk_dedup.gear_hashes(data)
    for i, b in enumerate(data):
        want = (want * 2 + int(chunk_dedup._GEAR[b])) & 0xFFFFFFFF
        assert got[i] == want


def test_chunks_cover_the_text_and_resist_shifts(rows):
    for _, text in rows:
        if text:
            assert b"".join(_chunks(text)) == text.encode()
            assert all(len(c) <= chunk_dedup.MAX_CHUNK for c in _chunks(text))
            for c in _chunks(text):
                c.decode()
    long = max((t for _, t in rows if t), key=len)
    before, after = set(_chunks(long)), set(_chunks("An inserted word or two " + long))
    assert len(before & after) > 0.95 * len(before)


def test_chunks_do_not_depend_on_the_batch(rows):
    texts = [t for _, t in rows if t]
    data, offsets = buffers(pa.array(texts))
    for text, ends in zip(texts, chunk_dedup.chunk_ends(data, offsets), strict=True):
        alone, own = buffers(pa.array([text]))
        assert chunk_dedup.chunk_ends(alone, own)[0] == ends


def test_later_passages_go_first_ones_stay(docs, rows):
    got = {r["doc_id"]: r for r in chunk_dedup.without_repeats(docs).collect()}
    assert set(got) == {i for i, _ in rows}
    text = dict(rows)
    for i in range(60):
        assert got[i]["text"] == text[i], "the first of all copies, and clean texts, stay"
    for i in range(100, 112):
        if len(text[i].encode()) >= chunk_dedup.MIN_RUN:
            assert got[i]["text"] == "" and got[i]["_removed"] == len(text[i].encode())
    assert got[300]["text"] == text[300]
    for i in range(301, 308):
        assert got[i]["_removed"] > 200 and len(got[i]["text"]) >= 70 * 3
    assert got[400]["text"] is None and got[401]["text"] == ""
    assert got[100]["key"] == "k" and got[100]["_id"] is None and got[100]["place"] == 100


def test_removal_equals_the_rule(docs, rows):
    """Brute force of the rule: a chunk's first place by (doc_id, start) stays, long enough runs of others go."""
    owner, places = {}, []
    for i, text in sorted(rows):
        at = 0
        for c in _chunks(text) if text else []:
            owner.setdefault(c, (i, at))
            places.append((i, at, c))
            at += len(c)
    gone = {}
    for i, at, c in places:
        if owner[c] != (i, at):
            runs = gone.setdefault(i, [])
            if runs and runs[-1][1] == at:
                runs[-1][1] += len(c)
            else:
                runs.append([at, at + len(c)])
    want = {}
    for i, text in rows:
        raw, parts, last = (text or "").encode(), [], 0
        runs = [r for r in gone.get(i, []) if r[1] - r[0] >= chunk_dedup.MIN_RUN]
        for a, b in runs:
            parts.append(raw[last:a])
            last = b
        kept = b"".join([*parts, raw[last:]])
        want[i] = (len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in chunk_dedup.removal_digest(docs).collect()}
    assert got == want


def test_chunk_dedup_of_odd_tables(spark):
    schema = "doc_id long, text string, _removed string"
    assert chunk_dedup.without_repeats(spark.createDataFrame([], schema)).collect() == []
    line = "a passage of text that is long enough to be cut into several chunks " * 5
    odd = spark.createDataFrame([(None, line, "x"), (None, line, "y"), (2, line, "z"), (2, line, "z"), (3, None, "n")],
                                schema)
    got = chunk_dedup.without_repeats(odd).collect()
    assert len(got) == 5 and all(r["text"] == line for r in got if r["doc_id"] is None)
    assert odd.columns[:2] + ["_removed", "_gone"] == chunk_dedup.without_repeats(odd).columns


def _bare(rng, n, kind):
    if kind == "base64":
        return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    low, high = {"chinese": (0x4E00, 0x9FA5), "thai": (0x0E01, 0x0E2E), "hiragana": (0x3041, 0x3096)}[kind]
    return "".join(chr(rng.randint(low, high)) for _ in range(n))


@pytest.mark.parametrize("kind", ["chinese", "thai", "hiragana", "base64"])
def test_passages_without_blanks_are_found(spark, kind):
    rng = random.Random(8)
    size = 400 if kind == "base64" else 150
    texts, planted = [], []
    for _ in range(40):
        passage = _bare(rng, size, kind)
        planted.append(len(passage.encode()))
        texts += [_bare(rng, rng.randint(100, 700), kind) + passage + _bare(rng, rng.randint(100, 700), kind)
                  for _ in range(2)]
    sizes = [len(c) for t in texts for c in _chunks(t)]
    assert 35 <= sum(sizes) / len(sizes) <= 65
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["_removed"] for r in chunk_dedup.without_repeats(df).collect()}
    assert all(got[i] == 0 for i in range(0, 80, 2))
    found = [got[2 * i + 1] for i in range(40)]
    assert sum(f > 0 for f in found) >= 39 and all(f <= n for f, n in zip(found, planted, strict=True))
    assert sum(found) > 0.7 * sum(planted)


@pytest.mark.parametrize("word", [1, 4, 12, 20, 28, 60])
def test_chunks_are_alike_for_words_of_any_length(word):
    rng = random.Random(word)
    sizes = [len(c) for c in _chunks(" ".join(_bare(rng, word, "base64") for _ in range(60_000 // (word + 1))))]
    assert 20 <= sum(sizes) / len(sizes) <= 75


@pytest.mark.parametrize("period", [1, 5, 27, 100, 301])
def test_text_that_goes_round_is_cut_alike_behind_an_insertion(period):
    rng = random.Random(period)
    text = _bare(rng, period, "base64") * (9000 // period)
    before, after = _chunks(text), set(_chunks("inserted-" + text))
    assert sum(len(c) for c in before if c in after) > 0.7 * len(text)


def test_short_copies_of_whole_texts_go(spark):
    short = ["ok", "a short text", "x" * (chunk_dedup.MIN_RUN - 1), "短い文書", "one two three four five six seven eight"]
    rows = [(i, t) for i, t in enumerate(short)] + [(10 + i, t) for i, t in enumerate(short)]
    rows += [(20, "ok ok"), (21, "a short text that goes on"), (22, ""), (23, None), (None, "ok"), (4, short[4])]
    got = chunk_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        if r["doc_id"] is not None and 10 <= r["doc_id"] < 20:
            size = len(short[r["doc_id"] - 10].encode())
            assert (r["text"], r["_removed"]) == ("", size) and [tuple(g) for g in r["_gone"]] == [(0, size)]
        else:
            assert (r["doc_id"], r["text"]) in rows and r["_removed"] == 0
    assert len(got) == len(rows)


def test_texts_that_share_a_doc_id_are_cut_apart(spark):
    rng = random.Random(12)
    passage, clean = _bare(rng, 400, "base64"), _bare(rng, 1600, "chinese")
    cut = _bare(rng, 300, "base64") + passage + _bare(rng, 300, "base64")
    rows = [(1, _bare(rng, 200, "base64") + passage), (5, cut), (5, clean), (5, clean)]
    got = chunk_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = sorted(r["_removed"] for r in got)
    assert removed[:3] == [0, 0, 0] and 0 < removed[3] <= 400
    assert sum(r["text"] == clean for r in got) == 2, "the other text of the doc_id is clean and stays whole"
    copies = chunk_dedup.without_repeats(spark.createDataFrame([(1, clean), (5, cut), (5, clean)],
                                                               "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in copies) == sorted([(1, clean), (5, cut), (5, "")])
