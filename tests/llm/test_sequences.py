import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from stationcare.llm import packing
from stationcare.llm.tokens import Tokenizer

ODD = ["it's", "we'll", "'s", "''s", " ", "  ", "\n", "\n\n", " \n", "\t", "I'd've", "x'", "'", "' s", "'sx", "'re",
       "'rex", "123", "12ab", "é", "ñ'll", "<|endoftext|>", "!!", "a.b", " x", "日本", "😀", "'l", "\x00", "\r\n"]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer as Reference

    known = Reference.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known.encode_special_tokens = True
    return lambda t: known.encode(t, add_special_tokens=False).ids


def test_ids_equal_the_tokenizers_library(reference, rows):
    rng = random.Random(1)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 10))) for _ in range(600)] + [t or "" for _, t in rows] + [""]
    own = Tokenizer()
    for size in (1, 50, 1000):
        for a in range(0, len(texts), size):
            part = texts[a:a + size]
            ids, at = own.encode(part)
            assert [ids[b:c].tolist() for b, c in zip(at[:-1], at[1:], strict=True)] == [reference(t) for t in part]
    assert [x.tolist() for x in own.encode([])] == [[], [0]]


def _check(got, rows, reference, window):
    """Round trip: pieces give each document's ids back; sequences are gapless and whole."""
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*reference(t or ""), packing.END_ID])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
    assert set(pieces) == set(want)
    for i, parts in pieces.items():
        if len(want[i]) == 1:
            assert [x for _, ids, _ in sorted(parts) for x in ids] == want[i][0]
        assert sum(len(ids) for _, ids, _ in parts) == sum(map(len, want[i]))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= window and end & (end - 1) == 0


@pytest.mark.parametrize(("window", "shard"), [(2048, 1_000_000), (256, 3_000), (64, 1)])
def test_pack_round_trip(docs, rows, reference, window, shard):
    _check(packing.pack(docs, window=window, shard_tokens=shard).collect(), rows, reference, window)


def test_pack_odd_tables(spark, reference):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, None), (None, "a b c"), (1, "x y"), (1, "x y"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    _check(packing.pack(df).collect(), rows, reference, 2048)
    with pytest.raises(ValueError):
        packing.pack(df, window=1000)


def test_index_equals_plain_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 60, rng.integers(1, 50)).astype(np.int32) for _ in range(30)]
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    index = packing.Index(np.concatenate(docs), at)
    mean = np.mean([len(d) for d in docs])
    used = np.zeros(30, bool)
    used[[3, 7]] = True
    query = rng.integers(0, 60, 8)
    scores = np.zeros(30)
    for term in set(query.tolist()):
        df = sum(term in d for d in docs)
        if df > 1:
            for i, d in enumerate(docs):
                tf = int((d == term).sum())
                norm = packing.K1 * (1 - packing.B + packing.B * len(d) / mean)
                scores[i] += np.log1p((30 - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + norm)
    scores[used] = 0
    want = [i for i in sorted(range(30), key=lambda i: (-round(scores[i], 9), i)) if scores[i] > 0]
    assert index.neighbours(query, used).tolist() == want


def plain_bm25(docs, query):
    """Score of each document for all tokens of the query that several documents hold."""
    mean, scores = np.mean([len(d) for d in docs]), np.zeros(len(docs))
    for term in set(query.tolist()):
        tf = np.array([(d == term).sum() for d in docs])
        df = (tf > 0).sum()
        if df > 1:
            norm = packing.K1 * (1 - packing.B + packing.B * np.array([len(d) for d in docs]) / mean)
            scores += np.log1p((len(docs) - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + norm)
    return scores


def plain_packing(docs, window):
    """(document, start, length) in the order laid: seeds by position, each window filled for its first document."""
    laid, left, fill, seed, used = [], {i: len(d) for i, d in enumerate(docs)}, 0, None, set()

    def lay(i):
        nonlocal fill, seed
        used.add(i)
        while left[i]:
            if not fill:
                seed = i
            part = min(left[i], window - fill)
            laid.append((i, len(docs[i]) - left[i], part))
            left[i] -= part
            fill = (fill + part) % window

    while len(used) < len(docs):
        following = min(set(range(len(docs))) - used)
        if not fill:
            lay(following)
            continue
        scores = plain_bm25(docs, docs[seed])
        best = sorted((i for i in range(len(docs)) if scores[i] > 0 and i not in used), key=lambda i: (-round(scores[i], 9), i))
        cut, closed = None, False
        for i in best:
            if len(docs[i]) <= window - fill:
                lay(i)
                closed = not fill
                if closed:
                    break
            elif cut is None:
                cut = i
        if not closed:
            lay(cut if cut is not None else following) if cut is not None or not best else None
    return laid


def test_long_queries_equal_plain_bm25():
    rng = np.random.default_rng(5)
    docs = [rng.zipf(1.3, rng.integers(1, 400)).clip(0, 900).astype(np.int32) for _ in range(80)]
    index = packing.Index(np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
    for query in [rng.choice(900, 200, replace=False).astype(np.int32), *docs[:20]]:
        scores = plain_bm25(docs, query)
        np.testing.assert_allclose(index.scores(query), scores, atol=1e-9)
        top = sorted(range(80), key=lambda i: (-round(scores[i], 9), i))[:10]
        assert index.neighbours(query, np.zeros(80, bool))[:10].tolist() == [i for i in top if scores[i] > 0]


@pytest.mark.parametrize("window", [64, 256])
def test_windows_are_filled_for_their_first_document(window):
    rng = np.random.default_rng(window)
    docs = [np.append(rng.integers(2 + 40 * (i % 4), 60 + 40 * (i % 4), rng.integers(1, 200)), 1).astype(np.int32) for i in range(60)]
    packer = packing.Packer(window, 0, False)
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    packer.shard([(i, len(d)) for i, d in enumerate(docs)], np.concatenate(docs), at)
    got = [(r[0], r[1], r[2]) for r in packer.rows] + [(doc, start, len(part)) for doc, _, start, part, _ in packer.open]
    assert got == plain_packing(docs, window)


def test_neighbours_share_windows(spark):
    """Documents on one subject, dealt out in turn, end up beside each other."""
    rng = random.Random(9)
    subjects = [[f"{chr(97 + k)}{chr(97 + j)}{x}q" for j in range(9) for x in "uvwxyz"] for k in range(6)]
    rows = [(i, " ".join(rng.choices(subjects[i % 6], k=60))) for i in range(120)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    inside = defaultdict(list)
    for r in got:
        inside[r["sequence_id"]].append(r["doc_id"] % 6)
    pairs = [a == b for s in inside.values() for a, b in zip(s[:-1], s[1:], strict=True)]
    assert np.mean(pairs) > 0.7
