import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stationcare.llm import merkle
from stationcare.llm.merkle import folded, manifest, siblings_digest, tampering_found

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, position long, tree string, proof string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def grow(nodes):
    """The root, and for each node the siblings level by level."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
    root, above = grow([digest(*r) for r in runs])
    return root, [[(r[:i], r[i + 1:]), *up] for r, up in zip(runs, above, strict=True) for i in range(len(r))]


def plain_version(rows):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append((leaf_of(*row), row))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    grown = {}
    for name in names:
        by[name].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        grown[name] = grow([leaf for leaf, _ in by[name]])
    root, over = grow([grown[n][0] for n in names]) if names else (None, [])
    out = []
    for name, up in zip(names, over, strict=True):
        subroot, proofs = grown[name]
        for (leaf, row), own in zip(by[name], proofs, strict=True):
            path = [*own, *up]
            doc_id, source, lang, n_chars, text = row
            even = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 2 == 0
            node = leaf_of(doc_id, source, lang, n_chars, text.replace("\n", "") if even and text is not None else text)
            for left, right in path:
                node = digest(*left, node, *right)
            siblings = digest(*[d for left, right in path for d in [*left, *right]])
            out.append((doc_id, leaf, subroot, root, siblings, node, node == root))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "t", "p") for r in rows], SCHEMA).repartition(3)


def many(sizes, seed=1):
    rng = random.Random(seed)
    out = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "a\nb", "plain", "é\n" * rng.randint(1, 9)])
            out.append((rng.choice([None, rng.randint(-50, 10**6)]), source, rng.choice([None, "en", ""]),
                        rng.choice([None, rng.randint(0, 99)]), text))
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 2}, {"a": 3, "b": 1}, {"": 4, None: 1, "é": 9, "z": 27, "Z": 28}])
def test_small_trees_equal_the_plain_version(spark, sizes):
    rows = many(sizes)
    assert sorted(map(tuple, tampering_found(table(spark, rows)).collect()), key=str) == sorted(plain_version(rows), key=str)


def test_large_sources_repeated_rows_and_many_sources(spark):
    rows = many({"hot": 2300, None: 729, "b": 730, **{f"s{i}": 1 + i % 4 for i in range(800)}})
    rows += rows[:50]
    got = sorted(map(tuple, tampering_found(table(spark, rows)).collect()), key=str)
    assert got == sorted(plain_version(rows), key=str)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_blocks_of_any_size_give_one_answer(spark, levels):
    rows = many({"a": 100, "b": 27, "c": 1, None: 10})
    made = manifest(table(spark, rows), levels=levels)
    got = made.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("s"),
                      (folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("holds")).collect()
    assert all(r["holds"] for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(
        (r[:5] for r in plain_version(rows)), key=str)


def test_queue_stays_small(monkeypatch):
    longest = 0
    real = merkle.heapq.heappush

    def watched(queue, item):
        nonlocal longest
        real(queue, item)
        longest = max(longest, len(queue))

    monkeypatch.setattr(merkle.heapq, "heappush", watched)
    made = merkle._forward([digest(str(i)) for i in range(729)], 6, 3)
    assert [len(level) for level in made] == [729, 243, 81, 27, 9, 3, 1] and longest <= 3 * 6
    merkle._backward(made, "", 3)
    assert longest <= 3 * 6


def test_empty_table(spark):
    assert tampering_found(table(spark, many({"a": 1})).limit(0)).collect() == []
