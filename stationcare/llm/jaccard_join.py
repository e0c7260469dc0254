"""N-gram Jaccard join: MinHash banding finds candidates, whole n-gram sets decide.

1. Every text becomes a set of hashed runs of five words. Texts with equal sets form one class at once
   (``groupBy`` on a 128-bit digest of the set, summed map-side), so copies are never compared.
2. ``bands_for`` picks rows per band and bands for the wanted recall at the threshold. Class representatives
   meet in buckets of equal band hashes. Signatures of each member and the bucket's smallest member are compared;
   members far from it, as chance meetings are, and in no group with it by way of other bands, are compared with
   all others of the bucket, tile by tile. Components of the pairs that may be similar are the groups inside which
   whole sets are verified, so meetings by chance do not chain texts into ever larger groups.
3. Members of a group are dealt into tiles; tasks compare tile with tile: signatures first rule out pairs far
   below the threshold, then exact intersections of the whole sets decide. A task sends back one row per
   member (how many documents it is linked to) and a spanning forest of the links, never the pairs.
4. Components of the links are the final classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcare.llm.components import connected
from stationcare.llm.text import SHINGLE_WORDS, Permutations, buffers, mix, pieces, shingle_hashes
from stationcare.session import staged, unstage

THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 192
TILE = 256
#: The share of equal signature values estimates the similarity; below this part of the threshold is out of reach.
REACH = 0.65


@dataclass(frozen=True)
class Bands:
    bands: int
    rows: int

    def chance(self, similarity: float) -> float:
        """Chance that two sets of this similarity share a bucket."""
        return 1 - (1 - similarity**self.rows) ** self.bands


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = MAX_HASHES) -> Bands:
    """The most rows per band (fewest chance candidates) that still reach the recall at the threshold."""
    for rows in range(hashes, 0, -1):
        found = Bands(hashes // rows, rows)
        if found.chance(threshold) >= recall:
            return found
    raise ValueError("no banding of so few hash functions reaches this recall")


def _unique_sets(shingles: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [np.unique(shingles[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _digest(values: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_intdigest(values.tobytes())
    return (raw >> 64) - (1 << 63), (raw & (2**64 - 1)) - (1 << 63)


def set_signatures(docs: DataFrame, plan: Bands, words: int) -> DataFrame:
    """``(doc_id, hi, lo, bands, sig)``: digest of the set, one 64-bit hash per band, lowest bytes of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Permutations(plan.bands * plan.rows)
        weights = np.random.default_rng(11).integers(0, 2**64, plan.rows, dtype=np.uint64) | np.uint64(1)
        for piece in pieces(batches):
            shingles, at = shingle_hashes(*buffers(piece.column("text")), words)
            digests = np.array([_digest(s) for s in _unique_sets(shingles, at)], dtype=np.int64).reshape(-1, 2)
            sig = hashes.signatures(shingles, at)
            parts = sig.reshape(-1, plan.bands, plan.rows).astype(np.uint64)
            keys = mix((parts * weights).sum(axis=2, dtype=np.uint64)).view(np.int64)
            rows = pa.ListArray.from_arrays(
                pa.array(np.arange(0, keys.size + 1, plan.bands, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(digests[:, 0]), pa.array(digests[:, 1]), rows,
                 pa.array([s.tobytes() for s in sig.astype(np.uint8)], pa.binary())],
                ["doc_id", "hi", "lo", "bands", "sig"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, hi long, lo long, bands array<long>, sig binary")


def _table_of(sig: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x, np.uint8) for x in sig.to_pylist()])


def _equal_values(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of equal signature values of each pair of rows."""
    same = np.zeros((len(left), len(right)), np.uint16)
    for k in range(left.shape[1]):
        same += left[:, k][:, None] == right[:, k][None, :]
    return same


def _measured(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _table_of(batch.column("sig")), _table_of(batch.column("low_sig"))
            near = (a == b).sum(axis=1) >= a.shape[1] * threshold * REACH
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("low"), pa.array(near)],
                                             ["rep", "low", "near"])

    return run


def _near_in_tiles(threshold: float):
    """A spanning forest of the pairs in two tiles of a bucket whose signatures are in reach of the threshold."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        side = table.column("tile").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, side, sig = ids[order], side[order], _table_of(table.column("sig"))[order]
        left, right = np.flatnonzero(side == key[1].as_py()), np.flatnonzero(side == key[2].as_py())
        found = np.zeros((0, 2), np.int64)
        if len(left) and len(right):
            near = _equal_values(sig[left], sig[right]) >= sig.shape[1] * threshold * REACH
            rows, cols = np.nonzero(near)
            found = np.stack([left[rows], right[cols]], axis=1)
        roots = _roots(len(ids), found)
        apart = roots != np.arange(len(ids))
        return pa.table({"a": ids[apart], "b": ids[roots[apart]]})

    return run


def near_groups(reps: DataFrame, signed: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """``(rep, bands)`` to ``(node, root)``: components of the pairs that share a bucket and may be similar.

    ``signed`` has the signatures of all documents. Texts that only meet others by chance are in no group.
    """
    banded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = (banded.groupBy("band", "key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
               .filter("low < high").select("band", "key", "low"))
    star = staged(banded.join(buckets, ["band", "key"]).filter("rep != low"), "stars")
    nodes = star.select("rep").union(star.select("low")).distinct()
    sigs = staged(signed.select(F.col("doc_id").alias("rep"), "sig").join(nodes, "rep", "left_semi").distinct(), "sigs")
    lows = sigs.select(F.col("rep").alias("low"), F.col("sig").alias("low_sig"))
    judged = staged(star.select("rep", "low").distinct().join(sigs, "rep").join(lows, "low")
                    .select("rep", "low", "sig", "low_sig")
                    .mapInArrow(_measured(threshold), "rep long, low long, near boolean"), "judged")
    near = judged.filter("near").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    groups = connected(near)

    # a member far from the smallest one, and in no group with it by other bands either, is compared with all of the
    # bucket; members in the smallest one's group are not compared with one another again
    of = groups.select(F.col("node").alias("_rep"), F.col("root").alias("_r"))
    of_low = groups.select(F.col("node").alias("_low"), F.col("root").alias("_l"))
    away = (judged.filter("NOT near").select("rep", "low").distinct()
            .join(of, F.col("rep") == F.col("_rep"), "left").join(of_low, F.col("low") == F.col("_low"), "left")
            .filter("coalesce(_r, rep) != coalesce(_l, low)").select("rep", "low", F.lit(True).alias("away")))
    away = staged(away, "away")
    # rows that repeat would cancel in the sums below
    guests = star.join(away, ["rep", "low"]).distinct()
    content = guests.groupBy("band", "key", "low").agg(
        F.count_distinct("rep").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("h1"),
        F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("h2"))
    homes = star.join(content.select("band", "key"), ["band", "key"]).join(away, ["rep", "low"], "left_anti").distinct()
    filled = homes.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("rep")).alias("h3"),
        F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("h4"))
    # buckets of several bands with the same members are compared once; a guest alone with the smallest one was
    chosen = (content.join(filled, ["band", "key"], "left").na.fill(0, ["m", "h3", "h4"]).filter("n + m > 1")
              .groupBy("low", "n", "h1", "h2", "m", "h3", "h4").agg(F.min(F.struct("band", "key")).alias("_b"))
              .select("_b.band", "_b.key", F.ceil(F.col("n") / F.lit(tile)).cast("long").alias("tiles"),
                      F.ceil(F.col("m") / F.lit(tile)).cast("long").alias("rests")))
    chosen = staged(chosen, "chosen")
    number, zero = F.xxhash64("band", "key").alias("bucket"), F.lit(0).cast("long")
    guest = guests.join(chosen, ["band", "key"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    rest = homes.join(chosen, ["band", "key"]).withColumn("tile", -1 - F.pmod(F.xxhash64("rep"), F.col("rests")))
    # tiles of guests count from 0, those of the others from -1 down
    met = guest.withColumn("_t", F.explode(F.sequence(-F.col("rests"), F.col("tiles") - 1))).select(
        number, "rep", "tile", F.least("tile", "_t").alias("first"), F.greatest("tile", "_t").alias("second"))
    asked = rest.withColumn("_t", F.explode(F.sequence(zero, F.col("tiles") - 1))).select(
        number, "rep", "tile", F.col("tile").alias("first"), F.col("_t").alias("second"))
    inside = staged(met.union(asked).join(sigs, "rep").groupBy("bucket", "first", "second").applyInArrow(
        _near_in_tiles(threshold), "a long, b long"), "inside")
    if not inside.isEmpty():
        first = groups
        groups = connected(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(inside))
        unstage(first)
    unstage(star, judged, sigs, away, chosen, inside)
    return groups


def _sets(docs: DataFrame, words: int, plan: Bands) -> DataFrame:
    """Whole sets with a short signature, for candidates only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Permutations(plan.bands * plan.rows)
        for piece in pieces(batches):
            shingles, at = shingle_hashes(*buffers(piece.column("text")), words)
            sig = hashes.signatures(shingles, at).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("group"), piece.column("member"), piece.column("copies"),
                 piece.column("tiles"), pa.array([s.tobytes() for s in sig], pa.binary()),
                 pa.array([s.tobytes() for s in _unique_sets(shingles, at)], pa.binary())],
                ["doc_id", "group", "member", "copies", "tiles", "sig", "set"])

    return docs.mapInArrow(
        run, "doc_id long, group long, member long, copies long, tiles long, sig binary, set binary")


def links_between(left: list[np.ndarray], right: list[np.ndarray], near: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (i, j) among those marked in ``near`` whose sets have at least this Jaccard similarity."""
    rows, cols = np.nonzero(near)
    if not len(rows):
        return np.zeros((0, 2), np.int64)
    li, lj = np.unique(rows), np.unique(cols)
    a, b = [left[i] for i in li], [right[j] for j in lj]
    sizes_a, sizes_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if len(rows) > 64:  # many pairs: shared columns of one incidence matrix, in strips
        flat_a, flat_b = np.concatenate(a), np.concatenate(b)
        shared = np.intersect1d(flat_a, flat_b)
        both = np.zeros((len(a), len(b)), np.float32)
        own_a, own_b = np.repeat(np.arange(len(a)), sizes_a), np.repeat(np.arange(len(b)), sizes_b)
        ca, cb = np.searchsorted(shared, flat_a), np.searchsorted(shared, flat_b)
        ok_a = ca < len(shared)
        ok_a[ok_a] = shared[ca[ok_a]] == flat_a[ok_a]
        ok_b = cb < len(shared)
        ok_b[ok_b] = shared[cb[ok_b]] == flat_b[ok_b]
        ca, own_a, cb, own_b = ca[ok_a], own_a[ok_a], cb[ok_b], own_b[ok_b]
        order_a, order_b = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
        ca, own_a, cb, own_b = ca[order_a], own_a[order_a], cb[order_b], own_b[order_b]
        for low in range(0, len(shared), 4096):
            width = min(4096, len(shared) - low)
            strips = []
            for c, own, n in ((ca, own_a, len(a)), (cb, own_b, len(b))):
                s, e = np.searchsorted(c, [low, low + width])
                strip = np.zeros((n, width), np.float32)
                strip[own[s:e], c[s:e] - low] = 1
                strips.append(strip)
            both += strips[0] @ strips[1].T
        inter = both[np.searchsorted(li, rows), np.searchsorted(lj, cols)].astype(np.float64)
    else:
        inter = np.array([len(np.intersect1d(left[i], right[j], assume_unique=True))
                          for i, j in zip(rows, cols, strict=True)], dtype=np.float64)
    na = sizes_a[np.searchsorted(li, rows)]
    nb = sizes_b[np.searchsorted(lj, cols)]
    union = na + nb - inter
    similar = np.where(union > 0, inter / np.maximum(union, 1), 1.0) >= threshold
    return np.stack([rows[similar], cols[similar]], axis=1)


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest index of each component."""
    up = np.arange(n)
    while len(pairs):
        low = np.minimum(up[pairs[:, 0]], up[pairs[:, 1]])
        np.minimum.at(up, pairs[:, 0], low)
        np.minimum.at(up, pairs[:, 1], low)
        up = up[up]
        if (up[pairs[:, 0]] == up[pairs[:, 1]]).all() and (up[up] == up).all():
            break
    return up


def _compare_tiles(threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        copies = table.column("copies").to_numpy()
        side = table.column("tile").to_numpy()
        first, second = key[1].as_py(), key[2].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        sig = _table_of(table.column("sig"))
        sizes = np.array([len(s) for s in sets])
        order = np.argsort(ids, kind="stable")
        left, right = order[side[order] == first], order[side[order] == second]
        counts = np.zeros(len(ids), np.int64)
        found = []
        if len(left) and len(right):
            near = _equal_values(sig[left], sig[right]) >= sig.shape[1] * threshold * REACH
            small = np.minimum(sizes[left][:, None], sizes[right][None, :])
            near &= small >= threshold * np.maximum(sizes[left][:, None], sizes[right][None, :])
            near &= ids[left][:, None] != ids[right][None, :]
            if first == second:
                near &= np.triu(np.ones(near.shape, bool), 1)
            got = links_between([sets[i] for i in left], [sets[i] for i in right], near, threshold)
            found = np.stack([left[got[:, 0]], right[got[:, 1]]], axis=1)
            np.add.at(counts, found[:, 0], copies[found[:, 1]])
            np.add.at(counts, found[:, 1], copies[found[:, 0]])
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        roots = _roots(len(ids), rank[found] if len(found) else np.zeros((0, 2), np.int64))
        return pa.table({"a": ids[order], "b": ids[order][roots], "links": counts[order]})

    return run


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = SHINGLE_WORDS,
                    recall: float = RECALL, tile: int = TILE, plan: Bands | None = None) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links``.

    ``class_id`` is the smallest doc_id among the documents joined by links of at least ``threshold``;
    ``n_links`` counts the other documents with at least that similarity, copies included. Texts without a
    word (null, empty, symbols) have equal, empty sets: similarity 1. Rows that share a doc_id are one
    document, whose links are those of its texts. A null doc_id names no document: such a row comes back
    with null class and no links. An empty table gives an empty table; other columns are not read.
    """
    plan = plan or bands_for(threshold, recall)
    known = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = staged(set_signatures(known, plan, words), "signatures")
    classes = signed.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = staged(classes, "classes")

    reps = signed.join(classes, ["hi", "lo"]).filter(F.col("doc_id") == F.col("rep"))
    groups = near_groups(reps.select("rep", "bands"), signed, threshold, tile)

    sized = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    members = (groups.join(sized, "root")
               .select(F.col("node").alias("doc_id"), F.col("root").alias("group"),
                       F.ceil(F.col("n") / F.lit(tile)).cast("long").alias("tiles")))
    weights = classes.groupBy("rep").agg(F.sum("copies").alias("copies"))
    members = members.join(weights, members["doc_id"] == weights["rep"]).select(
        "doc_id", "group", "tiles", "copies",
        F.pmod(F.xxhash64("doc_id"), F.col("tiles")).alias("member"))
    wanted = known.join(members, "doc_id").select("doc_id", "text", "group", "member", "copies", "tiles")
    sets = _sets(wanted, words, plan)
    # a member of tile m meets every tile once: as (m, t) with t >= m, as (t, m) with t < m
    dealt = sets.select(
        "doc_id", "group", "copies", "sig", "set", F.col("member").alias("tile"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("_t")).select(
        "doc_id", "group", "copies", "sig", "set", "tile",
        F.least("tile", "_t").alias("first"), F.greatest("tile", "_t").alias("second"))
    compared = staged(dealt.groupBy("group", "first", "second").applyInArrow(
        _compare_tiles(threshold), "a long, b long, links long"), "links")
    between = compared.groupBy("a").agg(F.sum("links").alias("links"))
    roots = connected(compared.filter("a != b").select("a", "b"))

    # documents of one class, and of classes that share a doc_id, follow their representative
    found = (signed.join(classes, ["hi", "lo"]).select("doc_id", "rep", "copies")
             .join(between, F.col("rep") == F.col("a"), "left")
             .join(roots, F.col("rep") == F.col("node"), "left")
             .select("doc_id", F.coalesce("root", "rep").alias("class_id"),
                     (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    lost = docs.filter(F.col("doc_id").isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(lost)
