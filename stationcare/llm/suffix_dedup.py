"""Exact substring dedup with a sparse suffix array, ordered by deep-shallow sorting.

Every byte goes that lies in a 200-byte string which also starts at another place. A full suffix array would sort
every byte's suffix; here each 200-byte window picks the 64-byte grams with the smallest hash inside it, so equal
windows pick equal grams at equal offsets, and only suffixes that begin at picked places (about one in 69) are
kept. Grams that stand at one place only are dropped by a count. For the rest

1. a place becomes the bytes its windows can touch, left and right of it; equal ones are one class with a count,
   so copies never meet in one task;
2. the classes of a gram are ordered twice, by the suffix to the right and by the reversed bytes to the left:
   multikey quicksort over blocks of eight bytes to a shallow depth, then a blind trie for the groups that still
   share a long prefix. Common prefix lengths of neighbours give, for each class, the windows it shares;
3. grams with very many classes are not collected: their windows are counted one by one instead, which gives the
   same answer (``MAX_CLASSES`` decides which way is taken, never what is found).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcare.llm.text import BASE, BYTE_VALUES, buffers, mix, pieces, powers
from stationcare.operators.tables import settled
from stationcare.session import free_shuffles, staged, unstage

MATCH = 200
GRAM = 64
SPAN = MATCH - GRAM + 1
SHALLOW = 64
BLOCK = 8
PAIRWISE = 16
MAX_CLASSES = 20_000

_INVERSE = pow(BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {"up": powers(1 << 16, BASE), "down": powers(1 << 16, _INVERSE)}


def _slide(x: np.ndarray, span: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + span], by doubling."""
    done = 1
    while done * 2 <= span:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[:len(x) - (span - done)], x[span - done:]) if span > done else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Picked places of all texts: (place in ``data``, hash of its gram, and for each window offset whether the
    window that begins so many bytes before picks this place)."""
    n = len(data)
    sizes = np.diff(offsets)
    if n < MATCH or sizes.max() < MATCH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((SPAN, 0), bool)
    if n >= len(_tables["up"]):
        size = 1 << int(n + 1).bit_length()
        _tables.update(up=powers(size, BASE), down=powers(size, _INVERSE))
    total = np.zeros(n + 1, np.uint64)
    values = BYTE_VALUES[data]
    values *= _tables["up"][:n]
    np.cumsum(values, out=total[1:])
    grams = total[GRAM:] - total[:-GRAM]
    grams *= _tables["down"][:len(grams)]
    grams = mix(grams)
    lowest = _slide(grams, SPAN, np.minimum)  # of the window that begins here
    ends = np.repeat(offsets[1:], sizes)
    valid = np.arange(len(lowest)) + MATCH <= ends[:len(lowest)]
    lowest = np.where(valid, lowest, 0)
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), lowest, np.zeros(SPAN - 1, np.uint64)])
    highest = _slide(padded, SPAN, np.maximum)[:len(grams)]  # over the windows that hold the gram
    at = np.flatnonzero((highest == grams) & (grams > 0))
    picked = np.stack([padded[at - d + SPAN - 1] == grams[at] for d in range(SPAN)]) if len(at) else \
        np.zeros((SPAN, 0), bool)
    return at, grams[at], picked


def _reach(at: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest offset of the windows that picked each place."""
    return SPAN - 1 - np.argmax(picked[::-1], axis=0), np.argmax(picked, axis=0)


def _grams(docs: DataFrame) -> DataFrame:
    """``gram`` of every picked place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            _, grams, _ = anchors(*buffers(piece.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    return docs.select("text").mapInArrow(run, "gram long")


_PLACE = "doc_id long, text_hash long, at int, gram long, far int, near int, hi long, lo long"


def _places(docs: DataFrame) -> DataFrame:
    """Every picked place with its gram, its reach and a digest of all bytes its windows touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            data, offsets = buffers(piece.column("text"))
            at, grams, picked = anchors(data, offsets)
            far, near = _reach(at, picked)
            row = np.searchsorted(offsets, at, side="right") - 1
            raw, take = data.tobytes(), pa.array(row)
            digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(
                (at - far).tolist(), (at - near + MATCH).tolist(), strict=True)]), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(take), piece.column("text_hash").take(take),
                 pa.array((at - offsets[row]).astype(np.int32)), pa.array(grams.view(np.int64)),
                 pa.array(far.astype(np.int32)), pa.array(near.astype(np.int32)),
                 pa.array(digest[:, 0]), pa.array(digest[:, 1])],
                ["doc_id", "text_hash", "at", "gram", "far", "near", "hi", "lo"])

    return docs.mapInArrow(run, _PLACE)


def _contexts(docs: DataFrame) -> DataFrame:
    """Bytes of the places listed in ``ats`` (place, count of its class), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            data, offsets = buffers(piece.column("text"))
            at, grams, picked = anchors(data, offsets)
            lists = piece.column("ats")
            flat = lists.flatten()
            wanted = flat.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
            wanted = wanted + np.repeat(offsets[:-1], np.diff(lists.offsets.to_numpy()))
            order = np.argsort(wanted)
            number = flat.field("n").to_numpy(zero_copy_only=False)[order]
            kept = np.searchsorted(at, wanted[order])
            at, grams, picked = at[kept], grams[kept], picked[:, kept]
            far, near = _reach(at, picked)
            raw = data.tobytes()
            context = [raw[a:b] for a, b in zip((at - far).tolist(), (at - near + MATCH).tolist(), strict=True)]
            digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, context)), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams.view(np.int64)), pa.array(far.astype(np.int32)), pa.array(digest[:, 0]),
                 pa.array(digest[:, 1]), pa.array(context, pa.binary()), pa.array(number, pa.int64())],
                ["gram", "far", "hi", "lo", "context", "n"])

    return docs.mapInArrow(run, "gram long, far int, hi long, lo long, context binary, n long")


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class BlindTrie:
    """Compact trie that stores only where its branches differ; a leaf holds equal strings."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # [depth, {byte or -1: node}] or [None, [items]]

    def _branch(self, s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, item: int) -> None:
        s = self.strings[item]
        if self.root is None:
            self.root = [None, [item]]
            return
        node = self.root
        while node[0] is not None:  # blind: any leaf below a missing branch serves to compare
            node = node[1].get(self._branch(s, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node[1].append(item)
            return
        parent, node, branch = None, self.root, 0
        while node[0] is not None and node[0] < depth:
            parent, branch = node, self._branch(s, node[0])
            node = node[1][branch]
        if node[0] == depth:
            node[1][self._branch(s, depth)] = [None, [item]]
            return
        below = node
        while below[0] is not None:
            below = next(iter(below[1].values()))
        split = [depth, {self._branch(s, depth): [None, [item]],
                         self._branch(self.strings[below[1][0]], depth): node}]
        if parent is None:
            self.root = split
        else:
            parent[1][branch] = split

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                out += node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Sorted order of strings: multikey quicksort to ``shallow`` bytes, then blind tries."""
    if len(strings) == 2:  # one comparison orders a pair
        return [0, 1] if strings[0] <= strings[1] else [1, 0]
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) <= 1:
            out += items
        elif depth >= shallow:
            trie = BlindTrie(strings)
            for i in items:
                trie.add(i)
            out += trie.ordered()
        else:
            pivot = strings[items[len(items) // 2]][depth:depth + BLOCK]
            less, same, more = [], [], []
            for i in items:
                block = strings[i][depth:depth + BLOCK]
                (same if block == pivot else less if block < pivot else more).append(i)
            stack.append((more, depth))
            if len(pivot) < BLOCK:  # the strings end here and are equal
                stack += [([i], depth) for i in reversed(same)]
            else:
                stack.append((same, depth + BLOCK))
            stack.append((less, depth))
    return out


def _among(order: list[int], step: list[int], kept: set[int]) -> tuple[list[int], list[int]]:
    """An order and the common prefixes of its neighbours, for some of its members only."""
    some, between, low = [], [], 1 << 30
    for place, item in enumerate(order):
        if place:
            low = min(low, step[place - 1])
        if item in kept:
            if some:
                between.append(low)
            some.append(item)
            low = 1 << 30
    return some, between


def _bounds(order: list[int], step: list[int]) -> dict[int, int]:
    """Longest common prefix of each member with any other one of the order."""
    out = dict.fromkeys(order, 0)
    for place, length in enumerate(step):
        out[order[place]] = max(out[order[place]], length)
        out[order[place + 1]] = length
    return out


def _nearest(order: list[int], step: list[int], place: int, length: int, most: int = 4) -> Iterator[int]:
    """Some of the members that share ``length`` bytes with the one at this place."""
    for way in (-1, 1):
        at = place
        for _ in range(most):
            edge = at - 1 if way < 0 else at
            if not 0 <= edge < len(step) or step[edge] < length:
                break
            at += way
            yield order[at]


def shared_windows(rights: list[bytes], lefts: list[bytes], counts: list[int],
                   near: list[int]) -> list[tuple[int, int] | None]:
    """For each class of one gram the smallest and largest window offset that another place shares, or None.

    ``rights``: bytes from the gram on; ``lefts``: reversed bytes before it; ``near``: smallest offset.
    """
    m = len(rights)
    out: list[tuple[int, int] | None] = [(near[c], len(lefts[c])) if counts[c] > 1 else None for c in range(m)]
    if m == 1:
        return out
    rank, step, reach = [], [], []
    for strings in (rights, lefts):
        order = deep_shallow_order(strings)
        shared = [common_prefix(strings[a], strings[b]) for a, b in zip(order[:-1], order[1:], strict=True)]
        # neighbours in the order have the longest common prefixes that any other member has
        most = [0] * m
        for place, length in enumerate(shared):
            most[order[place]] = max(most[order[place]], length)
            most[order[place + 1]] = length
        rank.append(order)
        step.append(shared)
        reach.append(most)
    # both members of a pair that shares a window reach far enough on both sides
    kept = {c for c in range(m) if reach[0][c] + reach[1][c] >= MATCH}
    if all(counts[c] > 1 for c in kept):
        return out
    for k in range(2):
        rank[k], step[k] = _among(rank[k], step[k], kept)
    if len(kept) <= PAIRWISE:
        common = [{}, {}]
        for k in range(2):
            for i in range(len(kept)):
                low = 1 << 30
                for j in range(i + 1, len(kept)):
                    low = min(low, step[k][j - 1])
                    a, b = rank[k][i], rank[k][j]
                    common[k][a, b] = common[k][b, a] = low
        for a in kept:
            if counts[a] > 1:
                continue
            low, high = SPAN, -1
            for b in kept:
                if a != b and common[0][a, b] + common[1][a, b] >= MATCH:
                    low = min(low, MATCH - common[0][a, b])
                    high = max(high, common[1][a, b])
            if high >= 0:
                out[a] = (max(low, near[a]), min(high, len(lefts[a])))
        return out
    # the longest match on one side bounds the offset; mostly a neighbour that has it matches far enough on the other
    bound = [_bounds(rank[k], step[k]) for k in range(2)]
    ends: list[dict[int, int]] = [{}, {}]
    for k, other in ((0, lefts), (1, rights)):
        spot = {c: i for i, c in enumerate(rank[k])}
        for c in kept:
            if counts[c] <= 1 and any(
                    bound[k][c] + common_prefix(other[c], other[b]) >= MATCH
                    for b in _nearest(rank[k], step[k], spot[c], bound[k][c])):
                ends[k][c] = MATCH - bound[0][c] if k == 0 else bound[1][c]
    open_ = {c for c in kept if counts[c] <= 1 and not (c in ends[0] and c in ends[1])}
    for c in kept - open_:
        if counts[c] <= 1:
            out[c] = (ends[0][c], ends[1][c])
    if not open_:
        return out
    names = np.array(sorted(kept))
    place = np.empty((2, m), np.int64)
    steps = [np.array(s) for s in step]
    for k in range(2):
        place[k, rank[k]] = np.arange(len(names))
    place = place[:, names]
    far, least = np.array([len(lefts[c]) for c in names]), np.array([near[c] for c in names])
    right, left = np.array([bound[0][c] for c in names]), np.array([bound[1][c] for c in names])
    low, high = np.full(len(names), SPAN), np.full(len(names), -1)
    asked = np.array([c in open_ for c in names.tolist()])
    for d in range(max(0, MATCH - int(right[asked].max())), min(SPAN - 1, int(left[asked].max())) + 1):
        group = [np.concatenate([[0], np.cumsum(s < depth)])[place[k]]
                 for k, (s, depth) in enumerate(zip(steps, (MATCH - d, d), strict=True))]
        key = group[0] * len(names) + group[1]
        live = np.flatnonzero((far >= d) & (least <= d) & (left >= d) & (right >= MATCH - d))
        values, inverse, number = np.unique(key[live], return_inverse=True, return_counts=True)
        hit = live[number[inverse] > 1]
        low[hit] = np.minimum(low[hit], d)
        high[hit] = np.maximum(high[hit], d)
    for i, c in enumerate(names.tolist()):
        if c in open_ and high[i] >= 0:
            out[c] = (int(low[i]), int(high[i]))
    return out


def _ordered_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram; a gram's rows may span batches."""
    held: list[tuple] = []

    def solved(rows: list[tuple]) -> list[tuple]:
        rights = [r[4][r[1]:] for r in rows]
        lefts = [r[4][:r[1]][::-1] for r in rows]
        near = [r[1] + MATCH - len(r[4]) for r in rows]
        found = shared_windows(rights, lefts, [r[5] for r in rows], near)
        return [(*r[:4], *f) for r, f in zip(rows, found, strict=True) if f is not None]

    for batch in _with_end(batches):
        out: list[tuple] = []
        if batch is None:
            out = solved(held) if held else []
        else:
            for row in zip(*[batch.column(c).to_pylist() for c in ("gram", "far", "hi", "lo", "context", "n")],
                           strict=True):
                if held and held[0][0] != row[0]:
                    out += solved(held)
                    held = []
                held.append(row)
        names = ["gram", "far", "hi", "lo", "low", "high"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in range(6)], names)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _key(doc_id: str = "doc_id", text_hash: str = "text_hash") -> Column:
    return F.struct(F.col(doc_id).alias("i"), F.col(text_hash).alias("h"))


_CLASS = ["gram", "far", "hi", "lo"]
_FOUND = "gram long, far int, hi long, lo long, low int, high int"


def _counted_windows(classes: DataFrame) -> DataFrame:
    """The answer for grams with very many classes: every window's bytes counted, in DataFrame operations."""
    near = F.col("far") + MATCH - F.octet_length("context")
    windows = classes.select(*_CLASS, "n", "context", F.explode(F.sequence(near, F.col("far"))).alias("d"))
    bytes_ = F.substring("context", F.col("far") - F.col("d") + 1, F.lit(MATCH))
    keyed = windows.select(*_CLASS, "n", "d", F.sha2(bytes_, 256).alias("window"))
    often = (keyed.groupBy("gram", "d", "window").agg(F.sum("n").alias("often")).filter("often > 1")
             .select(F.col("gram").alias("_g"), F.col("d").alias("_d"), F.col("window").alias("_w")))
    hit = keyed.join(often, (F.col("gram") == F.col("_g")) & (F.col("d") == F.col("_d"))
                     & (F.col("window") == F.col("_w")))
    return hit.groupBy(*_CLASS).agg(F.min("d").alias("low"), F.max("d").alias("high"))


def _on(left: list[str]) -> Column:
    """Equality of these columns with the ones of the same name behind an underscore."""
    out = F.lit(True)
    for c in left:
        out &= F.col(c) == F.col(f"_{c}")
    return out


def repeated_spans(docs: DataFrame, max_classes: int = MAX_CLASSES) -> DataFrame:
    """``key, spans``: per text (doc_id, hash of the text) the repeated byte ranges, unmerged (from, to)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                      F.col("text"))
    long_enough = own.filter(F.octet_length("text") >= MATCH)
    twice = (_grams(long_enough).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select(F.col("gram").alias("_gram")))
    found = staged(_places(long_enough).join(twice, _on(["gram"])).drop("_gram"), "places")
    free_shuffles(docs.sparkSession)
    classes = staged(found.groupBy(*_CLASS, "near").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_hash", "at")).alias("first")), "classes")
    free_shuffles(docs.sparkSession)
    sizes = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("classes"))
    several = sizes.filter("classes > 1").select(F.col("gram").alias("_gram"))
    # a gram whose places all look alike needs no order: it has one class, and every window of it is shared
    alike = classes.join(sizes.filter("classes = 1").select(F.col("gram").alias("_gram")), _on(["gram"])).filter(
        "n > 1").select(*_CLASS, F.col("near").alias("low"), F.col("far").alias("high"))
    lists = (classes.join(several, _on(["gram"])).select(
        _key("first.doc_id", "first.text_hash").alias("key"), F.struct("first.at", "n").alias("place"))
        .groupBy("key").agg(F.collect_set("place").alias("ats")))
    # rows that repeat give a text once
    texts = long_enough.withColumn("_key", _key()).join(lists, F.col("_key") == F.col("key")).select("text", "ats")
    contexts = _contexts(texts)
    crowds = settled(sizes.filter(F.col("classes") > max_classes).select(F.col("gram").alias("_gram")))
    if crowds.isEmpty():
        quiet, crowded = contexts, None
    else:
        kept = staged(contexts, "contexts")
        quiet, crowded = kept.join(crowds, _on(["gram"]), "left_anti"), kept.join(crowds, _on(["gram"]), "left_semi")
    solved = (quiet.repartition("gram").sortWithinPartitions("gram", *_CLASS[1:])
              .mapInArrow(_ordered_groups, _FOUND).unionByName(alike))
    if crowded is not None:
        solved = solved.unionByName(_counted_windows(crowded.distinct()))
    solved = solved.select(*[F.col(c).alias(f"_{c}") for c in _CLASS], "low", "high")
    spans = (found.join(solved, _on(_CLASS))
             .select(_key().alias("key"), (F.col("at") - F.col("high")).alias("from"),
                     (F.col("at") - F.col("low") + MATCH).alias("to"))
             .groupBy("key").agg(F.collect_set(F.struct("from", "to")).alias("spans")))
    out = staged(spans, "spans")
    unstage(found, classes)
    free_shuffles(docs.sparkSession)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, spans = [], [], []
        for raw, found in zip(batch.column("raw").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            gone: list[list[int]] = []
            for span in sorted((s["from"], s["to"]) for s in found or []):
                if gone and span[0] <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], span[1])
                else:
                    gone.append(list(span))
            parts, last = [], 0
            for a, b in gone:
                parts.append(raw[last:a])
                last = b
            kept.append(b"".join([*parts, raw[last:]]))
            removed.append(sum(b - a for a, b in gone))
            spans.append(gone)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()),
             pa.array([len(s) for s in spans], pa.int64()), pa.array(kept, pa.binary()),
             pa.array([[{"from": a, "to": b} for a, b in s] for s in spans],
                      pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])


def without_repeated_bytes(docs: DataFrame, max_classes: int = MAX_CLASSES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept, spans``.

    ``kept`` are the bytes left, ``spans`` the maximal removed runs. Null texts are empty; texts under 200 bytes
    lose nothing; repeated rows are copies of each other and lose all that a match can cover; a null doc_id is a
    document like any other. An empty table gives an empty table; other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                      F.coalesce("text", F.lit("")).alias("text"))
    found = repeated_spans(docs, max_classes).select(F.col("key").alias("_key"), "spans")
    joined = own.withColumn("key", _key()).join(found, F.col("key") == F.col("_key"), "left")
    return joined.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                         F.encode("text", "utf-8").alias("raw"), "spans").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, "
              "spans array<struct<from: long, to: long>>")
