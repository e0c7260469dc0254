"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends behind white space, or elsewhere between two characters,
where bits of the hash say so. Elsewhere that is rare while words are short; once no white space came for 32 bytes,
every byte has the same chance, so that texts without blanks get chunks of the same size. Cut points depend on the last
32 bytes only and come back right after an insertion. Chunks are deduplicated by 128-bit digest: the first place, by
(doc_id, hash of the text, start), keeps a chunk, later places lose it if the run of repeated chunks they lie in is
long enough to be a passage. Texts shorter than a passage also have one digest of the whole text, by which later
copies of them are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcare.llm.text import BYTE_VALUES, buffers, pieces
from stationcare.session import staged

HASH_BYTES = 32
MIN_CHUNK = 16
MAX_CHUNK = 1024
SPACE_BITS = 2
LONG_WORD = 12  # bytes; behind longer words one bit less, behind twice as long ones no bit must be zero
OTHER_BITS = 9
BARE_BITS = 5  # per byte of the character, where the hash knows no white space
MIN_RUN = 100
WHOLE = -1  # start of the row that stands for a whole short text
ADDED = ("_removed", "_gone")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))

_GEAR = (BYTE_VALUES >> np.uint64(32)).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes that end at each place: sum of gear[byte] << age, by doubling."""
    h = _GEAR[data]
    for span in (1, 2, 4, 8, 16):
        if span >= len(h):
            break
        ahead = h.copy()
        ahead[span:] += h[:-span] << np.uint32(span)
        h = ahead
    return h


def _since_space(data: np.ndarray) -> np.ndarray:
    """Bytes between each place and the white space before it (or the first byte of all)."""
    place = np.arange(len(data), dtype=np.int64)
    last = np.maximum.accumulate(np.where(_SPACE[data], place, -1))
    before = np.empty_like(last)
    before[:1] = -1
    before[1:] = last[:-1]
    return place - before - 1


def _may_cut(data: np.ndarray, h: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Places whose byte may be the last of a chunk; ``after`` marks those where a character ends."""
    high = h >> np.uint32(8)  # the lowest bits only know the last few bytes
    since = _since_space(data)
    bits = np.maximum(SPACE_BITS - since // LONG_WORD, 0)
    spaced = _SPACE[data] & ((high & ((1 << bits) - 1).astype(np.uint32)) == 0)
    wide = np.ones(len(data), np.uint32)  # bytes of the character that ends here
    inner = (data & 0xC0) == 0x80
    for k in (1, 2, 3):
        wide[k:] += inner[k:]
        inner[1:] &= inner[:-1].copy()
    chance = np.where(since >= HASH_BYTES - 1, wide << np.uint32(OTHER_BITS - BARE_BITS), np.uint32(1))
    return spaced | (after & ((high & np.uint32((1 << OTHER_BITS) - 1)) < chance))


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Per text the ends of its chunks, from the text's start."""
    h = gear_hashes(data)
    after = np.zeros(len(data), bool)  # the next byte starts a character
    after[:-1] = (data[1:] & 0xC0) != 0x80
    cut = np.flatnonzero(_may_cut(data, h, after))
    where = np.searchsorted(cut, offsets)
    out = []
    for i in range(len(offsets) - 1):
        start, end = int(offsets[i]), int(offsets[i + 1])
        last, ends = start, []
        for c in (cut[where[i]:where[i + 1]] + 1).tolist() + [end]:
            while c - last > MAX_CHUNK:
                # text that goes round without a cut: the last place of smallest hash is the same in every round
                least = last + (MIN_CHUNK if last > start else HASH_BYTES)
                spots = np.flatnonzero(after[least - 1:last + MAX_CHUNK]) + least
                smallest = h[spots - 1]
                forced = int(spots[np.flatnonzero(smallest == smallest.min())[-1]])
                ends.append(forced - start)
                last = forced
            # the hash of the first bytes reaches into the text before: no cut there
            least = MIN_CHUNK if last > start else max(MIN_CHUNK, HASH_BYTES)
            if c - last >= least or c == end and c > last:
                ends.append(c - start)
                last = c
        out.append(ends)
    return out


def chunks(docs: DataFrame, short: int = MIN_RUN) -> DataFrame:
    """``doc_id, text_hash, start, length, hi, lo``: every chunk of every text with its digest.

    A text of fewer than ``short`` bytes has one more row, with start ``WHOLE`` and a digest of its own kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            data, offsets = buffers(piece.column("text"))
            ends = chunk_ends(data, offsets)
            counts = np.array([len(e) for e in ends])
            stops = np.fromiter((x for e in ends for x in e), np.int64, counts.sum())
            base = np.repeat(offsets[:-1], counts)
            starts = np.zeros(len(stops), np.int64)
            starts[1:] = stops[:-1]
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])[counts > 0]
            starts[first] = 0
            raw = data.tobytes()
            digests = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in
                                zip((base + starts).tolist(), (base + stops).tolist(), strict=True)])
            sizes = np.diff(offsets)
            whole = np.flatnonzero((sizes > 0) & (sizes < short))
            digests += b"".join([xxhash.xxh3_128_digest(raw[offsets[i]:offsets[i + 1]], seed=1) for i in whole])
            halves = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2)
            row = np.concatenate([np.repeat(np.arange(len(counts)), counts), whole])
            ids, texts = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_hash"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row], pa.int64()), pa.array(texts[row], pa.int64()),
                 pa.array(np.concatenate([starts, np.full(len(whole), WHOLE)]).astype(np.int32)),
                 pa.array(np.concatenate([stops - starts, sizes[whole]]).astype(np.int32)),
                 pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                ["doc_id", "text_hash", "start", "length", "hi", "lo"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       "text").mapInArrow(
        run, "doc_id long, text_hash long, start int, length int, hi long, lo long")


def _runs(spans: list[tuple[int, int]], min_run: int) -> list[tuple[int, int]]:
    """Join touching (start, length) spans; keep those of at least ``min_run`` bytes."""
    out: list[list[int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length)
        else:
            out.append([start, start + length])
    return [(a, b) for a, b in out if b - a >= min_run]


def _cut(min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, spans = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                raw = (text or "").encode()
                spots = [(s["start"], s["length"]) for s in found or []]
                whole = any(start == WHOLE for start, _ in spots)
                gone = [(0, len(raw))] if whole else _runs(spots, min_run)
                parts, last = [], 0
                for a, b in gone:
                    parts.append(raw[last:a])
                    last = b
                kept.append(text if not gone else b"".join([*parts, raw[last:]]).decode(errors="replace"))
                removed.append(sum(b - a for a, b in gone))
                spans.append([{"start": a, "length": b - a} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(kept, pa.string()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))],
                ["_row", "text", *ADDED])

    return run


def without_repeats(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and ``_removed`` bytes, ``_gone`` spans (start, length).

    All copies but the first (smallest doc_id, then hash of the text, then start) of a chunk go where the run of
    such chunks has at least ``min_run`` bytes; a later copy of a whole text, however short, becomes empty. Chunks
    that repeat inside one text count too. Rows that share doc_id and text are one owner: equal places keep their
    chunk. Null and empty texts have no chunks; rows without a doc_id keep their text and own nothing. All other
    columns stay,
    but for columns named as the two added ones, which are replaced.
    """
    known = docs.filter(F.col("doc_id").isNotNull())
    # half a digest, counted map-side, leaves the few chunks that may repeat; whole digests decide
    often = chunks(known, min_run).groupBy("hi").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("hi")
    some = staged(chunks(known, min_run).join(often, "hi"), "chunks")
    repeated = (some.groupBy("hi", "lo")
                .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("doc_id", "text_hash", "start")).alias("_first"))
                .filter("_n > 1").select("hi", "lo", "_first"))
    later = (some.join(repeated, ["hi", "lo"])
             .filter(F.struct("doc_id", "text_hash", "start") != F.col("_first"))
             .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"))
             .agg(F.collect_list(F.struct("start", "length")).alias("_spans")))
    # other columns travel in one struct, so that no name can clash
    rest = [c for c in docs.columns if c not in ("text", *ADDED)]
    rows = docs.select(F.struct(*[f"`{c}`" for c in rest]).alias("_row"), "text",
                       F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_hash"))
    own = (F.col("_doc") == F.col("_id")) & (F.col("_hash") == F.col("_text"))
    joined = rows.join(later, own, "left").select("_row", "text", "_spans")
    kinds = T.StructType([joined.schema["_row"], T.StructField("text", T.StringType()),
                          T.StructField(ADDED[0], T.LongType()), T.StructField(ADDED[1], SPANS)])
    cut = joined.mapInArrow(_cut(min_run), kinds)
    order = [c for c in docs.columns if c not in ADDED]
    return cut.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in order], *ADDED)


def removal_digest(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, text``: what goes from each document, and what stays."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = without_repeats(plain, min_run)
    return cut.select("doc_id", (F.octet_length("text") + F.col("_removed")).cast("long").alias("n_bytes"),
                      F.col("_removed").alias("n_removed"), F.size("_gone").cast("long").alias("n_spans"),
                      F.sha2("text", 256).alias("kept_sha256"), "text")
