"""Document fingerprints: MinHash signatures of word shingles.

``signatures`` hashes every shingle of five words once and sends the hashes through many universal hash
functions, in NumPy over whole batches. ``near_duplicates`` cuts signatures into bands, joins documents on
equal bands in Spark and verifies the Jaccard similarity of the whole shingle sets. ``edited_fingerprints``
compares each document with its neighbour in doc_id order and with a mixture of both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcare.llm.jaccard_join import Bands, jaccard_classes
from stationcare.llm.text import SHINGLE_WORDS, Permutations, buffers, pieces, shingle_hashes
from stationcare.operators.ordered import MAX_BUCKETS, bucketed

HASHES = 128
BAND_ROWS = 4
THRESHOLD = 0.8
ROWS_PER_BUCKET = 4_000


def hexed(sig: np.ndarray) -> list[str]:
    """Lower 16 bits of every value, as text."""
    return [row.tobytes().hex() for row in sig.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values in two tables of signatures (as kept in the fingerprints: 16 bits)."""
    return (a.astype(np.uint16) == b.astype(np.uint16)).mean(axis=1)


def _signed(texts: list[bytes], hashes: Permutations, words: int) -> np.ndarray:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return hashes.signatures(*shingle_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets, words))


def signatures(docs: DataFrame, hashes: int = HASHES, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, n_shingles, signature array<int>``. A text without a word has no shingle: all values are -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = Permutations(hashes)
        for piece in pieces(batches):
            shingles, at = shingle_hashes(*buffers(piece.column("text")), words)
            sig = functions.signatures(shingles, at).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, hashes, dtype=np.int32)),
                                             pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(np.diff(at)), lists], ["doc_id", "n_shingles", "signature"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, n_shingles long, signature array<int>")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, hashes: int = HASHES,
                    band_rows: int = BAND_ROWS, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, class_id, n_links``: documents whose signatures share a band, verified on whole shingle sets.

    Bands of the signatures are joined in Spark; the groups they form are verified tile by tile, so a group of
    copies is never expanded into pairs. See ``jaccard_join.jaccard_classes`` for nulls, ties and copies.
    """
    return jaccard_classes(docs, threshold, words, plan=Bands(hashes // band_rows, band_rows))


def _edited(hashes: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = Permutations(hashes)
        before: tuple | None = None  # part, doc_id, text, signature of the row that waits for its successor

        for piece in pieces(batches):
            parts = piece.column("part").to_pylist()
            ids = piece.column("doc_id").to_pylist()
            halo = piece.column("halo").to_pylist()
            texts = [t or "" for t in piece.column("text").to_pylist()]
            sig = _signed([t.encode() for t in texts], functions, words)
            rows = [(*x, s) for x, s in zip(zip(parts, ids, texts, halo, strict=True), sig, strict=True)]
            pairs = []
            for row in rows:
                if before is not None and before[0] == row[0] and not before[3]:
                    pairs.append((before, row))
                before = row
            if not pairs:
                continue
            mixed = [a[2][:len(a[2]) - len(a[2]) // 2] + b[2][:len(a[2]) // 2] for a, b in pairs]
            raw = [m.encode() for m in mixed]
            own = np.stack([a[4] for a, _ in pairs])
            following = np.stack([b[4] for _, b in pairs])
            changed = _signed(raw, functions, words)
            yield pa.RecordBatch.from_arrays([
                pa.array([a[1] for a, _ in pairs], pa.int64()),
                pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                pa.array(hexed(own), pa.string()), pa.array(hexed(changed), pa.string()),
                pa.array(likeness(own, changed)), pa.array(likeness(own, following))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return run


def edited_fingerprints(docs: DataFrame, hashes: int = HASHES, words: int = SHINGLE_WORDS,
                        buckets: int | None = None) -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness; one row per row of ``docs``.

    The edited text replaces the last ``floor(n / 2)`` code points by the first as many (or all) of the next
    document in descending doc_id order; after the last comes the first (a single document follows itself).
    Rows with one doc_id are ordered by a hash of their text, null doc_ids come last, null texts are empty. A
    text without a word has the fingerprint ``ffff...``. An empty table gives an empty table; other columns
    are not read.

    Rows fall into buckets of consecutive (doc_id, hash of the text), so different texts of one doc_id spread. The first row of each bucket is also sent to the bucket
    before it, so each task finds every successor without a window over the whole table. The driver holds one
    key per bucket.
    """
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = named.withColumn("_hash", F.xxhash64("text"))
    rows = named.count()
    if buckets is None:
        parallel = 4 * spark.sparkContext.defaultParallelism
        buckets = int(min(MAX_BUCKETS, max(parallel, rows // ROWS_PER_BUCKET), max(1, rows // 500)))
    placed = bucketed(named, ["doc_id", "_hash"], rows=rows, buckets=buckets)
    # the bucket's first row in descending order; nulls are smallest
    heads = (placed.groupBy("_bucket").agg(F.max(F.struct("doc_id", "_hash")).alias("_head"))
             .select("_bucket", "_head.doc_id", "_head._hash").orderBy("_bucket").collect())
    if not heads:
        return placed.limit(0).select(
            "doc_id", F.lit(0).cast("long").alias("n_chars"), *[F.lit("").alias(c) for c in
            ("edited_sha256", "fingerprint", "edited_fingerprint")],
            *[F.lit(0.0).alias(c) for c in ("near_edited", "near_next")])
    # successors: bucket k's last row is followed by the head of the next lower bucket, the lowest by the highest
    order = [h["_bucket"] for h in heads]
    target = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    rows = [(h["_bucket"], h["doc_id"], h["_hash"], target[h["_bucket"]]) for h in heads]
    ends = spark.createDataFrame(rows, "_b int, _id long, _h long, _to int")
    flagged = placed.join(F.broadcast(ends), (F.col("_bucket") == F.col("_b"))
                          & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    places = F.array(F.struct(F.col("_bucket").alias("part"), F.lit(False).alias("halo")),
                     F.struct(F.col("_to").alias("part"), F.lit(True).alias("halo")))
    sent = (flagged.select("doc_id", "_hash", "text", F.explode(F.filter(places, lambda p: p["part"].isNotNull()))
                           .alias("_p")).select("doc_id", "_hash", "text", "_p.part", "_p.halo"))
    sorted_parts = sent.repartition(len(order), "part").sortWithinPartitions(
        "part", "halo", F.col("doc_id").desc_nulls_last(), F.col("_hash").desc())
    return sorted_parts.select("part", "halo", "doc_id", "text").mapInArrow(
        _edited(hashes, words), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double")
