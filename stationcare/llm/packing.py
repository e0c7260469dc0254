"""Lexical retrieval packing: training sequences whose documents share rare tokens.

Each task cuts its rows into shards of bounded size. A shard builds a BM25 inverted index over the token ids of
its documents; the first document of a window is its seed and asks the index, with all of its tokens, for unused
neighbours, which fill the window greedily: best first while whole documents fit, then the best remaining one is cut
to close the window and its rest seeds the next one. The window that is open at the end of a shard goes on into the
next shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcare.llm.text import pieces
from stationcare.llm.tokens import Tokenizer

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 1_000_000
K1, B = 1.2, 0.75
PIECE_BYTES = 2 << 20


class Index:
    """BM25 postings over token ids: for each token the documents that hold it, with finished weights."""

    def __init__(self, ids: np.ndarray, at: np.ndarray):
        sizes = np.diff(at)
        docs = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        keys = np.sort((ids.astype(np.int64) << 32) | docs)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        begin = np.flatnonzero(new)
        tf = np.diff(np.append(begin, len(keys))).astype(np.float64)
        self.docs = keys[begin] & 0xFFFFFFFF
        terms = keys[begin] >> 32
        first = np.ones(len(terms), bool)
        first[1:] = terms[1:] != terms[:-1]
        self.at = np.append(np.flatnonzero(first), len(terms))
        self.terms = terms[self.at[:-1]]
        df = np.diff(self.at)
        self.idf = np.log1p((len(sizes) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(sizes.mean(), 1))
        self.weights = np.repeat(self.idf, df) * tf * (K1 + 1) / (tf + norm[self.docs])
        self.shared = df > 1
        self.size = len(sizes)

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 score of every document for all tokens of the query that several documents hold."""
        wanted = np.unique(query)
        slot = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        slot = slot[(self.terms[slot] == wanted) & self.shared[slot]]
        begin, sizes = self.at[slot], self.at[slot + 1] - self.at[slot]
        spots = np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)
        return np.bincount(self.docs[spots], self.weights[spots], self.size)

    def neighbours(self, query: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a token with the query, by falling score; ties by position."""
        return ranked(self.scores(query), used)


def ranked(scores: np.ndarray, used: np.ndarray) -> np.ndarray:
    found = np.flatnonzero((scores > 0) & ~used)
    return found[np.lexsort((found, -scores[found]))]


class Packer:
    """State of one task: the open window and the number of closed ones."""

    def __init__(self, window: int, first_sequence: int, with_ids: bool):
        self.window, self.sequence, self.with_ids = window, first_sequence, with_ids
        self.fill, self.open, self.seed, self.rows = 0, [], np.zeros(0, np.int32), []
        self.scores: np.ndarray | None = None  # of the seed in the present shard, once asked for

    def put(self, doc: tuple, ids: np.ndarray) -> None:
        """Lay the ids of one document into windows, closing each that fills up."""
        start, whole = 0, ids
        while len(ids):
            part = ids[:self.window - self.fill]
            if not self.fill:
                self.seed, self.scores = whole, None
            self.open.append((*doc, start, part, self.fill))
            self.fill += len(part)
            start, ids = start + len(part), ids[len(part):]
            if self.fill == self.window:
                self.close()

    def close(self) -> None:
        for doc_id, total, start, part, offset in self.open:
            raw = part.astype("<u4").tobytes()
            self.rows.append((doc_id, start, len(part), zlib.crc32(raw), total, self.sequence, offset,
                              part if self.with_ids else None))
        self.sequence, self.fill, self.open = self.sequence + 1, 0, []

    def flush(self) -> None:
        """Close the last window as sequences of powers of two, which need no padding."""
        left, self.open, self.fill = self.open, [], 0
        total = sum(len(p[3]) for p in left)
        room = 0
        for doc_id, size, start, part, _ in left:
            while len(part):
                if not room:
                    room = 1 << (total.bit_length() - 1)
                    total -= room
                cut = part[:room]
                self.open.append((doc_id, size, start, cut, self.fill))
                self.fill, room, start, part = self.fill + len(cut), room - len(cut), start + len(cut), part[len(cut):]
                if not room:
                    self.close()

    def shard(self, docs: list[tuple], ids: np.ndarray, at: np.ndarray) -> None:
        """Pack all documents of a shard; ``docs`` holds (doc_id, number of ids)."""
        sizes = np.diff(at)
        index = Index(ids, at)
        self.scores = None
        used = np.zeros(len(sizes), bool)
        following = 0

        def lay(i: int) -> None:
            used[i] = True
            self.put(docs[i], ids[at[i]:at[i + 1]])

        while True:
            while following < len(sizes) and used[following]:
                following += 1
            if following == len(sizes):
                return
            if not self.fill:
                lay(following)
                continue
            if self.scores is None:
                self.scores = index.scores(self.seed)
            best = ranked(self.scores, used)
            sequence = self.sequence
            cut = None
            for i in best.tolist():
                if sizes[i] <= self.window - self.fill:
                    lay(i)
                    if self.sequence != sequence:
                        break
                elif cut is None:
                    cut = i
            if self.sequence == sequence:
                if cut is not None:
                    lay(cut)
                elif not len(best):
                    lay(following)


def _packed(path: str | None, window: int, shard_tokens: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(7)]
        if with_ids:
            columns.append(pa.array([r[7] for r in rows], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Tokenizer(path)
        # sequence numbers of a task come from its partition, so a repeated task gives the same ones
        packer = Packer(window, TaskContext.get().partitionId() << 40, with_ids)
        docs, parts, held = [], [], 0

        def finish() -> None:
            sizes = [len(p) for p in parts]
            packer.shard(docs, np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)]))

        for piece in pieces(batches, size=PIECE_BYTES):
            ids, at = bpe.encode([t or "" for t in piece.column("text").to_pylist()])
            for doc_id, a, b in zip(piece.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                docs.append((doc_id, b - a + 1))
                parts.append(np.append(ids[a:b], np.int32(END_ID)))
                held += b - a + 1
                if held >= shard_tokens:
                    finish()
                    docs, parts, held = [], [], 0
                    yield batch(packer.rows)
                    packer.rows = []
        if docs:
            finish()
        packer.flush()
        if packer.rows:
            yield batch(packer.rows)

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS,
         with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, one row each: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    and, if wanted, the ``ids`` themselves.

    A document is its byte-pair ids and END_ID; a null text is empty, so that its only id is END_ID. Each id lies
    in one piece. Every sequence has exactly ``window`` ids, but for the last ones of a partition, whose lengths
    are powers of two. Repeated rows are packed as often as they stand there. An empty table gives no rows.
    ``path`` names the ranks file of the vocabulary.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    kinds = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
             + ", ids array<int>" * with_ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _packed(path, window, shard_tokens, with_ids), kinds)
