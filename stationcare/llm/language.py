"""Language identification by compression with one raw-content zstandard dictionary per language.

A dictionary is text of one language. Every block of a text is compressed with each dictionary and the language
with the smallest sum wins. Blocks are short, so that a text is measured against the dictionary and not against
itself. Short texts, and texts whose margin is narrow, are encoded again with stronger settings and several
dictionaries a language; what stays narrow is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationcare.llm.text import pieces
from stationcare.operators.tables import settled

UNKNOWN = "und"
DICTIONARY_BYTES = 32_768
PARTS = 4
#: The fit reads a sample: at most so many texts a language, a stretch of each from a hashed place, all cut to
#: equal shares of PARTS * DICTIONARY_BYTES.
SAMPLE_TEXTS = 512
SAMPLE_CHARS = 1_000
BLOCK_BYTES = 1_024
LEVEL, SECOND_LEVEL = 5, 12
SHORT_BYTES = 400
NARROW = 0.02
REJECT = 0.005

_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_LETTER = regex.compile(r"\p{L}")


def fold(text: str) -> bytes:
    """Lower case; other ASCII characters than letters become single blanks."""
    return b" ".join(text.lower().encode(errors="replace").translate(_FOLD).split())


@dataclass(frozen=True)
class Dictionaries:
    """Sampled text of each language, in language order."""

    texts: dict[str, bytes]

    def coders(self, level: int, parts: int) -> list[tuple[str, list]]:
        out = []
        for lang, text in sorted(self.texts.items()):
            own = []
            for k in range(parts):
                content = text[k * DICTIONARY_BYTES:(k + 1) * DICTIONARY_BYTES]
                # too little text for another part: take the first one again
                content = content if len(content) >= DICTIONARY_BYTES // 2 else text[:DICTIONARY_BYTES]
                known = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=level)
                own.append(zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False,
                                                    write_checksum=False, write_dict_id=False))
            out.append((lang, own))
        return out


def drawn(labelled: DataFrame, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """``lang, rank, text``: at most ``texts`` different texts a language, a stretch of SAMPLE_CHARS of each.

    The hash of doc_id and text draws, so texts that share a doc_id (or have none) are drawn one by one and
    repeated rows count once. The stretch begins at a hashed place, so that common openings do not dominate.
    """
    known = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    cells = F.lit(1 << 52)
    hashed = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("_hash"))
    counts = (hashed.groupBy("lang").agg(F.approx_count_distinct("_hash").alias("_n"))
              .select(F.col("lang").alias("_lang"), "_n"))
    # a thinned table first, where the rows lie, so that no task sees a whole language
    thin = (hashed.withColumn("_draw", F.pmod(F.xxhash64("_hash", F.lit("dictionary")), cells) / cells)
            .join(settled(counts), F.col("lang") == F.col("_lang")).filter(F.col("_draw") * F.col("_n") < 4 * texts))
    last = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64("_hash", F.lit("place")), last) + 1).cast("int")
    once = thin.select("lang", "_draw", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text")).distinct()
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("_draw", "text")))
    return ranked.filter(F.col("rank") <= texts).select("lang", "rank", "text")


def fit(labelled: DataFrame, texts: int = SAMPLE_TEXTS) -> Dictionaries:
    """Dictionaries from ``doc_id, text, lang`` rows: at most ``texts`` texts a language, see ``drawn``.

    Every text drawn gives the same number of bytes at most, so that all of them fit in the dictionaries. The
    driver receives at most ``texts * SAMPLE_CHARS`` characters a language. Rows without text or language do not
    count, repeated rows count once; an empty table teaches no language, and all predictions are ``und``.
    """
    found: dict[str, list[bytes]] = {}
    for r in sorted(drawn(labelled, texts).collect(), key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(fold(r["text"]))
    room = PARTS * DICTIONARY_BYTES
    return Dictionaries({lang: b" ".join(p[:max(room // len(parts) - 1, 1)] for p in parts)[:room]
                         for lang, parts in found.items()})


def _sizes(raw: bytes, coders: list[tuple[str, list]]) -> np.ndarray:
    blocks = [raw[a:a + BLOCK_BYTES] for a in range(0, max(len(raw), 1), BLOCK_BYTES)]
    return np.array([sum(len(c.compress(b)) for c in own for b in blocks) for _, own in coders], np.float64)


def _margin(sizes: np.ndarray) -> float:
    if len(sizes) < 2:
        return 1.0
    best, second = np.partition(sizes, 1)[:2]
    return float((second - best) / second)


def predict(docs: DataFrame, model: Dictionaries, reject: float = REJECT) -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected`` for every whole text.

    ``margin`` is how much larger the second smallest encoding is, relative to it; ``score`` rises with it from
    0.5 to 1; ``rejected`` marks margins under ``reject``, where ``lang_pred`` is still the smallest (ties: first
    by name). ``und`` with score 0, rejected: the text is null or has no letter, or no language was learned.
    One row per row of ``docs``, repeated rows included; an empty table gives an empty table; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = model.coders(LEVEL, 1), None
        names = [lang for lang, _ in first]
        for piece in pieces(batches):
            out = []
            for text in piece.column("text").to_pylist():
                if not text or not names or not _LETTER.search(text):
                    out.append((UNKNOWN, 0.0, 0.0, True))
                    continue
                raw = fold(text)
                sizes = _sizes(raw, first)
                margin = _margin(sizes)
                if margin < NARROW or len(raw) < SHORT_BYTES:
                    second = second or model.coders(SECOND_LEVEL, PARTS)
                    sizes = _sizes(raw, second)
                    margin = _margin(sizes)
                out.append((names[int(np.argmin(sizes))], 1 - 0.5 * float(np.exp(-margin / NARROW)), margin,
                            margin < reject))
            columns = [pa.array([o[k] for o in out], kind) for k, kind in
                       enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns],
                                             ["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")
