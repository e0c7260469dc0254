"""Fill-in-middle: texts cut in line units, rearranged as prefix, suffix and middle.

Each batch runs through one columnar pipeline: texts become lists of units, the lists are flattened with the
index of their text, units are numbered within their text, filtered by the part they belong to, gathered in
lists again and joined. No row is looked at by itself and nothing is shuffled. ``restored`` rebuilds the text
from what was written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcare.llm.text import pieces

#: fixed values: the marks before each part
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
RATE = 100
SPM_SHARE = 50

_TEXT = pa.large_string()
_NONE = pa.scalar("", _TEXT)


def _mark(value: str) -> pa.Scalar:
    return pa.scalar(value, _TEXT)


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Units of all texts in one array, the text and the place of each, and the number of units of each text.

    The piece behind the last line end is a unit only if it is not empty; an empty one keeps its place behind all
    others, where it changes nothing.
    """
    lists = pc.split_pattern(texts, "\n")
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    places = np.arange(len(flat), dtype=np.int64) - (ends - sizes)[parents]
    last = places == sizes[parents] - 1
    units = pc.binary_join_element_wise(flat, pc.if_else(pa.array(last), _NONE, _mark("\n")), _NONE)
    behind = pc.equal(flat.take(pa.array(ends - 1)), _NONE).to_numpy(zero_copy_only=False)
    return units, parents, places, sizes - behind


def _part(units: pa.Array, parents: np.ndarray, chosen: np.ndarray, texts: int) -> pa.Array:
    """The chosen units of each text, joined."""
    counts = np.bincount(parents[chosen], minlength=texts)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, units.filter(pa.array(chosen))), _NONE)


def _arranged(rate: int, spm_share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = pc.fill_null(batch.column("text").cast(_TEXT), _NONE)
            h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
            units, parents, places, n = _units(texts)
            first, second = h1 % (n + 1), h2 % (n + 1)
            after = (places >= np.minimum(first, second)[parents]).astype(np.int8)
            after += places >= np.maximum(first, second)[parents]
            prefix, middle, suffix = (_part(units, parents, after == k, len(texts)) for k in range(3))
            plain = pc.equal(texts, _NONE)
            for mark in (PREFIX, SUFFIX, MIDDLE):
                plain = pc.or_(plain, pc.match_substring(texts, mark))
            plain = pc.or_(plain, pa.array(h3 % 100 >= rate))
            spm = pa.array(h4 % 100 < spm_share)
            form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
            psm_text = pc.binary_join_element_wise(_mark(PREFIX), prefix, _mark(SUFFIX), suffix, _mark(MIDDLE), middle, _NONE)
            spm_text = pc.binary_join_element_wise(_mark(SUFFIX), suffix, _mark(PREFIX), prefix, _mark(MIDDLE), middle, _NONE)
            output = pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text))
            chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(p).cast(pa.int64()))
                     for p in (prefix, middle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), form, *chars, output.cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: one row per row of ``docs``.

    A text is cut in ``n`` units, lines with their line end. The first four 8-digit groups of the sha256 of
    ``seed:doc_id`` choose where prefix and middle end, whether the text is rearranged (``rate`` in a hundred) and
    in which order (``spm_share`` in a hundred begin with the suffix). ``form`` is ``plain`` where the text stays
    as it is: an empty or null text, or one that holds a mark itself; the numbers of characters are null then.

    Repeated rows and rows with one doc_id are cut each by itself (equal doc_ids draw equal numbers); a null doc_id
    stands for an empty number. A text without a line end is one unit. An empty table gives an empty table; other
    columns are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest.alias("_d")).select(
        "doc_id", "text", *[F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}")
                            for i in range(4)])
    return drawn.mapInArrow(_arranged(rate, spm_share), "doc_id long, n long, form string, prefix_chars long, "
                            "middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` was given. A rearranged text holds each mark once, so each cut is certain."""
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)

    def cut(text: Column, mark: str, part: int) -> Column:
        return F.split_part(text, F.lit(mark), F.lit(part))

    rest = cut(body, SUFFIX, 2)
    psm = F.concat(cut(body, SUFFIX, 1), cut(rest, MIDDLE, 2), cut(rest, MIDDLE, 1))
    rest = cut(body, PREFIX, 2)
    spm = F.concat(cut(rest, MIDDLE, 1), cut(rest, MIDDLE, 2), cut(body, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
