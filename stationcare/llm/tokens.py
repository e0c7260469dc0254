"""Byte-pair ids of whole batches of texts, equal to the tokenizer's own, with each distinct word encoded once.

A byte-level BPE splits a text into pieces by a pattern and merges inside pieces only. Pieces are found here
for all texts of a batch at once (NumPy over UTF-16 units), so each distinct piece goes through the tokenizer
once per batch or comes from a bounded cache. Texts with characters beyond the Latin blocks go through the
tokenizer whole.
"""

from __future__ import annotations

import base64

import numpy as np
import regex
import tiktoken

from stationcare.llm.text import BASE, mix, powers

CACHE_PIECES = 1_000_000
LATIN_LIMIT = 0x250
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pattern of the vocabulary, written without needless backtracking; it splits every text alike.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_LETTER, _NUMBER, _SPACE, _OTHER, _FOREIGN = range(5)


def _unit_classes() -> np.ndarray:
    kinds = np.full(1 << 16, _FOREIGN, np.uint8)
    for code in range(LATIN_LIMIT):
        c = chr(code)
        kinds[code] = (_LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c)
                       else _SPACE if regex.match(r"\s", c) else _OTHER)
    return kinds


class Tokenizer:
    """``path``: ranks file of the vocabulary (default: the public tokenizer package's)."""

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kinds = _unit_classes()
        self.line = ranks[b"\n"]
        self.values = np.random.default_rng(3).integers(0, 2**64, 1 << 16, dtype=np.uint64)
        self.powers = powers(1 << 12, BASE)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)

    def _add(self, hashes: np.ndarray, units: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
             white: np.ndarray) -> None:
        """Encode new pieces with one call; line breaks between them never merge with a neighbour."""
        words = ~white
        stops = np.cumsum(lengths[words] + 1)  # a line break behind each
        text = np.full(int(stops[-1]) if len(stops) else 0, 10, np.uint16)
        spread = np.arange(len(text)) - np.repeat(stops - lengths[words] - 1, lengths[words] + 1)
        spread += np.repeat(starts[words], lengths[words] + 1)
        real = np.ones(len(text), bool)
        real[stops - 1] = False
        text[real] = units[spread[real]]
        ids = np.array(self.bpe.encode_ordinary(text.tobytes().decode("utf-16-le", "surrogatepass")), np.int32)
        breaks = np.flatnonzero(ids == self.line)
        counts = np.diff(np.concatenate([[-1], breaks])) - 1
        parts = [ids[ids != self.line]]
        for a, n in zip(starts[white].tolist(), lengths[white].tolist(), strict=True):
            own = self.bpe.encode_ordinary(units[a:a + n].tobytes().decode("utf-16-le", "surrogatepass"))
            parts.append(np.array(own, np.int32))
            counts = np.append(counts, len(own))
        base = len(self.known)
        new = np.concatenate([hashes[words], hashes[white]]).tolist()
        self.known.update(zip(new, range(base + 1, base + 1 + len(new)), strict=True))
        fresh = np.concatenate(parts)
        held = self.ends[base]
        for name, used, size in (("flat", held, len(fresh)), ("ends", base + 1, len(new))):
            store = getattr(self, name)
            if used + size > len(store):
                setattr(self, name, np.concatenate([store[:used], np.zeros(used + 2 * size, store.dtype)]))
        self.flat[held:held + len(fresh)] = fresh
        self.ends[base + 1:base + 1 + len(new)] = held + np.cumsum(counts)

    def _piece_starts(self, kinds: np.ndarray, units: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(units)
        head = np.zeros(n + 1, bool)
        head[offsets] = True
        before = np.empty(n, np.uint8)  # class of the unit before, none at a text's start
        before[0], before[1:] = 255, kinds[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = 255
        after = np.empty(n, np.uint8)
        after[-1], after[:-1] = 255, kinds[1:]
        after[offsets[1:] - 1] = 255
        space = kinds == _SPACE
        blank = units == 32
        follows_blank = np.zeros(n, bool)
        follows_blank[1:] = blank[:-1]
        follows_blank &= before != 255
        # a run of one class begins a piece, unless a blank before it belongs to it
        start = ~space & (kinds != before) & ~follows_blank
        # white space: its first unit, and its last one if something other follows
        start |= space & (before != _SPACE)
        start |= space & (after != _SPACE) & (after != 255)
        # contractions: a lone apostrophe that no blank precedes takes the letters of its ending
        quote = np.flatnonzero((units == 39) & start & (after == _LETTER))
        if len(quote):
            padded = np.concatenate([units, np.zeros(3, units.dtype)])
            text_end = offsets[np.searchsorted(offsets, quote, side="right")]
            one, two = padded[quote + 1], padded[quote + 2]
            two = np.where(quote + 2 < text_end, two, 0)
            pair = one.astype(np.int64) << 16 | two
            length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
            length = np.where(np.isin(pair, [ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")]), 2, length)
            quote, length, text_end = quote[length > 0], length[length > 0], text_end[length > 0]
            start[quote + 1] = False
            rest = quote + 1 + length
            inside = rest < text_end
            rest = rest[inside]
            start[rest[kinds[rest] == _LETTER]] = True
        start |= head[:-1]
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32) and the offsets of the texts among them."""
        raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
        sizes = np.array([len(r) // 2 for r in raw], np.int64)
        units = np.frombuffer(b"".join(raw), np.uint16)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        kinds = self.kinds[units]
        foreign = np.flatnonzero(kinds == _FOREIGN)
        if len(foreign):
            whole = np.unique(np.searchsorted(offsets, foreign, side="right") - 1)
            rest = np.setdiff1d(np.arange(len(texts)), whole)
            ids, at = self.encode([texts[i] for i in rest])
            parts: list = [None] * len(texts)
            for j, i in enumerate(rest):
                parts[i] = ids[at[j]:at[j + 1]]
            for i in whole:
                parts[i] = np.array(self.bpe.encode_ordinary(texts[i]), np.int32)
            return (np.concatenate(parts).astype(np.int32),
                    np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))
        if not len(units):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        if len(self.known) > CACHE_PIECES:
            self._clear()
        starts = self._piece_starts(kinds, units, offsets)
        lengths = np.diff(np.append(starts, len(units)))
        if lengths.max() > len(self.powers):
            self.powers = powers(1 << int(lengths.max()).bit_length(), BASE)
        local = np.arange(len(units)) - np.repeat(starts, lengths)
        hashes = mix(np.add.reduceat(self.values[units] * self.powers[local], starts))
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        new = np.array([i for i, k in enumerate(keys) if k not in self.known], np.int64)
        if len(new):
            at = starts[first[new]]
            size = lengths[first[new]]
            self._add(distinct[new], units, at, size, kinds[at + size - 1] == _SPACE)
        slot = np.array([self.known[k] for k in keys], np.int64)[inverse]
        begin, count = self.ends[slot - 1], self.ends[slot] - self.ends[slot - 1]
        stops = np.cumsum(count)
        place = np.arange(stops[-1]) + np.repeat(begin - (stops - count), count)
        text_of = np.searchsorted(starts, offsets)
        return self.flat[place], np.concatenate([[0], stops])[text_of]
