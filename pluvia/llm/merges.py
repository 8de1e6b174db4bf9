"""Ids of many texts at once by a merge tokenizer that drops white space, on Arrow kernels and arrays.

No merge crosses white space there, so a text is split at ASCII blanks, only its distinct chunks are cut into
parts, and only distinct parts go through the merges, all of one length together. Chunks outside the plain
Latin range, and parts longer than the widest table, go through the tokenizer itself. The ids equal those of
``Tokenizer.encode`` of each whole text with ``add_special_tokens=False``.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks of characters that have one lower-case form, are their own NFC form and are no white space.
PLAIN = r"^[\x{21}-\x{84}\x{86}-\x{9f}\x{a1}-\x{12f}\x{131}-\x{24f}]*$"

#: What the start of a special token looks like; chunks with it go through the tokenizer.
SPECIAL = "<|"

#: Fixed value: the pre-tokenizer's pattern, as in the tokenizer's file (chunks hold no white space).
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+"

#: Parts are merged in tables of these widths in bytes, so many parts at a time.
WIDTHS = (4, 6, 8, 9, 10, 11, 12, 14, 16, 20, 24, 32, 48)
ROWS = 8192

PAD, FREE = np.uint16(0xFFFF), np.uint32(0xFFFFFFFF)
NO_RANK = np.int32(1 << 24)
SLOTS = 20


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def spread(values: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches number ``at`` of ``values`` (each from ``start``, ``size`` long) in a row, and where each ends."""
    n = size[at]
    ends = np.cumsum(n)
    shift = (start[at] - (ends - n)).astype(np.int32)  # arrays of a slice are far below 2^31 ids
    return values[np.repeat(shift, n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)], ends


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS)).astype(np.int64)


class MergeEncoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, last = model["vocab"], model["end_of_word_suffix"]
        self.chars = byte_chars()
        self.inner = np.array([ids[c] for c in self.chars], np.uint16)
        self.last = np.array([ids[c + last] for c in self.chars], np.uint16)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = np.array([ids[a + b] for a, b in pairs], np.uint16)
        self._fill(np.array([ids[a] << 16 | ids[b] for a, b in pairs], np.uint32))

    def _fill(self, keys: np.ndarray) -> None:
        """An open hash table from pairs of ids to the rank of their merge."""
        self.keys, self.rank = np.full(1 << SLOTS, FREE), np.full(1 << SLOTS, NO_RANK)
        at, left = _slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == FREE]
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.rank[at[free]] = keys[free], free
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << SLOTS) - 1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = ((a.astype(np.uint32) << np.uint32(16)) | b).ravel()
        at = _slot(keys)
        there, out = self.keys[at], self.rank[at]
        other = np.flatnonzero(there != keys)
        out[other] = NO_RANK
        other = other[there[other] != FREE]
        while len(other):
            at[other] = (at[other] + 1) & ((1 << SLOTS) - 1)
            there = self.keys[at[other]]
            hit = there == keys[other]
            out[other[hit]] = self.rank[at[other[hit]]]
            other = other[~hit & (there != FREE)]
        return out.reshape(a.shape)

    def _merge(self, ids: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merges the columns of ``ids``: in each step every part's best pair, the leftmost of equals."""
        out = []
        rank = self.ranks(ids[:-1], ids[1:])
        while len(ids) > 1:
            place = np.arange(len(ids) - 1, dtype=np.int32)[:, None]
            best = (rank * 64 + place).min(0)
            go = best < NO_RANK * 64
            if not go.all():
                out.append((rows[~go], ids[:, ~go]))
                rows, ids, rank, best = rows[go], ids[:, go], rank[:, go], best[go]
                if not len(rows):
                    return out
            at = best & 63
            ids = np.where(place > at, ids[1:], ids[:-1])
            ids[at, np.arange(len(rows))] = self.merged[best >> 6]
            rank = np.where(place[:-1] >= at, rank[1:], rank[:-1])
            left = np.flatnonzero(at > 0)
            rank[at[left] - 1, left] = self.ranks(ids[at[left] - 1, left], ids[at[left], left])
            right = np.flatnonzero(at < len(ids) - 1)
            rank[at[right], right] = self.ranks(ids[at[right], right], ids[at[right] + 1, right])
        out.append((rows, ids))
        return out

    def parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct parts: all ids, and each part's begin and size."""
        raw = parts.cast(pa.binary())
        begin = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4).astype(np.int64)
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        n = np.diff(begin)
        size, done, least = np.zeros(len(n), np.int64), [], 0
        for width in WIDTHS:
            rows = np.flatnonzero((n > least) & (n <= width))
            least = width
            for k in range(0, len(rows), ROWS):
                own = rows[k : k + ROWS]
                place, m = np.arange(width)[:, None], n[own]
                ids = self.inner[data[np.minimum(begin[own] + place, len(data) - 1)]]
                ids[m - 1, np.arange(len(own))] = self.last[data[begin[own] + m - 1]]
                ids[place >= m] = PAD
                done += self._merge(ids, own)
        for rows, ids in done:
            size[rows] = (ids != PAD).sum(0)
        long = {}
        for i in np.flatnonzero(n > WIDTHS[-1]).tolist():
            long[i] = [t.id for t in self.tokenizer.model.tokenize("".join(self.chars[b] for b in raw[i].as_py()))]
            size[i] = len(long[i])
        start = np.cumsum(size) - size
        flat = np.zeros(size.sum(), np.uint32)
        for rows, ids in done:
            place = np.arange(len(ids))[:, None] + start[rows]
            some = ids != PAD
            flat[place[some]] = ids[some]
        for i, own in long.items():
            flat[start[i] : start[i] + size[i]] = own
        return flat, start, size

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks: all ids, and each chunk's begin and size."""
        plain = pc.and_not(pc.match_substring_regex(chunks, PLAIN), pc.match_substring(chunks, SPECIAL))
        low = pc.if_else(plain, pc.utf8_lower(chunks), "")
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(low, pattern=PARTS, replacement=r"\0 "))
        ends = np.asarray(cut.offsets).astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        flat, stops = spread(*self.parts(coded.dictionary), np.asarray(coded.indices))
        stops = np.concatenate([[0], stops])[ends - ends[0]]
        start, size = stops[:-1].copy(), np.diff(stops)
        odd = np.flatnonzero(~np.asarray(plain))
        more = [self.tokenizer.encode(c, add_special_tokens=False).ids for c in chunks.take(pa.array(odd)).to_pylist()]
        size[odd] = [len(x) for x in more]
        start[odd] = len(flat) + np.cumsum(size[odd]) - size[odd]
        return np.concatenate([flat, *(np.array(x, np.uint32) for x in more)]), start, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array, and where each text's ids end."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        flat, stops = spread(*self.chunks(coded.dictionary), np.asarray(coded.indices))
        return flat, np.concatenate([[0], stops])[ends[1:] - ends[0]]
