"""Byte-pair encoding and decoding of many texts at once, in batched merge rounds on arrays.

The distinct words of a slice of texts lie in one flat array of symbols. In a round each word finds its pair of lowest rank, by binary search of
all neighbouring pairs in the sorted pair keys; the pair is merged wherever it stands in the word, the array closes up, and ranks
are looked up again beside what was merged. Words without a pair that merges leave the array, so later rounds work on few symbols.

Merging all places of a pair in one round gives what merging them one by one from the left gives, if nothing that is made
of the new symbol has a lower rank; pairs for which a vocabulary doesn't ensure that are merged at the leftmost place only.

Text is cut like this: strings of special tokens first, then Unicode NFC, lower case, and the pre-tokenizer's parts without white space. No
part reaches over an ASCII blank, so a slice is cut there first and only its distinct chunks are taken apart: plain Latin ones by Arrow
kernels, others by the file's normalizer and pattern, whose Unicode version differs from Python's. All words are merged here.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, release
from .merges import PARTS, PLAIN, SPECIAL, byte_chars, spread
from .packing import gathered

#: Bytes of text that are encoded at once.
SLICE = 8_000_000

NO_RANK = np.int32(0x7FFFFFFF)

_TYPE = pa.struct([("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
RESULT = "struct<n_tokens:bigint,ids:binary,decoded:string>"


class RoundEncoder:
    """Encoder and decoder of one vocabulary file with word ends."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        file = Tokenizer.from_file(path)
        self.normalizer, self.cut = file.normalizer, file.pre_tokenizer[0]
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids, last = file["model"]["vocab"], file["model"]["end_of_word_suffix"]
        chars = byte_chars()
        self.inner = np.array([ids[c] for c in chars], np.int64)
        self.last = np.array([ids[c + last] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys).astype(np.int32)  # place among the sorted keys -> rank
        self.keys = keys[self.order]
        first = np.full(max(ids.values()) + 1, NO_RANK)  # the lowest rank of a pair that a symbol is in
        for side in (keys >> 32, keys & 0xFFFFFFFF):
            np.minimum.at(first, side, np.arange(len(keys), dtype=np.int32))
        self.everywhere = first[self.merged] > np.arange(len(keys))
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        tokens = {**{i: t for t, i in ids.items()}, **{i: t for t, i in self.special.items()}}
        self.tokens = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.string())

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, by binary search; ``NO_RANK`` for pairs that don't merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NO_RANK)

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words (none empty): all ids, and each word's begin and size."""
        raw = words.cast(pa.binary())
        begin = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4).astype(np.int64)
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]] if len(raw) else np.zeros(0, np.uint8)
        begin = begin - begin[0]
        symbols = self.inner[data]
        symbols[begin[1:] - 1] = self.last[data[begin[1:] - 1]]
        word, sizes = np.arange(len(raw)), np.diff(begin)
        special = np.asarray(pc.index_in(words, pa.array(list(self.special), pa.string())).fill_null(-1))
        done = [(np.flatnonzero(special >= 0), np.array(list(self.special.values()), np.int64)[special[special >= 0]], np.ones(np.count_nonzero(special >= 0), np.int64))]
        keep = special < 0
        symbols, word, sizes = symbols[np.repeat(keep, sizes)], word[keep], sizes[keep]
        ends = np.cumsum(sizes)
        rank = np.full(len(symbols), NO_RANK)
        rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        rank[ends - 1] = NO_RANK
        while len(word):
            best = np.minimum.reduceat(rank, ends - sizes)
            over = best == NO_RANK
            if over.any():
                out = np.repeat(over, sizes)
                done.append((word[over], symbols[out], sizes[over]))
                symbols, rank, word, sizes, best = symbols[~out], rank[~out], word[~over], sizes[~over], best[~over]
                ends = np.cumsum(sizes)
                if not len(word):
                    break
            owner = np.repeat(np.arange(len(word)), sizes)
            at = np.flatnonzero(rank == best[owner])
            own = owner[at]
            go = self.everywhere[best[own]] | np.r_[True, own[1:] != own[:-1]]
            row = np.r_[0, np.cumsum(np.diff(at) != 1)]  # overlapping places (of a pair of equal symbols) stand in a row: every other one counts
            go &= (np.arange(len(at)) - np.flatnonzero(np.r_[True, np.diff(row) != 0])[row]) % 2 == 0
            at, own = at[go], own[go]
            symbols[at] = self.merged[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            tail = np.zeros(len(symbols), bool)
            tail[ends - 1] = True
            tail[at] |= tail[at + 1]
            symbols, rank, tail = symbols[stay], rank[stay], tail[stay]
            sizes = sizes - np.bincount(own, minlength=len(word))
            ends = np.cumsum(sizes)
            at = at - np.arange(len(at))
            anew = np.concatenate([at, at[at > 0] - 1])
            rank[anew] = np.where(tail[anew], NO_RANK, self.ranks(symbols[anew], symbols[np.minimum(anew + 1, len(symbols) - 1)]))
        size = np.zeros(len(raw), np.int64)
        for words_, _, n in done:
            size[words_] = n
        start = np.cumsum(size) - size
        flat = np.zeros(size.sum(), np.int32)
        for words_, ids, n in done:
            flat[np.repeat(start[words_] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return flat, start, size

    def words_of(self, chunk: str) -> list[str]:
        """The words of a chunk; a special token's string is a word of its own (no part of ordinary text reads like it)."""
        out = []
        for k, x in enumerate(self.cut_special.split(chunk)):
            if k % 2:
                out.append(x)
            else:
                out += [w for w, _ in self.cut.pre_tokenize_str(self.normalizer.normalize_str(x))]
        return out

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks without ASCII blanks: all ids, and each chunk's begin and size."""
        plain = pc.and_not(pc.match_substring_regex(chunks, PLAIN), pc.match_substring(chunks, SPECIAL))
        low = pc.if_else(plain, pc.utf8_lower(chunks), "")
        cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.replace_substring_regex(low, pattern=PARTS, replacement=r"\0 ")))
        n = np.diff(np.asarray(cut.offsets)).astype(np.int64)
        odd = np.flatnonzero(~np.asarray(plain))
        more = [self.words_of(c) for c in chunks.take(pa.array(odd)).to_pylist()]
        flat = cut.flatten()
        empty = np.asarray(pc.equal(pc.binary_length(low), 0))  # what is odd, and the chunk without a character
        n[empty] = 0
        flat = flat.filter(pc.not_equal(flat, ""))
        stop = np.cumsum(n)
        sizes = n.copy()
        sizes[odd] = [len(x) for x in more]
        start = stop - n
        start[odd] = len(flat) + np.cumsum(sizes[odd]) - sizes[odd]
        words = pa.concat_arrays([flat.cast(pa.string()), pa.array([w for x in more for w in x], pa.string())]).dictionary_encode()
        ids, ends = spread(*self.merge(words.dictionary), np.asarray(words.indices))
        ends = np.r_[0, ends]
        return ids, ends[start], ends[start + sizes] - ends[start]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array, and where each text's ids end."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        flat, stops = spread(*self.chunks(coded.dictionary), np.asarray(coded.indices))
        return flat, np.r_[0, stops][ends[1:] - ends[0]]

    def decode(self, ids: np.ndarray, stops: np.ndarray) -> pa.Array:
        """The strings of each text's tokens, special ones too, with a space between two (the file has no decoder of its own)."""
        tokens = self.tokens.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, stops], pa.int32()), tokens), " ")


_WORKER: dict[str, RoundEncoder] = {}


def encode_decode(docs: DataFrame, tokenizer: str) -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is given too: a struct of the number of ids of each text, the ids
    (unsigned, 32 bits each, little-endian), and the text decoded from them.

    Defined cases: null and empty texts have no ids and decode to the empty text; so do texts of white space; repeated rows are encoded
    alike; an empty table gives no rows; other columns stay. A text is encoded as a whole in one task.
    """

    @F.arrow_udf(RESULT)
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if tokenizer not in _WORKER:
            _WORKER[tokenizer] = RoundEncoder(tokenizer)
        own = _WORKER[tokenizer]
        for batch in batches:
            parts = []
            for part in gathered(iter([pa.RecordBatch.from_arrays([batch], names=["text"])]), SLICE):
                ids, stops = own.encode(part["text"])
                packed = [None, pa.py_buffer((4 * np.r_[0, stops]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))]
                columns = [pa.array(np.diff(stops, prepend=0)), pa.Array.from_buffers(pa.binary(), len(stops), packed), own.decode(ids, stops)]
                parts.append(pa.StructArray.from_arrays(columns, fields=list(_TYPE)))
            yield pa.concat_arrays(parts) if parts else pa.array([], _TYPE)
        release()

    name = fresh(docs, "coded")
    return docs.withColumn(name, coded("text")), name
