"""Exact tokens of whole texts from public vocabularies, each distinct piece encoded once.

Both vocabularies in use cannot merge across certain characters, so a text falls into chunks
whose encodings are independent. Arrow splits a block of texts and dictionary-encodes the
chunks; only chunks that a worker hasn't met are given to the library. The memo is bounded
and emptied when full, which changes no result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of the memo of one Python worker (about 200 bytes each).
MEMO_ENTRIES = 500_000
#: Bytes of text that are split at once.
BLOCK_BYTES = 4_000_000


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of about ``most`` bytes of text, each with the index of its first."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def chunk_index(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row offsets, chunk numbers and distinct chunks of a list array of strings."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.dictionary_encode() if len(lists.values) else pa.array([], pa.string()).dictionary_encode()
    index = coded.indices.to_numpy().astype(np.int64)
    base = offsets[0]
    return offsets - base, index[base : offsets[-1]], coded.dictionary


# -- word BPE ---------------------------------------------------------------------------------

#: ASCII marks that end a run of letters and start a chunk of their own.
_MARKS = '.,!*$&%#|;:?()"'


class WordTokens(dict):
    """Memo: letters and marks to little-endian 32-bit ids, through the ``tokenizers`` library.

    The vocabulary's splitter never crosses white space, nor the border between a letter and
    an ASCII mark other than an apostrophe. Words with ``<`` may hold special strings and go
    to the library whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        ids = np.array(self.library.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self[piece] = ids
        return ids

    def word(self, word: str) -> bytes:
        if "<" in word or max(word, default="") >= "ɐ" or "İ" in word:
            return self[word]  # special strings, combining marks, letters that lower to several
        core = word.rstrip(_MARKS)
        if len(core) == len(word) or not core or not core[-1].isalpha():
            return self[word.lower()]
        return self[core.lower()] + self[word[len(core) :]]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def word_ids(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``first row, ids, row offsets`` for blocks of texts (null: no ids)."""
    memo = word_tokens(path)
    for at, part in blocks(texts):
        lists = pc.ascii_split_whitespace(pc.fill_null(part, ""))
        offsets, index, distinct = chunk_index(lists)
        coded = [memo.word(w) for w in distinct.to_pylist()]
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), dtype="<u4")
        starts = np.cumsum(sizes) - sizes
        each = sizes[index]
        ends = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.repeat(starts[index] - ends[:-1], each) + np.arange(ends[-1])] if len(index) else flat[:0]
        yield at, ids, ends[offsets]


# -- piece BPE --------------------------------------------------------------------------------

_BLANK = "▁"


class PieceCounts(dict):
    """Memo: chunk to its number of tokens, through the ``sentencepiece`` library.

    The library turns blanks into U+2581 and puts one before the text. No piece of the
    vocabulary holds U+2581 after another character, and none holds a line feed, so tokens
    never cross the start of a run of blanks nor a line feed (one byte token).
    """

    def __init__(self, path: str):
        super().__init__()
        self.parts: dict[str, int] = {}
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.library.encode(text))

    def __missing__(self, chunk: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        head, *rest = chunk.split("\n")
        found = self.count(head) if head and not rest else self.part(head, "")
        for x in rest:
            found += self.part(x, "\n")
        self[chunk] = found
        return found

    def part(self, text: str, before: str) -> int:
        """Tokens of ``text`` after a blank (none) or of a line feed and ``text``."""
        if not text:
            return 1
        key = before + text
        found = self.parts.get(key)
        if found is None:
            if len(self.parts) >= MEMO_ENTRIES:
                self.parts.clear()
            # after a line feed the library's own leading blank is one token more
            found = self.parts[key] = self.count(key) - (1 if before else 0)
        return found

    def odd(self, text: str) -> list[tuple[int, int]]:
        """``characters, tokens`` of each chunk of a text with runs of blanks or U+2581."""
        import re

        found = []
        marked = text.replace(" ", _BLANK)
        for k, m in enumerate(re.finditer(f"^{_BLANK}*[^{_BLANK}]*|{_BLANK}+[^{_BLANK}]*", marked)):
            piece = m[0] if k == 0 else m[0][1:]  # the library puts the first blank back
            if m[0] or k:
                found.append((len(m[0]), self.count(piece.replace(_BLANK, " ")) if piece else 1))
        return found


@lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


def piece_prefixes(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``first row, row offsets, characters, tokens`` per block of texts (null: empty).

    ``characters[offsets[i] : offsets[i + 1]]`` and the same slice of ``tokens`` are the
    running sums over the chunks of row ``i``: every prefix that ends at a chunk's end.
    """
    memo = piece_counts(path)
    for at, part in blocks(texts):
        part = pc.fill_null(part, "")
        odd = pc.match_substring_regex(part, f"^ |  |{_BLANK}").to_numpy(zero_copy_only=False)
        usual = pc.if_else(pa.array(odd), "", part) if odd.any() else part
        offsets, index, distinct = chunk_index(pc.split_pattern(usual, " "))
        names = distinct.to_pylist()
        count = np.fromiter((memo[w] for w in names), dtype=np.int64, count=len(names))[index] if len(index) else np.zeros(0, np.int64)
        width = (pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64) + 1)[index]
        empty = (pc.binary_length(usual).to_numpy(zero_copy_only=False) == 0) & (np.diff(offsets) == 1)
        count[offsets[:-1][empty]] = 0
        width[offsets[:-1][:]] -= 1  # no blank stands before the first chunk
        if odd.any():
            counts, widths, sizes = [], [], []
            for i in range(len(part)):
                if odd[i]:
                    pairs = memo.odd(part[i].as_py())
                    widths.append(np.array([p[0] for p in pairs], dtype=np.int64))
                    counts.append(np.array([p[1] for p in pairs], dtype=np.int64))
                else:
                    widths.append(width[offsets[i] : offsets[i + 1]])
                    counts.append(count[offsets[i] : offsets[i + 1]])
                sizes.append(len(counts[-1]))
            count, width = np.concatenate(counts), np.concatenate(widths)
            offsets = np.concatenate(([0], np.cumsum(sizes)))
        total, wide = np.cumsum(count), np.cumsum(width)
        each = np.diff(offsets)
        before = lambda s: np.repeat(np.concatenate(([0], s))[offsets[:-1]], each)
        yield at, offsets, wide - before(wide), total - before(total)
