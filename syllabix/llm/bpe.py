"""Words of a lower-casing byte-pair vocabulary, and their tokens.

The vocabulary file is a JSON description for the ``tokenizers`` library: NFC, lower
case, words cut by a pattern, bytes written as characters, a mark on the last symbol of
a word. Word cutting is done here for texts of Latin letters and by the library for all
others; both give the same words.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

from tokenizers import Tokenizer

# Fixed values of the vocabulary's word pattern.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACES = "\t\n\x0b\x0c\r \x85\xa0"
END_OF_WORD = "</w>"
# Code points below this are cut here: no combining marks, no context-dependent case.
LATIN_END = 0x250
# Words of usual length remembered per Python worker; at this number the memory is emptied.
MAX_REMEMBERED, USUAL_LENGTH = 250_000, 64
# Bits of a heap entry that hold the position; no text has a word of a terabyte.
POSITION_BITS = 40
POSITION_MASK = (1 << POSITION_BITS) - 1


def _latin_pattern() -> re.Pattern:
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for code in range(LATIN_END):
        kind = unicodedata.category(chr(code))[0]
        if kind in kinds:
            kinds[kind].append(re.escape(chr(code)))
    letters, numbers = "".join(kinds["L"]), "".join(kinds["N"])
    return re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{SPACES}{letters}{numbers}]+")


def _byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(byte if byte in printable else next(free)) for byte in range(256)]


class Vocabulary:
    """Merge ranks, special strings and word cutting of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(described["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self._split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self._latin_words = _latin_pattern().findall
        self._other = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]").search
        self._characters = dict(enumerate(_byte_characters()))

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings, which are kept as segments of their own."""
        return self._split_special(text) if "<|" in text else [text]

    def words(self, segment: str) -> list[str]:
        """Normalised words of a text without special strings, as plain text."""
        lowered = segment.lower()
        if self._other(lowered):
            segment = self.library.normalizer.normalize_str(segment)
            return [segment[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(segment)]
        return self._latin_words(lowered)

    def symbols(self, word: str) -> str:
        """One character per byte of the word."""
        return word.encode("utf-8").decode("latin-1").translate(self._characters)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per Python worker."""
    return Vocabulary(path)


def merged_length(characters: str, ranks: dict[tuple[str, str], int]) -> int:
    """Number of tokens of a word: its symbols minus the merges that apply.

    The adjacent pair of lowest rank (leftmost among equals) is merged until no pair has
    a rank. Symbols form a linked list and pairs wait in a heap, so a word of n bytes
    takes O(n log n); entries made stale by a merge are recognised when popped.
    """
    symbol = list(characters)
    last = len(symbol) - 1
    symbol[last] += END_OF_WORD
    rank_of = ranks.get
    # A heap entry is rank and left position in one number.
    heap = [rank << POSITION_BITS | i for i, rank in enumerate(map(rank_of, pairwise(symbol))) if rank is not None]
    if not heap:
        return last + 1
    heapify(heap)
    after, before = list(range(1, last + 2)), list(range(-1, last))
    merges = 0
    while heap:
        entry = heappop(heap)
        i = entry & POSITION_MASK
        j = after[i]
        left = symbol[i]
        if left is None or j > last or rank_of((left, symbol[j])) != entry >> POSITION_BITS:
            continue
        symbol[i] = left = left + symbol[j]
        symbol[j] = None
        merges += 1
        after[i] = k = after[j]
        if k <= last:
            before[k] = i
            if (rank := rank_of((left, symbol[k]))) is not None:
                heappush(heap, rank << POSITION_BITS | i)
        if (h := before[i]) >= 0 and (rank := rank_of((symbol[h], left))) is not None:
            heappush(heap, rank << POSITION_BITS | h)
    return last + 1 - merges


class Lengths(dict):
    """Token number by word, computed on first use."""

    def __init__(self, path: str):
        super().__init__()
        self.vocabulary = vocabulary(path)

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_REMEMBERED:
            self.clear()
        length = merged_length(self.vocabulary.symbols(word), self.vocabulary.ranks)
        if len(word) <= USUAL_LENGTH:
            self[word] = length
        return length

    def of(self, text: str) -> int:
        """Tokens of a text; a special string in it is one."""
        vocabulary, total = self.vocabulary, 0
        for segment in vocabulary.segments(text):
            total += 1 if segment in vocabulary.special else sum(map(self.__getitem__, vocabulary.words(segment)))
        return total


class Identifiers(dict):
    """Token identifiers by word as little-endian unsigned 32-bit bytes, given by the library's model."""

    def __init__(self, path: str):
        super().__init__()
        self.vocabulary = vocabulary(path)
        self._tokenize = self.vocabulary.library.model.tokenize

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MAX_REMEMBERED:
            self.clear()
        tokens = self._tokenize(self.vocabulary.symbols(word))
        found = b"".join(t.id.to_bytes(4, "little") for t in tokens)
        if len(word) <= USUAL_LENGTH:
            self[word] = found
        return found

    def of(self, text: str) -> bytes:
        """Identifiers of a text, one after another."""
        vocabulary, parts = self.vocabulary, []
        for segment in vocabulary.segments(text):
            if segment in vocabulary.special:
                parts.append(vocabulary.special[segment].to_bytes(4, "little"))
            else:
                parts.extend(map(self.__getitem__, vocabulary.words(segment)))
        return b"".join(parts)


@lru_cache(maxsize=4)
def lengths(path: str) -> Lengths:
    return Lengths(path)


@lru_cache(maxsize=4)
def identifiers(path: str) -> Identifiers:
    return Identifiers(path)
