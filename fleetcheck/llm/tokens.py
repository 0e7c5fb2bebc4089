"""Token ids of whole texts with public tokenizers, word by word with a per-process cache.

Neither tokenizer used here merges across white space, so the ids of a text are those of its words in
order; a word seen before is not encoded again. Texts outside that rule go to the library whole.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np

CACHE_WORDS = 300_000  # words held per worker process, unless fewer are asked for; further ones are put together each time
CACHE_UNITS = 600_000  # units of words held as well; further ones are encoded each time
CACHE_PIECES = 100_000  # words whose sentencepiece counts are held
CACHE_LEN = 64  # longer ones are encoded each time
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
#: Fixed by byte-level vocabularies: the character that stands for each byte
_BYTES = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
_CHAR = {b: chr(b) for b in _BYTES} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _BYTES)}


class WordIds(dict):
    """bytes of a word -> its ids as little-endian uint32 bytes, for the vocabulary with word ends.

    Words of plain letters with punctuation behind are two units of that tokenizer, so the letters (in lower case)
    and the punctuation go to its model apart; every other word goes to the library as it is.
    """

    def __init__(self, path: str, words: int = CACHE_WORDS, units: int = CACHE_UNITS):
        super().__init__()
        from tokenizers import Tokenizer

        self.most_words, self.most_units = words, units
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.units: dict[bytes, bytes] = {}
        self.by_unit = self._whole("Don,t-") == self._unit("don") + self._unit(",") + self._unit("t") + self._unit("-")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        chars = unit if unit.isascii() else unit.encode().decode("latin-1").translate(_CHAR)
        return array("I", [t.id for t in self.model.tokenize(chars)]).tobytes()

    def _new_unit(self, unit: bytes) -> bytes:
        ids = self._unit(unit.decode())
        if len(self.units) < self.most_units and len(unit) <= CACHE_LEN:
            self.units[unit] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        units = self.units
        if not self.by_unit:
            ids = self._whole(word.decode())
        elif word.isalpha():  # of bytes: ASCII letters only
            unit = word.lower()
            ids = units.get(unit) or self._new_unit(unit)
        elif word[-1] in b".," and (stem := word[:-1]).isalpha():
            unit, mark = stem.lower(), word[-1:]
            ids = (units.get(unit) or self._new_unit(unit)) + (units.get(mark) or self._new_unit(mark))
        elif plain := _PLAIN.fullmatch(word.decode()):
            ids = b""
            for u in plain.groups():
                if u:
                    unit = u.lower().encode()
                    ids += units.get(unit) or self._new_unit(unit)
        else:
            ids = self._whole(word.decode())
        if len(self) < self.most_words and len(word) <= CACHE_LEN:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """ids of a whole text (null: none). bytes.split() parts at ASCII white space, which the tokenizer drops.

        The tokenizer lowers its input, all but its special strings, so a text without them is lowered here first.
        """
        raw = (text or "").encode()
        if b"<|" not in raw:
            raw = raw.lower()
        return np.frombuffer(b"".join(map(self.__getitem__, raw.split())), dtype="<u4")


class PieceCounts(dict):
    """A word -> its number of sentencepiece tokens (a word stands for ``▁word`` as at the start of a text)."""

    def __init__(self, path: str):
        super().__init__()
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        pieces = (self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size()))
        self.by_word = (not any("▁" in p.lstrip("▁") for p in pieces)
                        and self.processor.encode("x y", out_type=str) == ["▁x", "▁y"])

    def __missing__(self, word: str) -> int:
        n = len(self.processor.encode(word))
        if len(self) < CACHE_PIECES and len(word) <= CACHE_LEN:
            self[word] = n
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a whole text. Only single inner blanks part words; other texts are encoded whole."""
        if not text:
            return 0
        if not self.by_word or "  " in text or "▁" in text or "\0" in text or text[0] == " " or text[-1] == " ":
            return len(self.processor.encode(text))
        return sum(map(self.__getitem__, text.split(" ")))


@functools.lru_cache(maxsize=4)
def word_ids(path: str, words: int = CACHE_WORDS, units: int = CACHE_UNITS) -> WordIds:
    return WordIds(path, words, units)


@functools.lru_cache(maxsize=4)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


def forget() -> None:
    """Drop this process's tokenizers and caches: a worker stays between stages, and a later one may not encode at all."""
    word_ids.cache_clear()
    piece_counts.cache_clear()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
