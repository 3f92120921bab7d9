"""Whole texts to token ids with a public tokenizer file, through caches of words that live as long as the worker."""

from __future__ import annotations

import re
from array import array

import regex
from tokenizers import Tokenizer

END_ID = 1
#: What the caches of a worker hold at most, keys, values and places in the table together: long words don't stay.
CACHE_BYTES, ENTRY_BYTES, LONGEST = 64 << 20, 200, 64

#: White space as the tokenizer's normaliser has it; str.split() takes four control characters more.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_CONTROL = re.compile("[\x1c-\x1f]")
#: Punctuation that ends words.
MARKS = ".,!?;:"
#: Below U+0100 a word is in composed form, and lower-casing goes letter by letter.
_PLAIN = re.compile("[\x21-\x7e\xa1-\xff]+")


def _byte_letters() -> list[str]:
    """The letter that byte-level models write for each byte: itself where printable, else the next one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for byte in range(256):
        out.append(chr(byte if byte in own else spare))
        spare += byte not in own
    return out


class _Pieces(dict):
    """Ids of one piece of the tokenizer's own split; those that are words of small letters are held by their words."""

    def __init__(self, model) -> None:
        super().__init__()
        self.room = CACHE_BYTES // 4 // ENTRY_BYTES
        self.tokenize = model.tokenize
        self.letters = str.maketrans(dict(enumerate(_byte_letters())))

    def encode(self, piece: str) -> bytes:
        # Printable ASCII is written as itself.
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) < self.room and len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class WordTokenizer(dict):
    """Ids, as little-endian unsigned 32-bit integers, of texts whose tokenizer splits at white space.

    The tokenizer must drop white space and never join across it; word_bpe_49k.json is of that kind, and the
    constructor refuses others. A text is then the chain of its words, each of which the library encodes once.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.room = CACHE_BYTES * 3 // 4 // ENTRY_BYTES
        self.library = Tokenizer.from_file(path)
        probe = self.library.encode("ab c", add_special_tokens=False).ids
        apart = [i for w in ("ab", "c") for i in self.library.encode(w, add_special_tokens=False).ids]
        if probe != apart:
            raise ValueError(f"{path}: this tokenizer keeps or crosses white space")
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.pieces = _Pieces(self.library.model)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else re.compile(r"(?!)")
        # Else a word of letters, with one of these marks or none after it, holds no special token.
        self.special_letters = any(t.isalpha() or t[-1:] in MARKS and (t[:-1].isalpha() or not t[:-1]) for t in special)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4

    def __missing__(self, word: str) -> bytes:
        low = word.lower()
        body, mark = (low, "") if low.isalpha() else (low[:-1], low[-1:])
        if (not mark or mark in MARKS and body.isalpha()) and not self.special_letters and (word.isascii() or _PLAIN.fullmatch(word)):
            ids = self.pieces.encode(word) if word == body else self[body]
            if mark:
                ids += self.pieces[mark]
        elif _PLAIN.fullmatch(word) and not self.special.search(word):
            ids = b"".join(map(self.pieces.__getitem__, self.split(low)))
        else:
            ids = array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()
        if len(self) < self.room and len(word) <= LONGEST:
            self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """All ids of a text without the end id; null counts as empty. A lone word of any length is one step."""
        if not text:
            return b""
        words = text.split() if not _CONTROL.search(text) else filter(None, _SPACE.split(text))
        return b"".join([self[w] for w in words])


_LOADED: dict[str, WordTokenizer] = {}


def load(path: str) -> WordTokenizer:
    """The tokenizer of this worker process, read once."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
