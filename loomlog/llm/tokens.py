"""Token ids of whole texts, word by word, with a bounded cache.

A tokenizer that takes white space for a boundary treats what stands between two spaces by itself, so a text's ids are those of its
pieces in turn. Frequent pieces are encoded once in a worker's life and then looked up. A new piece goes the shortest way that holds
for it: words of plain letters straight to the model, punctuation around a word apart from it, all else to the tokenizer. Each of
these ways is tried on the tokenizer at hand before it is used; where one fails, whole texts go to the tokenizer.
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterable

#: Pieces that a worker remembers of the last texts, and as many of those before.
CACHE_WORDS = 200_000
#: Bytes of text that are cut into pieces at once.
SLICE_BYTES = 2 << 20
_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = "\t\n\x0b\f\r "
_PUNCTUATION = string.punctuation.encode()
#: Pieces on which the ways through the tokenizer are compared.
_PROBE = ["a", "the", "tion", "ouier", "zzxq", "internationalisation", "é", "straße", "日本", "1", "x9", "it's", "--", "a.b", string.ascii_lowercase]
_ENCODERS: dict[int, WordEncoder] = {}


def vocabulary(name: str = "word_bpe_49k.json", path: str | None = None) -> str:
    """The tokenizer's JSON, read on the driver (a few MB, whatever the input) and sent to the executors."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def _byte_letters() -> dict[int, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


class _Pieces(dict):
    """Ids by piece; a piece that is not there yet is encoded."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, piece: bytes) -> bytes:
        ids = self[piece] = self.encode(piece)
        return ids


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, source: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.size = self.tokenizer.get_vocab_size()
        self.known, self.older = _Pieces(self._piece), {}
        self.letters: dict[str, bool] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.bytes = _byte_letters()
        alone = self._ids(_PROBE)
        #: White space separates, in any amount, and leaves no ids.
        self.cuts = self._ids([f" {a}{s}{s}{b}\n" for s in _SPACE for a in _PROBE for b in _PROBE]) == [x + y for _ in _SPACE for x in alone for y in alone]
        mixed = [f"{a}{x}{b}" for x in string.ascii_uppercase for a in ("", "q", "é") for b in ("", "z", "ö", "9")]
        self.lower = self.cuts and self._ids(mixed) == self._ids([w.lower() for w in mixed])
        plain = [a + b for a in string.ascii_lowercase for b in ("", *string.ascii_lowercase)] + [w for w in _PROBE if w.isalpha()]
        self.plain = self.cuts and [self._model(w.encode()) for w in plain] == self._ids(plain)
        marks = [m + n for m in string.punctuation for n in ("", *string.punctuation)]
        of = dict(zip(marks, self._ids(marks), strict=True))
        before, after = self._ids([f"{m}q" for m in marks]), self._ids([f"q{m}" for m in marks])
        (q,) = self._ids(["q"])
        #: Punctuation before and after a letter makes a piece of its own; before it, not if an apostrophe comes last.
        self.marks = self.cuts and all(b == q + of[m] and (m[-1] == "'" or a == of[m] + q) for m, a, b in zip(marks, before, after, strict=True))

    @classmethod
    def of(cls, source: str) -> WordEncoder:
        """The worker's own encoder for this vocabulary."""
        key = zlib.crc32(source.encode())
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = cls(source)
        return _ENCODERS[key]

    def _ids(self, pieces: Iterable[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(list(pieces), add_special_tokens=False)]

    def _model(self, word: bytes) -> bytes:
        """Straight to the model, for a word in which there is nothing to normalise or to cut."""
        text = word.decode() if word.isascii() else word.decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()

    def _is_plain(self, letter: str) -> bool:
        """A letter up to U+024F that normalising leaves alone and that never joins another."""
        found = self.letters.get(letter)
        if found is None:
            found = letter.isalpha() and ord(letter) < 0x250 and letter.lower() == letter and not unicodedata.combining(letter)
            if found:
                words = [letter, f"q{letter}", f"{letter}q", letter * 2]
                found = [self._model(w.encode()) for w in words] == self._ids(words)
            self.letters[letter] = found
        return found

    def _stands_apart(self, letter: str, mark: str) -> bool:
        """Is punctuation after this letter a piece of its own? Not if the letter's last part is, normalised, no letter."""
        found = self.apart.get((letter, mark))
        if found is None:
            whole, before, after = self._ids([letter + mark, letter, mark])
            joined, longer = self._ids([f"q{letter}{mark}", f"q{letter}"])
            found = self.apart[letter, mark] = whole == before + after and joined == longer + after
        return found

    def _piece(self, w: bytes) -> bytes:
        if (seen := self.older.get(w)) is not None:
            return seen
        if self.plain and w.isalpha() and w.islower():  # of ASCII
            return self._model(w)
        if self.marks and b"<" not in w:
            word = w.rstrip(_PUNCTUATION)
            if 0 < len(word) < len(w):
                if word.isalpha() or not word.isascii() and (t := word.decode("utf-8", "surrogatepass")).isalpha() and self._stands_apart(t[-1], chr(w[len(word)])):
                    return self.known[word] + self.known[w[len(word) :]]
            else:
                word = w.lstrip(_PUNCTUATION)
                if 0 < len(word) < len(w) and word[0] < 0x80 and w[-len(word) - 1] != 39:
                    return self.known[w[: -len(word)]] + self.known[word]
        t = w.decode("utf-8", "surrogatepass")
        if self.plain and all(map(self._is_plain, t)):
            return self._model(w)
        return self._ids([t])[0]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text (UTF-8; null: empty). Lower-casing A-Z first makes more pieces alike, if the tokenizer does so anyway."""
        if not self.cuts:
            return self._ids((t or b"").decode("utf-8", "surrogatepass") for t in texts)
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, _Pieces(self._piece)
        ids, lower = self.known.__getitem__, self.lower
        # Special tokens are written in small letters and would be found in a lower-cased text.
        return [b"".join(map(ids, (t.translate(_LOW) if lower and b"<|" not in t else t).split())) if t else b"" for t in texts]
