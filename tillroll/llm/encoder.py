"""Token ids of whole texts by a public tokenizer, word by word with a bounded cache.

The tokenizer (BPE with word ends) cuts texts at white space and between letters and other
characters before it merges anything, so a text's ids are those of its pieces one after another.
Most words and pieces repeat; each is encoded once per worker and looked up afterwards.
"""

from __future__ import annotations

import os
import re
import struct

# letters (ASCII and beyond) or a run of other characters; used on texts for which this cut is exact
LETTERS_OR_OTHERS = re.compile(rb"[a-z\x80-\xff]+|[^a-z\x80-\xff\s]+")
# UTF-8 of U+00C0 to U+027F (letters, but for the signs and the dotted capital below) and ASCII without the apostrophe
PLAIN_BYTES = bytes(b for b in range(128) if b != 0x27) + bytes(range(0x80, 0xC0)) + bytes(range(0xC3, 0xCA))
UNLIKE = re.compile(rb"<\||\xc3\x97|\xc3\xb7|\xc4\xb0")
# Words on which a file's merges, applied to bytes in printable form, have to agree with its whole tokenizer.
PROBES = ("a", "the", "zebra", "Élève", "ñandú", "straße", "œuvre", "ŵyłą", "ǅungla", "unverwechselbar", "ãÃâÂ")
MARKS = b",.;:!?"
CACHE_WORDS, CACHE_PIECES = 250_000, 400_000  # values kept, and as many set aside
KEPT_BYTES = 64  # longer words and pieces are encoded each time


def _printable() -> dict[int, int]:
    """Byte to the character that stands for it in byte-level vocabularies: itself where it prints, else the
    next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


PRINTABLE = _printable()


class _Cache(dict):
    """Made values by key; keys beyond `KEPT_BYTES` are made anew. Beyond `most` values what is there is
    set aside, and a key that comes again is taken back from it, until the next time."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > KEPT_BYTES:
                return value
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


def _is_plain(text: bytes) -> bool:
    return not text.translate(None, PLAIN_BYTES) and not UNLIKE.search(text)


class WordEncoder:
    """Encodes as the tokenizer file at `path` does, without special tokens.

    Ids are little-endian unsigned 32-bit. A word between white space is looked up whole; a new one is put
    together from its pieces, of which there are far fewer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.of_piece = _Cache(self._encode, CACHE_PIECES)
        self.of_word = _Cache(self._put_together, CACHE_WORDS)
        words = [w.encode() for w in PROBES]
        self.by_merges = False
        try:
            self.by_merges = all(self._merged(w.lower()) == self._whole(w) for w in words)
        except KeyError:  # letters that the vocabulary writes in another way
            pass

    def _whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merged(self, letters: bytes) -> bytes:
        """Ids of a run of letters by the merges alone, several times as fast."""
        text = letters.decode().lower()
        if not letters.isascii():
            text = text.encode().decode("latin-1").translate(PRINTABLE)
        ids = [t.id for t in self.tokenizer.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, piece: bytes) -> bytes:
        """Ids of a piece of a plain word: its first byte tells letters from others."""
        first = piece[0]
        return self._merged(piece) if self.by_merges and (97 <= first <= 122 or first >= 128) else self._whole(piece)

    def _put_together(self, word: bytes) -> bytes:
        # most words are ASCII letters alone, or with one mark behind; what they are made of is plain to see
        if word.isalpha():
            return self.of_piece[word.lower()]
        if word[-1] in MARKS and word[:-1].isalpha():
            return self.of_piece[word[:-1].lower()] + self.of_piece[word[-1:]]
        if not _is_plain(word):
            return self._whole(word)
        return b"".join(map(self.of_piece.__getitem__, LETTERS_OR_OTHERS.findall(word.lower())))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text."""
        out = []
        for text in texts:
            self.of_word.trim()
            self.of_piece.trim()
            out.append(b"".join(map(self.of_word.__getitem__, text.split())))
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this process for a file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
