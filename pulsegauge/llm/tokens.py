"""Token ids of whole texts, with each distinct piece of text encoded once per Python worker."""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata
from array import array

#: Pieces remembered per worker and table (about 200 bytes each), twice: a full table becomes the old one, from which
#: pieces that are met again return, and the old one goes. So memory stays bounded and frequent pieces stay known.
PIECES = 450_000
#: Words on which the direct way is compared with the library's own before it is used.
PROBES = ("the", "Straße", "ÉTÉ", "naïve", "Zürich", "ПРИВЕТ", "日本語", "ſ", "ﬁn", "İstanbul", "ΣΑΣ", "ñandú", "Ǆ")
# byte-level vocabularies write a byte as its Latin-1 character if that is visible, and the others in order from U+0100
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_NAMES = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
# white space beside the space and the line end, first what ASCII has of it
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_ASCII_SPACES = [c for c in _SPACES if c.isascii()]
_DOUBLED = ("  ", " \n", "\n ", "\n\n")
_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")


class _Pieces(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit bytes, filled on demand.

    ``space`` is put before each piece that does not begin with a newline. A comma or full stop after a
    letter is a pre-token of its own in the vocabularies used, so such pieces share the ids of the rest, unless
    the vocabulary's normaliser takes the letter apart: a mark at its end would join the sign.
    """

    def __init__(self, encode, encode_word, space: str):
        super().__init__()
        self._encode, self._encode_word, self._space = encode, encode_word, space
        self._old = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self._old.get(piece)
        if ids is not None:
            pass
        elif piece.isalpha():
            ids = self._encode_word(self._space, piece)
        elif piece[-1:] in (",", ".") and piece[-2:-1].isalpha() and unicodedata.normalize("NFC", piece[-2]).lower().isalpha():
            ids = self[piece[:-1]] + self._encode(piece[-1])
        elif piece.startswith("\n"):
            ids = self._encode(piece)
        else:
            ids = self._encode(self._space + piece) if piece else b""
        if len(self) >= PIECES:
            self._old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Ids of texts by a vocabulary file of the ``tokenizers`` library.

    The text is cut where the vocabulary's own pre-tokenizer always cuts: before a space or line end
    that follows other text. Byte-level vocabularies keep the space with the next piece; vocabularies
    with word ends drop white space. Texts with other white space, or an unknown kind of vocabulary, are
    encoded in one go. So are texts that hold the string of an added token, which the library gives its own id.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(added), re.IGNORECASE) if added else None
        self.vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        word_end = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        byte_level = type(self._tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self._kind = "dropped" if word_end else "kept" if byte_level else "unknown"
        self._model = self._tokenizer.model
        same = self._kind != "unknown" and all(self._word(s, w) == self._direct(s + w) for w in PROBES for s in self._spaces())
        word = self._word if same else lambda space, text: self._direct(space + text)
        self._first = _Pieces(self._direct, word, "")
        self._later = _Pieces(self._direct, word, self._spaces()[-1])

    def _spaces(self) -> tuple[str, ...]:
        return ("", " ") if self._kind == "kept" else ("",)

    def _direct(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, space: str, word: str) -> bytes:
        """The ids of a word of letters, which is one pre-token, from the vocabulary's model alone.

        Vocabularies that drop white space compose and lower-case a text first; words for which that is not
        the same as Python's lower-casing are left to the library.
        """
        if self._kind == "dropped" and not (word.isascii() and word.islower()):
            if "Σ" in word or not unicodedata.is_normalized("NFC", word) or not (low := word.lower()).isalpha():
                return self._direct(word)
            word = low
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_NAMES)
        return array("I", [t.id for t in self._model.tokenize("Ġ" + word if space else word)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit bytes; a null text is empty."""
        if not text:
            return b""
        if self._added and self._added.search(text):
            return self._direct(text)
        if self._kind == "dropped":
            return b"".join(map(self._later.__getitem__, text.replace("\n", " ").split(" ")))
        odd = _ASCII_SPACES if text.isascii() else _SPACES
        if self._kind == "unknown" or any(c in text for c in odd):
            return self._direct(text)
        if text[0] == " " or text[-1] in " \n" or any(pair in text for pair in _DOUBLED):
            return b"".join(map(self._first.__getitem__, _UNIT.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return b"".join([self._first[first] if first else b"", *map(self._later.__getitem__, rest)])


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it outlives the task, as the worker does."""
    kept = sys.modules.setdefault("_worker_encoders", types.ModuleType("_worker_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
