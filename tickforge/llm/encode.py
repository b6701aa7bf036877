"""Exact encoding of whole texts with the public tokenizers, made fast for many texts.

Words of a vocabulary with word ends never cross white space, so a text's ids are those of its white-space chunks in a
row. Each Python worker keeps the ids of the chunks it has met, as bytes of little-endian unsigned 32-bit ids; a text is
then a join of cached bytes, and only new chunks reach the tokenizers library. A byte-level vocabulary is handed, from
the same file, to tiktoken, which merges the same pieces to the same ids several times as fast. Texts with characters on
which the libraries could differ, or with the content of an added token, which the library recognises inside a text, go
to the tokenizers library as they are.
"""

from __future__ import annotations

import os
import re

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks and pieces that a worker keeps at most; it then starts anew.
CACHE_ENTRIES = 400_000
#: Control characters that the libraries class differently, and white space too long for tiktoken's pattern.
_ODD = re.compile(r"[\x1c-\x1f]|\s{5000}")
#: Below this code point letters need no canonical composition and have plain lower case.
_NOT_PLAIN = re.compile("[^\x00-įı-ɏ]")
#: Punctuation that forms one piece after a word, whatever its length.
_MARKS = ".,;:!?*#$%&|()"
#: The split patterns and the byte alphabet of the two vocabularies.
_SPLIT = {
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
}


def _byte_alphabet() -> dict[int, str]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Memo(dict):
    """A dict that fills missing keys by a function and empties itself when full."""

    def __init__(self, fill):
        self.fill = fill

    def __missing__(self, key):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[key] = self.fill(key)
        return value


class Encoder:
    """Whole texts to ids; ``path`` is a tokenizers JSON file whose words end in a suffix or whose bytes keep spaces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.words = bool(self.model.end_of_word_suffix)
        if self.words:
            self.split = regex.compile(_SPLIT["word"]).findall
            self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
            self.pieces = _Memo(self._piece)
            self.chunks = _Memo(self._chunk)
        else:
            self.bytewise = self._bytewise()

    def _bytewise(self):
        """The same vocabulary in tiktoken: its merges are made in the order of the ids."""
        from tiktoken import Encoding

        byte = {ord(shown): b for b, shown in self.alphabet.items()}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(byte[ord(c)] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in special}
        return Encoding("bytewise", pat_str=_SPLIT["byte"], mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            shown = piece
        else:
            shown = piece.encode().decode("latin1").translate(self.alphabet)
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(shown)])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a plain chunk; a word before plain punctuation, the usual case, needs no pattern."""
        core = chunk.rstrip(_MARKS)
        if core.isalpha():
            return self.pieces[core] + self.pieces[chunk[len(core) :]] if len(core) < len(chunk) else self.pieces[core]
        return b"".join(map(self.pieces.__getitem__, self.split(chunk)))

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        if not text.isascii() and _NOT_PLAIN.search(text) or _ODD.search(text):
            return self._whole(text)
        lower = text.lower()  # in any case of letters, as a token may be sought in the normalized text
        if any(content in lower for content in self.added):
            return self._whole(text)
        if self.words:
            return b"".join(map(self.chunks.__getitem__, lower.split()))
        return np.array(self.bytewise(text), "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; operators take any other path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
