"""Subword lattices of many words at once: forward and backward sums over all segmentations, in log space."""

from __future__ import annotations

from copy import copy
from functools import lru_cache

import numpy as np

#: Bytes from which letters are no longer plain, no longer Latin of two bytes, and the end of all bytes.
_KINDS = (0x80, 0xD0, 0x100)
_BASE, _MIX, _BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 18
#: Bytes from which a word's expected uses are summed by blocks of so many places, so that no more of its arcs are held.
_PLACES = 2048


@lru_cache(maxsize=2)
def lattice_of(path: str) -> Lattice:
    """This worker's lattice of a vocabulary with its first weights."""
    return Lattice(*vocabulary_pieces(path))


def vocabulary_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece model as bytes (a word's start is a space) with log scores to begin with.

    The model's scores are merge ranks; they weigh pieces by Zipf's law. All 256 bytes are pieces, so that every text
    has a segmentation. Control pieces and pieces with a space inside can't occur in a word.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    known: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:] and piece == piece.lower():
            known[piece] = -np.log(10.0 - model.get_score(i))
    lowest = min(known.values(), default=0.0)
    for b in range(256):
        known.setdefault(bytes([b]), lowest)
    scores = np.array(list(known.values()))
    return list(known), scores - np.logaddexp.reduce(scores)


class Lattice:
    """Segmentations of words into pieces, of log probability ``scores``."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        self.none = len(pieces)
        # pieces of plain letters, of two-byte Latin ones too, and all: a word needs no longer piece than its kind has
        self.longest = [max((len(p) for p in pieces if max(p) < top), default=1) for top in _KINDS]  # in bytes
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest[-1] + 1)], np.uint64)
        self.keys = np.zeros(1 << _BITS, np.uint64)
        self.values = np.full(1 << _BITS, self.none, np.int32)
        self.probes = 1
        for length in sorted({len(p) for p in pieces}):
            same = [i for i, p in enumerate(pieces) if len(p) == length]
            letters = np.frombuffer(b"".join(pieces[i] for i in same), np.uint8).reshape(len(same), length)
            for i, h in zip(same, self._prefixes(letters)[-1].tolist(), strict=True):
                at = (h * int(_MIX) & (2**64 - 1)) >> 64 - _BITS
                step = 1
                while self.keys[at]:
                    at, step = (at + 1) % (1 << _BITS), step + 1
                self.keys[at], self.values[at], self.probes = h, i, max(self.probes, step)
        self.scores = np.append(scores, -np.inf)  # the last: no such piece

    def weighed(self, scores: np.ndarray) -> Lattice:
        """The same pieces with other log probabilities."""
        other = copy(self)
        other.scores = np.append(scores, -np.inf)
        return other

    @staticmethod
    def _prefixes(letters: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all prefixes: a row a length, a column a word."""
        out = np.zeros((letters.shape[1] + 1, letters.shape[0]), np.uint64)
        for i in range(letters.shape[1]):
            out[i + 1] = out[i] * _BASE + letters[:, i] + np.uint64(1)
        return out

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes * _MIX >> np.uint64(64 - _BITS)).astype(np.int64)
        keys = self.keys[at]
        found = np.where(keys == hashes, self.values[at], self.none)
        again = np.flatnonzero((keys != hashes) & (keys != 0))
        flat, out = hashes.ravel(), found.ravel()
        at = at.ravel()[again]
        for _ in range(self.probes - 1):
            if not len(again):
                break
            at = (at + 1) & ((1 << _BITS) - 1)
            keys = self.keys[at]
            hit = keys == flat[again]
            out[again[hit]] = self.values[at[hit]]
            go = ~hit & (keys != 0)
            again, at = again[go], at[go]
        return out.reshape(hashes.shape)

    def _forward(self, words: list[bytes], lengths: np.ndarray, longest: int, keep: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        top = int(lengths.max())
        letters = np.frombuffer(b"".join(w.ljust(top, b"\0") for w in words), np.uint8).reshape(len(words), top)
        prefixes = self._prefixes(letters)
        alpha = np.full((top + 1, len(words)), -np.inf)
        alpha[0] = 0.0
        kept = []
        for i in range(1, top + 1):
            m = min(i, longest)
            ids = self._find(prefixes[i][None, :] - prefixes[i - m : i] * self.powers[m:0:-1, None])
            sums = alpha[i - m : i] + self.scores[ids]
            most = sums.max(0)
            alpha[i] = most + np.log(np.exp(sums - most).sum(0))
            if keep:
                kept.append(ids)
        return alpha, kept

    def _arcs(self, letters: np.ndarray, first: int, past: int, longest: int) -> np.ndarray:
        """Pieces that end at the places first to past - 1 of one word: a row a place, from the longest to the last letter."""
        ends = np.arange(first, past)
        ids, hashes = np.full((len(ends), longest), self.none, np.int32), np.zeros(len(ends), np.uint64)
        for k in range(1, min(longest, past - 1) + 1):
            whole = max(0, k - first)
            hashes[whole:] += (letters[ends[whole:] - k] + np.uint64(1)) * self.powers[k - 1]
            ids[whole:, longest - k] = self._find(hashes[whole:])
        return ids

    def _expected_long(self, word: bytes, count: float, longest: int) -> np.ndarray:
        """Expected uses of each piece over one word of any length; 8 bytes a place are held, and the arcs of one block."""
        letters, n = np.frombuffer(word, np.uint8), len(word)
        # place i is at longest + i: what comes before the word can't be reached
        alpha = np.full(longest + n + 1, -np.inf)
        alpha[longest] = 0.0
        blocks = [(at, min(at + _PLACES, n + 1)) for at in range(1, n + 1, _PLACES)]
        for first, past in blocks:
            scores = self.scores[self._arcs(letters, first, past, longest)]
            for i in range(first, past):
                sums = alpha[i : i + longest] + scores[i - first]
                most = sums.max()
                alpha[i + longest] = most + np.log(np.exp(sums - most).sum())
        total, shift = np.zeros(self.none + 1), np.log(count) - alpha[-1]
        # of the places that the block's pieces begin at; the block after has its part in the last of them
        beta = np.full(longest, -np.inf)
        beta[-1] = 0.0
        for first, past in reversed(blocks):
            ids = self._arcs(letters, first, past, longest)
            scores = self.scores[ids]
            beta = np.concatenate([np.full(past - first, -np.inf), beta])
            for i in range(past - 1, first - 1, -1):
                at = i - first
                np.logaddexp(beta[at : at + longest], scores[at] + beta[at + longest], out=beta[at : at + longest])
            starts = np.lib.stride_tricks.sliding_window_view(alpha[first : past - 1 + longest], longest)
            used = np.exp(starts + scores + beta[longest:, None] + shift)
            total += np.bincount(ids.ravel(), used.ravel(), self.none + 1)
            beta = beta[:longest]
        return total

    def _batches(self, words: list[bytes], cells: int = 400_000):
        """Words of one kind and about one length together, so that padding is small: places, words, lengths, longest piece."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        kinds = np.searchsorted(_KINDS, np.fromiter(map(max, words), np.int64, len(words)), "right")
        for kind, longest in enumerate(self.longest):
            mine = np.flatnonzero(kinds == kind)
            order = mine[np.argsort(lengths[mine], kind="stable")]
            at = 0
            while at < len(order):
                # the last word of a batch is its longest
                n = max(1, min(len(order) - at, cells // (longest * int(lengths[order[at]]) or 1)))
                while n > 1 and n * int(lengths[order[at + n - 1]]) * longest > 2 * cells:
                    n //= 2
                yield order[at : at + n], [words[k] for k in order[at : at + n]], lengths[order[at : at + n]], longest
                at += n

    def log_probabilities(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability under each row of piece weights: a row a row of weights. Pieces are looked up once."""
        out = np.zeros((len(weights), len(words)))
        scores = np.concatenate([weights, np.full((len(weights), 1), -np.inf)], axis=1)
        for where, some, lengths, longest in self._batches(words, 400_000 // len(weights)):
            top = int(lengths.max())
            letters = np.frombuffer(b"".join(w.ljust(top, b"\0") for w in some), np.uint8).reshape(len(some), top)
            prefixes = self._prefixes(letters)
            # only the last places are held, however long a word is
            alpha = np.empty((longest + 2048, len(weights), len(some)))
            alpha[0], base = 0.0, 0
            ends = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths).tolist()}
            for i in range(1, top + 1):
                m = min(i, longest)
                if i - base == len(alpha):
                    alpha[:longest] = alpha[-longest:]
                    base = i - longest
                at = i - base
                ids = self._find(prefixes[i][None, :] - prefixes[i - m : i] * self.powers[m:0:-1, None])
                sums = alpha[at - m : at] + scores[:, ids].swapaxes(0, 1)
                most = sums.max(0)
                alpha[at] = most + np.log(np.exp(sums - most).sum(0))
                if i in ends:
                    out[:, where[ends[i]]] = alpha[at][:, ends[i]]
        return out

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability, summed over all its segmentations."""
        out = np.zeros(len(words))
        for where, some, lengths, longest in self._batches(words):
            alpha, _ = self._forward(some, lengths, longest, keep=False)
            out[where] = alpha[lengths, np.arange(len(some))]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over the words, each counted so often."""
        total = np.zeros(self.none + 1)
        for where, some, lengths, longest in self._batches(words):
            if lengths[-1] > _PLACES:
                for k, word in zip(where, some, strict=True):
                    total += self._expected_long(word, counts[k], longest)
                continue
            alpha, kept = self._forward(some, lengths, longest, keep=True)
            columns, top = np.arange(len(some)), len(kept)
            beta = np.full((top + 1, len(some)), -np.inf)
            beta[lengths, columns] = 0.0
            shift = np.log(counts[where]) - alpha[lengths, columns]
            for i in range(top, 0, -1):
                m = min(i, longest)
                ids = kept[i - 1]
                step = self.scores[ids] + beta[i]
                beta[i - m : i] = np.logaddexp(beta[i - m : i], step)
                used = np.exp(alpha[i - m : i] + step + shift)
                total += np.bincount(ids.ravel(), used.ravel(), self.none + 1)
        return total[:-1]
