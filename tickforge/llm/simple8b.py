"""Simple-8b word-aligned coding of unsigned integers, encoded and decoded by numpy for many lists at once.

A 64-bit word holds a selector in its top four bits and values of one width below. Selectors 0 to 13 give how many
values of how many bits a word holds; selector 15 is the escape: the word's payload is an index into a list of raw
64-bit values, for values of over 60 bits. The last word of a list may hold fewer values than its selector says, as
the list's length is stored. ``block_offsets`` has, for every ``BLOCK`` words, how many values come before them, so
that a reader can decode from any block on.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: values a word, and their bits, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1], np.int64)
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 0], np.int64)
ESCAPE, BLOCK = 15, 128


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 1 at least."""
    bits = np.ones(len(values), np.uint8)
    for b in range(1, 64):
        above = values >= np.uint64(1 << b)
        if not above.any():
            break
        bits += above
    return bits


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each position the selector that packs most of the values from there on."""
    n = len(bits)
    best = np.full(n, 13, np.uint8)
    padded = np.concatenate([bits, np.zeros(64, np.uint8)])
    best[bits > 60] = ESCAPE
    widest, size = padded, 1
    for selector in range(12, -1, -1):  # from two values a word up to sixty
        while size < COUNTS[selector]:
            step = min(size, int(COUNTS[selector]) - size)
            widest = np.concatenate([np.maximum(widest[:-step], widest[step:]), widest[-step:]])
            size += step
        fits = widest[:n] <= WIDTHS[selector]
        if not fits.any():
            break
        best[fits] = selector
    return best


def encode(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists laid end to end, with their lengths, to words, words a list, block offsets, blocks a list, escapes, escapes a list."""
    values, lengths = np.asarray(values, np.uint64), np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    best = _selectors(_bits(values))
    end_of = np.repeat(ends, lengths)
    following = np.minimum(np.arange(len(values)) + COUNTS[best], end_of).tolist()
    starts, at = [], 0
    while at < len(values):  # one step a word
        starts.append(at)
        at = following[at]
    starts = np.array(starts, np.int64)
    chosen, end_of = best[starts], end_of[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        rows = np.flatnonzero(chosen == selector)
        if selector == ESCAPE:
            continue
        for k in range(COUNTS[selector]):
            at = starts[rows] + k
            inside = at < end_of[rows]
            words[rows[inside]] |= values[at[inside]] << np.uint64(k * WIDTHS[selector])
    per_list = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    owner = np.repeat(np.arange(len(lengths)), per_list)
    within = np.arange(len(words)) - np.repeat(np.cumsum(per_list) - per_list, per_list)
    first = within % BLOCK == 0
    offsets = (starts - np.repeat(ends - lengths, per_list))[first].astype(np.uint32)
    escaped = np.flatnonzero(chosen == ESCAPE)
    per_escape = np.bincount(owner[escaped], minlength=len(lengths))
    words[escaped] |= (np.arange(len(escaped)) - np.repeat(np.cumsum(per_escape) - per_escape, per_escape)).astype(np.uint64)
    return words, per_list, offsets, np.bincount(owner[first], minlength=len(lengths)), values[starts[escaped]], per_escape


def decode(words: np.ndarray, per_list: np.ndarray, lengths: np.ndarray, escapes: np.ndarray, per_escape: np.ndarray) -> np.ndarray:
    """The values of all lists, end to end."""
    words, lengths = np.asarray(words, np.uint64), np.asarray(lengths, np.int64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    ends = np.cumsum(lengths)
    starts = np.cumsum(counts) - counts
    first_word = np.cumsum(per_list) - per_list
    has = per_list > 0
    shift = np.zeros(len(lengths), np.int64)
    shift[has] = (ends - lengths)[has] - starts[first_word[has]]
    starts = starts + np.repeat(shift, per_list)
    end_of = np.repeat(ends, per_list)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    base = np.repeat(np.cumsum(per_escape) - per_escape, per_list)
    for selector in np.unique(selectors):
        rows = np.flatnonzero(selectors == selector)
        if selector == ESCAPE:
            index = (words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)
            out[starts[rows]] = np.asarray(escapes, np.uint64)[base[rows] + index]
            continue
        mask = np.uint64((1 << int(WIDTHS[selector])) - 1)
        for k in range(COUNTS[selector]):
            at = starts[rows] + k
            inside = at < end_of[rows]
            out[at[inside]] = (words[rows[inside]] >> np.uint64(k * WIDTHS[selector])) & mask
    return out


def decode_from(words: np.ndarray, length: int, offsets: np.ndarray, escapes: np.ndarray, block: int) -> np.ndarray:
    """The values of one list from a block on, without reading the words before it."""
    rest, left = words[block * BLOCK :], length - int(offsets[block])
    return decode(rest, np.array([len(rest)]), np.array([left]), escapes, np.array([len(escapes)]))
