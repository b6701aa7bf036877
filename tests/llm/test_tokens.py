"""Encoding, token files, packing and length counts against the tokenizers library."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import TEXTS
from tickforge.llm import op01_token_files as files
from tickforge.llm import op07_packing as packing
from tickforge.llm import op10_token_counts as counts
from tickforge.llm import simple8b
from tickforge.llm.encode import encoder, vocabulary

ODD = ["a  b", "a \n b\n\n  c ", "DON'T don't we'LL", "\x1cx\x1dy", "a b", "<|endoftext|>", "İ ΣΑΣ ß ŉ", "½ ²3 123", "x\u0085y", "😀👍🏽", "a\n \nb", " " * 7000 + "x", "q" * 3000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoding_equals_the_library(name, small):
    mine = encoder(vocabulary(name))
    for text in ODD + [t or "" for _, t, _ in TEXTS] + [r.text for r in small.select("text").collect()]:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == mine.tokenizer.encode(text, add_special_tokens=False).ids, text[:60]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_inside_texts(name):
    """Against the library as it is loaded, with no setting of ours."""
    from tokenizers import Tokenizer

    fresh, mine = Tokenizer.from_file(vocabulary(name)), encoder(vocabulary(name))
    for token in ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof text|>"):
        for text in (f"a {token} b", f"a{token}b", f"{token}\n{token}", f"It's {token}, café 東京", token * 40):
            assert np.frombuffer(mine.encode(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids, text
    if name.startswith("byte"):
        assert np.frombuffer(mine.encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]


VALUES = st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=300), max_size=8)


@settings(max_examples=150, deadline=None)
@given(VALUES)
def test_simple8b_round_trip(lists):
    flat = np.array([v for x in lists for v in x], np.uint64)
    lengths = np.array([len(x) for x in lists], np.int64)
    words, per, offsets, blocks, escapes, per_escape = simple8b.encode(flat, lengths)
    assert simple8b.decode(words, per, lengths, escapes, per_escape).tolist() == flat.tolist()
    assert per.sum() == len(words) and blocks.sum() == len(offsets)


def test_simple8b_from_a_block_and_size():
    values = np.arange(5000, dtype=np.uint64) % 50_000
    words, per, offsets, _, escapes, _ = simple8b.encode(values, np.array([5000]))
    for block in range(len(offsets)):
        assert simple8b.decode_from(words, 5000, offsets, escapes, block).tolist() == values[offsets[block] :].tolist()
    assert len(simple8b.encode(np.zeros(6000, np.uint64), np.array([6000]))[0]) == 100


def expected_ids(rows, name, end):
    tok = encoder(vocabulary(name)).tokenizer
    return [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for i, t in rows]


def test_token_files(docs, nothing, spark):
    written = files.write_ids(docs)
    got = sorted(tuple(r) for r in files.read_ids(written).collect())
    rows = sorted(((i, t) for i, t, _ in TEXTS), key=lambda r: (r[0], r[1] or ""))
    at, want = 0, []
    for i, ids in expected_ids(rows, "word_bpe_49k.json", 2):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
    order = [r.doc_id for r in written.orderBy("shard", "local_start").collect()]
    assert order == sorted(order)
    assert files.read_ids(files.write_ids(nothing)).count() == 0


def check_packing(found, rows, capacity):
    want = Counter()
    for i, ids in expected_ids(rows, "byte_bpe_50k.json", 0):
        n, at, piece = len(ids), 0, 0
        size = n if n <= capacity else n % capacity or capacity
        while at < n:
            want[i, piece, at, size, zlib.crc32(ids[at : at + size].tobytes())] += 1
            at, piece, size = at + size, piece + 1, capacity
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-sum(r.length for r in found) // capacity)


def test_packing(docs, nothing, small):
    used, least = check_packing(packing.pack(docs).collect(), [(i, t) for i, t, _ in TEXTS], 2048)
    assert used == least
    used, least = check_packing(packing.pack(small).collect(), [(r.doc_id, r.text) for r in small.collect()], 2048)
    assert used <= least * 1.01 + 1
    assert packing.pack(nothing).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 12), max_size=12))
def test_plan_places_every_piece(histogram):
    plan = packing.Plan(histogram, 40)
    filled, seen = {}, Counter()
    for length, rank, n, first, offset in plan.segments:
        for k in range(n):
            seen[length, rank + k] += 1
            filled.setdefault(first + k, []).append((offset, length))
    assert seen == Counter((length, r) for length, n in histogram.items() for r in range(n))
    assert len(filled) == plan.sequences
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 40


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for room in sorted({*bins}):
            if room >= items[k]:
                rest = list(bins)
                rest.remove(room)
                go(k + 1, [*rest, room - items[k]])
        go(k + 1, [*bins, capacity - items[k]])

    go(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(3, 20), min_size=1, max_size=8))
def test_reduction_keeps_the_optimum(items):
    """Fixing dominating sets never costs a sequence: what they fix and the best packing of the rest is optimal."""

    class Reduced(packing.Plan):
        def best_fit(self):
            pass

    plan = Reduced(dict(Counter(items)), 20)
    rest = [x for x, n in plan.left.items() for _ in range(n)]
    assert plan.sequences + (optimum(rest, 20) if rest else 0) == optimum(items, 20)


def test_length_histogram(docs, nothing):
    hist = counts.histogram(counts.lengths(docs))
    tok = encoder(vocabulary("byte_bpe_50k.json")).tokenizer
    n = sorted(len(tok.encode(t or "", add_special_tokens=False).ids) for _, t, _ in TEXTS)
    for r in hist.collect():
        x = r.encoded_length
        longer = [m for m in n if m > x]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (n.count(x), len([m for m in n if m >= x]), sum(m for m in n if m >= x))
        assert (r.docs_cut, r.tokens_cut) == (len(longer), sum(longer) - x * len(longer))
        assert r.share_within == pytest.approx(1 - len(longer) / len(n))
    assert sum(r.n_docs for r in hist.collect()) == len(n)
    for r in counts.at_limits(hist, [0, 10, 2048, 10**6]).collect():
        assert r.tokens_kept == sum(min(m, r.context_limit) for m in n)
    found = {r.share: r.encoded_length for r in counts.quantiles(hist, [0.5, 1.0]).collect()}
    assert found == {0.5: n[-(-len(n) // 2) - 1], 1.0: n[-1]}
    assert counts.histogram(counts.lengths(nothing)).count() == 0
