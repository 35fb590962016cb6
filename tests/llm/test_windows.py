"""Repeated byte and word windows against brute force, and their engines."""

import brute
import numpy as np
import pytest

from trailmark.llm import substring_dedup, suffix_dedup
from trailmark.llm.fm_index import FMIndex, WaveletMatrix, suffix_array
from trailmark.llm.windows import Segments, spread


def random_segments(seed, symbols=2):
    rng = np.random.default_rng(seed)
    width, m = int(rng.integers(2, 12)), int(rng.integers(1, 30))
    n = rng.integers(1, 6, m)
    tokens = rng.integers(0, symbols, int((n + width - 1).sum()))
    s = Segments(n, tokens.astype(np.uint8), rng.integers(0, 9, m), np.arange(m) * 20, width)
    b = s.bounds
    windows = [(bytes(s.tokens[b[i] + o : b[i] + o + width]), s.ids[i], s.starts[i], o) for i in range(m) for o in range(n[i])]
    return s, windows


@pytest.mark.parametrize("seed", range(25))
def test_engines_agree_with_brute_force(seed):
    s, windows = random_segments(seed)
    assert suffix_dedup.earlier_in_smaller_document(s).tolist() == [any(v[0] == w[0] and v[1] < w[1] for v in windows) for w in windows]
    wide = Segments(s.n, s.tokens.astype(np.uint64), s.ids, s.starts, s.width)
    assert substring_dedup.earlier_copy(wide).tolist() == [any(v[0] == w[0] and v[1:] < w[1:] for v in windows) for w in windows]


@pytest.mark.parametrize("seed", range(10))
def test_longest_previous_factor(seed):
    s, windows = random_segments(seed)

    def common(a, b):
        return next((k for k in range(len(a)) if a[k] != b[k]), len(a))

    value = np.array([w[1] for w in windows])
    got = suffix_dedup.longest_previous_factor(s.tokens, spread(s.bounds[:-1], s.n), value, s.width, 1)
    assert got.tolist() == [max((common(w[0], v[0]) for v in windows if v[1] < w[1]), default=0) for w in windows]


def test_wavelet_matrix_counts():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 37, 500)
    at, which = rng.integers(0, 501, 200), rng.integers(0, 37, 200)
    got = WaveletMatrix(symbols, 37).rank(at, which)
    assert got.tolist() == [int((symbols[:i] == c).sum()) for i, c in zip(at, which)]


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(5)
    text = np.append(rng.integers(1, 4, 300), 0)
    assert [tuple(text[i : i + 8]) for i in suffix_array(text, 8)] == sorted(tuple(text[i : i + 8]) for i in range(301))
    index = FMIndex(text, 4, 8)
    low, high = np.array([0]), np.array([301])
    pattern = text[40:46]
    for c in pattern[::-1]:
        low, high = index.extend(np.array([c]), low, high)
    assert high[0] - low[0] == sum(np.array_equal(text[i : i + 6], pattern) for i in range(296))


@pytest.mark.parametrize("hot", [20_000, 2])
def test_bytes(docs, corpus, hot):
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, texts=False, hot=hot).collect()}
    assert got == brute.byte_repeats([(i, t) for i, t, *_ in corpus])


@pytest.mark.parametrize("hot", [20_000, 2])
def test_words(docs, corpus, hot):
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.remove_repeats(docs, texts=False, hot=hot).collect()}
    assert got == brute.word_repeats([(i, t) for i, t, *_ in corpus])


def test_small_blocks_and_chunks(docs, corpus, monkeypatch):
    import trailmark.llm.windows as windows

    monkeypatch.setattr(windows, "BLOCK_BYTES", 100)
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.remove_repeats(docs, width=5, gram=2, texts=False).collect()}
    assert got == brute.word_repeats([(i, t) for i, t, *_ in corpus], 5)


def test_kept_texts(docs):
    import hashlib

    for r in suffix_dedup.remove_repeats(docs).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    for r in substring_dedup.remove_repeats(docs).collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("module", [suffix_dedup, substring_dedup])
def test_edges(module, no_docs, awkward):
    assert module.remove_repeats(no_docs).collect() == []
    rows = module.remove_repeats(awkward, width=3, gram=2).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "2", "3", "None", "None"]
    kept = [r for r in rows if r.doc_id == 1]
    # Rows of one id are one document: bytes of the same document stay, words that repeat in it go.
    assert sorted(r.n_removed for r in kept) == ([0, 0] if module is suffix_dedup else [0, 3])
    assert max(r.n_removed for r in rows if r.doc_id is None) == (15 if module is suffix_dedup else 3)
