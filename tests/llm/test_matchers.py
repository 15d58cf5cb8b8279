"""The matchers of the passage operators on small arrays, against brute force."""

import numpy as np
import pytest

from panelweave.llm import fmindex, lpf


def _longest(seq, i, held, depth):
    best = 0
    for h in held:
        for j in range(len(h)):
            k = 0
            while k < depth and i + k < len(seq) and j + k < len(h) and seq[i + k] == h[j + k]:
                k += 1
            best = max(best, k)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    letters, depth = int(rng.integers(1, 6)), int(rng.integers(2, 9))
    held = [rng.integers(0, letters, rng.integers(1, 30)) for _ in range(5)]
    sent = [rng.integers(0, letters + 1, rng.integers(1, 30)) for _ in range(4)] + [held[2]]
    index = fmindex.Index(np.concatenate(held), np.array([len(x) for x in held]), letters + 1, depth)
    length, begin = index.statistics(np.concatenate(sent), np.array([len(x) for x in sent]))
    want = [_longest(list(x), i, [list(h) for h in held], depth) for x in sent for i in range(len(x))]
    assert length.tolist() == want
    # Each interval begins at a suffix that holds the match.
    text = np.concatenate([np.append(h, -1 - i) for i, h in enumerate(held)])
    flat = [(x, i) for x in sent for i in range(len(x))]
    for (x, i), n, b in zip(flat, length, begin):
        spot = index.order[b]
        assert text[spot : spot + n].tolist() == list(x[i : i + n])


@pytest.mark.parametrize("seed", range(6))
def test_longest_previous_factors_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    window = 20
    texts = [bytes(rng.choice(list(b"ab"), window)) for _ in range(40)] + [b"a" * window] * 3
    place = rng.integers(0, 12, len(texts))
    order = sorted(range(len(texts)), key=lambda i: texts[i])
    steps = [0, 8, window - 8]
    keys = [np.array([int.from_bytes(texts[i][s : s + 8], "big") for i in order], np.uint64) for s in steps]
    shared = lpf.shared_prefixes(keys, steps, window)

    def common(a, b):
        return next((k for k in range(window) if a[k] != b[k]), window)

    assert shared.tolist() == [0] + [common(texts[a], texts[b]) for a, b in zip(order, order[1:])]
    got = lpf.longest_previous_factors(place[order], shared)
    assert got.tolist() == [max((common(texts[i], texts[j]) for j in range(len(texts)) if place[j] < place[i]), default=0) for i in order]


def test_windows_come_from_the_search(monkeypatch):
    from panelweave.llm.passages import Shard

    text = " ".join(f"w{i}" for i in range(25))
    data = [f"{text} tail".encode(), f"{text} end".encode()]
    shard = Shard(np.frombuffer(b"".join(data), np.uint8), np.array([0, len(data[0]), len(data[0]) + len(data[1])]), np.array([6, 6]), np.array([3, 9]), np.array([0, 0]), np.array([1, 1]))
    assert fmindex.earlier_matches(shard, fmindex.WORDS).tolist() == [False] * 6 + [True] * 6
    # The matches come from the search alone: without its statistics none is left.
    monkeypatch.setattr(fmindex.Index, "statistics", lambda self, words, sizes: (words * 0, words * 0))
    assert not fmindex.earlier_matches(shard, fmindex.WORDS).any()
