"""Expected counts against all state paths, and long texts in stretches."""

import itertools

import numpy as np
import pytest

from tessera.llm import hmm


def model(k, b, seed=0):
    rng = np.random.default_rng(seed)
    return hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(b), k).T.copy())


def counted(m, seqs):
    first = np.cumsum([0, *map(len, seqs)])
    flat, counts = np.concatenate(seqs).astype(np.int64), np.zeros((len(m.pi), len(m.e)))
    xi, starts, total = np.zeros((len(m.pi),) * 2), np.zeros(len(m.pi)), 0.0
    for _, begin, lengths in hmm.chunks(first):
        lay = hmm.lanes(begin, lengths)
        if len(lay.order):
            x, s, ll = hmm.expected(m, flat[lay.source], lay, counts)
            xi, starts, total = xi + x, starts + s, total + ll
    return counts, xi, starts, total


def enumerated(m, seqs):
    k = len(m.pi)
    counts, xi, starts, total = np.zeros((k, len(m.e))), np.zeros((k, k)), np.zeros(k), 0.0
    for s in seqs:
        if not len(s):
            continue
        weights = {z: np.prod([(m.pi[z[0]] if i == 0 else m.a[z[i - 1], z[i]]) * m.e[s[i], z[i]] for i in range(len(s))]) for z in itertools.product(range(k), repeat=len(s))}
        whole = sum(weights.values())
        total += np.log(whole)
        for z, w in weights.items():
            starts[z[0]] += w / whole
            for i in range(len(s)):
                counts[z[i], s[i]] += w / whole
                if i:
                    xi[z[i - 1], z[i]] += w / whole
    return counts, xi, starts, total


@pytest.mark.parametrize("stretch", [600_000, 1, 3, 7])
def test_counts_are_those_of_all_paths(stretch, monkeypatch):
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    rng = np.random.default_rng(1)
    m = model(3, 6)
    seqs = [rng.integers(0, 6, n) for n in (5, 0, 1, 5, 3, 2)]
    for a, b in zip(counted(m, seqs), enumerated(m, seqs)):
        assert np.allclose(a, b)


def test_a_long_text_is_one_sequence(monkeypatch):
    rng = np.random.default_rng(2)
    m = model(4, 50, 3)
    seqs = [rng.integers(0, 50, 40_000), rng.integers(0, 50, 10)]
    whole = counted(m, seqs)
    monkeypatch.setattr(hmm, "STRETCH", 1000)
    for a, b in zip(counted(m, seqs), whole):
        assert np.allclose(a, b)
    assert whole[2].sum() == pytest.approx(2) and whole[1].sum() == pytest.approx(40_008) and whole[0].sum() == pytest.approx(40_010)
