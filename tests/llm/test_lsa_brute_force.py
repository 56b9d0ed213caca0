"""Latent search against an exhaustive one: numpy's own SVD, every window with every item, a plain longest common subsequence."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import common, lsa
from tests.llm.test_methods import _lcs, table, words_of


def exhaustive(space, idf, items, texts):
    """(text, item) with the best LCS and answer shares, comparing every window of every text with every window of every item."""
    out = {}
    for t, words in enumerate(texts):
        if not len(words):
            continue
        b = lsa.blocks(words, np.array([0, len(words)]))
        v = lsa.windows(b, space.projection)
        for i, w in enumerate(items):
            if not len(w):
                continue
            if len(w) < lsa.MIN_WORDS:
                if any((words[k : k + len(w)] == w).all() for k in range(len(words) - len(w) + 1)):
                    out[t, i] = (1.0, 1.0)
                continue
            q = lsa.windows(lsa.blocks(w, np.array([0, len(w)])), space.projection)
            q = q[:-1] if len(q) > 1 else q
            unique = np.unique(w)
            rare = unique[np.argsort(-idf[unique & np.uint32(lsa.BUCKETS - 1)], kind="stable")][: lsa.ANSWER_WORDS]
            kind = -(-len(w) // 64)
            before, after = (2, 4) if kind == 1 else (4 * kind, 4 * kind + 1)
            for k in range(len(v)):
                if (v[k] @ q.T).max() < lsa.COSINE:
                    continue
                region = words[max(0, k - before) * lsa.HALF : (k + after) * lsa.HALF]
                answer = np.isin(rare, region).sum()
                share = _lcs(w.tolist(), region.tolist()) / len(w)
                if answer >= np.ceil(lsa.ANSWER * len(rare) - 1e-9) and share >= lsa.LCS:
                    old = out.get((t, i), (0, 0))
                    out[t, i] = (max(old[0], share), max(old[1], answer / len(rare)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_search_is_exhaustive(seed):
    rng = np.random.default_rng(seed)
    vocabulary = rng.integers(0, 2**32, 400, dtype=np.uint32)
    items = [rng.choice(vocabulary, n) for n in (9, 17, 30, 64, 65, 100, 150, 3, 1, 7, 0, 40)]
    texts = [rng.choice(vocabulary, n) for n in (0, 1, 8, 40, 200, 500)]
    for w in items:
        changed = np.where(rng.random(len(w)) < rng.choice([0, 0.2, 0.4]), rng.choice(vocabulary, len(w)), w)
        texts.append(np.concatenate([rng.choice(vocabulary, rng.integers(0, 90)), changed, rng.choice(vocabulary, rng.integers(0, 90))]))
    idf = np.append(rng.random(lsa.BUCKETS) + 0.5, 0).astype(np.float32)
    projection = np.append(rng.standard_normal((lsa.BUCKETS, 12)), np.zeros((1, 12)), axis=0).astype(np.float32) * idf[:, None]
    space = lsa.Space(projection, *lsa.prepare(list(range(len(items))), items, idf, projection))
    found = {}
    first = np.cumsum([0, *map(len, texts)])
    for row, item, share, answer in lsa.search(space, np.concatenate(texts).astype(np.uint32), first):
        for key, a, b in zip(zip(row.tolist(), item.tolist()), share, answer):
            old = found.get(key, (0, 0))
            found[key] = (max(old[0], a), max(old[1], b))
    expected = exhaustive(space, idf, items, texts)
    assert len(expected) > 8 and found.keys() == expected.keys()
    for k in expected:
        assert found[k] == pytest.approx(expected[k])


def test_long_lcs():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, (12, 192)).astype(np.uint32), rng.integers(0, 9, (12, 300)).astype(np.uint32)
    size, there = rng.integers(1, 193, 12), rng.random((12, 300)) < 0.8
    assert lsa.lcs(a, size, b, there).tolist() == [_lcs(a[i, : size[i]].tolist(), b[i][there[i]].tolist()) for i in range(12)]


def test_factor_spans_what_numpy_finds():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((300, 6)) @ np.diag([9, 7, 5, 4, 3, 2.0]) @ rng.standard_normal((6, 80))
    g = rng.standard_normal((80, 20))
    u, s = lsa.factor(a.T @ (a @ g), g)
    _, exact, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(s[:6], exact[:6], rtol=1e-3)
    assert np.allclose(np.abs(np.sum(u[:, :6] * vt[:6].T, axis=0)), 1, atol=1e-3)


def test_paraphrases_down_to_the_limit(spark, sf_dir, monkeypatch):
    """Of what sequence and answer words admit with any cosine at all, the cosine search finds nine in ten."""
    docs = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents").select("doc_id", "text")
    items = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "benchmark")
    rng = np.random.default_rng(7)
    pool = [w for r in docs.limit(200).collect() for w in words_of(r.text)]
    planted = []
    for r in items.collect():
        for rate in (0.2, 0.3, 0.35, 0.4, 0.45):
            w = [x if rng.random() > rate else pool[rng.integers(len(pool))] for x in words_of(r.text)]
            host = [pool[i] for i in rng.integers(0, len(pool), 300)]
            at = int(rng.integers(0, 300))
            planted.append(" ".join(host[:at] + w + host[at:]))
    space = next(lsa.fit(common.tokenised(docs), items))
    _, _, words = next(common.scan(pa.array(planted)))

    def pairs():
        return {(a, b) for row, item, *_ in lsa.search(space, words.hash.astype(np.uint32), words.first) for a, b in zip(row.tolist(), item.tolist())}

    found = pairs()
    monkeypatch.setattr(lsa, "COSINE", -2.0)
    every = pairs()
    assert len(every) > 60 and found <= every and len(found) >= 0.9 * len(every)


def test_short_items_match_whole_and_in_a_row(spark):
    docs = spark.createDataFrame([(1, "so the answer is forty two here"), (2, "the answer forty is two"), (3, None), (3, "Answer is forty two!"), (3, "Answer is forty two!")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "answer is forty two"), (8, ""), (9, None), (None, "so the")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.lcs) for r in lsa.contamination(docs, items).collect()) == [(1, 7, 1.0), (3, 7, 1.0)]
    assert [r.doc_id for r in lsa.drop_contaminated(docs, items).where("text IS NOT NULL").collect()] == [2]
